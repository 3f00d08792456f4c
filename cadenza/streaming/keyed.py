"""Each user's last rows and weekly lists as keyed state of a stream.

Only users with new rows are touched by a batch: their rows are in a state store, committed
with the batch's offsets, so a batch that is repeated after a lost executor changes nothing and
no other user's history is read or written.

A row that equals a kept one in all its columns is a replay and counts once. Rows are in order of their
time, then of the other columns (nulls first), not of their arrival, so late rows take their place; rows
without a user or a time are left out. A user's state holds n rows, and n more for each week that
is still open where weekly lists are made.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WEEK = 7 * 86_400_000_000
MONDAY = -3 * 86_400_000_000  # a Monday, in microseconds from 1970
# Microseconds from 1970 of the clock time in a column, and back, without a time zone.
MICROS = "datediff(cast({0} as date), date'1970-01-01') * 86400000000L + hour({0}) * 3600000000L + minute({0}) * 60000000L + cast(extract(second from {0}) * 1000000 as bigint)"
CLOCK = "timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast({} as decimal(18, 0)) / 1000000)"


def monday_after(at: int) -> int:
    """The end of the week, from Monday, that holds a time in microseconds."""
    return at - (at - MONDAY) % WEEK + WEEK


def _order(row: tuple) -> tuple:
    return tuple((x is not None, x) if x is not None else (False,) for x in row)


def _sorted(rows: Iterable[tuple]) -> list[tuple]:
    rows = list(rows)
    try:
        return sorted(rows)  # the same order where no null meets a value
    except TypeError:
        return sorted(rows, key=_order)


class _Rows(StatefulProcessor):
    """State `rows`: by the end of their week, lists of tuples of which the first column is the time in
    microseconds. Rows of a week travel as one value, and only weeks that are asked for travel."""

    def __init__(self, n: int, kinds: dict[str, str]) -> None:
        self.n, self.width, self.kind = n, len(kinds), ", ".join(f"`{c}`: {t}" for c, t in kinds.items())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "week long", f"list array<struct<{self.kind}>>")

    def week(self, at: int) -> int:
        return monday_after(at)

    def weeks(self) -> list[int]:
        return [w for (w,) in self.rows.keys()]

    def held(self, week: int) -> list[tuple]:
        return [tuple(r) for r in self.rows.getValue((week,))[0]]

    def merge(self, rows: Iterator[Row]) -> dict[int, int]:
        """Put rows into the state, a bounded number of them at a time, of which the last n of each week stay.
        Gives the number of rows of each week that has new ones."""
        known, new, out = set(self.weeks()), {}, {}
        for r in rows:
            row = tuple(r)[1 : self.width + 1]
            mine = new.setdefault(self.week(row[0]), set())
            mine.add(row)
            if len(mine) >= self.n + 4096:
                new[self.week(row[0])] = set(_sorted(mine)[-self.n :])
        for week, mine in new.items():
            kept = _sorted(mine.union(self.held(week)) if week in known else mine)[-self.n :]
            self.rows.updateValue((week,), (kept,))
            out[week] = len(kept)
        return out

    def close(self) -> None:
        pass


class LastRows(_Rows):
    """The last n rows of a user, without weeks; gives the users that a batch touched."""

    def week(self, at: int) -> int:
        return 0

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        yield Row(user_id=key[0], rows=self.merge(rows)[0])


class WeeklyRows(_Rows):
    """A timer at the end of each week of which a user has rows gives the user's list for it; then
    the last n rows of that week and all before are kept as one."""

    def __init__(self, n: int, kinds: dict[str, str]) -> None:
        super().__init__(n, kinds)
        self.row = Row("user_id", "week_end", "place", *kinds)

    def closed(self, timers) -> int:
        """The last Monday that the watermark has passed."""
        return monday_after(max(timers.getCurrentWatermarkInMs(), 0) * 1000) - WEEK

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        closed = self.closed(timerValues)
        for end in self.merge(rows):
            if end > closed:
                self.handle.registerTimer(end // 1000)  # of the same time there is one
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        end = expiredTimerInfo.getExpiryTimeInMs() * 1000
        weeks = [w for w in self.weeks() if w <= end]
        before = _sorted({r for w in weeks for r in self.held(w)})[-self.n :]
        new = [r for r in before if r[0] >= end - WEEK]
        listed = [r for r in before if r[0] < end - WEEK][-(self.n // 2) :] + new[-(self.n // 2) :]
        latest = {r[1]: r for r in listed}  # of each song the row that comes last
        for place, r in enumerate(reversed(_sorted(latest.values())), 1):
            yield self.row(key[0], end, place, *r)
        if weeks != [end]:
            self.rows.updateValue((end,), (before,))
            for w in weeks:
                if w != end:
                    self.rows.removeKey((w,))


def _dealt(events: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """(user_id, at, song_id, ...) of a stream of events and the types of what is kept of a row."""
    rest = [c for c in events.columns if c not in ("user_id", "song_id", "ts")]
    rows = events.where("user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", F.expr(MICROS.format("cast(ts as timestamp_ntz)")).alias("at"), "song_id", *rest)
    return rows, dict(rows.drop("user_id").dtypes)


def _started(out: DataFrame, folder: str, mode: str, sink: str | None = None) -> StreamingQuery:
    spark, name = out.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)  # read when the query starts
    try:
        w = out.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        return (w.format("parquet").option("path", sink) if sink else w.format("noop")).start()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def keep_last(events: DataFrame, folder: str, n: int = 50) -> StreamingQuery:
    """Keep the last n rows of each user from a stream of (user_id, song_id, ts, ...) in a folder's
    state, whatever their order of arrival."""
    rows, kinds = _dealt(events)
    key = dict(rows.dtypes)["user_id"]
    out = rows.groupBy("user_id").transformWithState(LastRows(n, kinds), f"user_id {key}, rows long", "Update", "None")
    return _started(out, folder, "update")


def last_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, song_id, ts, ...): what keep_last() or weekly_lists() holds after their last batch."""
    state = spark.read.format("statestore").option("stateVarName", "rows").load(f"{folder}/checkpoint")
    rows = state.select("key.user_id", F.explode("user_map_value.list").alias("row")).select("user_id", "row.*")
    ts = F.expr(CLOCK.format("at")).alias("ts")
    return rows.select("user_id", "song_id", ts, *(c for c in rows.columns if c not in ("user_id", "song_id", "at")))


def weekly_lists(events: DataFrame, folder: str, n: int = 50, late: str = "1 day") -> StreamingQuery:
    """Write (user_id, week_end, place, song_id, ts, ...) to folder/lists: as soon as a week is over by
    the watermark, the list of each user who has rows of it: of the last n rows before its end the last n / 2 of
    the week and the last n / 2 from before, the latest row of each song, latest first. Rows that come later than
    the watermark allows are left out; users without rows of a week keep the list they have."""
    rows, kinds = _dealt(events)
    key = dict(rows.dtypes)["user_id"]
    rows = rows.withColumn("_time", F.timestamp_micros("at")).withWatermark("_time", late)
    made = ", ".join(f"`{c}` {t}" for c, t in kinds.items())
    out = rows.groupBy("user_id").transformWithState(WeeklyRows(n, kinds), f"user_id {key}, week_end long, place long, {made}", "Append", "EventTime")
    rest = [c for c in kinds if c not in ("at", "song_id")]
    out = out.select("user_id", F.expr(CLOCK.format("week_end")).alias("week_end"), "place", "song_id", F.expr(CLOCK.format("at")).alias("ts"), *rest)
    return _started(out, folder, "append", f"{folder}/lists")

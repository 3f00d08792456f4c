"""A mixture of sources by target weights.

Rows get a hash key, are sorted within their source in ranges of the key, and prefix sums
of their words tell where a source's budget is used up: rows before that point are
taken whole, the one at it up to a word, later ones not. A source that is to give more than
it has is taken whole as often as needed, up to `epochs` times, and then cut.

A source's target is weight * level, but no more than epochs times its size. The level at
which the targets add up to the wanted total is found without a loop: with sources sorted by
the level at which they are used up, it is the largest of (total - limits before) /
(weights - weights before) over all sources.

No source and no global sort lands in one task: ranges of the key are equal parts of the
hash, whose sums are added up first (4,096 numbers for a source); sources are put in order
in ranges, too. Equal rows are counted and then numbered. Texts are not shuffled for the
plan, only keys and sizes; mixed() reads them again.

Results for special inputs: a null text, as an empty one, has size 0 and is taken 0 times;
rows without a source are a source of their own, after all others; rows without a key and
equal rows are dealt like any others, and which of several equal rows is cut makes no
difference; very long texts are cut at a word like others; sources without words or with a
weight of 0 or less (or null) have target 0; columns other than key, text and source are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_long, stored

EPOCHS = 3
CHUNK = 4096  # copies of a row that a task numbers at a time
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def word_count(text: str) -> Column:
    """Without an array of the words, so that a text is held twice at most."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WORD, "w"), BLANKS, "")).cast("long")


def cycled(*weights: int) -> Column:
    """The weights in turn for sources in the order of their names."""
    return F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))


def _sums_before(df: DataFrame, order: list[str], name: str, **sums: Column) -> DataFrame:
    """df with the sums over the rows before each row in an order without ties. Ranges of it go to
    partitions, whose sums (a row for each partition) are added up."""
    dealt = stored(df.withColumns({f"_{n}": c for n, c in sums.items()}).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), name)
    parts = dealt.groupBy("_p").agg(*(F.sum(f"_{n}").alias(f"_{n}") for n in sums))
    before = W.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("_p", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_start_{n}") for n in sums))
    inside = W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = {n: F.col(f"_start_{n}") + F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)) for n in sums}
    return dealt.join(F.broadcast(parts), "_p").withColumns(out).drop("_p", *(f"_{n}" for n in sums), *(f"_start_{n}" for n in sums))


def _targets(sources: DataFrame, weight: Column, share: float, epochs: int) -> DataFrame:
    """sources (_s, source_size) with target."""
    named = sources.withColumn("source", F.when(F.col("_s") != "null", F.substr("_s", F.lit(2)))).withColumn("_last", F.col("source").isNull())
    placed = _sums_before(named, ["_last", "_s"], "sources", place=F.lit(1)).withColumn("_w", weight.cast("double")).withColumn("_limit", F.col("source_size") * epochs)
    some = placed.where("_w > 0").withColumn("_full", F.col("_limit") / F.col("_w"))
    before = _sums_before(some.select("_s", "_w", "_limit", "_full"), ["_full", "_s"], "limits", limits=F.col("_limit"), weights=F.col("_w"))
    total = F.broadcast(sources.agg((F.sum("source_size") * share).alias("_total")).join(F.broadcast(some.agg(F.sum("_w").alias("_all")))))
    level = before.join(total).agg(F.max((F.col("_total") - F.col("limits")) / (F.col("_all") - F.col("weights"))).alias("_level"))
    target = F.when(F.col("_w") > 0, F.least(F.col("_limit").cast("double"), F.col("_w") * F.col("_level"))).otherwise(0.0)
    return placed.join(F.broadcast(level)).select("_s", "source_size", target.alias("target"))


def plan(docs: DataFrame, weight: Column | None = None, share: float = 1.0, epochs: int = EPOCHS, seed: int = 42, buckets: int = 4096, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """(key, source, text_md5, size, source_size, target, taken) of each row of docs: its
    words, its source's and the words wanted of that, and how many of its own the mixture
    takes, repeats counted. weight: of a source, a column over `source` and `place` (from 0,
    by code point); share: the wanted words over all there are; buckets: ranges of the key, 4,096 at most."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = as_long(docs, key, text, source).select(key, F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null")).alias("_s"), word_count(text).alias("size"), F.md5(body.cast("binary")).alias("text_md5"))
    same = ["_s", key, "size", "text_md5"]
    # Copies get numbers in chunks, so no task makes all rows of a large group.
    rows = rows.groupBy(*same).agg(F.count("*").alias("_c")).withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor((F.col("_c") - 1) / CHUNK)))).repartition(*same, "_k")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.col("_k") * CHUNK, F.least("_c", (F.col("_k") + 1) * CHUNK) - 1)))
    rows = rows.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*same, "_copy"))).cast("binary"))).drop("_c", "_k", "_copy")
    rows = stored(rows.withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 3), 16, 10).cast("int") * buckets / 4096).cast("int")), "mixing", keep=True)
    ranges = rows.groupBy("_s", "_b").agg(F.sum("size").alias("_n"))
    targets = _targets(ranges.groupBy("_s").agg(F.sum("_n").alias("source_size")), cycled(1, 2, 3) if weight is None else weight, share, epochs)
    start = F.coalesce(F.sum("_n").over(W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    size, budget = F.greatest("source_size", F.lit(1)), F.floor(F.col("target") + 0.5)
    cuts = ranges.withColumn("_start", start).join(targets, "_s").withColumns({"_whole": F.floor(budget / size), "_rest": budget % size}).drop("_n")
    before = F.col("_start") + F.coalesce(F.sum("size").over(W.partitionBy("_s", "_b").orderBy("_h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    taken = F.col("_whole") * F.col("size") + F.greatest(F.lit(0), F.least("size", F.col("_rest") - before))
    name = F.when(F.col("_s") != "null", F.substr("_s", F.lit(2)))
    return rows.join(cuts, ["_s", "_b"]).select(key, name.alias("source"), "text_md5", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """(key, source, epoch, text): the mixture itself, a row for each time that a text is taken. A
    text that is cut has its first words with one space between them."""
    takes = plan(docs, text=text, key=key, source=source, **options).where("taken > 0")
    body = F.coalesce(F.col(text), F.lit(""))
    texts = as_long(docs, key, text, source).select(F.col(key).alias("_key"), F.col(source).cast("string").alias("_of"), F.md5(body.cast("binary")).alias("_md5"), body.alias("_text")).dropDuplicates(["_key", "_of", "_md5"])
    met = takes.join(texts, F.col(key).eqNullSafe(F.col("_key")) & F.col("source").eqNullSafe(F.col("_of")) & (F.col("text_md5") == F.col("_md5")))
    each = met.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    words = F.filter(F.split("_text", f"[{BLANKS}]+"), lambda w: w != "")
    part = F.array_join(F.slice(words, 1, (F.col("taken") - F.col("epoch") * F.col("size")).cast("int")), " ")
    return each.select(key, "source", "epoch", F.when((F.col("epoch") + 1) * F.col("size") <= F.col("taken"), F.col("_text")).otherwise(part).alias(text))

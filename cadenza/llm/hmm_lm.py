"""Language-model scoring with a hidden Markov model.

Tokens are words and one end for each text, which counts as the empty word. Training
documents are those whose crc32(doc_id as text) mod 7 is not 2. Documents are packed into
blocks of some BLOCK_TOKENS tokens, each with the list of its different words.

The model has `states` latent states and an emission of its own for every training word
in each state. Words are dealt to parts by a hash; a part holds for each of its words
the count and which share of it each state is expected to emit, so this table grows with
the corpus and lies apart in tasks. The driver sees only starts, moves and sums. A state
that emits `mass` words in all, of these `g` times one word, gives it the probability
(tokens * (g + PRIOR * share of the word) / (mass + PRIOR) + 1) / (tokens + words + 1);
an unknown word takes the 1. So all word probabilities of a state sum to one, and with
one state the score is that of word counts alone.

Baum-Welch: in every iteration each part answers each block with the numbers of the
block's words, the block runs the scaled forward and backward recursions and sends the
parts what it expects. All words of a block and a part travel as one row of packed arrays.
Iterations end when one betters the training texts' log likelihood by less than TOLERANCE
of it. The score is the scaled forward recursion's exact log10 likelihood of the whole text.

Memory: a task holds one block and the state vectors of WINDOW tokens. For a text that is
longer, forward vectors are kept where windows begin and made again window by window.

Results for special inputs: null and empty texts are the end alone; a null doc_id
counts as the empty text in the split; equal rows each count; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, removed, small_batches, stored, temporary_tables, tidy

STATES = 8
TOLERANCE = 1e-3
BLOCK_TOKENS = 1 << 22
WINDOW = 1 << 20
PARTS, PART_WORDS = 64, 1 << 22  # at least so many parts; words that blocks ask of one
PRIOR = 100  # words that each state emits by their shares besides what it is expected to
WHOLE = 65_535  # shares of a word's count are kept as 16-bit numbers
END = b""


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def packed(x: np.ndarray) -> bytes:
    """The numbers of an array, all first bytes, then all second ones, and so on."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(x.size, x.itemsize).T.tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def blocks_of(docs: DataFrame) -> DataFrame:
    """(block, held_out, doc_ids, lengths, symbols, words, counts, size) of docs (doc_id,
    text, held_out): symbols are places in the block's words, which are in the order of
    their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh():
            return {}, [], [], []

        def row(held_out, index, ids, lengths, texts):
            words = list(index)
            order = np.argsort(_hashes(words), kind="stable")
            place = np.empty(len(words), np.int32)
            place[order] = np.arange(len(words), dtype=np.int32)
            symbols = place[np.concatenate(texts)]
            blobs = [packed(np.array(lengths, np.int32)), packed(symbols), b"\n".join([words[i] for i in order]), packed(np.bincount(symbols))]
            return pa.RecordBatch.from_arrays(
                [pa.array([held_out]), pa.array([ids], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in blobs), pa.array([len(words)], pa.int32())],
                names=["held_out", "doc_ids", "lengths", "symbols", "words", "counts", "size"],
            )

        now, size = {False: fresh(), True: fresh()}, {False: 0, True: 0}
        for b in batches:
            for doc_id, t, held_out in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                index, ids, lengths, texts = now[held_out]
                words = words_of(t.as_py())
                words.append(END)
                texts.append(np.fromiter([index.setdefault(w, len(index)) for w in words], np.int32, len(words)))
                ids.append(doc_id)
                lengths.append(len(words))
                size[held_out] += len(words)
                if size[held_out] >= BLOCK_TOKENS:
                    yield row(held_out, *now[held_out])
                    now[held_out], size[held_out] = fresh(), 0
        for held_out, block in now.items():
            if block[1]:
                yield row(held_out, *block)
        del now
        release()

    kinds = "held_out boolean, doc_ids array<bigint>, lengths binary, symbols binary, words binary, counts binary, size int"
    return docs.select("doc_id", "text", "held_out").mapInArrow(run, kinds).withColumn("block", F.monotonically_increasing_id())


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit  # emit[symbol, state]

    @staticmethod
    def first(states: int) -> Model:
        """Sticky states; what tells them apart is what they emit at first."""
        move = np.full((states, states), 0.05 / max(1, states - 1))
        np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
        return Model(np.full(states, 1 / states), move, np.zeros((0, states)))

    def _forward(self, e: np.ndarray, alive: np.ndarray, now: np.ndarray | None, alpha: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Over a window of emissions [state, time, text], behind the vectors `now`:
        (scale [time, text], last vectors). Vectors go to alpha."""
        start, move = self.start.astype(e.dtype)[:, None], np.ascontiguousarray(self.move.T, e.dtype)
        scale = np.ones(e.shape[1:], e.dtype)
        for t, n in enumerate(alive):
            x, c = (np.empty((len(e), n), e.dtype) if alpha is None else alpha[:, t, :n]), scale[t, :n]
            if now is None:
                x[:] = start
            else:
                np.matmul(move, now[:, :n], out=x)
            x *= e[:, t, :n]
            np.add.reduce(x, 0, out=c)
            x /= c
            now = x
        return scale, now

    def _windows(self, s: np.ndarray) -> list[tuple[int, int]]:
        step = max(1, WINDOW // s.shape[1])
        return [(a, min(a + step, len(s))) for a in range(0, len(s), step)]

    def score(self, s: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """s: symbols [time, text], texts by falling length; alive[t]: texts with a token
        at t. Gives the log10 likelihood of each text."""
        out, now, emit = np.zeros(s.shape[1]), None, np.ascontiguousarray(self.emit.T)
        for a, b in self._windows(s):
            scale, now = self._forward(np.take(emit, s[a:b], axis=1), alive[a:b], now, None)
            out += np.log(scale).sum(0, dtype=np.float64)
        return out / np.log(10)

    def expected(self, s: np.ndarray, alive: np.ndarray, out: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
        """Add the texts' expected counts of starts, moves and emissions to out. Gives
        their log10 likelihood."""
        emit, move = np.ascontiguousarray(self.emit.T, np.float32), self.move.astype(np.float32)
        start, moves, emits = out
        windows, heads = self._windows(s), [None]
        for a, b in windows[:-1]:
            heads.append(self._forward(np.take(emit, s[a:b], axis=1), alive[a:b], heads[-1], None)[1])
        score, k, texts, ahead = 0.0, len(self.start), s.shape[1], None
        xi = np.zeros((k, k))
        for (a, b), head in zip(reversed(windows), reversed(heads), strict=True):
            e = np.take(emit, s[a:b], axis=1)
            alpha, beta = np.zeros_like(e), np.ones_like(e)
            scale, _ = self._forward(e, alive[a:b], head, alpha)
            score += float(np.log(scale).sum(dtype=np.float64)) / np.log(10)
            e *= np.where(np.arange(texts) < alive[a:b, None], 1 / scale, 0)  # zero where a text has no token
            if ahead is not None:
                xi += alpha[:, -1, : ahead.shape[1]] @ ahead.T
            for t in range(b - a - 1, -1, -1):
                if ahead is not None:
                    np.matmul(move, ahead, out=beta[:, t, : ahead.shape[1]])
                ahead = e[:, t, : alive[a + t]]
                ahead *= beta[:, t, : alive[a + t]]
            ahead = ahead.copy()
            xi += alpha.reshape(k, -1)[:, : -texts] @ e.reshape(k, -1)[:, texts:].T
            beta *= alpha  # zero where a text has no token
            if a == 0:
                start += beta[:, 0].sum(1)
            flat = s[a:b].ravel().astype(np.intp)
            for j in range(k):
                emits[:, j] += np.bincount(flat, weights=beta[j].ravel(), minlength=len(emits))
        moves += xi * self.move
        return score


def groups(symbols: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Texts of like length as matrices: (places, symbols [time, text], alive)."""
    order = sorted(range(len(symbols)), key=lambda i: -len(symbols[i]))
    i = 0
    while i < len(order):
        length = len(symbols[order[i]])
        own = order[i : i + max(1, WINDOW // length)]
        i += len(own)
        s = np.zeros((length, len(own)), np.int32)
        for j, at in enumerate(own):
            s[: len(symbols[at]), j] = symbols[at]
        lengths = np.array([len(symbols[at]) for at in own])
        yield own, s, (lengths[None, :] > np.arange(length)[:, None]).sum(1)


#: What travels between parts and blocks: a block's words of a part stand from `first` on in
#: the block and in `slots` of the part, with counts and the states' shares of them. Rows of
#: a part alone have no block, and sums of it.
TABLE = "part long, block long, held_out boolean, first int, slots binary, counts binary, shares binary, sums array<double>"
_NAMES = ("part", "block", "held_out", "first", "slots", "counts", "shares", "sums")
_KINDS = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()))


def _row(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(n)], k) for n, k in zip(_NAMES, _KINDS, strict=True)], names=list(_NAMES))


def _groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows in the order of a key as one run of rows for each value."""
    rows = (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist())
    now = next(rows, None)
    while now is not None:
        value = now[key]

        def run(value=value) -> Iterator[dict]:
            nonlocal now
            while now is not None and now[key] == value:
                yield now
                now = next(rows, None)

        own = run()
        yield value, own
        for _ in own:  # what was not asked for
            pass


def _sums(counts: np.ndarray, shares: np.ndarray) -> list[float]:
    """What each state emits of a part's words, all tokens of them and their number."""
    return [*(counts @ (shares / WHOLE)), float(counts.sum()), float(len(counts))]


def asked_of(blocks: DataFrame, parts: int, states: int, seed: int) -> DataFrame:
    """A row for each block and part with the slots of the words, and one for each part
    with the counts of all its training words and their first shares."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, held_out, raw, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words, counts = raw.split(b"\n"), unpacked(counts, np.int64)
                part = ((_hashes(words) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                ends = np.flatnonzero(np.diff(part, append=np.uint64(parts))) + 1
                for a, z in zip([0, *ends], ends, strict=False):
                    yield _row(part=int(part[a]), block=block, held_out=held_out, first=int(a), slots=b"\n".join(words[a:z]), counts=packed(counts[a:z]))
        release()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _groups_of(batches, "part"):
            index: dict[bytes, int] = {}
            total = np.zeros(0, np.int64)
            for r in rows:
                words = r["slots"].split(b"\n")
                if r["held_out"]:
                    slots = np.array([index.get(w, -1) for w in words], np.int32)
                else:
                    slots = np.array([index.setdefault(w, len(index)) for w in words], np.int32)
                    total = np.concatenate([total, np.zeros(len(index) - len(total), np.int64)])
                    total[slots] += unpacked(r["counts"], np.int64)
                yield _row(part=part, block=r["block"], held_out=r["held_out"], first=r["first"], slots=packed(slots))
            # States differ at random, by the words' hashes, in how much of a word is theirs.
            h = _hashes(list(index))[:, None] ^ np.random.default_rng(seed).integers(0, 2**63, states, dtype=np.uint64)[None, :]
            draws = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) / 2.0**24 + 0.5
            shares = np.rint(draws / draws.sum(1, keepdims=True) * WHOLE).astype(np.uint16)
            yield _row(part=part, held_out=False, counts=packed(total), shares=packed(shares), sums=_sums(total, shares))
        release()

    rows = blocks.select("block", "held_out", "words", "counts").mapInArrow(split, TABLE)
    return rows.repartition("part").sortWithinPartitions("part", "held_out", "block").mapInArrow(assign, TABLE)


def answers(asked: DataFrame, model: DataFrame, states: int) -> DataFrame:
    """The rows asked with the counts and shares of their words; unknown ones have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _groups_of(batches, "part"):
            counts, shares = np.zeros(1, np.int64), np.zeros((1, states), np.uint16)
            for r in rows:
                if r["block"] is None:  # a row of zeros behind the last stands for slot -1
                    counts = np.append(unpacked(r["counts"], np.int64), 0)
                    shares = np.vstack([unpacked(r["shares"], np.uint16).reshape(-1, states), shares[-1:]])
                else:
                    slots = unpacked(r["slots"], np.int32)
                    yield _row(part=part, block=r["block"], held_out=r["held_out"], first=r["first"], slots=r["slots"], counts=packed(counts[slots]), shares=packed(shares[slots]))
        release()

    both = asked.unionByName(model.where("part >= 0"))
    return both.repartition("part").sortWithinPartitions("part", F.col("block").asc_nulls_first()).mapInArrow(run, TABLE)


class Sizes:
    """The sums that emissions depend on."""

    def __init__(self, mass: np.ndarray, total: float, words: float) -> None:
        self.mass, self.total, self.words = mass, total, words

    def emissions(self, counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
        c = counts[:, None].astype(np.float64)
        g = c * shares / WHOLE + PRIOR * c / max(1.0, self.total)
        return (g * (self.total / (self.mass + PRIOR)) + 1) / (self.total + self.words + 1)


def _at_blocks(blocks: DataFrame, answered: DataFrame, f: Callable[[dict, list[dict]], Iterator[pa.RecordBatch]], columns: list[str], kinds: str) -> DataFrame:
    """f(block, answers) for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups_of(batches, "block"):
            block, *own = rows
            yield from f(block, own)
            del block, own
        release()

    both = blocks.select("block", *columns).unionByName(answered.drop("sums"), allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", F.col("part").asc_nulls_first()).mapInArrow(run, kinds)


def _texts(block: dict) -> list[np.ndarray]:
    return np.split(unpacked(block["symbols"], np.int32), np.cumsum(unpacked(block["lengths"], np.int32))[:-1])


def _emissions(block: dict, own: list[dict], sizes: Sizes, states: int) -> np.ndarray:
    emit = np.empty((block["size"], states))
    for r in own:
        counts = unpacked(r["counts"], np.int64)
        emit[r["first"] : r["first"] + len(counts)] = sizes.emissions(counts, unpacked(r["shares"], np.uint16).reshape(-1, states))
    return emit


def expected_in(blocks: DataFrame, answered: DataFrame, model: Model, sizes: Sizes) -> DataFrame:
    """The table of counts and shares that the forward and backward recursions expect,
    with the sums of starts, moves and likelihood as parts below 0."""
    states, start, move = len(model.start), model.start, model.move

    def step(block: dict, own: list[dict]) -> Iterator[pa.RecordBatch]:
        m = Model(start, move, _emissions(block, own, sizes, states))
        out = np.zeros(states), np.zeros((states, states)), np.zeros((block["size"], states))
        texts = _texts(block)
        score = sum(m.expected(s, alive, out) for _, s, alive in groups(texts))
        counts = np.bincount(np.concatenate(texts), minlength=block["size"])
        shares = np.rint(out[2] / np.maximum(out[2].sum(1, keepdims=True), 1e-30) * WHOLE).astype(np.uint16)
        for r in own:
            at = slice(r["first"], r["first"] + len(unpacked(r["slots"], np.int32)))
            yield _row(part=r["part"], slots=r["slots"], counts=packed(counts[at]), shares=packed(shares[at]))
        yield _row(part=-1 - block["block"] % PARTS, sums=[*out[0], *out[1].ravel(), score])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _groups_of(batches, "part"):
            if part < 0:
                yield _row(part=part, sums=np.sum([r["sums"] for r in rows], axis=0).tolist())
                continue
            total, g = np.zeros(0, np.int64), np.zeros((0, states))
            for r in rows:
                slots, counts = unpacked(r["slots"], np.int32), unpacked(r["counts"], np.int64)
                if (more := int(slots.max()) + 1 - len(total)) > 0:
                    total, g = np.append(total, np.zeros(more, np.int64)), np.vstack([g, np.zeros((more, states))])
                total[slots] += counts
                g[slots] += counts[:, None] * (unpacked(r["shares"], np.uint16).reshape(-1, states) / WHOLE)
            shares = np.rint(g / np.maximum(g.sum(1, keepdims=True), 1e-30) * WHOLE).astype(np.uint16)
            yield _row(part=part, held_out=False, counts=packed(total), shares=packed(shares), sums=_sums(total, shares))
        release()

    found = _at_blocks(blocks, answered, step, ["held_out", "lengths", "symbols", "size"], TABLE)
    return found.repartition("part").sortWithinPartitions("part").mapInArrow(gather, TABLE)


def _summed(table: DataFrame) -> dict[bool, np.ndarray]:
    """The sums of parts (True) and of what lies below them (False); a few dozen numbers."""
    sums = table.where("sums IS NOT NULL").select((F.col("part") >= 0).alias("own"), F.posexplode("sums").alias("i", "x"))
    out: dict[bool, dict[int, float]] = {}
    for r in sums.groupBy("own", "i").agg(F.sum("x").alias("x")).collect():
        out.setdefault(r.own, {})[r.i] = r.x
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


def _sizes(sums: dict[bool, np.ndarray], states: int) -> Sizes:
    own = sums.get(True, np.zeros(states + 2))
    return Sizes(own[:states], own[states], own[states + 1])


def train(blocks: DataFrame, asked: DataFrame, states: int, tolerance: float) -> tuple[Model, DataFrame, Sizes, list[float]]:
    """Baum-Welch over all training documents until an iteration gains less than
    tolerance. Gives starts and moves, the parts' table and its sums, and the log10
    likelihood before each iteration."""
    spark = blocks.sparkSession
    model, table, previous = Model.first(states), asked.where("block IS NULL"), None
    sizes = _sizes(_summed(table), states)
    asks, gained = asked.where("block IS NOT NULL AND NOT held_out"), []
    while sizes.total:
        after = stored(expected_in(blocks.where("NOT held_out"), answers(asks, table, states), model, sizes), "expected")
        sums = _summed(after)
        if previous is not None:
            removed(previous)
        table, previous, sizes = after.where("part >= 0"), after, _sizes(sums, states)
        start, move = sums[False][:states] + 1, sums[False][states:-1].reshape(states, states) + 1
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), np.zeros((0, states)))
        gained.append(float(sums[False][-1]))
        tidy(spark)  # else the files of each iteration's shuffles stay
        if len(gained) > 1 and gained[-1] - gained[-2] < tolerance * -gained[-1]:
            break
    return model, table, sizes, gained


def score_documents(docs: DataFrame, states: int = STATES, tolerance: float = TOLERANCE, seed: int = 7) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (of word counts alone) and score (of the model), both log10."""
    with temporary_tables(docs.sparkSession):
        return _score(docs, states, tolerance, seed)


def _score(docs: DataFrame, states: int, tolerance: float, seed: int) -> DataFrame:
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), (F.crc32(key.cast("binary")) % 7 == 2).alias("held_out"))
    with small_batches(spark, 500):
        blocks = stored(blocks_of(rows), "blocks")
    with small_batches(spark, 8):  # rows are large from here on
        wanted = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        asked = stored(asked_of(blocks, max(PARTS, wanted // PART_WORDS), states, seed), "asked")
        model, table, sizes, _ = train(blocks, asked, states, tolerance)
        start, move, norm = model.start, model.move, float(np.log10(sizes.total + sizes.words + 1))
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

        def score(block: dict, own: list[dict]) -> Iterator[pa.RecordBatch]:
            m, texts, c = Model(start, move, _emissions(block, own, sizes, states)), _texts(block), np.zeros(block["size"])
            for r in own:
                counts = unpacked(r["counts"], np.int64)
                c[r["first"] : r["first"] + len(counts)] = counts
            scores, known, base = np.zeros(len(texts)), c > 0, np.log10(c + 1) - norm
            for at, s, alive in groups(texts):
                scores[at] = m.score(s, alive)
            columns = [
                pa.array(block["doc_ids"], pa.int64()), pa.array([block["held_out"]] * len(texts)), pa.array([len(x) for x in texts], pa.int64()),
                pa.array([int(known[x].sum()) for x in texts], pa.int64()), pa.array([int(sizes.total)] * len(texts), pa.int64()), pa.array([float(base[x].sum()) for x in texts]), pa.array(scores),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

        kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        answered = answers(asked.where("block IS NOT NULL"), table, states)
        return stored(_at_blocks(blocks, answered, score, ["held_out", "doc_ids", "lengths", "symbols", "size"], kinds), "scores", keep=True)

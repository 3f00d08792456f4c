"""Quality classifier with a weak-label model.

Overlapping heuristic labellers each vote clean, low or toxic for a document, or
abstain: the annotations where a document has one, a lexicon of words that go with
toxic annotations, and tests of a text's shape (repeated symbols, capitals, table
bars, repeated words, ordinary sentences). The lexicon is made in two folds: documents of
one are voted on with what the annotations of the other show, so it never repeats the
annotation that it stands beside. Expectation-maximisation starts from annotations that
are mostly right and estimates how accurate each labeller is for each class, until the
likelihood gains nothing more. Its input is the count of every pattern of votes over all
documents, which Spark sums; a pattern table has a fixed largest size, so the driver can
hold it.

The posterior labels of at most `sample` annotated documents with at most `sample_bytes`
of features (the bounds on what is fitted; the first by a hash of doc_id) train a hashed
linear scorer over words and shape features, which then scores every document.

Results for special inputs: texts without words are rejected as low; a null doc_id
has no annotation; several annotations of a document count as the worst of them;
equal rows give equal rows; without annotations the heuristics alone decide; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, tidy
from .license_scan import words_of

CLEAN, LOW, TOXIC = range(3)
ABSTAIN = 3
LABELLERS = ("annotation", "lexicon", "symbols", "capitals", "bars", "repeats", "sentences")
SAMPLE = 20_000
SAMPLE_BYTES = 1 << 28
HASHED = 1 << 18
SHAPES = 5
STEPS = 12
WIDTH = HASHED + SHAPES * STEPS
CACHE = 100_000
_UPPER, _LOWER = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))
_SYMBOLS = [s * 3 for s in (b"#", b"$", b"%", b"&", b"*", b"!", b"@", b"~", b"=", b"_", b"?")]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = i = zlib.crc32(word)
        return i


Lexicons = tuple[frozenset[int], frozenset[int]]


class Features:
    def __init__(self, lexicons: Lexicons = (frozenset(), frozenset())) -> None:
        self.hashes, self.lexicons = _Hashes(), [np.array(sorted(x), dtype=np.int64) for x in lexicons]

    def words(self, text: str | None) -> np.ndarray:
        """The hashes of a text's words, each once."""
        return self._once(words_of(text))

    def _once(self, words: list[bytes]) -> np.ndarray:
        if len(self.hashes) > CACHE:
            self.hashes.clear()
        return np.unique(np.fromiter(map(self.hashes.__getitem__, words), np.int64, len(words)))

    def of(self, text: str | None, fold: int = 0) -> tuple[np.ndarray, list[int], int]:
        """(slots, votes of all labellers but the annotation, words) of a text; its fold
        says which lexicon votes."""
        data = (text or "").encode("utf-8", "surrogatepass")
        words = words_of(text)
        n = max(1, len(words))
        found = self._once(words)
        upper, lower = len(data) - len(data.translate(None, _UPPER)), len(data) - len(data.translate(None, _LOWER))
        ratios = [
            sum(map(data.count, _SYMBOLS)) / n,
            upper / max(1, upper + lower),
            data.count(b"|") / n,
            1 - len(set(words)) / n,
            data.count(b". ") / n,
        ]
        shape = [HASHED + i * STEPS + min(STEPS - 1, int(r * 2 * STEPS)) for i, r in enumerate(ratios)]
        symbols, capitals, bars, repeats, sentences = ratios
        low = lambda x: LOW if x else ABSTAIN
        lexicon = self.lexicons[fold]
        toxic = len(lexicon) and np.isin(found, lexicon, assume_unique=True).any()
        votes = [
            TOXIC if toxic else ABSTAIN,
            low(symbols > 0.1),
            low(capitals > 0.3),
            low(bars > 0.1),
            low(repeats > 0.85 and n > 50),
            CLEAN if 0.02 < sentences and capitals < 0.15 and symbols == bars == 0 else ABSTAIN,
        ]
        return np.concatenate([np.unique(found % HASHED), shape]), votes, len(words)


#: What the batches of a task share.
_KEPT: dict[Lexicons, Features] = {}


def _features(lexicons: Lexicons) -> Features:
    if lexicons not in _KEPT:
        _KEPT.clear()
        _KEPT[lexicons] = Features(lexicons)
    return _KEPT[lexicons]


def _done() -> None:
    """At the end of a task."""
    _KEPT.clear()
    release()


def leaning(rows: list[np.ndarray], inside: np.ndarray) -> np.ndarray:
    """For each slot by how many standard deviations its documents in a class are
    more than its share of all documents would give."""
    n, share = np.zeros(WIDTH), float(inside.mean()) if len(inside) else 0.0
    hits = np.zeros(WIDTH)
    for slots, x in zip(rows, inside, strict=True):
        n[slots] += 1
        hits[slots] += x
    return (hits - n * share) / np.sqrt(n * share * (1 - share) + 1e-9)


def lexicon(rows: list[np.ndarray], marks: np.ndarray, least: float = 6.0) -> frozenset[int]:
    """Hashes of words that stand in toxic documents far above their share (by so many
    standard deviations), and in more of those than of others: a word that is merely more
    common there, or a slot that other words share, would mark most texts."""
    toxic = marks == TOXIC
    share = float(toxic.mean()) if len(marks) else 0.0
    words, hits = np.unique(np.concatenate([*(r for r, x in zip(rows, toxic, strict=True) if x), np.empty(0, np.uint32)]), return_counts=True)
    n = np.zeros(len(words))
    for r in rows if len(words) else ():  # one row at a time: only what toxic ones hold is counted
        at = np.minimum(np.searchsorted(words, r), len(words) - 1)
        n[at[words[at] == r]] += 1
    return frozenset(words[(hits - n * share >= least * np.sqrt(n * share * (1 - share) + 1e-9)) & (2 * hits > n)].tolist())


def estimate(votes: np.ndarray, counts: np.ndarray, gain: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """Dawid-Skene by expectation-maximisation over patterns of votes [pattern,
    labeller] and their counts: (log prior [class], log P(vote | class) [labeller,
    class, vote])."""
    accuracy = np.full((votes.shape[1], 3, 4), 0.1)
    for k in range(3):
        accuracy[:, k, k] = 0.3
    accuracy[:, :, ABSTAIN] = 0.5
    accuracy[0] = [[0.4, 0.01, 0.01, 0.58], [0.01, 0.4, 0.01, 0.58], [0.01, 0.01, 0.4, 0.58]]
    prior = np.array([0.8, 0.1, 0.1])
    hot = np.eye(4)[votes]  # [pattern, labeller, vote]
    before, now = -np.inf, -1e300
    while now - before > gain * abs(now):  # of the log likelihood, which never falls but for the smoothing
        joint = np.log(prior) + _evidence(votes, np.log(accuracy))
        before, now = now, float(counts @ np.logaddexp.reduce(joint, axis=1))
        p = posterior(votes, np.log(prior), np.log(accuracy)) * counts[:, None]
        prior = (p.sum(0) + 1) / (p.sum() + 3)
        n = np.einsum("pk,plv->lkv", p, hot) + 0.01
        accuracy = n / n.sum(2, keepdims=True)
    return np.log(prior), np.log(accuracy)


def _evidence(votes: np.ndarray, accuracy: np.ndarray) -> np.ndarray:
    """log P(votes | class) [pattern, class]."""
    return accuracy[np.arange(votes.shape[1])[None, :, None], np.arange(3)[None, None, :], votes[:, :, None]].sum(1)


def posterior(votes: np.ndarray, prior: np.ndarray, accuracy: np.ndarray) -> np.ndarray:
    x = prior + _evidence(votes, accuracy)
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def fit_scorer(rows: list[np.ndarray], labels: np.ndarray, rounds: int = 20, rate: float = 0.3, least: float = 5.0, decay: float = 1e-4) -> np.ndarray:
    """A multinomial linear scorer [slot, class] by adaptive stochastic gradients,
    over the shape features and the words that lean to a class."""
    use = np.zeros(WIDTH, bool)
    use[HASHED:] = True
    for k in range(3) if rows else ():
        use[:HASHED] |= leaning(rows, labels[:, k])[:HASHED] >= least
    rows = [np.append(r[use[r]], np.int32(WIDTH)) for r in rows]
    w, g2 = np.zeros((WIDTH + 1, 3)), np.full((WIDTH + 1, 3), 1e-2)
    rng = np.random.default_rng(5)
    for _ in range(rounds if rows else 0):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            at = np.concatenate([rows[i] for i in part])
            of = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            x = np.stack([np.bincount(of, weights=w[at, k], minlength=len(part)) for k in range(3)], axis=1)
            x = np.exp(x - x.max(1, keepdims=True))
            error = x / x.sum(1, keepdims=True) - labels[part]
            slots, back = np.unique(at, return_inverse=True)
            g = np.stack([np.bincount(back, weights=error[of, k], minlength=len(slots)) for k in range(3)], axis=1) + decay * len(part) * w[slots]
            g2[slots] += g * g
            w[slots] -= rate * g / np.sqrt(g2[slots])
    return w


def _code(votes: list[int]) -> int:
    return sum(v << 2 * i for i, v in enumerate(votes))


def _decode(code: int) -> list[int]:
    return [code >> 2 * i & 3 for i in range(len(LABELLERS) - 1)]


def _fold(column: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(column), F.lit(2)).cast("int").alias("fold")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, only_kept: bool = False, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """A row for each row of docs: doc_id, the scorer's probability of each class,
    and kept: it is clean by the scorer and has words. only_kept: instead the rows
    of docs that are kept, as they are."""
    spark = docs.sparkSession
    context = spark.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).withColumn("fold", _fold())
    worst = F.when(F.max(F.col("toxic").cast("int")) > 0, TOXIC).when(F.min(F.col("quality").cast("int")) < 1, LOW).otherwise(CLEAN)
    marks = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(worst.alias("mark"))
    some = marks.join(rows.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _features((frozenset(), frozenset()))
        for b in batches:
            found = [f.of(t.as_py())[:2] for t in b.column(1)]
            words = [f.words(t.as_py()).astype(np.uint32).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.binary()), pa.array([s[-SHAPES:].astype(np.int32).tobytes() for s, _ in found], pa.binary()), pa.array([_code(v) for _, v in found], pa.int32()), b.column(3), b.column(2)], names=["doc_id", "words", "shape", "code", "mark", "fold"])
        _done()

    fitted = rows.join(F.broadcast(some), "doc_id").mapInArrow(features, "doc_id long, words binary, shape binary, code int, mark int, fold int")
    found, shapes, codes, folds, room = [], [], [], [], sample_bytes
    for r in fitted.orderBy(F.xxhash64("doc_id"), "doc_id", "words", "shape").limit(sample).toLocalIterator():
        room -= len(r.words)
        if room < 0:
            break
        found.append((np.frombuffer(r.words, np.uint32), r.mark))
        shapes.append(np.frombuffer(r.shape, np.int32))
        codes.append(r.code)
        folds.append(r.fold)
    # Each fold is voted on by the lexicon of the other.
    known = tuple(lexicon([s for (s, _), x in zip(found, folds, strict=True) if x != fold], np.array([y for (_, y), x in zip(found, folds, strict=True) if x != fold])) for fold in range(2))
    shared = context.broadcast(known)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _features(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_code(f.of(t.as_py(), x)[1]) for t, x in zip(b.column(1), b.column(2).to_pylist(), strict=True)], pa.int32())], names=["doc_id", "code"])
        _done()

    coded = rows.mapInArrow(vote, "doc_id long, code int").join(marks, "doc_id", "left")
    patterns = coded.groupBy("code", F.coalesce("mark", F.lit(ABSTAIN)).alias("mark")).agg(F.count("*").alias("n")).collect()
    votes = np.array([[r.mark, *_decode(r.code)] for r in patterns], dtype=np.int64).reshape(-1, len(LABELLERS))
    prior, accuracy = estimate(votes, np.array([float(r.n) for r in patterns]))
    own = np.array([[y, TOXIC if not known[x].isdisjoint(s.tolist()) else ABSTAIN, *_decode(code)[1:]] for (s, y), code, x in zip(found, codes, folds, strict=True)], dtype=np.int64).reshape(-1, len(LABELLERS))
    slots = []
    while found:  # each row's words make place for its slots
        s, _ = found.pop()
        slots.append(np.concatenate([np.unique(s % HASHED).astype(np.int32), shapes[len(found)]]))
    slots.reverse()
    trained = bool(slots)
    weights = fit_scorer(slots, posterior(own, prior, accuracy))
    model = context.broadcast((weights, known, prior, accuracy, trained))
    del slots, found, shapes, codes, own, patterns, votes
    tidy(spark)

    def scored(texts: pa.Array) -> tuple[list[np.ndarray], list[bool]]:
        w, lex, prior, accuracy, trained = model.value
        f, p, kept = _features(lex), [], []
        for t in texts:
            slots, votes, n = f.of(t.as_py())  # votes count only where nothing trained a lexicon
            if trained:
                x = w[slots].sum(0) + w[WIDTH]
                x = np.exp(x - x.max())
                x /= x.sum()
            else:
                x = posterior(np.array([[ABSTAIN, *votes]]), prior, accuracy)[0]
            p.append(x)
            kept.append(bool(n and x.argmax() == CLEAN))
        return p, kept

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, kept = scored(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([float(x[k]) for x in p], pa.float64()) for k in range(3)), pa.array(kept, pa.bool_())], names=["doc_id", "p_clean", "p_low", "p_toxic", "kept"])
        _done()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scored(b.column("text"))[1], pa.bool_()))
        _done()

    if only_kept:
        return docs.mapInArrow(keep, docs.schema)
    return rows.mapInArrow(score, "doc_id long, p_clean double, p_low double, p_toxic double, kept boolean")

"""Language model, classifier and encoder against plain computations."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cadenza.llm import hmm_lm, quality
from cadenza.llm.bpe import Encoder, encode_documents, load_vocabulary
from cadenza.llm.queries import vocabulary_path

ODD = [(None, None), (9001, ""), (9002, " \n\t"), (9003, None)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1.0, 0) for i, t in rows], "doc_id long, text string, score double, n_tokens int")


@pytest.mark.parametrize("window", [1 << 19, 6])
def test_expected_counts_against_all_paths(monkeypatch, window):
    monkeypatch.setattr(hmm_lm, "WINDOW", window)  # 6: texts go through in several windows
    rng = np.random.default_rng(0)
    move, emit = rng.random((3, 3)) + 0.1, rng.random((7, 3)) + 0.1
    m = hmm_lm.Model(np.full(3, 1 / 3), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    texts = [rng.integers(0, 7, n).astype(np.int32) for n in (1, 2, 3, 5, 8, 4)]
    out = np.zeros(3), np.zeros((3, 3)), np.zeros((7, 3))
    scores, total = np.zeros(len(texts)), 0.0
    for own, s, alive in hmm_lm.groups(texts):
        total += m.expected(s, alive, out)
        scores[own] = m.score(s, alive)
    assert total == pytest.approx(scores.sum(), abs=1e-4)
    want = np.zeros(3), np.zeros((3, 3)), np.zeros((7, 3))
    for d, x in zip(texts, scores, strict=True):
        total, part = 0.0, [np.zeros_like(z) for z in want]
        for path in itertools.product(range(3), repeat=len(d)):
            p = m.start[path[0]] * m.emit[d[0], path[0]]
            for i in range(1, len(d)):
                p *= m.move[path[i - 1], path[i]] * m.emit[d[i], path[i]]
            total += p
            part[0][path[0]] += p
            for i in range(len(d)):
                part[2][d[i], path[i]] += p
                if i:
                    part[1][path[i - 1], path[i]] += p
        for z, y in zip(want, part, strict=True):
            z += y / total
        assert x == pytest.approx(math.log10(total), abs=1e-9)
    for a, b in zip(out, want, strict=True):
        assert np.abs(a - b).max() < 1e-5


def test_many_texts_go_through_together():
    steps = sum(len(s) for _, s, _ in hmm_lm.groups([np.zeros(600, np.int32)] * 1700))
    assert steps == 600  # each takes some ten calls, however few texts


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(hmm_lm, "BLOCK_TOKENS", 700)  # so that words stand in several blocks
    monkeypatch.setattr(hmm_lm, "PARTS", 3)
    random.seed(1)
    groups = [[f"{g}{i}" for i in range(40)] for g in "ab"]
    rows = [(i, " ".join(random.choice(groups[i % 2][: random.randint(1, 40)]) for _ in range(random.randint(0, 60)))) for i in range(150)] + ODD
    got = hmm_lm.score_documents(docs(spark, rows), states=2).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in [*(t or "").split(), ""])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        w = [*(t or "").split(), ""]
        want[i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # two topics are told apart
    assert hmm_lm.score_documents(docs(spark, rows).limit(0)).count() == 0


def test_word_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    counts, shares = rng.integers(1, 90, 50), rng.integers(0, 2**15, (50, 3)).astype(np.uint16)
    *mass, total, words = hmm_lm._sums(counts, shares)
    e = hmm_lm.Sizes(np.array(mass), total, words).emissions(np.append(counts, 0), np.vstack([shares, shares[:1]]))
    assert e[:50].sum(0) + e[50] == pytest.approx(np.ones(3))  # the last is an unknown word


def test_packed_numbers():
    for x in (np.arange(1000, dtype=np.int32), np.array([2**40, -1, 0]), np.zeros(0, np.uint16), np.arange(24, dtype=np.uint16).reshape(3, 8)):
        assert (hmm_lm.unpacked(hmm_lm.packed(x), x.dtype) == x.ravel()).all()


def test_estimated_accuracies():
    rng = np.random.default_rng(3)
    y = rng.choice(3, 4000, p=[0.8, 0.1, 0.1])
    votes = np.full((4000, 4), quality.ABSTAIN)
    for j, good in enumerate((0.95, 0.8, 0.7, 0.6)):
        say = rng.random(4000) < 0.7
        right = rng.random(4000) < good
        votes[say, j] = np.where(right, y, rng.integers(0, 3, 4000))[say]
    patterns, at, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    prior, accuracy = quality.estimate(patterns, n.astype(float))
    assert np.abs(np.exp(prior) - [0.8, 0.1, 0.1]).max() < 0.05
    own = [float(np.mean([np.exp(accuracy[j, k, k]) / (1 - np.exp(accuracy[j, k, 3])) for k in range(3)])) for j in range(4)]
    assert own == sorted(own, reverse=True)


def test_estimates_against_loops():
    rng = np.random.default_rng(9)
    votes, counts = rng.integers(0, 4, (30, 7)), rng.integers(1, 200, 30).astype(float)
    prior, accuracy = quality.estimate(votes, counts, gain=1e-12)
    p = quality.posterior(votes, prior, accuracy)
    share = [[math.exp(prior[k]) * math.prod(math.exp(accuracy[j, k, v]) for j, v in enumerate(row)) for k in range(3)] for row in votes.tolist()]
    assert np.abs(p - [[x / sum(row) for x in row] for row in share]).max() < 1e-9
    # A fixed point: the posteriors give back the priors and the tables of votes.
    weight = [[c * x for x in row] for c, row in zip(counts, p.tolist(), strict=True)]
    for k in range(3):
        assert (sum(w[k] for w in weight) + 1) / (counts.sum() + 3) == pytest.approx(math.exp(prior[k]), abs=1e-3)
        for j in range(7):
            n = [sum(w[k] for w, row in zip(weight, votes, strict=True) if row[j] == v) + 0.01 for v in range(4)]
            assert [x / sum(n) for x in n] == pytest.approx(np.exp(accuracy[j, k]).tolist(), abs=1e-3)


def test_classes_against_a_loop(spark):
    """Every probability is the scorer's, trained as the operator trains it."""
    random.seed(21)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(2, 4)))
    rows = [(i, " ".join([word() for _ in range(30)] + ["vile"] * (i % 4 == 0)) + (" ### $$$" * (i % 5 == 0))) for i in range(200)] + ODD
    marks = {i: (int(i % 5 > 0), int(i % 4 == 0)) for i in range(0, 200, 2)}
    labels = spark.createDataFrame([(i, *m) for i, m in marks.items()], "doc_id long, quality int, toxic int")
    got = {(r.doc_id, round(r.p_clean, 9), round(r.p_low, 9), round(r.p_toxic, 9), r.kept) for r in quality.classify(docs(spark, rows), labels).collect()}
    ids = spark.createDataFrame([(i,) for i, _ in rows], "doc_id long")
    hashed = {r.doc_id: (r.h, r.fold) for r in ids.selectExpr("doc_id", "xxhash64(doc_id) AS h", "cast(pmod(xxhash64(doc_id), 2) AS int) AS fold").collect()}
    mark = {i: quality.TOXIC if t else quality.LOW if not q else quality.CLEAN for i, (q, t) in marks.items()}
    f, text = quality.Features(), dict(rows)
    fitted = sorted(mark, key=lambda i: hashed[i][0])
    slots = {i: f.of(text[i])[0] for i in fitted}
    words = {i: f.words(text[i]) for i in fitted}
    known = tuple(quality.lexicon([words[i] for i in fitted if hashed[i][1] != x], np.array([mark[i] for i in fitted if hashed[i][1] != x])) for x in (0, 1))
    f = quality.Features(known)
    votes = Counter((mark.get(i, quality.ABSTAIN), *f.of(t, hashed[i][1])[1]) for i, t in rows)
    prior, accuracy = quality.estimate(np.array(list(votes)), np.array(list(votes.values()), float))
    own = np.array([[mark[i], *f.of(text[i], hashed[i][1])[1]] for i in fitted])
    w = quality.fit_scorer([slots[i] for i in fitted], quality.posterior(own, prior, accuracy))
    want = set()
    for i, t in rows:
        s, _, n = f.of(t)
        x = [sum(w[k, c] for k in s) + w[quality.WIDTH, c] for c in range(3)]
        e = [math.exp(v - max(x)) for v in x]
        want.add((i, *(round(v / sum(e), 9) for v in e), bool(n and x.index(max(x)) == quality.CLEAN)))
    assert len(got ^ want) <= 2 and {(i, k) for i, *_, k in got} == {(i, k) for i, *_, k in want}  # but for last digits


def test_a_lexicon_holds_no_common_words():
    rng = np.random.default_rng(8)
    marks = np.where(np.arange(2000) % 10 == 0, quality.TOXIC, quality.CLEAN)
    # Word 1 marks toxic texts, 2 is twice as common there, the rest are alike.
    rows = [np.unique([*rng.integers(10, 400, 50), *[1] * int(y == quality.TOXIC), *[2] * int(rng.random() < (0.8 if y == quality.TOXIC else 0.4))]) for y in marks]
    assert quality.lexicon(rows, marks) == {1}
    assert quality.lexicon([], np.array([])) == frozenset()


def test_classifier_on_held_out_rows(spark):
    random.seed(7)
    bad = ["vile", "awful", "rotten"]
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(2, 5)))
    rows, labels, kind = [], [], {}
    for i in range(600):
        text = [word() for _ in range(80)]
        kind[i] = ("clean", "clean", "clean", "toxic", "low")[i % 5]
        if kind[i] == "toxic":
            for w in random.choices(bad, k=4):
                text[random.randrange(80)] = w
        if kind[i] == "low":
            text = [w + random.choice(["###", "$$$"]) for w in text]
        rows.append((i, ". ".join(" ".join(text[k : k + 8]).capitalize() for k in range(0, 80, 8)) + "."))
        if i < 400:
            labels.append((i, int(kind[i] != "low"), int(kind[i] == "toxic"), "z"))
    labels += [(None, 1, 1, "z"), (4, None, None, "z")]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, kept string")
    got = {r.doc_id: r for r in quality.classify(docs(spark, rows + ODD), marks).collect()}
    wrong = [i for i in range(400, 600) if got[i].kept != (kind[i] == "clean")]
    assert len(wrong) <= 4
    assert not got[9001].kept and not got[None].kept
    kept = {r.doc_id for r in quality.classify(docs(spark, rows + ODD), marks, only_kept=True).collect()}
    assert kept == {i for i, r in got.items() if r.kept}
    assert quality.classify(docs(spark, rows).limit(0), marks).count() == 0
    assert quality.classify(docs(spark, rows[:20]), marks.limit(0)).count() == 20


def odd_texts():
    random.seed(3)
    parts = ["a", "aa", "b", "th", "e", "é", "ß", "'s", "'ll", " ", "\n", "İ", "Σ", "σς", "ﬁ", "<|endoftext|>", "<|startoftext|>", "½", "²", "٣", "日本", "\x1c", "\x85", "﻿", "😀", "ª", "ͅ", "!!", "###", "0", "12", "\x00"]
    return ["".join(random.choice(parts) for _ in range(random.randint(0, 30))) for _ in range(1500)] + ["a" * 5000, "the" * 2000, "é" * 1000, "!" * 999, ""]


def test_encoder_against_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary_path()
    library, own = tokenizers.Tokenizer.from_file(path), Encoder(load_vocabulary(path))
    for text, e in zip(odd_texts(), library.encode_batch(odd_texts(), add_special_tokens=False), strict=True):
        ids, decoded = own.encode(text)
        assert ids == " ".join(map(str, e.ids)), text
        assert decoded == library.decode(e.ids, skip_special_tokens=False) == own.decode(e.ids)


def test_all_code_points_against_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary_path()
    library, own = tokenizers.Tokenizer.from_file(path), Encoder(load_vocabulary(path))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b1{c}{c} " for c in points[i : i + 16]) for i in range(0, len(points), 16)]
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        if own.encode(text)[0] != " ".join(map(str, e.ids)):
            wrong = [hex(ord(c)) for c in set(text) if own.encode(f"a{c}b1{c}{c}")[0] != " ".join(map(str, library.encode(f"a{c}b1{c}{c}", add_special_tokens=False).ids))]
            raise AssertionError(wrong)


def test_long_words_against_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    library, own = tokenizers.Tokenizer.from_file(vocabulary_path()), Encoder(load_vocabulary(vocabulary_path()))
    random.seed(12)
    for text in ("".join(random.choice("aehinorst") for _ in range(30_000)), " ".join("".join(random.choice("abcé ") for _ in range(40)) for _ in range(20_000))):
        assert own.encode(text)[0] == " ".join(map(str, library.encode(text, add_special_tokens=False).ids))


def test_encoded_documents(spark):
    rows = list(enumerate(odd_texts()[:50])) + ODD
    got = encode_documents(docs(spark, rows), vocabulary_path(), full=True).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_tokens == len(r.ids)
    assert {r.n_tokens for r in got if r.doc_id is None} == {0}


def test_every_word_has_emissions_of_its_own(spark):
    """Words that are each far below 1/16384 of all tokens tell two topics apart."""
    random.seed(2)
    topics = [[f"{g}{i}" for i in range(9000)] for g in "ab"]
    rows = []
    for i in range(400):
        words = random.choices(topics[i % 2], k=150)
        rows.append((i, " ".join(words)))
    got = hmm_lm.score_documents(docs(spark, rows), states=2).collect()
    gain = sum(r.score - r.base_score for r in got if not r.held_out) / sum(r.n_tokens for r in got if not r.held_out)
    assert gain > 0.2  # a topic halves the choice, which is log10(2) = 0.3 a word
    one = hmm_lm.score_documents(docs(spark, rows + ODD), states=1).collect()
    assert max(abs(r.score - r.base_score) for r in one) < 1e-2

"""Near-duplicates, shards, conversations and the pipeline against plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import common, embedding_dedup
from cadenza.llm.chat_format import format_chats
from cadenza.llm.components import components
from cadenza.llm.embedding_dedup import near_duplicate_vectors
from cadenza.llm.minhash_dedup import drop_near_duplicates, near_duplicates
from cadenza.llm.sharding import shard

DOCS = "doc_id long, text string, source string, kept int, n long"


def joined(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_against_a_loop(spark):
    random.seed(1)
    links = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    want = joined(range(200), links)
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: want[i] for i in {x for p in links for x in p if p[0] != p[1]}}


def test_counted_joins_keep_all_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    keys = [1] * 9 + [2] * 6 + [3] * 3 + [4, 5, None]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int")
    facts = df.where("k IS NOT NULL AND k <> 5").groupBy("k").agg(F.count("*").alias("f"))
    found = common.join_counted(df, facts, "k", "f", len(keys)).collect()
    assert sorted(map(tuple, found)) == [(k, i, keys.count(k)) for i, k in enumerate(keys) if k in {1, 2, 3, 4}]


def test_rare_keys_keep_all_their_rows(spark, monkeypatch):
    df = spark.range(5000).select((F.col("id") * 7919 - 10**6).alias("k"), F.lit("x").alias("_t"))
    facts = df.where("pmod(k, 97) = 0 OR k < -990000").select("k", F.lit(1).alias("f")).unionByName(spark.createDataFrame([(1, 1), (None, 1)], "k long, f int"))
    want = {r.k for r in df.join(facts, "k").collect()}
    near = [r.k for r in common.likely_in(df, facts, "k", facts.count()).collect()]
    assert len(near) == len(set(near)) and want <= set(near) and len(near) < len(want) + 1500
    assert sorted(r.k for r in common.join_counted(df, facts, "k", "f", 5000, rare=True).collect()) == sorted(want)
    monkeypatch.setattr(common, "BITS", 1 << 15)  # more keys than bits only let more through
    assert want <= {r.k for r in common.likely_in(df, facts, "k", 10**6).collect()}
    # So few rows are dealt: those that the join's shuffle reads are near those it keeps.
    assert common.likely_in(df, facts.limit(0), "k", 0).count() == 0


def near_rows():
    random.seed(8)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(55)]
    rows = []
    for _ in range(90):  # versions of one text, some near and some less so
        t = list(base)
        for _ in range(random.randint(0, 8)):
            t[random.randrange(120)] = word()
        rows.append(" ".join(t))
    rows += [" ".join(passage + [word() for _ in range(random.randint(0, 60))]) for _ in range(90)]
    rows += [" ".join(word() for _ in range(random.randint(1, 9))) for _ in range(20)]
    rows += ["a b", "A  b", "a b c d e", "a b c d e", "a b c d e f", *rows[:20]]
    rows = list(enumerate(rows))
    random.shuffle(rows)
    return [(i + 10, t) for i, t in rows]


@pytest.mark.parametrize("long", [64, 8])
def test_near_duplicates_against_all_pairs(spark, long):
    rows = near_rows()
    odd = [(1, None), (2, ""), (3, " \n"), (None, None)]
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = joined(ids, links)
    got = near_duplicates(spark.createDataFrame([(i, t, "s", 1, 2) for i, t in rows + odd], DOCS), long=long).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id and r.doc_id >= 10} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is None or r.doc_id < 10} == {(i, 0, i) for i, _ in odd}
    assert all(r.n_shingles == len(sets[r.doc_id]) for r in got if r.doc_id in sets)


def test_dropping_near_duplicates(spark):
    rows = [(1, "one two three four five six"), (2, "one two three four five six"), (1, "one two three four five six"), (3, "else"), (None, "x"), (4, None)]
    left = drop_near_duplicates(spark.createDataFrame([(i, t, "s", 1, 2) for i, t in rows], DOCS)).collect()
    assert Counter(r.doc_id for r in left) == Counter([1, 3, None, 4])
    long = [" ".join(f"w{i}" for i in range(a, a + 40)) for a in (0, 1)]
    rows = [(None, long[0]), (None, long[0]), (7, long[0]), (7, long[1]), (7, "other"), (7, "other"), (None, "y"), (None, "y"), (5, " "), (5, " "), (None, None), (None, None)]
    frame = spark.createDataFrame([(i, t, i, t) for i, t in rows], "doc_id int, text string, kept_id int, kept_hash string")
    left = drop_near_duplicates(frame).collect()
    assert Counter(r.doc_id for r in left) == Counter([7, 7, None, 5, 5, None, None]) and frame.columns == ["doc_id", "text", "kept_id", "kept_hash"]
    assert sum(r.text in long for r in left) == 1 and all(r.doc_id == r.kept_id for r in left)
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(40):
            v = rng.standard_normal(16)
            for _ in range(int(rng.integers(1, 12))):
                rows.append((n, (v + 0.08 * rng.standard_normal(16)).astype(np.float32).tolist(), label))
                n += 1
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 0), (n + 2, None, 0), (n + 3, [0.0] * 16, 0), (n + 4, [float("nan")] + [1.0] * 15, 0), (n + 5, [None] + [1.0] * 15, 0), (n + 6, [1.0, 2.0], 1), (n + 7, [], 1)]
    good = {i: np.array(v, float) / np.linalg.norm(v) for i, v, k in rows if k is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: k for i, _, k in rows}
    links = [(a, b) for a in good for b in good if a < b and label[a] == label[b] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.93]
    want, degree = joined(label, links), Counter(x for p in links for x in p)
    got = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=25).collect()
    found = {r.vec_id: r for r in got}
    assert len(got) == len(rows)
    assert {i: (r.n_links, r.component_id) for i, r in found.items()} == {i: (degree[i], want[i]) for i in label}
    assert near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_single_links_between_large_groups(spark):
    """Tight groups of 200 vectors, two and two joined by one link of cosine 0.94."""
    rng = np.random.default_rng(11)
    rows, n = [], 0
    for label in range(4):
        q = np.linalg.qr(rng.standard_normal((64, 64)))[0]
        centre, other, away = q[0], np.cos(0.49) * q[0] + np.sin(0.49) * q[1], np.arccos(0.94)
        left = [centre + 0.006 * rng.standard_normal(64) for _ in range(200)]
        right = [other + 0.006 * rng.standard_normal(64) for _ in range(200)]
        bridge = [np.cos(a) * q[0] + np.sin(a) * q[1] for a in ((0.49 - away) / 2, (0.49 + away) / 2)]
        for v in (*left, *right, *bridge):
            rows.append((n, v.tolist(), label))
            n += 1
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([k for *_, k in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label)
    want = joined(range(n), [(int(a), int(b)) for a, b in np.argwhere(np.triu(near, 1))])
    got = {r.vec_id: r for r in near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=150).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_links for i, r in got.items()} == {i: int(near[i].sum()) - 1 for i in range(n)}


def test_lost_vectors_are_audited_and_found(spark, monkeypatch):
    """Rare pairs that no bucket joins beside a group that is joined."""
    rng = np.random.default_rng(6)
    rows = [(i, (np.eye(16)[0] + 0.01 * rng.standard_normal(16)).tolist(), 0) for i in range(60)]
    for i in range(40):
        v = rng.standard_normal(16)
        rows += [(100 + 2 * i, v.tolist(), 1), (101 + 2 * i, (v + 0.02 * rng.standard_normal(16)).tolist(), 1)]
    real = embedding_dedup._buckets
    monkeypatch.setattr(embedding_dedup, "_buckets", lambda classes, tables: real(classes.where("label = '0'"), tables))
    got = {r.vec_id: r for r in near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=25).collect()}
    assert all(got[100 + 2 * i].component_id == got[101 + 2 * i].component_id == 100 + 2 * i for i in range(40))


def test_audit_is_bounded_and_keeps_what_it_finds(spark, monkeypatch):
    """24,000 vectors of which none is linked, then some that are: two passes at most, and
    no vector comes to the driver."""
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    rng = np.random.default_rng(8)
    x = rng.standard_normal((24000, 12))
    x[1::400] = x[::400] + 0.001  # 60 pairs, whose links all leave their components
    frame = lambda m: spark.createDataFrame([(i, "l", 12, v.tobytes()) for i, v in enumerate(m)], "cid long, label string, size int, vec binary")
    passes, real = [], embedding_dedup._asked
    monkeypatch.setattr(embedding_dedup, "_asked", lambda *a: passes.append(1) or real(*a))
    collect = Frame.collect

    def counts_only(df):
        assert "vec" not in df.columns
        return collect(df)

    monkeypatch.setattr(Frame, "collect", counts_only)
    alone = frame(rng.standard_normal((24000, 12)))
    whole, linked, lost = embedding_dedup.audit(alone, alone.select("cid", F.col("cid").alias("comp")), 0.999)
    assert whole == linked == 0 == lost.count() and len(passes) == 2
    classes = frame(x)
    whole, linked, lost = embedding_dedup.audit(classes, classes.select("cid", F.col("cid").alias("comp")), 0.999)
    assert whole == 0 < linked and len(passes) == 4
    got = {frozenset(r) for r in lost.collect()}
    assert got <= {frozenset((i, i + 1)) for i in range(0, 24000, 400)} and 30 < len(got) <= 60 and len(got) <= linked <= 2 * len(got)


def test_shards(spark):
    random.seed(9)
    rows = [(i % 300 if i else None, random.choice([None, "", "text é " * random.randint(1, 40)]), random.choice(["hot"] * 8 + ["a", "b", None]), 1, 2) for i in range(1000)]
    got = shard(spark.createDataFrame(rows, DOCS), shards=7, buckets=16).collect()
    data = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len(data(t)) + 16, zlib.crc32(data(t))) for i, t, *_ in rows)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert shard(spark.createDataFrame([], DOCS)).count() == 0


def test_shards_against_a_loop(spark):
    random.seed(15)
    rows = [(None if i % 9 == 0 else i // 3, random.choice(["x", None, "é" * (i % 4)]), f"s{i}" if i % 5 == 0 else "hot", 1, 2) for i in range(400)]
    data = lambda t: (t or "").encode()
    md5 = lambda *x: hashlib.md5("|".join(["42", *x]).encode()).hexdigest()
    part = lambda h: (int(h[:8], 16) + 0.5) / 2**32
    seen, by = Counter(), {}
    for i, t, s, *_ in rows:
        key = (f"={s}", "" if i is None else str(i), str(len(data(t)) + 16), str(zlib.crc32(data(t))))
        by.setdefault(key[0], []).append((md5(*key, str(seen[key])), i, len(data(t)) + 16, zlib.crc32(data(t))))
        seen[key] += 1
    order = sorted(((k + part(md5(s))) / len(own), *r) for s, own in by.items() for k, r in enumerate(sorted(own)))
    want, slots = Counter(), Counter()
    for p, (_, _, i, size, crc) in enumerate(order):
        shard_of = p * 7 // len(order)
        want[i, size, crc, shard_of, slots[shard_of]] += 1
        slots[shard_of] += 1
    got = shard(spark.createDataFrame(rows, DOCS), shards=7, buckets=16).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got) == want


def test_shards_match_the_mixture(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 else f"s{i % 5}", 1, 2) for i in range(3000)]
    got = {r.doc_id: r.shard for r in shard(spark.createDataFrame(rows, DOCS), shards=10).collect()}
    total = Counter(s for _, _, s, *_ in rows)
    inside = Counter((got[i], s) for i, _, s, *_ in rows)
    assert all(abs(inside[k, s] - n / 10) <= 2 for s, n in total.items() for k in range(10))


CHATS = [
    (1, 0, "user", "Hello there.\nHow do I sort?"),
    (1, 1, "assistant", "On Monday X wrote:\n> Hello there.\n> How do I sort?\nUse sorted."),
    (1, 2, "user", "Unrelated question"),
    (1, 3, "user", ">> how do I SORT?\n> Use sorted.\n\nThanks"),
    (1, 4, "assistant", "> Unrelated question\nanswer"),
    (1, 5, "user", "> never said\nhm"),
    (2, 0, "user", "> Use sorted.\nciting elsewhere"),
    (2, 1, "user", None),
    (None, None, None, "x"),
]


def test_chats_in_reply_order(spark):
    df = spark.createDataFrame([(*r, 9) for r in CHATS], "conv_id long, turn long, role string, text string, position int")
    got = format_chats(df).collect()
    order = [(r.source_conv_id, r.turn) for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)]
    assert order == [(1, 0), (1, 1), (2, 0), (1, 3), (1, 2), (1, 4), (1, 5)]
    at = {(r.source_conv_id, r.turn): r for r in got}
    assert (at[1, 3].reply_to_turn, at[1, 3].reply_depth, at[1, 3].content) == (1, 2, "Thanks")
    assert at[1, 1].content == "Use sorted." and at[1, 5].content == "hm" and at[1, 5].reply_to_turn is None
    assert at[2, 1].content == "" and at[None, None].content == "x"
    assert all(">" not in r.content for r in got)
    assert format_chats(df.limit(0)).count() == 0


def chat_loop(rows):
    """(conv_id, turn) -> (root's conversation, position, what it replies to, depth)."""
    normal = lambda t: " ".join(re.findall("[a-z0-9]+", t.lower()))
    said, quotes = {}, {}
    for conv, turn, _, text in rows:
        lines = [(len(re.sub("[^>]", "", m[0])) if (m := re.match("[ \t]*(>[ \t]*)+", x)) else 0, re.sub("^([ \t]*>)+", "", x).strip(" ")) for x in text.split("\n")]
        own = [x for n, x in lines if n == 0]
        said[conv, turn] = {normal(x) for x in [*own, "\n".join(own).strip()]} - {""}
        quotes[conv, turn] = []
        for level in {n for n, _ in lines if n}:
            i = 0
            while i < len(lines):
                j = i
                while j < len(lines) and lines[j][0] == level:
                    j += 1
                body = [x for _, x in lines[i:j]]
                quotes[conv, turn] += [(level, i - 0, normal(x), len(x)) for x in (["\n".join(body), *body] if body else []) if normal(x)]
                i = max(j, i + 1)
    parent = {}
    for (conv, turn), found in quotes.items():
        weight = Counter()
        for level, run, text, n in found:
            near = [k for k in said if k[0] == conv and k[1] < turn and text in said[k]]
            far = min((k for k in said if text in said[k]), default=None)
            if near or far and far[0] < conv:
                weight[level, run, max(near) if near else far] += n
        if weight:
            # Of the lowest level, the original with most of a passage; ties: the later turn.
            parent[conv, turn] = max((-level, n, (k[1], k)) for (level, _, k), n in weight.items())[2][1]
    out, place = {}, Counter()

    def walk(k, root, depth):
        out[k] = (root[0], place[root[0]], parent.get(k), depth)
        place[root[0]] += 1
        for child in sorted((c for c, p in parent.items() if p == k), key=lambda c: (c[1], c[0])):
            walk(child, root, depth + 1)

    for k in sorted(said):
        if k not in parent:
            walk(k, k, 0)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_chats_against_a_loop(spark, seed):
    random.seed(seed)
    rows, lines = [], [f"line {i} of talk" for i in range(40)]
    turns = iter(random.sample(range(1000), 200))  # all different, so replies have one order
    for conv in range(4):
        for turn in sorted(next(turns) for _ in range(30)):
            text = [random.choice(lines) for _ in range(random.randint(0, 2))]
            for level in random.sample([1, 2], random.randint(0, 2)):
                text = [">" * level + " " + random.choice(lines) for _ in range(random.randint(1, 2))] + text
            rows.append((conv, turn, "user", "\n".join(text)))
    want = chat_loop(rows)
    got = {(r.source_conv_id, r.turn): (r.conv_id, r.position, None if r.reply_to_turn is None else (r.reply_to_conv, r.reply_to_turn), r.reply_depth) for r in format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == want


def test_deep_and_broad_replies(spark):
    chain = [(1, i, "user", f"> word{i - 1}\nword{i}") for i in range(1200)]
    broad = [(2, 0, "user", "all reply here")] + [(2, i, "user", "> all reply here\nyes " + str(i)) for i in range(1, 500)]
    got = {(r.source_conv_id, r.turn): r for r in format_chats(spark.createDataFrame(chain + broad, "conv_id long, turn long, role string, text string")).collect()}
    assert all((got[1, i].reply_depth, got[1, i].position) == (i, i) for i in range(1200))
    assert all((got[2, i].reply_depth, got[2, i].reply_to_turn, got[2, i].position) == (1, 0, i) for i in range(1, 500))


def test_chat_plan_has_no_python(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    plan = format_chats(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_long_conversation_with_equal_messages(spark):
    rows = [(7, i, "user", "same words" if i % 2 else "> same words\nreply") for i in range(1000)]
    got = {r.turn: r for r in format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert sorted(r.position for r in got.values()) == list(range(1000))
    assert got[10].reply_to_turn == 9 and got[0].reply_to_turn is None


def test_quotes_that_the_message_says_itself(spark):
    rows = [(1, 0, "user", "Thanks"), (1, 1, "user", "other"), (1, 2, "user", "> Thanks\nThanks"), (1, 3, "user", "> Thanks\n+1"), (2, 0, "user", "> Thanks\nThanks")]
    got = {(r.source_conv_id, r.turn): r for r in format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1, 2].reply_to_turn, got[1, 2].reply_depth) == (0, 1)
    assert (got[1, 3].reply_to_turn, got[1, 3].reply_depth) == (2, 2)  # the nearest that says so
    assert (got[2, 0].reply_to_conv, got[2, 0].reply_to_turn) == (1, 0)


def test_pipeline_stages(spark, tmp_path):
    random.seed(5)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(2, 5)))
    prose = lambda: ". ".join(" ".join(word() for _ in range(8)).capitalize() for _ in range(12)) + "."
    rows = [(i, prose(), "en", f"s{i % 3}") for i in range(120)]
    item = " ".join(word() for _ in range(30))
    rows += [(200, rows[5][1], "en", "s0"), (201, prose() + " " + item + " " + prose(), "en", "s0"), (202, prose() + " password=abcdef123456 end", "en", "s0"), (203, "WORD!! " * 60, "en", "s0"), (204, None, None, None)]
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(item_id, t) for item_id, t in [(1, item)]], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(203, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = frame, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen.append((name, {r.doc_id for r in docs.select("doc_id").collect()}))
        if name != "encode":
            assert docs.columns == frame.columns
        if name == "secrets":
            texts = {r.doc_id: r for r in docs.collect()}
            assert texts[202].text.endswith(" [secret] end") and texts[202].n_chars == len(texts[202].text)
    clean = set(range(120))
    assert seen[0] == ("quality", clean | {200, 201, 202})
    assert seen[1] == ("near_duplicates", clean | {201, 202})
    assert seen[2][1] == seen[3][1] == seen[4][1] == clean | {202}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 121


def test_components_of_a_chain_take_few_jobs(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(50)], "a long, b long").repartition(3)
    spark.sparkContext.setJobGroup("chain", "")
    try:
        got = {r.node: r.comp for r in components(chain).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == dict.fromkeys(range(301), 0) | dict.fromkeys(range(1000, 1050), 1000)
    assert jobs < 30  # each step of large and small stars takes some ten


def test_components_in_small_chunks(spark):
    rng = random.Random(8)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(500 + i, 501 + i) for i in range(60)]
    want = components(spark.createDataFrame(links, "a long, b long")).collect()
    got = components(spark.createDataFrame(links, "a long, b long").repartition(5), chunk=8).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == len({r.node for r in got})

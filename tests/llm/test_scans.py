"""Licence, secret and benchmark scans against plain loops, and their edge cases."""

import hashlib
import random
import re
import time

import pytest

from cadenza.llm.decontaminate import contaminated, drop_contaminated, edit_distance, normalised
from cadenza.llm.license_scan import BLOCK, NOTICES, PHRASES, scan_licenses, words_of
from cadenza.llm.secret_scan import BASE_RULES, MORE_RULES, Scanner, compile_rules, redact_secrets, scan_secrets

DOCS = "doc_id long, text string, spans string, n_words int"
ODD = [(None, None), (9001, ""), (9002, " \n\t"), (9003, None)]


def frame(spark, rows):
    """Rows of doc_id and text with columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], DOCS)


def test_license_places_against_a_loop(spark):
    random.seed(2)
    parts = ["MIT", "license", "License.", "apache", "general", "public", "gnu\n", "é", "x", "released under the", "3"]
    rows = [(i, " ".join(random.choice(parts) for _ in range(random.randint(0, 200)))) for i in range(60)] + ODD
    got = {(r.doc_id, r.n_words): r for r in scan_licenses(frame(spark, rows)).collect()}
    for i, t in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at, labels = [], set()
        for phrase, label in PHRASES.items():
            p = phrase.split()
            found = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        r = got[i, len(w)]
        assert (r.n_base, r.first_word, r.last_word) == (len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1


def stands(named, block):
    """Whether the names of a notice stand in a block in order, each within its gap."""

    def behind(at, k):
        return k == len(named) or any(block[j] == named[k][0] and behind(j, k + 1) for j in range(at + 1, min(at + 2 + named[k][1], len(block))))

    return any(w == named[0][0] and behind(i, 1) for i, w in enumerate(block))


def with_gaps(text, names):
    words, names, at, out = text.split(), names.split(), -1, []
    for k, n in enumerate(names):
        here = words.index(n, at + 1)
        out.append((n.encode(), here - at - 1 + 1 if k else 0))
        at = here
    return out


def test_license_notices_against_all_blocks(spark):
    random.seed(3)
    rows = []
    for i in range(80):
        notice = words_of(NOTICES[i % len(NOTICES)][1])
        kept = [w.decode() for w in notice if random.random() < 0.9]
        rows.append((i, " ".join(["the of and"] * random.randint(0, 40) + kept + ["filler"] * random.randint(0, 90))))
    got = {r.doc_id: r for r in scan_licenses(frame(spark, rows)).collect()}
    def contained(short, long):
        rest = iter(long)
        return all(x in rest for x in short)

    for i, t in rows:
        w, want, unnamed = words_of(t), set(), set()
        for first in range(0, max(1, len(w)), BLOCK // 2):
            block = w[first : first + BLOCK]
            for label, text, named in NOTICES:
                need = set(words_of(text))
                if len(need & set(block)) >= -int(-0.8 * len(need) // 1):
                    longer = any(contained(named.split(), n.split()) and len(n) > len(named) and stands(with_gaps(x, n), block) for _, x, n in NOTICES)
                    (want if stands(with_gaps(text, named), block) and not longer else unnamed).add(label)
        assert set(got[i].labels.split(",")) - {""} == want | (set(got[i].base_labels.split(",")) - {""})
        assert set(got[i].unnamed.split(",")) - {""} == unnamed


def test_no_notice_fires_on_another_licence(spark):
    others = [
        ("released under the Apache License", {"apache"}),
        ("code released under the GNU General Public License", {"gpl"}),
        ("not released under a license by the owner", set()),
        ("the press released a statement; under the counter a driver license was found", set()),
        ("licensed under the Mozilla license version 2.0", set()),
        ("Researchers at MIT released the code under the Apache License.", {"apache"}),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", {"cc-by-sa"}),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", {"cc-by-nc-nd"}),
        ("licensed under CC BY-NC-SA 4.0", {"cc-by-nc-sa"}),
        ("licensed under CC BY-NC-ND 4.0", {"cc-by-nc-nd"}),
        ("licensed under CC BY-NC 4.0", {"cc-by-nc"}),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", {"cc-by"}),
        ("the author of this work and the public at large have rights to all of it under law", set()),
    ]
    rows = [(i, t) for i, (t, _) in enumerate(others)] + [(100 + i, text) for i, (_, text, _) in enumerate(NOTICES)]
    got = {r.doc_id: set(r.labels.split(",")) - {""} for r in scan_licenses(frame(spark, rows)).collect()}
    assert [got[i] for i in range(len(others))] == [want for _, want in others]
    assert [got[100 + i] for i in range(len(NOTICES))] == [{label} for label, *_ in NOTICES]


def test_licences_in_a_very_long_text(spark):
    text = "word other " * 400_000 + "MIT License " + "filler " * 300_000 + NOTICES[2][1]
    r = scan_licenses(frame(spark, [(1, text)])).first()
    assert (r.n_words, r.n_base, r.first_word, r.labels) == (1_100_002 + len(words_of(NOTICES[2][1])), 1, 800_000, "bsd,mit")


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(t):
    found = [(0, m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(1, m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(2, m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[1], x[0]))


def secret_texts(n):
    random.seed(4)
    parts = ["password", "passwd", "SECRET", "token", "api_key", "apikey", ":", "=", " ", "'", '"', "é", "abc", "token=", "AKIA", "0123456789abcdef", "ABCDEFGH12", "x", "😀", "-", "ſecret", "a=", "ghp_", "."]
    return ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(n)]


def test_secret_automaton_against_regexes():
    scanner = Scanner(BASE_RULES + MORE_RULES, compile_rules(BASE_RULES + MORE_RULES))
    for t in secret_texts(4000):
        assert [x for x in scanner.spans(t) if x[0] < 3] == base_spans(t), t


def test_rule_patterns_against_regexes():
    random.seed(14)
    patterns = [rb"a(b|cd)*e?f{2,3}", rb"[a-c-]+x{2}", rb"\x61\.[x.]b", rb"(ab?|b+)c{1,}", rb"a{0,2}b"]
    for p in patterns:
        _, own = compile_rules([("x", p, 0, 0)])
        forward = own[0][0]
        for _ in range(2000):
            t = bytes(random.choice(b"abcdefx-.") for _ in range(random.randint(1, 8)))
            s, ends = 0, set()
            for i, c in enumerate(t):
                s = forward.next_state[s, c]
                if s >= forward.first_accepting:
                    ends.add(i + 1)
            want = {j for i in range(len(t)) for j in range(i + 1, len(t) + 1) if re.fullmatch(p, t[i:j])}
            assert ends == want, (p, t)


def test_many_spans_in_a_long_text_of_any_script():
    scanner = Scanner(BASE_RULES, compile_rules(BASE_RULES))
    text = "é token=abcdef12 " * 40_000  # quadratic work would take minutes
    start = time.time()
    found = scanner.spans(text)
    assert found == [(0, 17 * i + 2, 17 * i + 16) for i in range(40_000)]
    assert time.time() - start < 30


def test_secret_query_and_redaction(spark):
    rows = list(enumerate(secret_texts(200))) + ODD + [(900, "x" * 100_000 + " token: abcdef123 ghp_" + "a1B2" * 10)]
    got = {(r.doc_id, r.base_sha256): r for r in scan_secrets(frame(spark, rows)).collect()}
    names = [r[0] for r in BASE_RULES]
    for i, t in rows:
        spans = base_spans(t or "")
        digest = hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        r = got[i, digest]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for k, *_ in spans) for j in range(3)]
    assert "github" in got[900, digest].spans
    clean = {r.doc_id: r.text for r in redact_secrets(frame(spark, rows)).collect()}
    assert clean[900].endswith(" [secret] [secret]") and clean[9003] is None
    assert scan_secrets(frame(spark, rows).limit(0)).count() == 0


def test_edit_distance_against_a_table():
    random.seed(5)
    for _ in range(300):
        p, t = ("".join(random.choice("abc") for _ in range(random.randint(1, n))) for n in (12, 30))
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in t:
            new = [0]
            for j in range(1, len(p) + 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p[j - 1] != c)))
            row = new
            best = min(best, row[-1])
        bits = {}
        for i, c in enumerate(p):
            bits[c] = bits.get(c, 0) | 1 << i
        assert edit_distance(bits, len(p), t) == best


def test_contamination_against_all_windows(spark):
    random.seed(6)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "in", "epsilon", "zeta"]
    text = lambda n: " ".join(random.choice(words) for _ in range(n))
    items = [(i, text(random.randint(8, 25))) for i in range(8)] + [(8, None), (9, "")]
    rows = []
    for i in range(60):
        body = items[i % 8][1]
        edited = "".join(c if random.random() > 0.03 * (i % 5) else random.choice("xyz") for c in body)
        rows.append((i, text(random.randint(0, 30)) + ".\n" + edited.upper() + " " + text(random.randint(0, 30)) if i % 3 else text(40)))
    rows += ODD
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.item_id, r.doc_id): r.distance for r in contaminated(frame(spark, rows), bench, items_per_scan=3).collect()}
    want = {}
    for d, t in rows:
        for i, b in items:
            p = f" {normalised(b)} "
            bits = {}
            for k, c in enumerate(p):
                bits[c] = bits.get(c, 0) | 1 << k
            if b and t and (n := edit_distance(bits, len(p), f" {normalised(t)} ")) <= int((len(p) - 2) * 0.08):
                want[i, d] = n
    assert got == want and want
    left = {r.doc_id for r in drop_contaminated(frame(spark, rows), bench, items_per_scan=3).collect()}
    assert left == {d for d, _ in rows} - {d for _, d in want}


def test_short_items_match_whole_words(spark):
    rows = [(0, "the cat"), (1, "spirit island"), (2, "It is, a cat"), (3, "it is"), (4, "a"), (5, None), (6, "")]
    bench = spark.createDataFrame([(0, "a"), (1, "It is"), (1, "It is"), (2, " \n"), (3, "...")], "item_id long, text string")
    docs = frame(spark, [*rows, (3, "it is")])
    got = sorted((r.item_id, r.doc_id, r.distance) for r in contaminated(docs, bench).collect())
    assert got == [(0, 2, 0), (0, 4, 0), *[(1, 2, 0)] * 2, *[(1, 3, 0)] * 4]
    assert sorted(r.doc_id for r in drop_contaminated(docs, bench).collect()) == [0, 1, 5, 6]
    assert contaminated(docs.limit(0), bench).count() == 0 and drop_contaminated(docs.limit(0), bench).count() == 0
    assert contaminated(docs, bench.limit(0)).count() == 0 and drop_contaminated(docs, bench.limit(0)).count() == 8


def test_item_in_a_very_long_text(spark):
    item = " ".join(f"word{k}" for k in range(30))
    docs = frame(spark, [(1, "other words " * 500_000 + item.upper() + " and more" * 300_000), (2, "other words " * 500_000)])
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [tuple(r) for r in contaminated(docs, bench).collect()] == [(7, 1, 0)]


@pytest.mark.parametrize("f", [scan_licenses, scan_secrets])
def test_repeated_rows(spark, f):
    rows = f(frame(spark, [(5, "MIT License token=abcdefgh")] * 3)).collect()
    assert len(rows) == 3 and len(set(rows)) == 1

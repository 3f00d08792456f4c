"""Properties of the automaton, the encoder and the distance."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm.bpe import Encoder, load_vocabulary
from cadenza.llm.decontaminate import Matcher, normalised
from cadenza.llm.queries import vocabulary_path
from cadenza.llm.secret_scan import BASE_RULES, MORE_RULES, Scanner, compile_rules

SCANNER = Scanner(BASE_RULES + MORE_RULES, compile_rules(BASE_RULES + MORE_RULES))
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
PARTS = st.sampled_from(["token", "Secret", "api_key", "=", ":", " ", '"', "'", "a", "deadbeef", "AKIA", "Q", "é", "😀", "\n", "0"])
TEXT = st.lists(PARTS | st.text(max_size=3), max_size=20).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_spans_equal_regexes(t):
    t = t.encode("utf-8", "ignore").decode()
    want = [(0, m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    want += [(1, m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    want += [(2, m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    assert [x for x in SCANNER.spans(t) if x[0] < 3] == sorted(want, key=lambda x: (x[1], x[0]))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_ids_equal_the_library(t):
    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary_path()
    if not hasattr(test_ids_equal_the_library, "pair"):
        test_ids_equal_the_library.pair = Encoder(load_vocabulary(path)), tokenizers.Tokenizer.from_file(path)
    own, library = test_ids_equal_the_library.pair
    assert own.encode(t)[0] == " ".join(map(str, library.encode(t, add_special_tokens=False).ids))


@settings(max_examples=100, deadline=None)
@given(st.text("abc ", min_size=20, max_size=60), st.text("abc ", max_size=30), st.text("abc ", max_size=30))
def test_an_item_is_found_in_any_text(item, before, after):
    p = normalised(item)
    if len(p) >= 10:
        assert Matcher([(1, p)], 0.1).matches(before + " " + item + " " + after) == [(0, 0)]

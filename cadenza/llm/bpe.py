"""Byte-pair encoding by dynamic programming over prefixes.

For every prefix of a word exactly one token can come last in the prefix's
encoding. An automaton over the vocabulary gives all tokens that end at a
position; the right one is the longest that fits behind the last token of the
shorter prefix, where two tokens fit if encoding their joined symbols would give
just those two. The encoder stores one token per prefix and follows the back
pointers, so a word costs time in proportion to its length however long it is.

Words are cut by the letters and numbers of Unicode 16, as the vocabulary's own library
does, and its lower case is that of Unicode 17: what Python's tables lack is added.

Results for special inputs: a null or empty text has no tokens and decodes to an
empty text; nulls in other columns are carried; equal rows give equal rows; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import cache
from itertools import islice

import ahocorasick
import regex
from pyspark.sql import DataFrame

from .common import as_long, map_rows, release

# How the vocabulary's pre-tokeniser cuts a normalised text; white space,
# which separates words and is dropped; and the letters and numbers of Unicode 16, which
# it follows, beyond those of Python's own tables.
WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NEW = {
    "L": "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b-1138b 1138e-1138e 11390-113b5 113b7-113b7 113d1-113d1 113d3-113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff-18cff 1e5d0-1e5ed 1e5f0-1e5f0",
    "N": "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa",
}
# Capitals that are newer than Python's tables, and their lower case.
NEW_CAPITALS = "1c89 a7cb a7cc a7ce a7d2 a7d4 a7da a7dc 10d50-10d65 16ea0-16eb8"
NEW_LOWER = "1c8a 0264 a7cd a7cf a7d3 a7d5 a7db 019b 10d70-10d85 16ebb-16ed3"
#: Up to here all characters are assigned, so property classes of any version agree.
PLAIN = regex.compile(WORDS.format(letters=r"\p{L}", numbers=r"\p{N}", space=SPACE))
BEYOND_PLAIN = re.compile("[^\x00-\u0377]")


def _listed(ranges: str) -> list[int]:
    ends = [[int(x, 16) for x in r.split("-")] for r in ranges.split()]
    return [c for r in ends for c in range(r[0], r[-1] + 1)]


LOWER = dict(zip(_listed(NEW_CAPITALS), _listed(NEW_LOWER), strict=True))


def _characters(kind: str) -> str:
    """The ranges of a character class that hold a general category."""
    added = set(_listed(NEW[kind]))
    out, first = [], None
    for c in range(0x110001):
        inside = c < 0x110000 and (unicodedata.category(chr(c))[0] == kind or c in added)
        if inside and first is None:
            first = c
        elif not inside and first is not None:
            out.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return "".join(out)


@cache
def any_words() -> re.Pattern:
    return re.compile(WORDS.format(letters=_characters("L"), numbers=_characters("N"), space=SPACE))


def words_of(text: str) -> list[str]:
    return (any_words() if BEYOND_PLAIN.search(text) else PLAIN).findall(text)


WORD_CACHE = 150_000
WORDS_KEPT = 30_000
LAST = 0x10000  # added to the code point of a word's last symbol


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """What the encoder needs of a tokenizer file; a fixed size, fit to broadcast."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    return {
        "vocab": model["vocab"],
        "merges": [m if isinstance(m, list) else m.split(" ") for m in model["merges"]],
        "suffix": model["end_of_word_suffix"] or "",
        "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
    }


class Encoder:
    def __init__(self, vocabulary: dict) -> None:
        self.suffix, self.special = vocabulary["suffix"], vocabulary["special"]
        vocab = vocabulary["vocab"]
        self.tokens = {i: t for t, i in (vocab | self.special).items()}
        self.symbols = {b: c for b, c in byte_symbols().items()}
        self.special_text = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # Ranks of merges; a token made by a merge comes apart into its two parts.
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made_at: dict[int, int] = {}
        for k, (a, b) in enumerate(vocabulary["merges"]):
            pair, made = (vocab[a], vocab[b]), vocab[a + b]
            self.rank[pair] = k
            self.parts.setdefault(made, pair)
            self.made_at.setdefault(made, k)
        self.length: dict[int, int] = {}
        automaton = ahocorasick.Automaton()
        single = {c for c in self.symbols.values()}
        for t, i in vocab.items():
            key = self._key(t)
            if i in self.parts or len(key) == 1 and (key in single or chr(ord(key) - LAST) in single):
                self.length[i] = len(key)
                automaton.add_word(key, i)
        automaton.make_automaton()
        self.automaton = automaton
        self.fits: dict[tuple[int, int], bool] = {}
        self.text_of: dict[str, str] = {}
        self.ids_of = _Words(self._seen)

    def _key(self, token: str) -> str:
        """The symbols of a token, its last one marked if it ends a word."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + LAST)
        return token

    def fit(self, left: int, right: int) -> bool:
        """Whether encoding the symbols of left and right gives these two tokens.
        Undo their merges from the latest back: were any merge across the border
        possible before the one undone last, it would have come first."""
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) > 200_000:
                self.fits.clear()
            found = self.fits[left, right] = self._fit(left, right)
        return found

    def _fit(self, left: int, right: int) -> bool:
        # The merge undone last: a rank, and 1 if in the left token or 2 if in the
        # right one, as equal merges go from left to right.
        limit = (len(self.rank), 0)
        while True:
            if (self.rank.get((left, right), len(self.rank)), 1) < limit:
                return False
            a, b = self.made_at.get(left, -1), self.made_at.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = (a, 1), self.parts[left][1]
            else:
                limit, right = (b, 2), self.parts[right][0]

    def encode_word(self, word: str) -> list[int]:
        """The ids of one pre-tokenised word."""
        symbols = "".join(map(self.symbols.__getitem__, word.encode("utf-8", "surrogatepass")))
        if not symbols:
            return []
        if self.suffix:
            symbols = symbols[:-1] + chr(ord(symbols[-1]) + LAST)
        last = [-1] * (len(symbols) + 1)
        length, fit = self.length, self.fit
        for end, token in self.automaton.iter(symbols):  # the longest token first at each end
            end += 1
            if last[end] < 0:
                begin = end - length[token]
                if begin == 0 or last[begin] >= 0 and fit(last[begin], token):
                    last[end] = token
        out, end = [], len(symbols)
        while end:
            out.append(last[end])
            end -= length[last[end]]
        return out[::-1]

    def _seen(self, word: str) -> str:
        """The ids of a new word; its tokens' text is kept beside them."""
        ids = self.encode_word(word)
        self.text_of[word] = " ".join(map(self.tokens.__getitem__, ids))
        return " ".join(map(str, ids))

    def pieces(self, text: str) -> list[tuple[bool, list[str]]]:
        """The words of the text between special tokens, and those tokens."""
        parts = self.special_text.split(text) if self.special_text and "<|" in text else [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append((True, [part]))
            elif part:
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out.append((False, words_of(part.translate(LOWER) if BEYOND_PLAIN.search(part) else part)))
        return out

    def encode(self, text: str | None) -> tuple[str, str]:
        """(ids joined by spaces, decoded text) of a whole text."""
        ids, words = [], []
        for special, found in self.pieces(text or ""):
            if special:
                ids.append(str(self.special[found[0]]))
                words.append(found[0])
            else:
                ids += map(self.ids_of.__getitem__, found)
                words += map(self.text_of.__getitem__, found)
        return " ".join(ids), " ".join(words)

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids)

    def forget(self) -> None:
        """Keep the words seen within a bound; called between batches."""
        if len(self.ids_of) > WORD_CACHE:
            self.forget_all()

    def forget_all(self) -> None:
        """Called at the end of a task: the words seen first, the common ones, stay."""
        for seen in (self.ids_of, self.text_of):
            first = list(islice(seen.items(), WORDS_KEPT))
            seen.clear()
            seen.update(first)


class _Words(dict):
    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, word: str) -> str:
        self[word] = out = self.make(word)
        return out


#: A Python worker serves many tasks; it keeps its encoder and the common words.
_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str, shared) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(shared.value)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", full: bool = False) -> DataFrame:
    """A row for each row of docs: key, the number of tokens and digests of the ids
    and of the text decoded from them; full adds ids and the decoded text itself."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    release()

    def start():
        encoder = _encoder(path, shared)

        def batch(cols):
            rows = []
            for k, t in zip(*cols, strict=True):
                ids, words = encoder.encode(t)
                row = (k, ids.count(" ") + 1 if ids else 0, _sha(ids), _sha(words))
                rows.append((*row, list(map(int, ids.split())), words) if full else row)
            encoder.forget()
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * (6 if full else 4)

        batch.close = encoder.forget_all
        return batch

    more = ", ids array<int>, decoded string" if full else ""
    return map_rows(as_long(docs, key, text), f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}", start)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

"""Licence scans as an exact set-similarity join of text blocks and templates.

A block is a window of BLOCK words; windows overlap, so any passage of up to
BLOCK / 2 words lies whole in one. A block holds a template if it has at least
ceil(threshold * size) of the template's distinct words (its containment). The
join is exact: the templates' words are ordered by their counts over all
documents, rarest first; a block that meets the threshold must hold one of the
first size - needed + 1 words of a template (prefix filter), must have as many
words as are needed (length filter), and where its first hit is the i-th word in
that order, only size - i are left to be found (positional filter). What passes is
counted word by word. Such a block gives the notice's label where the words that name the licence
stand in it in the notice's order and as near to each other as there (one more word may stand in each
gap), and no longer name that contains this one does (Attribution-ShareAlike is not Attribution). The
labels of the other blocks that meet the threshold are in `unnamed`, so the join is complete.

Phrase templates have threshold 1 and are then checked for words that stand
consecutively; they give the base places. Templates of notices add labels.

The templates are fixed, so their index is broadcast and blocks are joined where
they are read: no text is shuffled, and a licence line that a third of all rows
hold makes no task larger.

Results for special inputs: a null or empty text has no words and empty labels;
a null key is kept; other columns are not read; equal rows give equal rows; an empty table
gives no rows; of a very long text only blocks around rare words are looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_long, map_rows

# The phrases whose places count, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notices of well-known licences: the label that a notice adds, its text and
# the words of it that name the licence, in their order.
NOTICES = [
    ("apache", "licensed under the apache license version 2.0", "apache"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0", "apache"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution binary"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license", "creative commons attribution"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4.0 international license", "creative commons attribution noncommercial"),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives 4.0 international license", "creative commons attribution noncommercial noderivatives"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4.0 international license", "creative commons attribution noncommercial sharealike"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4.0 international license", "creative commons attribution noderivatives"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4.0 international license", "creative commons attribution sharealike"),
    ("cc-by", "licensed under cc by 4.0", "cc by"),
    ("cc-by-nc", "licensed under cc by nc 4.0", "cc by nc"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4.0", "cc by nc nd"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4.0", "cc by nc sa"),
    ("cc-by-nd", "licensed under cc by nd 4.0", "cc by nd"),
    ("cc-by-sa", "licensed under cc by sa 4.0", "cc by sa"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived copyright"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission fee"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission charge"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v. 2.0", "mozilla public"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "warranty liable"),
]
BLOCK = 64
THRESHOLD = 0.8
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of ASCII letters, digits and all other characters, in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


@dataclass
class Template:
    label: str
    phrase: list[bytes]
    consecutive: bool
    threshold: float
    name: str = ""  # a pattern over words joined by spaces
    longer: list[str] = field(default_factory=list)
    order: list[bytes] = field(default_factory=list)
    needed: int = 0


def name_pattern(text: str, names: str) -> str:
    """A pattern, for words joined by single spaces, of a notice's names in order, with as many
    words between them as in the notice and one more at most. It uses nothing that RE2 lacks."""
    words, at, out = text.split(), -1, "(?:^| )"
    for k, n in enumerate(names.split()):
        here = words.index(n, at + 1)
        out += (f"(?: [^ ]+){{0,{here - at}}} " if k else "") + re.escape(n)
        at = here
    return out + "(?: |$)"


def _contained(short: str, long: str) -> bool:
    rest = iter(long.split())
    return short != long and all(w in rest for w in short.split())


def longer_names(names: str) -> list[str]:
    """The patterns of notices whose names contain these in order, and more."""
    return [name_pattern(v, n) for _, v, n in NOTICES if _contained(names, n)]


def templates(threshold: float) -> list[Template]:
    notices = [Template(k, words_of(v), False, threshold, name_pattern(v, n), longer_names(n)) for k, v, n in NOTICES]
    return [Template(v, words_of(k), True, 1.0) for k, v in PHRASES.items()] + notices


def word_counts(docs: DataFrame, text: str, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How often each word of a fixed vocabulary stands in all texts; counted in
    each task, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                total.update(filter(vocabulary.__contains__, words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    found = docs.select(F.col(f"`{text}`")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word.encode(): r.n for r in found.collect()}  # as many rows as the templates have words


class Index:
    """The prefix index of the templates under a global order of words."""

    def __init__(self, temps: list[Template], counts: dict[bytes, int]) -> None:
        self.temps = temps
        self.names: list[tuple[re.Pattern, list[re.Pattern]]] = []
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for k, t in enumerate(temps):
            t.order = sorted(set(t.phrase), key=lambda w: (counts.get(w, 0), w))
            t.needed = -int(-t.threshold * len(t.order) // 1)
            self.names.append((re.compile(t.name.encode()), [re.compile(n.encode()) for n in t.longer]))
            for i, w in enumerate(t.order[: len(t.order) - t.needed + 1]):
                self.prefix.setdefault(w, []).append((k, i))

    def blocks_with(self, words: list[bytes]) -> Iterator[tuple[int, int, int, float]]:
        """(template, first word, end word, containment) of the blocks that meet a threshold."""
        prefix = self.prefix
        hits = [i for i, w in enumerate(words) if w in prefix] if not prefix.keys().isdisjoint(words) else []
        step, tested = BLOCK // 2, set()
        for i in hits:
            for first in {max(0, i // step - 1) * step, i // step * step}:
                end = min(first + BLOCK, len(words))
                for k, _ in prefix[words[i]]:
                    t = self.temps[k]
                    if (k, first) in tested or not first <= i < end or end - first < t.needed:  # length filter
                        continue
                    tested.add((k, first))
                    have = set(words[first:end])
                    at = next(j for j, w in enumerate(t.order) if w in have)
                    if len(t.order) - at >= t.needed:  # positional filter
                        held = sum(w in have for w in t.order)
                        if held >= t.needed:
                            yield k, first, end, held / len(t.order)

    def named(self, k: int, block: list[bytes]) -> bool:
        """Whether a block holds the template's names, and no longer ones that contain them."""
        name, longer = self.names[k]
        joined = b" ".join(block)
        return bool(name.search(joined)) and not any(n.search(joined) for n in longer)

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, str, float]:
        words = words_of(text)
        places: set[tuple[int, int]] = set()
        base, more, unnamed, best = set(), set(), set(), 0.0
        for k, first, end, held in self.blocks_with(words):
            t = self.temps[k]
            if t.consecutive:
                n = len(t.phrase)
                at = first
                while True:
                    try:
                        at = words.index(t.phrase[0], at, end)
                    except ValueError:
                        break
                    if words[at : at + n] == t.phrase:
                        places.add((at, k))
                        base.add(t.label)
                    at += 1
            elif self.named(k, words[first:end]):
                more.add(t.label)
                best = max(best, held)
            else:
                unnamed.add(t.label)
        starts = [at for at, _ in places]
        return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), ",".join(sorted(unnamed)), 1.0 if base else best)


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of docs: words, places of the phrases, labels, those of blocks without the names, and the
    highest containment of a template that it holds (1 where a phrase stands)."""
    temps = templates(threshold)
    vocabulary = frozenset(w for t in temps for w in t.phrase)
    shared = docs.sparkSession.sparkContext.broadcast((temps, word_counts(docs, text, vocabulary)))

    def start():
        index = Index(*shared.value)

        def batch(cols):
            out = [(k, *index.scan(t)) for k, t in zip(*cols, strict=True)]
            return [list(c) for c in zip(*out, strict=True)] if out else [[]] * 9

        return batch

    return map_rows(as_long(docs, key, text), f"{key} long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, unnamed string, score double", start)

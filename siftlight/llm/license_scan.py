"""Fuzzy search for short licence notices.

A notice of m characters with at most k edits, cut into k + 1 seeds, holds at least one
seed unchanged (pigeonhole). All seeds of all notices are found in one pass of an
Aho-Corasick automaton over the text's words joined by spaces; around each the ``regex``
library's bounded-error matching verifies the notice and counts the edits. Base phrases
are places where their words stand one after another, exactly; they are notices too, in
whole words only, so that a slip in one is found in whatever sentence it stands.

Letters A-Z count as a-z; words are runs of digits, letters and characters from U+0080
on. Defined results: a null or empty text has no words and no labels; null ids and
repeated rows are scanned like others; matches of one place are in order of end, then label;
a text of any length is scanned whole, in time about proportional to it; other columns are
ignored; empty in, empty out.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlight.llm.common import slices, text_or_empty


@dataclass(frozen=True)
class Notice:
    """With ``whole``, a match is widened to whole words and its edits are those of them;
    it must hold ``core``, unless a single slip explains it, and be nearer to the notice
    than to each of ``unlike``."""

    label: str
    words: str
    edits: int
    whole: bool = False
    core: str = ""
    unlike: tuple[str, ...] = ()


#: Exact phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Notices that are searched with edits: about one for each dozen characters.
NOTICES = (
    Notice("mit", "released under the mit license", 2),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 6),
    Notice("apache-2", "licensed under the apache license version 2 0", 3),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", 2),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 3),
    Notice("cc-by", "creative commons attribution 4 0 international", 3),
    Notice("cc-by-sa", "creative commons attribution sharealike", 3),
    Notice("gpl-2", "gnu general public license version 2 of", 1),
    Notice("gpl-3", "licensed under the gnu general public license version 3", 3),
    Notice("lgpl", "gnu lesser general public license", 2),
    Notice("agpl", "gnu affero general public license", 2),
    Notice("mpl-2", "subject to the terms of the mozilla public license", 4),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 6),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 5),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 5),
    Notice("proprietary", "all rights reserved", 1),
    Notice("mit", "under the mit license", 2, whole=True, core="mit"),
    Notice("apache-2", "apache license version 2", 2, whole=True, core="apache", unlike=("apache license version 1",)),
    Notice("cc-by-nc", "cc by nc", 1, whole=True, unlike=("cc by nd", "cc by no")),
)

_WORDS = bytes(c if c >= 128 or 48 <= c < 58 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def _edits(a: str, b: str, swaps: bool = False) -> int:
    """Edit distance; with ``swaps``, two neighbours that changed places are one edit."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
            if swaps and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[-1] = min(row[-1], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


def _whole_edits(notice: Notice, text: str) -> int | None:
    """The edits of whole words against the notice; None if they aren't one."""
    n = _edits(text, notice.words)
    if n > notice.edits or any(_edits(text, other) <= n for other in notice.unlike):
        return None
    return n if notice.core in text or _edits(text, notice.words, swaps=True) <= 1 else None


class NoticeScanner:
    def __init__(self, notices: Iterable[Notice] = NOTICES, phrases: Iterable[tuple[str, str]] = PHRASES):
        import ahocorasick
        import regex

        self.notices = list(notices)
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases]
        self.verify = [regex.compile(f"(?b)(?:{regex.escape(x.words)}){{e<={x.edits}}}") for x in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for number, notice in enumerate(self.notices):
            n, parts = len(notice.words), notice.edits + 1
            for i in range(parts):
                a, b = n * i // parts, n * (i + 1) // parts
                seeds.setdefault(notice.words[a:b], []).append((number, a))
        self.seeds = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.seeds.add_word(seed, (len(seed), uses))
        self.seeds.make_automaton()

    def scan(self, text: str) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, int]]]:
        """The number of words; base matches (label, first word); notice matches (label,
        first word, last word, edits)."""
        words = text.encode().translate(_WORDS).split()
        joined = b" ".join([b"", *words, b""])
        base = []
        for phrase, label in self.phrases:
            at, counted, word = joined.find(phrase), 0, 0
            while at >= 0:
                word += joined.count(b" ", counted, at)
                counted = at
                base.append((label, word))
                at = joined.find(phrase, at + 1)
        return len(words), sorted(base, key=lambda x: x[1]), self._fuzzy(joined.decode()) if words else []

    def _fuzzy(self, line: str) -> list[tuple[str, int, int, int]]:
        starts: dict[int, set[int]] = {}
        for end, (size, uses) in self.seeds.iter(line):
            for number, offset in uses:
                starts.setdefault(number, set()).add(end + 1 - size - offset)
        found = []
        spaces = None  # where words part, to number them
        for number, places in starts.items():
            notice, size = self.notices[number], len(self.notices[number].words)
            done = -1
            for place in sorted(places):
                if place + size <= done:  # within the last match
                    continue
                low, high = max(0, place - notice.edits, done), min(len(line), place + size + notice.edits)
                match = self.verify[number].search(line, low, high)
                if match:
                    a, b = match.span()
                    while a < b and line[a] == " ":
                        a += 1
                    while b > a and line[b - 1] == " ":
                        b -= 1
                    edits: int | None = sum(match.fuzzy_counts)
                    if notice.whole:
                        a, b = line.rfind(" ", 0, a + 1) + 1, line.find(" ", b)
                        edits = _whole_edits(notice, line[a:b])
                        if edits is None:
                            continue
                    done = match.end()
                    if edits or not notice.whole:  # whole and without edits: a base phrase
                        if spaces is None:
                            spaces = [i for i, c in enumerate(line) if c == " "]
                        found.append((notice.label, bisect_left(spaces, a) - 1, bisect_left(spaces, b) - 1, edits))
        return sorted(found, key=lambda x: x[1:])


_MATCH = "struct<label:string,start:long,end:long,edits:long,exact:boolean>"
_MATCH_TYPE = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64()), ("exact", pa.bool_())])


def scan_licenses(docs: DataFrame, *, notices: Iterable[Notice] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, base_words (first words of base matches, in order), base_labels
    and matches: every base or notice match with its label, its span in the text (code
    points, end exclusive), its edits and whether it is a base phrase; score: 1 less the
    share of edits in the best match, 0 without one."""
    notices = tuple(notices)
    sizes = {p: len(p.split()) for p, _ in PHRASES}
    lengths = {label: sizes[p] for p, label in PHRASES}
    longest = {x.label: max(len(y.words) for y in notices if y.label == x.label) for x in notices}
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("base_words", pa.list_(pa.int64())), ("base_labels", pa.list_(pa.string())),
        ("matches", pa.list_(_MATCH_TYPE)), ("score", pa.float64()),
    ])

    def spans(text, base, fuzzy):
        if not base and not fuzzy:
            return []
        at = [m.span() for m in _WORD.finditer(text)]
        out = [(label, at[w][0], at[w + lengths[label] - 1][1], 0, True) for label, w in base]
        out += [(label, at[a][0], at[b][1], edits, False) for label, a, b, edits in fuzzy]
        return [dict(zip(("label", "start", "end", "edits", "exact"), x)) for x in sorted(out, key=lambda x: x[1:3] + x[:1])]

    def run(batches):
        scanner = _scanner(notices)
        for ids, texts in slices(batches):
            rows: list[tuple] = []
            for text in texts:
                n, base, fuzzy = scanner.scan(text)
                score = 1.0 if base else max((1 - e / longest[label] for label, _, _, e in fuzzy), default=0.0)
                rows.append((n, [w for _, w in base], sorted({x for x, _ in base}), spans(text, base, fuzzy), score))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return picked.mapInArrow(
        run, f"doc_id long, n_words long, base_words array<long>, base_labels array<string>, matches array<{_MATCH}>, score double"
    )


_scanners: dict[tuple, NoticeScanner] = {}


def _scanner(notices: tuple[Notice, ...]) -> NoticeScanner:
    if notices not in _scanners:
        _scanners[notices] = NoticeScanner(notices)
    return _scanners[notices]

"""License scan: exact phrases, and short notices found with a bounded number of edits.

A notice with at most k edits in it holds one of its k + 1 pieces unchanged, so the pieces are exact
seeds: one automaton finds the seeds of all notices in a pass over the text. Around each seed the
``regex`` library's fuzzy matching decides, counts the edits and gives the span.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from rollmark.llm.common import prepare

#: Exact phrases, which are found wherever their words stand in a row. Fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Short notices in lower-case words. The usual wordings of public licenses.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("epl", "under the terms of the eclipse public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
)
#: One edit (a character more, less or other) is allowed for so many characters of a notice.
CHARACTERS_PER_EDIT = 14
#: A window of many seeds is searched in pieces of about so many notice lengths.
PIECE = 4

_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

ROWS = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "notices array<struct<label:string,start_word:long,stop_word:long,edits:int>>"
)


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    edits: int
    pattern: regex.Pattern


class Scanner:
    """Seeds of all notices in one automaton."""

    def __init__(self, notices: tuple[tuple[str, str], ...], per_edit: int):
        self.notices: list[Notice] = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for number, (label, text) in enumerate(notices):
            edits = len(text) // per_edit
            # whole words only; the match is as good as it gets from its start on
            pattern = regex.compile(rf"(?be)(?<![^ ])(?:{regex.escape(text)}){{e<={edits}}}(?![^ ])")
            self.notices.append(Notice(label, text, edits, pattern))
            cuts = [len(text) * i // (edits + 1) for i in range(edits + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                seeds.setdefault(text[a:b], []).append((number, a))
        self.automaton = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.automaton.add_word(seed, (len(seed), places))
        self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """Per notice the merged parts of the text around its seeds."""
        out: dict[int, list[list[int]]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for number, offset in places:
                notice = self.notices[number]
                begin = max(0, last - size + 1 - offset - notice.edits)
                end = min(len(text), last - size + 1 - offset + len(notice.text) + 2 * notice.edits)
                found = out.setdefault(number, [])
                if found and begin <= found[-1][1]:
                    found[-1][0] = min(found[-1][0], begin)
                    found[-1][1] = max(found[-1][1], end)
                else:
                    found.append([begin, end])
        return out

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """Notices in ``text`` (words between single spaces): number, start, stop, edits."""
        out = []
        for number, parts in self.windows(text).items():
            notice = self.notices[number]
            for begin, end in parts:
                # one more character on each side tells where words end
                found = {m.span(): sum(m.fuzzy_counts) for a, b in _pieces(notice, text, max(0, begin - 1), min(len(text), end + 1)) for m in _matches(notice, text, a, b)}
                out += [(number, start, stop, edits) for (start, stop), edits in _apart(found)]
        return out


def _pieces(notice: Notice, text: str, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """A long window in pieces of some notice lengths that end at spaces; any match lies within one of them.

    Work on a piece is bounded, so that on a text grows with its length only.
    """
    longest = len(notice.text) + notice.edits + 2
    while end - begin > 2 * PIECE * longest:
        cut = text.find(" ", begin + PIECE * longest, end)
        if cut < 0:
            break
        yield begin, cut + 1
        # the last match of the piece may be cut off, so the next one begins a longest match before
        begin = max(begin + 1, text.rfind(" ", begin, cut - longest))
    yield begin, end


def _matches(notice: Notice, text: str, begin: int, end: int) -> Iterator[regex.Match]:
    """The best match of a part of the text, then those of what is left and right of it."""
    parts = [(begin, end)]
    while parts:
        begin, end = parts.pop()
        if end - begin >= len(notice.text) - notice.edits and (m := notice.pattern.search(text, begin, end)):
            yield m
            parts += [(begin, m.start()), (m.end(), end)]


def _apart(found: dict[tuple[int, int], int]) -> list[tuple[tuple[int, int], int]]:
    """Of matches that overlap the one with the fewest edits, the first of equals."""
    kept: list[tuple[tuple[int, int], int]] = []
    for span, edits in sorted(found.items(), key=lambda x: (x[1], x[0])):
        at = bisect_left(kept, (span, -1))
        if (at == 0 or kept[at - 1][0][1] <= span[0]) and (at == len(kept) or kept[at][0][0] >= span[1]):
            kept.insert(at, (span, edits))
    return kept


_SCANNERS: dict[tuple, Scanner] = {}


def _scanner(notices: tuple[tuple[str, str], ...], per_edit: int) -> Scanner:
    key = (notices, per_edit)
    if key not in _SCANNERS:
        _SCANNERS[key] = Scanner(notices, per_edit)
    return _SCANNERS[key]


def scan(text: str, phrases: dict[str, str], scanner: Scanner) -> dict:
    """All that is reported of one text."""
    words = text.encode().translate(_CLEAN).split()
    clean = (b" " + b" ".join(words) + b" ").decode()
    starts: list[int] = []
    base: set[str] = set()
    for phrase, label in phrases.items():
        wanted, at = f" {phrase} ", -1
        while (at := clean.find(wanted, at + 1)) >= 0:
            starts.append(at)
            base.add(label)
    places = scanner.find(clean)
    # word numbers: how many spaces are before a place
    spaces = np.flatnonzero(np.frombuffer(clean.encode("utf-32-le"), dtype="<u4") == 32) if places or starts else np.zeros(0)
    found = []
    score = 1.0 if base else 0.0
    for number, begin, end, edits in places:
        notice = scanner.notices[number]
        while clean[begin] == " ":
            begin += 1
        first = int(np.searchsorted(spaces, begin)) - 1
        found.append({"label": notice.label, "start_word": first, "stop_word": first + len(clean[begin:end].split()), "edits": edits})
        score = max(score, 1 - edits / len(notice.text))
    found.sort(key=lambda x: (x["start_word"], x["label"], x["stop_word"]))
    places = [int(np.searchsorted(spaces, s)) for s in (min(starts), max(starts))] if starts else [None, None]
    labels = base | {x["label"] for x in found}
    return {
        "n_words": len(words),
        "n_base": len(starts),
        "first_word": places[0],
        "last_word": places[1],
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(labels)),
        "score": score,
        "notices": found,
    }


def _scan(phrases: dict[str, str], notices: tuple[tuple[str, str], ...], per_edit: int):
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]
    kinds.append(pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("stop_word", pa.int64()), ("edits", pa.int32())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(notices, per_edit)
        for batch in batches:
            rows = [scan(t or "", phrases, scanner) for t in batch.column(1).to_pylist()]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[n] for r in rows], type=k) for n, k in zip(names, kinds, strict=True))], names=["doc_id", *names])

    return run


def license_scan(
    docs: DataFrame,
    phrases: dict[str, str] | None = None,
    notices: tuple[tuple[str, str], ...] = NOTICES,
    per_edit: int = CHARACTERS_PER_EDIT,
) -> DataFrame:
    """Per document: words, places and labels of the phrases, labels with those of notices, score, notices.

    Words are runs of digits, letters (A-Z in lower case) and non-ASCII characters. ``first_word`` and
    ``last_word`` are the smallest and largest first word of a phrase's place, null if there is none.
    ``score`` is 1 for a phrase, otherwise the unchanged share of the best notice, or 0. ``notices``
    lists label, first and last word (exclusive) and edits. A null text is empty; null ids and
    repeated rows are reported like all others. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(_scan(dict(PHRASES if phrases is None else phrases), notices, per_edit), ROWS)

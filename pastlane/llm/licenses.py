"""Short licence notices with spelling errors, found by pigeonhole seeds (operator 5).

A notice of L letters may have k = L // 8 errors (4 at most). Cut into k + 1 pieces, one
of them must stand in the text unchanged, so one automaton over all pieces finds every
place worth a look. The ``regex`` library's bounded-error matching then decides in a
window of that place, counts the edits and gives the span. The word that names a licence (``NAMES``) is bounded apart: it
has no error if it is short, and one at most else, so that one name is never read as another.

Texts are compared as words: A-Z in lower case, words of letters, digits and all beyond
ASCII, joined by one space. Null texts are empty; an empty text has no words, labels or
spans, and an empty table no rows. The whole text is searched, in time that grows with its length, and repeated rows are searched each.
Of places that overlap the one with the fewest errors stays, of equals the longest, then the first notice of the list. The scan
looks at one column and gives one, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from pastlane.llm.arrays import slices

# The phrases that are counted exactly, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices that may be misspelled, and their labels.
NOTICES = [
    ("all rights reserved", "reserved"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("creative commons attribution", "cc-by"),
    ("licensed under cc by", "cc-by"),
    ("creative commons zero", "cc0"),
    ("dedicated to the public domain", "public-domain"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("licensed under the bsd license", "bsd"),
    ("licensed under the isc license", "isc"),
    ("licensed under the gpl license", "gpl"),
    ("released under the isc license", "isc"),
    ("released under the gpl license", "gpl"),
    ("released under the apache license", "apache"),
    ("permission is hereby granted free of charge", "mit"),
    ("licensed under the apache license", "apache"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("released under the bsd license", "bsd"),
    ("permission to use copy modify and distribute this software", "isc"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("boost software license", "boost"),
    ("this is free and unencumbered software", "unlicense"),
    ("spdx license identifier", "spdx"),
]
# The words that name a licence.
NAMES = set("mit bsd isc gpl apache mozilla eclipse boost lesser affero".split())
LETTERS_PER_NAME_EDIT = 5
LETTERS_PER_EDIT = 8
MOST_EDITS = 4

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))

SPAN = pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()),
                  ("last_word", pa.int64()), ("edits", pa.int32()), ("found", pa.string())])
RESULT = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                    ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("spans", pa.list_(SPAN))])
RESULT_DDL = ("struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, "
              "base_labels: array<string>, spans: array<struct<label: string, notice: string, "
              "first_word: bigint, last_word: bigint, edits: int, found: string>>>")


class Notices:
    """An automaton over the pieces of all notices, and a bounded-error pattern for each."""

    def __init__(self, notices: list[tuple[str, str]]):
        self.notices, seeds = [], {}
        for number, (notice, label) in enumerate(notices):
            edits = min(MOST_EDITS, len(notice) // LETTERS_PER_EDIT)
            # BESTMATCH: of all places in the window the one with the fewest edits.
            pattern = regex.compile(rf"(?b)\b(?:{regex.escape(notice)}){{e<={edits}}}\b")
            names = [regex.compile(rf"(?:{name}){{e<=1}}" if len(name) >= LETTERS_PER_NAME_EDIT else rf"\b{name}\b")
                     for name in notice.split() if name in NAMES]
            self.notices.append((notice, label, edits, pattern, names))
            cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(notice[start:stop], []).append((number, start, stop - start))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, uses)
        self.automaton.make_automaton()

    def spans(self, words: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) of each place, of notices in text order."""
        done: dict[int, int] = {}  # by notice, up to where its windows have been looked at
        found = []
        for end, uses in self.automaton.iter(words):
            for number, offset, size in uses:
                notice, _, edits, pattern, names = self.notices[number]
                start = end + 1 - size - offset
                if start + edits < done.get(number, 0):
                    continue  # inside the place found last
                window = max(0, start - edits, done.get(number, 0)), start + len(notice) + edits
                match = pattern.search(words, window[0], min(len(words), window[1]))
                if match and all(name.search(match[0]) for name in names):
                    first = match.start() + len(match[0]) - len(match[0].lstrip(" "))
                    found.append((number, first, first + len(match[0].strip(" ")), sum(match.fuzzy_counts)))
                    done[number] = match.end()
        return _fewest_edits(found)


def _fewest_edits(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of places that overlap, those that no other with fewer edits (or as few and longer) covers."""
    kept = []
    for place in sorted(found, key=lambda x: (x[1], x[2])):
        rank = (place[3], place[1] - place[2], place[0])
        while kept and kept[-1][2] > place[1] and rank < (kept[-1][3], kept[-1][1] - kept[-1][2], kept[-1][0]):
            kept.pop()
        if not kept or kept[-1][2] <= place[1]:
            kept.append(place)
    return kept


def scan(text: str | None, notices: Notices) -> dict:
    parts = (text or "").encode().translate(_LOWER).split()
    words = b" ".join(parts).decode()
    starts, labels = [], set()
    padded = f" {words} "
    for phrase, label in BASE.items():
        at = padded.find(f" {phrase} ")
        while at >= 0:
            starts.append(at)
            labels.add(label)
            at = padded.find(f" {phrase} ", at + 1)
    ends = [padded.count(" ", 0, at) for at in (min(starts), max(starts))] if starts else [None, None]
    spans, at, before = [], 0, 0
    for number, start, end, edits in notices.spans(words):  # in text order, so blanks are counted once
        notice, label, *_ = notices.notices[number]
        at, before = start, before + words.count(" ", at, start)
        spans.append({"label": label, "notice": notice, "first_word": before,
                      "last_word": before + words.count(" ", start, end - 1), "edits": edits, "found": words[start:end]})
    return {"n_words": len(parts), "n_base": len(starts), "first_word": ends[0], "last_word": ends[1],
            "base_labels": sorted(labels), "spans": spans}


def licence_scan(text: Column, notices: list[tuple[str, str]] | None = None) -> Column:
    """A struct of the exact phrases' counts and places, their labels, and the spans of misspelled notices."""
    chosen = NOTICES if notices is None else notices

    @F.arrow_udf(RESULT_DDL)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = Notices(chosen)
        for column in batches:
            yield pa.chunked_array([
                pa.array([scan(x, made) for x in column.slice(start, stop - start).to_pylist()], RESULT)
                for start, stop in slices(column)], RESULT).combine_chunks()

    return search(text)

"""License scan: exact phrase counts, and fuzzy search of short notices.

Pigeonhole: of the k + 1 pieces of a notice found with at most k edits one stands unedited, and of n pieces n - k do. So
exact seeds locate candidates: the pieces of a notice without names, and else the exact words that name the license (three
edits turn any three-letter name into another). A candidate needs n - k of the small pieces near their places. Only then
the ``regex`` library matches what lies left and right of the seed with bounded errors, from and to
every word's end in reach, each distinct text once. So all places within the bound are known, with their
fewest edits, and of overlapping ones that with the fewest edits is reported.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallylake.llm.common import WORDS, arrow_map, per_batch, utf8

# Phrases and labels of the base count.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Names of licenses and their labels.
NAMES = {
    "agpl": "agpl",
    "apache": "apache",
    "boost": "boost",
    "bsd": "bsd",
    "eupl": "eupl",
    "gpl": "gpl",
    "isc": "isc",
    "lgpl": "lgpl",
    "mit": "mit",
    "mpl": "mpl",
    "zlib": "zlib",
}
# Notices searched with errors: the words before the name, the names (with labels), the words after it,
# most edits outside the name. The texts are lower-case words; a notice without names has one label.
NOTICES = (
    ("", {"gnu": "gpl"}, "general public license", 3),
    ("gnu lesser general public license", "lgpl", "", 3),
    ("gnu affero general public license", "agpl", "", 3),
    ("", NAMES, "license", 1),
    ("licensed under the", NAMES, "license", 3),
    ("released under the", NAMES, "license", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", "", 6),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", "", 6),
    ("redistribution and use in source and binary forms", "bsd", "", 4),
    ("this is free and unencumbered software released into the public domain", "unlicense", "", 5),
    ("mozilla public license", "mpl", "", 2),
    ("eclipse public license", "epl", "", 2),
    ("creative commons attribution", "cc-by", "", 3),
    ("creative commons zero", "cc0", "", 2),
    ("", {"all": "proprietary"}, "rights reserved", 2),
)


def _cut(raw: bytes, n: int) -> list[tuple[int, bytes]]:
    cuts = [round(k * len(raw) / n) for k in range(n + 1)]
    return [(cuts[k], raw[cuts[k] : cuts[k + 1]]) for k in range(n)]


class Part:
    """Fixed words on one side of a seed: how many edits lie between them and a text, by the ``regex`` library."""

    #: Distinct texts whose edits are kept.
    KEPT = 50_000

    def __init__(self, raw: bytes, edits: int, alone: bool = False):
        self.raw, self.edits, self.known = raw, edits, {raw: 0}
        #: Small pieces that a match has near their places, all but at most ``edits`` of them.
        self.pieces = _cut(raw, max(edits + 1 if alone else 1, len(raw) // 5)) if raw else []
        self.letters = [(c, raw.count(c)) for c in map(bytes, zip(sorted(set(raw))))]
        self.pattern = regex.compile(b"(?:%s){e<=%d}" % (regex.escape(raw, special_only=False, literal_spaces=True), edits), regex.BESTMATCH) if raw else None

    def distance(self, text: bytes) -> int | None:
        """The fewest edits, None if there are more than allowed."""
        if not self.raw:
            return len(text) if len(text) <= self.edits else None
        if text not in self.known:
            if len(self.known) > self.KEPT:
                self.known = {self.raw: 0}
            # letters that the text lacks are edits
            lacking = sum(max(0, n - text.count(c)) for c, n in self.letters)
            m = self.pattern.fullmatch(text) if lacking <= self.edits else None
            self.known[text] = sum(m.fuzzy_counts) if m else None
        return self.known[text]

    def near(self, flat: bytes, at: int) -> int:
        """How many of the pieces stand near their places, if the words begin at ``at`` or so."""
        k = self.edits
        return sum(flat.find(x, max(0, at + o - k), max(0, at + o + len(x) + k)) >= 0 for o, x in self.pieces)

    def all_near(self, flat: bytes, at: np.ndarray) -> np.ndarray:
        """The same for many ascending places."""
        out = np.zeros(len(at), np.int64)
        for o, x in self.pieces:
            found = np.fromiter(occurrences(flat, x), np.int64)
            out += np.searchsorted(found, at + o + self.edits, side="right") > np.searchsorted(found, at + o - self.edits)
        return out


class Notice:
    """A notice ready for search: seeds, and for each the parts to its left and right."""

    def __init__(self, before: str, names: dict[str, str] | str, after: str, edits: int):
        self.edits = edits
        if isinstance(names, str):
            raw = before.encode()
            self.label, self.names, self.pattern = names, {}, None
            cut = _cut(raw, edits + 1)
            # where the piece before stands exactly too and no start is within it, that piece finds the same places
            before = [b"", *(y if at >= len(y) + edits else b"" for (at, _), (_, y) in zip(cut[1:], cut, strict=False))]
            self.seeds = [(x, y, Part(raw[:at], edits), Part(raw[at + len(x) :], edits)) for (at, x), y in zip(cut, before, strict=True)]
        else:
            self.label, self.names = "", {k.encode(): v for k, v in names.items()}
            self.pattern = regex.compile(rb"(?<![^ ])(?:" + b"|".join(map(regex.escape, sorted(self.names, key=len, reverse=True))) + rb")(?![^ ])")
            self.seeds = [(b"", b"", Part(before.encode(), edits, not after), Part(after.encode(), edits, not before))]

    def anchors(self, flat: bytes, seen: dict):
        """(label, part before, where it ends, part behind, where it begins) of every exact seed that has enough
        of the small pieces near their places; ``seen`` keeps the names of a text for the next notice."""
        for seed, previous, left, right in self.seeds:
            if seed and seed not in flat:
                continue
            pieces = [*left.pieces, *right.pieces]
            need = len(pieces) - self.edits
            if need > 0 and sum(x in flat for _, x in pieces) < need:
                continue
            if self.pattern is None:
                found = [(at, at + len(seed), self.label) for at in occurrences(flat, seed) if not previous or flat[max(0, at - len(previous)) : at] != previous]
            else:
                if self.pattern not in seen:
                    seen[self.pattern] = [(m.start(), m.end(), self.names[m.group()]) for m in self.pattern.finditer(flat)]
                # the spaces beside a name belong to it
                x, y = bool(left.raw), bool(right.raw)
                found = [(a - x, b + y, label) for a, b, label in seen[self.pattern]]
            if need > 0 and len(found) > 64:
                ends, begins = (np.array([x[k] for x in found]) for k in (0, 1))
                near = left.all_near(flat, ends - len(left.raw)) + right.all_near(flat, begins)
                found = [found[k] for k in np.flatnonzero(near >= need).tolist()]
            elif need > 0:
                found = [x for x in found if left.near(flat, x[0] - len(left.raw)) + right.near(flat, x[1]) >= need]
            for a, b, label in found:
                yield label, left, a, right, b


def compiled(notices=NOTICES) -> list[Notice]:
    return [Notice(*x) for x in notices]


def occurrences(text: bytes, what: bytes):
    at = text.find(what)
    while at >= 0:
        yield at
        at = text.find(what, at + 1)


def _near(flat: bytes, notice: Notice, left: Part, a: int, right: Part, b: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the matches with ``left`` just before ``a`` and ``right`` just behind ``b``, from word to word."""
    k, p, q = notice.edits, len(left.raw), len(right.raw)
    starts = [(x, e) for x in range(max(0, a - p - k), min(a, a - p + k) + 1) if (x == 0 or flat[x - 1] == 32) and (e := left.distance(flat[x:a])) is not None]
    if not starts:
        return []
    n, room = len(flat), k - min(e for _, e in starts)
    ends = [(x, e) for x in range(max(b, b + q - room), min(n, b + q + room) + 1) if (x == n or flat[x] == 32) and (e := right.distance(flat[b:x])) is not None]
    return [(x, y, e + f) for x, e in starts for y, f in ends if e + f <= k]


def places(flat: bytes, notice: Notice, seen: dict | None = None) -> dict[tuple[int, int, str], int]:
    """Every (start, end, label) of whole words within the notice's bound, with its fewest edits."""
    out: dict[tuple[int, int, str], int] = {}
    for label, left, a, right, b in notice.anchors(flat, {} if seen is None else seen):
        for start, end, edits in _near(flat, notice, left, a, right, b):
            key = (start, end, label)
            if edits < out.get(key, notice.edits + 1):
                out[key] = edits
    return out


def matches(flat: bytes, notice: Notice, seen: dict | None = None) -> list[tuple[int, int, int, str]]:
    """(start, end, edits, label): places by fewest edits, then start, end and label, without those that overlap one taken before."""
    begins: list[int] = []
    taken: dict[int, tuple[int, int, int, str]] = {}
    for edits, start, end, label in sorted((e, a, b, label) for (a, b, label), e in places(flat, notice, seen).items()):
        at = bisect_left(begins, end)
        if not at or taken[begins[at - 1]][1] <= start:
            begins.insert(at, start)
            taken[start] = (start, end, edits, label)
    return [taken[x] for x in begins]


def scan(text: bytes, notices: list[Notice]) -> dict:
    """Base places and fuzzy matches of one text.

    Spans are (label, first word, end word, edits) with words counted from 0 and the end exclusive.
    """
    flat = b" ".join(text.translate(WORDS).split())
    padded = b" " + flat + b" "
    spaces = np.flatnonzero(np.frombuffer(padded, np.uint8) == 32)
    n_words = len(spaces) - 1 if flat else 0
    word = lambda places: np.searchsorted(spaces, places).tolist()  # the number of the word after a space
    base, fuzzy = [], []
    for phrase, label in PHRASES.items():
        for first in word(np.fromiter(occurrences(padded, b" " + phrase.encode() + b" "), np.int64)):
            base.append((label, first, first + phrase.count(" ") + 1, 0))
    seen: dict = {}
    for notice in notices:
        found = matches(flat, notice, seen)
        # byte p of the flat text is byte p + 1 of the padded one
        for (a, b, edits, label), first in zip(found, word(np.array([x[0] for x in found], np.int64)), strict=True):
            fuzzy.append((label, first, first + flat.count(b" ", a, b) + 1, edits, 1 - edits / (b - a)))
    starts = [x[1] for x in base]
    return {
        "n_words": n_words,
        "n_base": len(base),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted({x[0] for x in base})),
        "labels": ",".join(sorted({x[0] for x in [*base, *fuzzy]})),
        "score": 1.0 if base else max((x[4] for x in fuzzy), default=0.0),
        "notices": [{"label": x[0], "first_word": x[1], "end_word": x[2], "edits": x[3]} for x in sorted(fuzzy)],
    }


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<label:string,first_word:long,end_word:long,edits:long>>"


def license_scan(docs: DataFrame, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the base counts, the labels with the fuzzy ones, score and spans.

    A map over the documents without any shuffle. Null texts count as empty: no words, null first and
    last word, empty labels, score 0. Repeated rows are kept as they are. The score is 1 with
    any base place, else the best share of unedited letters of a notice. A notice that names no known license
    has no label; names of a list stand exactly. Every place of whole words within a notice's bound is
    reported, or overlaps a reported one of that notice with as few edits or fewer.
    """

    def make():
        ready = compiled(notices)
        kinds = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int64())]))
        types = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "notices": kinds}

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [scan(x, ready) for x in utf8(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in types.items())], names=["doc_id", *types])

        return f

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(arrow_map, per_batch(make), f"doc_id long, {RESULT}")

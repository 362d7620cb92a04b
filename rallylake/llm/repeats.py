"""Repeated byte strings: a run-length index over the places where repeats can be.

1. Anchors. Each window of ``length`` bytes selects the least of its hashed ``gram``-byte substrings
   (leftmost on ties). Equal windows select the same one, so repeats meet at equal anchors, wherever
   they stand. Consecutive windows with one anchor form a context of fewer than two lengths.
2. Contexts that occur twice whole are repeats in every window. They are told equal by two 64-bit hashes,
   that of the anchor and that of the context, and one of each goes on. What is left are distinct
   contexts around one anchor: edges of passages and near copies.
3. Run-length index. The distinct contexts of some anchors form a text whose Burrows-Wheeler
   transform is cut in runs. Longest matches with the neighbours in suffix order are sampled at run
   ends only; inside a run a match is one shorter than that of the position before, so matching
   statistics stream over the text from the samples. Matches of at least ``length`` are marked.

Where very many distinct contexts share an anchor, their windows select anchors anew by another hash,
which deals them to small groups in proportion to their number; this repeats a few times. Only what is
then still together is dealt to pairs of blocks, so that each index is bounded and every two contexts
meet in some index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallylake.llm.common import arrow_map, materialize, merged, per_batch, utf8

LENGTH = 200
GRAM = 40
#: Bytes whose windows are hashed at once, and bytes of contexts that one index takes at once.
SLICE = 1 << 20
INDEX = 1 << 20
#: Contexts of one anchor that meet in one index before they are dealt on, and how often anchors are chosen anew.
BLOCK = 4096
LEVELS = 4
#: A context is hot if it has more than one in so many of all rows, so hot ones are at most so many.
HOT = 2048

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_TABLE = np.random.Generator(np.random.PCG64(2024)).integers(0, 1 << 64, 256, np.uint64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2 ** 64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, SLICE + (1 << 17))
        with np.errstate(over="ignore"):
            _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM, level: int = 0) -> tuple[np.ndarray, ...]:
    """For texts raw[begin:end], each of at least ``length`` bytes: per context its text's number, the
    place of its first window in ``raw``, its number of windows, its anchor's hash and its own hash. Each
    ``level`` orders the substrings by another hash."""
    up, down = powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[raw] * up[: len(raw)], dtype=np.uint64)])
        h = mixed((sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1])
        if level:
            h = mixed(h + np.uint64(_BASE * 2 * level & _MASK))
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    low = sliding_min((h >> bits << bits) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    anchor = (low & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    which = np.repeat(np.arange(len(begins)), ends - begins - length + 1)
    start = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(begins, ends, strict=True)])
    at = anchor[start]
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (which[1:] != which[:-1])]))
    count = np.diff(np.append(head, len(at)))
    lo = start[head]
    hi = lo + count - 1 + length
    with np.errstate(over="ignore"):
        own = mixed((sums[hi] - sums[lo]) * down[lo]) + count.astype(np.uint64)
    return which[head], lo, count, h[at[head]].view(np.int64), own.view(np.int64)


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text number, offset, bytes) in lists of about SLICE bytes; a longer text comes in pieces that
    overlap so that each window is in exactly one."""
    out, size = [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), SLICE):
            piece = text[at : at + SLICE + length - 1]
            if len(piece) < length:
                continue
            out.append((k, at, piece))
            size += len(piece)
            if size >= SLICE:
                yield out
                out, size = [], 0
    if out:
        yield out


def _found(texts: list[bytes], length: int, gram: int, level: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, offset of the first window, number of windows, anchor's hash, own hash) of contexts."""
    for pieces in _pieces(texts, length):
        ends = np.cumsum([len(x[2]) for x in pieces])
        begins = ends - [len(x[2]) for x in pieces]
        which, lo, count, h, c = anchors(np.frombuffer(b"".join(x[2] for x in pieces), np.uint8), begins, ends, length, gram, level)
        yield np.array([x[0] for x in pieces])[which], lo - begins[which] + np.array([x[1] for x in pieces])[which], count, h, c


ANCHORS = "did long, key long, h long, c long, p long"


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                did, key = (part.column(k).to_numpy() for k in (0, 1))
                for text, lo, count, h, c in _found(utf8(part.column(2)), length, gram, 0):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (did[text], key[text], h, c, lo << 10 | count)], names=["did", "key", "h", "c", "p"])

    return run


def _anchored_again(length: int, gram: int, level: int):
    """Anchor rows of the windows of given contexts, by the hash of ``level``; groups stay within their old ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for did, key, text, need in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                for at in range(0, len(need), 4096):
                    part = need[at : at + 4096]
                    lo0 = np.array([x["p"] >> 10 for x in part])
                    old = np.array([x["h"] for x in part], np.int64).view(np.uint64)
                    for k, lo, count, h, c in _found([text[x["p"] >> 10 : (x["p"] >> 10) + (x["p"] & 1023) - 1 + length] for x in part], length, gram, level):
                        with np.errstate(over="ignore"):
                            h = mixed(h.view(np.uint64) + old[k] * np.uint64(_BASE)).view(np.int64)
                        n = len(k)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, did)), pa.array(np.full(n, key)), pa.array(h), pa.array(c), pa.array((lo0[k] + lo) << 10 | count)], names=["did", "key", "h", "c", "p"])

    return run


class RunLengthIndex:
    """Index of distinct short strings; ``longest[p]`` is the longest match of the suffix at p of the
    joined text with any other suffix, not crossing the strings' ends. Samples of matches shorter than
    ``least`` are left out, so shorter matches may show as less."""

    STEP = 7

    def __init__(self, strings: list[bytes], least: int = 0):
        sizes = np.array([len(x) for x in strings])
        self.begins = np.cumsum(sizes + 1) - sizes - 1
        text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int16) + np.int16(1)
        ends = self.begins + sizes
        text[ends] = 0
        n = len(text)
        here, end = np.arange(n, dtype=np.int32), np.repeat(ends, sizes + 1).astype(np.int32)
        order, ranks = self._suffix_order(text, here, end)
        # Burrows-Wheeler transform; a string's first suffix is preceded by a mark of its own
        before = text[order - 1].astype(np.int32)
        before[before == 0] = -1 - order[before == 0]
        cut = np.concatenate([[True], before[1:] != before[:-1], [True]])
        heads, tails = np.flatnonzero(cut[:-1]), np.flatnonzero(cut[1:])
        del before, cut
        self.runs = len(heads)
        self.longest = np.zeros(n, np.int32)
        sieve = [rank for step, rank in ranks if step <= least][-1:]
        for at, other in ((heads[1:], heads[1:] - 1), (tails[:-1], tails[:-1] + 1)):
            # samples at run ends; between them a match is one shorter at each step
            for rank in sieve:
                fine = rank[order[at]] == rank[order[other]]
                at, other = at[fine], other[fine]
            value = np.full(n, -1, np.int32)
            value[order[at]] = self._common(order[at], order[other], text, ranks) + order[at]
            np.maximum(self.longest, np.maximum.accumulate(value) - here, out=self.longest)
        self.longest = np.minimum(self.longest, end - here)

    def _suffix_order(self, text: np.ndarray, here: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Suffix array by doubling, and the ranks by prefixes of 7, 14, 28 ... symbols."""
        n = len(text)
        pad = np.concatenate([text, np.zeros(self.STEP, np.int16)])
        key = np.zeros(n, np.int64)
        for k in range(self.STEP):
            key <<= 9
            key |= np.where(here + k < end, pad[k : n + k], 0)
        step, ranks = self.STEP, []
        while True:
            order = np.argsort(key).astype(np.int32)
            key = key[order]
            # a prefix that meets its string's end is like no other
            short = (here + step > end)[order]
            new = np.ones(n, bool)
            new[1:] = (key[1:] != key[:-1]) | short[1:] | short[:-1]
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
            ranks.append((step, rank))
            if new.all():
                return order, ranks
            key = (rank + np.int64(1)) * (n + 1)
            key += np.where(here + step < end, rank[np.minimum(here + step, n - 1)] + 1, 0)
            step *= 2

    def _common(self, p: np.ndarray, q: np.ndarray, text: np.ndarray, ranks: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Lengths of the common prefixes of the suffixes at p and at q."""
        n, out = len(text), np.zeros(len(p), np.int32)
        for step, rank in reversed(ranks):
            out += step * (rank[np.minimum(p + out, n - 1)] == rank[np.minimum(q + out, n - 1)])
        live = np.ones(len(p), bool)
        for _ in range(self.STEP - 1):
            a, b = text[np.minimum(p + out, n - 1)], text[np.minimum(q + out, n - 1)]
            live &= (a == b) & (a > 0)
            out += live
        return out


def marked(contexts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each context the spans covered by strings of ``length`` bytes that stand elsewhere too."""
    index = RunLengthIndex(contexts, length)
    hit = np.flatnonzero(index.longest >= length)
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    if len(hit):
        which = np.searchsorted(index.begins, hit, "right") - 1
        first = np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(which) > 0)])
        for a, b in zip(np.flatnonzero(first), np.append(np.flatnonzero(first)[1:], len(hit)), strict=True):
            k = which[a]
            out[k].append((int(hit[a] - index.begins[k]), int(hit[b - 1] - index.begins[k]) + length))
    return out


def _index_rows(length: int):
    """Rows sorted by (h, pair): whole groups, of about INDEX bytes together, go to one index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(rows):
            spans = marked([r[6] for r in rows], length)
            out = [(r[2], r[3], (r[4] + a) << 31 | (r[4] + b)) for r, s in zip(rows, spans, strict=True) if r[5] for a, b in s]
            cols = zip(*out, strict=True) if out else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["did", "key", "span"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # two pairs of blocks of one group may hold the same context, so they never share an index
                if held and row[:2] != held[-1][:2] and (size >= INDEX or row[0] == held[-1][0]):
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield flush(held)

    return run


def _contexts(length: int):
    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for did, key, text, need in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                for x in need:
                    lo, count = x["p"] >> 10, x["p"] & 1023
                    rows.append((x["h"], x["d"], x["c"], did, key, lo, x["n"] == 1, text[lo : lo + count - 1 + length]))
            kinds = [pa.int64()] * 6 + [pa.bool_(), pa.binary()]
            cols = zip(*rows, strict=True) if rows else [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["h", "d", "c", "did", "key", "lo", "once", "context"])

        return f

    return make


def _removed(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for text, packed in zip(utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True):
        spans, kept, at = merged((x >> 31, x & (1 << 31) - 1) for x in packed or ()), hashlib.sha256(), 0
        for a, b in spans:
            kept.update(text[at:a])
            at = b
        kept.update(text[at:])
        rows.append((len(text), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
    kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    cols = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([batch.column(4), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def _groups(found: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of anchor rows: the spans of contexts that occur whole more than once; the distinct contexts whose
    anchor recurs, each with its number and one place; the anchors with several of them, and how many."""
    # written first: both sides of the join are then plain exchanges, which Spark splits if a key is hot
    twice = materialize(found.groupBy("h").count().where("count > 1").select("h"), "repeated-hashes")
    again = materialize(found.join(twice, "h"), "repeated-anchors")
    distinct = materialize(again.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("did", "key", "p")).alias("one")), "contexts")
    span = (F.shiftleft(F.shiftright("p", 10), 31) + F.shiftright("p", 10) + F.col("p").bitwiseAND(F.lit(1023)) + F.lit(length - 1)).alias("span")
    copies = distinct.where("n > 1").select("h", "c", "n")
    # a context with a large share of all rows is one key; there are few of these, whatever the table
    most = max(1, again.count() // HOT)
    hot = F.broadcast(copies.where(F.col("n") > most).select("h", "c"))
    rest = again.join(hot, ["h", "c"], "left_anti").join(copies.where(F.col("n") <= most).select("h", "c"), ["h", "c"])
    whole = again.join(hot, ["h", "c"]).unionByName(rest).select("did", "key", span)
    return whole, distinct, materialize(distinct.groupBy("h").agg(F.count("*").alias("d")).where("d > 1"), "groups")


def _wanted(keyed: DataFrame, distinct: DataFrame, groups: DataFrame) -> DataFrame:
    """Texts with one place of each distinct context of some groups."""
    need = distinct.join(groups, "h").select("one.did", "one.key", F.struct("h", "d", "c", "n", "one.p").alias("x")).groupBy("did", "key").agg(F.collect_list("x").alias("need"))
    need = materialize(need, "places")  # its size is known then: texts move only if places of very many are wanted
    return keyed.join(need, ["did", "key"]).select("did", "key", "text", "need", "doc_id")


def _edges(keyed: DataFrame, distinct: DataFrame, groups: DataFrame, length: int) -> DataFrame:
    """Spans that the indexes over the groups' distinct contexts mark."""
    contexts = _wanted(keyed, distinct, groups).transform(arrow_map, per_batch(_contexts(length)), "h long, d long, c long, did long, key long, lo long, once boolean, context binary")
    blocks = F.ceil(F.col("d") / BLOCK).cast("long")
    own = F.pmod("c", blocks)
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda x: F.least(x, own) * blocks + F.greatest(x, own))).alias("pair")
    dealt = contexts.select("h", pair, "did", "key", "lo", "once", "context").repartition("h", "pair").sortWithinPartitions("h", "pair")
    return dealt.transform(arrow_map, _index_rows(length), "did long, key long, span long")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (of removed bytes).

    A byte goes if some string of ``length`` bytes that covers it also starts anywhere else, in any
    text; all is judged on the input. ``length`` must exceed ``gram`` by fewer than 1,000. Null texts
    count as empty; texts shorter than ``length`` keep all; repeated rows of at least ``length`` bytes
    lose all, like any copies; an empty table gives no rows. Null ids are allowed.
    """
    if not 0 < length - gram < 1000:
        raise ValueError("length must exceed gram by fewer than 1,000")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = keyed.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("did"), F.xxhash64("text").alias("key"))
    found = keyed.where(F.octet_length("text") >= length).select("did", "key", "text").transform(arrow_map, _anchor_rows(length, gram), ANCHORS)
    marks = None
    for level in range(LEVELS):
        whole, distinct, many = _groups(materialize(found, "anchors"), length)
        marks = whole if marks is None else marks.union(whole)
        large = many.where(F.col("d") > BLOCK)
        if level == LEVELS - 1 or large.isEmpty():
            break
        marks = marks.union(_edges(keyed, distinct, many.where(F.col("d") <= BLOCK), length))
        found = _wanted(keyed, distinct, large).transform(arrow_map, _anchored_again(length, gram, level + 1), ANCHORS)
    marks = marks.union(_edges(keyed, distinct, many, length))
    marks = marks.groupBy("did", "key").agg(F.collect_set("span").alias("marks"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    return keyed.join(marks, ["did", "key"], "left").select("did", "key", "text", "marks", "doc_id").transform(arrow_map, per_batch(lambda: _removed), out)

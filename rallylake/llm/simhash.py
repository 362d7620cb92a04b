"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits link at up to 3 differing bits. Bit i gets a vector of four bits, and the
table of a non-zero four-bit vector v keeps the bits whose vector has an odd product with v. Up to
three differing bits span at most three dimensions, so some v is orthogonal to all of them: that
table keeps none of the differing bits, and the pair collides there for certain. 15 tables cover
every pair; each keeps 32 of the 64 bits.

Equal fingerprints are one node. A bucket of more than ``hot`` nodes is dealt again by covering its
free bits (48 bits kept, then 56: at most 256 nodes), so no task gathers an unbounded bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallylake.llm.common import arrow_map, components, materialize, per_batch, roots, utf8

RADIUS = 3
SEED = 42


def covering_masks(bits: list[int]) -> list[int]:
    """15 masks over the given bit positions such that any 3 positions are all absent from one of them."""
    out = []
    for v in range(1, 2 ** (RADIUS + 1)):
        out.append(sum(1 << bit for k, bit in enumerate(bits) if bin((k % 15 + 1 if len(bits) >= 15 else k + 1) & v).count("1") % 2))
    return out


def mask_levels() -> list[list[int]]:
    """Masks by level: 15 keep about half of the bits, 15 * 15 about three quarters, 15 ** 3 the more."""
    levels = [covering_masks(list(range(64)))]
    for _ in range(2):
        levels.append([m | x for m in levels[-1] for x in covering_masks([b for b in range(64) if not m >> b & 1])])
    return levels


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 12):
        bits = np.unpackbits(hashes[at : at + (1 << 12), None].view(np.uint8), axis=1, bitorder="little")
        # bytes hold the sums of 255 rows
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The SimHash of one text as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    return fingerprint_of(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long). Null and empty texts, and texts of white space only, have fingerprint 0."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(x, shingle) for x in utf8(batch.column(1))], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

        return f

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(arrow_map, per_batch(make), "doc_id long, fp long")


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (t, key): for each bucket a spanning forest of the nodes within the radius."""
    held: list[np.ndarray] | None = None

    def forest(t, key, fp, node):
        ids, at = np.unique(node, return_inverse=True)
        label, todo, size = np.arange(len(ids)), [], 0
        live, step = np.arange(len(t)), 1

        def join():
            nonlocal label, todo, size
            if todo:
                a, b = (at[np.concatenate(x)] for x in zip(*todo, strict=True))
                label = roots(len(ids), np.concatenate([a, np.arange(len(ids))]), np.concatenate([b, label]))
                todo, size = [], 0

        while True:
            live = live[live + step < len(t)]
            live = live[(t[live] == t[live + step]) & (key[live] == key[live + step])]
            if not len(live):
                break
            near = live[np.bitwise_count((fp[live] ^ fp[live + step]).view(np.uint64)) <= RADIUS]
            todo.append((near, near + step))
            size += len(near)
            if size > 1 << 20:
                join()
            step += 1
        join()
        own = label != np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[label[own]])], names=["a", "b"])

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        t, key = cols[0], cols[1]
        if not len(t):
            continue
        cut = int(np.flatnonzero((t != t[-1]) | (key != key[-1]))[-1]) + 1 if (t[0], key[0]) != (t[-1], key[-1]) else 0
        held = [c[cut:] for c in cols]
        if cut:
            yield forest(*(c[:cut] for c in cols))
    if held is not None:
        yield forest(*held)


def _buckets(nodes: DataFrame, level: int) -> DataFrame:
    """nodes: (fp, node) at level 0, else (fp, node, t) with the table of the level above."""
    masks = mask_levels()[level]
    literal = F.array(*[F.lit(_signed(m)) for m in masks])
    if level == 0:
        exploded = nodes.select("fp", "node", F.posexplode(literal).alias("t", "m"))
    else:
        per = F.array(*[F.array(*[F.lit(_signed(m)) for m in masks[k : k + 15]]) for k in range(0, len(masks), 15)])
        exploded = nodes.select("fp", "node", "t", F.posexplode(F.element_at(per, F.col("t") + 1)).alias("s", "m")).withColumn("t", F.col("t") * 15 + F.col("s"))
    return exploded.select(F.col("t").cast("int").alias("t"), F.col("m").bitwiseAND(F.col("fp")).alias("key"), "fp", "node")


def links(nodes: DataFrame, hot: int = 4096) -> DataFrame:
    """(a, b): edges that connect exactly the nodes that chains of links within the radius connect.

    ``nodes`` has distinct fingerprints (fp long, node long). A bucket emits a spanning forest, never all its pairs.
    """
    out = None
    for level in range(3):
        rows = _buckets(nodes, level)
        again = None
        if level < 2:
            full = materialize(rows.groupBy("t", "key").count().where(F.col("count") > hot).select("t", "key"), "hot")
            if full.limit(1).count():
                again = rows.join(full, ["t", "key"], "left_semi").select("fp", "node", "t")
                rows = rows.join(full, ["t", "key"], "left_anti")
        rows = rows.repartition("t", "key").sortWithinPartitions("t", "key")
        found = rows.select("t", "key", "fp", "node").transform(arrow_map, _bucket_links, "a long, b long")
        out = found if out is None else out.union(found)
        if again is None:
            return out
        nodes = materialize(again, "again")
    return out


def chained(fps: DataFrame, hot: int = 4096) -> DataFrame:
    """(fp, component): every distinct fingerprint and the smallest that chains of links connect it with."""
    nodes = materialize(fps.select("fp").distinct(), "nodes")
    # written, so that a task never runs two Python workers at once, whose memory adds up
    found = components(materialize(links(nodes.withColumn("node", F.col("fp")), hot), "bucket-links"))
    return materialize(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("component")), "chained")


def near_duplicates(docs: DataFrame, shingle: int = 3, hot: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Rows with equal text share a fingerprint and so a component. Null texts count as empty. A row
    whose doc_id is null takes part with its fingerprint and never names a component unless all of
    the component's ids are null. Rows of one id link by their texts alone, never by the id. Repeated
    rows are kept. An empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = chained(fps, hot).join(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp")
    names = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = nodes.join(names, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""Near-duplicate texts at a similarity of five-word shingles: SimHash and minima propose links, the texts decide.

Texts of the same words are one class, and one row stands for it. Two sources propose pairs of classes: the
covering tables of :mod:`rallylake.llm.simhash`, which find fingerprints within 3 bits for certain, and, as pairs
at a similarity of about 0.8 mostly differ in more bits, bands of minima of the hashed shingles: with
8 bands of 4, a pair at 0.8 shares a band with probability 0.985. Each proposed pair is then compared by its exact
shingle sets, and only those at the threshold or above are links.

A bucket first proposes a star: each member with the least one, and large buckets are dealt into parts, whose least
members meet again. What that does not bring together is settled exactly: of every bucket, and of every chain of
near fingerprints, with members in more than one component, all pairs across components are compared, in
tiles of two blocks of members, so that a task holds a tile and no bucket. So no pair that a source proposes is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallylake.llm.common import arrow_map, components, materialize, per_batch, release, utf8
from rallylake.llm.simhash import RADIUS, SEED, fingerprint_of, links

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 8, 4


def shingles(words: list[bytes], n: int = SHINGLE) -> set:
    """The n-word shingles of a text; of fewer words the whole sequence, of none nothing."""
    return set(zip(*(words[k:] for k in range(n)))) if len(words) >= n else {tuple(words)} if words else set()


def similarity(a: set, b: set) -> float:
    """Jaccard similarity; two texts without words are the same."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(digest of the words, hashes of the three-word shingles, hashes of the five-word ones), repeats included."""
    words = text.lower().split()
    whole = xxhash.xxh3_128_digest(b" ".join(words))
    if len(words) < 3:
        grams = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    else:
        grams = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[k:] for k in range(3)))), repeat(SEED)), np.uint64)
    # five words are the first three and the last three of them
    five = _mixed(grams[:-2] * np.uint64(0x9E3779B97F4A7C15) + grams[2:]) if len(words) >= SHINGLE else np.frombuffer(whole[:8], np.uint64)
    return whole, grams, five


def signature(text: bytes, bands: int = BANDS, rows: int = ROWS) -> tuple[bytes, int, np.ndarray]:
    """(digest of the words, SimHash of three-word shingles, keys of the bands), the numbers unsigned."""
    whole, grams, five = _hashed(text)
    keys = np.empty(bands * rows, np.uint64)
    for k in range(bands * rows):
        keys[k] = _mixed(five ^ np.uint64((k + 1) * 0xD1342543DE82EF95 % (1 << 64))).min()
    out = np.zeros(bands, np.uint64)
    for r in range(rows):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + keys.reshape(bands, rows)[:, r])
    return whole, fingerprint_of(grams), out


def _signatures(texts: DataFrame) -> DataFrame:
    """(row, same, fp, keys) of (row, text)."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [signature(x) for x in utf8(batch.column(1))]
            n = len(made)
            fp = np.array([m[1] for m in made], np.uint64).view(np.int64)
            keys = np.concatenate([np.zeros(0, np.uint64), *(m[2] for m in made)]).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * BANDS, keys)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.binary()), pa.array(fp), lists], names=["row", "same", "fp", "keys"])

        return f

    return texts.transform(arrow_map, per_batch(make), "row long, same binary, fp long, keys array<bigint>")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, key, part, row) in that order: each row with the first of its bucket, which may have come in an earlier batch."""
    last, first = None, 0
    for batch in batches:
        band, key, part, row = (c.to_numpy() for c in batch.columns)
        if not len(row):
            continue
        new = np.concatenate([[(band[0], key[0], part[0]) != last], (band[1:] != band[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        at = np.maximum.accumulate(np.where(new, np.arange(len(row)), -1))
        least = np.where(at >= 0, row[np.maximum(at, 0)], first)
        last, first = (band[-1], key[-1], part[-1]), int(least[-1])
        yield pa.RecordBatch.from_arrays([pa.array(least[~new]), pa.array(row[~new])], names=["a", "b"])


def _similar(fives: list[np.ndarray], fp: np.ndarray, component: np.ndarray, low: np.ndarray, across: bool, radius: int | None, threshold: float) -> Iterator[tuple[int, int]]:
    """Places of the pairs whose sets of hashes have about the similarity, but for those that surer pairs and ``component`` connect already.
    ``across``: only pairs of a member of ``low`` with another; ``radius``: only pairs of fingerprints within it."""
    sizes = np.array([len(x) for x in fives])
    ids, at = np.unique(np.concatenate(fives), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    label, mark = component.copy(), np.zeros(len(ids), np.uint8)
    for x in np.flatnonzero(low) if across else range(len(fives)):
        other = (label != label[x]) & (np.minimum(sizes, sizes[x]) >= threshold * np.maximum(sizes, sizes[x]))
        if across:
            other &= ~low
        else:
            other[: x + 1] = False
        if radius is not None:
            other &= np.bitwise_count((fp ^ fp[x]).view(np.uint64)) <= radius
        near = np.flatnonzero(other)
        if not len(near):
            continue
        own = at[starts[x] : starts[x] + sizes[x]]
        mark[own] = 1
        # no set is empty, so each has a sum of its own
        both = np.add.reduceat(mark[at], starts, dtype=np.int64)[near] if 8 * len(near) > len(fives) else np.array([np.count_nonzero(mark[at[starts[y] : starts[y] + sizes[y]]]) for y in near])
        mark[own] = 0
        # of hashes: what is close to the threshold is told to the exact sets, and connects nothing here
        bound = threshold * (sizes[x] + sizes[near] - both)
        for y, sure in zip(near[both >= 0.99 * bound], (both >= 1.01 * bound)[both >= 0.99 * bound], strict=True):
            if label[y] != label[x]:
                yield x, y
                if sure:
                    label[label == label[y]] = label[x]


def _tiles(threshold: float):
    """Rows (band, key, lo, hi, block, component, row, fp, text), a tile after the other: pairs of the tile that are about similar by the
    hashes of their shingles. In a tile of two blocks only members of different blocks are compared, those of one block have a tile of their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def compared() -> pa.RecordBatch:
            a, b = [], []
            if len(held) > 1:
                block, component, row, fp = (np.array(x, np.int64) for x in zip(*(h[:4] for h in held), strict=True))
                for x, y in _similar([h[4] for h in held], fp, component, block == last[2], last[2] != last[3], RADIUS if last[0] < 0 else None, threshold):
                    a.append(min(row[x], row[y]))
                    b.append(max(row[x], row[y]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for *tile, block, component, row, fp, text in zip(*(batch.column(k).to_pylist() for k in range(8)), utf8(batch.column(8)), strict=True):
                if tile != last:
                    if last is not None:
                        yield compared()
                    last, held = tile, []
                # a text without words is like no other
                if text.strip():
                    held.append((block, component, row, fp, np.unique(_hashed(text)[2])))
            pa.default_memory_pool().release_unused()
        if last is not None:
            yield compared()

    return run


def _across(groups: DataFrame, found: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """(a, b): similar pairs of rows that share a group (band, key) and are in different components of ``found``. Of groups
    (band, key, row, fp) with more than one component every pair is in one tile of two blocks of about ``size`` members."""
    placed = materialize(groups.join(found.withColumnRenamed("node", "row"), "row", "left").select("band", "key", "row", "fp", F.coalesce("component", "row").alias("component")), "placed")
    several = placed.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
    blocks = several.select("band", "key", F.ceil(F.col("n") / F.lit(size)).cast("int").alias("blocks"))
    member = placed.join(blocks, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    dealt = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = dealt.select("band", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "component", "row", "fp")
    tile = ["band", "key", "lo", "hi"]
    rows = texts.join(tiles.hint("merge"), "row").select(*tile, "block", "component", "row", "fp", "text").repartition(*tile).sortWithinPartitions(*tile, "row")
    # written, so that a task never runs two Python workers at once
    out = materialize(rows.transform(arrow_map, _tiles(threshold), "a long, b long").distinct(), "across")
    release(placed)
    return out


def _dealt(points: DataFrame, hot: int) -> DataFrame:
    """``points`` (band, key, ...) of buckets with two rows or more, with ``part``: large buckets are dealt by row."""
    sizes = points.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / F.lit(hot))
    return points.join(sizes, ["band", "key"]).withColumn("part", F.pmod(F.xxhash64("row"), parts).cast("int")).drop("n")


def _proposed(points: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """Stars of all buckets, and the dealt points, written."""
    dealt = materialize(_dealt(points, hot), "buckets")
    order = ["band", "key", "part", "row"]
    stars = dealt.select(order).repartition("band", "key", "part").sortWithinPartitions(order).transform(arrow_map, _stars, "a long, b long")
    # the least rows of the parts of a large bucket meet here
    heads = dealt.groupBy("band", "key", "part").agg(F.min("row").alias("b"))
    tops = heads.groupBy("band", "key").agg(F.min("b").alias("a"))
    return stars.union(heads.join(tops, ["band", "key"]).where("a <> b").select("a", "b")), dealt


def _verify(threshold: float):
    """Rows (a, salt, b, text) in that order, the text of ``a`` itself first (b null): the pairs that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, set()
        for batch in batches:
            a, b = [], []
            for first, salt, second, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), utf8(batch.column(3)), strict=True):
                made = shingles(text.lower().split())
                if second is None:
                    at, own = (first, salt), made
                elif at != (first, salt):
                    raise ValueError("a pair without its first text")
                # the sets' sizes bound the similarity
                elif min(len(own), len(made)) >= threshold * max(len(own), len(made)) and similarity(own, made) >= threshold:
                    a.append(first)
                    b.append(second)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            pa.default_memory_pool().release_unused()

    return run


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, hot: int = 4096) -> DataFrame:
    """The pairs (a, b) of rows whose texts (row, text) have the similarity; a row with many pairs is dealt into salts."""
    pairs = materialize(pairs.where("a <> b").distinct(), "pairs")
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(hot)).cast("int").alias("salts"))
    salted = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
    firsts = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), F.col("a").alias("row"))
    # a shuffle at every size; a small side would be broadcast, a large one not
    asked = firsts.union(salted.select("a", "salt", "b", F.col("b").alias("row"))).hint("merge")
    rows = texts.join(asked, "row").select("a", "salt", "b", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return materialize(rows.transform(arrow_map, _verify(threshold), "a long, b long"), "links")


def classes(texts: DataFrame, threshold: float = THRESHOLD, hot: int = 4096, tile: int = 256) -> DataFrame:
    """(row, component) for every row of ``texts`` (row long, text string): the least row that chains of links reach."""
    signed = materialize(_signatures(texts), "signatures")
    same = materialize(signed.groupBy("same").agg(F.min("row").alias("rep")), "classes")
    reps = materialize(signed.join(same, "same").where("row = rep").select("row", "fp", "keys"), "representatives")
    some = texts.join(reps.select("row").hint("merge"), "row", "left_semi")
    points = reps.select(F.posexplode("keys").alias("band", "key"), "row", "fp")
    stars, dealt = _proposed(points, hot)
    # texts of one fingerprint, and fingerprints within the radius
    heads = materialize(reps.groupBy("fp").agg(F.min("row").alias("node")), "fingerprints")
    alike = reps.join(heads, "fp").where("row <> node").select(F.col("node").alias("a"), F.col("row").alias("b"))
    near = materialize(links(heads, hot).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "near")
    first = verified(stars.union(alike).union(near), some, threshold, hot)
    found = materialize(components(first), "first-components")
    # fingerprints within the radius are in one chain, whose least node names it
    chains = heads.join(components(near), "node", "left").select("fp", F.coalesce("component", "node").alias("key"))
    chained = reps.join(chains, "fp").select(F.lit(-1).alias("band"), "key", "row", "fp")
    groups = dealt.select("band", "key", "row", "fp").union(chained)
    every = first.union(verified(_across(groups, found, some, threshold, tile), some, threshold, hot))
    joined = materialize(components(every).withColumnRenamed("node", "rep"), "components")
    release(dealt)
    return signed.join(same, "same").join(joined, "rep", "left").select("row", F.coalesce("component", "rep").alias("component"))


def distinct_rows(docs: DataFrame, threshold: float = THRESHOLD, hot: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id, a null id last; of rows of one id the
    one of the least digest stays.

    Texts are linked where their sets of five-word shingles (words as white space splits them, A-Z lower-cased) have a Jaccard
    similarity of ``threshold`` or more; each link is verified, none is a guess. Texts without words are one class. Rows that share an id
    but no text are different documents. An empty table gives no rows.
    """
    # the caller's columns travel as one, so that none of their names can clash
    rows = materialize(docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    found = classes(rows.select("row", F.col("doc").getField(text_col).cast("string").alias("text")), threshold, hot)
    named = F.col("doc").getField(id_col)
    order = F.struct(named.isNull().alias("unnamed"), named.alias("id"), F.sha1(F.to_json("doc")).alias("sha"), F.col("row").alias("row"))
    placed = found.join(rows.select("row", order.alias("place")), "row")
    chosen = materialize(placed.groupBy("component").agg(F.min("place").alias("place")).select(F.col("place.row").alias("row")), "chosen")
    return rows.join(chosen.hint("merge"), "row", "left_semi").select("doc.*")

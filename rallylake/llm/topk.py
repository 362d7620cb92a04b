"""Exact top-k inner products with multi-resolution segment statistics.

Distances and inner products order alike once the norms are known: ``2 <q, c> = |q|^2 + |c|^2 -
d(q, c)^2``. The distance has a lower bound from segment means and deviations, ``d^2 >= sum over
segments of n * ((mean_q - mean_c)^2 + (dev_q - dev_c)^2)``, hence the product an upper bound, ``<q, c> <= sum of
n * (mean_q * mean_c + dev_q * dev_c)``: a product of short statistics vectors. Coarse segments come
first, then finer ones for the pairs that are left, and exact products only for pairs that survive all.

Queries go to the executors in blocks of a stated size, each against all rows; every partition keeps
its best k a query, and these merge by an aggregation. A block is run and its result written before
the next one is read, so one block is on the way at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallylake.llm.common import arrow_map, materialize, scratch_path

#: Segments by resolution, coarse to fine.
LEVELS = (4, 8, 16)
#: Largest sum of products that doubles hold exactly.
EXACT = float(1 << 53)
#: No score and no row yet.
NONE, LAST = -(1 << 62) * 2 + 1, (1 << 63) - 1


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row the segments' means and deviations, scaled by the root of the segment's size."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).round().astype(int)
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = x[:, a:b]
        mean = part.mean(axis=1)
        out += [mean * np.sqrt(b - a), np.sqrt(np.maximum(0, ((part - mean[:, None]) ** 2).sum(axis=1)))]
    return np.stack(out, axis=1)


def products(q: np.ndarray, c: np.ndarray, matrix: bool) -> np.ndarray:
    """Integer inner products, of all rows (``matrix``) or row by row; in doubles while these are exact, else
    in 64-bit integers, else in whole numbers of any size, held at the ends of the 64-bit range."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < EXACT:
        return (q @ c.T if matrix else np.einsum("ij,ij->i", q, c)).astype(np.int64)
    if most < float(1 << 62):
        q, c = q.astype(np.int64), c.astype(np.int64)
        return q @ c.T if matrix else np.einsum("ij,ij->i", q, c)
    q, c = (np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) for x in (q, c))
    exact = q @ c.T if matrix else (q * c).sum(axis=1)
    return np.array(np.clip(exact, NONE + 1, LAST), np.int64).reshape(exact.shape)


class Best:
    """The k best ids of each query so far, each by its best row; ties to the smaller id."""

    #: Pairs whose statistics or vectors are gathered at once.
    PAIRS = 1 << 17
    #: A block of pairs of which more than one in so many survive is multiplied as a matrix, which is cheaper.
    SPARSE = 24

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.levels = [statistics(q, n) for n in LEVELS]
        self.norm = np.sqrt((q * q).sum(axis=1))
        self.score = np.full((len(q), k), NONE)
        self.row = np.full((len(q), k), LAST)
        self.exact = self.pairs = 0

    def add(self, ids: np.ndarray, c: np.ndarray) -> None:
        """Rows come in pieces that grow, so that there are places to beat early."""
        at, size = 0, 16
        while at < len(c):
            self._add(ids[at : at + size], c[at : at + size])
            at, size = at + size, min(2 * size, 1024)

    def _add(self, ids: np.ndarray, c: np.ndarray) -> None:
        self.pairs += len(self.q) * len(c)
        least = np.where(self.row[:, -1] < LAST, self.score[:, -1].astype(np.float64), -np.inf)
        norm = np.sqrt((c * c).sum(axis=1))
        # bounds carry rounding errors, so they get a margin; ties survive
        bound = self.levels[0] @ statistics(c, LEVELS[0]).T
        i, j = np.nonzero(bound + 1e-9 * self.norm[:, None] * norm + 1e-6 >= least[:, None])
        for level, segments in list(enumerate(LEVELS))[1:]:
            if not len(i):
                return
            fine = np.zeros(len(i), bool)
            qs, cs = np.unique(i), np.unique(j)
            stats = statistics(c[cs], segments)
            if len(i) * self.SPARSE > len(qs) * len(cs):
                bound = (self.levels[level][qs] @ stats.T)[np.searchsorted(qs, i), np.searchsorted(cs, j)]
                fine = bound + 1e-9 * self.norm[i] * norm[j] + 1e-6 >= least[i]
            else:
                for at in range(0, len(i), self.PAIRS):
                    a, b = i[at : at + self.PAIRS], j[at : at + self.PAIRS]
                    bound = np.einsum("ij,ij->i", self.levels[level][a], stats[np.searchsorted(cs, b)])
                    fine[at : at + self.PAIRS] = bound + 1e-9 * self.norm[a] * norm[b] + 1e-6 >= least[a]
            i, j = i[fine], j[fine]
        if not len(i):
            return
        qs, cs = np.unique(i), np.unique(j)
        if len(i) * self.SPARSE > len(qs) * len(cs):
            self.exact += len(qs) * len(cs)
            score = products(self.q[qs], c[cs], True)[np.searchsorted(qs, i), np.searchsorted(cs, j)]
        else:
            self.exact += len(i)
            score = np.concatenate([products(self.q[i[at : at + self.PAIRS]], c[j[at : at + self.PAIRS]], False) for at in range(0, len(i), self.PAIRS)])
        fine = (score >= least[i]) & (self.ids[i] != ids[j])
        self._merge(i[fine], ids[j[fine]], score[fine])

    def _merge(self, q: np.ndarray, name: np.ndarray, score: np.ndarray) -> None:
        """An id that is held and comes again keeps one place, so k places are k ids."""
        qs = np.unique(q)
        held = np.nonzero(self.row[qs] < LAST)
        q = np.concatenate([q, qs[held[0]]])
        name, score = np.concatenate([name, self.row[qs][held]]), np.concatenate([score, self.score[qs][held]])
        order = np.lexsort((-score, name, q))
        q, name, score = q[order], name[order], score[order]
        first = np.concatenate([[True], (q[1:] != q[:-1]) | (name[1:] != name[:-1])]) if len(q) else np.zeros(0, bool)
        q, name, score = q[first], name[first], score[first]
        order = np.lexsort((name, -score, q))
        q, name, score = q[order], name[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        best = rank < self.k
        self.row[qs], self.score[qs] = LAST, NONE
        self.row[q[best], rank[best]], self.score[q[best], rank[best]] = name[best], score[best]


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, x array<double>): each component floored after scaling; vectors that are null, empty or
    hold null or non-finite components are left out, as are null ids."""
    x = F.transform(F.col(vector_col), lambda v: F.floor(v.cast("double") * scale).cast("double"))
    fine = F.col(vector_col).isNotNull() & F.forall(F.col(vector_col), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & fine & (F.size(vector_col) > 0)).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def _by_length(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length of vectors: where they stand, and their values as a matrix."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
    begins = np.cumsum(sizes) - sizes
    out = []
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        out.append((at, flat.reshape(-1, n) if len(at) == len(sizes) else flat[begins[at][:, None] + np.arange(n)]))
    return out


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: Best(ids, q, k) for n, (ids, q) in shared.value.items()}
        for batch in batches:
            own = batch.column(0).to_numpy()
            for at, x in _by_length(batch.column(1)):
                if x.shape[1] in best:
                    best[x.shape[1]].add(own[at], x)
        for b in best.values():
            found = b.row < LAST
            yield pa.RecordBatch.from_arrays([pa.array(a[found]) for a in (np.broadcast_to(b.ids[:, None], found.shape), b.row, b.score)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = 5, every: int = 50, scale: float = 256.0, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products, its own id
    left out, ties to the smaller id (repeated rows of an id, asked or found, count once, by their best
    score).

    ``queries`` (same columns) default to the rows whose id is divisible by ``every``. They are taken
    ``block`` rows at a time, dealt beforehand by a hash: a block is read, sent out, run in one pass over all
    rows, its k best a query written, and released before the next. So neither the driver nor a task
    holds more than about one block, however many there are. A query meets the vectors of its own
    length. Scores beyond 64 bits are held at the ends of the range. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vector_col, scale)
    asked = rows.where(F.col("vec_id") % every == 0) if queries is None else quantised(queries, id_col, vector_col, scale)
    asked = materialize(asked.dropDuplicates(["vec_id", "x"]), "queries")
    blocks = max(1, -(-asked.count() // block))
    if blocks > 1:
        dealt = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)).cast("int"))
        path = scratch_path(spark, "query-blocks")
        dealt.repartition("block").write.partitionBy("block").parquet(path)
        asked = spark.read.schema("vec_id long, x array<double>, block int").parquet(path)
    found, schema = scratch_path(spark, "found"), "query_id long, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(found)
    for b in range(blocks):
        part = (asked.where(F.col("block") == b) if blocks > 1 else asked).select("vec_id", "x").toPandas()
        by = {n: (own["vec_id"].to_numpy(), np.stack(own["x"].to_numpy())) for n, own in part.groupby(part["x"].map(len))}
        if not by:
            continue
        shared = spark.sparkContext.broadcast(by)
        once = rows.transform(arrow_map, _search(shared, k), schema).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        once.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank").write.mode("append").parquet(found)
        shared.destroy()
    # rows of one query with several vectors may have come in several blocks
    once = spark.read.schema(schema).parquet(found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

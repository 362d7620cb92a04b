"""Lloyd's clustering on whole numbers, with an annulus search for the nearest centroid.

A centroid nearer to x than u has a norm within u of x's norm. So each round takes u as the exact
distance to the centroid that x had before, finds by binary search which of the centroids, sorted by
norm, lie in that annulus, and compares exactly those with x; centroids on its edge stay in, so ties
go to the smaller number. In the first round the centroid whose norm is nearest gives u.

Vectors stay where they are: a task assigns its rows and gives one row of sums a centroid, which are
added up by an aggregation; ``k`` rows reach the driver a round. Assignments travel to the next round
in a written table, whose predecessor is then removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallylake.llm.common import arrow_map, materialize, release
from rallylake.llm.topk import EXACT

#: The largest distance that is reported as it is; greater ones are held there.
LONGEST = (1 << 63) - 1


def whole(vectors: DataFrame, dims: int, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x array<long>): floored components of the vectors with exactly ``dims`` of them, none null or non-finite."""
    x, v = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * scale)), F.col(vector_col)
    fine = v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


class Annulus:
    """Exact nearest centroids (the smaller number of equal ones) of whole vectors."""

    def __init__(self, centroids: np.ndarray):
        self.whole, self.centroids = centroids.astype(object), centroids.astype(np.float64)
        self.square = (self.centroids**2).sum(axis=1)
        norms = np.sqrt(self.square)
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]
        self.compared = self.rows = 0

    def distances(self, x: np.ndarray, c: np.ndarray | int) -> np.ndarray:
        """Squared distances to centroids ``c`` (one, or one a row), exact: ``x`` are doubles that hold all sums, or numbers of any size."""
        if x.dtype == np.float64:
            product = x @ self.centroids[c] if isinstance(c, int) else np.einsum("ij,ij->i", x, self.centroids[c])
            return np.einsum("ij,ij->i", x, x) - 2 * product + self.square[c]
        return ((x - self.whole[c]) ** 2).sum(axis=1)

    def nearest(self, x: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Per row of ``x`` its centroid and squared distance; ``before`` are the centroids of the last round."""
        y = x.astype(np.float64)
        most = max(float(np.abs(y).max(initial=0)), float(np.abs(self.centroids).max(initial=0)))
        norm = np.sqrt((y**2).sum(axis=1))
        x = y if 4 * x.shape[1] * most**2 < EXACT else x.astype(object)
        if before is None:
            right = np.clip(np.searchsorted(self.norms, norm), 1, max(1, len(self.norms) - 1))
            left = right - 1
            right = np.minimum(right, len(self.norms) - 1)
            before = self.order[np.where(norm - self.norms[left] <= self.norms[right] - norm, left, right)]
        best, least = before.copy(), self.distances(x, before)
        # rounding may move an edge, so the annulus gets a margin; what it lets in is compared exactly
        bound = np.sqrt(least.astype(np.float64)) * (1 + 1e-9) + norm * 1e-9 + 1e-6
        first, last = np.searchsorted(self.norms, norm - bound), np.searchsorted(self.norms, norm + bound, side="right")
        self.rows += len(x)
        for place in range(int(first.min(initial=0)), int(last.max(initial=0))):
            c = int(self.order[place])
            at = np.flatnonzero((first <= place) & (place < last) & (before != c))
            if not len(at):
                continue
            self.compared += len(at)
            found = self.distances(x if len(at) == len(x) else x[at], c)
            nearer = (found < least[at]) | ((found == least[at]) & (c < best[at]))
            best[at[nearer]], least[at[nearer]] = c, found[nearer]
        return best, least


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(centroids)
        for batch in batches:
            if not batch.num_rows:
                continue
            before = batch.column(2).to_numpy(zero_copy_only=False) if batch.num_columns > 2 else None
            best, least = search.nearest(_matrix(batch.column(1)), before)
            distance = pa.array([min(int(v), LONGEST) for v in least.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.int32()), distance], names=["vec_id", "x", "cluster", "distance"])

    return run


def _sums(k: int, dims: int):
    """Per task one row a centroid that it has: how many vectors, and their sums by component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            small = float(np.abs(x.astype(np.float64)).max()) * len(x) < 1 << 62
            order = np.argsort(cluster, kind="stable")
            kinds, begins = np.unique(cluster[order], return_index=True)
            part = np.add.reduceat(x[order] if small else x[order].astype(object), begins, axis=0)
            total[kinds] += part.astype(object)
            n += np.bincount(cluster, minlength=k)
        own = np.flatnonzero(n)
        sums = pa.array([[str(v) for v in total[c]] for c in own], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(n[own]), sums], names=["cluster", "n", "sums"])

    return run


def kmeans(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: float = 256.0, salt: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) for every vector of ``dims`` finite components, and the centroids.

    Components are floored after scaling, centroids are whole numbers and everything is exact. The first
    centroids are the vectors with the smallest SHA-256 of ``salt:id``, of equal ones (repeated ids) the
    smaller vector; rows without an id come last there. Fewer vectors than ``k`` give fewer centroids.
    In each round every vector goes to its nearest centroid (of equal ones the smaller number), and every
    centroid that has vectors becomes the floor of their mean; then all are assigned once more. Repeated rows
    are vectors each for itself. Components beyond 64 bits are held at the ends of that range, as are
    distances. An empty table gives no rows and no centroids.
    """
    rows = materialize(whole(vectors, dims, scale, id_col, vector_col), "vectors")
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(name.asc_nulls_last(), "x").limit(k).collect()
    centroids = np.array([r["x"] for r in first], np.int64).reshape(-1, dims)
    schema = "vec_id long, x array<bigint>, cluster int, distance long"
    for step in range(rounds + 1):
        if not len(centroids):
            return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
        columns = ("vec_id", "x") if not step else ("vec_id", "x", "cluster")
        after = materialize(rows.select(*columns).transform(arrow_map, _assign(centroids), schema), "assigned")
        release(rows)
        rows = after
        if step < rounds:
            sums = rows.select("cluster", "x").transform(arrow_map, _sums(len(centroids), dims), "cluster int, n long, sums array<string>")
            total = sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(dims))).alias("sums"))
            for r in total.collect():
                centroids[r["cluster"]] = [int(v) // r["n"] for v in r["sums"]]
    return rows.select("vec_id", "cluster", "distance"), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``found`` of :func:`kmeans` with cluster_inertia, inertia (sums of distances, held at 64 bits) and
    centroid_sha256; one row a centroid goes out to all."""
    spark = found.sparkSession
    by = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    total = min(sum(by.values()), LONGEST)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, min(d, LONGEST), total, digest[c]) for c, d in by.items()]
    return found.join(F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster")

"""Helpers the training-data operators share: shared storage, Arrow batches and components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory; any path that Spark's readers open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where the session names none, a local session (tests on one machine) uses a temporary folder; on a
    cluster that is an error, as executors would not see the driver's folders.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="rallylake-")
        where = _local[app]
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the JVM ends."""
    path = f"{shared_dir(spark)}/rallylake/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The written table survives lost executors and later jobs read it instead of recomputing.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(df: DataFrame) -> None:
    """Remove a table that :func:`materialize` wrote and nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Separators become spaces, A-Z become a-z; digits, letters and bytes of other characters stay.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def merged(spans) -> list[tuple[int, int]]:
    """Union of half-open spans; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes the empty string."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def portions(batch: pa.RecordBatch, column: int, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose texts (a string column) have about ``limit`` bytes together."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy())
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit)) + 1
        yield batch.slice(at, end - at)
        at = end


def per_batch(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]):
    """A ``mapInArrow`` function that applies ``make()`` (called once a task) to slices of up to
    512 rows, so that Python objects exist for one slice at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield f(batch.slice(at, 512))
            pa.default_memory_pool().release_unused()

    return run


#: What a worker that is used again keeps from task to task, of one kind at a time: its kind, its key and the value.
_kept: list = []


def kept(kind: str, key, make: Callable):
    """``make()``, made once in a worker for all tasks of this kind and key; the maps that ask for it name the kind."""
    if not (_kept and _kept[0] == kind and (_kept[1] is key or _kept[1] == key)):
        let_go()
        _kept[:] = [kind, key, make()]
    return _kept[2]


def let_go(kind: str | None = None) -> None:
    """Free what the worker keeps of any other kind."""
    if _kept and _kept[0] != kind:
        _kept.clear()
        gc.collect()


def trim() -> None:
    """Give memory that is free in this process back to the machine; C libraries without such a call keep theirs."""
    pa.default_memory_pool().release_unused()
    if back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        back(0)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, keeps: str | None = None) -> DataFrame:
    """``df.mapInArrow`` with Arrow batches of about 8 MB, whatever the length of the texts.

    A size that the session has been given other than Spark's default is kept. ``keeps`` is the kind of what the tasks
    get from :func:`kept`; what workers have kept of other kinds, for the operators before, goes when a task begins,
    and what a task no longer uses when it ends.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(keeps)
        yield from run(batches)
        trim()

    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) in ("67108864b", "67108864", "64m", "64MB"):
        conf.set(key, "8m")
    return df.mapInArrow(task, schema)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges (a, b): the smallest node of each node's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        left = label[a] != label[b]
        a, b = a[left], b[left]
    return label


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
        ids, at = np.unique(np.concatenate(ends), return_inverse=True)
        label = roots(len(ids), at[: len(ends[0])], at[len(ends[0]) :])
        own = np.arange(len(ids)) != label
        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[label[own]])], names=["a", "b"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long): the smallest node reachable.

    Alternating large-star and small-star rounds; each is two aggregations with map-side combine and
    a join, so a node with very many links is not gathered anywhere. Rounds stop when the edge set is
    stable. Every round is written to the shared folder and only a row count and a checksum reach
    the driver.
    """
    schema = "a long, b long"
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    now = materialize(edges.transform(arrow_map, _contract, schema).distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        # large-star: every larger neighbour of u is linked to the least of u and its neighbours
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small-star: u and its smaller neighbours are linked to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        after = materialize(small.where("a <> b").distinct(), "links")
        release(now)
        now = after
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == seen:
            break
        seen = tuple(sums)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

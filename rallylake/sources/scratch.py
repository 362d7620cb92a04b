"""Folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``. Where none is set, a local session uses a temporary
    folder; on a cluster that is an error, as executors would not see the driver's folders."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="rallylake-")
        where = _local[app]
    return f"{where.rstrip('/')}/rallylake/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: a cut in the lineage that outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""A keyed table that is changed in place: only partitions with touched keys are rewritten.

The table is Parquet, dealt into a fixed number of partitions by a hash of its key. A batch of changes reads and
rewrites the partitions of its keys (dynamic partition overwrite) and then leaves a marker under its id.
A batch with a marker is not applied again; one that was cut off is, with the same outcome, as every
change says what a row becomes and not what is added to it. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallylake.sources.scratch import written


class Store:
    """The table at ``path`` with the columns of ``schema``; ``key`` names the unique, non-null column."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, parts: int = 16):
        self.spark, self.path, self.key, self.parts = spark, path.rstrip("/"), key, parts
        self.schema = T.StructType.fromDDL(schema)
        self.columns = self.schema.fieldNames()

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int").alias("part")

    def _stored(self) -> DataFrame:
        """All rows with their partition; an emptied partition keeps one row without a key."""
        self._fs(self.path, lambda fs, p: fs.mkdirs(p))
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("part", T.IntegerType())])).parquet(self.path)

    def rows(self) -> DataFrame:
        return self._stored().where(F.col(self.key).isNotNull()).drop("part")

    def _fs(self, path: str, do):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return do(hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop)

    def applied(self, batch: str) -> bool:
        return self._fs(f"{self.path}/_batches/{batch}", lambda fs, p: fs.exists(p))

    def upsert(self, rows: DataFrame, batch: str) -> bool:
        """Insert the rows, or put them in place of those of their keys; of several of a key the greatest stays."""
        latest = rows.select(self.columns).groupBy(self.key).agg(F.max(F.struct(*self.columns)).alias("r")).select("r.*")
        return self._apply(latest.withColumn("_gone", F.lit(False)), batch)

    def insert(self, rows: DataFrame, batch: str) -> DataFrame:
        """Insert the rows whose keys are new, and return the stored row of every key of the batch, with ``inserted``: false where
        one was there before, which stays. Of several rows of a key the greatest counts; rows without a key are left out.
        The answer is written before the table changes, so a batch that is sent again, or was cut off, gets the same one.
        """
        answer, done = f"{self.path}/_returned/{batch}", lambda fs, p: fs.exists(p)
        schema = T.StructType([*self.schema.fields, T.StructField("inserted", T.BooleanType())])
        if not self._fs(f"{answer}/_SUCCESS", done):
            new = rows.where(F.col(self.key).isNotNull()).select(self.columns).groupBy(self.key).agg(F.max(F.struct(*self.columns)).alias("new"))
            before = self.rows().select(self.key, F.struct(*self.columns).alias("old"))
            both = new.join(before, self.key, "left").select(F.coalesce("old", "new").alias("r"), F.col("old").isNull().alias("inserted"))
            both.select("r.*", "inserted").write.mode("overwrite").parquet(answer)
        told = self.spark.read.schema(schema).parquet(answer)
        self._apply(told.where("inserted").select(*self.columns, F.lit(False).alias("_gone")), batch)
        return told

    def delete(self, keys: DataFrame, batch: str) -> bool:
        """Delete the rows of the keys; keys without a row change nothing."""
        gone = keys.select(F.col(self.key)).distinct()
        return self._apply(gone.select(*(F.col(c) if c == self.key else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in self.columns), F.lit(True).alias("_gone")), batch)

    def update(self, keys: DataFrame, values: dict[str, Column], batch: str) -> bool:
        """Set columns of the rows of the keys. A value is an expression of the row before; a batch that was cut off is
        applied again, so it should give the same when applied to its own result."""
        # the rows as they are, written, since the table they come from is about to change
        now = written(self.rows().join(keys.select(self.key).distinct(), self.key, "left_semi").select(*(values[c].alias(c) if c in values else F.col(c) for c in self.columns)), "updated")
        return self._apply(now.withColumn("_gone", F.lit(False)), batch)

    def _apply(self, changes: DataFrame, batch: str) -> bool:
        """Whether the batch was applied now. ``changes`` has one row a key, with ``_gone`` for deletions."""
        if self.applied(batch):
            return False
        changes = written(changes.where(F.col(self.key).isNotNull()).withColumn("part", self._part()), "changes")
        # at most as many numbers as the table has partitions
        touched = [r["part"] for r in changes.select("part").distinct().collect()]
        if touched:
            before = self._stored().where(F.col("part").isin(touched) & F.col(self.key).isNotNull())
            kept = before.join(changes.select(self.key), self.key, "left_anti").select(*self.columns, "part")
            new = changes.where(~F.col("_gone")).select(*self.columns, "part")
            marks = self.spark.createDataFrame([(p,) for p in touched], "part int").select(*(F.lit(None).cast(self.schema[c].dataType).alias(c) for c in self.columns), "part")
            out = kept.unionByName(new).unionByName(marks).repartition(len(touched), "part")
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)
        self._fs(f"{self.path}/_batches/{batch}", lambda fs, p: fs.create(p, True).close())
        return True

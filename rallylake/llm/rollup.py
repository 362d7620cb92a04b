"""Delta-maintained token counts: additive totals by source, language and tokenizer version.

An insert adds a document and its tokens, a delete subtracts them, a revision subtracts the old
count and adds the new one. A batch is summed by key before it is shuffled and written once, under
its batch id; a batch that is already committed is not written again, so a replay changes nothing.
Totals are the sums over the committed batches; ``compact`` folds batches into one.
"""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallylake.llm.common import arrow_map, per_batch, utf8
from rallylake.llm.tokens import encoder

KEY = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


def without_repeated_lines(text: bytes) -> bytes:
    """Each distinct line once, at its first place."""
    lines = text.split(b"\n")
    return b"\n".join(dict.fromkeys(lines)) if len(set(lines)) < len(lines) else text


def version(path: str) -> str:
    """The tokenizer's name and the beginning of its vocabulary's digest."""
    with open(path, "rb") as f:
        return f"{path.rpartition('/')[2].rpartition('.')[0]}@{hashlib.file_digest(f, 'sha256').hexdigest()[:12]}"


def count_tokens(docs: DataFrame, path: str | None = None, revise=without_repeated_lines, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens, revised_tokens: two rows a document, for the vocabulary
    file at ``path`` (default: the public word BPE) and for white-space words.

    ``revise`` gives the revised text whose tokens are the revised count. Null texts count as empty.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    name = version(path)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def make():
        lengths = encoder(path).lengths

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = utf8(batch.column(3))
            ids, split = lengths(batch.column(3)).tolist(), [len(x.split()) for x in texts]
            new = [revise(x) for x in texts]
            changed = [k for k, x in enumerate(texts) if new[k] is not x]
            ids2, split2 = list(ids), list(split)
            for k, n in zip(changed, lengths(pa.array([new[k] for k in changed], pa.string())).tolist(), strict=True):
                ids2[k], split2[k] = n, len(new[k].split())
            cols = [pa.concat_arrays([c, c]) for c in batch.columns[:3]]
            counts = [[name] * len(texts) + ["whitespace"] * len(texts), ids + split, ids2 + split2]
            return pa.RecordBatch.from_arrays([*cols, pa.array(counts[0], pa.string()), *(pa.array(c, pa.int64()) for c in counts[1:])], names=["doc_id", "source", "lang", "tokenizer", "tokens", "revised_tokens"])

        return f

    return docs.transform(arrow_map, per_batch(make), "doc_id long, source string, lang string, tokenizer string, tokens long, revised_tokens long", "tokens")


def inserts(counts: DataFrame, tokens: str = "tokens") -> DataFrame:
    return counts.select(*KEY, F.lit(1).cast("long").alias("docs"), F.col(tokens).alias("tokens"))


def deletes(counts: DataFrame, tokens: str = "tokens") -> DataFrame:
    return counts.select(*KEY, F.lit(-1).cast("long").alias("docs"), (-F.col(tokens)).alias("tokens"))


def revisions(counts: DataFrame, old: str = "tokens", new: str = "revised_tokens") -> DataFrame:
    return counts.select(*KEY, F.lit(0).cast("long").alias("docs"), (F.col(new) - F.col(old)).alias("tokens"))


class Rollup:
    """A rollup kept under ``path``, a folder that the driver and all executors see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """Ids of the batches whose write has ended."""
        found = self._fs.globStatus(self._hadoop(f"{self.path}/batch=*/_SUCCESS")) or []
        return sorted(x.getPath().getParent().getName().removeprefix("batch=") for x in found)

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Write a batch of signed deltas once; False if it was committed before.

        A write that broke off left no ``_SUCCESS``, is not read, and is overwritten by the next try.
        """
        if not batch_id or set(batch_id) & set("/=*?{}[]\\,"):
            raise ValueError(f"not a batch id: {batch_id!r}")
        if batch_id in self.committed():
            return False
        summed = deltas.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        summed.where("docs <> 0 or tokens <> 0").write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over the committed batches; keys that came to nothing go."""
        paths = [f"{self.path}/batch={b}" for b in self.committed()]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def compact(self, into: Rollup) -> None:
        """Write the totals as one batch of another rollup; its id names the batches that it holds, so
        that a repeated compaction changes nothing."""
        into.commit("upto-" + hashlib.sha256("\n".join(self.committed()).encode()).hexdigest()[:16], self.totals())

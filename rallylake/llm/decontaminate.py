"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive item words. Per class of pattern lengths: the shift table tells
for a block of two words how far the scan may jump, the blocks that end a pattern select a bucket of
patterns by a hash of all words up to it, and only these are compared.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallylake.llm.common import WORDS, arrow_map, kept, materialize, merged, per_batch, scratch_path, utf8

WINDOW = 13

def words(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class WuManber:
    """Search of word patterns of at least ``m`` words, ``m`` being the shortest pattern's length.

    A block is two words; where it may end a pattern's first m words, these are hashed as a whole and select the
    bucket whose patterns are compared.
    """

    def __init__(self, runs: list[tuple[list[bytes], int]], m: int):
        """``runs``: the words of an item and the length of its patterns, which are all its windows of that length."""
        self.m, self.block = m, min(2, m)
        self.default = m - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[bytes, ...]]] = {}
        shift, default = self.shift, self.default
        for w, n in runs:
            last = len(w) - n + m
            # of the windows that hold a block, the one that it ends allows the least jump
            for end in range(self.block, last + 1):
                block, jump = tuple(w[end - self.block : end]), max(0, m - end)
                if jump < shift.get(block, default):
                    shift[block] = jump
            for k in range(len(w) - n + 1):
                p = tuple(w[k : k + n])
                own = self.bucket.setdefault(p[:m], [])
                if p not in own:
                    own.append(p)

    def find(self, text: list[bytes]) -> list[tuple[int, tuple[bytes, ...]]]:
        """(first word, pattern) of every occurrence."""
        found, at, n = [], self.m - 1, len(text)
        shift, default, two = self.shift.get, self.default, self.block == 2
        while at < n:
            block = (text[at - 1], text[at]) if two else (text[at],)
            jump = shift(block, default)
            if jump:
                at += jump
                continue
            begin = at - self.m + 1
            for p in self.bucket.get(tuple(text[begin : at + 1]), ()):
                if len(p) == self.m or tuple(text[begin : begin + len(p)]) == p:
                    found.append((begin, p))
            at += 1
        return found


def length_class(n: int) -> int:
    """Patterns of like length share tables, so that a one-word item does not shorten every jump."""
    return 0 if n == 1 else 1 if n < 4 else 2 if n < 8 else 3 if n < WINDOW else 4


def tables(items: list[tuple[str, bytes]], window: int = WINDOW) -> tuple[list[WuManber], dict[tuple[bytes, ...], list[str]]]:
    """For (item name, text): a searcher per length class, and the names of each pattern's items."""
    owners: dict[tuple[bytes, ...], list[str]] = {}
    classes: dict[int, list[tuple[list[bytes], int]]] = defaultdict(list)
    for name, text in sorted(set(items)):
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            own = owners.setdefault(tuple(w[k : k + n]), [])
            if not own or own[-1] != name:
                own.append(name)
        if w:
            classes[length_class(n)].append((w, n))
    return [WuManber(runs, min(n for _, n in runs)) for runs in classes.values()], owners


def _tables_once(items: list, window: int):
    """The tables of a broadcast value, built once in a worker that is used again."""
    return kept("windows", (items, window), lambda: tables(items, window))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_chars: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, item_names (sorted strings), contaminated.

    All columns of ``docs`` are kept (those four are replaced if there), of whatever names. The benchmark
    goes to the executors in blocks of about ``block_chars`` characters, dealt by a hash of the item. One
    block is one map. Of more, each is read, run over the written table, its hits written, and released
    before the next, so neither a task nor the driver ever holds more than about one. Null texts have
    no words; an item with a null id is named "null"; an empty benchmark marks nothing; repeated items
    count once by name.
    """
    spark = docs.sparkSession
    items = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("name"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.length("text") + 8)).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    # the caller's columns travel as one, so that none of their names can clash
    kept = F.struct(*[F.col(c) for c in docs.columns if c not in RESULT]).alias("doc")
    now = docs.select(kept, F.col(text_col).cast("string").alias("text"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("array<long>").alias("hits"), F.lit(None).cast("array<string>").alias("names"))

    def sent(k: int):
        part = items.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == k)
        return spark.sparkContext.broadcast([(r["name"], r["text"].encode()) for r in part.collect()])

    if blocks == 1:
        now = now.transform(arrow_map, per_batch(_search(sent(0), window)), now.schema, "windows")
    else:
        now = materialize(now.withColumn("row", F.monotonically_increasing_id()), "texts")
        path = scratch_path(spark, "hits")
        for k in range(blocks):
            shared, some = sent(k), now.select("row", "text", "n", "hits", "names")
            found = some.transform(arrow_map, per_batch(_search(shared, window)), some.schema, "windows").drop("text")
            # the first block's rows are all kept, for the counts of words
            (found if k == 0 else found.where("size(hits) > 0")).write.mode("append").parquet(path)
            shared.destroy()
        spans = F.flatten(F.collect_list("hits"))
        found = spark.read.parquet(path).groupBy("row").agg(F.max("n").alias("n"), spans.alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))
        now = now.select("doc", "row").join(found, "row")
    return now.select(
        "doc.*",
        F.col("n").alias("n_words"),
        _covered(F.col("hits")).alias("n_hit"),
        F.col("names").alias("item_names"),
    ).withColumn("contaminated", contaminated())


RESULT = ("n_words", "n_hit", "item_names", "contaminated")


def _covered(spans: Column) -> Column:
    """Words that spans (first << 31 | end) cover together."""
    low = F.lit((1 << 31) - 1)
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x.bitwiseAND(low) - F.greatest(F.shiftright(x, 31), acc["end"]))).alias("n"), F.greatest(acc["end"], x.bitwiseAND(low)).alias("end"))
    zero = F.lit(0).cast("long")
    return F.aggregate(F.array_sort(spans), F.struct(zero.alias("n"), zero.alias("end")), step, lambda acc: acc["n"])


def contaminated() -> Column:
    """The rule: at least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def _search(shared, window: int):
    def make():
        searchers, owners = _tables_once(shared.value, window)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            ns, hits, names = [], [], []
            for text in utf8(cols["text"]):
                w = words(text)
                spans, items = [], set()
                for searcher in searchers:
                    for at, p in searcher.find(w):
                        spans.append((at, at + len(p)))
                        items.update(owners[p])
                ns.append(len(w))
                hits.append([a << 31 | b for a, b in merged(spans)])
                names.append(sorted(items))
            cols |= {"n": pa.array(ns, pa.int64()), "hits": pa.array(hits, pa.list_(pa.int64())), "names": pa.array(names, pa.list_(pa.string()))}
            return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

        return f

    return make


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()

"""WARC archives through Spark's own writers and readers, with payloads as chunk rows.

Every payload, whatever its size, becomes rows of the chunked record table: record identifier, chunk
number, bytes of at most a chunk, and the length and SHA-1 up to and with the chunk, carried from
chunk to chunk. Tasks cut payloads as they stream by; beside the input row they hold one small group of
chunks. Records of several chunks are written as segmented records (WARC-Segment-Number and
``continuation`` records, as the format defines them). Reading gives chunk rows again, which meet by
record in the order of their numbers; their running digests are those of the archived bytes.

The archives are text files of records ending in two line breaks. The reader's record separator is
the version line with the name of the first header; a payload that holds this separator is cut
inside it, so it never stands whole in a record's block.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallylake.llm.common import arrow_map, materialize, release

VERSION, FIRST = "WARC/1.1\r\n", "WARC-Type: "
END = "\r\n\r\n"
#: Bytes of a payload in one row, and bytes of chunks that a task gathers before it hands them on.
CHUNK = 1 << 14
GROUP = 1 << 21


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def cuts(payload: memoryview, chunk_bytes: int) -> Iterator[memoryview]:
    """Pieces of at most ``chunk_bytes``, at least one; none holds the record separator."""
    mark, at, n = (VERSION + FIRST).encode(), 0, len(payload)
    while True:
        piece = payload[at : at + chunk_bytes]
        inside = bytes(piece).find(mark)
        if inside >= 0:
            piece = piece[: inside + len(VERSION)]
        yield piece
        at += len(piece)
        if at >= n:
            return


CHUNKS = "record string, page_id long, url string, chunk_no int, last boolean, chunk binary, bytes_so_far long, digest_so_far string"


def chunked(pages: DataFrame, chunk_bytes: int = CHUNK, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """The chunked record table of pages: a record a row of ``pages``, a row a chunk.

    A record's name holds the page's id and the place of its row (partition and number), so rows that
    repeat an id, or have none, stay apart. Null payloads are one empty chunk.
    """
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit("")
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.coalesce(url, F.lit("")), "[\\r\\n]", "%0A").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, rows, size = TaskContext.get().partitionId(), 0, [], 0

        def group():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for page, url, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                record = f"<urn:page:{'null' if page is None else page}:{part}-{row}"
                row += 1
                sha, total, n = hashlib.sha1(), 0, len(payload.as_buffer())
                for k, piece in enumerate(cuts(memoryview(payload.as_buffer()), chunk_bytes)):
                    sha.update(piece)
                    total += len(piece)
                    rows.append((record, page, url, k + 1, total == n, piece, total, base32(sha.digest())))
                    size += len(piece) + 200
                    if size >= GROUP:
                        yield group()
                        rows, size = [], 0
        if rows:
            yield group()

    return pages.transform(arrow_map, run, CHUNKS)


def revisits(chunks: DataFrame, at_least: int = 0) -> DataFrame:
    """(record, refers_to): records that revisit the first of those with an equal payload of at least
    ``at_least`` bytes. The first is that with the smallest page id (a null one last); other rows of the
    same page are responses themselves."""
    ends = chunks.where(F.col("last") & (F.col("bytes_so_far") >= at_least)).select("record", "page_id", F.col("bytes_so_far").alias("n"), F.col("digest_so_far").alias("sha"))
    first = ends.groupBy("n", "sha").agg(F.count("*").alias("copies"), F.min(F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "record")).alias("first")).where("copies > 1")
    # written first, so that the planner knows its size
    first = materialize(first.select("n", "sha", F.col("first.page_id").alias("first_page"), F.col("first.record").alias("refers_to")), "first")
    return ends.join(first, ["n", "sha"]).where(~F.col("page_id").eqNullSafe(F.col("first_page"))).select("record", "refers_to")


def write_archives(pages: DataFrame, path: str, at_least: int = 0, chunk_bytes: int = CHUNK, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> None:
    """Write gzip-compressed WARC files under ``path``: a record a page, of as many segments as it has chunks."""
    chunks = materialize(chunked(pages, chunk_bytes, id_col, payload_col, url_col), "chunks")
    again = materialize(revisits(chunks, at_least), "revisits")
    rows = chunks.join(again, "record", "left")
    visit, later = F.col("refers_to").isNotNull(), F.col("chunk_no") > 1
    rows = rows.where(~(visit & later)).withColumn("block", F.when(visit, F.lit(b"")).otherwise(F.col("chunk")))
    number = F.col("chunk_no").cast("string")
    head = F.concat(
        F.lit(VERSION + FIRST),
        F.when(later, "continuation").when(visit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), F.col("record"), F.when(later, F.concat(F.lit(":segment-"), number)).otherwise(""), F.lit(">"),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.col("url"),
        F.when(~visit & F.col("last"), F.concat(F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest_so_far"))).otherwise(""),
        F.when(visit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), F.col("refers_to"), F.lit(">"))).otherwise(""),
        F.when(~visit & ~(F.col("last") & ~later), F.concat(F.lit("\r\nWARC-Segment-Number: "), number)).otherwise(""),
        F.when(later, F.concat(F.lit("\r\nWARC-Segment-Origin-ID: "), F.col("record"), F.lit(">"))).otherwise(""),
        F.when(later & F.col("last"), F.concat(F.lit("\r\nWARC-Segment-Total-Length: "), F.col("bytes_so_far").cast("string"))).otherwise(""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit(END),
    )
    text = F.concat(head.cast("binary"), F.col("block")).cast("string")
    rows.select(text.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 100_000).text(path)
    release(chunks)  # the archives hold them now


def chunk_table(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of the archives under ``path``: record_id, chunk_no (from 1),
    segmented, record_type, target_uri, refers_to, payload_digest (as the header has it), complete
    (false if the block is shorter than its header says), chunk."""
    rows = spark.read.option("lineSep", VERSION + FIRST).text(path).where("value <> ''")
    # what a map over partitions gave stays one expression each: the header is cut off once
    rows = rows.select("value", F.substring_index("value", END, 1).alias("head"))

    def field(name: str) -> Column:
        return F.regexp_extract("head", f"(?i)\\r\\n{name}: *([^\\r\\n]*)", 1)

    length = field("Content-Length").cast("int")
    chunk = F.substring(F.col("value").cast("binary"), F.octet_length("head") + len(END) + 1, length)
    origin = field("WARC-Segment-Origin-ID")
    return rows.select(
        F.when(origin != "", origin).otherwise(field("WARC-Record-ID")).alias("record_id"),
        F.coalesce(F.nullif(field("WARC-Segment-Number"), F.lit("")).cast("int"), F.lit(1)).alias("chunk_no"),
        (field("WARC-Segment-Number") != "").alias("segmented"),
        F.substring_index("head", "\r\n", 1).alias("record_type"),
        field("WARC-Target-URI").alias("target_uri"),
        F.nullif(field("WARC-Refers-To"), F.lit("")).alias("refers_to"),
        F.regexp_extract("head", "(?i)\\r\\nWARC-Payload-Digest: *sha1:([A-Z2-7]*)", 1).alias("payload_digest"),
        (F.octet_length(chunk) == length).alias("complete"),
        chunk.alias("chunk"),
    )


RUNNING = "record_id string, chunk_no int, record_type string, refers_to string, bytes_so_far long, digest_so_far string, last boolean"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by record and number; the last of a record is known when the next one begins."""
    names, kinds = [x.split()[0] for x in RUNNING.split(", ")], [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    now, total, sha, held, first = None, 0, None, None, ("", None)
    for batch in batches:
        rows = []
        for record, number, kind, refers, chunk in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), strict=True):
            if held is not None:
                rows.append((*held, record != now))
            if record != now:
                now, total, sha, first = record, 0, hashlib.sha1(), (kind, refers)
            raw = chunk.as_buffer()
            sha.update(raw)
            total += len(raw)
            held = (record, number, *first, total, base32(sha.digest()))
        if rows:
            yield table(rows)
    if held is not None:
        yield table([(*held, True)])


def running_digests(chunks: DataFrame) -> DataFrame:
    """Per chunk row: bytes and SHA-1 (base32) of its record up to and with it, and whether it is the last."""
    dealt = chunks.select("record_id", "chunk_no", "record_type", "refers_to", "chunk")
    return dealt.repartition("record_id").sortWithinPartitions("record_id", "chunk_no").transform(arrow_map, _running, RUNNING)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: record_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest are computed from the archived bytes; a revisit has those of the record that
    it refers to.
    """
    ends = running_digests(chunk_table(spark, path)).where("last")
    found = materialize(ends.select("record_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to"), "records")
    originals = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.struct("payload_bytes", "payload_digest").alias("original"))
    visits = found.where("record_type = 'revisit'").select("record_id", "record_type", "refers_to").join(originals, "refers_to", "left").select("record_id", "record_type", "refers_to", "original.*")
    columns = ["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return found.where("record_type <> 'revisit'").select(columns).union(visits.select(columns))


def page_id(record: str) -> Column:
    return F.regexp_extract(record, "<urn:page:(-?\\d+):", 1)


def round_trip(pages: DataFrame, path: str, at_least: int = 0, chunk_bytes: int = CHUNK, **columns: str) -> DataFrame:
    """Write the archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null payloads are empty ones, of which the later revisit the first. A null page_id comes back as
    null and is never preferred. Rows that repeat a page with its payload are each a response if the
    page is the first. Each row comes back once, of whatever length, whatever the size of a chunk. An
    empty table gives no rows.
    """
    write_archives(pages, path, at_least, chunk_bytes, **columns)
    found = read_archives(pages.sparkSession, path)
    return found.select(F.nullif(page_id("record_id"), F.lit("")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.nullif(page_id("refers_to"), F.lit("")).cast("long").alias("refers_to"))

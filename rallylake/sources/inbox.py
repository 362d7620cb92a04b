"""An inbox of update messages as a replayable stream source, and feeds of frames as a two-phase stream sink.

The inbox is a folder ``producer=<name>/seq=<n>/`` of text files with one message a line. A producer numbers
its deliveries upwards and never changes one; a delivery counts once its folder is there under its
own name. An offset is the highest number read of each producer, so any range can be read
again, a stream that starts anew reads exactly what its last one did not commit, and deliveries of one producer
are read in their order whatever the times of the files.

The sink takes frames of subscribers. Tasks write files aside; the commit of a batch moves them to
the batch's folder, replacing what an earlier try of that batch left there; an abort removes them.

Folders are opened by Arrow's file systems: local and mounted paths, and the addresses that these know.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

MESSAGE = "producer string, seq long, line long, body string"
FRAME = "subscriber string, place long, frame string"


def opened(path: str) -> tuple[files.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    if "://" in path or path.startswith("file:"):
        return files.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return files.LocalFileSystem(), path


def _replace(system: files.FileSystem, path: str, text: str) -> None:
    aside = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as out:
        out.write(text.encode())
    system.move(aside, path)


def _names(system: files.FileSystem, path: str, prefix: str = "") -> list[str]:
    """Names in a folder that begin with ``prefix``; hidden ones are not there yet."""
    found = system.get_file_info(files.FileSelector(path, allow_not_found=True))
    return sorted(x.base_name for x in found if x.base_name.startswith(prefix) and x.base_name[:1] not in "._")


@dataclass
class Deliveries(InputPartition):
    """Consecutive deliveries of one producer, or one file of one delivery."""

    producer: str
    first: int
    last: int
    #: place of the only file to read; None for all
    file: int | None = None


class InboxReader(DataSourceStreamReader):
    """Options: ``path``; ``most``, the deliveries of each producer that one batch may have more than the batch before
    (all by default); ``progress``, a file of the stream's own that keeps the last offset that was planned, which
    ``most`` needs after a restart; ``split``, deliveries a task (a delivery of several files is a task a file, unless this is given)."""

    def __init__(self, options: dict[str, str]):
        self.path, self.most, self.progress, self.split = options["path"], int(options.get("most", 0)), options.get("progress"), int(options.get("split", 0))
        self.planned: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, root = opened(self.path)
        there = {p.removeprefix("producer="): max((int(s.removeprefix("seq=")) for s in _names(system, f"{root}/{p}", "seq=")), default=-1) for p in _names(system, root, "producer=")}
        if not self.most:
            return {p: n for p, n in there.items() if n >= 0}
        if self.planned is None:
            self.planned = self._kept()
        # the stream has committed this offset or is at most one plan behind it, so this never goes back
        before = self.planned
        self.planned = {p: min(n, before.get(p, -1) + self.most) for p, n in there.items() if n >= 0}
        if self.progress and self.planned != before:
            system, path = opened(self.progress)
            _replace(system, path, json.dumps(self.planned))
        return self.planned

    def _kept(self) -> dict[str, int]:
        if not self.progress:
            return {}
        system, path = opened(self.progress)
        if system.get_file_info(path).type == files.FileType.NotFound:
            return {}
        with system.open_input_stream(path) as f:
            return json.loads(f.read())

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if any(end.get(p, -1) < n for p, n in start.items()):
            raise ValueError("the inbox or its progress went back behind what the stream has read")
        if self.split:
            return [Deliveries(p, at, min(n, at + self.split - 1)) for p, n in sorted(end.items()) for at in range(start.get(p, -1) + 1, n + 1, self.split)]
        system, root = opened(self.path)
        files_of = lambda p, at: range(max(1, len(_names(system, f"{root}/producer={p}/seq={at}"))))
        return [Deliveries(p, at, at, k) for p, n in sorted(end.items()) for at in range(start.get(p, -1) + 1, n + 1) for k in files_of(p, at)]

    def read(self, partition: Deliveries) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.path)
        for seq in range(partition.first, partition.last + 1):
            folder = f"{root}/producer={partition.producer}/seq={seq}"
            for place, name in enumerate(_names(system, folder)):
                if partition.file not in (None, place):
                    continue
                # rises through the files of a delivery without reading those before
                line = place << 40
                with system.open_input_stream(f"{folder}/{name}") as f:
                    for bodies in _lines(f):
                        n = len(bodies)
                        yield pa.RecordBatch.from_arrays([pa.array([partition.producer] * n), pa.array([seq] * n, pa.int64()), pa.array(range(line, line + n), pa.int64()), pa.array(bodies, pa.string())], names=["producer", "seq", "line", "body"])
                        line += n


def _lines(f, size: int = 1 << 20) -> Iterator[list[str]]:
    """The lines of a file, some at a time; bytes that are no UTF-8 become U+FFFD."""
    rest = b""
    while block := f.read(size):
        *whole, rest = (rest + block).split(b"\n")
        if whole:
            yield [x.decode(errors="replace") for x in whole]
    if rest:
        yield [rest.decode(errors="replace")]


class Inbox(DataSource):
    """``spark.readStream.format("inbox")``."""

    @classmethod
    def name(cls) -> str:
        return "inbox"

    def schema(self) -> str:
        return MESSAGE

    def streamReader(self, schema: T.StructType) -> InboxReader:
        return InboxReader(dict(self.options))


@dataclass
class Staged(WriterCommitMessage):
    """A file that a task has written aside, None if it had no frames."""

    name: str | None


class FeedWriter(DataSourceStreamWriter):
    """Frames as JSON lines under ``path/batch=<n>/``."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def write(self, iterator) -> Staged:
        system, root = opened(self.path)
        out, name = None, f"{uuid.uuid4().hex}.json"
        for row in iterator:
            if out is None:
                system.create_dir(f"{root}/_aside", recursive=True)
                out = system.open_output_stream(f"{root}/_aside/{name}")
            out.write((json.dumps(row.asDict(), ensure_ascii=False) + "\n").encode())
        if out is None:
            return Staged(None)
        out.close()
        return Staged(name)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        system, root = opened(self.path)
        names = [m.name for m in messages if m is not None and m.name]
        folder, made = f"{root}/batch={batchId}", f"{root}/_aside/batch-{batchId}-{uuid.uuid4().hex}"
        if names:
            system.create_dir(made, recursive=True)
            for name in names:
                system.move(f"{root}/_aside/{name}", f"{made}/{name}")
        if system.get_file_info(folder).type != files.FileType.NotFound:
            system.delete_dir(folder)
        if names:
            system.move(made, folder)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        system, root = opened(self.path)
        for m in messages:
            path = f"{root}/_aside/{m.name}" if m is not None and m.name else ""
            if path and system.get_file_info(path).type != files.FileType.NotFound:
                system.delete_file(path)


class Feeds(DataSource):
    """``writeStream.format("feeds")`` of (subscriber, place, frame)."""

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return FRAME

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> FeedWriter:
        return FeedWriter(dict(self.options))


def deliver(bodies: DataFrame, path: str, order: list[str], deliveries: int, producer: str = "all", first: int = 0, pieces: int = 1) -> None:
    """Write the column ``body`` as deliveries ``first``, ``first`` + 1, ... of a producer, dealt by ranges of ``order``.

    Each range is one task and one of the ``pieces`` of a delivery, a file, so times rise from one to the next.
    """
    at = F.lit(first) + F.floor(F.spark_partition_id() / F.lit(pieces)).cast("int")
    dealt = bodies.repartitionByRange(deliveries * pieces, *order).sortWithinPartitions(*order).select("body", F.lit(producer).alias("producer"), at.alias("seq"))
    dealt.write.mode("append").partitionBy("producer", "seq").text(path)


def messages(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """The inbox as a stream (producer, seq, line, body)."""
    spark.dataSource.register(Inbox)
    return spark.readStream.format("inbox").options(path=path, **options).load()


# Statuses of an update.
STATUSES = ("queued", "running", "completed", "failed")


def _missing(v: Column, name: str) -> Column:
    """What JavaScript takes for false: absent, null, empty text, zero or false."""
    text, kind = F.try_variant_get(v, f"$.{name}", "string"), F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    return text.isNull() | (text == "") | ((kind != "STRING") & text.isin("0", "false"))


def judged(stream: DataFrame, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """The messages with ``reason`` (null for a valid one: unreadable, missing job, missing status or unknown status)
    and the fields of an update: job_id, step, status, progress, stage, error, at (microseconds, if sent)."""
    v, own = F.col("_v"), [c for c in stream.columns]
    said = stream.withColumn("_v", F.try_parse_json("body"))
    get = lambda name, kind="string": F.try_variant_get(v, f"$.{name}", kind).alias(name)
    readable = v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")
    reason = F.when(~F.coalesce(readable, F.lit(False)), "unreadable").when(_missing(v, "jobId"), "missing job").when(_missing(v, "status"), "missing status").when(~F.try_variant_get(v, "$.status", "string").isin(*statuses), "unknown status")
    return said.select(*own, reason.alias("reason"), get("jobId").alias("job_id"), get("step"), get("status"), get("progress", "double"), get("stage"), get("error"), get("at", "long"))

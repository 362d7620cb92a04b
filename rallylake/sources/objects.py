"""Object trees ``{env}/{user}/{video}/{file}``: listings, probes, fallbacks, whole texts and documents.

A listing is one scan of file metadata; contents are read only where a query asks for them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import deque
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

from rallylake.functions import js
from rallylake.sources import inbox

# The artifacts that an analysis leaves, in the order of its steps.
ARTIFACTS = ("calibration.csv", "pose.json", "positions.json", "corrected_positions.json", "jumps.json", "shuttle.json", "position_analysis.json", "player_names.json", "analyzed_video.mp4")

SHUTTLE = T.MapType(T.StringType(), T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "confidence")]))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """key, file_name, size, modified, file_type of all objects under ``root`` that have content.

    The content column is pruned, so only metadata is read, and no listing is cut short.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/*", "/")
    key = F.expr("substr(p, length(b) + 2)")
    rows = files.where("length > 0").select(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/").alias("p"), base.alias("b"), "length", "modificationTime")
    return rows.select(key.alias("key"), "length", "modificationTime").select("key", file_name(F.col("key")).alias("file_name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), file_type(F.col("key")).alias("file_type"))


def file_name(key: Column) -> Column:
    return F.element_at(F.split(key, "/"), -1)


def file_type(key: Column) -> Column:
    return F.when(F.contains(key, F.lit("/video.")), "video").otherwise("analysis")


def is_video(key: Column, size: Column, user: Column, env: str = "dev") -> Column:
    """What a listing of a user's videos shows: objects with content, named video, in one of two layouts."""
    own = F.startswith(key, F.concat(F.lit(f"{env}/"), user, F.lit("/"))) | F.startswith(key, F.concat(user, F.lit("/")))
    return F.coalesce((size > 0) & ~F.endswith(key, F.lit("/")) & own & F.contains(key, F.lit("/video.")), F.lit(False))


def video_of(key: Column, user: Column, env: str = "dev", stored_name: Column | None = None) -> tuple[Column, Column]:
    """Video id and file name by the layout of a key: ``{env}/{user}/{video}/video.{ext}``,
    ``{user}/{video}/video.{ext}``, ``users/{user}/videos/{millis}-{name}`` (id "existing" without the number),
    or any other (id "unknown"). A name stored with the object goes before that of the key."""
    parts, last = F.split(key, "/"), file_name(key)
    named = F.contains(key, F.lit("/video."))
    new = F.startswith(key, F.concat(F.lit(f"{env}/"), user, F.lit("/"))) & named
    legacy = F.startswith(key, F.concat(user, F.lit("/"))) & named
    old = F.contains(key, F.concat(F.lit("users/"), user, F.lit("/videos/")))
    number, rest = (F.nullif(F.regexp_extract(last, r"^(\d+)-(.+)$", g), F.lit("")) for g in (1, 2))
    video = F.when(new, F.get(parts, F.lit(2))).when(legacy, F.get(parts, F.lit(1))).when(old, F.coalesce(number, F.lit("existing"))).otherwise("unknown")
    name = F.when(old & ~new & ~legacy, F.coalesce(rest, last)).otherwise(last)
    return video, name if stored_name is None else F.coalesce(F.nullif(stored_name, F.lit("")), name)


def locate(key: Column) -> dict[str, Column]:
    """env, user_id, video_id, file_name by place in the key; null where the key is too short."""
    parts = F.split(key, "/")
    return {name: F.get(parts, F.lit(k)) for k, name in enumerate(("env", "user_id", "video_id", "file_name"))}


def present(files: DataFrame, expected: tuple[str, ...] = ARTIFACTS, by: list[str] | None = None) -> DataFrame:
    """One row per group (default: user_id and video_id) with a flag for each expected file: one aggregation
    instead of a probe per file."""
    return files.groupBy(*(by or ["user_id", "video_id"])).agg(*[F.bool_or(F.col("file_name") == x).alias(x) for x in expected])


def first_available(candidates: DataFrame, files: DataFrame, by: list[str], rank: str = "rank", key: str = "key") -> DataFrame:
    """Of ranked candidate keys the first that exists, per ``by``; null where none does.

    The existing candidates are reduced to one per group before the shuffle.
    """
    found = candidates.join(files.select(F.col(key)).distinct(), key, "left_semi").groupBy(*by).agg(F.min_by(key, rank).alias(key))
    return candidates.select(*by).distinct().join(found, by, "left")


def texts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, text: each object read whole, as UTF-8."""
    # an argument, as the reader's own default would take the place of an option
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def parsed(text: Column, schema: T.DataType) -> Column:
    """A lenient parse: valid documents as they are, others after a repair; null for what is no JSON."""
    clean = js.json_text(text)
    return F.when(F.try_parse_json(clean).isNotNull(), F.from_json(clean, schema))


def names_after(stored: Column, update: Column) -> Column:
    """The small key-value document after a write: the update replaces it whole; a missing one is empty."""
    empty = F.from_json(F.lit("{}"), T.MapType(T.StringType(), T.StringType()))
    return F.coalesce(update, stored, empty)


def names_merged(stored: Column, update: Column) -> Column:
    """The stored names with those of the update in their place or added."""
    empty = F.from_json(F.lit("{}"), T.MapType(T.StringType(), T.StringType()))
    stored, update = F.coalesce(stored, empty), F.coalesce(update, empty)
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(update, k)), update)


def shuttle_frames(documents: DataFrame, text: str = "text") -> DataFrame:
    """Rows (frame, x, y, confidence) of documents that map ``frame_N`` to a position; other columns stay."""
    kept = [c for c in documents.columns if c != text]
    rows = documents.select(*kept, F.explode(parsed(F.col(text), SHUTTLE)).alias("name", "at"))
    return rows.select(*kept, F.nullif(F.regexp_extract("name", r"^frame_(\d+)$", 1), F.lit("")).cast("long").alias("frame"), "at.x", "at.y", "at.confidence")


def put(df: DataFrame, root: str, mode: str = "append") -> None:
    """Write rows in folders ``user_id=/video_id=``, by which later reads prune; rows of a folder meet in few files."""
    df.repartition("user_id", "video_id").write.mode(mode).partitionBy("user_id", "video_id").parquet(root)


def without(files: DataFrame, keep: str = "/video.") -> DataFrame:
    """Keys that a reset removes: all but the video itself."""
    return files.where(~F.contains("key", F.lit(keep)))


def variant_fields(df: DataFrame, doc: str) -> DataFrame:
    """``df`` without ``doc``, a row for each field of the variant: field, value (variant) and type. What is no object has no fields."""
    others = [F.col(c) for c in df.columns if c != doc]
    exploded = df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(doc).outer()))
    return exploded.where("key IS NOT NULL").select(*others, F.col("key").alias("field"), "value", F.schema_of_variant("value").alias("type"))


def variant_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(row): every line of CSV files whose columns are unknown, as one variant; with a header an object by its names, else an array of values."""
    return spark.read.option("singleVariantColumn", "row").option("header", header).csv(path)


def artifact_schema(df: DataFrame, doc: str) -> str:
    """The schema that all variants of a column share: fields of some are fields of all, types widen as needed."""
    return df.agg(F.schema_of_variant_agg(doc)).first()[0]


class ObjectLister(DataSourceReader):
    """Objects below a folder: at most ``tasks`` tasks, dealt the subfolders of whatever level has enough of them.

    Planning lists folders from the top, one at a time, until there are ``tasks`` of them, so a single folder at the top,
    or few, do not make for few tasks; it keeps names of folders only. Filters on ``prefix`` (the first part of a key; equal or in a
    list) and on ``key`` (begins with) choose the folders, those on ``key`` and ``size`` (bounds) drop objects before they leave a task.
    """

    def __init__(self, path: str, tasks: int = 200):
        self.path, self.tasks, self.prefixes, self.begins, self.low, self.high = path, tasks, None, [], None, None

    def pushFilters(self, filters):
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if name == "prefix" and isinstance(f, (EqualTo, In)):
                told = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.prefixes = told if self.prefixes is None else self.prefixes & told
            elif name == "key" and isinstance(f, StringStartsWith):
                self.begins.append(f.value)
            elif name == "size" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low or 0, f.value + isinstance(f, GreaterThan))
            elif name == "size" and isinstance(f, (LessThan, LessThanOrEqual)):
                bound = f.value - isinstance(f, LessThan)
                self.high = bound if self.high is None else min(self.high, bound)
            else:
                yield f

    def _may_hold(self, folder: str) -> bool:
        """Whether keys below a folder can pass the filters."""
        if self.prefixes is not None and folder.split("/")[0] not in self.prefixes:
            return False
        return all(f"{folder}/".startswith(b) or b.startswith(f"{folder}/") for b in self.begins)

    def partitions(self):
        system, root = inbox.opened(self.path.rstrip("/") or "/")
        alone, todo = [], deque([""])
        while todo and len(todo) + len(alone) < self.tasks:
            folder = todo.popleft()
            found = system.get_file_info(files.FileSelector(f"{root}/{folder}".rstrip("/") or "/", allow_not_found=True))
            if any(x.type == files.FileType.File for x in found):
                alone.append((folder, False))
            below = sorted(f"{folder}/{x.base_name}".lstrip("/") for x in found if x.type == files.FileType.Directory)
            todo.extend(x for x in below if self._may_hold(x))
        dealt = [*alone, *((folder, True) for folder in todo)]
        return [InputPartition(dealt[k :: self.tasks]) for k in range(min(self.tasks, len(dealt)))]

    def read(self, partition):
        if partition is None:  # nothing is there to list
            return
        system, root = inbox.opened(self.path.rstrip("/") or "/")
        todo = [(f"{root}/{folder}".rstrip("/") or "/", deep) for folder, deep in partition.value]
        while todo:
            folder, deep = todo.pop()
            rows = []
            for x in system.get_file_info(files.FileSelector(folder)):
                key = x.path[len(root.rstrip("/")) + 1 :]
                if x.type == files.FileType.Directory:
                    if deep and self._may_hold(key):
                        todo.append((x.path, True))
                    continue
                prefix = key.split("/")[0] if "/" in key else ""
                if (self.prefixes is None or prefix in self.prefixes) and all(key.startswith(b) for b in self.begins) and (self.low is None or x.size >= self.low) and (self.high is None or x.size <= self.high):
                    rows.append((prefix, key, x.size, x.mtime_ns // 1000))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.timestamp("us", "UTC"))], names=["prefix", "key", "size", "modified"])


@dataclass
class Put(WriterCommitMessage):
    """The file with the properties of what a task has put."""

    aside: str


class ObjectPutter(DataSourceWriter):
    """Writes each row (key, content, content_type, metadata) as an object of its own.

    A task writes an object aside and moves it to its key, so a reader sees the old or the new one, whole, and an attempt that
    is run again puts the same. Properties go to ``{folder}.metadata``, one file a task, which counts when the write is committed.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.id = path.rstrip("/"), f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        if overwrite:
            for folder in (self.path, f"{self.path}.metadata"):
                system, root = inbox.opened(folder)
                system.delete_dir_contents(root, missing_dir_ok=True)

    def write(self, rows) -> Put:
        (system, root), told, made = inbox.opened(self.path), [], set()
        _, beside = inbox.opened(f"{self.path}.metadata")
        system.create_dir(f"{beside}/_aside", recursive=True)
        for row in rows:
            if not row.key or any(part in ("", ".", "..") for part in row.key.split("/")):
                raise ValueError(f"no key of an object: {row.key!r}")
            target, aside = f"{root}/{row.key}", f"{beside}/_aside/{uuid.uuid4().hex}"
            with system.open_output_stream(aside) as out:
                out.write(bytes(row.content or b""))
            folder = target.rsplit("/", 1)[0]
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            system.move(aside, target)
            told.append(json.dumps({"key": row.key, "content_type": row.content_type, "metadata": row.metadata, "place": len(told)}))
        aside = f"{beside}/_aside/{uuid.uuid4().hex}"
        with system.open_output_stream(aside) as out:
            out.write("".join(f"{x}\n" for x in told).encode())
        return Put(aside)

    def commit(self, messages) -> None:
        system, beside = inbox.opened(f"{self.path}.metadata")
        for n, put in enumerate(m for m in messages if m is not None):
            system.move(put.aside, f"{beside}/{self.id}-{n}.json")

    def abort(self, messages) -> None:
        system, _ = inbox.opened(self.path)
        for put in messages:
            if put is not None:
                system.delete_file(put.aside)


class Objects(DataSource):
    """``spark.read.format("objects").load(folder)``: prefix, key, size, modified of every object, of whatever number;
    and ``write.format("objects")`` of (key, content, content_type, metadata)."""

    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return "prefix string, key string, size long, modified timestamp"

    def reader(self, schema) -> ObjectLister:
        return ObjectLister(self.options["path"], int(self.options.get("tasks", 200)))

    def writer(self, schema, overwrite: bool) -> ObjectPutter:
        return ObjectPutter(self.options["path"], overwrite)


def listed(spark: SparkSession, root: str, tasks: int = 200) -> DataFrame:
    """The listing of a folder by up to ``tasks`` tasks; filters on prefix, key and size reach the source where the session lets them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Objects)
    return spark.read.format("objects").option("tasks", tasks).load(root)


PUT = "key string, content binary, content_type string, metadata map<string,string>"


def put_objects(df: DataFrame, root: str, order: list[str] | None = None, mode: str = "append") -> None:
    """Write the rows (key, content and, if there, content_type and metadata) as objects below ``root``.

    A content that is null or absent is empty; an object with the key is replaced. Keys are unique unless ``order`` is given: then of the rows of a key
    the last by ``order`` stays, its rows meeting in one task (a sort that spills, nothing is held).
    """
    df.sparkSession.dataSource.register(Objects)
    if order:
        df = df.repartition("key").sortWithinPartitions("key", *order)
    fields = [F.col(c.name).cast(c.dataType).alias(c.name) if c.name in df.columns else F.lit(None).cast(c.dataType).alias(c.name) for c in T.StructType.fromDDL(PUT)]
    df.select(*fields).write.format("objects").mode(mode).save(root)


def properties(spark: SparkSession, root: str) -> DataFrame:
    """(key, content_type, metadata) of all objects as last put; objects that came another way have none."""
    put = spark.read.schema("key string, content_type string, metadata map<string,string>, place long").json(f"{root.rstrip('/')}.metadata")
    newest = F.max_by(F.struct("content_type", "metadata"), F.struct(F.col("_metadata.file_name"), F.col("place")))
    return put.groupBy("key").agg(newest.alias("p")).select("key", "p.content_type", "p.metadata")


def dealt(keys: DataFrame) -> DataFrame:
    """Rows of a listing dealt evenly: a task of the listing may hold a whole branch."""
    return keys.repartition(4 * keys.sparkSession.sparkContext.defaultParallelism)


def contents(spark: SparkSession, root: str) -> DataFrame:
    """(key, text) of all objects below ``root``, each read whole: listed by tasks and read by the tasks that the keys are dealt to.

    (A file reader would list all folders, a task for a few of them, and keep every object's status at the driver.)
    """
    return fetched(dealt(listed(spark, root).select("key")), root)


def fetched(keys: DataFrame, root: str, key: str = "key", text: str = "text") -> DataFrame:
    """``keys`` with the text of each row's object, null where there is none (or no key): one read a row, in the tasks that
    hold the rows; nothing else below ``root`` is read. Bytes that are no UTF-8 become replacement characters."""
    schema = T.StructType([*keys.schema.fields, T.StructField(text, T.StringType())])

    def read(batches):
        system, base = inbox.opened(root.rstrip("/"))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, found = batch.slice(at, 64), []
                for k in part.column(key).to_pylist():
                    if not k:
                        found.append(None)
                        continue
                    try:
                        with system.open_input_stream(f"{base}/{k}") as f:
                            found.append(f.read().decode("utf-8", "replace"))
                    except FileNotFoundError:
                        found.append(None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], names=schema.fieldNames())

    return keys.mapInArrow(read, schema)

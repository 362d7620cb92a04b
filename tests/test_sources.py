"""Object trees and streams on small folders."""

import json

import pytest
from pyspark.sql import functions as F

from rallylake.sources import objects
from rallylake.streaming import tracking


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("objects")
    for key, content in {
        "prod/u1/v1/video.mp4": "x" * 30,
        "prod/u1/v1/pose.json": "{}",
        "prod/u1/v1/empty.json": "",
        "prod/u1/v2/video.mp4": "yy",
        "prod/u2/v3/shuttle.json": json.dumps({"frame_2": {"x": 1.5, "y": 2, "confidence": 0.5}, "frame_10": {"x": 3, "y": None}}).replace("null", "NaN"),
    }.items():
        at = root / key
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(content)
    return str(root)


def test_listing(spark, tree):
    files = objects.listing(spark, tree)
    found = {r["key"]: (r["file_name"], r["size"], r["file_type"]) for r in files.collect()}
    assert found["prod/u1/v1/video.mp4"] == ("video.mp4", 30, "video")
    assert found["prod/u1/v1/pose.json"] == ("pose.json", 2, "analysis")
    assert len(found) == 4  # the empty object is left out
    located = files.select("key", "file_name", *[c.alias(n) for n, c in objects.locate(F.col("key")).items() if n != "file_name"])
    flags = {r["video_id"]: r.asDict() for r in objects.present(located).collect()}
    assert flags["v1"]["pose.json"] and not flags["v2"]["pose.json"] and flags["v3"]["shuttle.json"]
    assert {r["key"] for r in objects.without(files).collect()} == {"prod/u1/v1/pose.json", "prod/u2/v3/shuttle.json"}


def test_first_available(spark, tree):
    files = objects.listing(spark, tree)
    rows = [("v1", 1, "prod/u1/v1/none"), ("v1", 2, "prod/u1/v1/pose.json"), ("v1", 3, "prod/u1/v1/video.mp4"), ("v9", 1, "prod/u1/v9/video.mp4")]
    found = objects.first_available(spark.createDataFrame(rows, "video string, rank int, key string"), files, ["video"])
    assert {tuple(r) for r in found.collect()} == {("v1", "prod/u1/v1/pose.json"), ("v9", None)}


def test_documents(spark, tree):
    read = objects.texts(spark, tree, "*.json").where("path like '%shuttle.json'")
    frames = sorted(tuple(r) for r in objects.shuttle_frames(read.select("text")).collect())
    assert frames == [(2, 1.5, 2.0, 0.5), (10, 3.0, None, None)]
    rows = spark.sql("SELECT map('1', 'Ann', '2', 'Bo') AS stored, map('2', 'Cy') AS sent UNION ALL SELECT NULL, NULL")
    merged = rows.select(objects.names_merged(F.col("stored"), F.col("sent")).alias("m"), objects.names_after(F.col("stored"), F.col("sent")).alias("a")).collect()
    assert [r["m"] for r in merged] == [{"1": "Ann", "2": "Cy"}, {}] and [r["a"] for r in merged] == [{"2": "Cy"}, {}]


def test_put_prunes_by_folder(spark, tmp_path):
    df = spark.createDataFrame([("u", "v", 1), ("u", "w", 2)], "user_id string, video_id string, x int")
    objects.put(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.where("video_id = 'w'").select("x").first()[0] == 2 and back.count() == 2


def test_streams_give_what_the_batch_gives(spark, small):
    batch = spark.read.parquet(f"{small}/events.parquet")
    stream = lambda: tracking.updates(spark, f"{small}/events.parquet")
    counted = {r["user_id"]: r["updates"] for r in tracking.drained(tracking.counts(stream()), "counts").collect()}
    assert counted == {r["user_id"]: r["count"] for r in batch.groupBy("user_id").count().collect()}
    last = {r["user_id"]: r["event_id"] for r in tracking.drained(tracking.latest(stream()), "latest").collect()}
    assert last == {r["user_id"]: r["e"] for r in batch.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e")).collect()}


def test_state_crosses_batches_and_listeners_are_apart(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    path = f"{tmp_path}/events.parquet"
    events.repartition(5, "event_id").write.parquet(path)
    stream = lambda: tracking.updates(spark, path, 1)
    assert {tuple(r) for r in tracking.drained(tracking.counts(stream()), "counts").collect()} == {tuple(r) for r in events.groupBy("user_id").count().collect()}
    seen = []

    def picky(batch):
        seen.append(batch.count())
        if len(seen) % 2:
            raise KeyError("odd batches")
        return batch

    told = tracking.fan_out(stream(), {"picky": picky, "all": lambda x: x}, "fan").collect()
    assert sum(r["rows"] for r in told if r["listener"] == "all") == events.count() and len(seen) == 5
    assert [r["error"] for r in sorted(told, key=lambda r: r["batch"]) if r["listener"] == "picky"] == ["KeyError", None, "KeyError", None, "KeyError"]


def test_watch_ends_when_done_or_late(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").limit(300)
    path = f"{tmp_path}/events.parquet"
    events.repartition(6).write.parquet(path)
    looks = []

    def done(seen):
        looks.append(seen.count())
        if len(looks) == 1:
            raise ValueError("a look that fails")
        return looks[-1] >= 100

    push = lambda: tracking.updates(spark, path, 1)
    got, how = tracking.watched(push(), done, "watch", every="100 milliseconds", timeout_s=60)
    assert how == "done" and 100 <= got.count() <= 300 and len(looks) > 1
    got, how = tracking.watched(push(), lambda _: False, "watch", every="100 milliseconds", timeout_s=6)
    assert how == "late" and got.count() == 300
    # a source that goes quiet, or fails, is replaced by the poll
    quiet = tracking.updates(spark, path, 1).where("event_id < 0")
    got, how = tracking.watched(quiet, lambda x: x.count() >= 100, "watch", push, "100 milliseconds", quiet_s=5, timeout_s=60)
    assert how == "polled" and got.count() >= 100
    broken = push().withColumn("value", F.raise_error(F.lit("gone")).cast("double"))
    got, how = tracking.watched(broken, lambda x: x.count() >= 100, "watch", push, "100 milliseconds", quiet_s=20, timeout_s=60)
    assert how == "polled" and got.count() >= 100
    assert tracking.watched(broken, lambda x: True, "watch", every="100 milliseconds", timeout_s=30)[1] == "ended"

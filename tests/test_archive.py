"""Objects put, listed and read; rows inserted with an answer; single rows for many keys; write checks by row."""

import os

import pytest
from pyspark.sql import functions as F

from rallylake.operators import relational as R
from rallylake.operators import security
from rallylake.plans.archive import write_checks  # noqa: F401  the module's queries are compared with SQL in test_oracles
from rallylake.sources import objects, store


def put(spark, rows, root, **options):
    objects.put_objects(spark.createDataFrame(rows, "key string, content binary, content_type string, metadata map<string,string>, n int"), root, **options)


def told(spark, root):
    return {r["key"]: (r["content_type"], r["metadata"]) for r in objects.properties(spark, root).collect()}


def test_objects_are_put_replaced_listed_and_read_whole(spark, tmp_path):
    root = str(tmp_path / "archive")
    long = b"line\nline\r\n" * 20_000
    put(spark, [("a/b c+d%.txt", "é\n\nx".encode(), "text/plain", {"k": "v"}, 1), ("a/empty", None, None, None, 1), ("top", long, "x", {}, 1)], root)
    put(spark, [("a/b c+d%.txt", b"new\n", "text/html", {"k": "w"}, 1)], root)
    assert told(spark, root) == {"a/b c+d%.txt": ("text/html", {"k": "w"}), "a/empty": (None, None), "top": ("x", {})}
    assert {r["key"]: r["size"] for r in objects.listed(spark, root).collect()} == {"a/b c+d%.txt": 4, "a/empty": 0, "top": len(long)}
    read = {r["key"]: r["text"] for r in objects.contents(spark, root).collect()}
    # one row an object, whatever lines it has
    assert (read["a/b c+d%.txt"], read["top"]) == ("new\n", long.decode()) and objects.contents(spark, root).count() == len(read)


def test_of_rows_of_a_key_the_last_by_order_is_put(spark, tmp_path):
    root = str(tmp_path / "archive")
    rows = [(f"k{n % 3}", str(n).encode(), None, {"n": str(n)}, n) for n in range(60)]
    put(spark, rows[::-1], root, order=["n"])
    assert {r["key"]: r["text"] for r in objects.contents(spark, root).collect()} == {"k0": "57", "k1": "58", "k2": "59"}
    assert {k: m["n"] for k, (_, m) in told(spark, root).items()} == {"k0": "57", "k1": "58", "k2": "59"}


@pytest.mark.parametrize("key", ["", None, "../out", "a//b", "/abs", "a/."])
def test_a_key_that_leaves_the_folder_or_is_empty_is_refused(spark, tmp_path, key):
    root = str(tmp_path / "archive")
    with pytest.raises(Exception, match="no key of an object"):
        put(spark, [(key, b"x", None, None, 1)], root)
    assert not os.path.exists(tmp_path / "out")


def test_an_overwrite_leaves_only_its_own_objects_and_an_empty_put_none(spark, tmp_path):
    root = str(tmp_path / "archive")
    put(spark, [("a", b"1", "x", None, 1), ("b", b"2", "x", None, 1)], root)
    put(spark, [("c", b"3", "y", None, 1)], root, mode="overwrite")
    assert [r["key"] for r in objects.listed(spark, root).collect()] == ["c"] and list(told(spark, root)) == ["c"]
    put(spark, [], root)
    assert list(told(spark, root)) == ["c"]


def test_fetched_reads_what_is_asked_for_and_keeps_other_columns(spark, tmp_path):
    root = str(tmp_path / "archive")
    put(spark, [("a", "ä".encode(), None, None, 1), ("b", b"\xff", None, None, 1)], root)
    asked = spark.createDataFrame([("a", 1), ("b", 2), ("none", 3), (None, 4), ("a", 5), ("", 6)], "key string, n int")
    assert {r["n"]: r["text"] for r in objects.fetched(asked, root).collect()} == {1: "ä", 2: "�", 3: None, 4: None, 5: "ä", 6: None}
    assert objects.fetched(asked.limit(0), root).count() == 0


def stored(spark, tmp_path):
    return store.Store(spark, str(tmp_path / "table"), "id long, v string", "id", parts=4)


def answer(df):
    return sorted((r["id"], r["v"], r["inserted"]) for r in df.collect())


def test_an_insert_answers_with_stored_rows_and_the_same_when_sent_again(spark, tmp_path):
    table = stored(spark, tmp_path)
    table.upsert(spark.createDataFrame([(1, "old")], "id long, v string"), "a")
    new = spark.createDataFrame([(1, "new"), (2, "x"), (2, "y"), (None, "z")], "id long, v string")
    want = [(1, "old", False), (2, "y", True)]
    assert answer(table.insert(new, "b")) == want
    # what happens later does not change the answer, nor does a repeat change the table
    table.delete(spark.createDataFrame([(2,)], "id long"), "c")
    assert answer(table.insert(new, "b")) == want
    assert sorted(map(tuple, table.rows().collect())) == [(1, "old")]
    assert answer(table.insert(new.limit(0), "d")) == []


def test_an_insert_cut_off_before_its_marker_gives_the_same(spark, tmp_path):
    table = stored(spark, tmp_path)
    new = spark.createDataFrame([(5, "x")], "id long, v string")
    want = answer(table.insert(new, "b"))
    os.remove(tmp_path / "table" / "_batches" / "b")
    assert answer(table.insert(new, "b")) == want == [(5, "x", True)] and table.rows().count() == 1


def test_single_rows_for_many_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c")], "id long, v string")
    asked = spark.createDataFrame([(1,), (2,), (3,), (None,), (1,)], "id long")
    found = R.single_each(asked, rows, "id").select("id", F.col("row.v").alias("v")).collect()
    assert sorted(((r["id"], r["v"]) for r in found), key=str) == sorted([(1, "a"), (1, "a"), (2, None), (3, None), (None, None)], key=str)


def test_write_checks_by_row(spark):
    rows = spark.createDataFrame([(7,), (8,), (None,)], "user_id long")
    allowed = lambda policy, who: [r["ok"] for r in rows.select(security.writable(policy, who).alias("ok")).collect()]
    assert allowed("videos", security.Context(7)) == [True, False, False]
    assert allowed("usage_records", security.Context(7)) == [False] * 3 == allowed("videos", security.Context())
    assert allowed("usage_records", security.Context(bypass=True)) == [True] * 3 == allowed("videos", security.Context(1, "admin"))
    with pytest.raises(PermissionError):
        security.write_check(rows, "videos", security.Context(7))


def test_a_single_folder_at_the_top_is_listed_by_many_tasks(spark, tmp_path):
    want = {}
    for user in range(6):
        for video in range(3):
            folder = tmp_path / "dev" / f"u{user}" / f"v{video}" / "deep"
            folder.mkdir(parents=True)
            for path in (folder / "a.json", folder.parent / "video.mp4"):
                path.write_bytes(b"x" * (user + 1))
                want[str(path.relative_to(tmp_path))] = user + 1
    (tmp_path / "dev" / "note").write_bytes(b"1")
    (tmp_path / "top").write_bytes(b"1")
    (tmp_path / "dev" / "empty").mkdir()
    want |= {"dev/note": 1, "top": 1}
    for tasks in (1, 2, 5, 8, 200):
        df = objects.listed(spark, str(tmp_path), tasks)
        # every object once, whatever level the tasks are dealt at
        assert sorted((r["key"], r["size"]) for r in df.collect()) == sorted(want.items()), tasks
        assert {r["prefix"] for r in df.collect()} == {"dev", ""}
        assert min(tasks, 6) <= df.rdd.getNumPartitions() <= tasks
        assert {r["key"] for r in df.where("prefix = ''").collect()} == {"top"} and df.where("prefix = 'dev' and size > 5").count() == 6
        for begins in ("dev/u1", "dev/u1/", "dev/u1/v2/d", "de", "dev/note", "t", "none"):
            found = df.where(F.startswith("key", F.lit(begins)))
            assert {r["key"] for r in found.collect()} == {k for k in want if k.startswith(begins)}, (tasks, begins)
    assert objects.listed(spark, str(tmp_path)).where("startswith(key, 'dev/u1/')").rdd.getNumPartitions() < 10


def test_contents_are_read_by_the_tasks_of_a_listing(spark, tmp_path):
    """No reader of files lists the folders or keeps their objects at the driver."""
    root = f"{tmp_path}/objects"
    objects.put_objects(spark.range(30).selectExpr("concat('u', id % 3, '/v', id, '/_x.txt') AS key", "CAST(CAST(id AS STRING) AS BINARY) AS content"), root)
    read = objects.contents(spark, root)
    assert read.inputFiles() == []
    assert {r["key"]: r["text"] for r in read.collect()} == {f"u{k % 3}/v{k}/_x.txt": str(k) for k in range(30)}

"""Tables changed in place, first rows by group, locale order, and artifacts of unknown columns."""

import glob
import os
import random

from pyspark.sql import functions as F

from rallylake.operators import relational as R
from rallylake.sources import objects, store

SCHEMA = "id long, name string, n long"


def files(path):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/part=*/*.parquet")}


def test_changes_rewrite_only_their_partitions_and_only_once(spark, tmp_path):
    table = store.Store(spark, f"{tmp_path}/t", SCHEMA, "id", parts=8)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert table.rows().collect() == []
    rng, want = random.Random(1), {}
    for step in range(6):
        rows = [(rng.randrange(40), rng.choice("abc"), rng.randrange(9)) for _ in range(3 if step else 60)]
        before = files(table.path)
        if step == 3:
            assert table.delete(frame(rows), f"b{step}")
            want = {k: v for k, v in want.items() if k not in {r[0] for r in rows}}
        elif step == 4:
            assert table.update(frame(rows), {"name": F.upper("name")}, f"b{step}")
            want |= {r[0]: (want[r[0]][0].upper(), want[r[0]][1]) for r in rows if r[0] in want}
        else:
            assert table.upsert(frame(rows), f"b{step}")
            want |= {r[0]: max((x[1], x[2]) for x in rows if x[0] == r[0]) for r in rows}
        after = files(table.path)
        assert {r["id"]: (r["name"], r["n"]) for r in table.rows().collect()} == want
        if step:  # at most one partition a key has new files, the others' are the same
            gone = {os.path.dirname(p) for p in before if p not in after}
            assert len(gone) <= 3 and all(after[p] == before[p] for p in before if os.path.dirname(p) not in gone)
        # the same batch again changes no file
        assert not table.upsert(frame([(1, "again", 0)]), f"b{step}") and files(table.path) == after


def test_a_partition_may_become_empty_and_a_cut_off_batch_runs_again(spark, tmp_path):
    table = store.Store(spark, f"{tmp_path}/t", SCHEMA, "id", parts=2)
    rows = spark.createDataFrame([(k, "x", k) for k in range(6)] + [(None, "none", 0)], SCHEMA)
    table.upsert(rows, "load")
    assert table.rows().count() == 6  # a row without a key is none
    for _ in range(2):
        assert table.delete(rows, "clear")
        assert table.rows().count() == 0
        # as if the marker had not been written
        os.remove(f"{table.path}/_batches/clear")
    table.upsert(rows.where("id < 2"), "some")
    assert sorted(r["id"] for r in table.rows().collect()) == [0, 1]


def test_first_rows_of_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot", "hot"]), rng.randrange(50), k) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, v int, k int").repartition(7)
    for k in (1, 10, 5000):
        got = sorted(tuple(r) for r in R.bottom_k(df, ["g"], ["v", "k"], k).collect() if r["g"] is not None)
        assert got == sorted(x for g in ("a", "b", "hot") for x in sorted(r for r in rows if r[0] == g)[:k])
    assert R.bottom_k(df, ["g"], ["v", "k"], 3).where("g is null").count() == 3
    assert R.bottom_k(df.limit(0), ["g"], ["v", "k"], 3).count() == 0


def test_names_in_locale_order(spark):
    want = ["_a", "a", "A", "á", "ab", "Ab", "b", "B", "é", "z", "Z"]
    df = spark.createDataFrame([(x,) for x in sorted(want)], "name string")
    assert [r["name"] for r in df.orderBy(R.by_name(F.col("name"))).collect()] == want
    # without case, texts that differ in it alone are one
    assert df.groupBy(R.by_name(F.col("name"), True)).count().count() == 7
    pairs = df.alias("x").join(df.alias("y"), R.by_name(F.col("x.name"), True) == R.by_name(F.col("y.name"), True))
    assert pairs.where("x.name = 'ab'").count() == 2


def test_artifacts_of_unknown_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, '{"a": 1, "b": {"c": 2.5}}'), (2, '{"a": "x", "d": [1, 2]}'), (3, "no json"), (4, "[1]"), (5, None), (6, "{}")], "id int, t string").select("id", F.try_parse_json("t").alias("doc"))
    assert sorted((r["id"], r["field"], r["type"]) for r in objects.variant_fields(docs, "doc").collect()) == [(1, "a", "BIGINT"), (1, "b", "OBJECT<c: DECIMAL(2,1)>"), (2, "a", "STRING"), (2, "d", "ARRAY<BIGINT>")]
    schema = objects.artifact_schema(docs.where("id in (1, 2)"), "doc")
    assert schema == "OBJECT<a: VARIANT, b: OBJECT<c: DECIMAL(2,1)>, d: ARRAY<BIGINT>>"
    (tmp_path / "calibration.csv").write_text("point,x,y\nnet,1.5,2\ncorner,3,\n")
    rows = objects.variant_csv(spark, str(tmp_path)).select(F.variant_get("row", "$.point", "string").alias("p"), F.try_variant_get("row", "$.x", "double").alias("x")).collect()
    assert sorted(tuple(r) for r in rows) == [("corner", 3.0), ("net", 1.5)]


def test_objects_are_listed_in_parallel_with_pushed_filters(spark, tmp_path):
    want = {}
    for k in range(60):
        key = f"u{k % 4}/v{k % 7}/{'x/' * (k % 3)}f{k}.json" if k % 10 else f"top{k}.txt"
        path = tmp_path / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * k)
        want[key] = k
    df = objects.listed(spark, str(tmp_path))
    assert {r["key"]: r["size"] for r in df.collect()} == want and df.rdd.getNumPartitions() >= 5
    assert all(r["prefix"] == (r["key"].split("/")[0] if "/" in r["key"] else "") for r in df.collect())
    for condition, keep in {
        "prefix = 'u1'": lambda k: k.startswith("u1/"), "prefix in ('u1', 'u2') and size > 20": lambda k: k[:2] in ("u1", "u2") and want[k] > 20, "size >= 10 and size < 12": lambda k: 10 <= want[k] < 12,
        "startswith(key, 'u1/v')": lambda k: k.startswith("u1/v"), "startswith(key, 'u')": lambda k: k.startswith("u"), "startswith(key, 'top')": lambda k: k.startswith("top"), "key like '%5.json'": lambda k: k.endswith("5.json"),
    }.items():
        assert {r["key"] for r in df.where(condition).collect()} == {k for k in want if keep(k)}, condition
    assert df.where("prefix = 'u1'").rdd.getNumPartitions() < df.rdd.getNumPartitions()
    assert objects.listed(spark, f"{tmp_path}/none").collect() == []

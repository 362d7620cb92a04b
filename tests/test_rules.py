"""Golden tables of the rules and of the functions with JavaScript semantics."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rallylake.functions import js
from rallylake.operators import jobs, metering, security
from rallylake.operators import relational as R
from rallylake.plans import registry
from rallylake.sources import schemas


def one(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"id int, {schema}").orderBy("id").select(*columns).collect()]


@pytest.mark.parametrize(
    ("present", "step", "progress"),
    [
        ((), "Queued for Analysis", 0),
        (("video.mp4",), "Court Detection", 5),
        (("calibration.csv",), "Detecting Poses", 10),
        (("pose.json",), "Calculating Positions", 25),
        (("positions.json",), "Removing Artifacts", 40),
        (("jumps.json",), "Tracking Shuttlecock", 55),
        (("shuttle.json", "pose.json"), "Analyzing Positions", 70),
        (("position_analysis.json",), "Generating Visualization", 85),
        (("analyzed_video.mp4", "video.mp4"), "Analysis Complete", 100),
    ],
)
def test_status_ladder(spark, present, step, progress):
    found = jobs.ladder({x[0]: F.lit(x[0] in present) for x in jobs.LADDER})
    assert tuple(spark.range(1).select(*found).first()) == (step, progress)


def test_log_step_takes_the_last_place_of_the_first_literal(spark):
    logs = ["", "STEP 1: court", "STEP 2: a STEP 3: b", "STEP 3: b then step 3: again STEP 1: back", "Shuttle Tracking ... Jump Detection", "visualization and Visualization"]
    found = one(spark, "log string", [(x,) for x in logs], *jobs.log_step(F.col("log")))
    assert [(x[0], x[2]) for x in found] == [(None, 0), ("calibration", 15), ("shuttle", 80), ("calibration", 15), ("pose_position_artifacts", 70), ("visualization", 90)]
    assert found[2][1] == "Detecting shuttlecock positions..." and found[0][1] is None


def test_health_and_retry_rules(spark):
    rows = [("COMPLETED", True), ("COMPLETED", False), ("FAILED", False), ("TIMED_OUT", False), ("CANCELLED", False), ("IN_PROGRESS", False), ("UNKNOWN", False)]
    found = one(spark, "s string, o boolean", rows, *jobs.health(F.col("s"), F.col("o")).values())
    assert found == [(False, True, False, False), (False, False, True, True), (False, False, True, True), (False, False, True, True), (False, False, False, False), (True, False, False, False), (False, False, False, False)]
    again = one(spark, "s string, n int", [("failed", 2), ("failed", 3), ("running", 0), ("worker_died", 0)], jobs.retry_eligible(F.col("s"), F.col("n")))
    assert [x[0] for x in again] == [True, False, False, True]


def test_numbers(spark):
    rows = [(-2.5,), (2.5,), (0.0,), (1.006,)]
    assert one(spark, "x double", rows, js.js_round(F.col("x"))) == [(-2,), (3,), (0,), (1,)]
    fixed = [(1.005, "1.00"), (1.115, "1.11"), (0.125, "0.13"), (-0.125, "-0.13"), (2.675, "2.67"), (1.006, "1.01"), (0.0, "0.00"), (-0.001, "-0.00"), (0.995, "0.99"), (0.996, "1.00"), (123456789.995, "123456790.00"), (1e17, "100000000000000000.00"), (float("nan"), "NaN"), (float("inf"), "Infinity"), (None, None)]
    assert one(spark, "x double", [(x,) for x, _ in fixed], js.fixed2(F.col("x"))) == [(y,) for _, y in fixed]
    assert one(spark, "x double", [(0.5,), (1.5,), (2.25,)], js.to_fixed(F.col("x"), 0), js.to_fixed(F.col("x"), 1)) == [("1", "0.5"), ("2", "1.5"), ("2", "2.3")]
    assert one(spark, "x double", [(None,), (0.0,), (float("nan"),), (4.0,)], js.or_default(F.col("x"), F.lit(7.0))) == [(7.0,), (7.0,), (7.0,), (4.0,)]
    assert one(spark, "n long", [(0,), (1536,), (1 << 20,), (5,), (1 << 30,)], js.human_bytes(F.col("n"))) == [("0 Bytes",), ("1.5 KB",), ("1 MB",), ("5 Bytes",), ("1 GB",)]
    assert one(spark, "x double", [(59.9,), (61.0,), (0.0,)], js.mmss(F.col("x"))) == [("0:59",), ("1:01",), ("0:00",)]
    assert one(spark, "x string", [("12px",), (" -3.9",), ("abc",), (None,)], js.parse_int(F.col("x"))) == [(12,), (-3,), (None,), (None,)]


def test_fixed_is_the_exact_decimal(spark):
    """Against Python's decimals of the exact binary value, halves away from zero."""
    from decimal import ROUND_HALF_UP

    values = [k / 1000 for k in range(-2000, 9000)] + [k / 200 + 1000 for k in range(500)] + [k / 128 * 1e6 for k in range(500)] + [1e-5 * k for k in range(300)]
    found = [r[0] for r in spark.createDataFrame(list(enumerate(values)), "id int, x double").orderBy("id").select(js.fixed2(F.col("x"))).collect()]
    assert found == [f"{'-' if x < 0 else ''}{abs(Decimal(x)).quantize(Decimal('0.01'), ROUND_HALF_UP)}" for x in values]


def test_labels_and_rules(spark):
    texts = [("player_3",), ("x PLAYER_12y",), ("guest",)]
    assert one(spark, "x string", texts, js.player_label(F.col("x")), js.player_label(F.col("x"), short=True)) == [("Player 3", "P3"), ("Player 12", "P12"), ("guest", "GUEST")]
    assert one(spark, "x string", [("jobId",), ("aVeryLongFieldName",)], js.field_label(F.col("x"))) == [("Job Id        ",), ("A Very Long Field Name",)]
    assert one(spark, "x double", [(59.4,), (59.6,), (61.0,), (119.7,)], js.long_time(F.col("x"))) == [("59s",), ("60s",), ("1m 1s",), ("1m 60s",)]
    assert one(spark, "x string", [("12.5px",), (" -.5e1x",), ("abc",), ("Infinity",), ("1.2.3",), (None,)], js.parse_float(F.col("x"))) == [(12.5,), (-5.0,), (None,), (float("inf"),), (1.2,), (None,)]
    assert one(spark, "x string", [(None,), ("",), ("your_key",), ("put_here",), ("real",)], js.setting_missing(F.col("x"))) == [(True,), (True,), (True,), (True,), (False,)]
    rows = [("image/png", 5242880), ("image/png", 5242881), ("video/mp4", 1), (None, 1)]
    assert one(spark, "m string, n long", rows, js.media_accepted(F.col("m"), F.col("n")), js.is_video(F.col("m"))) == [(True, False), (False, False), (False, True), (False, False)]
    assert one(spark, "x double", [(10.0,), (1.0,)], js.capture_time(F.col("x"))) == [(2.0,), (0.0,)]
    assert one(spark, "x long", [(0,), (1700000000,)], js.iso_seconds(F.col("x"))) == [("1970-01-01T00:00:00.000Z",), ("2023-11-14T22:13:20.000Z",)]
    assert one(spark, "x int", [(12,), (13,), (50,), (93,)], jobs.stage_index(F.col("x"), jobs.LONG_STAGES)) == [(0,), (1,), (2,), (7,)]
    raw = [('{"a": NaN}',), ('{"s": "x: NaN"}',), ("[NaN]",), ('{"a": -Infinity, "b": "y"}',)]
    assert one(spark, "x string", raw, js.json_text(F.col("x"))) == [('{"a": null}',), ('{"s": "x: NaN"}',), ("[NaN]",), ('{"a": null, "b": "y"}',)]
    assert [x[0] for x in one(spark, "s string", [("active",), ("trialing",), ("past_due",), (None,)], metering.payment_status(F.col("s")))] == ["active", "incomplete", "past_due", "incomplete"]


def test_updates_touch_what_they_change(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, None, 30)], "id int, s string, updated_at int")
    out = R.touched(rows, F.col("s") == "a", {"s": F.lit("z")}, F.lit(99))
    assert sorted(map(tuple, out.collect())) == [(1, "z", 99), (2, "b", 20), (3, None, 30)]
    assert R.inserted(rows, str(tmp_path / "t")).count() == 3 and spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_subscriptions_without_a_checkout(spark):
    events = spark.createDataFrame([("a", 1, "deleted"), ("a", 2, "updated"), ("a", 3, "usage"), ("b", 1, "usage"), ("b", 2, "checkout"), ("b", 3, "usage"), ("b", 4, "deleted"), ("b", 5, "updated")], "k string, n int, kind string")
    events = events.select("k", F.struct("n").alias("place"), "kind", F.lit("PRO").alias("plan"), F.lit("trialing").alias("status"), F.lit(7).alias("minutes"), F.col("n").alias("period_start"))
    assert sorted(map(tuple, metering.subscriptions(events, "k").collect())) == [("a", "FREE", "active", 300, 7, None), ("b", "FREE", "incomplete", 300, 0, 5)]


def test_document_holds_every_group(spark, small):
    import json

    documents = {r["player"]: json.loads(r["document"])["players"] for r in registry.QUERIES["mv_document"](spark, small).collect()}
    fields = {r["player"]: r for r in registry.QUERIES["mv_document_fields"](spark, small).collect()}
    assert set(documents) == set(fields)
    for player, document in documents.items():
        (own,) = document.values()
        assert list(document) == [f"player_{player}"]
        assert set(own["positioning_strategy"]) == {"offensive_defensive", "left_right_bias", "predictive_positioning"} and own["positioning_strategy"]["predictive_positioning"] == {"anticipation_score": None}
        assert own["rally_dynamics"]["jump_pattern"]["error"] is None and own["rally_dynamics"]["jump_pattern"]["total_jumps"] == fields[player]["total_jumps"]
        assert own["movement_efficiency"]["return_to_center"]["average_return_time_s"] == fields[player]["average_return_time_s"]
    one_sample = spark.sql("SELECT 1 AS player, timestamp_ntz'2024-01-01' AS t, 1 AS sample, 1D AS x, 1D AS y, 'click' AS event_type")
    from rallylake.operators import movement

    assert movement.document(one_sample, F.lit(True)).first()["rally_dynamics"]["jump_pattern"]["error"] == "no time tracked"


def test_texts(spark):
    assert one(spark, "x string", [(" Hello, World ",), ("",)], js.slugify(F.col("x"))) == [("-hello-world-",), ("",)]
    assert one(spark, "x string", [("a[1]/b?.mp4",)], js.sanitize_name(F.col("x"))) == [("a(1)-b_.mp4",)]
    assert one(spark, "x string", [("",), ("a " * 199 + "a",), ("a " * 200 + "a",)], js.reading_minutes(F.col("x"))) == [(1,), (1,), (2,)]
    assert one(spark, "x string", [("a_b_c",), ("abc",)], js.replace_first(F.col("x"), "_", " ")) == [("a b_c",), ("abc",)]
    assert one(spark, "x string", [("bytes=0-",), ("bytes=x",), ("bytes=3-10",)], *js.byte_range(F.col("x"), F.lit(10).cast("long"))) == [(206, 0, 9), (416, None, None), (416, None, None)]


def test_every_is_true_for_no_rows(spark):
    assert spark.range(0).agg(R.every(F.col("id") > 5)).first()[0] is True


def test_single(spark):
    assert R.single(spark.range(1)).count() == 1
    for n in (0, 2):
        with pytest.raises(ValueError, match="row"):
            R.single(spark.range(n))


def test_upsert_leaves_what_an_update_does_not_name(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, s string, t string")
    updates = spark.createDataFrame([(2, None, "z"), (3, "c", None)], "id int, s string, t string")
    assert sorted(map(tuple, R.upsert(base, updates, "id").collect())) == [(1, "a", "x"), (2, "b", "z"), (3, "c", None)]


def test_quota_fold_lets_smaller_records_through(spark):
    rows = [("a", 1, 5, 0), ("a", 2, 20, 0), ("a", 3, 4, 0), ("a", 4, 1, 0), ("a", 5, 1, 0), ("b", 1, None, 0), ("b", 2, 99, None), (None, 1, 10, 0)]
    out = metering.quota_fold(spark.createDataFrame(rows, "k string, t int, m int, inc int"), "k", "m", "inc", ["t"], bound=10)
    found = {(r["k"], r["t"]): (r["accepted"], r["used"]) for r in out.collect()}
    assert found == {("a", 1): (True, 5), ("a", 2): (False, None), ("a", 3): (True, 9), ("a", 4): (True, 10), ("a", 5): (False, 10), ("b", 1): (True, 0), ("b", 2): (True, 99), (None, 1): (True, 10)}
    assert metering.quota_fold(out.limit(0).select("k", "t", "m", "inc"), "k", "m", "inc", ["t"]).count() == 0


def test_policies(spark):
    videos = spark.createDataFrame([(1, "u", None), (2, "u", "2024-01-01"), (3, "v", None), (4, None, None)], "id int, user_id string, deleted_at string")
    seen = lambda who: sorted(r["id"] for r in security.secured(videos, "videos", who).collect())
    assert seen(security.Context("u")) == [1]
    assert seen(security.Context("u", "super_admin")) == seen(security.Context(bypass=True)) == [1, 2, 3, 4]
    assert seen(security.Context()) == []
    posts = spark.createDataFrame([(1, "a", "draft"), (2, "b", "published")], "id int, author_id string, status string")
    assert [r["id"] for r in security.secured(posts, "blog_posts", security.Context()).collect()] == [2]
    own = videos.where("user_id = 'u'")
    assert security.write_check(own, "videos", security.Context("u")) is own
    for who in (security.Context("v"), security.Context()):
        with pytest.raises(PermissionError):
            security.write_check(own, "videos", who)
    before, after = (spark.createDataFrame([(1, r)], "id int, role string") for r in ("user", "admin"))
    assert security.role_unchanged(before, after).count() == 1 and security.role_unchanged(before, before).count() == 0


def test_schemas(spark):
    for table in schemas.TABLES:
        assert spark.createDataFrame([], schemas.schema(table)).count() == 0
    rows = spark.createDataFrame([("s", Decimal(10), Decimal(4)), ("t", Decimal(10), Decimal(14))], "id string, minutes_included decimal(10,2), minutes_used decimal(10,2)")
    assert [(float(r[0]), float(r[1])) for r in schemas.with_generated(rows).orderBy("id").select("minutes_remaining", "overage_minutes").collect()] == [(6.0, 0.0), (0.0, 4.0)]
    assert schemas.evolved(spark.range(1), spark.range(1).withColumn("added", F.lit(1))).where("added is null").count() == 1
    profiles = spark.createDataFrame([("user",), ("owner",), (None,)], "role string")
    assert [tuple(r) for r in schemas.enum_violations(profiles, "user_profiles").collect()] == [("role", 1)]


def test_retry_chain_follows_long_chains(spark, tmp_path):
    rows = spark.range(150).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 150 - id) AS ts", "id % 2 AS user_id", "'error' AS event_type", "0D AS value", "'{}' AS props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    found = registry.QUERIES["retry_chain"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r[c] for c in ("event_id", "user_id", "parent", "depth", "root")) for r in found) == [(k, k % 2, k + 2 if k < 148 else None, (149 - k) // 2, 148 + k % 2) for k in range(150)]


def test_sql_functions_of_roles_and_metering(spark):
    from rallylake.operators import sqlfunctions

    spark.createDataFrame([("a", "admin"), ("b", "user"), ("s", "super_admin")], "id string, role string").createOrReplaceTempView("user_profiles")
    spark.createDataFrame([("a", "active", 300, 100), ("b", "active", 300, 6200), ("c", "canceled", 1, 1)], "user_id string, status string, minutes_included long, minutes_used long").createOrReplaceTempView("subscriptions")
    sqlfunctions.register(spark)
    roles = spark.sql("SELECT x, is_admin(x), is_super_admin(x) FROM VALUES ('a'), ('b'), ('s'), ('none'), (null) AS t(x)").collect()
    assert {tuple(r) for r in roles} == {("a", True, False), ("b", False, False), ("s", True, True), ("none", False, False), (None, False, False)}
    answers = spark.sql("SELECT x, u.* FROM VALUES ('a'), ('b'), ('c') AS t(x), LATERAL usage_answer(x, 250) u").collect()
    # the bound itself is allowed, one more is not, and nobody without an active subscription has an answer
    assert {tuple(r) for r in answers} == {("a", True, 350, 0, 50, None), ("b", False, 6200, 0, 5900, "overage limit exceeded")}
    assert [r["success"] for r in spark.sql("SELECT * FROM usage_answer('a', 6200)").collect()] == [True]
    assert [r["success"] for r in spark.sql("SELECT * FROM usage_answer('a', 6201)").collect()] == [False]


def test_text_rules_on_white_space_long_numbers_and_characters_of_two_units(spark):
    x, n = F.col("x"), F.lit(10).cast("long")
    wide = "\U0001f600" * 128
    assert one(spark, "x string", [("a\u00a0\u2003b",), ("\ufeff a \t",), ("",), (None,)], js.sanitize_name(x)) == [("a b",), ("a",), ("",), (None,)]
    names = [("a",), ("\u00a0\u3000 ",), ("",), (None,), ("a" * 255,), ("a" * 255 + " ",), (wide,), (wide[1:],)]
    assert one(spark, "x string", names, js.valid_name(x), js.utf16_length(x)) == [(True, 1), (False, 3), (False, 0), (False, None), (True, 255), (False, 256), (False, 256), (True, 254)]
    assert one(spark, "x string", [("a\u00a0b\u2028c",), ("",), (None,)], js.word_count(x)) == [(3,), (1,), (None,)]
    assert one(spark, "x string", [("\u00a07",), ("9" * 30,), ("-9223372036854775808x",), ("+",)], js.parse_int(x)) == [(7,), (None,), (-(2**63),), (None,)]
    assert one(spark, "x string", [("\ufeff7.5",), ("9" * 30,), ("1e999",)], js.parse_float(x)) == [(7.5,), (1e30,), (float("inf"),)]
    ranges = [("bytes=0-1, 4-5",), ("bytes=" + "9" * 30 + "-",), ("bytes=0-" + "9" * 30,), ("bytes=9-9",), ("bytes=10-",), ("bytes=3-2",), ("",), (None,)]
    assert one(spark, "x string", ranges, *js.byte_range(x, n)) == [(206, 0, 1)] + [(416, None, None)] * 2 + [(206, 9, 9)] + [(416, None, None)] * 4
    urls = [("data:image/jpg;base64,QQ==",), ("data:image/webp;base64,QQ",), ("data:image/png;base64,QQ==",), ("data:image/jpeg;base64,QQ==\n",), ("data:image/jpeg;base64,",), (None,)]
    assert one(spark, "x string", urls, *js.data_url(x)) == [("jpeg", "QQ=="), ("webp", "QQ")] + [(None, None)] * 4
    assert one(spark, "x string", [('{"a":\u00a0NaN}',)], js.json_text(x)) == [('{"a": null}',)]


def test_a_range_header_compiles(spark):
    """The expressions stay small enough for generated code."""
    status, begin, end = js.byte_range(F.col("x"), F.lit(10).cast("long"))
    plan = spark.range(1).select(F.col("id").cast("string").alias("x")).select(status, begin, end)._jdf.queryExecution()
    code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan.executedPlan())
    assert len(code) < 200_000


def test_times_beyond_four_digits_of_a_year(spark):
    # as strftime of the SQL prints them
    seconds = [(253402300799,), (253402300800,), (777599913618,), (-62167219201,), (-62135596801,)]
    assert one(spark, "x long", seconds, js.iso_seconds(F.col("x"))) == [("9999-12-31T23:59:59.000Z",), ("10000-01-01T00:00:00.000Z",), ("26611-03-01T00:00:18.000Z",), ("-1-12-31T23:59:59.000Z",), ("0000-12-31T23:59:59.000Z",)]


def test_slugs_of_white_space_beyond_ascii(spark):
    texts = [("A\u00a0 \u3000B\ufeff-c\u2028\n", "a-b--c-"), ("\u00c4b\u00e9 \u1680\u200b x_9!?", "b-x_9"), ("", ""), (None, None)]
    assert one(spark, "x string", [(x,) for x, _ in texts], js.slugify(F.col("x"))) == [(y,) for _, y in texts]
    # one pass with a class beyond ASCII, which looks at characters beyond ASCII only
    plan = spark.range(1).select(js.slugify(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("u3000") == 1


def test_a_log_is_looked_at_once(spark, small):
    from rallylake.plans import registry

    plan = registry.QUERIES["log_text_stage"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1 and plan.count("regexp_replace") == 1
    # overlapping markers count both; the first literal of a step is the one whose last place counts
    texts = [("Artifact RemovaLocation Calculation",), ("step 1: STEP 4: x VISUALIZATION step 1: STEP 1:",), ("nothing",), (None,), ("Video Visualization, pose estimation",)]
    found = one(spark, "x string", texts, jobs.log_step(F.col("x"))[2])
    assert found == [(55,), (15,), (0,), (0,), (35,)]

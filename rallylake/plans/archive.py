"""Queries over objects that are really written, listed and read: puts, names, shared pages, summaries; and point lookups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallylake.operators import relational as R
from rallylake.operators import security
from rallylake.plans import movement, streams
from rallylake.plans.base import ORACLES, query
from rallylake.sources import inbox, objects, schemas, store
from rallylake.sources.scratch import scratch
from rallylake.sources.tables import load
from rallylake.streaming import tracking

NAMES = T.MapType(T.StringType(), T.StringType())


def text(column):
    return F.col(column).cast("string")


@query("""SELECT 'dev/u' || page_id % 7 || '/v' || page_id || '/page ' || page_id || '+.html' AS key, CAST(strlen(html) AS BIGINT) AS size, 'text/html' AS content_type, 'u' || page_id % 7 AS owner,
    CASE WHEN page_id % 3 = 0 THEN 'second' ELSE 'first' END AS version, CAST(length(html) AS BIGINT) AS chars, md5(html) AS digest FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)""")
def objects_put(spark, d):
    """Pages put as objects with properties, every third one twice; then listed, read whole as text, and joined with what was said of them."""
    page, root = text("page_id"), scratch(spark, "archive")
    user = F.concat(F.lit("u"), (F.col("page_id") % 7).cast("string"))
    key = F.concat(F.lit("dev/"), user, F.lit("/v"), page, F.lit("/page "), page, F.lit("+.html"))
    pages = load(spark, d, "pages").select("page_id", key.alias("key"), F.coalesce("html", F.lit("")).cast("binary").alias("content"), F.lit("text/html").alias("content_type"), user.alias("user"))
    said = lambda version: F.create_map(F.lit("userId"), "user", F.lit("version"), F.lit(version)).alias("metadata")
    objects.put_objects(pages.select("key", "content", "content_type", said("first")), root)
    objects.put_objects(pages.where("page_id % 3 = 0").select("key", "content", "content_type", said("second")), root)
    files = objects.listed(spark, root).where(F.startswith("key", F.lit("dev/"))).select("key", "size")
    rows = objects.fetched(objects.dealt(files), root).join(objects.properties(spark, root), "key", "left")
    return rows.select("key", "size", "content_type", F.col("metadata")["userId"].alias("owner"), F.col("metadata")["version"].alias("version"), F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN 500 ELSE 200 END AS status, CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN 'player_1=' || s_nationkey WHEN s_suppkey % 3 <> 0 THEN 'player_0=' || s_name || ',player_1=Guest' ELSE '' END AS names FROM supplier""")
def player_names_documents(spark, d):
    """Small documents of names, a write replacing the whole one; without one the names are empty, a broken one is an error."""
    root, n = scratch(spark, "names"), F.col("s_suppkey")
    rows = load(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.concat(F.lit("dev/"), text("s_suppkey"), F.lit("/main/player_names.json")).alias("key"))
    stored = rows.where(n % 3 != 0).select("key", F.to_json(F.create_map(F.lit("player_0"), "s_name", F.lit("player_1"), F.lit("Guest"))).alias("content"))
    asked = rows.where(n % 2 == 0).select("key", F.to_json(F.create_map(F.lit("player_1"), text("s_nationkey"))).alias("content"))
    broken = rows.where(n % 11 == 0).select("key", F.lit("{no JSON").alias("content"))
    for batch in (stored, asked, broken):
        objects.put_objects(batch.withColumn("content_type", F.lit("application/json")), root)
    read = objects.fetched(rows.select("s_suppkey", "key"), root)
    names = F.when(F.col("text").isNull(), F.lit("{}")).otherwise(F.col("text"))
    parsed = read.select("s_suppkey", F.when(F.try_parse_json(names).isNotNull(), F.from_json(names, NAMES)).alias("names"))
    pairs = F.transform(F.array_sort(F.map_entries("names")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return parsed.select("s_suppkey", F.when(F.col("names").isNull(), 500).otherwise(200).alias("status"), F.array_join(pairs, ",").alias("names"))


@query(f"""WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS asked FROM events GROUP BY user_id),
    s AS (SELECT user_id, asked, CASE WHEN user_id % 13 = 0 THEN 404 WHEN user_id % 5 = 0 THEN 410 WHEN user_id % 4 = 1 THEN 202 ELSE 200 END AS status FROM u)
    SELECT s.user_id, status, CASE WHEN status = 200 THEN 'dev/' || s.user_id || '/main/' || CASE WHEN s.user_id % 3 = 0 THEN 'analyzed_video.mp4' WHEN s.user_id % 2 = 0 THEN 'video.mov' ELSE 'video.mp4' END END AS video_key,
    CASE WHEN status = 200 THEN CASE WHEN s.user_id % 2 = 0 THEN 'Player ' || s.user_id ELSE '' END END AS name, CASE WHEN status = 200 THEN asked ELSE 0 END AS views,
    CASE WHEN good THEN total_distance_m END AS total_distance_m, CASE WHEN good THEN st.dominant END AS dominant_stance, CASE WHEN good THEN jumps END AS total_jumps
    FROM (SELECT *, status = 200 AND user_id % 7 <> 0 AS good FROM s) s LEFT JOIN ({ORACLES["mv_distance"]}) a ON a.player = s.user_id LEFT JOIN ({ORACLES["mv_stance"]}) st ON st.player = s.user_id LEFT JOIN ({ORACLES["mv_jumps"]}) j ON j.player = s.user_id""")
def share_page(spark, d):
    """What a share link shows: 404 for an unknown one, 410 for an expired one, 202 before there is an analysis, else the video's key,
    the stored name and the analysis itself, read from the objects of the session; a broken analysis shows none. Every answered request is a view."""
    root = scratch(spark, "shares")
    requests = load(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("asked"))
    who, n = load(spark, d, "events").select("user_id").distinct(), F.col("user_id")
    own = lambda name: F.concat(F.lit("dev/"), text("user_id"), F.lit("/main/"), name).alias("key")
    videos = who.select(own(F.when(n % 2 == 0, "video.mov").otherwise("video.mp4")), F.lit("video").alias("content"))
    analyzed = who.where(n % 3 == 0).select(own(F.lit("analyzed_video.mp4")), F.lit("video").alias("content"))
    names = who.where(n % 2 == 0).select(own(F.lit("player_names.json")), F.to_json(F.create_map(F.concat(F.lit("player_"), text("user_id")), F.concat(F.lit("Player "), text("user_id")))).alias("content"))
    groups = movement.documents(spark, d).withColumnRenamed("player", "user_id").where(n % 4 != 1)
    document = F.to_json(F.struct(F.map_from_arrays(F.array(F.concat(F.lit("player_"), text("user_id"))), F.array(F.struct(*groups.columns[1:]))).alias("players")))
    analyses = groups.select(own(F.lit("position_analysis.json")), F.when(n % 7 == 0, "{no JSON").otherwise(document).alias("content"))
    objects.put_objects(videos.union(analyzed).union(names).union(analyses), root)

    # shares by token, of which some have expired and some do not exist
    shares = who.where(n % 13 != 0).select(F.concat(F.lit("token-"), text("user_id")).alias("token"), F.col("user_id").alias("owner"), (n % 5 == 0).alias("expired"))
    at = objects.locate(F.col("key"))
    files = objects.listed(spark, root).select("key", at["user_id"].cast("long").alias("owner"), at["file_name"].alias("file"))
    there = files.groupBy("owner").agg(F.bool_or(F.col("file") == "position_analysis.json").alias("analysis"), F.max(F.when(F.col("file") == "analyzed_video.mp4", F.col("key"))).alias("analyzed"), F.min(F.when(F.startswith("file", F.lit("video.")), F.col("key"))).alias("plain"))
    rows = requests.withColumn("token", F.concat(F.lit("token-"), text("user_id"))).join(shares, "token", "left").join(there, "owner", "left")
    status = F.when(F.col("owner").isNull(), 404).when(F.col("expired"), 410).when(~F.coalesce("analysis", F.lit(False)), 202).otherwise(200)
    good = F.col("status") == 200
    rows = rows.select("user_id", "asked", status.alias("status"), F.coalesce("analyzed", "plain").alias("video_key"))
    # only what is shown is read
    rows = objects.fetched(rows.withColumn("key", F.when(good, own(F.lit("position_analysis.json")))), root, text="analysis")
    rows = objects.fetched(rows.withColumn("key", F.when(good, own(F.lit("player_names.json")))), root, text="names")
    fields = "total_distance_m double, positioning_strategy struct<offensive_defensive: struct<dominant_stance: string>>, rally_dynamics struct<jump_pattern: struct<total_jumps: long>>"
    shape = T.StructType().add("players", T.MapType(T.StringType(), T.StructType.fromDDL(fields)))
    player = F.concat(F.lit("player_"), text("user_id"))
    rows = rows.withColumn("a", objects.parsed(F.col("analysis"), shape)["players"][player]).withColumn("name", F.coalesce(objects.parsed(F.col("names"), NAMES)[player], F.lit("")))
    return rows.select(
        "user_id", "status", F.when(good, F.col("video_key")).alias("video_key"), F.when(good, F.col("name")).alias("name"), F.when(good, F.col("asked")).otherwise(0).alias("views"),
        "a.total_distance_m", F.col("a.positioning_strategy.offensive_defensive.dominant_stance").alias("dominant_stance"), F.col("a.rally_dynamics.jump_pattern.total_jumps").alias("total_jumps"),
    )


@query("""SELECT who, o_orderstatus AS status, count(*) FILTER (ok) AS allowed, count(*) FILTER (NOT ok) AS refused FROM (
    SELECT who, o_orderstatus, CASE who WHEN 'admin' THEN true WHEN 'service' THEN true WHEN 'owner' THEN o_custkey = 7 ELSE false END AS ok FROM orders, (VALUES ('owner'), ('nobody'), ('admin'), ('service'), ('owner of usage')) w(who)) GROUP BY ALL""")
def write_checks(spark, d):
    """Of rows that come to be written, how many a user, nobody, an admin and the service may write; usage nobody but the latter two."""
    orders = load(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("status"))
    asked = {"owner": ("videos", security.Context(7)), "nobody": ("videos", security.Context()), "admin": ("videos", security.Context(8, "admin")), "service": ("usage_records", security.Context(bypass=True)), "owner of usage": ("usage_records", security.Context(7))}
    checks = [F.struct(F.lit(name).alias("who"), security.writable(policy, who).alias("ok")) for name, (policy, who) in asked.items()]
    told = orders.select("status", F.explode(F.array(*checks)).alias("c"))
    return told.groupBy("c.who", "status").agg(F.count_if("c.ok").alias("allowed"), F.count_if(~F.col("c.ok")).alias("refused"))


@query("""WITH p AS (SELECT CASE WHEN c_custkey % 9 = 0 THEN c_custkey - 1 ELSE c_custkey END AS id, c_name, c_nationkey FROM customer),
    one AS (SELECT id, any_value(c_name) AS name, any_value(c_nationkey) AS n FROM p GROUP BY id HAVING count(*) = 1)
    SELECT a.user_id, name, coalesce(n IN (1, 2), false) AS admin, coalesce(n = 2, false) AS super_admin, CASE WHEN n IN (1, 2) THEN 'page' ELSE 'redirect' END AS guard FROM (SELECT DISTINCT user_id FROM events) a LEFT JOIN one ON one.id = a.user_id""")
def profile_reads(spark, d):
    """The profile of each asker, read as a single row (none where an id has no profile or several), the roles that follow, and what the guard of the admin pages does."""
    n = F.col("c_nationkey")
    profiles = load(spark, d, "customer").select(F.when(F.col("c_custkey") % 9 == 0, F.col("c_custkey") - 1).otherwise(F.col("c_custkey")).alias("user_id"), F.col("c_name").alias("name"), F.when(n == 1, "admin").when(n == 2, "super_admin").otherwise("user").alias("role"))
    found = R.single_each(load(spark, d, "events").select("user_id").distinct(), profiles, "user_id")
    admin = F.coalesce(F.col("row.role").isin(*security.ADMIN_ROLES), F.lit(False))
    return found.select("user_id", F.col("row.name").alias("name"), admin.alias("admin"), F.coalesce(F.col("row.role") == "super_admin", F.lit(False)).alias("super_admin"), F.when(admin, "page").otherwise("redirect").alias("guard"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'stored' ELSE 'uploading' END AS status, o_orderkey % 4 <> 0 AS inserted, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS size FROM orders WHERE o_orderkey % 2 = 0""")
def insert_returning(spark, d):
    """Rows inserted in one batch, sent twice, and what came back: the stored rows, with those that were there before marked."""
    orders = load(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("size"))
    table = store.Store(spark, scratch(spark, "inserts"), "o_orderkey long, status string, size long", "o_orderkey")
    table.upsert(orders.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit("stored").alias("status"), F.lit(0).cast("long").alias("size")), "1-before")
    new = orders.where("o_orderkey % 2 = 0").withColumn("status", F.lit("uploading"))
    table.insert(new, "2-insert")
    told = table.insert(new, "2-insert").select("o_orderkey", "inserted")
    return table.rows().join(told, "o_orderkey").select("o_orderkey", "status", "inserted", "size")


@query("""SELECT c_nationkey, count(*) AS documents, count(*) FILTER (c_custkey % 6 = 5) AS errors, CAST(sum(CAST(floor(c_acctbal) AS BIGINT)) FILTER (c_custkey % 6 = 0) AS BIGINT) AS poses_detected, CAST(sum(c_custkey) FILTER (c_custkey % 6 = 1) AS BIGINT) AS player_detections,
    CAST(sum(c_custkey * 2) FILTER (c_custkey % 6 = 2) AS BIGINT) AS frames_with_data, count(*) FILTER (c_custkey % 6 = 2 AND c_custkey % 4 = 0) AS advanced, CAST(coalesce(sum(c_custkey % 3) FILTER (c_custkey % 6 = 3), 0) AS BIGINT) AS files, count(*) FILTER (c_custkey % 6 = 1) AS gpu, count(*) FILTER (c_custkey % 6 = 4) AS points FROM customer GROUP BY c_nationkey""")
def results_documents(spark, d):
    """Results of all kinds of steps (calibration, poses, positions, files, court points, errors) read with one schema, whose open parts stay variants."""
    n, key = F.col("c_custkey") % 6, F.col("c_custkey")
    one = lambda name, *fields: F.to_json(F.struct(F.struct(*fields).alias(name)))
    document = (
        F.when(n == 0, one("summary", F.floor("c_acctbal").cast("long").alias("poses_detected"), F.lit(1.5).alias("camera_height_meters")))
        .when(n == 1, one("pose_summary", F.struct(key.alias("player_detections")).alias("pose_analysis_summary"), F.struct(F.lit("gpu").alias("device"), F.lit(2).alias("batch")).alias("processing_info")))
        .when(n == 2, one("position_summary", (key * 2).alias("frames_with_data"), (key % 4 == 0).alias("advanced_tracking")))
        .when(n == 3, F.to_json(F.struct(F.transform(F.sequence(F.lit(1), (key % 3).cast("int") + 1), lambda i: F.struct(F.concat(F.lit("f"), i.cast("string")).alias("name"))).alias("files"))))
        .when(n == 4, F.to_json(F.struct(F.struct(F.array(F.lit(1), F.lit(2)).alias("corner")).alias("detected_points"))))
        .otherwise(F.to_json(F.struct(F.lit("failed").alias("error"))))
    )
    r = load(spark, d, "customer").select("c_nationkey", F.from_json(document, T.StructType.fromDDL(schemas.RESULTS)).alias("r"))
    return r.groupBy("c_nationkey").agg(
        F.count("*").alias("documents"), F.count("r.error").alias("errors"), F.sum("r.summary.poses_detected").alias("poses_detected"), F.sum("r.pose_summary.pose_analysis_summary.player_detections").alias("player_detections"),
        F.sum("r.position_summary.frames_with_data").alias("frames_with_data"), F.count_if("r.position_summary.advanced_tracking").alias("advanced"), F.sum(F.when(F.col("r.files").isNull(), 0).otherwise(F.size("r.files") - 1)).alias("files"),
        F.count_if(F.try_variant_get("r.pose_summary.processing_info", "$.device", "string") == "gpu").alias("gpu"), F.count_if(F.try_variant_get("r.detected_points", "$.corner[1]", "int") == 2).alias("points"),
    )


@query(f"""SELECT CAST(user_id AS VARCHAR) AS job_id, count(*) AS updates, count(*) FILTER ({streams.STATUS_SQL} IN ('completed', 'failed')) AS ends, 'polled' AS how FROM events GROUP BY user_id""")
def watch_to_end(spark, d):
    """Updates followed until every job's last one is there: the push source holds half of the log and falls quiet, a poll of the whole log takes its place."""
    body, half = streams.update_body(), load(spark, d, "events").selectExpr("percentile_approx(ts, 0.5, 1000) AS half")
    push = streams.delivered(spark, d, body, "watch-push", F.col("ts") <= half.first()["half"])
    whole = load(spark, d, "events").groupBy().agg(F.count_distinct("event_id").alias("n")).first()["n"]
    seen = lambda rows: rows.agg(F.count_distinct("id")).first()[0] >= whole
    poll = lambda: streams.told(streams.delivered(spark, d, body, "watch-poll"))
    rows, how = tracking.watched(streams.told(push), seen, "watch", poll, every="200 milliseconds", quiet_s=4)
    return rows.distinct().groupBy("job_id").agg(F.count("*").alias("updates"), F.count_if(F.col("status").isin(*inbox.STATUSES[2:])).alias("ends"), F.lit(how).alias("how"))

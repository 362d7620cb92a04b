"""Processing jobs: state from artifacts, worker status and logs; retries, waits and lineage.

events stand in for job updates: user_id is the job, ``$.k`` of props a number of 0 to 99; signup =
queued, view = running, click = heartbeat or cancelled, purchase = completed, error = failed.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rallylake.operators import jobs
from rallylake.plans.base import query
from rallylake.plans.scalars import K, k
from rallylake.sources.tables import load

ARTIFACTS = {"purchase": "analyzed_video.mp4", "error": "shuttle.json", "click": "positions.json", "view": "calibration.csv", "signup": "video.mp4"}
STATUS_SQL = "CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'IN_QUEUE' WHEN 'click' THEN 'CANCELLED' ELSE 'IN_PROGRESS' END"


def worker_status():
    t = F.col("event_type")
    return F.when(t == "purchase", "COMPLETED").when(t == "error", "FAILED").when(t == "signup", "IN_QUEUE").when(t == "click", "CANCELLED").otherwise("IN_PROGRESS")


@query("""SELECT user_id, CASE WHEN c THEN 'Analysis Complete' WHEN e THEN 'Analyzing Positions' WHEN k THEN 'Removing Artifacts' WHEN v THEN 'Detecting Poses' WHEN s THEN 'Court Detection' ELSE 'Queued for Analysis' END AS step,
    CASE WHEN c THEN 100 WHEN e THEN 70 WHEN k THEN 40 WHEN v THEN 10 WHEN s THEN 5 ELSE 0 END AS progress FROM (
    SELECT user_id, bool_or(event_type = 'purchase' AND value < 20) AS c, bool_or(event_type = 'error' AND value < 20) AS e, bool_or(event_type = 'click' AND value < 20) AS k, bool_or(event_type = 'view' AND value < 20) AS v, bool_or(event_type = 'signup' AND value < 20) AS s
    FROM events GROUP BY user_id)""")
def status_ladder(spark, d):
    # an artifact of at least 20 units is not there yet
    seen = load(spark, d, "events").groupBy("user_id").agg(*[F.bool_or((F.col("event_type") == t) & (F.col("value") < 20)).alias(t) for t in ARTIFACTS])
    step, progress = jobs.ladder({name: F.col(t) for t, name in ARTIFACTS.items()})
    return seen.select("user_id", step.alias("step"), progress.alias("progress"))


@query(f"""SELECT u.user_id, t.event_type AS artifact, e.user_id IS NOT NULL AS present FROM (SELECT DISTINCT user_id FROM events) u
    CROSS JOIN (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) t(event_type)
    LEFT JOIN (SELECT DISTINCT user_id, event_type FROM events WHERE {K} > 90) e ON e.user_id = u.user_id AND e.event_type = t.event_type""")
def artifact_progress(spark, d):
    # one pass: what each job has of the expected artifacts, then a row for each of them
    found = load(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(k() > 90, F.col("event_type"))).alias("found"))
    expected = F.explode(F.array(*map(F.lit, sorted(ARTIFACTS)))).alias("artifact")
    return found.select("user_id", expected, "found").select("user_id", "artifact", F.array_contains("found", F.col("artifact")).alias("present"))


@query(f"""SELECT user_id, CASE WHEN bool_or(event_type = 'purchase' AND {K} > 95) THEN 'purchase' WHEN bool_or(event_type = 'signup' AND {K} > 95) THEN 'signup' WHEN bool_or(event_type = 'view' AND {K} > 95) THEN 'view' END AS source
    FROM events GROUP BY user_id""")
def first_available(spark, d):
    # objects of rank over 95 exist; users without one of the candidates keep a row
    have = load(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(k() > 95, F.col("event_type"))).alias("have"))
    return have.select("user_id", F.coalesce(*[F.when(F.array_contains("have", F.lit(x)), x) for x in ("purchase", "signup", "view")]).alias("source"))


@query(f"""SELECT user_id, CASE t WHEN 'purchase' THEN 'visualization' WHEN 'error' THEN 'shuttle' WHEN 'signup' THEN 'calibration' WHEN 'click' THEN 'pose_position_artifacts' WHEN 'view' THEN 'pose_position_artifacts' END AS step,
    CASE t WHEN 'purchase' THEN 'Generating analyzed video...' WHEN 'error' THEN 'Detecting shuttlecock positions...' WHEN 'click' THEN 'Calculating player positions...' WHEN 'view' THEN 'Running pose estimation...' WHEN 'signup' THEN 'Processing court detection...' END AS stage,
    CASE t WHEN 'purchase' THEN 90 WHEN 'error' THEN 80 WHEN 'click' THEN 55 WHEN 'view' THEN 35 WHEN 'signup' THEN 15 ELSE 0 END AS progress
    FROM (SELECT user_id, arg_max(CASE WHEN {K} > 80 THEN event_type END, (ts, event_id)) FILTER ({K} > 80) AS t FROM events GROUP BY user_id)""")
def log_stage(spark, d):
    """What a job's log, a row a line, has reached; lines of rank up to 80 hold no marker."""
    t = F.col("event_type")
    marker = F.when(t == "purchase", "Visualization").when(t == "error", "Shuttle Tracking").when(t == "click", "Location Calculation").when(t == "view", "Pose Estimation").otherwise("Court Detection")
    lines = load(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("place"), F.when(k() > 80, marker).otherwise("frame done").alias("line"))
    step, stage, progress = jobs.last_log_step(F.col("line"), F.col("place"))
    return lines.groupBy("user_id").agg(step.alias("step"), stage.alias("stage"), progress.alias("progress"))


MARKERS = ("STEP 1: court", "Pose Estimation on", "location calculation", "Jump Detection", "Shuttle Detection", "Video Visualization")


@query("""SELECT doc_id, list_extract(['calibration', 'pose_position_artifacts', 'pose_position_artifacts', 'pose_position_artifacts', 'shuttle', 'visualization'], last) AS step, list_extract([15, 35, 55, 70, 80, 90], last) AS progress
    FROM (SELECT doc_id, CAST(doc_id // 6 % 6 + 1 AS INT) AS last FROM documents)""")
def log_text_stage(spark, d):
    """The same for logs that come whole, as one text: two markers around a document's text, of which the later counts."""
    marker = lambda n: F.element_at(F.array(*map(F.lit, MARKERS)), (n % 6 + 1).cast("int"))
    log = F.concat_ws("\n", marker(F.col("doc_id")), F.regexp_replace(F.col("text"), "(?i)(?=[sdtecrv])(?:step|detection|tracking|estimation|calculation|removal|visualization)", "."), marker(F.floor(F.col("doc_id") / 6)))
    # a column of its own, so that a text is looked at once for both
    found = load(spark, d, "documents").select("doc_id", jobs.log_place(log).alias("best"))
    return found.select("doc_id", "best.step", F.coalesce("best.progress", F.lit(0)).alias("progress"))


@query(f"""SELECT event_id, CASE WHEN k % 7 = 0 THEN step WHEN b = 0 THEN CASE WHEN k > 0 THEN greatest(step, 95) ELSE step END ELSE greatest(step, least(95, CAST(floor(100.0::DOUBLE * k / b + 0.5) AS INT))) END AS progress
    FROM (SELECT event_id, {K} AS k, CAST(floor(value) AS INT) AS b, CAST(event_id % 100 AS INT) AS step FROM events)""")
def frame_progress(spark, d):
    frames = F.concat(F.lit("at "), k().cast("string"), F.lit("/"), F.floor("value").cast("string"), F.lit(" frames, then 1/1 frames"))
    log = F.when(k() % 7 == 0, "no frames").otherwise(frames)
    return load(spark, d, "events").select("event_id", jobs.frame_progress(log, (F.col("event_id") % 100).cast("int")).alias("progress"))


@query(f"SELECT event_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'failed' WHEN 'signup' THEN 'queued' ELSE 'running' END AS status, CASE event_type WHEN 'purchase' THEN 100 WHEN 'signup' THEN 0 ELSE {K} END AS progress FROM events")
def status_map(spark, d):
    status, progress = jobs.overall(worker_status(), k())
    return load(spark, d, "events").select("event_id", status.alias("status"), progress.alias("progress"))


@query(f"""SELECT event_id, s IN ('IN_QUEUE', 'IN_PROGRESS') AS alive, s = 'COMPLETED' AND o AS succeeded, (s = 'COMPLETED' AND NOT o) OR s IN ('FAILED', 'TIMED_OUT') AS died, (s = 'COMPLETED' AND NOT o) OR s IN ('FAILED', 'TIMED_OUT') AS retry
    FROM (SELECT event_id, {STATUS_SQL} AS s, {K} % 2 = 0 AS o FROM events)""")
def health_rules(spark, d):
    return load(spark, d, "events").select("event_id", *[c.alias(name) for name, c in jobs.health(worker_status(), k() % 2 == 0).items()])


@query(f"""SELECT event_id, CASE WHEN k > 95 THEN 'success' WHEN s IN ('IN_QUEUE', 'IN_PROGRESS') THEN 'wait' WHEN s = 'COMPLETED' AND k % 2 = 0 AND k % 3 = 0 THEN 'success' WHEN (s = 'COMPLETED' AND k % 2 = 1) OR s = 'FAILED' THEN 'retry' ELSE 'failed' END AS recommendation
    FROM (SELECT event_id, {STATUS_SQL} AS s, {K} AS k FROM events)""")
def recommendation(spark, d):
    return load(spark, d, "events").select("event_id", jobs.recommendation(k() > 95, worker_status(), k() % 2 == 0, k() % 3 == 0).alias("recommendation"))


@query(f"SELECT event_id, event_type = 'error' AND {K} % 5 < 3 AS eligible, greatest(3 - {K} % 5, 0) AS retries_remaining, CASE WHEN {K} % 5 >= 3 THEN 'NO - MAX RETRIES EXCEEDED ❌' WHEN event_type = 'error' THEN 'YES - CAN RETRY ✅' ELSE 'NO' END AS can_retry FROM events")
def retry_eligible(spark, d):
    status = F.when(F.col("event_type") == "error", "failed").otherwise("running")
    return load(spark, d, "events").select("event_id", jobs.retry_eligible(status, k() % 5).alias("eligible"), F.greatest(3 - k() % 5, F.lit(0)).alias("retries_remaining"), jobs.retry_label(status, k() % 5).alias("can_retry"))


@query("""SELECT user_id, started_at, completed_at, CAST(date_diff('microsecond', started_at, completed_at) AS BIGINT) AS micros FROM (
    SELECT user_id, min(ts) FILTER (event_type = 'view') AS started_at FROM events GROUP BY user_id) JOIN (
    SELECT e.user_id AS u, min(e.ts) AS completed_at FROM events e JOIN (SELECT user_id, min(ts) AS s FROM events WHERE event_type = 'view' GROUP BY user_id) f ON e.user_id = f.user_id AND e.ts >= f.s
    WHERE event_type IN ('purchase', 'error') GROUP BY e.user_id) ON u = user_id""")
def job_durations(spark, d):
    events = load(spark, d, "events")
    started = events.where("event_type = 'view'").groupBy("user_id").agg(F.min("ts").alias("started_at"))
    ended = events.where(F.col("event_type").isin("purchase", "error")).select("user_id", "ts").join(started, "user_id").where("ts >= started_at")
    micros = F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return ended.groupBy("user_id", "started_at").agg(F.min("ts").alias("completed_at")).withColumn("micros", micros)


@query("""SELECT event_id, e.user_id, event_type FROM events e LEFT JOIN (
    SELECT user_id, min((ts, event_id)) AS stop FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id) s ON e.user_id = s.user_id WHERE stop IS NULL OR (ts, event_id) <= stop""")
def until_terminal(spark, d):
    events = load(spark, d, "events")
    place = F.struct("ts", "event_id")
    stop = events.where(F.col("event_type").isin("purchase", "error")).groupBy("user_id").agg(F.min(place).alias("stop"))
    return events.join(stop, "user_id", "left").where(F.col("stop").isNull() | (place <= F.col("stop"))).select("event_id", "user_id", "event_type")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error'),
    chain(event_id, user_id, parent, depth, root, n) AS (SELECT event_id, user_id, CAST(NULL AS BIGINT), CAST(0 AS BIGINT), event_id, n FROM e WHERE n = 1
        UNION ALL SELECT e.event_id, e.user_id, c.event_id, c.depth + 1, c.root, e.n FROM chain c JOIN e ON e.user_id = c.user_id AND e.n = c.n + 1)
    SELECT event_id, user_id, parent, depth, root FROM chain""")
def retry_chain(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    errors = load(spark, d, "events").where("event_type = 'error'")
    return errors.select("event_id", "user_id", F.lag("event_id").over(w).alias("parent"), (F.row_number().over(w) - 1).cast("long").alias("depth"), F.first("event_id").over(w).alias("root"))


@query("""SELECT event_id, user_id, signup_id, signup_id IS NOT NULL AS matched FROM (
    SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS signup_id
    FROM events WHERE event_type IN ('signup', 'purchase')) WHERE event_type = 'purchase'""")
def event_order(spark, d):
    events = load(spark, d, "events").where(F.col("event_type").isin("signup", "purchase"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w)
    return events.withColumn("signup_id", last).where("event_type = 'purchase'").select("event_id", "user_id", "signup_id", F.col("signup_id").isNotNull().alias("matched"))


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE next IS NULL OR date_diff('microsecond', ts, next) >= 3600000000")
def debounce(spark, d):
    events = load(spark, d, "events").select("event_id", "user_id", "ts").withColumn("next", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return events.where(F.col("next").isNull() | (micros("next") - micros("ts") >= 3_600_000_000)).select("event_id", "user_id")

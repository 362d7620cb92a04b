"""Movement metrics; events stand in for positions: x = (value mod 61) / 10, y = 0.134 k metres."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallylake.operators import movement as M
from rallylake.plans.base import ORACLES, query
from rallylake.plans.scalars import K, k
from rallylake.sources.tables import load


def positions(spark, d) -> DataFrame:
    return load(spark, d, "events").select(F.col("user_id").alias("player"), F.col("ts").alias("t"), F.col("event_id").alias("sample"), ((F.col("value") % 61) / 10).alias("x"), (k() * 0.134).alias("y"), "event_type")


P = f"(SELECT user_id AS player, ts AS t, event_id AS sample, event_type, (value % 61) / 10 AS x, {K} * CAST(0.134 AS DOUBLE) AS y FROM events)"
AWAY = "sqrt((x - 6.1::DOUBLE / 2) * (x - 6.1::DOUBLE / 2) + (y - 13.4::DOUBLE / 2) * (y - 13.4::DOUBLE / 2))"
STEPS = f"""(SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS step, micros - pm AS gap, lag(away) OVER (PARTITION BY player ORDER BY t, sample) AS before FROM (
    SELECT *, {AWAY} AS away, epoch_us(t) AS micros, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(epoch_us(t)) OVER w AS pm FROM {P} WINDOW w AS (PARTITION BY player ORDER BY t, sample)))"""
MICRO = "CAST(floor({} * 1e6 + 0.5) AS BIGINT)"
FRONT, MIDDLE = "y < 13.4::DOUBLE / 3", "(y >= 13.4::DOUBLE / 3 AND y < 2 * 13.4::DOUBLE / 3)"
LEFT = "x < 6.1::DOUBLE / 2"


@query(f"SELECT player, CAST(sum({MICRO.format('step')}) AS BIGINT) / 1e6 AS total_distance_m FROM {STEPS} GROUP BY player")
def mv_distance(spark, d):
    return M.steps(positions(spark, d)).groupBy("player").agg((F.sum(M.micro(F.col("step"))) / 1e6).alias("total_distance_m"))


@query(f"SELECT player, micros / 1e6 AS time_tracked_seconds, CASE WHEN micros = 0 THEN NULL ELSE length / micros END AS average_speed_m_s FROM (SELECT player, CAST(sum({MICRO.format('step')}) AS BIGINT) AS length, max(micros) - min(micros) AS micros FROM {STEPS} GROUP BY player)")
def mv_avg_speed(spark, d):
    sums = M.steps(positions(spark, d)).groupBy("player").agg(F.sum(M.micro(F.col("step"))).alias("length"), (F.max("micros") - F.min("micros")).alias("micros"))
    return sums.select("player", (F.col("micros") / 1e6).alias("time_tracked_seconds"), F.try_divide("length", "micros").alias("average_speed_m_s"))


@query(f"SELECT player, count(*) FILTER (step IS NULL OR step <= 8) AS cleaned_frame_count, count(*) FILTER (step > 8) AS artifacts FROM {STEPS} GROUP BY player")
def mv_frames(spark, d):
    good = F.col("step").isNull() | (F.col("step") <= M.ARTIFACT_STEP_M)
    return M.steps(positions(spark, d)).groupBy("player").agg(F.count_if(good).alias("cleaned_frame_count"), F.count_if(~good).alias("artifacts"))


@query("SELECT player, " + ", ".join(f"100.0::DOUBLE * count(*) FILTER ({c} AND {s}) / count(*) AS {n}_{m}" for n, c in (("front", FRONT), ("middle", MIDDLE), ("back", f"NOT {FRONT} AND NOT {MIDDLE}")) for m, s in (("left", LEFT), ("right", f"NOT {LEFT}"))) + f" FROM {P} GROUP BY player")
def mv_occupancy(spark, d):
    zone = F.concat(M.third(), F.lit("_"), M.side())
    return positions(spark, d).groupBy("player").agg(*[M.share(zone == z).alias(z) for z in M.ZONES])


@query(f"SELECT player, CAST(sum({MICRO.format('away')}) AS BIGINT) / 1e6 / count(*) AS avg_distance_m, max(away) AS max_distance_m, 100.0::DOUBLE * count(*) FILTER (away <= 1.5) / count(*) AS near_percent FROM {STEPS} GROUP BY player")
def mv_center(spark, d):
    return M.steps(positions(spark, d)).groupBy("player").agg((F.sum(M.micro(F.col("away"))) / 1e6 / F.count("*")).alias("avg_distance_m"), F.max("away").alias("max_distance_m"), M.share(F.col("away") <= M.NEAR_M).alias("near_percent"))


@query(f"""SELECT player, CAST(sum(micros) AS BIGINT) / 1e6 / count(*) AS avg_return_seconds, count(*) AS runs FROM (SELECT player, run, max(micros) - min(micros) AS micros FROM (
    SELECT *, sum(CASE WHEN away > 1.5 THEN 0 ELSE 1 END) OVER (PARTITION BY player ORDER BY t, sample ROWS UNBOUNDED PRECEDING) AS run FROM {STEPS}) WHERE away > 1.5 GROUP BY player, run) GROUP BY player""")
def mv_return_time(spark, d):
    return M.away_runs(positions(spark, d)).groupBy("player").agg((F.sum("micros") / 1e6 / F.count("*")).alias("avg_return_seconds"), F.count("*").alias("runs"))


@query(f"SELECT player, CAST(sum({MICRO.format('speed')}) AS BIGINT) / 1e6 / count(*) AS avg_recovery_m_s, max(speed) AS max_recovery_m_s FROM (SELECT player, step / (gap / 1e6) AS speed FROM {STEPS} WHERE away < before AND gap > 0) GROUP BY player")
def mv_recovery(spark, d):
    back = M.steps(positions(spark, d)).where("away < before and gap > 0").withColumn("speed", F.col("step") / (F.col("gap") / 1e6))
    return back.groupBy("player").agg((F.sum(M.micro(F.col("speed"))) / 1e6 / F.count("*")).alias("avg_recovery_m_s"), F.max("speed").alias("max_recovery_m_s"))


@query(f"""SELECT player, offensive, neutral, defensive, CASE WHEN defensive >= greatest(neutral, offensive) THEN 'defensive' WHEN neutral >= offensive THEN 'neutral' ELSE 'offensive' END AS dominant FROM (
    SELECT player, 100.0::DOUBLE * count(*) FILTER ({FRONT}) / count(*) AS offensive, 100.0::DOUBLE * count(*) FILTER ({MIDDLE}) / count(*) AS neutral, 100.0::DOUBLE * count(*) FILTER (NOT {FRONT} AND NOT {MIDDLE}) / count(*) AS defensive FROM {P} GROUP BY player)""")
def mv_stance(spark, d):
    shares = positions(spark, d).groupBy("player").agg(*[M.share(M.third() == zone).alias(name) for name, zone in (("offensive", "front"), ("neutral", "middle"), ("defensive", "back"))])
    return shares.withColumn("dominant", M.dominant(*[(n, F.col(n)) for n in ("offensive", "neutral", "defensive")]))


@query(f"SELECT player, l AS left_percent, r AS right_percent, CASE WHEN l >= r THEN 'left' ELSE 'right' END AS dominant FROM (SELECT player, 100.0::DOUBLE * count(*) FILTER ({LEFT}) / count(*) AS l, 100.0::DOUBLE * count(*) FILTER (NOT {LEFT}) / count(*) AS r FROM {P} GROUP BY player)")
def mv_side_bias(spark, d):
    shares = positions(spark, d).groupBy("player").agg(M.share(M.side() == "left").alias("left_percent"), M.share(M.side() == "right").alias("right_percent"))
    return shares.withColumn("dominant", M.dominant(("left", F.col("left_percent")), ("right", F.col("right_percent"))))


QUARTERS = f"(SELECT *, ntile(4) OVER (PARTITION BY player ORDER BY t, sample) AS quarter FROM {STEPS})"


def _quarters(spark, d) -> DataFrame:
    return M.steps(positions(spark, d)).withColumn("quarter", F.ntile(4).over(Window.partitionBy("player").orderBy("t", "sample")))


@query(f"""SELECT player, first_speed, last_speed, CASE WHEN first_speed = 0 THEN NULL ELSE 100 * (last_speed - first_speed) / first_speed END AS change_percent FROM (
    SELECT player, CAST(sum({MICRO.format('step')}) FILTER (quarter = 1) AS BIGINT) / CAST(sum(gap) FILTER (quarter = 1) AS BIGINT) AS first_speed, CAST(sum({MICRO.format('step')}) FILTER (quarter = 4) AS BIGINT) / CAST(sum(gap) FILTER (quarter = 4) AS BIGINT) AS last_speed FROM {QUARTERS} GROUP BY player)""")
def mv_quarters(spark, d):
    total = lambda c, q: F.sum(F.when(F.col("quarter") == q, c))
    speed = lambda q: F.try_divide(total(M.micro(F.col("step")), q), total(F.col("gap"), q))
    both = _quarters(spark, d).groupBy("player").agg(speed(1).alias("first_speed"), speed(4).alias("last_speed"))
    return both.withColumn("change_percent", F.try_divide(100 * (F.col("last_speed") - F.col("first_speed")), F.col("first_speed")))


@query(f"""SELECT player, jumps, CASE WHEN micros = 0 THEN NULL ELSE jumps / (micros / 1e6) END AS jumps_per_second, first_quarter, last_quarter FROM (
    SELECT player, count(*) FILTER (event_type = 'click') AS jumps, max(micros) - min(micros) AS micros, count(*) FILTER (event_type = 'click' AND quarter = 1) AS first_quarter, count(*) FILTER (event_type = 'click' AND quarter = 4) AS last_quarter FROM {QUARTERS} GROUP BY player)""")
def mv_jumps(spark, d):
    jump = F.col("event_type") == "click"
    counts = _quarters(spark, d).groupBy("player").agg(F.count_if(jump).alias("jumps"), (F.max("micros") - F.min("micros")).alias("micros"), F.count_if(jump & (F.col("quarter") == 1)).alias("first_quarter"), F.count_if(jump & (F.col("quarter") == 4)).alias("last_quarter"))
    return counts.select("player", "jumps", F.try_divide("jumps", F.col("micros") / 1e6).alias("jumps_per_second"), "first_quarter", "last_quarter")


@query(f"""SELECT player, CAST(sum(dist) AS BIGINT) / 1e6 / count(*) AS avg_m, CASE WHEN count(*) < 2 THEN NULL ELSE round(stddev_samp(dist) / 1e6, 3) END AS std_m, count(*) AS windows FROM (
    SELECT player, date_trunc('day', t) AS day, CAST(coalesce(sum({MICRO.format('step')}), 0) AS BIGINT) AS dist FROM {STEPS} GROUP BY ALL) GROUP BY player""")
def mv_intensity(spark, d):
    daily = M.steps(positions(spark, d)).groupBy("player", F.date_trunc("day", F.col("t")).alias("day")).agg(F.coalesce(F.sum(M.micro(F.col("step"))), F.lit(0)).alias("dist"))
    return daily.groupBy("player").agg((F.sum("dist") / 1e6 / F.count("*")).alias("avg_m"), F.when(F.count("*") > 1, F.round(F.stddev_samp("dist") / 1e6, 3)).alias("std_m"), F.count("*").alias("windows"))


FIELDS = ("mv_distance", "mv_avg_speed", "mv_frames", "mv_occupancy", "mv_center", "mv_return_time", "mv_recovery", "mv_stance", "mv_side_bias", "mv_quarters", "mv_jumps", "mv_intensity")
_PLAIN = (
    "player, total_distance_m, average_speed_m_s, time_tracked_seconds, cleaned_frame_count, artifacts AS artifacts_corrected, front_left, back_right, avg_distance_m AS average_distance_from_center_m, max_distance_m AS max_distance_from_center_m, "
    "avg_return_seconds AS average_return_time_s, near_percent AS time_near_center_percent, avg_recovery_m_s AS average_recovery_speed_m_s, max_recovery_m_s AS max_recovery_speed_m_s, offensive AS offensive_percent, defensive AS defensive_percent, "
    "s.dominant AS dominant_stance, left_percent, b.dominant AS dominant_side, first_speed AS first_quarter_speed_m_s, last_speed AS last_quarter_speed_m_s, change_percent, jumps AS total_jumps, jumps_per_second, first_quarter AS first_quarter_jumps, "
    "avg_m AS avg_distance_m, std_m AS std_distance_m"
)


def documents(spark, d) -> DataFrame:
    """The whole analysis document of each player as nested columns: one window sort for all metrics, one
    aggregation, and one more for what is counted by runs and by days."""
    return M.document(positions(spark, d), F.col("event_type") == "click")


@query(f"SELECT {_PLAIN} FROM ({ORACLES['mv_distance']}) " + " ".join(f"LEFT JOIN ({ORACLES[x]}) {dict(mv_stance='s', mv_side_bias='b').get(x, x)} USING (player)" for x in FIELDS[1:]))
def mv_document_fields(spark, d):
    """Fields of every group of the document, read back from it."""
    at = lambda path: F.col(path).alias(path.rsplit(".", 1)[-1])
    efficiency, strategy, rally = "movement_efficiency", "positioning_strategy", "rally_dynamics"
    paths = ["total_distance_m", "average_speed_m_s", "time_tracked_seconds", "cleaned_frame_count", "artifacts_corrected", "court_occupancy_percent.front_left", "court_occupancy_percent.back_right"]
    paths += [f"{efficiency}.return_to_center.{x}" for x in ("average_distance_from_center_m", "max_distance_from_center_m", "average_return_time_s", "time_near_center_percent")]
    paths += [f"{efficiency}.recovery_speed.{x}" for x in ("average_recovery_speed_m_s", "max_recovery_speed_m_s")]
    paths += [f"{strategy}.offensive_defensive.{x}" for x in ("offensive_percent", "defensive_percent", "dominant_stance")] + [f"{strategy}.left_right_bias.{x}" for x in ("left_percent", "dominant_side")]
    paths += [f"{rally}.speed_variation.{x}" for x in ("first_quarter_speed_m_s", "last_quarter_speed_m_s", "change_percent")] + [f"{rally}.jump_pattern.{x}" for x in ("total_jumps", "jumps_per_second", "first_quarter_jumps")]
    paths += [f"{rally}.movement_intensity.day.{x}" for x in ("avg_distance_m", "std_distance_m")]
    return documents(spark, d).select("player", *map(at, paths))


@query()
def mv_document(spark, d):
    """One JSON document per player with the nested groups, null fields kept."""
    groups = documents(spark, d)
    document = F.to_json(F.struct(F.map_from_arrays(F.array(F.concat(F.lit("player_"), F.col("player").cast("string"))), F.array(F.struct(*groups.columns[1:]))).alias("players")), {"ignoreNullFields": "false"})
    return groups.select("player", document.alias("document"))


@query(f"SELECT player, total_distance_m, average_speed_m_s, cleaned_frame_count FROM ({ORACLES['mv_distance']}) JOIN ({ORACLES['mv_avg_speed']}) USING (player) JOIN ({ORACLES['mv_frames']}) USING (player)")
def mv_shared(spark, d):
    """The fewer fields that a shared page shows; the other groups are not computed."""
    return documents(spark, d).select("player", "total_distance_m", "average_speed_m_s", "cleaned_frame_count")

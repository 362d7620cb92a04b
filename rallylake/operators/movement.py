"""Per-player movement metrics over positions(player, t, x, y), metres from the back-left corner.

The published result schema gives names and units only; the definitions are this library's. Sums are
of integer micro-units, so results do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH, DEPTH = 6.1, 13.4
NEAR_M = 1.5
ARTIFACT_STEP_M = 8.0
ZONES = tuple(f"{depth}_{side}" for depth in ("front", "middle", "back") for side in ("left", "right"))


def third() -> Column:
    return F.when(F.col("y") < DEPTH / 3, "front").when(F.col("y") < 2 * DEPTH / 3, "middle").otherwise("back")


def side() -> Column:
    return F.when(F.col("x") < WIDTH / 2, "left").otherwise("right")


def micro(x: Column) -> Column:
    """Whole millionths, for sums that are the same in any order."""
    return F.floor(x * 1e6 + 0.5).cast("long")


def steps(positions: DataFrame) -> DataFrame:
    """Positions with the step length and seconds since the sample before, and distances to the centre.

    One window per player, shared by all metrics: one shuffle and one sort.
    """
    w = Window.partitionBy("player").orderBy("t", "sample")
    dx, dy = (F.col(c) - F.lag(c).over(w) for c in "xy")
    away = F.sqrt((F.col("x") - WIDTH / 2) * (F.col("x") - WIDTH / 2) + (F.col("y") - DEPTH / 2) * (F.col("y") - DEPTH / 2))
    micros = F.unix_micros(F.col("t").cast("timestamp"))
    with_away = positions.withColumn("away", away).withColumn("micros", micros)
    return with_away.withColumns({"step": F.sqrt(dx * dx + dy * dy), "gap": F.col("micros") - F.lag("micros").over(w), "before": F.lag("away").over(w)})


def share(condition: Column) -> Column:
    """Percent of rows that satisfy a condition."""
    return 100.0 * F.count_if(condition) / F.count("*")


def dominant(*choices: tuple[str, Column]) -> Column:
    """The name with the greatest value; ties by name."""
    ordered = sorted(choices)
    best = F.greatest(*[c for _, c in ordered])
    return F.coalesce(*[F.when(c == best, name) for name, c in ordered])


def away_runs(positions: DataFrame) -> DataFrame:
    """Maximal runs of samples further than NEAR_M from the centre: player, run, micros (last minus first)."""
    w = Window.partitionBy("player").orderBy("t", "sample")
    far = F.col("away") > NEAR_M
    marked = steps(positions).withColumn("far", far)
    marked = marked.withColumn("run", F.sum(F.when(~F.col("far"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where("far").groupBy("player", "run").agg((F.max("micros") - F.min("micros")).alias("micros"))


def document(positions: DataFrame, jump: Column) -> DataFrame:
    """A row a player with all groups of the analysis document as nested columns.

    Steps, quarters and runs share the windows' sort; two small aggregations (runs away from the centre, days) are
    joined by player. A player with no time tracked has an error in place of a jump pattern.
    """
    w = Window.partitionBy("player").orderBy("t", "sample")
    rows = steps(positions).withColumn("quarter", F.ntile(4).over(w))
    zone = F.concat(third(), F.lit("_"), side())
    good, quick = F.col("step").isNull() | (F.col("step") <= ARTIFACT_STEP_M), (F.col("away") < F.col("before")) & (F.col("gap") > 0)
    speed = F.when(quick, F.col("step") / (F.col("gap") / 1e6))
    in_quarter = lambda c, q: F.sum(F.when(F.col("quarter") == q, c))
    jumps_in = lambda q: F.count_if(jump & (F.col("quarter") == q))
    found = rows.groupBy("player").agg(
        F.sum(micro(F.col("step"))).alias("length"),
        (F.max("micros") - F.min("micros")).alias("micros"),
        F.count_if(good).alias("cleaned_frame_count"),
        F.count_if(~good).alias("artifacts_corrected"),
        F.struct(*[share(zone == z).alias(z) for z in ZONES]).alias("court_occupancy_percent"),
        (F.sum(micro(F.col("away"))) / 1e6 / F.count("*")).alias("away"),
        F.max("away").alias("farthest"),
        share(F.col("away") <= NEAR_M).alias("near"),
        (F.sum(micro(speed)) / 1e6 / F.count(speed)).alias("recovery"),
        F.max(speed).alias("fastest"),
        *[share(third() == z).alias(n) for n, z in (("offensive", "front"), ("neutral", "middle"), ("defensive", "back"))],
        *[share(side() == z).alias(z) for z in ("left", "right")],
        *[F.try_divide(in_quarter(micro(F.col("step")), q), in_quarter(F.col("gap"), q)).alias(f"speed{q}") for q in (1, 4)],
        F.count_if(jump).alias("jumps"),
        *[jumps_in(q).alias(f"jumps{q}") for q in (1, 4)],
    )
    back = away_runs(positions).groupBy("player").agg((F.sum("micros") / 1e6 / F.count("*")).alias("return"))
    daily = rows.groupBy("player", F.date_trunc("day", F.col("t")).alias("day")).agg(F.coalesce(F.sum(micro(F.col("step"))), F.lit(0)).alias("dist"))
    days = daily.groupBy("player").agg((F.sum("dist") / 1e6 / F.count("*")).alias("avg_distance_m"), F.when(F.count("*") > 1, F.round(F.stddev_samp("dist") / 1e6, 3)).alias("std_distance_m"))
    days = days.select("player", F.struct(F.struct("avg_distance_m", "std_distance_m", (100 * F.try_divide("std_distance_m", "avg_distance_m")).alias("variation_percent")).alias("day")).alias("movement_intensity"))
    named = lambda *pairs: F.struct(*[(F.col(x) if isinstance(x, str) else x).alias(n) for n, x in pairs])
    jump_pattern = named(("total_jumps", "jumps"), ("jumps_per_second", F.try_divide("jumps", F.col("micros") / 1e6)), ("first_quarter_jumps", "jumps1"), ("last_quarter_jumps", "jumps4"), ("error", F.when(F.col("micros") == 0, "no time tracked")))
    return (
        found.join(back, "player", "left")
        .join(days, "player", "left")
        .select(
            "player",
            (F.col("length") / 1e6).alias("total_distance_m"),
            F.try_divide("length", "micros").alias("average_speed_m_s"),
            (F.col("micros") / 1e6).alias("time_tracked_seconds"),
            "cleaned_frame_count",
            "artifacts_corrected",
            "court_occupancy_percent",
            named(
                ("return_to_center", named(("average_distance_from_center_m", "away"), ("max_distance_from_center_m", "farthest"), ("average_return_time_s", "return"), ("time_near_center_percent", "near"))),
                ("recovery_speed", named(("average_recovery_speed_m_s", "recovery"), ("max_recovery_speed_m_s", "fastest"))),
            ).alias("movement_efficiency"),
            named(
                ("offensive_defensive", named(("offensive_percent", "offensive"), ("neutral_percent", "neutral"), ("defensive_percent", "defensive"), ("dominant_stance", dominant(*[(n, F.col(n)) for n in ("offensive", "neutral", "defensive")])))),
                ("left_right_bias", named(("left_percent", "left"), ("right_percent", "right"), ("dominant_side", dominant(("left", F.col("left")), ("right", F.col("right")))))),
                ("predictive_positioning", named(("anticipation_score", F.lit(None).cast("double")))),
            ).alias("positioning_strategy"),
            named(
                ("speed_variation", named(("first_quarter_speed_m_s", "speed1"), ("last_quarter_speed_m_s", "speed4"), ("change_percent", F.try_divide(100 * (F.col("speed4") - F.col("speed1")), F.col("speed1"))))),
                ("jump_pattern", jump_pattern),
                ("movement_intensity", "movement_intensity"),
            ).alias("rally_dynamics"),
        )
    )

"""Job state from artifacts, logs and worker status, as column builders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Artifact, step shown and progress, from the last step to the first.
LADDER = (
    ("analyzed_video.mp4", "Analysis Complete", 100),
    ("position_analysis.json", "Generating Visualization", 85),
    ("shuttle.json", "Analyzing Positions", 70),
    ("jumps.json", "Tracking Shuttlecock", 55),
    ("corrected_positions.json", "Tracking Shuttlecock", 55),
    ("positions.json", "Removing Artifacts", 40),
    ("pose.json", "Calculating Positions", 25),
    ("calibration.csv", "Detecting Poses", 10),
    ("video.mp4", "Court Detection", 5),
)
# Markers in worker logs (in any case), step, stage shown and progress, in order of precedence.
LOG_STEPS = (
    (r"STEP 4:|Visualization|Video Visualization", "visualization", "Generating analyzed video...", 90),
    (r"STEP 3:|Shuttle Tracking|Shuttle Detection", "shuttle", "Detecting shuttlecock positions...", 80),
    (r"Sub-step 2\.3:|Jump Detection|Artifact Removal", "pose_position_artifacts", "Detecting jumps and removing artifacts...", 70),
    (r"Sub-step 2\.2:|Location Calculation", "pose_position_artifacts", "Calculating player positions...", 55),
    (r"Sub-step 2\.1:|STEP 2:|Pose Estimation", "pose_position_artifacts", "Running pose estimation...", 35),
    (r"STEP 1:|Court Detection|Court & Camera Calibration", "calibration", "Processing court detection...", 15),
)
ALIVE = ("IN_QUEUE", "IN_PROGRESS")
BROKEN = ("FAILED", "TIMED_OUT")
RETRYABLE = ("failed", "worker_died", "timed_out")


def ladder(present: dict[str, Column]) -> tuple[Column, Column]:
    """Step and progress of the highest artifact that is present (flags by artifact name)."""
    have = [x for x in LADDER if x[0] in present]
    step = reduce(lambda rest, x: F.when(present[x[0]], x[1]).otherwise(rest), reversed(have), F.lit("Queued for Analysis"))
    progress = reduce(lambda rest, x: F.when(present[x[0]], x[2]).otherwise(rest), reversed(have), F.lit(0))
    return step, progress


def last_index(text: Column, literal: Column) -> Column:
    """Place (from 0) of the last occurrence of a literal, as written; negative if there is none."""
    back = F.call_function("locate", F.reverse(literal), F.reverse(text))
    return F.when(back > 0, F.length(text) - back - F.length(literal) + 1).otherwise(-1)


#: A place where a marker of any step begins. Letters that no marker begins with are passed at the first look; the look
#: ahead consumes nothing, so markers that overlap are all found.
ANY_MARKER = "(?i)(?=[svjalpc])(?=(" + "|".join(pattern for pattern, *_ in LOG_STEPS) + "))"


def log_place(text: Column) -> Column:
    """(at, rank, step, stage, progress) of the marker a log has reached, null if there is none.

    Each pattern's first match, in any case, gives a literal; where that literal stands last, as
    written, counts. The greatest place wins; of equal places the pattern listed first. One pass finds the literals of all
    patterns, of which no two begin at one place; the text is bound once, however costly the expression that makes it.
    """

    def places(log: Column, literals: Column) -> Column:
        found = []
        for rank, (pattern, step, stage, progress) in enumerate(LOG_STEPS):
            own = F.filter(literals, lambda x: F.rlike(x, F.lit(f"(?i)^(?:{pattern})$")))  # noqa: B023
            place = F.get(F.transform(F.slice(own, 1, 1), lambda literal: last_index(log, literal)), F.lit(0))
            found.append(F.struct(place.alias("at"), F.lit(-rank).alias("rank"), F.lit(step).alias("step"), F.lit(stage).alias("stage"), F.lit(progress).alias("progress")))
        return F.array_max(F.filter(F.array(*found), lambda x: x["at"].isNotNull()))

    def of(log: Column) -> Column:
        literals = F.array_distinct(F.regexp_extract_all(log, F.lit(ANY_MARKER), F.lit(1)))
        return F.get(F.transform(F.array(literals), lambda x: places(log, x)), F.lit(0))

    return F.get(F.transform(F.array(text), of), F.lit(0))


def log_step(text: Column) -> tuple[Column, Column, Column]:
    """Step, stage and progress a log has reached, by :func:`log_place`."""
    best = log_place(text)
    return best["step"], best["stage"], F.coalesce(best["progress"], F.lit(0))


def last_log_step(line: Column, place: Column) -> tuple[Column, Column, Column]:
    """Aggregates: step, stage and progress of the last line, by ``place``, that holds a marker; for logs
    that come as rows, of which a key may have any number. One pattern finds the lines with a marker; only each key's
    last one is looked at step by step."""
    marked = F.rlike(line, F.lit("(?i)" + "|".join(f"(?:{pattern})" for pattern, *_ in LOG_STEPS)))
    return log_step(F.max_by(line, F.when(marked, place)))


def frame_progress(text: Column, progress: Column) -> Column:
    """The greater of ``progress`` and the first "a/b frames" in percent, at most 95; x/0 is 95, 0/0 nothing."""
    a, b = (F.nullif(F.regexp_extract(text, r"(\d+)/(\d+) frames", g), F.lit("")).cast("long") for g in (1, 2))
    share = F.when((b == 0) & (a > 0), 95).when(b > 0, F.least(F.floor(100.0 * a / F.nullif(b, F.lit(0)) + 0.5), F.lit(95)))
    return F.greatest(progress, share.cast("int"))


def overall(status: Column, progress: Column) -> tuple[Column, Column]:
    """Job status and progress after the worker's status has its say."""
    name = F.when(status == "COMPLETED", "completed").when(status.isin("FAILED", "CANCELLED", "TIMED_OUT"), "failed").when(status == "IN_QUEUE", "queued").otherwise("running")
    return name, F.when(status == "COMPLETED", 100).when(status == "IN_QUEUE", 0).otherwise(progress)


def health(status: Column, has_output: Column) -> dict[str, Column]:
    """What a worker's status says: alive, succeeded, died, retry."""
    hollow = (status == "COMPLETED") & ~has_output
    died = hollow | status.isin(*BROKEN)
    return {"alive": status.isin(*ALIVE), "succeeded": (status == "COMPLETED") & has_output, "died": died, "retry": died}


def recommendation(all_files: Column, status: Column, has_output: Column, visualization: Column) -> Column:
    h = health(status, has_output)
    return F.when(all_files, "success").when(h["alive"], "wait").when(h["succeeded"] & visualization, "success").when(h["died"] | (status == "FAILED"), "retry").otherwise("failed")


# Progress at which a step shows its next stage, for short and for long steps.
SHORT_STAGES, LONG_STAGES = (20, 40, 60, 80), (12, 25, 50, 65, 75, 85, 92)


def stage_index(progress: Column, thresholds: tuple[int, ...]) -> Column:
    """How many thresholds the progress exceeds: the stage that a step which advances slowly has reached."""
    return reduce(lambda n, t: n + F.when(progress > t, 1).otherwise(0), thresholds, F.lit(0))


# What is shown of a failed job.
CAN_RETRY, NO_RETRIES, NO_RETRY = "YES - CAN RETRY ✅", "NO - MAX RETRIES EXCEEDED ❌", "NO"


def retry_label(status: Column, count: Column, most: Column | int = 3) -> Column:
    eligible = retry_eligible(status, count, most)
    return F.when(eligible, CAN_RETRY).when(count >= most, NO_RETRIES).otherwise(NO_RETRY)


def retry_eligible(status: Column, count: Column, most: Column | int = 3) -> Column:
    return (count < most) & status.isin(*RETRYABLE)

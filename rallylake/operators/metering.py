"""The metering transaction as an exact fold: a rejected record does not count towards later ones."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def remaining(included: Column, used: Column) -> Column:
    return F.greatest(F.lit(0), included - used)


def overage(included: Column, used: Column) -> Column:
    return F.greatest(F.lit(0), used - included)


def quota_fold(records: DataFrame, key: str, minutes: str, included: str, order: list[str], bound: int = 6000) -> DataFrame:
    """``records`` with ``accepted`` and ``used``: the minutes accepted for the key up to and with the row.

    In the order of ``order``, a record is accepted unless the overage that it would lead to exceeds
    ``bound``; later, smaller records may still fit. Whether one fits depends on all accepted before, so
    the rows of a key pass one task in order, as a stream: sorted by Spark, which spills, with two
    numbers of state. Records that alone exceed the bound can never fit; they are decided without being
    dealt. Null minutes count as 0, a null ``included`` as no limit.
    """
    schema = T.StructType([*records.schema.fields, T.StructField("accepted", T.BooleanType()), T.StructField("used", T.LongType())])
    need, names = F.coalesce(F.col(minutes), F.lit(0)), records.columns
    at = [names.index(c) for c in (key, minutes, included)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = object(), 0
        for batch in batches:
            accepted, totals = [], []
            for who, m, most in zip(*(batch.column(k).to_pylist() for k in at), strict=True):
                if who != now:
                    now, used = who, 0
                fits = most is None or used + (m or 0) - most <= bound
                used += fits * (m or 0)
                accepted.append(fits)
                totals.append(used)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(accepted, pa.bool_()), pa.array(totals, pa.int64())], names=[*names, "accepted", "used"])

    hopeless = F.coalesce(need - F.col(included) > bound, F.lit(False))
    folded = records.where(~hopeless).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
    never = records.where(hopeless).select(*names, F.lit(False).alias("accepted"), F.lit(None).cast("long").alias("used"))
    return folded.unionByName(never)


# Hours by plan.
PLAN_HOURS = {"FREE": 5, "STARTER": 50, "PRO": 200, "ENTERPRISE": 1000}


def payment_status(status: Column) -> Column:
    """The subscription's status; what is not known (trials, too) counts as incomplete."""
    return F.when(status.isin("active", "canceled", "past_due"), status).otherwise("incomplete")


def subscriptions(events: DataFrame, key: str) -> DataFrame:
    """State of each key's subscription after all events (kind, plan, status, minutes, period_start; in the order of
    ``place``, a struct).

    A checkout sets the plan, an empty use and a period; a cycle empties the use and begins a period; an update
    sets status and period; a deletion sets the free plan, canceled and unused; use adds minutes. Before
    the first checkout there is no paying customer, so all but checkouts and use find nothing. Each field is that of
    the last event that sets it, so aggregates with map-side combine do the fold: no key is gathered or sorted.
    """
    kind, place = F.col("kind"), F.col("place")
    first = events.groupBy(key).agg(F.min(F.when(kind == "checkout", place)).alias("first"))
    paid = F.coalesce(place >= F.col("first"), F.lit(False))
    # which events set what
    told = events.join(first, key)
    last = lambda value, *kinds: F.max_by(value, F.when(paid & kind.isin(*kinds), place))
    state = told.groupBy(key).agg(
        F.coalesce(last(F.when(kind == "checkout", F.col("plan")).otherwise("FREE"), "checkout", "deleted"), F.lit("FREE")).alias("plan_type"),
        F.coalesce(last(F.when(kind == "checkout", "active").when(kind == "deleted", "canceled").otherwise(payment_status(F.col("status"))), "checkout", "updated", "deleted"), F.lit("active")).alias("status"),
        last(F.col("period_start"), "checkout", "cycle", "updated").alias("current_period_start"),
        F.max(F.when(paid & kind.isin("checkout", "cycle", "deleted"), place)).alias("reset"),
    )
    used = events.where(kind == "usage").join(state.select(key, "reset"), key).where(F.col("reset").isNull() | (place > F.col("reset"))).groupBy(key).agg(F.sum("minutes").alias("used"))
    minutes = F.create_map(*[x for p, h in PLAN_HOURS.items() for x in (F.lit(p), F.lit(60 * h))])
    return state.join(used, key, "left").select(key, "plan_type", "status", minutes[F.col("plan_type")].alias("minutes_included"), F.coalesce("used", F.lit(0)).cast("long").alias("minutes_used"), "current_period_start")

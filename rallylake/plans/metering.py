"""Minutes, plans and balances: customers stand in for subscriptions, line items for usage records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallylake.operators import metering, sqlfunctions
from rallylake.plans.base import query
from rallylake.sources.tables import load


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage records: one row per line item with its customer and whole minutes."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = load(spark, sf_dir, "lineitem")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).withColumn("m", F.col("l_quantity").cast("long"))


def included(segment: str = "c_mktsegment"):
    """Minutes included in the plan that a customer's segment stands for."""
    return F.when(F.col(segment) == "BUILDING", 300).when(F.col(segment) == "MACHINERY", 3000).otherwise(10).cast("long")


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = minutes(spark, sf_dir).groupBy("o_custkey").agg(F.sum("m").alias("used"))
    customer = load(spark, sf_dir, "customer")
    return customer.join(used, customer.c_custkey == used.o_custkey, "left").select("c_custkey", "c_nationkey", included().alias("included"), F.coalesce("used", F.lit(0)).cast("long").alias("used"))


BALANCES_SQL = """
    SELECT c_custkey, c_nationkey,
           CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 300 WHEN 'MACHINERY' THEN 3000 ELSE 10 END AS BIGINT) AS included,
           CAST(coalesce(u.used, 0) AS BIGINT) AS used
    FROM customer LEFT JOIN (
        SELECT o_custkey, sum(CAST(l_quantity AS BIGINT)) AS used
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey) u ON c_custkey = u.o_custkey
"""


@query(f"""
    SELECT c_custkey, included, used, CAST(greatest(0, included - used) AS BIGINT) AS remaining,
           CAST(greatest(0, used - included) AS BIGINT) AS overage FROM ({BALANCES_SQL})
""")
def usage_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balances(spark, sf_dir).select("c_custkey", "included", "used", F.greatest(F.lit(0), F.col("included") - F.col("used")).cast("long").alias("remaining"), F.greatest(F.lit(0), F.col("used") - F.col("included")).cast("long").alias("overage"))


ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
MINUTES_SQL = "SELECT o_custkey, CAST(l_quantity AS BIGINT) AS m, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
RUNNING_SQL = f"SELECT o_custkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(sum(m) OVER (PARTITION BY o_custkey ORDER BY {', '.join(ORDER)} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM ({MINUTES_SQL})"


@query(f"SELECT o_custkey, CAST(sum(m) AS BIGINT) AS used FROM ({MINUTES_SQL}) GROUP BY o_custkey")
def usage_total(spark, d):
    return minutes(spark, d).groupBy("o_custkey").agg(F.sum("m").alias("used"))


def running(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return minutes(spark, sf_dir).select("o_custkey", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.sum("m").over(w).alias("running"))


@query(RUNNING_SQL)
def usage_running(spark, d):
    return running(spark, d)


@query(f"SELECT c_custkey, CASE WHEN included <= 0 THEN 0.0 ELSE least(100.0, used / CAST(included AS DOUBLE) * 100) END AS pct FROM ({BALANCES_SQL})")
def usage_pct(spark, d):
    pct = F.when(F.col("included") <= 0, 0.0).otherwise(F.least(F.lit(100.0), F.col("used") / F.col("included").cast("double") * 100))
    return balances(spark, d).select("c_custkey", pct.alias("pct"))


@query(f"SELECT r.o_custkey, r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey, r.running, r.running - b.included > 600 AS rejected FROM ({RUNNING_SQL}) r JOIN ({BALANCES_SQL}) b ON r.o_custkey = b.c_custkey")
def quota_gate(spark, d):
    """Flags by the cumulative sum: rows after a rejected one still count it. The bound of 600 minutes of
    overage stands for 6000 so that the test tables reach it; see quota_fold for the exact one."""
    plan = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), included().alias("included"))
    return running(spark, d).join(plan, "o_custkey").withColumn("rejected", F.col("running") - F.col("included") > 600).drop("included")


@query(f"""WITH RECURSIVE r AS (SELECT l.*, CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 300 WHEN 'MACHINERY' THEN 3000 ELSE 10 END AS BIGINT) AS included,
        row_number() OVER (PARTITION BY o_custkey ORDER BY {', '.join(ORDER)}) AS rn FROM ({MINUTES_SQL}) l JOIN customer ON c_custkey = o_custkey),
    f(k, n, used, accepted) AS (
        SELECT DISTINCT o_custkey, CAST(0 AS BIGINT), CAST(0 AS BIGINT), false FROM r
        UNION ALL SELECT k, rn, CASE WHEN used + m - included <= 600 THEN used + m ELSE used END, used + m - included <= 600 FROM f JOIN r ON o_custkey = k AND rn = n + 1)
    SELECT o_custkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, accepted, used FROM f JOIN r ON o_custkey = k AND rn = n""")
def quota_fold(spark, d):
    """The metering transaction: rejected records do not count towards later ones (bound as in quota_gate)."""
    plan = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), included().alias("included"))
    records = minutes(spark, d).select("o_custkey", *ORDER, "m").join(plan, "o_custkey")
    return metering.quota_fold(records, "o_custkey", "m", "included", ORDER, bound=600).select("o_custkey", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "accepted", "used")


@query(f"SELECT c_custkey, CAST(floor(greatest(0, used - included) / 60.0 * 200 + 0.0) AS BIGINT) AS charge_cents FROM ({BALANCES_SQL})")
def overage_charge(spark, d):
    over = F.greatest(F.lit(0), F.col("used") - F.col("included"))
    return balances(spark, d).select("c_custkey", F.floor(over / F.lit(60.0) * 200).cast("long").alias("charge_cents"))


@query(f"SELECT c_custkey, included, CAST(greatest(0, included - used) AS BIGINT) AS remaining, CAST(greatest(0, used - included) AS BIGINT) AS overage FROM (SELECT c_custkey, used, CAST(greatest(0, included + (c_nationkey - 12) * 10) AS BIGINT) AS included FROM ({BALANCES_SQL}))")
def plan_adjust(spark, d):
    changed = balances(spark, d).withColumn("included", F.greatest(F.lit(0), F.col("included") + (F.col("c_nationkey") - 12) * 10).cast("long"))
    return changed.select("c_custkey", "included", F.greatest(F.lit(0), F.col("included") - F.col("used")).cast("long").alias("remaining"), F.greatest(F.lit(0), F.col("used") - F.col("included")).cast("long").alias("overage"))


def duration_minutes(size_mb):
    """Estimated minutes of a video of so many MB: a minute for 15, at least half, at most 60."""
    return F.least(F.greatest(size_mb / 15.0, F.lit(0.5)), F.lit(60.0))


@query("SELECT p_partkey, least(greatest(p_retailprice / 15.0, 0.5), 60.0) AS minutes FROM part")
def duration_estimate(spark, d):
    return load(spark, d, "part").select("p_partkey", duration_minutes(F.col("p_retailprice")).alias("minutes"))


@query(f"""SELECT p_partkey, c_custkey IS NULL OR (included - used > 0 AND least(greatest(p_retailprice / 15.0, 0.5), 60.0) <= included - used) AS accepted
    FROM part LEFT JOIN ({BALANCES_SQL}) ON c_custkey = p_partkey""")
def upload_gate(spark, d):
    parts, b = load(spark, d, "part"), balances(spark, d)
    left = F.col("included") - F.col("used")
    fits = (left > 0) & (duration_minutes(F.col("p_retailprice")) <= left)
    return parts.join(b, parts.p_partkey == b.c_custkey, "left").select("p_partkey", (F.col("c_custkey").isNull() | fits).alias("accepted"))


@query("""SELECT user_id, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS used, max(cycle) AS cycle FROM (
    SELECT *, max(cycle) OVER (PARTITION BY user_id) AS last FROM (
    SELECT *, CAST(sum(CASE WHEN event_type IN ('signup', 'purchase') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cycle FROM events)) WHERE cycle = last GROUP BY user_id""")
def billing_fold(spark, d):
    """Usage since the last reset: a checkout (purchase) or a billing cycle (signup) starts from zero."""
    events = load(spark, d, "events")
    place = F.struct("ts", "event_id")
    # the last reset by an aggregate, then one join: no window over a customer's whole history
    reset = F.when(F.col("event_type").isin("signup", "purchase"), place)
    cycles = events.groupBy("user_id").agg(F.max(reset).alias("last"), F.count(reset).alias("cycle"))
    after = events.join(cycles, "user_id").where(F.col("last").isNull() | (place >= F.col("last")))
    return after.groupBy("user_id", "cycle").agg(F.count_if(F.col("event_type") == "click").alias("used")).select("user_id", "used", "cycle")


SUBSCRIPTION_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_type AS t, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    f(user_id, n, customer, plan, status, used, period_start) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), false, 'FREE', 'active', CAST(0 AS BIGINT), CAST(NULL AS TIMESTAMP) FROM e
        UNION ALL SELECT f.user_id, e.n, customer OR t = 'purchase',
            CASE WHEN t = 'purchase' THEN CASE k % 3 WHEN 0 THEN 'STARTER' WHEN 1 THEN 'PRO' ELSE 'ENTERPRISE' END WHEN customer AND t = 'error' THEN 'FREE' ELSE plan END,
            CASE WHEN t = 'purchase' THEN 'active' WHEN customer AND t = 'error' THEN 'canceled' WHEN customer AND t = 'view' THEN CASE k % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'canceled' WHEN 2 THEN 'past_due' ELSE 'incomplete' END ELSE status END,
            CASE WHEN t = 'purchase' OR (customer AND t IN ('error', 'signup')) THEN 0 WHEN t = 'click' THEN used + k ELSE used END,
            CASE WHEN t = 'purchase' OR (customer AND t IN ('signup', 'view')) THEN e.ts ELSE period_start END
        FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
    SELECT user_id, plan AS plan_type, status, CASE plan WHEN 'FREE' THEN 300 WHEN 'STARTER' THEN 3000 WHEN 'PRO' THEN 12000 ELSE 60000 END AS minutes_included, used AS minutes_used, period_start AS current_period_start
    FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1"""


@query(SUBSCRIPTION_SQL)
def subscription_fold(spark, d):
    """Payment events folded into subscriptions: purchase is a checkout (plan by k), signup a billing cycle, view an
    update (status by k), error a deletion; a click uses k minutes."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.create_map(*map(F.lit, ("purchase", "checkout", "signup", "cycle", "view", "updated", "error", "deleted", "click", "usage")))[F.col("event_type")]
    plan = F.get(F.array(*map(F.lit, ("STARTER", "PRO", "ENTERPRISE"))), (k % 3).cast("int"))
    status = F.get(F.array(*map(F.lit, ("active", "canceled", "past_due", "trialing"))), (k % 4).cast("int"))
    events = load(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("place"), kind.alias("kind"), plan.alias("plan"), status.alias("status"), k.alias("minutes"), F.col("ts").alias("period_start"))
    return metering.subscriptions(events, "user_id")


@query("SELECT c_custkey AS user_id, 'profile' AS kind, c_name AS detail FROM customer UNION ALL SELECT c_custkey, 'subscription', 'FREE' FROM customer")
def signup_fanout(spark, d):
    rows = F.explode(F.array(F.struct(F.lit("profile").alias("kind"), F.col("c_name").alias("detail")), F.struct(F.lit("subscription").alias("kind"), F.lit("FREE").alias("detail")))).alias("r")
    return load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), rows).select("user_id", "r.*")


@query("""WITH s AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_nationkey AS n, CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 300 ELSE 3000 END AS BIGINT) AS included, CAST(floor(abs(c_acctbal)) AS BIGINT) AS used FROM customer)
    SELECT id, n IN (1, 2) AS admin, n = 2 AS super_admin, used + 50 - included <= 6000 AS success, CASE WHEN used + 50 - included <= 6000 THEN used + 50 ELSE used END AS minutes_used FROM s WHERE n % 3 <> 0
    UNION ALL SELECT id, n IN (1, 2), n = 2, NULL, NULL FROM s WHERE n % 3 = 0""")
def sql_functions(spark, d):
    """Role checks and the answer to 50 minutes more, for every customer, by the session's own SQL functions."""
    people, n = load(spark, d, "customer"), F.col("c_nationkey")
    who = F.col("c_custkey").cast("string")
    people.select(who.alias("id"), F.when(n == 1, "admin").when(n == 2, "super_admin").otherwise("user").alias("role")).createOrReplaceTempView("user_profiles")
    plan = F.when(F.col("c_mktsegment") == "BUILDING", 300).otherwise(3000).cast("long")
    people.select(who.alias("user_id"), F.when(n % 3 == 0, "canceled").otherwise("active").alias("status"), plan.alias("minutes_included"), F.floor(F.abs("c_acctbal")).cast("long").alias("minutes_used")).createOrReplaceTempView("subscriptions")
    sqlfunctions.register(spark)
    return spark.sql("SELECT p.id, is_admin(p.id) AS admin, is_super_admin(p.id) AS super_admin, a.success, a.minutes_used FROM user_profiles p LEFT JOIN LATERAL usage_answer(p.id, 50) a")

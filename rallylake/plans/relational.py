"""Scans, filters, joins, aggregates, sorts and set operations on the stand-in tables.

customer = user profiles, orders = videos (owner o_custkey; F completed, P processing, O uploaded;
priority 5-LOW = deleted), lineitem = usage, events = job updates, documents = articles.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rallylake.functions import js
from rallylake.operators import relational as R
from rallylake.plans.base import NOW, query
from rallylake.sources import objects, schemas, store
from rallylake.sources.scratch import scratch
from rallylake.sources.tables import load

LINE_ORDER = ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity"]


@query("SELECT * FROM nation")
def scan_all(spark, d):
    return load(spark, d, "nation")


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
def project_cols(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")


@query("SELECT o_orderkey AS video_id, o_custkey AS user_id, o_orderdate AS uploaded_at, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'processing' ELSE 'uploaded' END AS status FROM orders")
def project_rename(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "processing").otherwise("uploaded")
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("video_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("uploaded_at"), status.alias("status"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(spark, d):
    return load(spark, d, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def filter_and(spark, d):
    return load(spark, d, "orders").where((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey", "o_custkey")


@query("SELECT event_id, user_id, props FROM events WHERE props IS NOT NULL UNION ALL SELECT event_id, user_id, props FROM events WHERE props IS NULL")
def filter_is_null(spark, d):
    """Null and non-null parts of a stored column; both conditions reach the Parquet scan."""
    events = load(spark, d, "events").select("event_id", "user_id", "props")
    return events.where(F.col("props").isNotNull()).unionByName(events.where(F.col("props").isNull()))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_in(spark, d):
    return load(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate <= TIMESTAMP '1995-03-31'")
def filter_period(spark, d):
    rows = load(spark, d, "lineitem")
    begin, end = "1995-01-01", "1995-03-31"
    if begin and end:  # the period counts only if both bounds are given
        rows = rows.where(F.col("l_shipdate").between(F.lit(begin).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate")


@query(f"SELECT event_id FROM (SELECT event_id, CASE WHEN event_type <> 'view' THEN ts END AS expires FROM events) WHERE expires IS NULL OR expires > TIMESTAMP '{NOW}'")
def filter_expiry(spark, d):
    events = load(spark, d, "events").withColumn("expires", F.when(F.col("event_type") != "view", F.col("ts")))
    return events.where(R.live(F.col("expires"), F.lit(NOW).cast("timestamp_ntz"))).select("event_id")


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_name ILIKE '%on_1%' OR n_name ILIKE '%on_1%'")
def search_ilike(spark, d):
    customer, nation = load(spark, d, "customer"), load(spark, d, "nation")
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    return joined.where(R.search("on_1", F.col("c_name"), F.col("n_name"))).select("c_custkey", "c_name", "n_name")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'bolt') OR contains(lower(p_brand), 'bolt') OR contains(lower(p_type), 'bolt')")
def search_contains(spark, d):
    return load(spark, d, "part").where(R.search("BOLT", F.col("p_name"), F.col("p_brand"), F.col("p_type"), wildcard=False)).select("p_partkey")


@query("SELECT doc_id, source, lang FROM documents WHERE lang = 'en' ORDER BY doc_id DESC LIMIT 10")
def published_page(spark, d):
    return R.page(load(spark, d, "documents").where("lang = 'en'").select("doc_id", "source", "lang"), 1, 10, F.desc("doc_id"))


@query("SELECT o_custkey, count(*) AS n_all, count(*) FILTER (o_orderstatus = 'F') AS n_ready, count(*) FILTER (o_orderstatus IN ('O', 'P')) AS n_processing FROM orders GROUP BY o_custkey")
def tab_counts(spark, d):
    status = F.col("o_orderstatus")
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_all"), F.count_if(status == "F").alias("n_ready"), F.count_if(status.isin("O", "P")).alias("n_processing"))


@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer")
def sort_desc(spark, d):
    rows = load(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    return rows.orderBy(F.desc_nulls_first("segment"), "c_custkey")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def page_offset(spark, d):
    return R.page(load(spark, d, "customer").select("c_custkey", "c_acctbal"), 3, 20, F.desc("c_acctbal"), F.asc("c_custkey"))


@query("SELECT c_mktsegment, count(*) AS n, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM customer GROUP BY c_mktsegment")
def page_count(spark, d):
    return load(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("pages", R.page_count(F.col("n"), 20))


@query("SELECT o_custkey, least(count(*), 10) = 10 AS has_more FROM orders GROUP BY o_custkey")
def has_more(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey").agg((F.least(F.count("*"), F.lit(10)) == 10).alias("has_more"))


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) = 1 AS featured FROM documents")
def featured_split(spark, d):
    # by an aggregate and a join, which Spark can split: a window would gather a language in one task
    docs = load(spark, d, "documents").select("doc_id", "lang")
    first = docs.groupBy("lang").agg(F.min("doc_id").alias("first"))
    return docs.join(first, "lang").select("doc_id", "lang", (F.col("doc_id") == F.col("first")).alias("featured"))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey HAVING count(*) = 1")
def single_row(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("o_orderkey")).where("n = 1").drop("n")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_per_key(spark, d):
    return load(spark, d, "events").groupBy("user_id").agg(R.latest("event_type", "ts", "event_id").alias("event_type"), F.max("ts").alias("ts"))


@query("SELECT r_name, count(n_name) AS nations, coalesce(string_agg(n_name, ',' ORDER BY n_name), '') AS names FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def embed_left(spark, d):
    nested = R.embed(load(spark, d, "region"), load(spark, d, "nation"), "r_regionkey", "n_regionkey", "nations", ["n_name"])
    return nested.select("r_name", F.size("nations").cast("long").alias("nations"), F.array_join(F.transform("nations", lambda x: x["n_name"]), ",").alias("names"))


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def embed_parent(spark, d):
    s, n, r = (load(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("s_suppkey", "s_name", "n_name", "r_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_exists(spark, d):
    c, o = load(spark, d, "customer"), load(spark, d, "orders").where("o_orderstatus = 'F'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) / count(*) FROM orders)")
def scalar_subquery(spark, d):
    load(spark, d, "orders").createOrReplaceTempView("_orders_scalar")
    return spark.sql("SELECT o_orderkey FROM _orders_scalar WHERE o_totalprice > (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) / count(*) FROM _orders_scalar)")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_default(spark, d):
    return load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query(f"SELECT l_orderkey, l_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS rn FROM lineitem) JOIN part ON l_partkey = p_partkey WHERE rn = 1")
def lookup_first(spark, d):
    first = R.first_per_key(load(spark, d, "lineitem").select("l_orderkey", *LINE_ORDER), ["l_orderkey"], *LINE_ORDER)
    part = load(spark, d, "part").select("p_partkey", "p_name")
    return first.join(part, first.l_partkey == part.p_partkey).select("l_orderkey", "l_partkey", "p_name")


@query("""SELECT c_custkey, coalesce(a.n_name, b.n_name) AS nation FROM customer
    LEFT JOIN nation a ON c_custkey % 2 = 0 AND c_nationkey = a.n_nationkey
    LEFT JOIN (SELECT n_regionkey, min(n_name) AS n_name FROM nation GROUP BY n_regionkey) b ON c_nationkey % 5 = b.n_regionkey""")
def fallback_join(spark, d):
    c, n = load(spark, d, "customer"), load(spark, d, "nation")
    first = n.select("n_nationkey", F.col("n_name").alias("first_name"))
    second = n.groupBy("n_regionkey").agg(F.min("n_name").alias("second_name"))
    keyed = c.withColumn("first_key", F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey"))).withColumn("second_key", F.col("c_nationkey") % 5)
    return keyed.join(first, keyed.first_key == first.n_nationkey, "left").join(second, keyed.second_key == second.n_regionkey, "left").select("c_custkey", F.coalesce("first_name", "second_name").alias("nation"))


@query("""SELECT u.user_id, coalesce(c_name, CASE WHEN u.user_id % 3 = 0 THEN 'guest-' || u.user_id ELSE 'Player ' || u.user_id END) AS label, CASE WHEN u.user_id % 3 = 0 THEN 'GUEST-' || u.user_id ELSE 'P' || u.user_id END AS short
    FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN customer ON c_custkey = u.user_id AND c_custkey % 2 = 0""")
def name_overlay(spark, d):
    number = F.col("user_id").cast("string")
    key = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("guest-"), number)).otherwise(F.concat(F.lit("a PLAYER_"), number))
    users = load(spark, d, "events").select("user_id").distinct().withColumn("player", key)
    names = load(spark, d, "customer").where("c_custkey % 2 = 0").select("c_custkey", "c_name")
    return users.join(names, users.user_id == names.c_custkey, "left").select("user_id", F.coalesce("c_name", js.player_label(F.col("player"))).alias("label"), js.player_label(F.col("player"), short=True).alias("short"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_missing(spark, d):
    return load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels"), "doc_id", "left_anti")


@query("""SELECT doc_id, 'label' AS side FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT doc_id, 'document' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def fk_orphans(spark, d):
    docs, labels = (load(spark, d, t).select("doc_id") for t in ("documents", "labels"))
    return labels.join(docs, "doc_id", "left_anti").withColumn("side", F.lit("label")).unionByName(docs.join(labels, "doc_id", "left_anti").withColumn("side", F.lit("document")))


@query("SELECT o_orderkey, coalesce(bool_and(l_linestatus = 'F'), true) AS ready FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def deps_ready(spark, d):
    steps = load(spark, d, "orders").select("o_orderkey")
    done = load(spark, d, "lineitem").groupBy("l_orderkey").agg(R.every(F.col("l_linestatus") == "F").alias("ready"))
    return steps.join(done, steps.o_orderkey == done.l_orderkey, "left").select("o_orderkey", F.coalesce("ready", F.lit(True)).alias("ready"))


@query("SELECT 'nation' AS table_name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', count(*) FROM supplier")
def count_rows(spark, d):
    one = lambda t: load(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
    return one("nation").union(one("region")).union(one("supplier"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n FROM orders GROUP BY o_orderpriority")
def count_if(spark, d):
    return load(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n"))


def _returned(spark, d, aggregate, default):
    orders = load(spark, d, "orders").select("o_orderkey")
    lines = load(spark, d, "lineitem").groupBy("l_orderkey").agg(aggregate.alias("flag"))
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select("o_orderkey", F.coalesce("flag", F.lit(default)).alias("flag"))


@query("SELECT o_orderkey, coalesce(bool_or(l_returnflag = 'R'), false) AS flag FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def bool_any(spark, d):
    return _returned(spark, d, F.bool_or(F.col("l_returnflag") == "R"), False)


@query("SELECT o_orderkey, coalesce(bool_and(l_returnflag = 'R'), true) AS flag FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def bool_all(spark, d):
    return _returned(spark, d, R.every(F.col("l_returnflag") == "R"), True)


@query("SELECT DISTINCT user_id FROM events")
def distinct_keys(spark, d):
    return load(spark, d, "events").select("user_id").distinct()


@query("SELECT user_id, count(DISTINCT event_type) AS types FROM events GROUP BY user_id")
def count_distinct(spark, d):
    return load(spark, d, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("types"))


@query(f"SELECT user_id, count(*) AS views FROM events WHERE event_type = 'view' AND (CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 THEN ts END IS NULL OR ts > TIMESTAMP '{NOW}') GROUP BY user_id")
def view_counts(spark, d):
    expires = F.when(F.get_json_object("props", "$.k").cast("int") % 2 == 0, F.col("ts"))
    events = load(spark, d, "events").where("event_type = 'view'").where(R.live(expires, F.lit(NOW).cast("timestamp_ntz")))
    return events.groupBy("user_id").agg(F.count("*").alias("views"))


@query("""SELECT b.c_custkey, CASE WHEN u.o_custkey IS NOT NULL THEN 'VIP' ELSE c_mktsegment END AS segment FROM customer b
    LEFT JOIN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey HAVING count(*) > 8) u ON u.o_custkey = b.c_custkey
    UNION ALL SELECT -1 AS c_custkey, 'VIP' AS segment""")
def merge_upsert(spark, d):
    base = load(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    hot = load(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").count().where("count > 8")
    updates = hot.select(F.col("o_custkey").alias("c_custkey"), F.lit("VIP").alias("segment")).union(spark.range(1).select(F.lit(-1).cast("long"), F.lit("VIP")))
    return R.upsert(base, updates, "c_custkey")


@query("SELECT d.doc_id, coalesce(l.quality, 0) AS quality, l.doc_id IS NULL AS created FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def get_or_create(spark, d):
    docs, labels = load(spark, d, "documents").select("doc_id"), load(spark, d, "labels").select("doc_id", "quality", F.lit(False).alias("created"))
    return docs.join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("created", F.lit(True)).alias("created"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def delete_anti(spark, d):
    orders = load(spark, d, "orders")
    gone = orders.where("o_orderstatus = 'P'").select("o_orderkey")
    return orders.join(gone, "o_orderkey", "left_anti").select("o_orderkey")


@query(f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'deleted' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'P' THEN TIMESTAMP '{NOW}' END AS deleted_at FROM orders")
def soft_delete(spark, d):
    gone = F.col("o_orderstatus") == "P"
    return load(spark, d, "orders").select("o_orderkey", F.when(gone, "deleted").otherwise(F.col("o_orderstatus")).alias("status"), F.when(gone, F.lit(NOW).cast("timestamp_ntz")).alias("deleted_at"))


@query("SELECT s_suppkey, count(*) OVER (PARTITION BY s_nationkey) > 1 AS may_demote FROM supplier")
def guard_last(spark, d):
    suppliers = load(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    counts = suppliers.groupBy("s_nationkey").agg((F.count("*") > 1).alias("may_demote"))
    return suppliers.join(counts, "s_nationkey").select("s_suppkey", "may_demote")


@query("""SELECT user_id, event_id, CASE WHEN event_type = 'purchase' AND prev IS DISTINCT FROM 'purchase' THEN ts END AS published_at,
    event_type = 'signup' AND prev = 'purchase' AS cleared FROM (
    SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events WHERE event_type IN ('signup', 'purchase'))""")
def publish_transition(spark, d):
    events = load(spark, d, "events").where(F.col("event_type").isin("signup", "purchase"))
    events = events.withColumn("prev", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    stamp = F.when((F.col("event_type") == "purchase") & ~F.col("prev").eqNullSafe("purchase"), F.col("ts"))
    return events.select("user_id", "event_id", stamp.alias("published_at"), ((F.col("event_type") == "signup") & (F.col("prev") == "purchase")).alias("cleared"))


@query("""SELECT 'discount_range' AS rule, count(*) FILTER (NOT (l_discount BETWEEN 0 AND 0.05)) AS violations FROM lineitem
    UNION ALL SELECT 'small_quantity', count(*) FILTER (NOT coalesce(nullif(l_quantity, 50) <= 30, true)) FROM lineitem""")
def check_violations(spark, d):
    return R.violations(load(spark, d, "lineitem"), {"discount_range": F.col("l_discount").between(0, 0.05), "small_quantity": F.nullif("l_quantity", F.lit(50.0)) <= 30})


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def unique_violations(spark, d):
    return load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def rls_owner(spark, d):
    return R.owner_filter(load(spark, d, "orders"), "o_custkey", 7).select("o_orderkey")


@query("SELECT o_orderkey FROM orders")
def rls_admin(spark, d):
    return R.owner_filter(load(spark, d, "orders"), "o_custkey", 7, admin=True).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderpriority <> '5-LOW'")
def rls_soft_delete(spark, d):
    return R.owner_filter(load(spark, d, "orders"), "o_custkey", 7, deleted=F.col("o_orderpriority") == "5-LOW").select("o_orderkey")


@query("""WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer) SELECT c_custkey, CASE WHEN rn <= 10 THEN 1 ELSE 2 END AS page FROM p WHERE rn <= 20""")
def union_pages(spark, d):
    keys = load(spark, d, "customer").select("c_custkey")
    first, second = (R.page(keys, k, 10, F.asc("c_custkey")).withColumn("page", F.lit(k)) for k in (1, 2))
    return first.unionByName(second)


@query("""SELECT user_id, array_to_string(list_sort(list_distinct(list_append(t, 'tag'))), ',') AS added, array_to_string(list_sort(list_filter(t, lambda x: x <> 'view')), ',') AS removed
    FROM (SELECT user_id, list(DISTINCT event_type) AS t FROM events GROUP BY user_id)""")
def array_set_ops(spark, d):
    tags = load(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("t"))
    return tags.select("user_id", F.array_join(F.array_sort(F.array_union("t", F.array(F.lit("tag")))), ",").alias("added"), F.array_join(F.array_sort(F.array_remove("t", "view")), ",").alias("removed"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type")
def map_explode(spark, d):
    counts = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select("user_id", F.explode("m").alias("event_type", "n"))


@query("""SELECT user_id, string_agg(DISTINCT upper(event_type), ', ' ORDER BY upper(event_type)) FILTER (event_type <> 'view') AS types FROM events GROUP BY user_id""")
def array_hof(spark, d):
    types = load(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("t"))
    joined = F.array_join(F.transform(F.filter("t", lambda x: x != "view"), lambda x: F.upper(x)), ", ")
    return types.select("user_id", F.nullif(joined, F.lit("")).alias("types"))


SHARE_SQL = """SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' AND o_orderdate < TIMESTAMP '1996-06-01' THEN 410 WHEN NOT coalesce(analysis, false) THEN 202 ELSE 200 END AS status,
    o_custkey, coalesce(analyzed, false) AS analyzed, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey
    LEFT JOIN (SELECT l_orderkey, bool_or(l_linenumber = 2) AS analysis, bool_or(l_linenumber = 3) AS analyzed FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""


def session_files(spark, d):
    """Per session (order) its files: line numbers stand for file names."""
    names = F.array(*map(F.lit, ("video.mp4", "position_analysis.json", "analyzed_video.mp4", "calibration_summary.json", "calibration.csv", "court.csv", "pose.json")))
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.get(names, (F.col("l_linenumber") - 1).cast("int")).alias("file_name"))


@query(f"""SELECT o_orderkey, status, CASE WHEN status = 200 THEN 'dev/' || o_custkey || '/' || o_orderkey || CASE WHEN analyzed THEN '/analyzed_video.mp4' ELSE '/video.mp4' END END AS video_key,
    CASE WHEN status = 200 THEN coalesce(c_name, '') END AS player_names, CAST(CASE WHEN status = 200 THEN 1 ELSE 0 END AS INT) AS views FROM ({SHARE_SQL})""")
def share_document(spark, d):
    """What a share link gives: gone if expired, not ready without the analysis, else the video to show and the names."""
    there = {"analysis": "position_analysis.json", "analyzed": "analyzed_video.mp4"}
    files = session_files(spark, d).groupBy("o_orderkey").agg(*[F.bool_or(F.col("file_name") == x).alias(n) for n, x in there.items()])
    shares = load(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate")).alias("expires"))
    names = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    now = F.lit("1996-06-01").cast("timestamp_ntz")
    rows = shares.join(files, "o_orderkey", "left").join(names, "o_custkey", "left")
    status = F.when(F.col("expires") < now, 410).when(~F.coalesce("analysis", F.lit(False)), 202).otherwise(200)
    shown = F.when(F.coalesce("analyzed", F.lit(False)), "analyzed_video.mp4").otherwise("video.mp4")
    key = F.concat_ws("/", F.lit("dev"), F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), shown)
    good = F.col("status") == 200
    return rows.withColumn("status", status).select("o_orderkey", "status", F.when(good, key).alias("video_key"), F.when(good, F.coalesce("c_name", F.lit(""))).alias("player_names"), F.when(good, 1).otherwise(0).alias("views"))


@query("SELECT l.doc_id, source || '-' || l.doc_id AS slug, lang, length(text) AS chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE quality = 1")
def blog_document(spark, d):
    """A published post by its slug, with its body read by the content key."""
    posts = load(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("content_key"))
    bodies = load(spark, d, "documents").select(F.col("doc_id").alias("content_key"), "source", "lang", "text")
    joined = posts.join(bodies, "content_key")
    return joined.select(F.col("content_key").alias("doc_id"), F.concat_ws("-", "source", F.col("content_key").cast("string")).alias("slug"), "lang", F.length("text").cast("long").alias("chars"))


@query("""SELECT o_orderkey, CASE WHEN NOT summary THEN 'files' WHEN o_orderkey % 10 = 0 THEN 'error' ELSE 'summary' END AS kind, CASE WHEN summary AND o_orderkey % 10 <> 0 THEN o_totalprice END AS reprojection_error,
    CASE WHEN summary AND o_orderkey % 10 <> 0 THEN calibration ELSE analysis END AS files FROM (SELECT o_orderkey, o_totalprice, bool_or(coalesce(l_linenumber = 4, false)) AS summary,
    coalesce(string_agg(DISTINCT f, ',' ORDER BY f) FILTER (l_linenumber IN (4, 5, 6)), '') AS calibration, coalesce(string_agg(DISTINCT f, ',' ORDER BY f) FILTER (l_linenumber <> 1), '') AS analysis
    FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, list_extract(['video.mp4', 'position_analysis.json', 'analyzed_video.mp4', 'calibration_summary.json', 'calibration.csv', 'court.csv', 'pose.json'], l_linenumber) AS f FROM lineitem) ON l_orderkey = o_orderkey GROUP BY ALL)""")
def calibration_results(spark, d):
    """The calibration summary of a session with its files; all analysis files where there is none or it is no JSON."""
    name = F.col("file_name")
    one = lambda condition: F.array_join(F.array_sort(F.collect_set(F.when(condition, name))), ",")
    files = session_files(spark, d).groupBy("o_orderkey").agg(F.bool_or(name == "calibration_summary.json").alias("there"), one(name.isin("court.csv", "calibration.csv", "calibration_summary.json")).alias("calibration"), one(~F.startswith(name, F.lit("video."))).alias("analysis"))
    orders = load(spark, d, "orders").select("o_orderkey", "o_totalprice").join(files, "o_orderkey", "left")
    content = F.when(F.col("o_orderkey") % 10 == 0, "no JSON").otherwise(F.to_json(F.struct(F.col("o_totalprice").alias("reprojection_error_pixels"))))
    rows = orders.withColumn("summary", F.when(F.col("there"), objects.parsed(content, schemas.SUMMARY)))
    good = F.col("summary").isNotNull()
    kind = F.when(good, "summary").when(F.col("there"), "error").otherwise("files")
    return rows.select("o_orderkey", kind.alias("kind"), F.col("summary.reprojection_error_pixels").alias("reprojection_error"), F.coalesce(F.when(good, F.col("calibration")).otherwise(F.col("analysis")), F.lit("")).alias("files"))


@query("""SELECT o_orderkey, analyzed AS exists, CASE WHEN analyzed THEN '/api/video-stream?key=dev%2F' || o_custkey || '%2F' || o_orderkey || '%2Fanalyzed_video.mp4' END AS url
    FROM (SELECT o_orderkey, o_custkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 3) AS analyzed FROM orders)""")
def processed_video_url(spark, d):
    found = session_files(spark, d).where("file_name = 'analyzed_video.mp4'").select("o_orderkey").distinct().withColumn("there", F.lit(True))
    key = F.concat_ws("/", F.lit("dev"), F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), F.lit("analyzed_video.mp4"))
    rows = load(spark, d, "orders").select("o_orderkey", "o_custkey").join(found, "o_orderkey", "left")
    return rows.select("o_orderkey", F.coalesce("there", F.lit(False)).alias("exists"), F.when(F.col("there"), F.concat(F.lit("/api/video-stream?key="), F.url_encode(key))).alias("url"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'P' THEN TIMESTAMP '{NOW}' ELSE o_orderdate END AS updated_at FROM orders")
def updated_touch(spark, d):
    """An update stamps the rows that it changes and no others."""
    orders = load(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated_at"))
    return R.touched(orders, F.col("status") == "P", {"status": F.lit("F")}, F.lit(NOW).cast("timestamp_ntz"))


@query("SELECT user_id, min(event_type) AS tracked FROM events GROUP BY user_id")
def first_value(spark, d):
    """Of a map only the first value, in the order of its keys."""
    maps = load(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("keys"))
    return maps.select("user_id", F.get(F.map_values(F.map_from_arrays("keys", "keys")), F.lit(0)).alias("tracked"))


@query("""WITH base AS (SELECT o_orderkey, o_orderstatus AS status, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders),
    a AS (SELECT b.o_orderkey, coalesce(u.status, b.status) AS status, b.price FROM base b LEFT JOIN (SELECT o_orderkey, 'VIP' AS status FROM base WHERE o_orderkey % 7 = 0) u USING (o_orderkey) UNION ALL SELECT -1, 'VIP', 0)
    SELECT o_orderkey, status, CASE WHEN o_orderkey % 10 = 1 THEN 0 ELSE price END AS price FROM a WHERE o_orderkey % 5 <> 0""")
def stored_changes(spark, d):
    """A table changed in place by four batches: all rows, upserts (sent twice), updates and deletions."""
    orders = load(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.floor("o_totalprice").cast("long").alias("price"))
    table = store.Store(spark, scratch(spark, "store"), "o_orderkey long, status string, price long", "o_orderkey")
    table.upsert(orders, "1-load")
    news = orders.where("o_orderkey % 7 = 0").withColumn("status", F.lit("VIP")).union(spark.range(1).select(F.lit(-1).cast("long"), F.lit("VIP"), F.lit(0).cast("long")))
    for _ in range(2):
        table.upsert(news, "2-upsert")
    table.update(orders.where("o_orderkey % 10 = 1"), {"price": F.lit(0).cast("long")}, "3-update")
    table.delete(orders.where("o_orderkey % 5 = 0"), "4-delete")
    return table.rows()


@query("""SELECT user_id, k AS field, count(*) AS n, CAST(sum(TRY_CAST(json_extract_string(j, '$.' || k) AS BIGINT)) FILTER (json_type(j, '$.' || k) <> 'VARCHAR') AS BIGINT) AS total,
    string_agg(DISTINCT CASE json_type(j, '$.' || k) WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'OBJECT' THEN 'OBJECT' ELSE json_type(j, '$.' || k) END, ',' ORDER BY 1) AS types
    FROM (SELECT user_id, j, unnest(json_keys(j)) AS k FROM (SELECT user_id, CASE WHEN event_id % 3 = 0 THEN CAST(json_object('kind', event_type, 'n', event_id) AS JSON) ELSE CAST(props AS JSON) END AS j FROM events)) GROUP BY user_id, k""")
def artifact_fields(spark, d):
    """Artifacts whose fields nobody has declared: each field with its count, whole-number total and types."""
    e = load(spark, d, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("event_id").alias("n")))).otherwise(F.col("props"))
    rows = objects.variant_fields(e.select("user_id", F.try_parse_json(text).alias("doc")), "doc")
    number = F.try_variant_get("value", "$", "long")
    return rows.groupBy("user_id", "field").agg(F.count("*").alias("n"), F.sum(F.when(F.col("type") == "BIGINT", number)).alias("total"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))

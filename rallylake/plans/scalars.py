"""Scalar functions: text, numbers, dates, JSON and object keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallylake.functions import js
from rallylake.operators import jobs
from rallylake.operators import relational as R
from rallylake.plans.base import query
from rallylake.sources import objects
from rallylake.sources.tables import load


def k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


K = "CAST(json_extract_string(props, '$.k') AS INT)"


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 7 ELSE p_size % 5 END AS size FROM part")
def js_or_default(spark, d):
    return load(spark, d, "part").select("p_partkey", js.or_default(F.col("p_size") % 5, F.lit(7)).alias("size"))


SPACE_SQL = r"\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^0-9A-Za-z_{SPACE_SQL}-]', '', 'g'), '[{SPACE_SQL}]+', '-', 'g') AS slug FROM documents")
def slugify(spark, d):
    return load(spark, d, "documents").select("doc_id", js.slugify(F.col("text")).alias("slug"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(name, '[', '('), ']', ')'), '/', '-'), chr(92), '-'), '<', '_'), '>', '_'), ':', '_'), '"', '_'), '|', '_'), '?', '_'), '*', '_'), '[ \t\n]+', ' ', 'g')) AS name
    FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '  ' || url || '[1]  b?.mp4 ' WHEN 1 THEN 'x<y>:"z"|*' || chr(92) || url ELSE url END AS name FROM pages)""")
def sanitize_name(spark, d):
    k3 = F.col("page_id") % 3
    raw = F.when(k3 == 0, F.concat(F.lit("  "), "url", F.lit("[1]  b?.mp4 "))).when(k3 == 1, F.concat(F.lit('x<y>:"z"|*\\'), "url")).otherwise(F.col("url"))
    return load(spark, d, "pages").select("page_id", js.sanitize_name(raw).alias("name"))


@query(r"""SELECT page_id, ext, CASE lower(ext) WHEN 'html' THEN 'application/octet-stream' WHEN 'mp4' THEN 'video/mp4' ELSE 'application/octet-stream' END AS mime
    FROM (SELECT page_id, list_last(string_split(name, '.')) AS ext FROM (SELECT page_id, list_last(string_split(regexp_replace(url, '[?#].*$', ''), '/')) || CASE WHEN page_id % 2 = 0 THEN '.MP4' ELSE '.html' END AS name FROM pages))""")
def file_ext(spark, d):
    last = F.element_at(F.split(F.regexp_replace("url", "[?#].*$", ""), "/"), -1)
    name = F.concat(last, F.when(F.col("page_id") % 2 == 0, ".MP4").otherwise(".html"))
    return load(spark, d, "pages").select("page_id", js.extension(name).alias("ext")).withColumn("mime", js.mime(F.col("ext")))


@query("SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, ''), nullif(CASE WHEN c_custkey % 2 = 0 THEN 'user' || CAST(c_custkey AS VARCHAR) ELSE '' END, ''), 'User') AS display FROM customer")
def display_name(spark, d):
    full = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name"))
    email = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.com"))).otherwise("@example.com")
    return load(spark, d, "customer").select("c_custkey", js.display_name(full, email).alias("display"))


@query("SELECT c_custkey, regexp_replace(c_name, '0', 'o') AS name FROM customer")
def replace_first(spark, d):
    return load(spark, d, "customer").select("c_custkey", js.replace_first(F.col("c_name"), "0", "o").alias("name"))


@query(rf"SELECT doc_id, regexp_matches(text, '[^{SPACE_SQL}]') AND length(text) + len(regexp_extract_all(text, '[\x{{10000}}-\x{{10ffff}}]')) <= 255 AS valid FROM documents")
def rename_valid(spark, d):
    return load(spark, d, "documents").select("doc_id", js.valid_name(F.col("text")).alias("valid"))


@query(rf"SELECT doc_id, CAST(ceil(len(regexp_split_to_array(text, '[{SPACE_SQL}]+')) / 200.0) AS BIGINT) AS minutes FROM documents")
def reading_time(spark, d):
    return load(spark, d, "documents").select("doc_id", js.reading_minutes(F.col("text")).alias("minutes"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'webp' END AS format, CASE WHEN p_partkey % 4 < 2 THEN to_base64(encode(p_name)) END AS payload FROM part""")
def dataurl_parse(spark, d):
    k4, content = F.col("p_partkey") % 4, F.base64(F.encode("p_name", "utf-8"))
    url = F.when(k4 == 0, F.concat(F.lit("data:image/jpg;base64,"), content)).when(k4 == 1, F.concat(F.lit("data:image/webp;base64,"), content)).when(k4 == 2, F.concat(F.lit("data:text/plain,"), "p_name")).otherwise("")
    kind, payload = js.data_url(url)
    return load(spark, d, "part").select("p_partkey", kind.alias("format"), payload.alias("payload"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(trunc(c_acctbal) AS BIGINT) WHEN 1 THEN c_custkey WHEN 3 THEN c_custkey END AS n,
    CASE c_custkey % 4 WHEN 0 THEN c_acctbal WHEN 1 THEN CAST(c_custkey AS DOUBLE) WHEN 3 THEN c_custkey + 0.5::DOUBLE END AS x, coalesce(CASE c_custkey % 4 WHEN 0 THEN c_acctbal WHEN 1 THEN CAST(c_custkey AS DOUBLE) WHEN 3 THEN c_custkey + 0.5::DOUBLE END, 0) AS x_or_zero FROM customer""")
def parse_int(spark, d):
    k4, key = F.col("c_custkey") % 4, F.col("c_custkey").cast("string")
    raw = F.when(k4 == 0, F.concat(F.col("c_acctbal").cast("string"), F.lit("px"))).when(k4 == 1, F.concat(F.lit("  "), key, F.lit(" items"))).when(k4 == 3, F.concat(F.lit("+"), key, F.lit(".5.7"))).otherwise(F.col("c_name"))
    x = js.parse_float(raw)
    return load(spark, d, "customer").select("c_custkey", js.parse_int(raw).alias("n"), x.alias("x"), js.or_default(x, F.lit(0.0)).alias("x_or_zero"))


#: C's printing takes the exact binary value too, but exact halves to even: odd eighths are the only ones.
FIXED_SQL = "CASE WHEN {x} * 8 = floor({x} * 8) AND CAST({x} * 8 AS BIGINT) % 2 <> 0 THEN printf('%.2f', {x} + sign({x}) * 0.001) ELSE printf('%.2f', {x}) END"


@query("SELECT p_partkey, " + FIXED_SQL.format(x="price") + " AS price, " + FIXED_SQL.format(x="eighths") + " AS eighths, " + FIXED_SQL.format(x="cents") + " AS cents FROM (SELECT p_partkey, p_retailprice * 1.01::DOUBLE - 1500 AS price, (p_partkey - 700) / 8.0::DOUBLE AS eighths, p_partkey / 1000.0::DOUBLE AS cents FROM part)")
def fixed2(spark, d):
    return load(spark, d, "part").select("p_partkey", js.fixed2(F.col("p_retailprice") * 1.01 - 1500).alias("price"), js.fixed2((F.col("p_partkey") - 700) / 8.0).alias("eighths"), js.fixed2(F.col("p_partkey") / 1000.0).alias("cents"))


@query("SELECT p_partkey, CAST(floor((p_retailprice - 1000) * 2.5 + 0.5) AS BIGINT) AS rounded FROM part")
def js_round(spark, d):
    return load(spark, d, "part").select("p_partkey", js.js_round((F.col("p_retailprice") - 1000) * 2.5).alias("rounded"))


@query("""SELECT doc_id, CASE WHEN n = 0 THEN '0 Bytes' WHEN n >= 1073741824 THEN f(n / 1073741824.0::DOUBLE) || ' GB' WHEN n >= 1048576 THEN f(n / 1048576.0::DOUBLE) || ' MB' WHEN n >= 1024 THEN f(n / 1024.0::DOUBLE) || ' KB' ELSE f(n::DOUBLE) || ' Bytes' END AS size FROM (SELECT doc_id, n_chars * (doc_id % 7) * (doc_id % 11) AS n FROM documents)""".replace("f(n / 1073741824.0::DOUBLE)", "{0}").replace("f(n / 1048576.0::DOUBLE)", "{1}").replace("f(n / 1024.0::DOUBLE)", "{2}").replace("f(n::DOUBLE)", "CAST(n AS VARCHAR)").format(*[f"rtrim(rtrim(CAST(CAST(floor(n / {u} * 100 + 0.5) AS BIGINT) // 100 AS VARCHAR) || '.' || lpad(CAST(CAST(floor(n / {u} * 100 + 0.5) AS BIGINT) % 100 AS VARCHAR), 2, '0'), '0'), '.')" for u in ("CAST(1073741824 AS DOUBLE)", "CAST(1048576 AS DOUBLE)", "CAST(1024 AS DOUBLE)")]))
def human_bytes(spark, d):
    n = F.col("n_chars") * (F.col("doc_id") % 7) * (F.col("doc_id") % 11)
    return load(spark, d, "documents").select("doc_id", js.human_bytes(n).alias("size"))


@query("""SELECT event_id, CAST(CAST(floor(value) AS BIGINT) // 60 AS VARCHAR) || ':' || lpad(CAST(CAST(floor(value) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS time,
    CASE WHEN value < 60 THEN CAST(CAST(floor(value + 0.5) AS BIGINT) AS VARCHAR) || 's' ELSE CAST(CAST(floor(value / 60) AS BIGINT) AS VARCHAR) || 'm ' || CAST(CAST(floor(value - floor(value / 60) * 60 + 0.5) AS BIGINT) AS VARCHAR) || 's' END AS long_time FROM events""")
def fmt_mmss(spark, d):
    return load(spark, d, "events").select("event_id", js.mmss(F.col("value")).alias("time"), js.long_time(F.col("value")).alias("long_time"))


@query(f"""SELECT event_id, CASE WHEN total = 0 THEN 0 ELSE CAST(floor(100.0 * sent / total + 0.5) AS BIGINT) END AS pct, CASE WHEN k = 0 THEN 0.0 ELSE sent / k END AS speed,
    CASE WHEN sent = 0 THEN 0.0 WHEN k = 0 THEN 0.0 ELSE (total - sent) / (sent / k) END AS eta
    FROM (SELECT event_id, {K} AS k, CAST(floor(value) AS DOUBLE) AS sent, CAST(floor(value) + {K} AS DOUBLE) AS total FROM events)""")
def upload_progress(spark, d):
    sent, total = F.floor("value").cast("double"), (F.floor("value") + k()).cast("double")
    speed = F.when(k() == 0, 0.0).otherwise(sent / F.nullif(k(), F.lit(0)))
    return load(spark, d, "events").select(
        "event_id",
        F.when(total == 0, F.lit(0).cast("long")).otherwise(js.js_round(100.0 * sent / F.nullif(total, F.lit(0.0)))).alias("pct"),
        speed.alias("speed"),
        F.when((sent == 0) | (k() == 0), 0.0).otherwise((total - sent) / F.nullif(speed, F.lit(0.0))).alias("eta"),
    )


@query(f"SELECT event_id, CASE WHEN {K} <= 0 THEN 0.0 ELSE (value / {K}) * 100 END AS pct, CASE event_type WHEN 'click' THEN 'red' WHEN 'view' THEN 'blue' ELSE 'green' END AS color FROM events")
def marker_pct(spark, d):
    pct = F.when(k() <= 0, 0.0).otherwise(F.col("value") / F.nullif(k(), F.lit(0)) * 100)
    color = F.when(F.col("event_type") == "click", "red").when(F.col("event_type") == "view", "blue").otherwise("green")
    return load(spark, d, "events").select("event_id", pct.alias("pct"), color.alias("color"))


@query("SELECT event_id, low, CASE WHEN high = low THEN high + 1 ELSE high END AS high FROM (SELECT event_id, CAST(ceil(2 * (value / 60)) AS BIGINT) AS low, CAST(ceil(3 * (value / 60)) AS BIGINT) AS high FROM events)")
def step_eta(spark, d):
    low, high = (F.ceil(n * (F.col("value") / 60)).cast("long") for n in (2, 3))
    return load(spark, d, "events").select("event_id", low.alias("low"), F.when(high == low, high + 1).otherwise(high).alias("high"))


STAGE_SQL = "(SELECT event_id, k, (SELECT count(*) FROM (VALUES (20), (40), (60), (80)) t(x) WHERE k > x) AS short_stage, (SELECT count(*) FROM (VALUES (12), (25), (50), (65), (75), (85), (92)) t(x) WHERE k > x) AS long_stage FROM (SELECT event_id, " + K + " AS k FROM events))"


@query(f"SELECT event_id, CASE WHEN k < 20 THEN 'calibration' WHEN k < 40 THEN 'pose' WHEN k < 60 THEN 'position' WHEN k < 80 THEN 'artifacts' ELSE 'visualization' END AS stage, CAST(short_stage AS INT) AS short_stage, CAST(long_stage AS INT) AS long_stage FROM {STAGE_SQL}")
def stage_bucket(spark, d):
    stage = F.when(k() < 20, "calibration").when(k() < 40, "pose").when(k() < 60, "position").when(k() < 80, "artifacts").otherwise("visualization")
    return load(spark, d, "events").select("event_id", stage.alias("stage"), jobs.stage_index(k(), jobs.SHORT_STAGES).alias("short_stage"), jobs.stage_index(k(), jobs.LONG_STAGES).alias("long_stage"))


@query(f"SELECT event_id, CAST(1000 * (1 << ({K} % 6)) AS BIGINT) AS thumbnail_ms, CAST(2000 * (1 << ({K} % 6)) AS BIGINT) AS player_ms FROM events")
def backoff(spark, d):
    power = F.pow(F.lit(2), k() % 6).cast("long")
    return load(spark, d, "events").select("event_id", (power * 1000).alias("thumbnail_ms"), (power * 2000).alias("player_ms"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_part(spark, d):
    return load(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS month_end, o_orderdate + INTERVAL 29 DAY + INTERVAL 1 DAY AS thirty_days FROM orders")
def period_end(spark, d):
    return load(spark, d, "orders").select("o_orderkey", F.expr("o_orderdate + INTERVAL 1 MONTH").alias("month_end"), F.expr("o_orderdate + INTERVAL 30 DAYS").alias("thirty_days"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, coalesce(json_extract_string(props, '$.missing'), '') AS missing FROM events")
def json_field(spark, d):
    return load(spark, d, "events").select("event_id", *[F.coalesce(F.get_json_object("props", f"$.{name}"), F.lit("")).alias(name) for name in ("k", "missing")])


@query("""SELECT n_nationkey, '{"id":' || CAST(n_nationkey AS VARCHAR) || ',"name":"' || n_name || '"}' AS document FROM nation""")
def json_build(spark, d):
    return load(spark, d, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("document"))


@query(f"""SELECT event_id, CASE k % 5 WHEN 1 THEN value WHEN 3 THEN 2 WHEN 4 THEN -2 END AS a, CASE k % 5 WHEN 3 THEN 'x: NaN, y: -Infinity' END AS s, k % 5 IN (0, 1, 3, 4) AS parsed
    FROM (SELECT event_id, round(value, 1) AS value, {K} AS k FROM events)""")
def json_sanitize(spark, d):
    k5, value = k() % 5, F.round("value", 1)
    raw = F.when(k5 == 0, '{"a": NaN}').when(k5 == 1, F.concat(F.lit('{"a": '), value.cast("string"), F.lit(', "b": -Infinity}'))).when(k5 == 2, "[NaN]").when(k5 == 3, '{"s": "x: NaN, y: -Infinity", "a": 2}').otherwise('{"b":Infinity,"a":-2}')
    return load(spark, d, "events").select("event_id", js.lenient_number(raw, "a").alias("a"), F.get_json_object(js.json_text(raw), "$.s").alias("s"), objects.parsed(raw, T.StructType().add("a", "double")).isNotNull().alias("parsed"))


@query("""SELECT page_id, regexp_extract(url, '^(\\w+)://', 1) AS scheme, regexp_extract(url, '^\\w+://([^/?#]+)', 1) AS host, len(parts) AS segments, parts[-1] AS last, TRY_CAST(parts[-1] AS BIGINT) AS id
    FROM (SELECT page_id, url, string_split(regexp_replace(regexp_replace(url, '^\\w+://[^/]+/', ''), '[?#].*$', ''), '/') AS parts FROM pages)""")
def object_key_parse(spark, d):
    parts = F.split(F.regexp_replace(F.regexp_replace("url", r"^\w+://[^/]+/", ""), "[?#].*$", ""), "/")
    pages = load(spark, d, "pages").select("page_id", "url", parts.alias("parts"))
    last = F.try_element_at("parts", F.lit(-1))
    return pages.select("page_id", F.regexp_extract("url", r"^(\w+)://", 1).alias("scheme"), F.regexp_extract("url", r"^\w+://([^/?#]+)", 1).alias("host"), F.size("parts").cast("long").alias("segments"), last.alias("last"), F.expr("try_cast(try_element_at(parts, -1) AS BIGINT)").alias("id"))


HOST = r"regexp_extract(url, '^\w+://([^/?#]+)', 1)"


def _pages(spark, d) -> DataFrame:
    return load(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", r"^\w+://([^/?#]+)", 1).alias("host"))


@query(f"SELECT host, page_id, name, CASE WHEN page_id % 2 = 0 THEN 'video' ELSE 'analysis' END AS file_type FROM (SELECT {HOST} AS host, page_id, list_last(string_split(url, '/')) AS name FROM pages) WHERE name <> '' ORDER BY host, name, page_id")
def session_files(spark, d):
    files = _pages(spark, d).withColumn("name", F.element_at(F.split("url", "/"), -1)).where("name <> ''")
    return files.select("host", "page_id", "name", F.when(F.col("page_id") % 2 == 0, "video").otherwise("analysis").alias("file_type")).orderBy("host", "name", "page_id")


@query(f"SELECT {HOST} AS host, count(*) AS n, max(page_id) AS last_id FROM pages GROUP BY 1")
def prefix_summary(spark, d):
    return _pages(spark, d).groupBy("host").agg(F.count("*").alias("n"), F.max("page_id").alias("last_id"))


@query(f"SELECT host, url, page_id, size FROM (SELECT {HOST} AS host, url, page_id, CAST(strlen(html) AS BIGINT) AS size FROM pages) QUALIFY row_number() OVER (PARTITION BY host ORDER BY url, page_id) <= 10")
def prefix_sample(spark, d):
    """At most ten objects of each prefix, the first by key, with their sizes."""
    pages = load(spark, d, "pages").select(F.regexp_extract("url", r"^\w+://([^/?#]+)", 1).alias("host"), "url", "page_id", F.octet_length("html").cast("long").alias("size"))
    return R.bottom_k(pages, ["host"], ["url", "page_id"], 10)


@query("SELECT page_id FROM pages WHERE NOT contains(url, '/en/')")
def reset_candidates(spark, d):
    return load(spark, d, "pages").where(~F.contains("url", F.lit("/en/"))).select("page_id")


@query(f"""SELECT event_id, CASE WHEN good THEN 206 ELSE 416 END AS status, CASE WHEN good THEN a END AS first_byte, CASE WHEN good THEN b END AS last_byte FROM (
    SELECT event_id, a, b, kind <> 2 AND a <= b AND b < 60 AS good FROM (SELECT event_id, a, CASE WHEN kind = 1 THEN 59 ELSE k END AS b, kind FROM (
    SELECT event_id, CAST(floor(value) AS BIGINT) AS a, CAST({K} AS BIGINT) AS k, event_id % 3 AS kind FROM events)))""")
def range_parse(spark, d):
    kind, first = F.col("event_id") % 3, F.floor("value").cast("string")
    header = F.concat(F.lit("bytes="), F.when(kind == 2, "x").otherwise(first), F.lit("-"), F.when(kind == 1, "").otherwise(k().cast("string")))
    status, begin, end = js.byte_range(header, F.lit(60).cast("long"))
    return load(spark, d, "events").select("event_id", status.alias("status"), begin.alias("first_byte"), end.alias("last_byte"))


@query("""SELECT p_partkey, CASE WHEN size < 104857600 THEN 1 ELSE parts END AS parts, CASE WHEN size < 104857600 THEN size ELSE size - (parts - 1) * 10485760 END AS last_bytes
    FROM (SELECT p_partkey, size, CAST(ceil(size / CAST(10485760 AS DOUBLE)) AS BIGINT) AS parts FROM (SELECT p_partkey, CAST(floor(p_retailprice * 262144) AS BIGINT) AS size FROM part))""")
def multipart_plan(spark, d):
    size = F.floor(F.col("p_retailprice") * 262144).cast("long")
    parts = F.when(size < 100 << 20, F.lit(1).cast("long")).otherwise(F.ceil(size / float(10 << 20)).cast("long"))
    return load(spark, d, "part").select("p_partkey", parts.alias("parts"), F.when(size < 100 << 20, size).otherwise(size - (parts - 1) * (10 << 20)).alias("last_bytes"))


@query("SELECT o_orderkey, strftime(make_timestamp((o_orderkey * 86399 + 17) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS at FROM orders")
def epoch_iso(spark, d):
    return load(spark, d, "orders").select("o_orderkey", js.iso_seconds(F.col("o_orderkey") * 86399 + 17).alias("at"))


LABEL_SQL = """CASE p_size % 3 WHEN 0 THEN 'job' WHEN 1 THEN 'job Duration Seconds' ELSE 'worker Health' END"""


@query(f"SELECT p_partkey, CASE WHEN length(words) < 14 THEN rpad(words, 14, ' ') ELSE words END AS label FROM (SELECT p_partkey, upper(words[1]) || words[2:] AS words FROM (SELECT p_partkey, {LABEL_SQL} AS words FROM part))")
def field_label(spark, d):
    name = F.when(F.col("p_size") % 3 == 0, "job").when(F.col("p_size") % 3 == 1, "jobDurationSeconds").otherwise("workerHealth")
    return load(spark, d, "part").select("p_partkey", js.field_label(name).alias("label"))


@query("""SELECT page_id, ext = 'mp4' OR ext = 'mov' AS is_video, ext IN ('jpg', 'png') AND n <= 5242880 AS accepted, page_id % 2 = 0 AS media_key, page_id % 5 IN (0, 1, 2) AS missing
    FROM (SELECT page_id, list_extract(['mp4', 'mov', 'jpg', 'png', 'txt'], CAST(page_id % 5 AS INT) + 1) AS ext, length(html) * 97 AS n FROM pages)""")
def media_rules(spark, d):
    """Uploads by media type and size, keys of articles' pictures, and settings left as in their template."""
    k5 = F.col("page_id") % 5
    kind = js.mime(F.element_at(F.array(*map(F.lit, ("mp4", "mov", "jpg", "png", "txt"))), (k5 + 1).cast("int")))
    key = F.concat(F.lit("dev"), F.when(F.col("page_id") % 2 == 0, "/blog/media/").otherwise("/blog/"), F.col("page_id").cast("string"))
    setting = F.when(k5 == 1, "your_key").when(k5 == 2, "put_it_here").when(k5 > 2, F.col("url"))
    size = F.length("html").cast("long") * 97
    return load(spark, d, "pages").select("page_id", js.is_video(kind).alias("is_video"), js.media_accepted(kind, size).alias("accepted"), js.media_key(key).alias("media_key"), js.setting_missing(setting).alias("missing"))


@query("SELECT event_id, CASE WHEN value * 0.2::DOUBLE < value - 1 THEN value * 0.2::DOUBLE ELSE value - 1 END AS second FROM events")
def capture_time(spark, d):
    return load(spark, d, "events").select("event_id", js.capture_time(F.col("value")).alias("second"))


VIDEO_KEY_SQL = """CASE page_id % 6 WHEN 0 THEN 'dev/' || u || '/v' || page_id || '/video.mp4' WHEN 1 THEN u || '/v' || page_id || '/video.mov' WHEN 2 THEN 'users/' || u || '/videos/' || (1700000000000 + page_id) || '-my-clip.mp4'
    WHEN 3 THEN 'users/' || u || '/videos/clip.mp4' WHEN 4 THEN 'dev/' || u || '/v' || page_id || '/pose.json' ELSE 'misc/' || page_id || '.bin' END"""


@query(f"""SELECT page_id, key, CASE page_id % 6 WHEN 0 THEN 'v' || page_id WHEN 1 THEN 'v' || page_id WHEN 2 THEN CAST(1700000000000 + page_id AS VARCHAR) WHEN 3 THEN 'existing' ELSE 'unknown' END AS video_id,
    CASE page_id % 6 WHEN 0 THEN 'video.mp4' WHEN 1 THEN 'video.mov' WHEN 2 THEN 'my-clip.mp4' WHEN 3 THEN 'clip.mp4' WHEN 4 THEN 'pose.json' ELSE page_id || '.bin' END AS file_name,
    page_id % 6 < 2 AND html <> '' AS listed FROM (SELECT page_id, html, {VIDEO_KEY_SQL} AS key FROM (SELECT page_id, html, 'u' || page_id % 7 AS u FROM pages))""")
def video_listing(spark, d):
    """Video id and file name of objects in all key layouts, and which of them a user's listing shows, newest first."""
    user, page = F.concat(F.lit("u"), (F.col("page_id") % 7).cast("string")), F.col("page_id").cast("string")
    k6 = F.col("page_id") % 6
    video = F.concat(F.lit("/v"), page)
    key = (
        F.when(k6 == 0, F.concat(F.lit("dev/"), user, video, F.lit("/video.mp4")))
        .when(k6 == 1, F.concat(user, video, F.lit("/video.mov")))
        .when(k6 == 2, F.concat(F.lit("users/"), user, F.lit("/videos/"), (F.col("page_id") + 1700000000000).cast("string"), F.lit("-my-clip.mp4")))
        .when(k6 == 3, F.concat(F.lit("users/"), user, F.lit("/videos/clip.mp4")))
        .when(k6 == 4, F.concat(F.lit("dev/"), user, video, F.lit("/pose.json")))
        .otherwise(F.concat(F.lit("misc/"), page, F.lit(".bin")))
    )
    files = load(spark, d, "pages").select("page_id", F.length("html").alias("size"), user.alias("user"), key.alias("key"))
    video_id, name = objects.video_of(F.col("key"), F.col("user"))
    return files.orderBy(F.desc("page_id")).select("page_id", "key", video_id.alias("video_id"), name.alias("file_name"), objects.is_video(F.col("key"), F.col("size"), F.col("user")).alias("listed"))

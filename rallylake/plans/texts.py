"""Rules for names, numbers, ranges, data URLs and JSON applied to whole texts of the tables, not to made-up values."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallylake.functions import js
from rallylake.plans.base import query
from rallylake.plans.scalars import SPACE_SQL
from rallylake.sources import objects
from rallylake.sources.tables import load

SANITIZED_SQL = rf"""trim(regexp_replace(regexp_replace(regexp_replace(translate(x, '[]', '()'), '[/\\\\\x{{29f8}}]', '-', 'g'), '[<>:"|?*]', '_', 'g'), '[{SPACE_SQL}]+', ' ', 'g'))"""
VALID_SQL = rf"regexp_matches(x, '[^{SPACE_SQL}]') AND length(x) + len(regexp_extract_all(x, '[\x{{10000}}-\x{{10ffff}}]')) <= 255"


@query(f"""SELECT doc_id, CAST(len(l) AS BIGINT) AS lines, CAST(len(list_filter(l, lambda x: {VALID_SQL})) AS BIGINT) AS valid, md5(array_to_string(list_transform(l, lambda x: {SANITIZED_SQL}), '|')) AS names
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def names_of_lines(spark, d):
    """Every line of every document as a file name: whether a rename would take it, and what a store makes of it."""
    lines = F.split("text", "\n")
    return load(spark, d, "documents").select(
        "doc_id", F.size(lines).cast("long").alias("lines"), F.size(F.filter(lines, lambda x: js.valid_name(x))).cast("long").alias("valid"), F.md5(F.array_join(F.transform(lines, js.sanitize_name), "|")).alias("names")
    )


@query(r"""SELECT page_id, CAST(len(list_filter(n, lambda x: x IS NOT NULL)) AS BIGINT) AS integers, CAST(list_sum(n) AS DECIMAL(38,0)) AS total, CAST(len(list_filter(w, lambda x: regexp_matches(x, '^[-+]?([0-9]|[.][0-9]|Infinity)'))) AS BIGINT) AS numbers
    FROM (SELECT page_id, w, list_transform(w, lambda x: CAST(TRY_CAST(nullif(regexp_extract(x, '^[-+]?[0-9]+'), '') AS BIGINT) AS DECIMAL(38,0))) AS n FROM (SELECT page_id, regexp_split_to_array(html, '[^0-9A-Za-z.+-]+') AS w FROM pages))""")
def numbers_of_words(spark, d):
    """Every word of every page as a number field: how many give an integer, their sum, and how many give a number at all."""
    words = F.split("html", "[^0-9A-Za-z.+-]+")
    pages = load(spark, d, "pages").select("page_id", F.filter(F.transform(words, js.parse_int), lambda n: n.isNotNull()).alias("n"), F.size(F.filter(words, lambda x: js.parse_float(x).isNotNull())).cast("long").alias("numbers"))
    total = F.aggregate("n", F.lit(None).cast("decimal(38,0)"), lambda a, x: (F.coalesce(a, F.lit(0)) + x.cast("decimal(20,0)")).cast("decimal(38,0)"))
    return pages.select("page_id", F.size("n").cast("long").alias("integers"), total.alias("total"), "numbers")


@query("""SELECT page_id, CASE WHEN html = '' THEN NULL ELSE list_extract(['jpeg', NULL, 'jpeg', 'webp'], CAST(page_id % 4 AS INT) + 1) END AS format, CASE WHEN page_id % 4 <> 1 AND html <> '' THEN CAST(strlen(html) AS BIGINT) END AS bytes, CASE WHEN page_id % 4 <> 1 AND html <> '' THEN md5(html) END AS digest FROM pages""")
def dataurl_payloads(spark, d):
    """Pages sent as data URLs of four formats, of which one is not taken; what arrives is decoded whole."""
    kind = F.get(F.array(*map(F.lit, ("jpeg", "png", "jpg", "webp"))), (F.col("page_id") % 4).cast("int"))
    url = F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(F.col("html").cast("binary")), r"\r\n", ""))
    name, payload = js.data_url(url)
    content = F.unbase64(payload)
    return load(spark, d, "pages").select("page_id", name.alias("format"), F.octet_length(content).cast("long").alias("bytes"), F.md5(content).alias("digest"))


@query("""SELECT page_id, CASE WHEN good THEN 206 ELSE 416 END AS status, CASE WHEN good THEN b - a + 1 END AS bytes, CASE WHEN good THEN md5(array_slice(c, a + 1, b + 1)) END AS digest FROM (SELECT *, k <> 4 AND a <= b AND b < n AS good FROM (
    SELECT page_id, encode(html) AS c, CAST(strlen(html) AS BIGINT) AS n, page_id % 5 AS k, page_id * 7 % 2000 AS a, CASE page_id % 5 WHEN 1 THEN CAST(strlen(html) AS BIGINT) - 1 WHEN 3 THEN 9223372036854775807 ELSE page_id * 7 % 2000 + page_id % 300 END AS b FROM pages))""")
def range_reads(spark, d):
    """Bytes of pages by range headers: closed, open, several (the first counts), beyond all sizes, and unreadable ones."""
    k, first = F.col("page_id") % 5, F.col("page_id") * 7 % 2000
    begin, end = first.cast("string"), (first + F.col("page_id") % 300).cast("string")
    header = F.when(k == 4, F.concat(F.lit("lines="), begin, F.lit("-"))).otherwise(F.concat(F.lit("bytes="), begin, F.lit("-"), F.when(k == 1, "").when(k == 2, F.concat(end, F.lit(", 5000-6000"))).when(k == 3, "9" * 30).otherwise(end)))
    pages = load(spark, d, "pages").select("page_id", F.col("html").cast("binary").alias("content"), header.alias("header"))
    status, a, b = js.byte_range(F.col("header"), F.octet_length("content").cast("long"))
    answers = pages.select("page_id", "content", status.alias("status"), a.alias("a"), (b - a + 1).alias("bytes"))
    return answers.select("page_id", "status", "bytes", F.md5(F.substring("content", (F.col("a") + 1).cast("int"), F.col("bytes").cast("int"))).alias("digest"))


@query("SELECT doc_id, true AS parsed, CAST(NULL AS DOUBLE) AS v, CASE WHEN doc_id % 2 = 0 THEN 1.5 END AS w, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def json_repairs(spark, d):
    """Documents as JSON with values that no JSON has beside the whole text: the values turn to null, the text comes back as it was."""
    own = F.to_json(F.struct(F.when(F.col("doc_id") % 2 == 0, 1.5).alias("w"), F.col("text").alias("t")))
    broken = F.concat(F.lit('{"v": -Infinity, "x": [{"y":NaN}], '), F.expr("substr(j, 2)"))
    docs = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", own.alias("j")).select("doc_id", broken.alias("j"))
    found = docs.select("doc_id", objects.parsed(F.col("j"), T.StructType().add("v", "double").add("w", "double").add("t", "string")).alias("r"))
    return found.select("doc_id", F.col("r").isNotNull().alias("parsed"), "r.v", "r.w", F.md5("r.t").alias("digest"))

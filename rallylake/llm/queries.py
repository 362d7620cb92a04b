"""The training-data operators applied to the driver's tables, one query for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallylake.llm import decontaminate, kmeans, licenses, negatives, packing, pieces, quality, repeats, rollup, secrets, simhash, topk, warc
from rallylake.llm.common import materialize, scratch_path, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text; matches of inferred formats as start:end:format."""
    found = secrets.secret_scan(table(spark, sf_dir, "documents"))
    return found.withColumn("matches", F.array_join(F.transform("matches", lambda x: F.concat_ws(":", x["start"], x["end"], x["format"])), ","))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record a page, written to archives and read back from them."""
    return warc.round_trip(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every text without strings of 200 bytes that stand elsewhere too."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, labels and score of every text; the spans of fuzzy notices as label:first:end:edits, in words."""
    span = lambda x: F.concat_ws(":", x["label"], x["first_word"], x["end_word"], x["edits"])
    return licenses.license_scan(table(spark, sf_dir, "documents")).withColumn("notices", F.array_join(F.transform("notices", span), ","))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows of highest integer inner product for each row whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every text."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents inserted; those labelled of low quality revised to their
    text without repeated lines; those labelled toxic deleted. The second batch comes twice."""
    counts = materialize(rollup.count_tokens(table(spark, sf_dir, "documents")), "counts")
    labels = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    labelled = materialize(counts.join(labels, "doc_id"), "labelled-counts")
    kept = rollup.Rollup(spark, scratch_path(spark, "rollup"))
    kept.commit("1-load", rollup.inserts(counts))
    for _ in range(2):
        kept.commit("2-revise", rollup.revisions(labelled.where("quality = 0")))
    now = F.when(F.col("quality") == 0, F.col("revised_tokens")).otherwise(F.col("tokens"))
    kept.commit("3-delete", rollup.deletes(labelled.where("toxic = 1").withColumn("tokens", now)))
    return kept.totals()


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every text by a classifier fitted on the same table and its labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels"))).drop("text")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every text in sequences of 4,096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every text that stand in benchmark windows, and the items that they come from."""
    docs = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", "n_words", "n_hit", F.size("item_names").cast("long").alias("n_items"), F.sha2(F.array_join("item_names", ","), 256).alias("items_sha256"), "contaminated")


def op11_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and squared distance of every vector, with the sums of distances and the centroid's digest."""
    return kmeans.with_inertia(*kmeans.kmeans(table(spark, sf_dir, "embeddings")))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by the piece vocabulary, and their text again, as digests."""
    found = pieces.encode_decode(table(spark, sf_dir, "documents"))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each anchor and positive, where every seventh label is wrong."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_warc, op3_repeats, op4_license_scan, op5_topk, op6_simhash, op7_token_rollup, op8_quality, op9_packing, op10_decontaminate, op11_kmeans, op12_sentencepiece, op13_hard_negatives)}


def _kmeans_sql(k: int = 40, rounds: int = 5) -> str:
    """Every round as two steps: vectors to centroids, then the floors of the means."""
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, e) - 1 AS c, e FROM v QUALIFY c < {k})"""]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT r, any_value(v.e) AS e, min({{'d': CAST(list_inner_product(v.e, v.e) - 2 * list_inner_product(v.e, c.e) + list_inner_product(c.e, c.e) AS BIGINT), 'c': c.c}}) AS best
        FROM v CROSS JOIN c{n} c GROUP BY r)""")
        steps.append(f"""c{n + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.e, c.e) AS e FROM c{n} c LEFT JOIN (SELECT c, list(CAST(f AS DOUBLE) ORDER BY k) AS e
        FROM (SELECT c, k, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS f FROM (SELECT best.c AS c, CAST(unnest(e) AS BIGINT) AS x, generate_subscripts(e, 1) AS k FROM a{n}) GROUP BY c, k)
        GROUP BY c) m USING (c))""")
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(list_transform(c{rounds}.e, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
    FROM a{rounds} JOIN v USING (r) JOIN c{rounds} ON c{rounds}.c = best.c"""


ORACLES = {
    "op11_kmeans": _kmeans_sql(),
    "op13_hard_negatives": """WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, CAST(list_inner_product(a.e, o.e) AS BIGINT) AS score FROM v a JOIN v o ON a.vec_id % 50 = 0 AND a.vec_id <> o.vec_id),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3""",
    "op5_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5"""
}

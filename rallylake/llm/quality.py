"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer.

Two heads, "junk" and "toxic". Each has heuristic labellers that vote bad (1), good (0) or abstain
(-1) on every document; the given labels are one labeller more, which abstains where there is none.
Expectation-maximisation over the counts of vote patterns (at most 3 ** labellers rows, whatever the
corpus) estimates how each labeller, the given labels included, votes on bad and on good documents.
The posteriors of a bounded sample of all documents then train a logistic scorer over hashed words,
word beginnings and shape buckets, which scores all documents. A document weighs in the training by
the share of what could be known that its votes tell: none if all labellers abstain.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallylake.llm.common import WORDS, arrow_map, materialize, per_batch, utf8

# An everyday list of insults; other words are learned from the labels.
INSULTS = frozenset(b"clown disgusting dumb fool idiot idiotic imbecile jerk loser moron moronic pathetic scum stupid trash worthless".split())
# Frequent English words; the insults are English, so on other texts their labeller abstains.
ENGLISH = frozenset(b"the and of to in is that for with was are this from have not".split())
SYMBOLS = b"#$%&*|!@^~=+<>{}\\_"
JUNK = ("symbols", "capitals", "stutter", "variety", "table", "function_words")
TOXIC = ("insults",)
HEADS = {"junk": JUNK, "toxic": TOXIC}


def vote(value: float, bad: float, good: float) -> int:
    """1 on the bad side of ``bad``, 0 on the good side of ``good``, -1 between them."""
    if bad > good:
        return 1 if value > bad else 0 if value < good else -1
    return 1 if value < bad else 0 if value > good else -1


def shape(raw: bytes) -> dict[str, float]:
    """Shares that the junk labellers look at."""
    words = raw.split()
    n = len(words) or 1
    return {
        "n": len(words),
        "symbols": (len(raw) - len(raw.translate(None, SYMBOLS))) / max(1, len(raw)),
        "capitals": sum(map(bytes.isupper, words)) / n,
        "stutter": sum(map(bytes.__eq__, words, words[1:])) / n,
        "variety": len(set(words)) / n,
        "table": words.count(b"|") / n,
        "function_words": sum(len(x) < 4 for x in words) / n,
    }


def votes(s: dict[str, float], found: set[bytes]) -> dict[str, list[int]]:
    """Each head's votes on a document of shape ``s`` and lower-case words ``found``."""
    n, insults = s["n"], len(found & INSULTS)
    junk = [
        vote(s["symbols"], 0.05, 0.02),
        vote(s["capitals"], 0.4, 0.2) if n > 4 else -1,
        vote(s["stutter"], 0.3, 0.1) if n > 7 else -1,
        vote(s["variety"], 0.3, 0.5) if n > 19 else -1,
        vote(s["table"], 0.2, 0.05) if n > 4 else -1,
        vote(s["function_words"], 0.05, 0.15) if n > 19 else -1,
    ]
    return {"junk": junk, "toxic": [1 if insults else 0 if len(found & ENGLISH) > 2 else -1]}


def features(s: dict[str, float], found: set[bytes]) -> np.ndarray:
    """Hashes of the words, their beginnings of 4 to 6 characters, and the shape in buckets."""
    text = {x for w in found if len(w) > 4 for u in (w.decode("utf-8", "replace"),) for k in (4, 5, 6) if len(u) > k for x in (b"^" + u[:k].encode(),)}
    told = JUNK if s["n"] > 19 else ("symbols", "capitals", "stutter", "table") if s["n"] > 7 else ("symbols",)
    buckets = [b"=%s%d" % (k.encode(), min(9, int(20 * s[k]))) for k in told]
    return np.fromiter(map(zlib.crc32, [*found, *text, *buckets]), np.int64)


#: How a labeller is expected to vote before any vote is seen: its accuracy, and how much that counts
#: beside its own votes. Heuristics are taken at their votes; given labels are trusted as much as they tell.
HEURISTIC, LABEL = (0.7, 0.01), (0.995, 1.0)


class LabelModel:
    """How each labeller votes by class, estimated by expectation-maximisation from pattern counts."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, trust: list[tuple[float, float]] | None = None, rounds: int = 200):
        """patterns: votes, a row each. ``trust``: by labeller the expected accuracy and its weight, as a
        share of the labeller's votes. At the start a pattern is bad if any labeller says so."""
        trust = trust or [HEURISTIC] * patterns.shape[1]
        self.table = np.full((patterns.shape[1], 2, 3), 0.5)  # by labeller, class and vote; abstaining tells nothing
        self.table[:, :, 0] = 1
        self.prior = 0.05
        if not len(patterns):
            return
        p = np.where((patterns == 1).any(axis=1), 0.9, 0.05)
        for _ in range(rounds):
            weight = np.stack([(1 - p) * counts, p * counts])
            self.prior = float((weight[1].sum() + 1) / (counts.sum() + 2))
            for k, (accuracy, share) in enumerate(trust):
                voted = patterns[:, k] >= 0
                right = np.array([[accuracy, 1 - accuracy], [1 - accuracy, accuracy]])
                seen = np.stack([weight @ (patterns[:, k] == v) for v in (0, 1)], axis=1)
                beside = 1 + share * (weight @ voted)
                self.table[k, :, 1:] = (seen + beside[:, None] * right) / (seen.sum(axis=1) + beside)[:, None]
            now = self.posterior(patterns)
            if np.abs(now - p).max() < 1e-9:
                break
            p = now

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a document with these votes (of the first labellers, or of all) is bad."""
        log = np.log([1 - self.prior, self.prior])[None, :] + sum(np.log(self.table[k][:, patterns[:, k] + 1]).T for k in range(patterns.shape[1]))
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))

    def told(self, p: np.ndarray) -> np.ndarray:
        """The share of what could be known that a posterior tells beyond the prior, 0 to 1: its divergence
        from the prior against that of certainty."""
        q, tiny = self.prior, 1e-300
        gain = p * np.log(np.maximum(p, tiny) / q) + (1 - p) * np.log(np.maximum(1 - p, tiny) / (1 - q))
        return np.clip(gain / np.where(p > q, -np.log(q), -np.log(1 - q)), 0, 1)


def train(rows: list[np.ndarray], target: np.ndarray, weight: np.ndarray, epochs: int = 20, rate: float = 0.3, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on presence of hashed features with soft targets and row weights (adaptive
    gradient steps in batches), from the mean target on. Returns the sorted feature hashes, their weights
    and the bias."""
    known = np.unique(np.concatenate([np.zeros(0, np.int64), *rows]))
    mean = (weight @ target + 0.05) / (weight.sum() + 1)
    weights, bias = np.zeros(len(known)), float(np.log(mean / (1 - mean)))
    if not len(rows):
        return known, weights, bias
    sums, bias_sum = np.full(len(known), 1e-8), 1e-8
    at = [np.searchsorted(known, x) for x in rows]
    order = np.random.Generator(np.random.PCG64(1))
    for _ in range(epochs):
        for part in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 64)):
            where = np.concatenate([at[k] for k in part])
            row = np.repeat(np.arange(len(part)), [len(at[k]) for k in part])
            z = np.bincount(row, weights[where], len(part)) + bias
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[part]) * weight[part]
            gradient = np.bincount(where, error[row], len(known)) / len(part) + ridge * weights
            sums += gradient**2
            weights -= rate * gradient / np.sqrt(sums)
            bias_sum += error.mean() ** 2
            bias -= rate * error.mean() / np.sqrt(bias_sum)
    return known, weights, bias


def _seen(batch: pa.RecordBatch, column: int) -> Iterator[tuple[dict, set[bytes]]]:
    for raw in utf8(batch.column(column)):
        yield shape(raw), set(raw.translate(WORDS).split())


def _code(v: list[int]) -> int:
    out = 0
    for x in v:
        out = out * 3 + x + 1
    return out


def _decode(code: int, n: int) -> list[int]:
    return [code // 3 ** (n - 1 - k) % 3 - 1 for k in range(n)]


def _voted():
    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [votes(s, w) for s, w in _seen(batch, 2)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([_code(r[h]) for r in rows], pa.int64()) for h in HEADS)], names=["doc_id", "digest", *HEADS])

    return f


def _featured():
    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [np.unique(features(s, w)).astype(np.uint32).view(np.int32) for s, w in _seen(batch, 1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.list_(pa.int32()))], names=["digest", "features"])

    return f


class Scorer:
    """The fitted classifier: a label model and linear weights for each head."""

    def __init__(self, models: dict[str, LabelModel], weights: dict[str, tuple[np.ndarray, np.ndarray, float]]):
        self.models, self.weights = models, weights

    def score(self, head: str, hashes: np.ndarray) -> float:
        known, weights, bias = self.weights[head]
        if not len(known):
            return 1 / (1 + np.exp(-bias))
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        z = float(weights[at][known[at] == hashes].sum()) + bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame | None = None, max_rows: int = 30_000, least_share: float = 0.01, least_ratio: float = 5.0, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Fit on ``docs`` and, if given, ``labels`` (doc_id, quality 0/1, toxic 0/1; nulls do not vote).

    The label models see every document's votes. The scorers are trained on about ``max_rows`` distinct
    texts of all documents, chosen by a hash of the text with a chance in proportion to what its votes
    tell; their targets are the posteriors. A feature is used if it occurs in ``least_share`` of the bad
    texts (and in 3), ``least_ratio`` times as often as among the good. Of repeated ids' labels the worst
    counts; of a text with several labels the least pattern of votes. Null ids have no label. A table
    without bad documents gives a scorer of the low mean alone.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("digest", F.xxhash64(F.coalesce("text", F.lit(""))))
    spark = docs.sparkSession
    gold = spark.createDataFrame([], "doc_id long, junk_label int, toxic_label int")
    if labels is not None:
        gold = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((1 - F.min("quality")).cast("int").alias("junk_label"), F.max("toxic").cast("int").alias("toxic_label"))
    marks = [F.coalesce(F.when(F.col(f"{h}_label").isin(0, 1), F.col(f"{h}_label")), F.lit(-1)).alias(f"{h}_label") for h in HEADS]
    voted = docs.select("doc_id", "digest", "text").transform(arrow_map, per_batch(_voted), "doc_id long, digest long, junk long, toxic long")
    voted = materialize(voted.join(gold, "doc_id", "left").select("digest", *HEADS, *marks), "votes")
    models, known = {}, {}
    for head, names in HEADS.items():
        found = sorted(voted.groupBy(head, f"{head}_label").count().collect())
        patterns = np.array([[*_decode(r[0], len(names)), r[1]] for r in found], int).reshape(-1, len(names) + 1)
        counts = np.array([r["count"] for r in found], float)
        models[head] = LabelModel(patterns, counts, [HEURISTIC] * len(names) + [LABEL])
        p = models[head].posterior(patterns)
        told = models[head].told(p)
        # a text is chosen in proportion to what its votes tell; what the rate cannot give, the weight does
        rate = np.minimum(1, told * max_rows / len(HEADS) / max(1e-9, float(told @ counts)))
        weigh = np.divide(told, rate, out=np.zeros(len(told)), where=rate > 0)
        weigh /= max(1e-300, float(weigh.max(initial=0)))
        known[head] = [(r[0], r[1], *map(float, x)) for r, *x in zip(found, p, weigh, rate, strict=True)]
    place = F.shiftrightunsigned("digest", 24) / float(1 << 40)
    for head in HEADS:
        rows = spark.createDataFrame(known[head], f"{head} long, {head}_label int, {head}_target double, {head}_weight double, {head}_rate double")
        voted = voted.join(F.broadcast(rows), [head, f"{head}_label"])  # a row a pattern of votes
    chosen = voted.where(F.greatest(*[F.col(f"{h}_rate") for h in HEADS]) > place)
    sides = [c for h in HEADS for c in (f"{h}_target", F.when(F.col(f"{h}_rate") > place, F.col(f"{h}_weight")).otherwise(0.0).alias(f"{h}_weight"))]
    chosen = materialize(chosen.select("digest", F.struct(*HEADS, *marks, *sides).alias("row")).groupBy("digest").agg(F.min("row").alias("row")).select("digest", "row.*"), "chosen")
    # about max_rows keys of eight bytes; texts that repeat give one row of features
    shapes = docs.join(F.broadcast(chosen.select("digest")), "digest", "left_semi").select("digest", "text").transform(arrow_map, per_batch(_featured), "digest long, features array<int>")
    sample = materialize(shapes.groupBy("digest").agg(F.first("features").alias("features")).join(chosen, "digest"), "sample")
    weights = {}
    for head in HEADS:
        own = sample.where(F.col(f"{head}_weight") > 0).select("digest", "features", F.col(f"{head}_target").alias("target"), F.col(f"{head}_weight").alias("weight"))
        # whole numbers, so that a sum does not depend on the order of rows
        bad, good = (F.sum(F.round(x * F.col("weight") * 1e6).cast("long")) / 1e6 for x in (F.col("target"), 1 - F.col("target")))
        total = own.agg(F.coalesce(bad, F.lit(0.0)).alias("bad"), F.coalesce(good, F.lit(0.0)).alias("good")).first()
        counts = own.select("target", "weight", F.explode("features").alias("feature")).groupBy("feature").agg(bad.alias("bad"), good.alias("good"))
        share, other = (F.col("bad") + 0.5) / (total["bad"] + 1), (F.col("good") + 0.5) / (total["good"] + 1)
        useful = (F.col("bad") >= max(2.5, least_share * total["bad"])) & (share >= least_ratio * other)
        useful = materialize(counts.where(useful).select("feature"), "features")
        pairs = own.select("digest", F.explode("features").alias("feature")).join(useful, "feature").groupBy("digest").agg(F.sort_array(F.collect_list("feature")).alias("features"))
        data = own.select("digest", "target", "weight").join(pairs, "digest", "left").toPandas().sort_values("digest")
        rows = [np.zeros(0, np.int64) if x is None else np.asarray(x, np.int32).view(np.uint32).astype(np.int64) for x in data["features"]]
        weights[head] = train(rows, data["target"].to_numpy(float), data["weight"].to_numpy(float))
    return Scorer(models, weights)


SCORES = "p_junk double, p_toxic double, posterior_junk double, posterior_toxic double, keep boolean"


def classify(docs: DataFrame, scorer: Scorer, threshold: float = 0.5, sure: float = 0.95, text_col: str = "text") -> DataFrame:
    """``docs`` with p_junk and p_toxic (the scorers), posterior_junk and posterior_toxic (the label
    models, by the heuristics' votes alone) and keep: no score reaches ``threshold`` and no posterior
    ``sure``.

    Every document is scored by its whole text in one map; null texts count as empty. Columns of these
    names are replaced; all others and repeated rows are kept.
    """
    names = ["p_junk", "p_toxic", "posterior_junk", "posterior_toxic", "keep"]
    kept = [c for c in docs.columns if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def make():
        ready = shared.value

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores, codes = [], defaultdict(list)
            for s, w in _seen(batch, batch.schema.names.index(text_col)):
                hashes = np.unique(features(s, w))
                scores.append([ready.score(h, hashes) for h in HEADS])
                for h, v in votes(s, w).items():
                    codes[h].append(v)
            scores = np.array(scores, float).reshape(-1, len(HEADS))
            posterior = [ready.models[h].posterior(np.array(codes[h], int).reshape(-1, len(HEADS[h]))) for h in HEADS]
            more = [scores[:, 0], scores[:, 1], *posterior, (scores < threshold).all(axis=1) & (np.stack(posterior, axis=1) < sure).all(axis=1)]
            return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, more)], names=[*batch.schema.names, *names])

        return f

    plain = docs.select(kept)
    schema = T.StructType(list(plain.schema.fields))
    for x in SCORES.split(", "):
        schema = schema.add(*x.split())
    return plain.transform(arrow_map, per_batch(make), schema)

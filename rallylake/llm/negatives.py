"""Hard negatives by inverted lists: rows of high score to an anchor, but of another label.

Rows go to the nearest of a bounded number of k-means centroids, and each list keeps its radius r, the
greatest distance of a member from the centroid m. By Cauchy and Schwarz the score of a member x with anchor q is
within ``|q| r`` of ``<q, m>``. An anchor visits lists in the order of the upper bounds, skips lists
whose bounds lie outside its window of scores, and stops when the bound falls strictly below its kth score, so the result is exact
whatever the centroids are.

Lists travel in shelves: short ones share a shelf, long ones take several, so a shelf has a bounded number of
rows whatever share of the table one list or one group of copies has. Anchors travel in blocks.
One task at a time has one block at one shelf. In the first of two rounds each anchor visits its most
promising shelf; in the second only the shelves with a list that can still hold a better row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallylake.llm.common import arrow_map, materialize, release
from rallylake.llm.topk import _by_length, products

#: No score: below every product.
NONE = -(1 << 62) * 2 + 1
MOST = (1 << 63) - 1


def whole_labelled(vectors: DataFrame, scale: float, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(vec_id, label, x array<double>): floored components; rows with a null id, label or vector, an empty vector, or null or non-finite components are left out."""
    v = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("x"))


def fit(rows: DataFrame, lists: int, sample: int, rounds: int = 5) -> np.ndarray:
    """Centroids by Lloyd's rounds on at most ``sample`` rows of the smallest hashes, of the length most frequent among them.

    They set how much is skipped, never what is found.
    """
    some = rows.select("x", F.xxhash64("x", "vec_id").alias("h")).orderBy("h", "x").limit(sample).toPandas()["x"]
    if not len(some):
        return np.zeros((0, 0))
    sizes, counts = np.unique(some.map(len), return_counts=True)
    x = np.stack(some[some.map(len) == sizes[counts.argmax()]].to_numpy())
    c = x[: min(lists, len(x))].copy()
    for _ in range(rounds):
        at = ((c**2).sum(axis=1)[None] - 2 * (x @ c.T)).argmin(axis=1)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _listed(centroids: np.ndarray):
    """Per row its list, its distance from the centroid and its number in the task; rows of another length than
    the centroids are in the last list, whose centroid is zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            where, far = np.full(batch.num_rows, len(centroids)), np.zeros(batch.num_rows)
            for at, x in _by_length(batch.column(2)):
                if len(centroids) and x.shape[1] == centroids.shape[1]:
                    where[at] = ((centroids**2).sum(axis=1)[None] - 2 * (x @ centroids.T)).argmin(axis=1)
                    far[at] = np.sqrt(((x - centroids[where[at]]) ** 2).sum(axis=1))
                else:
                    far[at] = np.sqrt((x**2).sum(axis=1))
            slot = pa.array(np.arange(seen, seen + batch.num_rows))
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where, pa.int32()), pa.array(far), slot], names=["vec_id", "label", "x", "list", "far", "slot"])

    return run


class Lists:
    """What is known of every list: centroid, radius, and the shelves that it stands on; one entry a list."""

    def __init__(self, centroids: np.ndarray, radius: dict[int, float], count: dict[int, int], shelf_rows: int):
        self.centroids, n = centroids, len(centroids) + 1
        self.radius = np.array([radius.get(k, -np.inf) for k in range(n)])
        self.first, self.shelves = np.zeros(n, np.int64), np.zeros(n, np.int64)
        shelf, room = 0, shelf_rows
        for k in range(n):
            rows = count.get(k, 0)
            if not rows:
                continue
            if rows > room and room < shelf_rows:
                shelf, room = shelf + 1, shelf_rows
            self.first[k], self.shelves[k] = shelf, -(-rows // shelf_rows)
            if rows > shelf_rows:
                shelf, room = shelf + int(self.shelves[k]), shelf_rows
            else:
                room -= rows

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per anchor and list the least and the greatest score that a member can have; empty lists have none."""
        norm, size = np.sqrt((q**2).sum(axis=1))[:, None], np.zeros(len(self.radius))
        middle = np.zeros((len(q), len(self.radius)))
        if len(self.centroids) and q.shape[1] == self.centroids.shape[1]:
            middle[:, :-1] = q @ self.centroids.T
            size[:-1] = np.sqrt((self.centroids**2).sum(axis=1))
        held = self.radius >= 0
        reach = norm * np.where(held, self.radius, 0)
        # rounding may move a bound, so it gets a margin; what it lets in is scored exactly
        slack = 1e-9 * norm * (size + np.where(held, self.radius, 0)) + 1e-6
        return np.where(held, middle - reach - slack, np.inf), np.where(held, middle + reach + slack, -np.inf)


class Search:
    """The best ``k`` rows of a shelf for each task (anchor, window of scores, same label or another)."""

    #: Cells of a matrix of scores held at once.
    CELLS = 1 << 21

    def __init__(self, lists: Lists, k: int, same: bool):
        self.lists, self.k, self.same = lists, k, same
        self.scored = 0

    def run(self, q: np.ndarray, ids: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, rows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """``rows``: per list its ids (ascending), labels and vectors. Returns (task, vec_id, score), at most k a task.

        ``least`` is a kth score that the task has elsewhere (or NONE)."""
        n = len(q)
        score, name = np.full((n, self.k), NONE), np.full((n, self.k), MOST)
        bottom, top = self.lists.bounds(q)
        present = np.array(sorted(rows), np.int64)
        bottom, top = bottom[:, present], top[:, present]
        order = np.argsort(-top, axis=1, kind="stable")
        step, width = 0, 1
        while step < len(present):
            # each task's next lists by upper bound; those of one list are scored together
            turn = order[:, step : step + width]
            kth = np.maximum(score[:, -1], least)
            bound = np.take_along_axis(top, turn, axis=1)
            go = (bound >= kth[:, None]) & (bound >= low[:, None]) & (np.take_along_axis(bottom, turn, axis=1) <= high[:, None])
            if not (bound >= kth[:, None]).any():
                break
            for at in np.unique(turn[go]).tolist():
                tasks = np.flatnonzero(((turn == at) & go).any(axis=1))
                self._visit(tasks, q, ids, label, low, high, least, rows[int(present[at])], score, name)
            step, width = step + width, 2 * width
        found = np.nonzero(name < MOST)
        return found[0], name[found], score[found]

    def _visit(self, tasks, q, ids, label, low, high, least, members, score, name) -> None:
        own, labels, x = members
        size = max(1, self.CELLS // max(1, len(own)))
        for a in range(0, len(tasks), size):
            t = tasks[a : a + size]
            s = products(q[t], x, True)
            self.scored += s.size
            fine = (s >= np.maximum(low[t], least[t])[:, None]) & (s <= high[t][:, None]) & (own != ids[t][:, None])
            # a row that ties with the kth score may still have a smaller id
            fine &= s >= score[t][:, -1:]
            fine &= (labels == label[t][:, None]) == self.same
            n = min(self.k, s.shape[1])
            if float(np.abs(s).max(initial=0)) * len(own) < 1 << 61:
                # ids ascend, so of equal scores the first column has the smallest id
                key = np.where(fine, s * len(own) + (len(own) - 1 - np.arange(len(own))), NONE)
                at = np.argpartition(-key, n - 1, axis=1)[:, :n]
            else:
                at = np.argsort(np.where(fine, -s, MOST), axis=1, kind="stable")[:, :n]
            good = np.take_along_axis(fine, at, axis=1)
            new_score, new_name = np.where(good, np.take_along_axis(s, at, axis=1), NONE), np.where(good, own[at], MOST)
            both, names = np.concatenate([score[t], new_score], axis=1), np.concatenate([name[t], new_name], axis=1)
            rank = np.lexsort((names, -both), axis=1)
            both, names = np.take_along_axis(both, rank, axis=1), np.take_along_axis(names, rank, axis=1)
            # an id with one score counts once, however many rows have it
            again = np.concatenate([np.zeros((len(t), 1), bool), (both[:, 1:] == both[:, :-1]) & (names[:, 1:] == names[:, :-1])], axis=1)
            both, names = np.where(again, NONE, both), np.where(again, MOST, names)
            rank = np.argsort(again, axis=1, kind="stable")[:, : self.k]
            score[t], name[t] = np.take_along_axis(both, rank, axis=1), np.take_along_axis(names, rank, axis=1)


def _shelved(lists, ids, labels, x) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The rows of a shelf by list, ids ascending, each identical row once; rows that share an id but differ
    come in further layers, so that no layer has an id twice in a list."""
    order = np.lexsort((labels, ids, lists))
    lists, ids, labels, x = lists[order], ids[order], labels[order], x[order]
    same = np.concatenate([[False], (lists[1:] == lists[:-1]) & (ids[1:] == ids[:-1])])
    layer = np.zeros(len(ids), np.int64)
    if same.any():
        keep, begin = np.ones(len(ids), bool), 0
        for end in [*np.flatnonzero(~same)[1:].tolist(), len(ids)]:
            if end - begin > 1:
                _, first = np.unique(np.concatenate([labels[begin:end, None], x[begin:end]], axis=1), axis=0, return_index=True)
                keep[begin:end] = False
                keep[begin + first] = True
                layer[begin + first] = np.arange(len(first))
            begin = end
        lists, ids, labels, x, layer = lists[keep], ids[keep], labels[keep], x[keep], layer[keep]
    for n in range(int(layer.max(initial=-1)) + 1):
        at = np.flatnonzero(layer == n)
        kinds, begins = np.unique(lists[at], return_index=True)
        yield {int(k): (ids[p], labels[p], x[p]) for k, p in zip(kinds, np.split(at, begins[1:]), strict=True)}


def _meet(lists: Lists, k: int, same: bool):
    """One block of tasks at one shelf."""

    def run(tasks: pa.Table, shelf: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if tasks.num_rows and shelf.num_rows:
            search = Search(lists, k, same)
            get = lambda t, c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
            members = {x.shape[1]: (at, x) for at, x in _by_length(shelf.column("x").combine_chunks())}
            for at, q in _by_length(tasks.column("x").combine_chunks()):
                if q.shape[1] not in members:
                    continue
                own, x = members[q.shape[1]]
                for layer in _shelved(*(get(shelf, c)[own] for c in ("list", "vec_id", "label")), x):
                    t, name, score = search.run(q, *(get(tasks, c)[at] for c in ("vec_id", "label", "low", "high", "least")), layer)
                    for column, values in zip(out, (get(tasks, "task")[at][t], name, score), strict=True):
                        column.append(values)
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *c]), pa.int64()) for c in out], names=["task", "found", "score"])

    return run


def _routes(lists: Lists, first: bool):
    """Per task the shelves that it visits: in the first round that of its best list, else all others
    that hold a list within its window and bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at_of, shelf_of = batch.column(batch.schema.get_field_index("x")), [], []
            low, high, least = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("low", "high", "least"))
            for at, q in _by_length(x):
                bottom, top = lists.bounds(q)
                fine = (top >= low[at][:, None]) & (bottom <= high[at][:, None]) & np.isfinite(top)
                best = np.where(fine, top, -np.inf).argmax(axis=1)
                home = lists.first[best]
                go = fine & (top >= least[at][:, None])
                for row in range(len(at)):
                    if not fine[row].any():
                        continue
                    if first:
                        shelves = [int(home[row])]
                    else:
                        shelves = sorted({s for k in np.flatnonzero(go[row]).tolist() for s in range(int(lists.first[k]), int(lists.first[k] + lists.shelves[k]))} - {int(home[row])})
                    at_of += [int(at[row])] * len(shelves)
                    shelf_of += shelves
            out = batch.take(pa.array(at_of, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(shelf_of, pa.int64())], names=[*batch.schema.names, "shelf"])

    return run


class Index:
    """Inverted lists of a table, written to the shared folder: (vec_id, label, x, list, slot)."""

    def __init__(self, rows: DataFrame, lists: int = 64, sample: int = 8192, shelf_rows: int = 8192, block: int = 32_768):
        self.block = block
        self.rows = materialize(rows, "vectors")
        centroids = fit(self.rows, lists, sample)
        listed = self.rows.transform(arrow_map, _listed(centroids), "vec_id long, label long, x array<double>, list int, far double, slot long")
        self.listed = materialize(listed, "lists")
        known = self.listed.groupBy("list").agg(F.max("far").alias("r"), F.count("*").alias("n")).collect()
        self.lists = Lists(centroids, {r["list"]: r["r"] for r in known}, {r["list"]: r["n"] for r in known}, shelf_rows)
        release(self.rows)

    def _shelf(self) -> Column:
        where = F.array(*(F.lit(int(v)) for v in self.lists.first))
        many = F.array(*(F.lit(max(1, int(v))) for v in self.lists.shelves))
        # copies of one row are dealt by their place in the table, so no list is one group
        return (F.get(where, F.col("list")) + F.pmod(F.col("slot"), F.get(many, F.col("list")))).cast("long")

    def best(self, tasks: DataFrame, k: int, same: bool) -> DataFrame:
        """(task, found, score, rank): the k best rows by score and then id of each written task (task, vec_id, label, x, low, high)."""
        columns = ["task", "vec_id", "label", "x", "low", "high", "least"]
        blocks = max(1, -(-tasks.count() // self.block))
        tasks = tasks.withColumn("least", F.lit(NONE).cast("long")).select(columns)
        once = materialize(self._round(tasks, k, same, True, blocks).distinct(), "first-shelf")
        kth = once.groupBy("task").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= k).select("task", "kth")
        again = tasks.join(kth, "task", "left").withColumn("least", F.coalesce("kth", "least")).select(columns)
        both = once.union(self._round(again, k, same, False, blocks)).distinct()
        order = Window.partitionBy("task").orderBy(F.desc("score"), "found")
        return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def _round(self, tasks: DataFrame, k: int, same: bool, first: bool, blocks: int) -> DataFrame:
        schema = "task long, vec_id long, label long, x array<double>, low long, high long, least long, shelf long"
        sent = tasks.transform(arrow_map, _routes(self.lists, first), schema).withColumn("block", F.pmod(F.xxhash64("task"), F.lit(blocks)))
        shelves = self.listed.select("vec_id", "label", "x", "list", self._shelf().alias("shelf"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
        return sent.groupBy("shelf", "block").cogroup(shelves.groupBy("shelf", "block")).applyInArrow(_meet(self.lists, k, same), "task long, found long, score long")


def hard_negatives(
    vectors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, every: int = 50, scale: float = 256.0,
    lists: int = 64, sample: int = 8192, shelf_rows: int = 8192, block: int = 32_768, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Components are floored after scaling; scores are integer inner products, ties go to the smaller id. Anchors
    are the rows whose id is divisible by ``every``. An anchor's positives are its first ``positives`` other rows of its
    label; the negatives of such a pair are the first ``negatives`` rows of another label with ``low * p <= 100 * n <= high * p`` for
    the scores p and n. Fewer rows give fewer; a pair without such rows gives none.

    Labels are whole numbers. Rows with a null id, label or vector, an empty vector, or null or non-finite components
    take no part. Rows that share the anchor's id are none of its others; among those found, an id counts once by score. Identical
    anchors count once, anchors of one id that differ are searched each for itself. Vectors meet those of their own length. Scores beyond 64 bits
    are held at the ends of the range. An empty table gives no rows.

    ``lists`` and ``sample`` (rows that centroids are fitted on, at most) set how much is skipped, ``shelf_rows`` and ``block``
    (tasks) what a task holds; none of them changes the result.
    """
    index = Index(whole_labelled(vectors, scale, id_col, label_col, vector_col), lists, sample, shelf_rows, block)
    anchors = index.listed.where(F.col("vec_id") % every == 0).select("vec_id", "label", "x").dropDuplicates()
    anchors = materialize(anchors.withColumn("task", F.monotonically_increasing_id()).withColumn("low", F.lit(NONE).cast("long")).withColumn("high", F.lit(MOST).cast("long")), "anchors")
    found = index.best(anchors, positives, True).select(F.col("task").alias("anchor"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    # whole-number ends of the window
    of = lambda share: F.col("positive_score").cast("decimal(20,0)") * F.lit(share).cast("decimal(5,0)") / F.lit(100).cast("decimal(3,0)")
    pairs = found.join(anchors.select(F.col("task").alias("anchor"), "vec_id", "label", "x"), "anchor")
    pairs = pairs.withColumn("low", F.ceil(of(low)).cast("long")).withColumn("high", F.floor(of(high)).cast("long")).where("low <= high")
    pairs = materialize(pairs.withColumn("task", F.monotonically_increasing_id()), "pairs")
    best = index.best(pairs, negatives, False).select("task", "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    named = pairs.select("task", F.col("vec_id").alias("anchor_id"), "positive_id", "positive_score")
    return best.join(named, "task").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

"""Relational helpers with the semantics of a query-builder client over Postgres."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows in a total order; plans as a top-k, not a full sort."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(rows: Column, size: int) -> Column:
    return F.ceil(rows / F.lit(size)).cast("long")


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key; Spark prunes to one row a key before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def latest(value: str, *order: str) -> Column:
    """Aggregate: the value of the last row by a total order, combined on the map side."""
    return F.max_by(value, F.struct(*order))


def single(df: DataFrame) -> DataFrame:
    """``df`` if it has exactly one row, else ValueError; looks at two rows at most."""
    n = len(df.take(2))
    if n != 1:
        raise ValueError("no row" if n == 0 else "more than one row")
    return df


def single_each(asked: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """``asked`` (a column ``key``) with the one row of ``df`` of its key as a struct ``row``, null where there is none, more than one
    or no key: the point lookup of one row, for many keys at once. Rows are counted by key before the join, so no group is gathered."""
    one = df.groupBy(key).agg(F.count("*").alias("_n"), F.any_value(F.struct(*df.columns)).alias("row"))
    return asked.join(one.where("_n = 1").drop("_n"), key, "left")


def embed(parent: DataFrame, child: DataFrame, key: str, child_key: str, field: str, columns: list[str]) -> DataFrame:
    """Parents with their children as a sorted array of structs; parents without children keep an empty one."""
    nested = child.groupBy(child_key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(field))
    joined = parent.join(nested, parent[key] == nested[child_key], "left").drop(child_key)
    return joined.withColumn(field, F.coalesce(field, F.array().cast(nested.schema[field].dataType)))


def search(term: str, *columns: Column, wildcard: bool = True) -> Column:
    """Any column holds the term, in either case; with ``wildcard`` its % and _ are live."""
    found = F.lit(False)
    for c in columns:
        found = found | (c.ilike(f"%{term}%") if wildcard else F.contains(F.lower(c), F.lower(F.lit(term))))
    return F.coalesce(found, F.lit(False))


def live(expires: Column, now: Column) -> Column:
    """Not expired: no expiry, or one after ``now``."""
    return expires.isNull() | (expires > now)


def every(condition: Column) -> Column:
    """Aggregate: all rows satisfy the condition; true for none."""
    return F.coalesce(F.bool_and(condition), F.lit(True))


def upsert(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows of ``updates`` replace those of ``base`` with their key or are added; a null field in an update
    leaves the old value (a sparse update)."""
    new = updates.select(*[F.col(c).alias(f"_new_{c}") for c in updates.columns])
    joined = base.join(new, base[key] == new[f"_new_{key}"], "full_outer")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in updates.columns else F.col(c) for c in base.columns])


def owner_filter(df: DataFrame, owner: str, user: int | None, admin: bool = False, bypass: bool = False, deleted: Column | None = None, public: Column | None = None) -> DataFrame:
    """Row visibility: policies combine with OR; owners do not see deleted rows, admins do."""
    if bypass:
        return df
    own = F.lit(False) if user is None else F.col(owner) == user
    if deleted is not None:
        own = own & ~deleted
    seen = own | F.lit(admin)
    return df.where(seen if public is None else seen | public)


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): rows for which a check is false; a null check passes. One pass for all rules."""
    counts = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("r")).select("r.*")


def touched(df: DataFrame, changed: Column, values: dict[str, Column], now: Column, stamp: str = "updated_at") -> DataFrame:
    """Rows for which ``changed`` holds get new values and the time; the others stay as they are."""
    hit = F.coalesce(changed, F.lit(False))
    new = {**values, stamp: now}
    return df.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns])


def inserted(df: DataFrame, path: str) -> DataFrame:
    """Append rows to the table at ``path`` and return them as stored."""
    df.write.mode("append").parquet(path)
    return df.select(*df.columns)


def bottom_k(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group, rows in the order of all of ``order``.

    Mergeable: every task gives its first k of a group before anything is shuffled, and the same step over what is
    left gives the groups' own. Both sort, spill and stream; no group is held, whatever its size. Null groups are a group.
    """

    def run(batches):
        last, left = None, 0
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
            keep = []
            for at, key in enumerate(keys):
                if key != last:
                    last, left = key, k
                if left > 0:
                    keep.append(at)
                    left -= 1
            yield batch.take(pa.array(keep, pa.int64()))

    first = df.sortWithinPartitions(*by, *order).mapInArrow(run, df.schema)
    return first.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, df.schema)


def by_name(name: Column, ignore_case: bool = False) -> Column:
    """A text in the order of languages rather than of bytes: accents and case decide last, or case not at all."""
    return F.collate(name, "UNICODE_CI" if ignore_case else "UNICODE")

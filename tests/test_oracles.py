"""Every query that has SQL, against DuckDB on the smallest tables: names, row counts and values."""

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

from rallylake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    """One form for values that both engines give in different types."""
    if isinstance(x, bool) or x is None:
        return repr(x)
    if isinstance(x, (int, float, Decimal)):
        return "nan" if math.isnan(x) else f"{float(x):.9g}"
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(value, x)) + "]"
    return str(x)


def rows(names, found):
    at = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in at], sorted(tuple(value(r[k]) for k in at) for r in found)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_gives_what_its_sql_gives(spark, duck, small, name):
    df = registry.QUERIES[name](spark, small)
    cursor = duck.execute(registry.ORACLES[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("end", ["70 MINUTE", "70 MINUTE + INTERVAL 700 MICROSECOND", "6 HOUR"])
def test_timers_at_the_end_of_the_log(spark, tmp_path, end):
    """Timers of the last ten minutes that an update of the user has passed, and those that are due when the log ends, to the microsecond."""
    con = duckdb.connect()
    at = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL"
    # (minutes, microseconds, user, kind); user 1 is due at the end, 2 and 3 have later updates of their own, 4 two timers, 5 is the clock
    told = [(0, 300, 1, "purchase"), (5, 0, 1, "view"), (1, 0, 2, "purchase"), (65, 0, 2, "view"), (6, 0, 3, "error"), (66, 0, 3, "view"), (4, 0, 4, "error"), (5, 0, 4, "error"), (64, 30, 4, "view"), (67, 0, 4, "view")]
    told += [(0, 0, 6, "purchase"), (5, 0, 6, "view")]
    # others at whole minutes, many of which meet
    told += [(k * 7919 % 70, 0, 10 + k % 12, ("purchase", "view", "error", "click", "signup")[k * 31 % 5]) for k in range(150)]
    values = ",".join(f"({k}, {at} {m} MINUTE + INTERVAL {us} MICROSECOND, {u}, '{kind}', 1.0, '{{}}')" for k, (m, us, u, kind) in enumerate(told))
    con.execute(f"CREATE TABLE events AS SELECT * FROM (VALUES {values}, ({len(told)}, {at} {end}, 5, 'view', 1.0, '{{}}')) v(event_id, ts, user_id, event_type, value, props)")
    con.execute(f"COPY (SELECT * REPLACE (CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS BIGINT) AS user_id) FROM events) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    df = registry.QUERIES["stream_ttl"](spark, str(tmp_path))
    cursor = con.execute(registry.ORACLES["stream_ttl"])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in cursor.description], cursor.fetchall())


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)

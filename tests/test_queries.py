"""Every registered query against its SQL on DuckDB."""

import math

import duckdb
import pytest

from keystrand.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: None if v is None else round(float(v), 6) if isinstance(v, float) and not math.isnan(v) else str(v) if hasattr(v, "as_tuple") else v
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cursor.fetchall(), names)


#: Queries that change the second event of a user.
AT_SECOND = ["dup_erase_one", "dup_insert_after", "dup_insert_before", "dup_insert_first", "dup_insert_last", "dup_overwrite_one"]


@pytest.mark.parametrize("name", AT_SECOND)
def test_change_at_one_of_equal_records(name, spark, tmp_path):
    """The other events of a user have the value of the second too."""
    rows = [(e, e % 4, float(e % 8 // 4)) for e in range(32)] + [(e, 6, 5.0) for e in range(32, 40)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    found = con.execute(ORACLES[name])
    df = QUERIES[name](spark, str(tmp_path))
    names = [d[0] for d in found.description]
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(found.fetchall(), names)


#: Those of them tried on events that are there several times.
AT_COPIES = ["dup_erase_one", "dup_insert_after", "dup_insert_before", "dup_insert_first", "dup_insert_last", "dup_overwrite_one"]


@pytest.mark.parametrize("name", AT_COPIES)
def test_change_at_one_of_equal_events(name, spark, tmp_path):
    """Copies of an event have its event_id too; one of them is the second event of its user."""
    rows = [(e, e % 4, float(e)) for e in range(16)] * 3 + [(e, 6, 5.0) for e in (20, 21, 21, 22)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    found = con.execute(ORACLES[name])
    df = QUERIES[name](spark, str(tmp_path))
    names = [d[0] for d in found.description]
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(found.fetchall(), names)


#: Those of them tried on events without an event_id and on large user_ids.
AT_ODD_IDS = ["dup_erase_one", "dup_insert_after", "dup_insert_before", "dup_insert_first", "dup_insert_last", "dup_overwrite_one"]


@pytest.mark.parametrize("name", AT_ODD_IDS)
def test_change_with_null_and_large_ids(name, spark, tmp_path):
    """A null event_id comes last among those of its user, and can be the second; a user_id may be near the end of its type."""
    rows = [(e, e % 4, float(e)) for e in range(16)] + [(None, u, 50.0 + u) for u in range(4)] + [(20, 6, 1.0), (None, 6, 2.0)]
    rows += [(e, 3 * 2**61, float(e)) for e in range(30, 34)] + [(e, -3 * 2**61, float(e)) for e in range(40, 44)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    found = con.execute(ORACLES[name])
    df = QUERIES[name](spark, str(tmp_path))
    names = [d[0] for d in found.description]
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(found.fetchall(), names)

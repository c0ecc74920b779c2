"""Semantics that the driver's tables don't show: ties, negatives, NaN, nulls, empty databases, errors."""

import math

import pytest
from pyspark.sql import functions as F

from keystrand import errors as E
from keystrand.functions.registry import Plugin, Registry
from keystrand.operators import cursor, lookup, overlay
from keystrand.plans.select import select
from keystrand.sources import storage
from keystrand.sources.catalog import Catalog, database
from keystrand.types import Kind


def make(spark, rows, record=Kind.REAL64, **more):
    source = spark.createDataFrame(rows, "k bigint, o bigint, r double")
    return database(1, source, "k", "r", Kind.INT64, record, ["o"], duplicates=True, **more)


def pairs(df):
    return [tuple(r) for r in df.collect()]


ROWS = [(1, 0, -5.0), (1, 1, -5.0), (2, 0, -3.0), (3, 0, float("nan")), (4, 0, -3.0), (None, 0, 1.0), (5, 0, None)]


def test_nulls_have_no_place(spark):
    assert pairs(select(make(spark, ROWS), "count")) == [("COUNT", 5)]


def test_extremes_of_negatives_ties_and_nan(spark):
    db = make(spark, ROWS)
    assert pairs(select(db, "max", "record")) == [(2, -3.0)]
    assert pairs(select(db, "min", "record")) == [(1, -5.0)]
    assert pairs(select(db, "top", "record", limit=10)) == [(1, -5.0), (2, -3.0)]
    assert pairs(select(db, "bottom", "record")) == [(1, -5.0)]


def test_key_sums_visit_a_key_once(spark):
    db = make(spark, ROWS)
    assert pairs(select(db, "sum", "key"))[0][1] == 1 + 2 + 3 + 4
    assert pairs(select(db, "sum", "key", where=lambda k, r: r < 0))[0][1] == 1 + 1 + 2 + 4
    assert pairs(select(db, "count", distinct=True)) == [("COUNT", 4)]


def test_values_come_in_key_order(spark):
    assert [k for (k,) in pairs(select(make(spark, ROWS), "value", "key"))] == [1, 1, 2, 3, 4]


def test_empty_database(spark):
    db = make(spark, [])
    assert pairs(select(db, "count")) == [("COUNT", 0)]
    assert pairs(select(db, "sum", "record")) == [("SUM", 0.0)]
    assert math.isnan(pairs(select(db, "average", "record"))[0][1])
    assert pairs(select(db, "max", "record")) == []
    assert pairs(cursor.neighbours(db)) == []


def test_unsigned_sums_wrap(spark):
    source = spark.sql("select id as k, cast(18446744073709551615 as decimal(20,0)) as r from range(3)")
    db = database(2, source, "k", "r", Kind.INT64, Kind.UINT64)
    assert int(pairs(select(db, "sum", "record"))[0][1]) == 3 * (2**64 - 1) % 2**64


def test_values_out_of_range_raise(spark):
    db = database(3, spark.range(1).select(F.lit(1).alias("k"), F.lit(300).alias("r")), "k", "r", Kind.INT64, Kind.UINT8)
    with pytest.raises(Exception, match="out of range"):
        db.rows.collect()


@pytest.mark.parametrize(
    ("arguments", "error"),
    [(("nosuch",), E.StatementError), (("count", "key", None, False, 5), E.StatementError), (("sum", "both"), E.StatementError), (("top", "key", None, False, -1), E.StatementError), (("sum", "key", "nosuch"), E.StatementError)],
)
def test_bad_statements(spark, arguments, error):
    with pytest.raises(error):
        select(make(spark, ROWS), *arguments)


def test_text_has_no_sum(spark):
    db = database(4, spark.createDataFrame([("a", "b")], "k string, r string"), "k", "r", Kind.TEXT, Kind.TEXT)
    with pytest.raises(E.StatementError):
        select(db, "sum", "record")


def test_registry():
    r = Registry()
    with pytest.raises(E.PluginNotFound):
        r.add(Plugin("nothing"))
    r.predicate("Even", lambda k, rec: k % 2 == 0)
    assert r.get("EVEN").predicate
    with pytest.raises(E.PluginExists):
        r.predicate("even", lambda k, rec: k)
    with pytest.raises(E.PluginNotFound):
        r.get("odd")


def test_nearest(spark):
    db = make(spark, ROWS)
    assert pairs(lookup.find(db, 0, "near")) == [(1, -5.0, 1)]
    assert pairs(lookup.find(db, 9, "near")) == [(4, -3.0, -1)]
    assert pairs(lookup.find(db, 9, "gt")) == []
    with pytest.raises(E.InvalidParameter):
        lookup.find(db, 0, "around")


def test_catalog(spark):
    catalog = Catalog(spark)
    catalog.add(make(spark, ROWS))
    with pytest.raises(E.DatabaseExists):
        catalog.add(make(spark, ROWS))
    catalog.rename(1, 7)
    assert list(catalog) == [7]
    with pytest.raises(E.DatabaseNotFound):
        catalog.get(1)
    with pytest.raises(E.InvalidParameter):
        catalog.rename(7, 0xF000)
    catalog.erase(7)
    assert list(catalog) == []


def test_conflicts_and_read_only(spark):
    db = database(5, spark.range(3).select("id", F.lit(1.0).alias("v")), "id", "v", Kind.INT64, Kind.REAL64)
    ops = spark.createDataFrame([(1, "put", 1, 2.0)], "seq bigint, op string, key bigint, record double")
    store = overlay.Overlay(db)
    one, two = store.begin(), store.begin()
    store.write(one, ops)
    with pytest.raises(E.TransactionConflict):
        store.write(two, ops)
    with pytest.raises(E.WriteProtected):
        store.write(store.begin(read_only=True), ops)
    assert dict(pairs(store.view().rows.select("key", "record")))[1] == 1.0
    assert dict(pairs(store.view(one).rows.select("key", "record")))[1] == 2.0


def test_operations_see_earlier_ones(spark):
    db = database(6, spark.range(1).select("id", F.lit(1.0).alias("v")), "id", "v", Kind.INT64, Kind.REAL64)
    log = [(1, "insert", 0, 9.0), (2, "erase", 0, None), (3, "find", 0, None), (4, "insert", 0, 5.0), (5, "find", 0, None), (6, "erase", 8, None)]
    ops = spark.createDataFrame(log, "seq bigint, op string, key bigint, record double")
    done = {r["seq"]: (r["status"], r["found"]) for r in overlay.outcomes(db, ops).collect()}
    assert done == {1: ("DUPLICATE_KEY", None), 2: ("OK", None), 3: ("KEY_NOT_FOUND", None), 4: ("OK", None), 5: ("OK", 5.0), 6: ("KEY_NOT_FOUND", None)}
    assert pairs(overlay.applied(db, ops).rows.select("key", "record")) == [(0, 5.0)]


def test_store_round_trip(spark, tmp_path):
    db = make(spark, [(k, o, float(k + o)) for k in range(50) for o in range(3)])
    storage.save(db, str(tmp_path / "db"))
    back = storage.load(spark, str(tmp_path / "db"), db)
    assert sorted(pairs(back.rows.select("key", "record"))) == sorted(pairs(db.rows.select("key", "record")))


def test_filters_reach_the_scan(spark, sf):
    from keystrand.plans.queries import QUERIES

    plan = QUERIES["range_sum"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey" in plan and "o_custkey" not in plan

"""Ranges of an order, keys of every type, single duplicates, stored databases and streams."""

import random

import pytest
from pyspark.sql import functions as F

from keystrand import errors as E
from keystrand.functions.ranking import last_before, ranged, split_row_number
from keystrand.operators import cursor, duplicates, lookup, overlay
from keystrand.plans.select import select
from keystrand.sources.catalog import Catalog, database
from keystrand.streaming.ingest import append_stream
from keystrand.types import Kind


def pairs(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def many_ranges(spark):
    """AQE would make one range of so few bytes."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_hot_key_is_cut(spark, many_ranges):
    """99 of 100 rows have one key: its rows lie in many ranges, and none holds more than its share."""
    rows = spark.range(50_000).select(F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(7).alias("key"), "id")
    sizes = [r["count"] for r in ranged(rows, ["key", "id"]).filter("key = 7").groupBy("_range").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 25_000
    placed = split_row_number(rows, ["key"], ["id"], "n").filter("key = 7").orderBy("id")
    assert [r["n"] for r in placed.collect()] == list(range(placed.count()))


def test_last_before_equals_brute_force(spark, many_ranges):
    rng = random.Random(2)
    rows = [(rng.choice("aaaaab"), i, rng.choice([None, i])) for i in rng.sample(range(10_000), 400)]
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(5)
    for keys in ([], ["k"]):
        for descending in (False, True):
            got = {r["o"]: r["x"] for r in last_before(df, keys, ["o"], "v", "x", descending).collect()}
            for k, o, _ in rows:
                near = [v for a, b, v in rows if v is not None and (not keys or a == k) and (b > o if descending else b < o)]
                assert got[o] == ((min if descending else max)(near) if near else None)


@pytest.mark.parametrize("kind", [Kind.TEXT, Kind.BINARY])
def test_text_and_binary_keys(spark, kind, many_ranges):
    keys = ["", "a", "aa", "b", "é", "zü"]
    as_key = (lambda c: F.col(c).cast("binary")) if kind == Kind.BINARY else F.col
    show = (lambda v: None if v is None else bytes(v).decode()) if kind == Kind.BINARY else (lambda v: v)
    db = database(1, spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, r int").select(as_key("k").alias("k"), "r"), "k", "r", kind, Kind.INT32)
    asked = spark.createDataFrame([("",), ("ab",), ("zz",), ("b",)], "p string").select(as_key("p").alias("p"))
    got = {show(r["probe"]): show(r["key"]) for r in lookup.find_all(db, asked, "p", "leq").collect()}
    assert got == {"": "", "ab": "aa", "zz": "b", "b": "b"}
    got = {show(r["probe"]): show(r["key"]) for r in lookup.find_all(db, asked, "p", "gt").collect()}
    assert got == {"": "a", "ab": "b", "zz": "zü", "b": "zü"}
    steps = {show(r["key"]): show(r["other_key"]) for r in cursor.neighbours(db).collect()}
    assert steps == dict(zip(sorted(keys, key=str.encode), [*sorted(keys, key=str.encode)[1:], None], strict=True))


def test_an_order_of_its_own_holds_everywhere(spark):
    db = database(1, spark.createDataFrame([(1,), (2,), (3,)], "k bigint"), "k", "k", Kind.INT64, Kind.INT64, sort_key=lambda c: -c)
    assert pairs(cursor.first(db)) == [(3, 3)] and pairs(cursor.last(db)) == [(1, 1)]
    assert pairs(cursor.step(db, 2)) == [(1, 1)] and pairs(cursor.step(db, 2, forward=False)) == [(3, 3)]
    assert [k for (k,) in pairs(select(db, "value", "key"))] == [3, 2, 1]
    assert {r["key"]: r["other_key"] for r in cursor.neighbours(db).collect()} == {3: 2, 2: 1, 1: None}


def test_signed_sums_keep_their_sign(spark):
    rows = spark.createDataFrame([(1, -5), (2, 3)], "k bigint, r int")
    assert int(select(database(1, rows, "k", "r", Kind.INT64, Kind.INT32), "sum", "record").first()["record"]) == -2


def _ops(spark, rows):
    return spark.createDataFrame([(s, op, k, None if at is None else (at,), r) for s, op, k, at, r in rows], "seq int, op string, key bigint, at struct<o:bigint>, record double")


def test_single_duplicates_in_order_of_operations(spark):
    source = spark.createDataFrame([(1, o, float(o)) for o in range(3)] + [(2, 0, 9.0)], "k bigint, o bigint, r double")
    db = database(1, source, "k", "r", Kind.INT64, Kind.REAL64, ["o"], duplicates=True)
    log = [
        (1, "first", 1, None, 10.0), (2, "first", 1, None, 11.0), (3, "last", 1, None, 12.0), (4, "after", 1, 1, 13.0), (5, "after", 1, 1, 14.0), (6, "before", 1, 1, 15.0), (7, "before", 1, 1, 16.0),
        (8, "overwrite", 1, 2, 20.0), (9, "overwrite", 1, 2, 21.0), (10, "erase", 1, 0, None), (11, "overwrite", 1, 0, 5.0), (12, "after", 1, 7, 5.0),
        (13, "erase_key", 2, None, None), (14, "last", 2, None, 30.0), (15, "last", 3, None, 31.0), (16, "erase_key", 4, None, None), (17, "overwrite", 2, 0, 1.0),
    ]
    status = {r["seq"]: r["status"] for r in duplicates.outcomes(db, _ops(spark, log)).collect()}
    assert {s for s, x in status.items() if x != "OK"} == {11, 12, 16, 17}
    new = duplicates.renumbered(duplicates.applied(db, _ops(spark, log)))
    rows = [(r["key"], r["record"]) for r in new.rows.orderBy("key", "ord").collect()]
    assert rows == [(1, 11.0), (1, 10.0), (1, 15.0), (1, 16.0), (1, 1.0), (1, 14.0), (1, 13.0), (1, 21.0), (1, 12.0), (2, 30.0), (3, 31.0)]
    # the next log refers to the new bookmarks
    at = new.rows.schema["ord"].dataType.names
    assert at == ["n"]
    more = spark.createDataFrame([(1, "before", 1, (0,), 0.5)], "seq int, op string, key bigint, at struct<n:bigint>, record double")
    assert [r["record"] for r in duplicates.applied(new, more).rows.filter("key = 1").orderBy("ord").limit(2).collect()] == [0.5, 11.0]
    with pytest.raises(E.InvalidParameter):
        overlay.outcomes(db, spark.createDataFrame([(1, "find", 1, None)], "seq int, op string, key bigint, record double"))


def test_stored_catalog(spark, tmp_path):
    root = str(tmp_path / "root")
    source = spark.createDataFrame([("a", 1), ("b", 2)], "k string, r int")
    made = Catalog(spark, root).create(database(3, source, "k", "r", Kind.TEXT, Kind.INT32))
    other = Catalog(spark, root)
    assert list(other) == [3] and other.parameters(3) == {"id": 3, "key": "text", "record": "int32", "duplicates": False, "record_number": False, "stored": True}
    with pytest.raises(E.DatabaseExists):
        other.create(made)
    other.flush(made.with_rows(made.rows.filter("key = 'a'")))
    assert pairs(Catalog(spark, root).open(3).rows.select("key", "record")) == [("a", 1)]
    reader = Catalog(spark, root, read_only=True)
    for act in (lambda: reader.erase(3), lambda: reader.rename(3, 4), lambda: reader.flush(made), lambda: reader.create(made)):
        with pytest.raises(E.WriteProtected):
            act()
    other.rename(3, 4)
    assert Catalog(spark, root).stored() == [4]
    other.erase(4)
    assert list(Catalog(spark, root)) == []
    with pytest.raises(E.DatabaseNotFound):
        other.open(4)


def test_range_cursors(spark):
    db = database(5, spark.range(10).select("id", (F.col("id") * 2).alias("r")), "id", "r", Kind.INT64, Kind.INT64)
    assert pairs(cursor.bookmark(db, 2, 6)) == [(6, 12)] and pairs(cursor.bookmark(db, 2)) == []
    assert cursor.position(db, (5, 4)) == 4
    with pytest.raises(E.CursorIsNil):
        cursor.position(db, None)
    with pytest.raises(E.InvalidParameter):
        cursor.position(db, (6, 4))


def test_cursors_of_others_in_open_transactions(spark):
    db = database(6, spark.range(1, 5).select("id", F.lit(1.0).alias("v")), "id", "v", Kind.INT64, Kind.REAL64)
    store = overlay.Overlay(db)
    store.write(store.begin(), spark.createDataFrame([(1, "put", 2, 7.0), (2, "insert", 9, 7.0)], "seq bigint, op string, key bigint, record double"))
    mine = store.begin()
    assert sorted(r["key"] for r in store.cursor_view(mine).rows.collect()) == [1, 3, 4]
    assert pairs(store.cursor_end(mine)) == [(1, 1.0)]
    with pytest.raises(E.TransactionConflict):
        store.cursor_end(mine, last=True)


def test_a_stream_starts_again_where_it_stopped(spark, tmp_path):
    source, path, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("key"), F.struct(F.col("id").alias("o")).alias("ord"), F.lit(1.0).alias("record"))
    for a, b in ((0, 10), (10, 25), (25, 25)):
        rows(a, b).write.mode("append").parquet(source)
        append_stream(spark.readStream.schema(rows(0, 1).schema).parquet(source), path, mark).awaitTermination()
        assert sorted(r["key"] for r in spark.read.parquet(path).collect()) == list(range(b))

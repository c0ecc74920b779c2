"""Ordered navigation: ends, steps, and the duplicates of a key.

A cursor is the pair it stands on: (key, ord) is a bookmark that any later plan can
filter by.  Whole-relation steps (each pair with its successor) are one pass over
ranges of the order, never one sorted task.  Keys of any type go in the database's own
order, where it has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrand.errors import CursorIsNil, InvalidParameter
from keystrand.functions.ranking import last_before, split_row_number
from keystrand.operators.aggregates import first_of_key
from keystrand.sources.catalog import Database

def _key(db: Database) -> Column:
    return db.order(F.col("key"))


def first(db: Database) -> DataFrame:
    return db.rows.orderBy(_key(db), "ord").limit(1).select("key", "record")


def last(db: Database) -> DataFrame:
    return db.rows.orderBy(_key(db).desc(), F.col("ord").desc()).limit(1).select("key", "record")


def step(db: Database, key: object, forward: bool = True) -> DataFrame:
    """The first pair of the next key, or the last pair of the one before."""
    at = db.order(F.lit(key))
    if forward:
        return db.rows.filter(_key(db) > at).orderBy(_key(db), "ord").limit(1).select("key", "record")
    return db.rows.filter(_key(db) < at).orderBy(_key(db).desc(), F.col("ord").desc()).limit(1).select("key", "record")


def neighbours(db: Database, forward: bool = True, skip_duplicates: bool = False) -> DataFrame:
    """Every pair with the pair after (or before) it: key, record, other_key, other_record (null at the end)."""
    rows = first_of_key(db.rows) if skip_duplicates and db.duplicates else db.rows
    rows = rows.select(_key(db).alias("_k"), "ord", F.struct("key", "record").alias("pair"))
    found = last_before(rows, [], ["_k", "ord"], "pair", "other", descending=forward)
    return found.select("pair.key", "pair.record", F.col("other.key").alias("other_key"), F.col("other.record").alias("other_record"))


def bookmark(db: Database, begin: object = None, end: object = None) -> DataFrame:
    """Where a cursor stands after a select over begin <= key < end has moved it on: the first pair at or past the end (no row: past the last)."""
    rows = db.rows
    if end is None:
        return rows.filter("false").select("key", "record")
    return rows.filter(_key(db) >= db.order(F.lit(end))).orderBy(_key(db), "ord").limit(1).select("key", "record")


def position(db: Database, cursor: tuple[int, object] | None) -> object:
    """The key of a cursor (database number, key) that a range of ``db`` may begin or end at."""
    if cursor is None or cursor[1] is None:
        raise CursorIsNil(str(db.id))
    if cursor[0] != db.id:
        raise InvalidParameter(f"a cursor of database {cursor[0]} can't bound a range of database {db.id}")
    return cursor[1]


def duplicate_counts(db: Database) -> DataFrame:
    return db.rows.groupBy("key").agg(F.count("*").alias("n"))


def duplicate_positions(db: Database) -> DataFrame:
    """Every pair with its 0-based place among its key's records: key, record, position."""
    return split_row_number(db.rows, ["key"], ["ord"], "position").select("key", "record", "position")


def next_duplicates(db: Database, forward: bool = True) -> DataFrame:
    """Every pair with the record after (or before) it of the same key: key, record, next_record (or previous_record)."""
    found = last_before(db.rows.withColumn("held", F.struct("record")), ["key"], ["ord"], "held", "other", descending=forward)
    return found.select("key", "record", F.col("other.record").alias("next_record" if forward else "previous_record"))


def duplicate_ends(db: Database, last: bool = False) -> DataFrame:
    """Each key with its first (or last) record."""
    pick = F.max if last else F.min
    return db.rows.groupBy("key").agg(pick(F.struct("ord", "record")).alias("p")).select("key", F.col("p.record").alias("record"))


def record_sizes(db: Database) -> DataFrame:
    """Every pair with the size of its record in bytes."""
    return db.rows.select("key", "record", db.record_kind.size(F.col("record")).alias("size"))

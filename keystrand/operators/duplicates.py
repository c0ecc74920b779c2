"""Changes to single duplicates: where a record is inserted, which one is overwritten or erased.

A log row is (seq, op, key, at, record).  ``at`` is the bookmark (ord) of the duplicate that a cursor
stands on, or null.  Operations: ``first`` and ``last`` insert at the ends of the key's
duplicates (also of a key that isn't there yet), ``before`` and ``after`` next to the one at ``at``, ``overwrite`` and ``erase`` change
that one, ``erase_key`` takes the key with all its records.

Places are not numbers to be shifted but an order: zone (inserted first, stored, inserted
last), the bookmark, side of it, and the log's order, so that the whole log is
applied at once, and a key with a third of all rows needs no task of its own.  A bookmark
must name one duplicate; where a table's order has ties, ``renumbered`` gives such bookmarks first.  The
records of one log refer to duplicates that were there before it; the next log may
refer to all, by the bookmarks of the new database.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrand.errors import InvalidParameter
from keystrand.functions.ranking import split_row_number
from keystrand.operators.overlay import NOT_FOUND, OK
from keystrand.sources.catalog import Database

INSERTS, ANCHORED = ("first", "last", "before", "after"), ("before", "after", "overwrite", "erase")


def outcomes(db: Database, ops: DataFrame) -> DataFrame:
    """Each operation with its status: KEY_NOT_FOUND where its duplicate isn't there, or an earlier operation has erased it or its key.

    ``erase_key`` finds its key if the database has it or the log has begun it; a log may erase it again.
    """
    if not db.duplicates:
        raise InvalidParameter("this database has unique keys")
    kind = db.rows.schema["ord"].dataType.simpleString()
    ops = ops.select("seq", "op", "key", F.col("at").cast(kind).alias("at"), "record")
    there = db.rows.select("key", F.col("ord").alias("at"), F.lit(True).alias("_there"))
    # of the log, what the first erasing of a duplicate and of a key is: one row for each
    gone = ops.filter("op = 'erase'").groupBy("key", "at").agg(F.min("seq").alias("_gone"))
    key_gone = ops.filter("op = 'erase_key'").groupBy("key").agg(F.min("seq").alias("_key_gone"))
    known = ops.filter("op = 'erase_key'").select("key").distinct().join(db.rows.select("key").distinct().withColumn("_key", F.lit(True)), "key")
    begun = ops.filter(F.col("op").isin("first", "last")).groupBy("key").agg(F.min("seq").alias("_begun"))
    rows = ops.join(there, ["key", "at"], "left").join(gone, ["key", "at"], "left").join(key_gone, "key", "left").join(known, "key", "left").join(begun, "key", "left")
    anchored = F.col("op").isin(*ANCHORED)
    lost = anchored & (F.col("_there").isNull() | (F.col("_gone") < F.col("seq")) | (F.col("_key_gone") < F.col("seq")))
    no_key = (F.col("op") == "erase_key") & F.col("_key").isNull() & ~F.coalesce(F.col("_begun") < F.col("seq"), F.lit(False))
    status = F.when(F.coalesce(lost, F.lit(False)) | no_key, NOT_FOUND).otherwise(OK)
    return rows.select("seq", "op", "key", "at", "record", status.alias("status"))


def place(zone: int, at: Column, side: int, turn: Column) -> Column:
    return F.struct(F.lit(zone).alias("zone"), at.alias("at"), F.lit(side).alias("side"), turn.alias("turn"))


def applied(db: Database, ops: DataFrame) -> Database:
    """The database after the log, with bookmarks of its own; those of the records that were there lie in ord.at."""
    done = outcomes(db, ops).filter(F.col("status") == OK)
    kind = db.rows.schema["ord"].dataType.simpleString()
    seq, zero = F.col("seq").cast("long"), F.lit(0).cast("long")
    erased = done.filter("op = 'erase_key'").groupBy("key").agg(F.max("seq").alias("_erased"))
    last = F.struct(F.col("seq"), F.col("op"), F.col("record"))
    changed = done.filter("op in ('overwrite', 'erase')").groupBy("key", F.col("at").alias("ord")).agg(F.max(last).alias("_last"))
    kept = db.rows.join(erased, "key", "left_anti").join(changed, ["key", "ord"], "left").filter("_last is null or _last.op <> 'erase'")
    stored = kept.select("key", place(1, F.col("ord"), 0, zero).alias("ord"), F.when(F.col("_last").isNull(), F.col("record")).otherwise(F.col("_last.record")).alias("record"))
    nowhere = F.lit(None).cast(kind)
    where = (
        F.when(F.col("op") == "first", place(0, nowhere, 0, -seq))
        .when(F.col("op") == "before", place(1, F.col("at"), -1, seq))
        .when(F.col("op") == "after", place(1, F.col("at"), 1, -seq))
        .otherwise(place(2, nowhere, 0, seq))
    )
    new = done.filter(F.col("op").isin(*INSERTS)).join(erased, "key", "left").filter("_erased is null or _erased < seq")
    added = new.select("key", where.alias("ord"), db.record_kind.stored(F.col("record")).alias("record"))
    return db.with_rows(stored.unionByName(added))


def renumbered(db: Database) -> Database:
    """The same pairs with bookmarks that are their places, from 0: short ones, whatever logs came before.

    Pairs of a key that share a bookmark get one each, in the order of their records.
    """
    rows = split_row_number(db.rows, ["key"], ["ord", "record"], "_n")
    return db.with_rows(rows.select("key", F.struct(F.col("_n").alias("n")).alias("ord"), "record"))

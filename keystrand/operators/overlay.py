"""Bulk operations and transactions as an overlay of an operation log.

A log row is (seq, op, key, record) with op one of insert (fails if the key is
there), put (insert or overwrite), erase (fails if it isn't) and find.  What a key
holds before an operation follows from the last earlier operation that changed it,
so the whole log is worked off at once: no operation waits for another.

This is the overlay of databases with unique keys; ``operators.duplicates`` has that of the others.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrand.errors import InvalidParameter, LimitsReached, TransactionConflict, WriteProtected
from keystrand.functions.ranking import last_in_ranges, ranged, split_row_number
from keystrand.operators import cursor
from keystrand.sources.catalog import Database

OK, DUPLICATE, NOT_FOUND = "OK", "DUPLICATE_KEY", "KEY_NOT_FOUND"


def outcomes(db: Database, ops: DataFrame) -> DataFrame:
    """Each operation with status and, for find, the record found: seq, op, key, record, status, found."""
    if db.duplicates:
        raise InvalidParameter("the keys of this database aren't unique")
    base = db.rows.select("key", F.struct("record").alias("stored"))
    rows = ops.select("seq", "op", "key", "record").join(base, "key", "left")
    changes = F.col("op") != "find"
    # whether the key is there after an operation doesn't depend on what was there before
    rows = rows.withColumn("_left", F.when(changes, F.struct((F.col("op") != "erase").alias("there"))))
    rows = last_in_ranges(ranged(rows, ["key", "seq"]), ["key"], ["seq"], "_left", "_prior")
    there = F.coalesce(F.col("_prior.there"), F.col("stored").isNotNull())
    rows = rows.withColumn("_there", there)
    wrote = (F.col("op") == "put") | ((F.col("op") == "insert") & ~F.col("_there"))
    rows = rows.withColumn("_write", F.when(wrote, F.struct("record")))
    rows = last_in_ranges(rows, ["key"], ["seq"], "_write", "_written")
    status = (
        F.when((F.col("op") == "insert") & F.col("_there"), DUPLICATE)
        .when(F.col("op").isin("erase", "find") & ~F.col("_there"), NOT_FOUND)
        .otherwise(OK)
    )
    found = F.when((F.col("op") == "find") & F.col("_there"), F.coalesce(F.col("_written"), F.col("stored"))["record"])
    return rows.select("seq", "op", "key", "record", status.alias("status"), found.alias("found"))


def applied(db: Database, ops: DataFrame) -> Database:
    """The database after all operations."""
    done = outcomes(db, ops)
    last = done.filter("op <> 'find'").groupBy("key").agg(
        F.max_by("op", "seq").alias("op"),
        F.max_by("record", F.when((F.col("op") == "put") | ((F.col("op") == "insert") & (F.col("status") == OK)), F.col("seq"))).alias("record"),
        F.max(F.when((F.col("op") == "put") | ((F.col("op") == "insert") & (F.col("status") == OK)), F.lit(1)).otherwise(0)).alias("wrote"),
    )
    joined = db.rows.join(last.select("key", "op", F.struct("record").alias("new"), "wrote"), "key", "left")
    kept = joined.filter("op is null or op <> 'erase'").select("key", "ord", F.when(F.col("wrote") == 1, F.col("new.record")).otherwise(F.col("record")).alias("record"))
    added = last.filter("op <> 'erase' and wrote = 1").join(db.rows.select("key"), "key", "left_anti")
    nothing = F.lit(None).cast(db.rows.schema["ord"].dataType)
    return db.with_rows(kept.unionByName(added.select("key", nothing.alias("ord"), "record")))


def numbered(db: Database, records: DataFrame, record: Column, order: list[str]) -> DataFrame:
    """New pairs whose keys continue the database's record numbers, contiguous and in order of the given columns.

    Rows are numbered within range partitions of the order, after one count per partition.
    """
    start = db.rows.agg(F.max("key")).first()[0] or 0
    rows = records.select(record.alias("record"), *[F.col(c).alias(f"_s{i}") for i, c in enumerate(order)])
    placed = split_row_number(rows, [], [f"_s{i}" for i in range(len(order))], "_n")
    most = db.key_kind.most
    if most is not None and start >= most:
        raise LimitsReached(str(most))
    return placed.select(db.key_kind.stored(F.col("_n") + F.lit(int(start) + 1)).alias("key"), "record")


@dataclass
class Transaction:
    id: int
    read_only: bool = False
    logs: list[DataFrame] = field(default_factory=list)


class Overlay:
    """Transactions over one database: others see committed operations only, a transaction also its own."""

    def __init__(self, db: Database):
        self.db, self.committed = db, []
        self.active: dict[int, Transaction] = {}
        self._next = self._lsn = 0

    def begin(self, read_only: bool = False) -> Transaction:
        self._next += 1
        self.active[self._next] = Transaction(self._next, read_only)
        return self.active[self._next]

    def write(self, txn: Transaction, ops: DataFrame) -> None:
        """Log operations (seq, op, key, record); a key that another open transaction has changed is a conflict."""
        if txn.read_only:
            raise WriteProtected(str(txn.id))
        for other in self.active.values():
            if other is not txn:
                for log in other.logs:
                    if ops.join(log.filter("op <> 'find'"), "key", "left_semi").take(1):
                        raise TransactionConflict(str(other.id))
        self._lsn += 1
        txn.logs.append(ops.select("seq", "op", "key", "record").withColumn("lsn", F.lit(self._lsn)))

    def commit(self, txn: Transaction) -> None:
        self.committed += txn.logs
        del self.active[txn.id]

    def abort(self, txn: Transaction) -> None:
        del self.active[txn.id]

    def view(self, txn: Transaction | None = None) -> Database:
        """The database as the transaction sees it, or as everybody does."""
        logs = self.committed + (txn.logs if txn else [])
        if not logs:
            return self.db
        log = reduce(DataFrame.unionByName, logs)
        # one order for all logs: log number, then place in it
        return applied(self.db, log.select(F.struct("lsn", "seq").alias("seq"), "op", "key", "record"))

    def cursor_view(self, txn: Transaction | None = None) -> Database:
        """The view without the keys that another open transaction has changed: a cursor steps over them."""
        seen = self.view(txn)
        for other in self.active.values():
            if other is not txn:
                for log in other.logs:
                    changed = log.filter("op <> 'find'").select("key")
                    seen = seen.with_rows(seen.rows.join(changed, "key", "left_anti").select(*seen.rows.columns))
        return seen

    def cursor_end(self, txn: Transaction | None = None, last: bool = False) -> DataFrame:
        """The first (or last) pair of the view; a conflict if another open transaction has changed that key, or one beyond it."""
        seen, held = self.view(txn), self.cursor_view(txn)
        end = cursor.last if last else cursor.first
        found, free = end(seen).first(), end(held).first()
        others = [log for other in self.active.values() if other is not txn for log in other.logs]
        if found != free:
            raise TransactionConflict(str(found and found["key"]))
        for log in others:
            keys = log.filter("op <> 'find'").select(self.db.order(F.col("key")).alias("k"))
            edge = keys.agg(F.max("k") if last else F.min("k")).first()[0]
            at = None if found is None else end(seen).select(self.db.order(F.col("key"))).first()[0]
            if edge is not None and (at is None or (edge > at if last else edge < at)):
                raise TransactionConflict(str(edge))
        return end(seen)

    def flush(self) -> Database:
        """Work the committed operations into the database; the log is empty afterwards, open transactions keep theirs."""
        self.db, self.committed = self.view(), []
        return self.db

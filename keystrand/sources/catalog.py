"""Numbered databases: ordered multimaps of (key, record) held as DataFrames.

A database's rows have the columns key, ord and record.  ``ord`` orders the records
of one key (their insertion order); it need only be comparable, so nothing has to
be numbered when rows are stored.  Rows with a null key or record are left out when
a database is registered: neither has a place in the order.  Keys of an order of their own
(``sort_key``) are compared by it everywhere: in ranges, lookups, cursors and sorted results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrand.errors import DatabaseExists, DatabaseNotFound, InvalidKeyType, InvalidParameter, WriteProtected
from keystrand.sources.scratch import exists, listed, move, remove
from keystrand.types import Kind

LEAST_ID, MOST_ID = 1, 0xEFFF


@dataclass(frozen=True)
class Database:
    """One ordered multimap and its configuration."""

    id: int
    rows: DataFrame
    key_kind: Kind
    record_kind: Kind
    duplicates: bool = False
    record_number: bool = False
    sort_key: object = None  # Column -> Column: orders keys that have an order of their own

    def order(self, column: Column) -> Column:
        return self.sort_key(column) if self.sort_key else column

    def with_rows(self, rows: DataFrame) -> Database:
        return replace(self, rows=rows)

    def with_order(self, sort_key) -> Database:
        return replace(self, sort_key=sort_key)


def database(
    id: int,
    source: DataFrame,
    key: str,
    record: str | None,
    key_kind: Kind,
    record_kind: Kind,
    order: list[str] = (),
    duplicates: bool = False,
    record_number: bool = False,
    sort_key=None,
) -> Database:
    """A database over the columns of a table; ``order`` must order a key's rows totally."""
    if not LEAST_ID <= id <= MOST_ID:
        raise InvalidParameter(f"database id {id} is not in {LEAST_ID}..{MOST_ID}")
    if record_number and key_kind not in (Kind.UINT32, Kind.UINT64):
        raise InvalidKeyType("record numbers are uint32 or uint64")
    if record_number and duplicates:
        raise InvalidParameter("record numbers are unique")
    value = F.col(record) if record else F.lit("")
    ord_ = F.struct(*[F.col(c) for c in order]) if order else F.struct(F.lit(0).alias("_"))
    rows = source.select(key_kind.stored(F.col(key)).alias("key"), ord_.alias("ord"), record_kind.stored(value).alias("record"))
    return Database(id, rows.filter(F.col("key").isNotNull() & F.col("record").isNotNull()), key_kind, record_kind, duplicates, record_number, sort_key)


class Catalog:
    """Databases by number: those of this session, and those stored as Parquet folders under ``root``.

    A stored database is a folder ``db-<number>`` of versions; a version is its rows, then a
    table of one row with its configuration, which makes it valid.  The last valid version is
    the database, so that readers never see half of one, nor a writer's lost tasks.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, read_only: bool = False):
        self.spark, self.root, self.read_only = spark, root.rstrip("/") if root else None, read_only
        self._open: dict[int, Database] = {}

    def _check(self, id: int) -> None:
        if not LEAST_ID <= id <= MOST_ID:
            raise InvalidParameter(f"database id {id} is not in {LEAST_ID}..{MOST_ID}")
        if self.read_only:
            raise WriteProtected(str(id))

    def _folder(self, id: int) -> str:
        return f"{self.root}/db-{id}"

    def _versions(self, id: int) -> list[int]:
        """Valid versions of a stored database, ascending."""
        if self.root is None:
            return []
        return sorted(int(name.removeprefix("v")) for name in listed(self.spark, self._folder(id)) if exists(self.spark, f"{self._folder(id)}/{name}/config/_SUCCESS"))

    def stored(self) -> list[int]:
        """Numbers of the databases under ``root``."""
        names = listed(self.spark, self.root) if self.root else []
        return sorted(i for i in (int(n.removeprefix("db-")) for n in names if n.startswith("db-")) if self._versions(i))

    def add(self, db: Database) -> Database:
        """A database of this session alone."""
        self._check(db.id)
        if db.id in self._open or self._versions(db.id):
            raise DatabaseExists(str(db.id))
        self._open[db.id] = db
        return db

    def create(self, db: Database) -> Database:
        """Store a new database and open it."""
        self._check(db.id)
        if self.root is None:
            raise InvalidParameter("this catalog has no root")
        if db.id in self._open or self._versions(db.id):
            raise DatabaseExists(str(db.id))
        return self._write(db, 1)

    def flush(self, db: Database) -> Database:
        """Store a changed database as a new version, open it, and drop the versions before the last."""
        self._check(db.id)
        versions = self._versions(db.id)
        if not versions:
            raise DatabaseNotFound(str(db.id))
        new = self._write(db, versions[-1] + 1)
        for v in versions[:-1]:
            remove(self.spark, f"{self._folder(db.id)}/v{v}")
        return new

    def _write(self, db: Database, version: int) -> Database:
        if db.sort_key:
            raise InvalidParameter("a key order that is a function can't be stored; register it anew with with_order")
        path = f"{self._folder(db.id)}/v{version}"
        db.rows.repartitionByRange("key").sortWithinPartitions("key", "ord").write.mode("overwrite").parquet(f"{path}/rows")
        config = [(db.key_kind.name, db.record_kind.name, db.duplicates, db.record_number)]
        names = "key_kind string, record_kind string, duplicates boolean, record_number boolean"
        self.spark.createDataFrame(config, names).coalesce(1).write.mode("overwrite").parquet(f"{path}/config")
        self._open.pop(db.id, None)
        return self.open(db.id)

    def open(self, id: int) -> Database:
        """A stored database, with the types and flags that it was created with."""
        if id in self._open:
            return self._open[id]
        versions = self._versions(id)
        if not versions:
            raise DatabaseNotFound(str(id))
        path = f"{self._folder(id)}/v{versions[-1]}"
        config = self.spark.read.parquet(f"{path}/config").first()
        rows = self.spark.read.parquet(f"{path}/rows")
        self._open[id] = Database(id, rows, Kind[config["key_kind"]], Kind[config["record_kind"]], config["duplicates"], config["record_number"])
        return self._open[id]

    def close(self, id: int) -> None:
        self._open.pop(id, None)

    def get(self, id: int) -> Database:
        """An open database; a stored one is opened first."""
        return self.open(id)

    def replace(self, db: Database) -> None:
        self.get(db.id)
        self._open[db.id] = db

    def rename(self, old: int, new: int) -> None:
        self._check(new)
        if new in self._open or self._versions(new):
            raise DatabaseExists(str(new))
        db = self.get(old)
        if self._versions(old):
            move(self.spark, self._folder(old), self._folder(new))
            self.close(old)
        else:
            del self._open[old]
            self._open[new] = replace(db, id=new)

    def erase(self, id: int) -> None:
        self._check(id)
        self.get(id)
        self.close(id)
        if self._versions(id):
            remove(self.spark, self._folder(id))

    def __iter__(self) -> Iterator[int]:
        return iter(sorted({*self._open, *self.stored()}))

    def parameters(self, id: int) -> dict[str, object]:
        db = self.get(id)
        return {"id": db.id, "key": db.key_kind.value[0], "record": db.record_kind.value[0], "duplicates": db.duplicates, "record_number": db.record_number, "stored": bool(self._versions(id))}

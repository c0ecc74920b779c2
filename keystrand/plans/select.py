"""A select over one database, as a DataFrame.

``select(db, "sum", "record", where=..., distinct=..., limit=..., begin=..., end=...)``
stands for: apply one function to a column of the database's ordered pairs, after a
key range (begin inclusive, end exclusive), a predicate and the choice of each key's
first record.  There is no statement text: the arguments are the statement.

Two rules of duplicates: SUM and AVERAGE of the key visit each key once unless the
predicate reads records, and ``distinct`` keeps the first record of each key.  Where
keys are unique neither costs anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrand.errors import PluginNotFound, StatementError
from keystrand.functions.registry import PluginContext, Predicate, Registry, told
from keystrand.operators import aggregates as A
from keystrand.sources.catalog import Database

NUMERIC = {"sum": A.total, "average": A.average, "min": A.least, "max": A.greatest, "top": A.top, "bottom": A.bottom}
LIMITED = ("top", "bottom")


def key_range(db: Database, begin: object = None, end: object = None) -> DataFrame:
    """Rows with begin <= key < end; the filters reach the Parquet scan."""
    rows = db.rows
    if begin is not None:
        rows = rows.filter(db.order(F.col("key")) >= db.order(F.lit(begin)))
    if end is not None:
        rows = rows.filter(db.order(F.col("key")) < db.order(F.lit(end)))
    return rows


def select(
    db: Database,
    function: str,
    on: str = "key",
    where: Predicate | str | None = None,
    distinct: bool = False,
    limit: int = 0,
    begin: object = None,
    end: object = None,
    where_reads_record: bool = True,
    registry: Registry | None = None,
) -> DataFrame:
    """``on`` is "key", "record" or "both"; ``where`` a function (key, record) -> Column or a registered name."""
    name = function.lower()
    if on not in ("key", "record", "both"):
        raise StatementError(on)
    if limit and name not in LIMITED:
        raise StatementError(f"{name} takes no limit")
    if limit < 0:
        raise StatementError("a limit is not negative")
    rows = key_range(db, begin, end)
    context = PluginContext(db.key_kind, db.record_kind, db.duplicates, on, distinct)
    if isinstance(where, str):
        try:
            found = (registry or Registry()).get(where)
        except PluginNotFound as e:
            raise StatementError(str(e)) from e
        if found.predicate is None:
            raise StatementError("not a predicate")
        where, where_reads_record = told(found.predicate, 2, context), where_reads_record and "record" in found.needs
    keys_only = name in ("sum", "average") and on == "key" and (where is None or not where_reads_record)
    if db.duplicates and keys_only:
        # each key once: its records are not read at all
        rows = rows.select("key").distinct()
        if where is not None:
            rows = rows.filter(where(F.col("key"), F.lit(None)))
    else:
        if distinct and db.duplicates:
            rows = A.first_of_key(rows)
        if where is not None:
            rows = rows.filter(where(F.col("key"), F.col("record")))
    if name in NUMERIC:
        kind = {"key": db.key_kind, "record": db.record_kind}.get(on)
        if kind is None or not kind.numeric:
            raise StatementError(f"{name} takes a numeric key or record")
        return NUMERIC[name](rows, on, kind, limit or 1) if name in LIMITED else NUMERIC[name](rows, on, kind)
    if name == "count":
        return A.count(rows)
    if name == "value":
        # pairs in key order; the caller may sort again after further steps
        return rows.orderBy(db.order(F.col("key")), "ord").select(*{"key": ["key"], "record": ["record"], "both": ["key", "record"]}[on])
    try:
        plugin = (registry or Registry()).get(name)
    except PluginNotFound as e:
        raise StatementError(str(e)) from e
    if plugin.aggregate is None:
        raise StatementError(f"{name} is not an aggregate")
    rows = rows.select(*[c for c in rows.columns if c == "ord" or c in plugin.needs])
    return told(plugin.aggregate, 1, context)(rows)

"""Exact and nearest-key lookup, one key at a time or for a table of probes.

Modes: exact, lt, leq, gt, geq, and near (exact, else the next lower key, else the
next higher one).  ``sign`` tells how the key found compares to the key asked for.
A key's record is its first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrand.errors import InvalidParameter
from keystrand.functions.ranking import last_before
from keystrand.operators.aggregates import first_of_key
from keystrand.sources.catalog import Database

MODES = ("exact", "lt", "leq", "gt", "geq", "near")


def find(db: Database, key: object, mode: str = "exact") -> DataFrame:
    """At most one row: key, record, sign.  A filter on the key and a top-1."""
    if mode not in MODES:
        raise InvalidParameter(mode)
    at, probe = db.order(F.col("key")), db.order(F.lit(key))
    sign = F.when(at < probe, -1).when(at > probe, 1).otherwise(0)
    if mode == "near":
        nearest = [find(db, key, m).withColumn("_p", F.lit(p)) for p, m in enumerate(("exact", "lt", "gt"))]
        return nearest[0].unionByName(nearest[1]).unionByName(nearest[2]).orderBy("_p").limit(1).drop("_p")
    rows = {"exact": at == probe, "lt": at < probe, "leq": at <= probe, "gt": at > probe, "geq": at >= probe}[mode]
    way = at.desc() if mode in ("lt", "leq") else at.asc()
    return db.rows.filter(rows).orderBy(way, "ord").limit(1).select("key", "record", sign.alias("sign"))


def find_all(db: Database, probes: DataFrame, probe: str, mode: str = "leq") -> DataFrame:
    """For each distinct probe: probe, key, record (null where there is none); keys of any type, in the database's order.

    An as-of join: pairs and probes are put in one order, and each probe looks back
    (or ahead) for the nearest pair, range by range.
    """
    asked = probes.select(F.col(probe).alias("probe")).filter("probe is not null").distinct()
    if mode == "exact":
        return asked.join(first_of_key(db.rows).select(F.col("key").alias("probe"), "key", "record"), "probe", "left")
    if mode == "near":
        exact = find_all(db, probes, probe, "leq")
        over = find_all(db, exact.filter("key is null"), "probe", "gt")
        return exact.filter("key is not null").unionByName(over)
    if mode not in MODES:
        raise InvalidParameter(mode)
    back = mode in ("lt", "leq")
    # where a probe equals a key, this puts the key on the side that is searched, or not
    side = {"leq": 1, "lt": -1, "geq": -1, "gt": 1}[mode]
    firsts = first_of_key(db.rows)
    pairs = firsts.select(db.order(F.col("key")).alias("x"), F.lit(0).alias("side"), F.struct("key", "record").alias("pair"), F.lit(None).cast(asked.schema["probe"].dataType).alias("probe"))
    both = pairs.unionByName(asked.select(db.order(F.col("probe")).alias("x"), F.lit(side).alias("side"), F.lit(None).cast(pairs.schema["pair"].dataType).alias("pair"), "probe"))
    found = last_before(both, [], ["x", "side"], "pair", "found", descending=not back)
    return found.filter("side <> 0").select("probe", "found.key", "found.record")

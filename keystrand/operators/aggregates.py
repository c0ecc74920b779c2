"""The built-in aggregates of a select, over rows (key, ord, record).

Each returns a relation (key, record).  Ties go to the pair that comes first in
(key, ord) order.  NaN is never the greatest or least value.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrand.types import Kind


def first_of_key(rows: DataFrame) -> DataFrame:
    """One row for each key, that of its first record: a minimum, so Spark combines before it shuffles."""
    return rows.groupBy("key").agg(F.min(F.struct("ord", "record")).alias("f")).select("key", F.col("f.ord").alias("ord"), F.col("f.record").alias("record"))


def total(rows: DataFrame, on: str, kind: Kind) -> DataFrame:
    """SUM: unsigned integers modulo 2**64, signed ones exactly, reals in double precision; 0 for no rows."""
    if kind.real:
        value = F.coalesce(F.sum(F.col(on).cast("double")), F.lit(0.0))
    else:
        value = F.coalesce(F.sum(F.col(on).cast("decimal(28,0)")), F.lit(0).cast("decimal(38,0)"))
        if kind.most is not None:
            value = F.pmod(value, F.lit(Decimal(2**64)).cast("decimal(38,0)")).cast("decimal(20,0)")
    return rows.agg(value.alias("record")).select(F.lit("SUM").alias("key"), "record")


def average(rows: DataFrame, on: str, kind: Kind) -> DataFrame:
    """AVERAGE in double precision; NaN for no rows."""
    return rows.agg(F.coalesce(F.avg(F.col(on).cast("double")), F.lit(float("nan"))).alias("record")).select(F.lit("AVERAGE").alias("key"), "record")


def count(rows: DataFrame, on: str = "key", kind: Kind | None = None) -> DataFrame:
    return rows.agg(F.count("*").alias("record")).select(F.lit("COUNT").alias("key"), "record")


def numbers(rows: DataFrame, on: str, kind: Kind) -> DataFrame:
    return rows.filter(~F.isnan(on)) if kind.real else rows


def least(rows: DataFrame, on: str, kind: Kind) -> DataFrame:
    """MIN: the least value with the pair it stands in; no row for no rows."""
    best = numbers(rows, on, kind).agg(F.min(F.struct(F.col(on).alias("v"), "key", "ord", "record")).alias("b"))
    return best.filter("b is not null").select("b.key", "b.record")


def greatest(rows: DataFrame, on: str, kind: Kind) -> DataFrame:
    """MAX: the greatest value with the first pair it stands in.

    One row comes out of a top-1 by value, key and order, which each task computes first.
    """
    return numbers(rows, on, kind).orderBy(F.col(on).desc(), "key", "ord").limit(1).select("key", "record")


def extremes(rows: DataFrame, on: str, kind: Kind, n: int, order: Column) -> DataFrame:
    """The n first distinct values in ``order``, each with the first pair it stands in, ascending by value."""
    firsts = numbers(rows, on, kind).groupBy(F.col(on).alias("v")).agg(F.min(F.struct("key", "ord", "record")).alias("f"))
    return firsts.orderBy(order).limit(n).orderBy("v").select("f.key", "f.record")


def top(rows: DataFrame, on: str, kind: Kind, n: int = 1) -> DataFrame:
    return extremes(rows, on, kind, n, F.col("v").desc())


def bottom(rows: DataFrame, on: str, kind: Kind, n: int = 1) -> DataFrame:
    return extremes(rows, on, kind, n, F.col("v").asc())

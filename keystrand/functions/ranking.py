"""Row numbers and the last value before a row, in orders and keys of any size.

A plain window sends all rows of a key, or of an order without keys, to one task.
Here Spark deals the rows to ranges of the whole order (keys first), as many as the session's
shuffle partitions or as AQE makes of them by size, so that a key with a third of
all rows is cut too; the columns keep their own types.  The ranges are written once, to
``spark.checkpoint.dir``, so that they are the same wherever they are read.  What a range needs from those
before it is one row for each key that lies in several ranges, fewer rows than there are ranges;
these alone are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrand.sources.scratch import written


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``_range``: ascending numbers of ranges of the order, which must be total (equal rows may part)."""
    return written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")


def split_row_number(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Add ``out``: the 0-based place of a row among those of its keys, in the order given."""
    rows = ranged(df, [*keys, *order])
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_n")).select(*keys, "_range", F.sum("_n").over(before).alias("_start")).filter("_start > 0")
    placed = rows.withColumn("_place", F.row_number().over(inside) - 1)
    joined = placed.join(F.broadcast(starts), [*keys, "_range"], "left")
    return joined.withColumn(out, (F.coalesce("_start", F.lit(0)) + F.col("_place")).cast("long")).drop("_range", "_place", "_start")


def last_in_ranges(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str, descending: bool = False) -> DataFrame:
    """``last_before`` of rows that have their ``_range`` already, which stays."""
    turn = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    by = [*keys, "_range"]
    inside = Window.partitionBy(*by).orderBy(*[turn(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    pick = F.min_by if descending else F.max_by
    place: Column = F.struct(*[F.col(c) for c in order])
    # of every key and range, also those without a value, the last value
    held = rows.groupBy(*by).agg(pick(value, F.when(F.col(value).isNotNull(), place)).alias("_v"))
    earlier = Window.partitionBy(*keys or [F.lit(0)]).orderBy(turn("_range")).rowsBetween(Window.unboundedPreceding, -1)
    carried = held.select(*by, F.last("_v", ignorenulls=True).over(earlier).alias("_carried")).filter("_carried is not null")
    near = rows.withColumn("_near", F.last(value, ignorenulls=True).over(inside))
    return near.join(F.broadcast(carried), by, "left").withColumn(out, F.coalesce("_near", "_carried")).drop("_near", "_carried")


def last_before(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, descending: bool = False) -> DataFrame:
    """Add ``out``: the last value that is not null, strictly before the row among those of its keys, in the order given.

    With ``descending`` the order is turned round, so "before" means after.
    """
    return last_in_ranges(ranged(df, [*keys, *order]), keys, order, value, out, descending).drop("_range")

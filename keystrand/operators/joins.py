"""Joins of databases: one to many, through a link database, semi and anti."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrand.sources.catalog import Database


def one_to_many(one: Database, many: Database) -> DataFrame:
    """Pairs of equal key: key, left, right."""
    left, right = one.rows.select("key", F.col("record").alias("left")), many.rows.select("key", F.col("record").alias("right"))
    return left.join(right, "key")


def through_link(left: Database, link: Database, right: Database) -> DataFrame:
    """left.key = link.key and link.record = right.key: key, left, right_key, right."""
    a = left.rows.select("key", F.col("record").alias("left"))
    b = link.rows.select("key", F.col("record").alias("right_key"))
    c = right.rows.select(F.col("key").alias("right_key"), F.col("record").alias("right"))
    return a.join(b, "key").join(c, "right_key").select("key", "left", "right_key", "right")


def existing(db: Database, other: Database) -> DataFrame:
    return db.rows.join(other.rows, "key", "left_semi").select("key", "record")


def missing(db: Database, other: Database) -> DataFrame:
    return db.rows.join(other.rows, "key", "left_anti").select("key", "record")

"""Writing, reading, exporting and merging databases as files."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrand.sources.catalog import Database


def save(db: Database, path: str) -> None:
    """Parquet sorted by key within files that hold key ranges, so that key filters prune row groups."""
    db.rows.repartitionByRange("key").sortWithinPartitions("key", "ord").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, like: Database) -> Database:
    return replace(like, rows=spark.read.parquet(path))


def export_rows(db: Database, path: str, format: str = "json") -> None:
    db.rows.write.mode("overwrite").format(format).save(path)


def merge(db: Database, other: Database) -> Database:
    """Rows of both; where keys must be unique, those of ``db`` win."""
    new = other.rows
    if not db.duplicates:
        new = new.join(db.rows.select("key"), "key", "left_anti").select("key", "ord", "record")
    if db.rows.schema["ord"].dataType != new.schema["ord"].dataType:
        raise ValueError("both databases must order duplicates by the same columns")
    return db.with_rows(db.rows.unionByName(new))


def dump(db: Database, key_chars: int = 16, record_chars: int = 16) -> DataFrame:
    """Text form of each pair, cut to a number of characters."""
    return db.rows.select(F.substring(F.col("key").cast("string"), 1, key_chars).alias("key"), F.substring(F.col("record").cast("string"), 1, record_chars).alias("record"))


def info(db: Database) -> DataFrame:
    """Statistics of a database: pairs, distinct keys, least and greatest key, mean record size in bytes."""
    return db.rows.agg(
        F.count("*").alias("n_pairs"),
        F.countDistinct("key").alias("n_keys"),
        F.min("key").alias("least_key"),
        F.max("key").alias("greatest_key"),
        F.avg(db.record_kind.size(F.col("record"))).alias("mean_record_size"),
    )


def violations(db: Database) -> DataFrame:
    """Integrity check: keys that repeat where they must not, and pairs of one key and place in order."""
    by = ["key", "ord"] if db.duplicates else ["key"]
    return db.rows.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1")

"""Helpers shared by the training-data operators.

Row-wise operators follow one convention: they return every input column plus
their own; an input column that bears the name of an output column is replaced.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of an Arrow batch handed to Python; texts may be long, so batches are short.
BATCH_ROWS = 500
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in rows and bytes, so that a worker holds little text at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one set here where it is unset (tests on one machine)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/keystrand/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of tables made by ``materialize`` that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def map_batches(
    df: DataFrame,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, object]]],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Add (or replace) the columns ``fields``, computed per Arrow batch.

    ``make`` runs once in each task and returns the function that maps a batch to
    its new columns; a function may return the key ``_keep`` with row indices to
    keep some rows only.
    """
    bounded_batches(df.sparkSession)
    names = {f.name for f in fields} | set(drop)
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType(kept + fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            new = fn(batch)
            rows = new.pop("_keep", None)
            old = batch.select([f.name for f in kept])
            if rows is not None:
                old = old.take(pa.array(rows, pa.int64()))
            columns = [old.column(i).cast(arrow.field(i).type) for i in range(len(kept))]
            columns += [pa.array(new[f.name], arrow.field(f.name).type) for f in fields]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def shielded(docs: DataFrame, names: list[str]) -> tuple[DataFrame, Callable[[str], Column]]:
    """``docs`` with its columns that bear one of the names set aside, and a function that gives an input column back by its own name."""
    taken = {n.lower() for n in names}
    there = {c.lower() for c in docs.columns}
    aside = {}
    for c in docs.columns:
        if c.lower() in taken:
            new = f"_own_{c}"
            while new.lower() in there | taken:
                new = "_" + new
            there.add(new.lower())
            aside[c] = new
    return docs.withColumnsRenamed(aside), lambda c: F.col(f"`{aside.get(c, c)}`").alias(c)


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast a value of bounded size; the function returned gives it back in a task."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def text_of(column: str = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def training_rows() -> Column:
    """Rows whose labels may be learned from: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0


def held_out() -> Column:
    """The other rows, as a column held_out; a row without an id isn't one of the training rows."""
    return F.coalesce(~training_rows(), F.lit(True)).alias("held_out")

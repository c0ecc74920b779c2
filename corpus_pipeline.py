"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keystrand.llm.common import materialize, table
from keystrand.llm.decontaminate import decontamination_stage
from keystrand.llm.near_dedup import dedup_stage
from keystrand.llm.packing import packing_stage
from keystrand.llm.pii import pii_stage
from keystrand.llm.quality_classifier import quality_stage

#: Each function takes (spark, docs, sf_dir); its result, written as Parquet, is the next one's docs.
STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicate removal", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("packing", packing_stage),
]

#: A trained classifier and a tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

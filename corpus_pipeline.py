"""Documents to packed sequences: quality rules, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from longview.llm.decontam import decontamination_stage
from longview.llm.lines import lines_stage
from longview.llm.packing import packing_stage
from longview.llm.quality import quality_stage
from longview.llm.simhash import dedup_stage
from longview.session import ensure_checkpoint_dir

STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", lines_stage),
    ("simhash_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: Robust estimates, fingerprints and best-fit packing are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over all documents, each written as Parquet beside the checkpoints and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

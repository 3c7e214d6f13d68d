"""Readers of parquet and text tables."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longview import schemas
from longview.functions import outcome as O
from longview.functions.risk import SCORE_COLUMNS
from longview.functions.text import strip
from longview.operators.clinical import TABLES

# Accepted column names, in order of preference.
PATIENT_COLUMNS = ["PatientID", "patient_id", "pid", "patient"]
LABEL_COLUMNS = ["label", "cancer", "canc_yr", "confirmed", "conflc"]


def read_index(spark: SparkSession, path: str, collection: str = "nlst", min_slices: int = 10) -> DataFrame:
    """CT series of a collection; the filters and the twelve columns reach the scan."""
    raw = spark.read.parquet(path)
    rows = raw.filter((F.col("collection_id") == collection) & (F.col("Modality") == "CT") & (F.col("instanceCount") >= min_slices))
    return rows.select(*[F.col(a).alias(b) for a, b in schemas.INDEX_NAMES.items()])


def read_index_all(spark: SparkSession, path: str) -> DataFrame:
    """The whole index, for joins with a manifest."""
    return spark.read.parquet(path).select(*[F.col(a).alias(b) for a, b in schemas.INDEX_NAMES.items()])


def read_clinical(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One clinical table from all its parquet parts; pid is trimmed text."""
    if name not in TABLES:
        raise ValueError(f"unknown clinical table {name!r}; expected one of {TABLES}")
    raw = spark.read.option("mergeSchema", "true").parquet(f"{directory.rstrip('/')}/{name}")
    return raw.withColumn("pid", strip(F.col("pid").cast("string"))) if "pid" in raw.columns else raw


def is_parquet(path: str) -> bool:
    return posixpath.splitext(path.rstrip("/"))[1].lower() in (".parquet", ".pq")


def read_scores(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """Score table by suffix, required columns checked."""
    raw = spark.read.parquet(path) if is_parquet(path) else spark.read.csv(path, header=True, inferSchema=False)
    named = raw.withColumnRenamed("PatientID", "patient_id")
    missing = [c for c in required or ["patient_id", *SCORE_COLUMNS] if c not in named.columns]
    if missing:
        raise ValueError(f"{path} is missing column(s): {missing}")
    scores = [F.col(c).cast("double").alias(c) for c in SCORE_COLUMNS if c in named.columns]
    return named.select(F.col("patient_id").cast("string").alias("patient_id"), *scores)


def first_column(columns: list[str], candidates: list[str]) -> str | None:
    """The first candidate present, ignoring case; among equals the last column."""
    lowered = {c.lower(): c for c in columns}
    return next((lowered[c.lower()] for c in candidates if c.lower() in lowered), None)


def canonical_labels(raw: DataFrame, source: str, order: list[str], year_coded: bool = False) -> DataFrame:
    """Any label table as (patient_id, label, label_source); first row per patient.

    Without a label column the table lists positives.
    """
    patient = first_column(raw.columns, PATIENT_COLUMNS)
    if patient is None:
        raise ValueError(f"no patient column among {raw.columns}; looked for {PATIENT_COLUMNS}")
    label = first_column(raw.columns, LABEL_COLUMNS)
    value = F.lit(O.POSITIVE) if label is None else O.coerce_label(F.col(label), year_coded)
    rows = raw.select(strip(F.col(patient).cast("string")).alias("patient_id"), value.alias("label"), F.struct(*order).alias("_order"))
    return rows.groupBy("patient_id").agg(F.min_by("label", "_order").alias("label")).withColumn("label_source", F.lit(source))


def read_label_file(spark: SparkSession, path: str, source: str | None = None, year_coded: bool = False) -> DataFrame:
    """A CSV, TSV or Parquet label file (S4). The source may come from its name."""
    suffix = posixpath.splitext(path.rstrip("/"))[1].lower()
    if is_parquet(path):
        raw = spark.read.parquet(path)
    else:
        raw = spark.read.csv(path, header=True, inferSchema=False, sep="\t" if suffix in (".tsv", ".tab") else ",")
    stem = posixpath.splitext(posixpath.basename(path.rstrip("/")))[0].lower()
    found = source or next((s for s in O.SOURCE_PRIORITY if s in stem), "manual")
    # File order: file, split offset, then the reader's own row order inside the split.
    placed = raw.withColumns({"_f": F.col("_metadata.file_path"), "_b": F.col("_metadata.file_block_start"),
                              "_n": F.monotonically_increasing_id()})
    return canonical_labels(placed, found, ["_f", "_b", "_n"], year_coded)


def read_slices(spark: SparkSession, path: str) -> DataFrame:
    """Decoded slices as a parquet table of the declared schema."""
    return spark.read.schema(schemas.SLICES).parquet(path)

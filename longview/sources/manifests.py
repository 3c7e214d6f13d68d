"""Download manifests: header and copy lines, uuids, join with the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: where a copy line carries the series uuid.
UUID_PATTERN = r"s3://[^/]+/([0-9a-f-]{36})/"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a manifest with their place: line_no.

    ``line_no`` is (file, block start, row order inside the block) and sorts as
    the lines stand, whatever order the reader plans the files in.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(place.alias("line_no"), F.col("value").alias("line"))


def classify_lines(lines: DataFrame) -> DataFrame:
    """Header and copy lines; anything else is dropped (S2). Adds kind and uuid (S3)."""
    header, copy = F.col("line").startswith("#"), F.col("line").contains("s3://")
    uuid = F.regexp_extract("line", UUID_PATTERN, 1)
    return lines.withColumn("kind", F.when(header, "header").when(copy, "copy")).filter(F.col("kind").isNotNull()).withColumn(
        "crdc_series_uuid", F.when((F.col("kind") == "copy") & (uuid != ""), uuid))


def unreadable_lines(classified: DataFrame) -> DataFrame:
    """Copy lines without a uuid, kept apart instead of failing the job."""
    return classified.filter("kind = 'copy' and crdc_series_uuid is null")


def lookup_series(classified: DataFrame, index: DataFrame, keep_unmatched: bool = True) -> DataFrame:
    """Copy lines with their index row, in manifest order.

    Left keeps every line; inner builds a cohort.
    """
    lines = classified.filter("crdc_series_uuid is not null").drop("kind")
    return lines.join(index, "crdc_series_uuid", "left" if keep_unmatched else "inner")

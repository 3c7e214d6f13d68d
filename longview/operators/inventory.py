"""Queries over a bounded cache of series (A30, P10, ST4-ST6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import OrderedScan


def cache_status(entries: DataFrame, cap_bytes: int) -> DataFrame:
    """Series, bytes and used share of each cache."""
    return entries.groupBy("cache_root").agg(F.count(F.lit(1)).alias("series"), F.sum("bytes").alias("bytes")).withColumns(
        {"cap_bytes": F.lit(cap_bytes), "used_fraction": F.col("bytes") / F.lit(float(cap_bytes)) if cap_bytes else F.lit(0.0)})


def eviction_plan(entries: DataFrame, incoming_bytes: int, cap_bytes: int) -> DataFrame:
    """Least recently used series to drop so that the incoming one fits (ST4).

    A victim is a series before which too little has been freed. One cache may
    hold most series, so the freed bytes come from an ordered scan. More than
    the cap coming in empties the cache.
    """
    slim = entries.select("cache_root", "last_used", "series_uid", "bytes")
    if incoming_bytes > cap_bytes:
        return slim
    scan = OrderedScan(slim, ["cache_root"], ["last_used", "series_uid"])
    need = scan.df.groupBy("cache_root").agg((F.sum("bytes") + F.lit(incoming_bytes) - F.lit(cap_bytes)).alias("needed")).filter("needed > 0")
    ran = scan.running(freed=F.col("bytes")).result()
    return ran.join(need, "cache_root").filter(F.col("freed") - F.col("bytes") < F.col("needed")).select(*slim.columns)


def incomplete_series(expected: DataFrame, slices: DataFrame) -> DataFrame:
    """Series with fewer slices than the index promised, or none (P10, ST5)."""
    found = slices.groupBy("series_uid").agg(F.count(F.lit(1)).alias("found"))
    out = expected.select("series_uid", "instance_count").join(found, "series_uid", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return out.filter((F.col("found") == 0) | (F.col("found") < F.col("instance_count")))


def complete_entries(listing: DataFrame) -> DataFrame:
    """Directories that hold slices and are not interrupted downloads (ST5)."""
    return listing.filter(~F.col("series_uid").endswith(".partial") & (F.col("files") > 0))

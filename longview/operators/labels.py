"""Label tables of different trust."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longview.functions.outcome import UNKNOWN, source_rank


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first in ``order`` (P1); combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(key).agg(best.alias("_first")).select(key, "_first.*")


def merge_labels(cohort: DataFrame, *tables: DataFrame) -> DataFrame:
    """The label of every cohort patient, most trusted source first.

    Rows outside the cohort are dropped; patients in no table are unknown. An
    unknown from a trusted source gives way to a known label of any other.
    """
    patients = cohort.select("patient_id").distinct()
    if not tables:
        return patients.withColumns({"label": F.lit(UNKNOWN), "label_source": F.lit("none")})
    ranked = [t.select("patient_id", F.col("label").cast("int").alias("label"), "label_source",
                       source_rank(F.col("label_source")).alias("_rank"), F.lit(i).alias("_table"))
              for i, t in enumerate(tables)]
    rows = reduce(DataFrame.unionByName, ranked)
    value = F.struct("label", "label_source")
    merged = rows.groupBy("patient_id").agg(
        F.min_by(F.when(F.col("label") != UNKNOWN, value),
                 F.when(F.col("label") != UNKNOWN, F.struct("_rank", "_table", "label", "label_source"))).alias("_known"),
        F.max_by(value, F.struct("_rank", "_table", "label", "label_source")).alias("_last"))
    chosen = F.coalesce("_known", "_last")
    picked = merged.select("patient_id", chosen["label"].alias("label"), chosen["label_source"].alias("label_source"))
    return attach_labels(patients, picked)


def attach_labels(cohort: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join with unknown / none for patients without a label."""
    out = cohort.join(labels.select("patient_id", "label", "label_source"), "patient_id", "left")
    return out.withColumns({"label": F.coalesce("label", F.lit(UNKNOWN)).cast("int"),
                            "label_source": F.coalesce("label_source", F.lit("none"))})


def restrict_to_cohort(outcomes: DataFrame, cohort: DataFrame) -> DataFrame:
    """Outcomes of cohort patients only."""
    return outcomes.join(cohort.select("patient_id"), "patient_id", "left_semi").filter(F.col("label").isNotNull())


def known_only(df: DataFrame) -> DataFrame:
    """Drop unknown labels, never recode them."""
    return df.filter(F.col("label") >= 0)


def label_summary(labels: DataFrame) -> DataFrame:
    """Positive, negative and unknown counts and the rate among known (A4)."""
    pos, neg = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return labels.agg(F.count(F.lit(1)).alias("patients"), pos.alias("positive"), neg.alias("negative"),
                      F.count_if(F.col("label") == UNKNOWN).alias("unknown")).withColumn(
        "positive_rate", F.col("positive") / F.nullif(F.col("positive") + F.col("negative"), F.lit(0)))


def source_counts(labels: DataFrame) -> DataFrame:
    """Patients by label source (A4)."""
    return labels.groupBy("label_source").agg(F.count(F.lit(1)).alias("patients"))

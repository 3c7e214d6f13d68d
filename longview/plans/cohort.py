"""Cohort, splits and viewer bundle (R-A, R-B, R-D, F22)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longview.functions import descriptor as D
from longview.functions.hashing import DEFAULT_FRACTIONS, DEFAULT_SEED, assign_split
from longview.functions.text import half_even
from longview.operators import cohort as C
from longview.operators.labels import merge_labels
from longview.operators.splits import hash_split, stratified_split, with_split
from longview.session import cut


def build_cohort(index: DataFrame, min_slices: int = 10, max_patients: int | None = None) -> DataFrame:
    """Index to series table: usable, annotated, axial, one primary per round (R-A)."""
    # The axial filter runs on the raw text: filtering on the parsed column would parse twice.
    # Stored, as it is read for the choice and for the rows: the index is joined and parsed once.
    series = cut(C.annotate(C.usable(index, "CT", min_slices).filter(D.describes_axial(F.col("series_description")))))
    return C.select_primary(series if max_patients is None else C.first_patients(series, max_patients))


def build_splits(series: DataFrame, *label_tables: DataFrame, seed: str = DEFAULT_SEED,
                 fractions: Sequence[float] = DEFAULT_FRACTIONS, stratify: bool = False) -> DataFrame:
    """Series and labels to one split row per patient (R-B).

    Counts and the label merge are both keyed by patient, so they share one
    partitioning. Run ``splits.verify`` on the written table.
    """
    patients = C.rounds_per_patient(series)
    labels = merge_labels(patients, *label_tables)
    rows = patients.join(labels, "patient_id")
    split = stratified_split(rows, "label", seed, fractions) if stratify else hash_split(rows, seed, fractions)
    return split.select("patient_id", "split", "label", "label_source", "n_rounds", "n_series", "split_mode", "split_seed")


def viewer_meta(volumes: DataFrame, mask_voxels: Column | None = None, splits: DataFrame | None = None) -> DataFrame:
    """Volume headers as viewer entries.

    ``volumes`` has patient, study_date, study_year, round, kernel, series_uid,
    depth, rows, cols, spacing_z/y/x, hu_min, hu_max and head_first. The split
    comes from ``splits`` where that table is given.
    """
    if splits is not None:
        declared = splits.select(F.col("patient_id").cast("string").alias("patient"), F.col("split").alias("_declared"))
        volumes = volumes.join(declared, "patient", "left")
    slug = D.series_slug(F.col("patient"), F.col("study_date"), F.col("kernel"), F.col("series_uid"))
    fields = {
        "id": slug, "study_date": D.dashed_date(F.col("study_date")), "visit": F.col("study_year"),
        "kernel": F.coalesce("kernel", F.lit("")), "kernel_style": D.kernel_style(F.col("kernel")),
        "spacing": F.transform(F.array("spacing_z", "spacing_y", "spacing_x"), lambda s: half_even(s, 6)),
        "shape": F.array("depth", "rows", "cols"), "hu_range": F.array("hu_min", "hu_max"),
        "file": F.concat(slug, F.lit("/hu")),
        "split": F.when(F.length("patient") > 0, assign_split(F.col("patient")) if splits is None else F.col("_declared")),
    }
    if mask_voxels is not None:
        voxel_ml = F.col("spacing_z") * F.col("spacing_y") * F.col("spacing_x") / 1000.0
        fields["lung_volume_ml"] = half_even(mask_voxels * voxel_ml, 1)
        fields["mask_file"] = F.concat(slug, F.lit("/lung"))
    keep = ["patient", "round", "series_uid", F.coalesce("head_first", F.lit(False)).alias("head_first")]
    return volumes.select(*keep, *[c.alias(n) for n, c in fields.items()])


def patient_bundle(series: DataFrame, seed: str = DEFAULT_SEED, splits: DataFrame | None = None) -> DataFrame:
    """Per patient what an export writes beside the index (R-D).

    Rounds are gathered from primary series, one per round.
    """
    return with_split(C.primary_only(series).groupBy("patient_id").agg(
        F.array_sort(F.collect_set("round")).alias("rounds"), F.count(F.lit(1)).alias("n_series"),
        F.sum("series_size_mb").alias("mb")), splits, seed)

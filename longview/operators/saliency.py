"""Overlays a reader can colour: attention and change."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bits
from .slices import profile, quantise_volumes, resample_nearest, resample_profile, sum_px, top_slices, zoom_linear

# The change scale and profile floors.
CHANGE_RANGE = (100.0, 800.0)
ATTENTION_FLOOR, CHANGE_FLOOR = 1e-9, 1e-6


def attention_overlay(attention: DataFrame, shapes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Attention on the viewer's grid: (byte slices, profile, top slices).

    ``shapes`` has volume_id, out_depth, out_rows, out_cols.
    """
    on_grid = zoom_linear(attention.join(shapes, "volume_id"))
    prof = profile(on_grid, "px", ATTENTION_FLOOR)
    return quantise_volumes(on_grid, "px"), prof, top_slices(prof)


def positive_change(delta: DataFrame, masks: DataFrame | None = None, mask: str = "interior") -> DataFrame:
    """Densification only, confined to the mask."""
    up = lambda v: F.greatest(v.cast("double"), F.lit(0.0))
    if masks is None:
        return delta.withColumn("px", F.transform("delta", up))
    joined = delta.join(masks.select("volume_id", "z", F.col(mask).alias("_m")), ["volume_id", "z"])
    return joined.withColumn("px", F.zip_with("delta", "_m", lambda v, m: F.when(m != 0, up(v)).otherwise(0.0))).drop("_m")


def change_overlay(delta: DataFrame, masks: DataFrame | None = None, mask: str = "interior",
                   hu_range: tuple[float, float] = CHANGE_RANGE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Change on a fixed scale: (byte slices, profile, top slices).

    A fixed scale gives equal colours equal meaning across patients.
    """
    up = positive_change(delta, masks, mask).select("volume_id", "z", "depth", "rows", "cols", "px")
    prof = profile(up, "px", CHANGE_FLOOR)
    return quantise_volumes(up, "px", *hu_range), prof, top_slices(prof)


def pair_change(pairs: DataFrame, shift: DataFrame | None = None) -> DataFrame:
    """Densification of aligned pairs inside the mask their regions are found in: slices with ``px``.

    ``pairs`` are packed slices with baseline, followup and interior. The breath-depth ``shift`` of each pair is taken off if given;
    the reference picture leaves it in.
    """

    @F.pandas_udf("array<double>")
    def risen(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for series in parts:
            made = []
            for a, b, m, h, w, off in zip(*series):
                up = np.maximum(bits.plane(b, h, w).astype(np.float64) - bits.plane(a, h, w) - off, 0.0)
                made.append(np.where(bits.plane(m, h, w), up, 0.0).ravel())
            yield pd.Series(made, dtype=object)

    off = F.lit(0.0)
    if shift is not None:
        pairs, off = pairs.join(shift.select("volume_id", F.col("shift_hu").alias("_off")), "volume_id"), F.col("_off")
    return pairs.select("volume_id", "z", "depth", "rows", "cols", risen("baseline", "followup", "interior", "rows", "cols", off).alias("px"))


def pair_overlay(pairs: DataFrame, shift: DataFrame | None = None, hu_range: tuple[float, float] = CHANGE_RANGE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``change_overlay`` of aligned pairs."""
    up = pair_change(pairs, shift)
    prof = profile(up, "px", CHANGE_FLOOR)
    return quantise_volumes(up, "px", *hu_range), prof, top_slices(prof)


def overlay_on_grid(levels: DataFrame, prof: DataFrame, shapes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An overlay on another grid: nearest bytes, linear profile.

    The profile is interpolated, not recomputed: saturated bytes would tie.
    """
    sized = levels.join(shapes, "volume_id")
    bytes_ = resample_nearest(sized.select("volume_id", "z", "depth", "rows", "cols", "out_depth", "out_rows", "out_cols",
                                           F.col("level").alias("px")))
    depth = levels.groupBy("volume_id").agg(F.max("depth").alias("depth")).join(shapes, "volume_id")
    moved = resample_profile(prof.join(depth, "volume_id"), "share")
    peak = moved.groupBy("volume_id").agg(F.max("share").alias("_peak"))
    out = moved.join(peak, "volume_id").select("volume_id", "z", F.col("share").alias("total"),
                                               (F.col("share") / F.greatest("_peak", F.lit(CHANGE_FLOOR))).alias("share"))
    return bytes_, out, top_slices(out)


def enrichment(attention: DataFrame, masks: DataFrame) -> DataFrame:
    """Share of attention inside the mask over the mask's share of the volume."""
    joined = attention.select("volume_id", "z", "px").join(masks.select("volume_id", "z", "mask"), ["volume_id", "z"])
    inside = F.zip_with("px", "mask", lambda v, m: F.when(m != 0, v.cast("double")).otherwise(0.0))
    sums = joined.select("volume_id", sum_px(inside).alias("i"), sum_px(F.col("px")).alias("a"),
                         sum_px(F.col("mask")).alias("m"), F.size("px").alias("n")).groupBy("volume_id").agg(
        F.sum("i").alias("i"), F.sum("a").alias("a"), F.sum("m").alias("m"), F.sum("n").alias("n"))
    share, part = F.try_divide("i", "a"), F.try_divide("m", "n")
    return sums.select("volume_id", share.alias("attention_share"), part.alias("mask_share"), F.try_divide(share, part).alias("enrichment"))


def belongs(overlay_patient: Column, overlay_round: Column, patient: Column, round_: Column) -> Column:
    """Whether an overlay describes the scan on screen; unlabelled ones pass."""
    other = (F.length(overlay_patient) > 0) & (F.length(patient) > 0) & (overlay_patient != patient)
    unlabelled = overlay_round.isNull() | (F.length(overlay_round) == 0)
    return ~F.coalesce(other, F.lit(False)) & (unlabelled | F.coalesce(overlay_round == round_, F.lit(False)))


def matches_shape(a: list[Column], b: list[Column]) -> Column:
    """Whether two grids have the same shape."""
    same = F.lit(True)
    for x, y in zip(a, b):
        same = same & F.coalesce(x == y, F.lit(False))
    return same


def overlay_targets(overlays: DataFrame, entries: DataFrame) -> DataFrame:
    """The viewer entry each overlay is fitted to: same patient and round."""
    keys = ["patient_id", "round"]
    return overlays.join(entries.select(*keys, "out_depth", "out_rows", "out_cols"), keys, "left")


def fit_overlays(levels: DataFrame, prof: DataFrame, top: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Overlays on the grids of their viewer entries (J15, X2): (byte slices, profile, top slices).

    ``targets`` has volume_id, out_depth, out_rows, out_cols. An overlay without an entry, or on the entry's grid already, stays.
    """
    own = levels.groupBy("volume_id").agg(*[F.max(c).alias(c) for c in ("depth", "rows", "cols")])
    out = ["out_depth", "out_rows", "out_cols"]
    other = ~matches_shape([F.col("depth"), F.col("rows"), F.col("cols")], [F.col(c) for c in out])
    moving = own.join(targets.select("volume_id", *out), "volume_id").filter(F.col("out_depth").isNotNull() & other).select("volume_id", *out)
    stay = lambda df: df.join(moving.select("volume_id"), "volume_id", "left_anti")
    slices, shares, best = overlay_on_grid(levels.select("volume_id", "z", "depth", "rows", "cols", "level"), prof, moving)
    kept = stay(levels).select("volume_id", "z", "depth", "rows", "cols", "level")
    return (kept.unionByName(slices.withColumnRenamed("px", "level")), stay(prof).select("volume_id", "z", "total", "share").unionByName(shares),
            stay(top).unionByName(best))

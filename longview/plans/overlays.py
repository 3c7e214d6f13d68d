"""Change overlays of compared pairs, on the grids the viewer shows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longview.operators.change import Comparison
from longview.operators.saliency import fit_overlays, overlay_targets, pair_overlay


class Overlays(NamedTuple):
    """Byte slices (volume_id, z, depth, rows, cols, level), a profile row a slice, and each overlay's top slices."""

    slices: DataFrame
    profile: DataFrame
    top: DataFrame


def overlay_path(from_round: Column, to_round: Column) -> Column:
    """Where a pair's overlay is kept."""
    return F.concat(F.lit("overlays/change_"), from_round, F.lit("_"), to_round)


def change_overlays(compared: Comparison, pairs: DataFrame, entries: DataFrame, subtract_shift: bool = False) -> Overlays:
    """The overlay of every compared pair, from its aligned difference inside the mask its regions were found in.

    ``pairs`` has volume_id, patient_id and from_round: a change map lives in the geometry of the earlier round, so it is fitted
    to the viewer entry (patient_id, round, out_depth, out_rows, out_cols) of that round where there is one. ``subtract_shift``
    also takes off the breath-depth shift, as the regions do; by default the overlay shows it.
    """
    levels, profile, top = pair_overlay(compared.slices, compared.shift if subtract_shift else None)
    wanted = overlay_targets(pairs.select("volume_id", "patient_id", F.col("from_round").alias("round")), entries)
    return Overlays(*fit_overlays(levels, profile, top, wanted))

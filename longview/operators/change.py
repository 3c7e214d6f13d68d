"""Change between consecutive rounds: alignment, difference, regions.

Inputs are slice tables on one grid, keyed by the pair in ``volume_id``: the
earlier and the later round (px) and masks (mask). Every step covers all pairs.
Inside, slices travel packed (``bits``); an aligned pair is one table with both
rounds and the eroded mask in the slice's row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from longview.functions import voxel as V
from longview.functions.narrative import FAILED_NOTE
from longview.functions.text import half_even
from longview.session import cut

from . import bits
from .align import FILL_HU, move_errors, moved, search_moves
from .blocks import BLOCK, GAUSS_RADIUS, Part, core, erode, gaussian_stack, over_blocks, slab_runs, with_block
from .components import global_labels, lung_mask
from .slices import mask_volume_ml, resample_isotropic

# What counts as a region of change.
REGISTRATION_MM = 1.5
MIN_HU_DELTA = 200.0
BASELINE_AIR_HU = -500.0
FOLLOWUP_TISSUE_HU = -600.0
MIN_FILL_FRACTION = 0.30
MAX_ELONGATION = 3.0
NEW_BELOW_HU = -800.0


def difference(baseline: DataFrame, warped: DataFrame) -> DataFrame:
    """Later minus earlier, slice by slice (J13): one row per slice is joined, not per voxel."""
    later = warped.select("volume_id", "z", F.col("px").alias("_w"))
    return baseline.join(later, ["volume_id", "z"]).withColumn("delta", F.zip_with("_w", "px", lambda b, a: b - a)).withColumnRenamed(
        "px", "baseline").withColumnRenamed("_w", "followup")


def onto_grid(later: DataFrame, baseline: DataFrame) -> DataFrame:
    """The later round on the baseline's voxel grid; what it does not cover is air. Packed if it came packed."""

    @F.pandas_udf("binary")
    def fitted(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for series in parts:
            made = []
            for data, h, w, rows, cols in zip(*series):
                if data is not None and (h, w) == (rows, cols):
                    made.append(data)
                    continue
                out = np.full((rows, cols), FILL_HU)
                if data is not None:
                    a = bits.plane(data, int(h), int(w))[:rows, :cols]
                    out = out.astype(a.dtype) if a.dtype.kind == "f" else out
                    out[:a.shape[0], :a.shape[1]] = a
                made.append(bits.pixel_bytes(out))
            yield pd.Series(made, dtype=object)

    grid = baseline.select("volume_id", "z", "depth", "rows", "cols")
    own = bits.with_packed_pixels(later.select("volume_id", "z", F.col("rows").alias("_r"), F.col("cols").alias("_c"), F.col("px").alias("_px")), "_px")
    out = grid.join(own, ["volume_id", "z"], "left").withColumn("px", fitted("_px", "_r", "_c", "rows", "cols")).drop("_r", "_c", "_px")
    if bits.is_packed(later, "px"):
        return out
    kind = later.schema["px"].dataType.elementType.simpleString()
    return out.withColumn("px", bits.pixels(F.col("px"), F.col("rows"), F.col("cols"), "double" if kind in ("double", "float") else "int"))


def masked(px: Column, mask: Column) -> Column:
    """Values under a 0/1 mask of the same slice."""
    pairs = F.filter(F.zip_with(px, mask, lambda v, m: F.when(m != 0, v)), lambda v: v.isNotNull())
    return pairs


def _masked_error(a: Column, b: Column, mask: Column) -> tuple[Column, Column]:
    diff = F.zip_with(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), mask, lambda d, m: F.when(m != 0, d).otherwise(0.0))
    return F.aggregate(diff, F.lit(0.0), lambda s, v: s + v), F.aggregate(mask, F.lit(0), lambda s, m: s + F.when(m != 0, 1).otherwise(0))


def alignment_error(baseline: DataFrame, stages: DataFrame, masks: DataFrame) -> DataFrame:
    """Mean absolute difference under the mask per stage (A24); null when the mask is empty."""
    fixed = baseline.select("volume_id", "z", F.col("px").alias("_a")).join(
        masks.select("volume_id", "z", "mask"), ["volume_id", "z"])
    err, n = _masked_error(F.col("_a"), F.col("px"), F.col("mask"))
    per_slice = stages.select("volume_id", "z", "stage", "stage_order", "px").join(fixed, ["volume_id", "z"]).select(
        "volume_id", "stage", "stage_order", err.alias("_e"), n.alias("_n"))
    return per_slice.groupBy("volume_id", "stage", "stage_order").agg(F.sum("_e").alias("_e"), F.sum("_n").alias("_n")).select(
        "volume_id", "stage", "stage_order", F.try_divide("_e", "_n").alias("error_hu"))


def best_stage(errors: DataFrame) -> DataFrame:
    """The stage with the least error; a tie keeps the earlier one, 'none' first."""
    return errors.groupBy("volume_id").agg(
        F.min_by("stage", F.struct(F.coalesce("error_hu", F.lit(float("inf"))).alias("e"), F.col("stage_order"))).alias("selected_stage"),
        F.min("error_hu").alias("alignment_after_hu"),
        F.max(F.when(F.col("stage") == "none", F.col("error_hu"))).alias("alignment_before_hu"),
        # One entry per candidate of the search.
        F.array_sort(F.collect_list(F.struct("stage_order", "stage", "error_hu"))).alias("alignment_by_stage_hu"))


def best_move(errors: DataFrame) -> DataFrame:
    """``best_stage`` and the move (dz, dy, dx) it stands for."""
    move = errors.groupBy("volume_id").agg(F.min_by(F.struct("dz", "dy", "dx"), F.struct(
        F.coalesce("error_hu", F.lit(float("inf"))).alias("e"), F.col("stage_order"))).alias("_m")).select("volume_id", "_m.*")
    return best_stage(errors).join(move, "volume_id")


def value_counts(px: Column, mask: Column) -> Column:
    """Distinct values under a slice's mask with how often each occurs."""

    @F.pandas_udf("array<struct<v:double,n:bigint>>")
    def counted(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for values, masks in parts:
            yield pd.Series([_counts(np.asarray(a)[np.asarray(m) != 0]) for a, m in zip(values, masks)], dtype=object)

    return counted(px, mask)


def _counts(values: np.ndarray) -> list[dict]:
    return [{"v": float(v), "n": int(n)} for v, n in zip(*np.unique(values, return_counts=True))]


def _median(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """Median of counted values (volume_id, counts) per pair of ``pairs``, 0 where there are none."""
    each = values.select("volume_id", F.explode("counts").alias("_v")).select("volume_id", "_v.v", "_v.n")
    counts = each.groupBy("volume_id", "v").agg(F.sum("n").alias("n"))
    medians = counts.groupBy("volume_id").agg(F.percentile("v", F.lit(0.5), F.col("n")).alias("_m"))
    return pairs.select("volume_id").distinct().join(medians, "volume_id", "left").select(
        "volume_id", F.coalesce("_m", F.lit(0.0)).alias("shift_hu"))


def inflation_shift(delta: DataFrame, masks: DataFrame, mask: str = "interior") -> DataFrame:
    """Median difference under the mask, 0 when it is empty.

    Values are counted inside the slice row; HU differences take a few thousand
    distinct values, so the exact median reads a small table per pair.
    """
    joined = delta.select("volume_id", "z", "delta").join(masks.select("volume_id", "z", mask), ["volume_id", "z"])
    return _median(joined.select("volume_id", value_counts(F.col("delta"), F.col(mask)).alias("counts")), masks)


def pair_shift(compared: DataFrame) -> DataFrame:
    """``inflation_shift`` of packed pairs (see ``aligned_pairs``)."""

    @F.pandas_udf("array<struct<v:double,n:bigint>>")
    def counted(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for series in parts:
            made = []
            for a, b, m, h, w in zip(*series):
                inside = bits.plane(m, h, w)
                made.append(_counts(bits.plane(b, h, w)[inside].astype(np.int64) - bits.plane(a, h, w)[inside]))
            yield pd.Series(made, dtype=object)

    counts = counted("baseline", "followup", "interior", "rows", "cols")
    return _median(compared.select("volume_id", counts.alias("counts")), compared)


def aligned_pairs(baseline: DataFrame, later: DataFrame, best: DataFrame, interior: DataFrame) -> DataFrame:
    """Both rounds and the eroded mask in one row a slice, all packed: baseline, followup, interior.

    The later round is moved by its pair's selected move (dz, dy, dx of ``best``); no other candidate is built, and what it does
    not cover is air.
    """
    sent = later.join(best.select("volume_id", "dz", "dy", "dx"), "volume_id").select(
        "volume_id", (F.col("z") + F.col("dz")).cast("int").alias("z"), moved(F.col("px"), F.col("rows"), F.col("cols"), F.col("dy"), F.col("dx")).alias("_px"))
    own = core(baseline, F.col("px").alias("baseline")).join(interior.select("volume_id", "z", "interior"), ["volume_id", "z"])
    return own.join(sent, ["volume_id", "z"], "left").withColumn(
        "followup", F.coalesce("_px", air(F.col("rows"), F.col("cols")))).drop("_px")


def air(rows: Column, cols: Column) -> Column:
    """A packed slice of air."""
    return F.concat(F.lit(b"h"), F.unhex(F.repeat(F.lit(np.dtype("<i2").type(FILL_HU).tobytes().hex()), (rows * cols).cast("int"))))


def unpacked(compared: DataFrame, mask: bool = False) -> DataFrame:
    """Slices with baseline, followup and delta as pixel arrays; the interior too if asked."""
    shape = F.col("rows"), F.col("cols")
    out = compared.select("volume_id", "z", "depth", "rows", "cols", *[bits.pixels(F.col(c), *shape).alias(c) for c in ("baseline", "followup", *["interior"] * mask)])
    return out.withColumn("delta", F.zip_with("followup", "baseline", lambda b, a: b - a))


# Sums of a run and, on the first run of a slab component, how often each baseline value occurs in it.
_RUN = {"z": "int", "y": "int", "x0": "int", "x1": "int", "comp": "bigint", "shared": "boolean", "width": "int", "n": "bigint", "sum_s": "double", "max_s": "double", "abs_s": "double",
        "sum_b": "double", "sum_f": "double", "values": "array<double>", "counts": "array<bigint>"}


def _hot_runs(slices: DataFrame, min_hu_delta: float, max_voxels: float, block: int) -> DataFrame:
    """Runs of smoothed change above the threshold inside the mask, with their sums: one pass over the blocks (X9, X10, part of X11).

    ``slices`` are packed: baseline, followup, interior, and delta or the shift_hu to take off the difference. Pixels end here.
    Baseline values are counted only for slab components that are not too large already.
    """
    given = "delta" in slices.columns

    def run(part: Part) -> tuple[np.ndarray, dict]:
        zs, rows, cols, at, of = part["z"], part.rows, part.cols, part["block"], part.of
        base, follow = (bits.stack(part[c], rows, cols) for c in ("baseline", "followup"))
        delta = bits.stack(part["delta"], rows, cols) if given else follow.astype(np.float64) - base - part["shift_hu"][:, None, None]
        smoothed = gaussian_stack(delta, zs, part["depth"], of)
        keep = (zs >= at * block) & (zs <= (at + 1) * block)  # the slice above is shared with the next block
        hot = (smoothed > min_hu_delta) & bits.stack(part["interior"], rows, cols) & keep[:, None, None]
        smoothed, base, follow = smoothed[hot], base[hot], follow[hot]
        apart, places, _ = part.gapped(hot)
        z, y, x0, x1, first = slab_runs(apart)
        z = np.searchsorted(places, z)
        n = x1 - x0 + 1
        starts = np.cumsum(n) - n
        total = lambda v: np.add.reduceat(v.astype(np.float64), starts) if len(starts) else np.empty(0)
        shared = zs[z] // block != at[z]
        voxel = (zs[z].astype(np.int64) * rows + y) * cols + x0
        values, counts = [None] * len(n), [None] * len(n)
        own = np.repeat(~shared, n)
        comp, value = np.repeat(first, n)[own], base[own].astype(np.float64)
        order = np.lexsort((value, comp))
        comp, value = comp[order], value[order]
        # Where a distinct value of a component starts, and which of these each component has.
        new = np.flatnonzero(np.r_[True, (comp[1:] != comp[:-1]) | (value[1:] != value[:-1])]) if len(comp) else np.empty(0, np.int64)
        often, many = np.diff(np.r_[new, len(comp)]), np.bincount(comp)
        for a, b in zip(*_spans(comp[new])):
            if many[comp[new[a]]] <= max_voxels:
                values[comp[new[a]]], counts[comp[new[a]]] = value[new[a:b]].tolist(), often[a:b].tolist()
        return of[z], {"z": zs[z], "y": y, "x0": x0, "x1": x1, "comp": voxel[first], "shared": shared, "width": np.full(len(n), cols), "n": n, "sum_s": total(smoothed),
                       "max_s": np.maximum.reduceat(smoothed, starts) if len(starts) else np.empty(0), "abs_s": total(np.abs(smoothed)),
                       "sum_b": total(base), "sum_f": total(follow), "values": values, "counts": counts}

    return over_blocks(with_block(slices, GAUSS_RADIUS, GAUSS_RADIUS + 1, block), run, _RUN)


def _spans(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values starts and ends."""
    if not len(of):
        return of, of
    edges = np.flatnonzero(of[1:] != of[:-1]) + 1
    return np.r_[0, edges], np.r_[edges, len(of)]


def percentile_of_counts(parts: Column, share: float) -> Column:
    """A percentile, interpolated, over an array of (values, counts) tables that are merged first."""

    @F.pandas_udf("double")
    def taken(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in series:
            made = []
            for own in lists:
                value, n = (np.concatenate([np.asarray(p[f]) for p in own]) for f in ("values", "counts"))
                order = np.argsort(value, kind="stable")
                value, upto = value[order], np.cumsum(n[order])
                at = share * (upto[-1] - 1)
                low, high = (value[np.searchsorted(upto, k, side="right")] for k in (np.floor(at), np.ceil(at)))
                made.append(low + (high - low) * (at - np.floor(at)))
            yield pd.Series(made, dtype="float64")

    return taken(parts)


def region_features(runs: DataFrame, spacing_mm: float, min_diameter_mm: float = V.MIN_DIAMETER_MM, max_diameter_mm: float = V.MAX_DIAMETER_MM,
                    baseline_air_hu: float = BASELINE_AIR_HU, followup_tissue_hu: float = FOLLOWUP_TISSUE_HU) -> DataFrame:
    """Features of the components that pass the region filters (A26, P8), from runs with their sums; no pixel is read again.

    The 90th percentile comes from counted values, merged only over components that passed size and shape.
    """
    mm3 = spacing_mm ** 3
    n, keys = F.col("n"), ["volume_id", "component"]
    per_slice = runs.groupBy(*keys, "z").agg(
        F.sum("n").alias("n"), F.sum("sum_s").alias("sum_s"), F.max("max_s").alias("max_s"), F.sum("abs_s").alias("abs_s"),
        F.sum("sum_b").alias("sum_b"), F.sum("sum_f").alias("sum_f"), F.max("width").alias("width"),
        F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"),
        F.sum(n * F.col("y")).alias("sy"), F.sum(n * (F.col("x0") + F.col("x1")) / 2.0).alias("sx"),
        F.collect_list(F.when(F.size("values") > 0, F.struct("values", "counts"))).alias("parts"))
    whole = per_slice.groupBy(*keys).agg(
        F.sum("n").cast("bigint").alias("voxels"), F.sum("sum_s").alias("sum_s"), F.max("max_s").alias("peak_delta_hu"),
        F.sum("sum_b").alias("sum_b"), F.sum("sum_f").alias("sum_f"), F.max("width").alias("width"),
        F.sum("sy").alias("sy"), F.sum("sx").alias("sx"), F.sum(n * F.col("z")).alias("sz"),
        F.min("z").alias("z0"), F.min("y0").alias("y0"), F.min("x0").alias("x0"),
        (F.max("z") + 1).alias("z1"), (F.max("y1") + 1).alias("y1"), (F.max("x1") + 1).alias("x1"),
        # First slice of the largest change, as an argmax takes it.
        F.min_by("z", F.struct((-F.col("abs_s")).alias("a"), F.col("z"))).alias("slice"), F.flatten(F.collect_list("parts")).alias("parts"))
    voxels = F.col("voxels")
    box = (F.col("z1") - F.col("z0")) * (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    sides = [(F.col(f"{a}1") - F.col(f"{a}0")) * spacing_mm for a in "zyx"]
    shaped = whole.withColumns({
        "volume_mm3": voxels * mm3, "fill_fraction": voxels / box.cast("double"),
        "elongation": F.greatest(*sides) / F.greatest(F.least(*sides), F.lit(1e-6))}).filter(
        F.col("volume_mm3").between(V.sphere_volume(min_diameter_mm), V.sphere_volume(max_diameter_mm))
        & (F.col("fill_fraction") >= MIN_FILL_FRACTION) & (F.col("elongation") <= MAX_ELONGATION))
    out = shaped.withColumns({
        "p90_baseline_hu": percentile_of_counts(F.col("parts"), 0.9),
        "mean_delta_hu": F.col("sum_s") / voxels, "baseline_hu": F.col("sum_b") / voxels, "followup_hu": F.col("sum_f") / voxels,
        "centroid_z_mm": F.col("sz") / voxels * spacing_mm, "centroid_y_mm": F.col("sy") / voxels * spacing_mm,
        "centroid_x_mm": F.col("sx") / voxels * spacing_mm, "diameter_mm": V.equivalent_diameter(F.col("volume_mm3")),
        "side": V.side(F.col("x0"), F.col("x1"), F.col("width"))}).filter(
        (F.col("p90_baseline_hu") < baseline_air_hu) & (F.col("followup_hu") > followup_tissue_hu))
    return out.withColumn("kind", F.when(F.col("baseline_hu") < NEW_BELOW_HU, "new").otherwise("growth")).drop(
        "parts", "sum_s", "sum_b", "sum_f", "sy", "sx", "sz", "width")


def regions_of(slices: DataFrame, spacing_mm: float, min_hu_delta: float = MIN_HU_DELTA, block: int = BLOCK,
               max_diameter_mm: float = V.MAX_DIAMETER_MM, **limits: float) -> DataFrame:
    """Ranked regions of packed slices (see ``_hot_runs``)."""
    table = cut(_hot_runs(slices, min_hu_delta, V.sphere_volume(max_diameter_mm) / spacing_mm**3, block))
    own = table.filter(~F.col("shared")).join(global_labels(table), ["volume_id", "comp"], "left").withColumn("component", F.coalesce("label", "comp"))
    return rank_regions(region_features(own, spacing_mm, max_diameter_mm=max_diameter_mm, **limits))


def find_regions(values: DataFrame, masks: DataFrame, spacing_mm: float, min_hu_delta: float = MIN_HU_DELTA,
                 block: int = BLOCK, **limits: float) -> DataFrame:
    """Ranked regions of densification.

    ``values`` are slices with delta, baseline and followup; ``masks`` carry interior.
    """
    packed = bits.with_packed_pixels(core(values, "delta", "baseline", "followup"), "delta", "baseline", "followup")
    inside = bits.with_packed_mask(core(masks, "interior"), "interior").select("volume_id", "z", "interior")
    return regions_of(packed.join(inside, ["volume_id", "z"]), spacing_mm, min_hu_delta, block, **limits)


def rank_regions(regions: DataFrame) -> DataFrame:
    """Largest density change first (W7); the size bound keeps a pair's list short."""
    w = W.partitionBy("volume_id").orderBy(F.desc(F.col("mean_delta_hu") * F.col("volume_mm3")), "component")
    return regions.withColumn("rank", F.row_number().over(w))


def report_region(regions: DataFrame) -> DataFrame:
    """Region fields with report digits."""
    one = {c: half_even(F.col(c), 1) for c in ("volume_mm3", "mean_delta_hu", "peak_delta_hu", "baseline_hu", "followup_hu", "elongation",
                                               "centroid_z_mm", "centroid_y_mm", "centroid_x_mm")}
    return regions.withColumns({**one, "delta_mm": half_even(F.col("diameter_mm"), 1), "fill_fraction": half_even(F.col("fill_fraction"), 2)})


def _masks_of_both(baseline: DataFrame, later: DataFrame, threshold: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Lung masks of both rounds from one pass over the two tables together."""
    id_type = baseline.schema["volume_id"].dataType
    core = ["z", "depth", "rows", "cols", "px"]
    tagged = [df.select(F.concat(F.lit(tag), F.col("volume_id").cast("string")).alias("volume_id"), *core)
              for tag, df in (("0", baseline), ("1", later))]
    masks = cut(lung_mask(tagged[0].unionByName(tagged[1]), threshold, block, packed=True))
    own = [masks.filter(F.col("volume_id").startswith(tag)).withColumn("volume_id", F.substr("volume_id", F.lit(2)).cast(id_type)) for tag in "01"]
    return own[0], own[1]


class Comparison(NamedTuple):
    """What ``compare`` finds: a row a pair, a row a region, the aligned pair's packed slices, and the shift of each pair."""

    pairs: DataFrame
    regions: DataFrame
    slices: DataFrame
    shift: DataFrame


def compare(baseline: DataFrame, later: DataFrame, spacing: DataFrame | None = None, target_mm: float = REGISTRATION_MM,
            shifts: list[tuple[int, int, int]] | None = None, threshold: int = V.LUNG_THRESHOLD_HU,
            min_hu_delta: float = MIN_HU_DELTA, block: int = BLOCK, later_spacing: DataFrame | None = None, reach: int = 0,
            **limits: float) -> Comparison:
    """Compare the rounds of every pair.

    Alignment candidates are whole-voxel moves: those of ``shifts``, or those a coarse-to-fine search finds up to ``reach``
    voxels away. Leaving the pair alone competes too; when nothing beats it, the pair has a note and no regions. With ``spacing``
    (volume_id, spacing_z, spacing_y, spacing_x) both rounds are put on a cubic grid first; the later round may have its own.
    """
    if spacing is not None:
        # Both are read for the masks, the errors and the difference.
        baseline = cut(resample_isotropic(baseline, spacing, target_mm))
        later = cut(resample_isotropic(later, spacing if later_spacing is None else later_spacing, target_mm))
    masks, later_masks = _masks_of_both(baseline, later, threshold, block)
    early = cut(bits.with_packed_pixels(core(baseline, "px"), "px"))
    late = cut(core(onto_grid(bits.with_packed_pixels(core(later, "px"), "px"), early), "px"))
    errors = search_moves(early, late, masks, reach) if reach else move_errors(early, late, masks, shifts or [])
    best = cut(best_move(errors))
    interior = erode(masks, "mask", 2, "interior", block, packed=True)
    slices = cut(aligned_pairs(early, late, best, interior))
    shift = cut(pair_shift(slices))
    aligned = best.filter("selected_stage <> 'none'")
    hunted = slices.join(aligned.select("volume_id"), "volume_id", "left_semi").join(shift, "volume_id")
    regions = cut(regions_of(hunted, target_mm, min_hu_delta, block, **limits))  # counted below and returned
    voxel = F.lit(target_mm ** 3)
    volumes = mask_volume_ml(masks, voxel, shape=True).select("volume_id", "shape", F.col("volume_ml").alias("from_lung_ml")).join(
        mask_volume_ml(later_masks, voxel).select("volume_id", F.col("volume_ml").alias("to_lung_ml")), "volume_id")
    counted = regions.groupBy("volume_id").agg(F.count(F.lit(1)).alias("n_regions"))
    failed = F.col("selected_stage") == "none"
    before, after = half_even(F.col("alignment_before_hu"), 1), half_even(F.col("alignment_after_hu"), 1)
    pairs = best.join(shift, "volume_id").join(volumes, "volume_id").join(counted, "volume_id", "left").select(
        "volume_id", "selected_stage", before.alias("alignment_before_hu"), after.alias("alignment_after_hu"),
        F.lit(False).alias("deformable"), failed.alias("registration_failed"), F.coalesce(after < before, F.lit(False)).alias("alignment_improved"),
        half_even(F.col("shift_hu"), 1).alias("inflation_shift_hu"), F.when(failed, FAILED_NOTE).alias("note"),
        F.coalesce("n_regions", F.lit(0)).alias("n_regions"), F.lit(float(target_mm)).alias("spacing_mm"),
        F.transform("alignment_by_stage_hu", lambda e: F.struct(e["stage"].alias("stage"), half_even(e["error_hu"], 1).alias("error_hu"))).alias("alignment_by_stage_hu"),
        "shape", half_even(F.col("from_lung_ml"), 1).alias("from_lung_ml"), half_even(F.col("to_lung_ml"), 1).alias("to_lung_ml"))
    return Comparison(pairs, regions, slices, shift)

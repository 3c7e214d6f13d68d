"""Slice tables: ordering, spacing, profiles, re-slicing and resampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from longview.functions import voxel as V

from . import bits
from .blocks import BLOCK
from .scan import OrderedScan, exact_median

# Fixed values.
TOP_K_SLICES, MIN_SEPARATION = 5, 5
UNCHANGED_FACTOR = 1e-3


def _stack_key(slices: DataFrame) -> DataFrame:
    """Slim rows with the volume's sort key: physical position when every slice has one, else the instance number."""
    slim = slices.select("volume_id", "slice_uid", "position_z", "instance")
    placed = slim.groupBy("volume_id").agg(F.min(F.col("position_z").isNotNull()).alias("placed"), F.count(F.lit(1)).cast("int").alias("depth"))
    key = F.when(F.col("placed"), F.col("position_z")).otherwise(F.coalesce(F.col("instance"), F.lit(0)).cast("double"))
    return slim.join(placed, "volume_id").withColumn("stack_key", key)


def order_slices(slices: DataFrame) -> DataFrame:
    """Number slices feet to head: adds z (from 0) and depth.

    Ranked on slim rows, without pixels, by an ordered scan; slice_uid is
    unique within its volume.
    """
    ranked = OrderedScan(_stack_key(slices), ["volume_id"], ["stack_key", "slice_uid"]).row_number("_n").result()
    place = ranked.select("volume_id", "slice_uid", (F.col("_n") - 1).cast("int").alias("z"), "depth")
    return slices.join(place, ["volume_id", "slice_uid"])


def slice_spacing(slices: DataFrame) -> DataFrame:
    """Median gap of neighbouring positions, else the first slice's thickness, else 1."""
    keyed = _stack_key(slices)
    steps = OrderedScan(keyed.filter("placed"), ["volume_id"], ["stack_key", "slice_uid"]).lag(_before=F.col("stack_key")).result()
    gaps = exact_median(steps.withColumn("_gap", F.abs(F.col("stack_key") - F.col("_before"))), ["volume_id"], "_gap", "_m")
    first = keyed.join(slices.select("volume_id", "slice_uid", "thickness"), ["volume_id", "slice_uid"]).groupBy("volume_id").agg(
        F.min_by(F.coalesce("thickness", F.lit(0.0)), F.struct("stack_key", "slice_uid")).alias("_t"))
    fallback = F.when(F.col("_t") != 0, F.col("_t")).otherwise(1.0)
    return first.join(gaps, "volume_id", "left").select(
        "volume_id", F.when(F.col("_m") > 0, F.col("_m")).otherwise(fallback).alias("spacing_z"))


def stored_head_first(slices: DataFrame) -> DataFrame:
    """Whether instance order runs head to feet."""
    numbered = F.col("position_z").isNotNull() & F.col("instance").isNotNull()
    key = F.when(numbered, F.struct("instance", "slice_uid"))
    out = slices.groupBy("volume_id").agg(
        F.count_if(numbered).alias("_n"), F.min_by("position_z", key).alias("_first"), F.max_by("position_z", key).alias("_last"))
    return out.select("volume_id", F.coalesce((F.col("_n") >= 2) & (F.col("_last") < F.col("_first")), F.lit(False)).alias("head_first"))


def mixed_sizes(slices: DataFrame) -> DataFrame:
    """Volumes whose slices differ in size, which is an input error."""
    return slices.groupBy("volume_id").agg(
        F.min("rows").alias("min_rows"), F.max("rows").alias("max_rows"),
        F.min("cols").alias("min_cols"), F.max("cols").alias("max_cols")).filter("min_rows <> max_rows or min_cols <> max_cols")


def volume_headers(slices: DataFrame) -> DataFrame:
    """Shape and HU range of each volume."""
    return slices.groupBy("volume_id").agg(
        F.count(F.lit(1)).cast("int").alias("depth"), F.max("rows").alias("rows"), F.max("cols").alias("cols"),
        F.min(F.array_min("px")).alias("hu_min"), F.max(F.array_max("px")).alias("hu_max"))


def mask_volume_ml(masks: DataFrame, voxel_mm3: Column, shape: bool = False) -> DataFrame:
    """Mask voxels and their volume in millilitres (A27); the volume's shape too if asked."""
    size = [F.array(*[F.max(c) for c in ("depth", "rows", "cols")]).alias("shape")] if shape else []
    own = bits.count_set(F.col("mask")) if bits.is_packed(masks, "mask") else sum_px(F.col("mask"))
    return masks.withColumn("_set", own).groupBy("volume_id").agg(F.sum("_set").cast("bigint").alias("voxels"), *size).withColumn(
        "volume_ml", F.col("voxels") * voxel_mm3 / 1000.0)


def sum_px(px: Column) -> Column:
    return F.aggregate(px, F.lit(0.0), lambda a, v: a + v.cast("double"))


def quantise_volumes(slices: DataFrame, px: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Quantise to bytes over the volume's own range, or a given one.

    Adds value_lo, value_hi and level. Only one row of range per volume is joined.
    """
    cleaned = F.transform(px, V.clean)
    own = slices.groupBy("volume_id").agg(F.min(F.array_min(cleaned)).alias("_lo"), F.max(F.array_max(cleaned)).alias("_hi"))
    ranges = own.select("volume_id", (F.lit(float(lo)) if lo is not None else F.col("_lo").cast("float").cast("double")).alias("value_lo"),
                        (F.lit(float(hi)) if hi is not None else F.col("_hi").cast("float").cast("double")).alias("_top"))
    ranges = ranges.withColumn("value_hi", F.when(F.col("_top") > F.col("value_lo"), F.col("_top")).otherwise(F.col("value_lo")))
    if lo is not None and hi is not None:
        out = slices.withColumns({"value_lo": F.lit(float(lo)), "value_hi": F.lit(float(hi if hi > lo else lo))})
    else:
        out = slices.join(ranges.drop("_top"), "volume_id")
    return out.withColumn("level", V.quantise(F.col(px), F.col("value_lo"), F.col("value_hi")))


def profile(slices: DataFrame, px: str, floor: float) -> DataFrame:
    """Sum per slice, and its share of the volume's largest."""
    sums = slices.select("volume_id", "z", sum_px(F.col(px)).alias("total"))
    peak = sums.groupBy("volume_id").agg(F.max("total").alias("_peak"))
    return sums.join(peak, "volume_id").select("volume_id", "z", "total", (F.col("total") / F.greatest("_peak", F.lit(floor))).alias("share"))


def top_slices(profiles: DataFrame, value: str = "total", k: int = TOP_K_SLICES, separation: int = MIN_SEPARATION) -> DataFrame:
    """The k strongest slices at least ``separation`` apart, greedily.

    A chosen slice rules out at most 2*separation-2 others, so the answer lies
    among the first (k-1)*(2*separation-1)+1 slices by value: no more than that
    is gathered per volume. Equal values prefer the higher slice.
    """
    enough = (k - 1) * (2 * separation - 1) + 1
    w = W.partitionBy("volume_id").orderBy(F.desc(value), F.desc("z"))
    best = profiles.filter(F.col(value) > 0).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= enough)
    ranked = best.groupBy("volume_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("_r", F.col("z").cast("int").alias("z")))), lambda s: s["z"]).alias("_z"))
    pick = F.aggregate(
        "_z", F.array().cast("array<int>"),
        lambda acc, z: F.when((F.size(acc) < k) & F.forall(acc, lambda c: F.abs(c - z) >= separation), F.array_append(acc, z)).otherwise(acc))
    picked = ranked.select("volume_id", pick.alias("top_slices"))
    return profiles.select("volume_id").distinct().join(picked, "volume_id", "left").withColumn(
        "top_slices", F.coalesce("top_slices", F.array().cast("array<int>")))


def reslice(slices: DataFrame, plane: str, px: str = "px") -> DataFrame:
    """Planes of a volume with the head on top: volume_id, plane_index, px.

    Each output row is one image; its lines come from one slice each.
    """
    if plane == "axial":
        return slices.select("volume_id", F.col("z").alias("plane_index"), F.col(px).alias("px"))
    rows, cols = F.col("rows"), F.col("cols")
    if plane == "coronal":
        lines = F.transform(F.sequence(F.lit(0), rows - 1), lambda y: F.slice(px, y * cols + 1, cols))
    elif plane == "sagittal":
        lines = F.transform(F.sequence(F.lit(0), cols - 1),
                            lambda x: F.transform(F.sequence(F.lit(0), rows - 1), lambda y: F.get(px, y * cols + x)))
    else:
        raise ValueError(f"unknown plane {plane!r}")
    each = slices.select("volume_id", "z", F.posexplode(lines).alias("plane_index", "line"))
    stacked = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("z")).alias("up"), "line"))), lambda s: s["line"])
    return each.groupBy("volume_id", "plane_index").agg(F.flatten(stacked).alias("px"))


def scaled_length(n: Column, factor: Column) -> Column:
    return F.bround(n * factor).cast("int")


def _targets(out_depth: Column) -> Column:
    """Output positions a source slice feeds, with linear weights."""
    z, n = F.col("z"), F.col("depth")
    ratio = F.when(n > 1, (out_depth - 1) / F.greatest(n - 1, F.lit(1))).otherwise(F.lit(0.0))
    lo = F.when(n > 1, F.greatest(F.floor((z - 1) * ratio), F.lit(0))).otherwise(F.lit(0)).cast("int")
    hi = F.when(n > 1, F.least(F.ceil((z + 1) * ratio), out_depth - 1)).otherwise(out_depth - 1).cast("int")

    def weigh(i: Column) -> Column:
        c = V.grid_coordinate(i, n, out_depth)
        base = F.floor(c)
        w = F.when(z == base, 1 - (c - base)).when(z == base + 1, c - base).otherwise(0.0)
        return F.struct(i.alias("i"), w.alias("w"))

    return F.filter(F.transform(F.sequence(lo, hi), weigh), lambda s: s["w"] > 0)


def zoom_linear(slices: DataFrame, px: str = "px", block: int = BLOCK) -> DataFrame:
    """Trilinear zoom onto out_depth x out_rows x out_cols (columns of ``slices``).

    Output slices are made in blocks, each of which gets the source slices it lies between, packed; a source slice goes to the
    one or two blocks it feeds. Planes are resized there, so neither resized planes nor halves of a slice are sent.
    """
    id_type = slices.schema["volume_id"].dataType.simpleString()
    out = ["out_depth", "out_rows", "out_cols"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        depth, n_out, rows, cols = (int(first[c]) for c in ("depth", *out))
        planes = {z: V.resized_plane(bits.plane(p, int(h), int(w)), rows, cols).ravel() for z, p, h, w in zip(pdf["z"], pdf[px], pdf["rows"], pdf["cols"])}
        own = np.arange(int(first["block"]) * block, min((int(first["block"]) + 1) * block, n_out))
        at = own * (depth - 1) / max(n_out - 1, 1) if n_out > 1 else np.zeros(len(own))
        made, kept = [], []
        for i, c in zip(own, at):
            low, w = int(np.floor(c)), c - np.floor(c)
            near = [(planes[z], v) for z, v in ((low, 1 - w), (low + 1, w)) if v > 0 and z in planes]
            if near:
                kept.append(i)
                made.append(near[0][0] if len(near) == 1 else near[0][0] * near[0][1] + near[1][0] * near[1][1])
        res = pd.DataFrame({"volume_id": first["volume_id"], "z": kept, "depth": n_out, "rows": rows, "cols": cols})
        res[px] = pd.Series(made, dtype=object)
        return res

    z, n, o = F.col("z"), F.col("depth"), F.col("out_depth")
    ratio = (o - 1) / F.greatest(n - 1, F.lit(1))
    low = F.when(n > 1, F.greatest(F.floor((z - 1) * ratio), F.lit(0))).otherwise(F.lit(0))
    high = F.when(n > 1, F.least(F.ceil((z + 1) * ratio), o - 1)).otherwise(o - 1)
    plain = slices.select("volume_id", *[F.col(c).cast("int").alias(c) for c in ("z", "depth", "rows", "cols", *out)], px)
    sent = bits.with_packed_pixels(plain, px).withColumn("block", F.explode(F.sequence(F.floor(low / block), F.floor(high / block))))
    return sent.groupBy("volume_id", "block").applyInPandas(run, f"volume_id {id_type}, z int, depth int, rows int, cols int, {px} array<double>")


def resample_isotropic(slices: DataFrame, spacing: DataFrame, target_mm: float = 1.0) -> DataFrame:
    """Slices on a cubic grid, linear, truncated to whole HU.

    ``spacing`` has volume_id, spacing_z, spacing_y, spacing_x. Volumes already
    on the grid pass through untouched.
    """
    axes = {"depth": "spacing_z", "rows": "spacing_y", "cols": "spacing_x"}
    same = F.lit(True)
    for s in axes.values():
        same = same & (F.abs(F.col(s) / target_mm - 1.0) < UNCHANGED_FACTOR)
    base = slices.select("volume_id", "z", "depth", "rows", "cols", "px").join(spacing, "volume_id").withColumn("_same", same)
    moved = base.filter(~F.col("_same")).withColumns(
        {f"out_{a}": scaled_length(F.col(a), F.col(s) / target_mm) for a, s in axes.items()})
    zoomed = zoom_linear(moved).withColumn("px", F.transform("px", lambda v: v.cast("float").cast("int")))
    kept = base.filter("_same").select(*zoomed.columns)
    return zoomed.unionByName(kept)


def resample_nearest(slices: DataFrame, px: str = "px") -> DataFrame:
    """Nearest-neighbour zoom onto out_depth x out_rows x out_cols.

    Every output slice copies one input slice, so rows are only repeated.
    """
    z, n, out = F.col("z"), F.col("depth"), F.col("out_depth")
    ratio = F.when(n > 1, (out - 1) / F.greatest(n - 1, F.lit(1))).otherwise(F.lit(0.0))
    lo = F.when(n > 1, F.greatest(F.floor((z - 0.5) * ratio) - 1, F.lit(0))).otherwise(F.lit(0)).cast("int")
    hi = F.when(n > 1, F.least(F.ceil((z + 0.5) * ratio) + 1, out - 1)).otherwise(out - 1).cast("int")
    fed = F.filter(F.sequence(lo, hi), lambda i: F.floor(V.grid_coordinate(i, n, out) + 0.5) == z)
    flat = V.nearest_plane(F.col(px), F.col("rows"), F.col("cols"), F.col("out_rows"), F.col("out_cols"))
    return slices.withColumn("_px", flat).select(
        "volume_id", F.explode(fed).alias("_i"), F.col("out_depth").alias("depth"), F.col("out_rows").alias("rows"),
        F.col("out_cols").alias("cols"), F.col("_px").alias(px)).withColumnRenamed("_i", "z")


def resample_profile(profiles: DataFrame, value: str) -> DataFrame:
    """Linear resample of a per-slice profile onto out_depth slices."""
    fed = profiles.select("volume_id", F.col(value).alias("_v"), F.explode(_targets(F.col("out_depth"))).alias("_t"))
    return fed.groupBy("volume_id", F.col("_t.i").alias("z")).agg(F.sum(F.col("_t.w") * F.col("_v")).alias(value))

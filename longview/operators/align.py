"""Whole-voxel alignment: errors of moves, and a coarse-to-fine search for the best one.

Slices are packed. The later round is sent once for each distinct move along z; all moves inside the plane are scored where it
meets the earlier round's slice, so no moved copy is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longview.session import cut

from . import bits

FILL_HU = -1024  # fixed value: air
#: Blocks of the coarsest level have at most this edge; each finer level halves it.
COARSEST = 4


def _shifted(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    out = np.full_like(a, FILL_HU)
    h, w = a.shape
    if abs(dy) < h and abs(dx) < w:
        out[max(dy, 0):h + min(dy, 0), max(dx, 0):w + min(dx, 0)] = a[max(-dy, 0):h - max(dy, 0), max(-dx, 0):w - max(dx, 0)]
    return out


def moved(px: Column, rows: Column, cols: Column, dy: Column, dx: Column) -> Column:
    """A packed slice moved in its plane, outside filled with air."""

    @F.pandas_udf("binary")
    def made(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for series in parts:
            yield pd.Series([p if y == 0 and x == 0 else bits.pixel_bytes(_shifted(bits.plane(p, h, w), int(y), int(x))) for p, h, w, y, x in zip(*series)], dtype=object)

    return made(px, rows, cols, dy, dx)


def _row_errors(fixed: bytes, weights: bytes, rows: int, cols: int, there: dict[int, bytes], moves: list[tuple[int, int, int]]) -> list[float]:
    """Weighted sum of absolute differences of one slice, for every move; only the box that has weight is looked at."""
    w = bits.plane(weights, rows, cols)
    used = np.nonzero(w)
    if not len(used[0]):
        return [0.0] * len(moves)
    y0, y1, x0, x1 = used[0].min(), used[0].max() + 1, used[1].min(), used[1].max() + 1
    w = w[y0:y1, x0:x1].astype(np.float64)
    a = bits.plane(fixed, rows, cols)[y0:y1, x0:x1].astype(np.float64)
    padded, out = {}, []
    air = float((np.abs(FILL_HU - a) * w).sum())
    reach = max([max(abs(dy), abs(dx)) for _, dy, dx in moves])
    for dz, dy, dx in moves:
        if dz not in there:
            out.append(air)
            continue
        if dz not in padded:
            padded[dz] = np.pad(bits.plane(there[dz], rows, cols).astype(np.float64), reach, constant_values=FILL_HU)
        b = padded[dz][reach + y0 - dy:reach + y1 - dy, reach + x0 - dx:reach + x1 - dx]
        out.append(float((np.abs(b - a) * w).sum()))
    return out


def score(fixed: DataFrame, later: DataFrame, moves: DataFrame) -> DataFrame:
    """Mean absolute difference under the mask of every move (A24): volume_id, dz, dy, dx, stage_order, error_hu (null without a mask).

    ``fixed`` are slices with px and mask (bits, or weights as pixels), ``later`` slices with px, ``moves`` rows of volume_id and
    ``moves``, an array of (dz, dy, dx, stage_order). What no slice of the later round reaches is air.
    """
    listed = moves.select("volume_id", "moves", F.array_distinct(F.transform("moves", lambda m: m["dz"])).alias("_dzs"))
    sent = later.join(listed.select("volume_id", "_dzs"), "volume_id").select("volume_id", "z", "px", F.explode("_dzs").alias("_dz")).select(
        "volume_id", (F.col("z") + F.col("_dz")).cast("int").alias("z"), "_dz", "px")
    # As many entries as the search has moves along z.
    met = sent.groupBy("volume_id", "z").agg(F.collect_list("_dz").alias("_there"), F.collect_list("px").alias("_px"))
    rows = fixed.join(met, ["volume_id", "z"], "left").join(listed.select("volume_id", "moves"), "volume_id")

    @F.pandas_udf("array<double>")
    def summed(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for series in parts:
            made = []
            for px, mask, h, w, there, planes, dz, dy, dx in zip(*series):
                own = dict(zip(there, planes)) if there is not None else {}
                errors = _row_errors(px, mask, h, w, own, list(zip(dz.tolist(), dy.tolist(), dx.tolist())))
                made.append([*errors, float(bits.plane(mask, h, w).sum())])
            yield pd.Series(made, dtype=object)

    parts = [F.col(f"moves.{c}") for c in ("dz", "dy", "dx")]
    # The weight of the slice comes last, behind its errors.
    per_slice = rows.select("volume_id", "moves", summed("px", "mask", "rows", "cols", "_there", "_px", *parts).alias("_s"))
    each = per_slice.select("volume_id", F.explode(F.transform("moves", lambda m, i: F.struct(
        m.alias("move"), F.get("_s", i).alias("e"), F.get("_s", F.size("moves")).alias("n")))).alias("_m"))
    total = each.groupBy("volume_id", F.col("_m.move").alias("_move")).agg(F.sum("_m.e").alias("_e"), F.sum("_m.n").alias("_n"))
    return total.select("volume_id", "_move.*", F.try_divide("_e", "_n").alias("error_hu"))


def _listed(volumes: DataFrame, moves: Sequence[tuple[int, int, int]]) -> DataFrame:
    """The same moves for every volume; staying put comes first, as stage 0."""
    rows = [(0, 0, 0, 0), *((*m, i + 1) for i, m in enumerate(moves))]
    made = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("dz", "dy", "dx", "stage_order"), r)]) for r in rows])
    return volumes.select("volume_id", made.alias("moves"))


def _named(errors: DataFrame) -> DataFrame:
    name = F.when(F.col("stage_order") == 0, "none").otherwise(F.format_string("shift(%d,%d,%d)", "dz", "dy", "dx"))
    return errors.withColumn("stage", name)


def _fixed(early: DataFrame, masks: DataFrame) -> DataFrame:
    packed = bits.with_packed_mask(masks.select("volume_id", "z", "rows", "cols", "mask"), "mask")
    return bits.with_packed_pixels(early.select("volume_id", "z", "depth", "rows", "cols", "px"), "px").join(packed.select("volume_id", "z", "mask"), ["volume_id", "z"])


def move_errors(early: DataFrame, later: DataFrame, masks: DataFrame, shifts: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Errors of the given moves, and of leaving the pair alone: volume_id, stage, stage_order, dz, dy, dx, error_hu."""
    volumes = early.select("volume_id").distinct()
    return _named(score(_fixed(early, masks), bits.with_packed_pixels(later.select("volume_id", "z", "px"), "px"), _listed(volumes, shifts)))


def shrink(slices: DataFrame, factor: int, px: str = "px", mask: str | None = None) -> DataFrame:
    """Block means of ``px`` over cubes of ``factor``, and how many voxels of ``mask`` each holds.

    A slice is shrunk in its row first, so what is sent along z is a factor-squared-th of it; a slab gathers ``factor`` slices.
    Blocks at the far ends are the means of what they hold.
    """

    @F.pandas_udf("binary")
    def reduced(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for data, rows, cols in parts:
            made = []
            for d, h, w in zip(data, rows, cols):
                a = bits.plane(d, h, w).astype(np.float64)
                a = np.add.reduceat(np.add.reduceat(a, np.arange(0, h, factor), axis=0), np.arange(0, w, factor), axis=1)
                made.append(bits.pixel_bytes(a))
            yield pd.Series(made, dtype=object)

    @F.pandas_udf("binary")
    def summed(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for lists, rows, cols, mean in parts:
            made = []
            for own, h, w, m in zip(lists, rows, cols, mean):
                oh, ow = -(-h // factor), -(-w // factor)
                a = sum(bits.plane(d, oh, ow) for d in own)
                if m:
                    size = np.add.reduceat(np.ones(h), np.arange(0, h, factor))[:, None] * np.add.reduceat(np.ones(w), np.arange(0, w, factor))
                    a = a / (size * len(own))
                made.append(bits.pixel_bytes(a))
            yield pd.Series(made, dtype=object)

    wanted = [px, *([mask] if mask else [])]
    flat = slices.select("volume_id", "z", "depth", "rows", "cols", *[reduced(c, "rows", "cols").alias(c) for c in wanted])
    slabs = flat.groupBy("volume_id", F.floor(F.col("z") / factor).cast("int").alias("z")).agg(
        F.max("depth").alias("depth"), F.max("rows").alias("rows"), F.max("cols").alias("cols"), *[F.collect_list(c).alias(c) for c in wanted])
    up = lambda c: F.ceil(F.col(c) / factor).cast("int").alias(c)
    return slabs.select("volume_id", "z", up("depth"), up("rows"), up("cols"), *[summed(c, "rows", "cols", F.lit(c == px)).alias(c) for c in wanted])


def search_moves(early: DataFrame, later: DataFrame, masks: DataFrame, reach: int, coarsest: int = COARSEST) -> DataFrame:
    """The moves a coarse-to-fine search ends with, and their errors, beside leaving the pair alone.

    Both rounds are shrunk to block means. At the coarsest level all moves up to ``reach`` voxels are scored, by weight of the mask
    in each block; every finer level scores the 27 around twice its pair's best, and the last one works on the voxels themselves,
    with the same errors as any other list of moves. Of equal errors the shorter move wins, then the lower one.
    """
    fixed = cut(_fixed(early, masks))
    late = bits.with_packed_pixels(later.select("volume_id", "z", "depth", "rows", "cols", "px"), "px")
    factor = 1
    while factor * 2 <= min(coarsest, reach):
        factor *= 2
    volumes, moves = early.select("volume_id").distinct(), None
    while True:
        a = fixed if factor == 1 else cut(shrink(fixed, factor, "px", "mask"))
        b = late if factor == 1 else shrink(late, factor)
        if moves is None:
            span = range(-(-(-reach // factor)), -(-reach // factor) + 1)
            moves = _listed(volumes, [(z, y, x) for z in span for y in span for x in span if (z, y, x) != (0, 0, 0)])
        elif factor == 1:
            # Staying put competes by itself, so it is listed once.
            near = F.filter("moves", lambda m: (m["dz"] != 0) | (m["dy"] != 0) | (m["dx"] != 0))
            still = F.struct(*[F.lit(0).alias(c) for c in ("dz", "dy", "dx", "stage_order")])
            moves = moves.select("volume_id", F.concat(F.array(still), near).alias("moves"))
        errors = score(a, b.select("volume_id", "z", "px"), moves)
        if factor == 1:
            return _named(errors)
        size = F.abs(F.col("dz")) + F.abs(F.col("dy")) + F.abs(F.col("dx"))
        # Rounded, so that sums taken in another order tie alike.
        order = F.struct(F.coalesce(F.round("error_hu", 6), F.lit(float("inf"))).alias("e"), size.alias("s"), F.col("dz"), F.col("dy"), F.col("dx"))
        best = errors.groupBy("volume_id").agg(F.min_by(F.struct("dz", "dy", "dx"), order).alias("_b"))
        around = [(z, y, x) for z in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1)]
        made = F.array(*[F.struct(*[(F.col(f"_b.{c}") * 2 + v).alias(c) for c, v in zip(("dz", "dy", "dx"), m)], F.lit(i + 1).alias("stage_order")) for i, m in enumerate(around)])
        moves = cut(best.select("volume_id", made.alias("moves")))
        factor //= 2

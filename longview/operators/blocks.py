"""Stencils over slice stacks by halo exchange.

A stencil along z needs neighbouring slices. Slices are grouped into blocks of
consecutive z, each block also receiving the few slices its neighbours share
with it, so a task holds a bounded stack (``block + 2 * halo`` slices) however
deep a volume is. Slices are packed before they are sent (``bits``). The arithmetic
is numpy on a stack, for masks on words of 64 pixels: one large block, or many
small ones with a clear slice between them, so that small blocks cost no call each.

Slices are rows of volume_id, z (dense from 0), depth, rows, cols and pixels.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longview.session import small_batches

from . import bits

BLOCK = 32
CHUNK = 1 << 22  # voxels of the small blocks that are worked on together
# Unit-sigma Gaussian, cut at four sigma.
GAUSS_RADIUS = 4
GAUSS_WEIGHTS = [math.exp(-0.5 * k * k) for k in range(-GAUSS_RADIUS, GAUSS_RADIUS + 1)]
GAUSS_WEIGHTS = [w / sum(GAUSS_WEIGHTS) for w in GAUSS_WEIGHTS]


def with_block(slices: DataFrame, below: int, above: int, block: int = BLOCK) -> DataFrame:
    """Send each slice to its block and to the blocks whose halo it lies in."""
    small_batches(slices.sparkSession)
    first = F.greatest(F.floor((F.col("z") - above) / block), F.lit(0))
    last = F.least(F.floor((F.col("z") + below) / block), F.floor((F.col("depth") - 1) / block))
    return slices.withColumn("block", F.explode(F.sequence(first, last)))


CORE = ["volume_id", "z", "depth", "rows", "cols"]


def core(slices: DataFrame, *extra: str) -> DataFrame:
    """The columns a block needs, counts as plain integers."""
    return slices.select("volume_id", *[F.col(c).cast("int").alias(c) for c in CORE[1:]], *extra)


class Part:
    """Whole blocks of one plane size: columns of their rows (by block, then z) and the number of each row's block in ``of``."""

    def __init__(self, table: pa.Table, of: np.ndarray, rows: int, cols: int):
        self._table, self.of, self.rows, self.cols = table, of, rows, cols

    def __getitem__(self, name: str) -> np.ndarray | list[bytes]:
        column = self._table.column(name)
        return column.to_pylist() if pa.types.is_binary(column.type) else column.to_numpy()

    def gapped(self, stack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The stack with a clear slice behind every block; the place of every slice, and of the clear ones."""
        at = np.arange(len(stack)) + self.of
        out = np.zeros((len(stack) + self.of[-1] + 1, *stack.shape[1:]), stack.dtype)
        out[at] = stack
        return out, at, np.setdiff1d(np.arange(len(out)), at, assume_unique=True)


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _column(values: np.ndarray | list, kind: str) -> pa.Array:
    if not kind.startswith("array<"):
        return pa.array(values, _ARROW[kind])
    inner = _ARROW[kind[6:-1]]
    if not isinstance(values, np.ndarray):
        return pa.array(values, pa.list_(inner))
    flat = pa.array(values.reshape(-1), inner)  # every row as long as the others
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * (len(flat) // max(len(values), 1)), pa.int32()), flat)


def _key(batch: pa.RecordBatch, i: int) -> tuple:
    return batch.column("volume_id")[i].as_py(), batch.column("block")[i].as_py()


def _starts(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """The rows at which a block starts."""
    ids = table.column("volume_id")
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    code, at = ids.dictionary_encode("encode").indices.to_numpy(), table.column("block").to_numpy()
    return np.r_[0, np.flatnonzero((code[1:] != code[:-1]) | (at[1:] != at[:-1])) + 1]


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches as tables of whole blocks; only the last block of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = int(_starts(batch)[-1])
        if held and (cut or _key(batch, 0) != _key(held[-1], held[-1].num_rows - 1)):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def over_blocks(wide: DataFrame, run: Callable[[Part], tuple[np.ndarray, dict]], out: dict[str, str]) -> DataFrame:
    """Run ``run`` on the blocks of ``wide`` (see ``with_block``): volume_id and the columns ``out`` names with their types.

    ``run`` gets a ``Part`` of one block, or of several that hold up to ``CHUNK`` voxels together, and returns the number of
    the block of every row it makes, and the columns. Rows of depth 0 are no slices and have no plane. Packed slices are few bytes
    for the work they cause, so their size does not set the number of tasks: it is three a core, or the session's partitions if fewer.
    """
    id_type = wide.schema["volume_id"].dataType.simpleString()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches):
            table = table.combine_chunks()
            starts = _starts(table)
            rows, cols, depth = (table.column(c).to_numpy() for c in ("rows", "cols", "depth"))
            high, wide_ = np.maximum.reduceat(rows, starts), np.maximum.reduceat(cols, starts)
            size = np.add.reduceat(np.where(depth > 0, 1, 0), starts) * high.astype(np.int64) * wide_
            ends = np.r_[starts[1:], table.num_rows]
            first = 0
            while first < len(starts):
                last, held = first + 1, size[first]
                while last < len(starts) and (high[last], wide_[last]) == (high[first], wide_[first]) and held + size[last] <= CHUNK:
                    held, last = held + size[last], last + 1
                own = starts[first:last]
                of = np.repeat(np.arange(last - first), ends[first:last] - own)
                at, made = run(Part(table.slice(own[0], ends[last - 1] - own[0]), of, int(high[first]), int(wide_[first])))
                if len(at):
                    ids = table.column("volume_id").take(pa.array(own[at])).combine_chunks()
                    yield pa.RecordBatch.from_arrays([ids, *[_column(made[c], kind) for c, kind in out.items()]], names=["volume_id", *out])
                first = last

    spark = wide.sparkSession
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    dealt = wide.repartition(n, "volume_id", "block").sortWithinPartitions("volume_id", "block", "z")
    return dealt.mapInArrow(parts, ", ".join([f"volume_id {id_type}", *[f"{c} {kind}" for c, kind in out.items()]]))


PLACE = {"z": "int", "depth": "int", "rows": "int", "cols": "int"}


def block_apply(slices: DataFrame, pixels: str, fn: Callable[..., np.ndarray], halo: int, out: str,
                out_type: str, block: int = BLOCK) -> DataFrame:
    """Run ``fn(stack, zs, depth, of) -> stack`` on blocks and keep each block's own slices. Pixels are packed before they are sent."""

    def run(part: Part) -> tuple[np.ndarray, dict]:
        zs = part["z"]
        result = fn(bits.stack(part[pixels], part.rows, part.cols), zs, part["depth"], part.of)
        own = zs // block == part["block"]
        return part.of[own], {**{c: part[c][own] for c in PLACE}, out: result.reshape(len(zs), -1)[own]}

    wide = with_block(bits.with_packed_pixels(core(slices, pixels), pixels), halo, halo, block)
    return over_blocks(wide, run, {**PLACE, out: f"array<{out_type}>"})


def mask_apply(slices: DataFrame, mask: str, fn: Callable[[np.ndarray, int, np.ndarray], np.ndarray], halo: int, out: str,
               block: int = BLOCK, packed: bool = False) -> DataFrame:
    """Run ``fn(words, cols, gaps) -> words`` on blocks of mask slices and keep each block's own; packed before they are sent.

    A block's ends count as clear: at a volume's end that is what the operators want, and elsewhere the halo is cut off. ``gaps``
    are the clear slices between blocks, which a step that sets them has to clear again before the next one.
    """

    def run(part: Part) -> tuple[np.ndarray, dict]:
        own = part["z"] // block == part["block"]
        words, at, gaps = part.gapped(bits.words_of(part[mask], part.rows, part.cols))
        result = fn(words, part.cols, gaps)[at[own]]
        return part.of[own], {**{c: part[c][own] for c in PLACE}, out: mask_column(result, part.cols, packed)}

    wide = with_block(bits.with_packed_mask(core(slices, mask), mask), halo, halo, block)
    return over_blocks(wide, run, {**PLACE, out: mask_kind(packed)})


def mask_kind(packed: bool) -> str:
    return "binary" if packed else "array<int>"


def mask_column(words: np.ndarray, cols: int, packed: bool) -> np.ndarray | list[bytes]:
    return bits.slice_bytes(words, cols) if packed else bits.booleans(words, cols).reshape(len(words), -1).astype(np.int32)


def _shifted(stack: np.ndarray, axis: int, k: int, mode: str) -> np.ndarray:
    """The stack moved by k along an axis, outside filled by reflection or zeros."""
    n = stack.shape[axis]
    pad = [(0, 0)] * stack.ndim
    pad[axis] = (abs(k), abs(k))
    big = np.pad(stack, pad, mode="symmetric") if mode == "reflect" else np.pad(stack, pad)
    return np.take(big, np.arange(n) + abs(k) + k, axis=axis)


def _along_z(stack: np.ndarray, zs: np.ndarray, depth: np.ndarray, of: np.ndarray, k: int, mode: str) -> np.ndarray:
    """The slice k further in the whole volume for every held slice.

    Rows whose neighbour is not held lie in the halo and are not kept.
    """
    target = zs + k
    if mode == "reflect":
        period = np.mod(target, 2 * depth)
        target = np.where(period < depth, period, 2 * depth - 1 - period)
    # Blocks far apart on one axis, so that one search serves all.
    far = np.int64(1) << 40
    held = np.searchsorted(of * far + zs, of * far + target).clip(np.searchsorted(of, of), np.searchsorted(of, of, side="right") - 1)
    out = stack[held].copy()
    if mode != "reflect":
        out[(target < 0) | (target >= depth)] = 0
    return out


def gaussian_stack(stack: np.ndarray, zs: np.ndarray, depth: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Smoothed slices of one or more blocks: ``of`` numbers the block of each."""
    out = stack.astype(np.float64)
    for axis in (0, 1, 2):
        src, ks = out, range(-GAUSS_RADIUS, GAUSS_RADIUS + 1)
        out = sum(w * (_along_z(src, zs, depth, of, k, "reflect") if axis == 0 else _shifted(src, axis, k, "reflect"))
                  for w, k in zip(GAUSS_WEIGHTS, ks))
    return out


def slab_runs(mask: np.ndarray, across: bool = True) -> tuple[np.ndarray, ...]:
    """Row runs of a stack (z, y, first and last x) and the run that names the component each belongs to.

    Components join slices only if ``across``.
    """
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (0, 0), (1, 1))), axis=2)
    z, y, x0 = np.nonzero(edge == 1)
    x1 = np.nonzero(edge == -1)[2] - 1
    run = np.cumsum(edge[:, :, :-1] == 1).reshape(mask.shape) * mask  # run number from 1, 0 outside
    label = np.arange(len(z) + 1)
    pairs = []
    for a, b in ((run[:, :-1], run[:, 1:]), (run[:-1], run[1:]))[:1 + across]:
        both = (a > 0) & (b > 0)
        pairs.append(np.unique(np.stack([a[both], b[both]]), axis=1))
    a, b = np.concatenate(pairs, axis=1)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return z, y, x0, x1, label[1:] - 1
        label = new


def filled_runs(z: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    """Disjoint row runs as a 0/1 stack: a mark where a run starts, one after its end, summed along the row."""
    marks = np.zeros((*shape[:2], shape[2] + 1), np.int32)
    np.add.at(marks, (z, y, x0), 1)
    np.add.at(marks, (z, y, x1 + 1), -1)
    return np.cumsum(marks, axis=2, dtype=np.int32)[:, :, :-1]


def fill_holes_stack(stack: np.ndarray) -> np.ndarray:
    """Set background that cannot reach a slice's border by 4-neighbour steps: components of its runs that no border run names."""
    z, y, x0, x1, first = slab_runs(stack == 0, across=False)
    _, rows, cols = stack.shape
    outside = np.zeros(len(z), bool)
    outside[first[(y == 0) | (y == rows - 1) | (x0 == 0) | (x1 == cols - 1)]] = True
    seen = outside[first]
    return 1 - filled_runs(z[seen], y[seen], x0[seen], x1[seen], stack.shape)


def gaussian(slices: DataFrame, pixels: str, out: str = "smoothed", block: int = BLOCK) -> DataFrame:
    """Unit-sigma smoothing in three dimensions, edges reflected."""
    return block_apply(slices, pixels, gaussian_stack, GAUSS_RADIUS, out, "double", block)


def erode(slices: DataFrame, mask: str, iterations: int = 2, out: str = "interior", block: int = BLOCK, packed: bool = False) -> DataFrame:
    """Erosion by a 3x3x3 cube, repeated; outside the volume counts as clear."""
    return mask_apply(slices, mask, lambda m, cols, gaps: bits.shrunk(m, iterations), iterations, out, block, packed)


def dilate(slices: DataFrame, mask: str, out: str = "dilated", block: int = BLOCK, packed: bool = False) -> DataFrame:
    """Dilation by a 3x3x3 cube."""
    return mask_apply(slices, mask, lambda m, cols, gaps: bits.grown(m, cols), 1, out, block, packed)


def close_words(m: np.ndarray, cols: int, gaps: np.ndarray) -> np.ndarray:
    wide = bits.grown(m, cols)
    wide[gaps] = 0
    return bits.shrunk(wide)


def close(slices: DataFrame, mask: str, out: str = "closed", block: int = BLOCK, packed: bool = False) -> DataFrame:
    """Closing by a 3x3x3 cube; the volume's outermost voxels always end up clear."""
    return mask_apply(slices, mask, close_words, 2, out, block, packed)


def close_and_fill(slices: DataFrame, runs: DataFrame, out: str = "mask", block: int = BLOCK, packed: bool = False) -> DataFrame:
    """The mask that ``runs`` draw on ``slices``, closed, then every slice's holes filled.

    Only runs are sent to the blocks; a slice comes without pixels, to say that it is there, and has a depth, which a run has not.
    """

    def run(part: Part) -> tuple[np.ndarray, dict]:
        z, depth = part["z"], part["depth"]
        own = depth > 0
        of, at = part.of[own], z[own]
        if not len(of):  # a halo beyond the last block
            return of, {}
        n = int(part.of[-1]) + 1
        low, high, deep = np.full(n, np.iinfo(np.int64).max), np.full(n, -1), np.zeros(n, np.int64)
        np.minimum.at(low, of, at)
        np.maximum.at(high, of, at)
        np.maximum.at(deep, of, depth[own])
        low, high = np.maximum(low - 2, 0), np.minimum(high + 2, deep - 1)
        layers = np.where(deep > 0, high - low + 1, 0)
        ends = np.cumsum(layers + 1)  # each block's layers, then a clear one
        base = ends - layers - 1
        drawn = ~own & (z >= low[part.of]) & (z <= high[part.of])
        layer = (base - low)[part.of[drawn]] + z[drawn]
        painted = filled_runs(layer, *(part[c][drawn] for c in ("y", "x0", "x1")), (int(ends[-1]), part.rows, part.cols))
        closed = bits.booleans(close_words(bits.words_from(painted != 0), part.cols, ends - 1)[(base - low)[of] + at], part.cols)
        return of, {**{c: part[c][own] for c in PLACE}, out: mask_column(bits.words_from(fill_holes_stack(closed) != 0), part.cols, packed)}

    none = F.lit(0)
    frame = core(slices, *[none.alias(c) for c in ("y", "x0", "x1")]).withColumn("block", F.floor(F.col("z") / block))
    at = runs.select("volume_id", F.col("z").cast("int").alias("z"), *[none.alias(c) for c in ("depth", "rows", "cols")], *[F.col(c).cast("int").alias(c) for c in ("y", "x0", "x1")], F.explode(F.sequence(
        F.greatest(F.floor((F.col("z") - 2) / block), F.lit(0)), F.floor((F.col("z") + 2) / block))).alias("block"))
    return over_blocks(frame.unionByName(at), run, {**PLACE, out: mask_kind(packed)})


def fill_holes(mask: Column, rows: Column, cols: Column) -> Column:
    """Per-slice hole fill (X8); a slice is one row, so no shuffle."""

    @F.pandas_udf("array<int>")
    def filled(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for m, r, c in parts:
            yield pd.Series([fill_holes_stack(np.asarray(a).reshape(1, h, w)).ravel() for a, h, w in zip(m, r, c)])

    return filled(mask, rows, cols)

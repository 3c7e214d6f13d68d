"""Face-connected components of mask volumes, and the lung mask.

Slabs of consecutive slices are labelled in parallel; a slab also holds the
next slab's first slice, so components meeting there can be matched by an
equi-join on that slice's runs. Only slab components that meet another slab
enter the global merge (``graph``), over a table far smaller than the voxels.
The label of a component is its first voxel in scan order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from longview.functions.voxel import LUNG_THRESHOLD_HU
from longview.session import cut

from . import bits
from .blocks import BLOCK, Part, close_and_fill, core, over_blocks, slab_runs, with_block
from .graph import components

SECOND_LUNG_SHARE = 0.15  # fixed value


def _slab_table(masks: DataFrame, block: int) -> DataFrame:
    def run(part: Part) -> tuple[np.ndarray, dict]:
        rows, cols = part.rows, part.cols
        apart, places, _ = part.gapped(bits.stack(part["mask"], rows, cols))
        z, y, x0, x1, first = slab_runs(apart)
        at = np.searchsorted(places, z)
        zs = part["z"][at]
        voxel = (zs.astype(np.int64) * rows + y) * cols + x0
        return part.of[at], {"z": zs, "y": y, "x0": x0, "x1": x1, "comp": voxel[first], "shared": zs // block != part["block"][at]}

    packed = bits.with_packed_mask(core(masks, "mask"), "mask")
    return over_blocks(with_block(packed, 0, 1, block), run, {"z": "int", "y": "int", "x0": "int", "x1": "int", "comp": "bigint", "shared": "boolean"})


def global_labels(table: DataFrame) -> DataFrame:
    """volume_id, comp and label of the slab components that meet another slab's.

    ``table`` has runs with the component of their slab; a run of the slice above a slab is ``shared`` there and meets itself.
    """
    met = table.filter("shared").select("volume_id", "z", "y", "x0", F.col("comp").alias("b"))
    edges = table.filter(~F.col("shared")).select("volume_id", "z", "y", "x0", F.col("comp").alias("a")).join(
        met, ["volume_id", "z", "y", "x0"]).select("volume_id", "a", "b")
    return components(edges, ["volume_id"]).select("volume_id", F.col("node").alias("comp"), F.col("component").alias("label"))


def labelled(table: DataFrame) -> DataFrame:
    """The runs of all slabs, each once, with the component of the whole volume instead of the slab's."""
    own = table.filter(~F.col("shared")).drop("shared")
    return own.join(global_labels(table), ["volume_id", "comp"], "left").withColumn(
        "component", F.coalesce("label", "comp")).drop("comp", "label")


def label_runs(masks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Runs of set voxels with their component: volume_id, z, y, x0, x1, component.

    ``masks`` are slices with a 0/1 pixel array ``mask``, or a packed one; touching faces connect.
    """
    return labelled(cut(_slab_table(masks, block)))


def component_sizes(runs: DataFrame) -> DataFrame:
    """Voxels and bounding box of each component; summed before the shuffle."""
    return runs.groupBy("volume_id", "component").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).cast("bigint").alias("voxels"),
        F.min("z").alias("z0"), F.min("y").alias("y0"), F.min("x0").alias("x0"),
        (F.max("z") + 1).alias("z1"), (F.max("y") + 1).alias("y1"), (F.max("x1") + 1).alias("x1"))


def lung_components(runs: DataFrame, shapes: DataFrame) -> DataFrame:
    """The at most two air components per volume taken as lungs.

    Components at a side wall are room air. The second is kept when larger
    than 15 % of the first; equal sizes prefer the later one in scan order.
    """
    walled = component_sizes(runs).join(shapes, "volume_id").filter(
        "y0 > 0 and x0 > 0 and y1 < rows and x1 < cols").select("volume_id", "component", "voxels")
    # Top two by row number: the limit is applied before the shuffle as well.
    w = W.partitionBy("volume_id").orderBy(F.desc("voxels"), F.desc("component"))
    best = walled.withColumn("_rank", F.row_number().over(w)).filter("_rank <= 2")
    largest = F.max("voxels").over(W.partitionBy("volume_id"))
    return best.withColumn("_max", largest).filter(F.col("voxels") > F.col("_max") * SECOND_LUNG_SHARE).select(
        "volume_id", "component", "voxels")


def lung_mask(slices: DataFrame, threshold: int = LUNG_THRESHOLD_HU, block: int = BLOCK, packed: bool = False) -> DataFrame:
    """Lung mask slices from HU slices (X4), as 0/1 arrays or packed.

    Pixels stay where they are: one bit each is sent to be labelled, and runs to be closed and filled.
    """
    air = slices.select("volume_id", "z", "depth", "rows", "cols", bits.packed_below(F.col("px"), F.col("rows"), F.col("cols"), threshold).alias("mask"))
    runs = label_runs(air, block)
    shapes = slices.groupBy("volume_id").agg(F.max("rows").alias("rows"), F.max("cols").alias("cols"))
    kept = runs.join(lung_components(runs, shapes), ["volume_id", "component"], "left_semi")
    return close_and_fill(slices, kept, "mask", block, packed)

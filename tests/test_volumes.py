"""Slice and voxel operators against brute force on small volumes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from longview.operators import blocks as K
from longview.operators import change as G
from longview.operators import components as C
from longview.operators import saliency as A
from longview.operators import slices as S

SHAPE = (10, 12, 14)


def table(spark, volumes, px="px", kind="double"):
    data = [(v, z, a.shape[0], a.shape[1], a.shape[2], a[z].ravel().tolist()) for v, a in volumes.items() for z in range(a.shape[0])]
    return spark.createDataFrame(data, f"volume_id string, z int, depth int, rows int, cols int, {px} array<{kind}>").repartition(3)


def array(df, px, shape, volume=None):
    out = np.zeros(shape)
    for r in df.collect():
        if volume is None or r["volume_id"] == volume:
            out[r["z"]] = np.reshape(r[px], shape[1:])
    return out


def flood(mask, faces=6):
    """Labels by flood fill: the first voxel of a component in scan order."""
    label = -np.ones(mask.shape, int)
    for start in np.argwhere(mask):
        if label[tuple(start)] >= 0:
            continue
        tag, stack = int(np.ravel_multi_index(tuple(start), mask.shape)), [tuple(start)]
        label[tuple(start)] = tag
        while stack:
            p = stack.pop()
            for axis in range(3):
                for d in (-1, 1):
                    q = list(p)
                    q[axis] += d
                    if 0 <= q[axis] < mask.shape[axis] and mask[tuple(q)] and label[tuple(q)] < 0:
                        label[tuple(q)] = tag
                        stack.append(tuple(q))
    return label


@pytest.mark.parametrize("density", [0.25, 0.5])
def test_components_across_slabs(spark, density):
    mask = np.random.default_rng(2).random(SHAPE) < density
    snake = np.zeros(SHAPE, bool)  # one component that winds through every slab
    snake[:, ::2, :] = True
    snake[0, 1::4, -1], snake[-1, 3::4, 0] = True, True
    runs = C.label_runs(table(spark, {"a": mask.astype(int), "b": snake.astype(int)}, "mask", "int"), block=3).collect()
    for name, m in (("a", mask), ("b", snake)):
        got = -np.ones(SHAPE, int)
        for r in runs:
            if r["volume_id"] == name:
                got[r["z"], r["y"], r["x0"]:r["x1"] + 1] = r["component"]
        assert (got == flood(m)).all()


def test_gaussian_reflects_and_blocks_agree(spark):
    vol = np.random.default_rng(3).normal(size=(5, 6, 7))
    w = np.exp(-0.5 * np.arange(-4, 5) ** 2)
    w /= w.sum()
    want = vol
    for axis in range(3):
        pad = [(4, 4) if a == axis else (0, 0) for a in range(3)]
        big = np.pad(want, pad, mode="symmetric")
        want = sum(w[k] * np.take(big, np.arange(want.shape[axis]) + k, axis=axis) for k in range(9))
    df = table(spark, {"a": vol})
    for block in (2, 32):
        assert np.allclose(array(K.gaussian(df, "px", "s", block), "s", vol.shape), want)


def test_erosion_and_closing_treat_outside_as_clear(spark):
    full = table(spark, {"a": np.ones((6, 7, 8), int)}, "mask", "int")
    got = array(K.erode(full, "mask", 2, "m", block=2), "m", (6, 7, 8))
    want = np.zeros((6, 7, 8))
    want[2:-2, 2:-2, 2:-2] = 1
    assert (got == want).all()
    closed = array(K.close(full, "mask", "m", block=3), "m", (6, 7, 8))
    assert closed[0].sum() == 0 and closed[-1].sum() == 0 and closed[1:-1, 1:-1, 1:-1].all()


def phantom():
    """Room air on the walls, two lungs, a gas pocket, a vessel and a nodule hole."""
    hu = np.full((14, 40, 60), 40)
    hu[:, :3, :] = hu[:, -3:, :] = hu[:, :, :3] = hu[:, :, -3:] = -1000
    z, y, x = np.mgrid[:14, :40, :60]
    big = ((y - 20) / 12) ** 2 + ((x - 17) / 9) ** 2 < 1
    small = ((y - 20) / 9) ** 2 + ((x - 43) / 7) ** 2 < 1
    hu[big | small] = -850
    hu[3:5, 18:21, 28:30] = -900  # pocket far below 15 % of the first lung
    hu[:, 20, 15] = 30  # vessel through the lung
    hu[6:8, 22:24, 44:46] = 20  # nodule
    return hu, big, small


def test_lung_mask_of_a_phantom(spark):
    hu, big, small = phantom()
    got = array(C.lung_mask(table(spark, {"a": hu}, "px", "int"), block=5), "mask", hu.shape).astype(bool)
    inner = (big | small)[1:-1]
    assert got[1:-1][inner].all()  # vessel and nodule are filled
    assert not got[:, :3].any() and not got[:, :, :3].any() and not got[4, 19, 29]
    assert not got[0].any() and not got[-1].any()


def test_no_lung_in_solid_tissue(spark):
    assert array(C.lung_mask(table(spark, {"a": np.full(SHAPE, 40)}, "px", "int")), "mask", SHAPE).sum() == 0


MM = 1.5


def sphere(vol, centre, radius_mm, value):
    g = np.indices(vol.shape).transpose(1, 2, 3, 0)
    vol[(((g - np.array(centre)) * MM) ** 2).sum(-1) <= radius_mm ** 2] = value


def regions(spark, baseline, followup, mask=None):
    mask = np.ones(baseline.shape, int) if mask is None else mask
    values = G.difference(table(spark, {"a": baseline}), table(spark, {"a": followup}))
    return sorted(G.find_regions(values, table(spark, {"a": mask}, "interior", "int"), MM, block=16).collect(), key=lambda r: r["rank"])


def air():
    return np.full((40, 60, 60), -850.0)


def test_new_nodule(spark):
    after = air()
    sphere(after, (20, 30, 20), 4, -50)
    (r,) = regions(spark, air(), after)
    assert r["kind"] == "new" and abs(r["diameter_mm"] - 8) <= 2 and r["side"] == "right" and r["slice"] == 20
    assert r["centroid_z_mm"] == pytest.approx(30, abs=0.5) and r["baseline_hu"] == pytest.approx(-850)


def test_growth_and_ranking(spark):
    before, after = air(), air()
    sphere(before, (12, 15, 15), 4, -700)
    sphere(after, (12, 15, 15), 4, -150)
    sphere(after, (28, 42, 42), 7, -100)
    got = regions(spark, before, after)
    assert [r["kind"] for r in got] == ["new", "growth"] and got[0]["volume_mm3"] > got[1]["volume_mm3"] and got[0]["side"] == "left"


def test_rejected_changes(spark):
    tube, solid, edge = air(), air(), air()
    tube[5:35, 30:32, 30] = -50  # elongated
    sphere(solid, (20, 30, 30), 25, -50)  # too large
    sphere(edge, (20, 30, 30), 1, -50)  # too small
    for after in (tube, solid, edge):
        assert regions(spark, air(), after) == []
    was, now = air(), air()
    sphere(was, (20, 30, 30), 4, -200)
    sphere(now, (20, 30, 30), 4, 200)
    assert regions(spark, was, now) == []  # tissue before
    lost = air()
    sphere(lost, (20, 30, 30), 4, -100)
    assert regions(spark, lost, air()) == []  # density lost
    after = air()
    sphere(after, (20, 30, 30), 4, -50)
    assert regions(spark, air(), after, np.zeros(after.shape, int)) == []  # outside the mask


def test_inflation_shift_and_alignment(spark):
    mask = np.zeros(SHAPE, int)
    mask[:, 2:8, 2:8] = 1
    d = np.full(SHAPE, 20.0)
    d[2:4, 3:5, 3:5] = 800.0
    delta, masks = table(spark, {"a": d}, "delta"), table(spark, {"a": mask}, "interior", "int")
    assert G.inflation_shift(delta, masks).first()["shift_hu"] == 20.0
    empty = table(spark, {"a": mask * 0}, "interior", "int")
    assert G.inflation_shift(delta, empty).first()["shift_hu"] == 0.0
    base = table(spark, {"a": np.zeros(SHAPE)})
    stages = table(spark, {"a": d}).withColumns({"stage": F.lit("none"), "stage_order": F.lit(0)})
    got = G.alignment_error(base, stages, empty.withColumnRenamed("interior", "mask")).first()
    assert got["error_hu"] is None


def test_translation_is_found_and_failure_reports_nothing(spark):
    hu, _, _ = phantom()
    noisy = hu + np.random.default_rng(4).integers(-60, 60, hu.shape)
    moved = np.full(hu.shape, -1024)
    moved[:-1] = noisy[1:]
    base, later = table(spark, {"a": noisy}, "px", "int"), table(spark, {"a": moved}, "px", "int")
    pairs, found, *_ = G.compare(base, later, shifts=[(1, 0, 0), (0, 1, 0)], block=6)
    row = pairs.first()
    assert row["selected_stage"] == "shift(1,0,0)" and not row["registration_failed"] and row["alignment_after_hu"] < row["alignment_before_hu"]
    pairs, found, *_ = G.compare(base, base, shifts=[(1, 0, 0)], block=6)
    row = pairs.first()
    assert row["registration_failed"] and row["note"] and row["n_regions"] == 0 and found.count() == 0


def test_later_round_of_another_shape_is_padded_with_air(spark):
    base = table(spark, {"a": np.zeros((3, 2, 3), int)}, "px", "int")
    later = table(spark, {"a": np.arange(8).reshape(2, 2, 2)}, "px", "int")
    got = array(G.onto_grid(later, base), "px", (3, 2, 3))
    assert got[1].tolist() == [[4, 5, -1024], [6, 7, -1024]] and (got[2] == -1024).all()


def profiles(spark, values):
    return spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "volume_id string, z int, total double")


def test_top_slices(spark):
    v = np.zeros(100)
    v[[10, 40, 70]] = [3, 5, 4]
    assert S.top_slices(profiles(spark, v)).first()["top_slices"] == [40, 70, 10]
    v = np.zeros(100)
    v[[50, 51, 52, 80]] = [9, 8, 7, 6]
    assert S.top_slices(profiles(spark, v)).first()["top_slices"] == [50, 80]
    assert S.top_slices(profiles(spark, np.zeros(10))).first()["top_slices"] == []
    dense = np.random.default_rng(5).random(300)  # candidates far beyond the five picked
    want = []
    for i in np.argsort(-dense):
        if all(abs(i - c) >= 5 for c in want) and len(want) < 5:
            want.append(int(i))
    assert S.top_slices(profiles(spark, dense)).first()["top_slices"] == want


def test_change_overlay_scale(spark):
    d = np.zeros((6, 8, 8))
    d[2, 2, 2], d[3, 3, 3] = 600.0, -600.0
    levels, _, top = A.change_overlay(table(spark, {"a": d}, "delta"))
    got = array(levels, "level", d.shape)
    assert got[2, 2, 2] == 182 and got[3, 3, 3] == 0 and top.first()["top_slices"] == [2]


def zoom1(a, n, axis):
    c = np.arange(n) * (a.shape[axis] - 1) / max(n - 1, 1)
    lo = np.floor(c).astype(int)
    hi = np.minimum(lo + 1, a.shape[axis] - 1)
    w = (c - lo).reshape([-1 if i == axis else 1 for i in range(a.ndim)])
    return np.take(a, lo, axis) * (1 - w) + np.take(a, hi, axis) * w


def test_resampling(spark):
    vol = np.random.default_rng(6).integers(-1000, 400, SHAPE)
    df = table(spark, {"a": vol, "b": vol}, "px", "int")
    spacing = spark.createDataFrame([("a", 2.5, 0.7, 0.7), ("b", 1.5, 1.5, 1.5)], "volume_id string, spacing_z double, spacing_y double, spacing_x double")
    out = S.resample_isotropic(df, spacing, 1.5)
    shape = tuple(round(n * s / 1.5) for n, s in zip(SHAPE, (2.5, 0.7, 0.7)))
    want = vol.astype(float)
    for axis in (2, 1, 0):
        want = zoom1(want, shape[axis], axis)
    assert (array(out, "px", shape, "a") == np.trunc(want.astype(np.float32))).all()
    assert (array(out, "px", SHAPE, "b") == vol).all()
    grid = df.withColumns({"out_depth": F.lit(25), "out_rows": F.lit(40), "out_cols": F.lit(1)})
    near = array(S.resample_nearest(grid), "px", (25, 40, 1), "a")
    at = [np.floor(np.arange(n) * (m - 1) / max(n - 1, 1) + 0.5).astype(int) for n, m in zip((25, 40, 1), SHAPE)]
    assert (near == vol[np.ix_(*at)]).all()


def test_slice_order_and_spacing(spark):
    schema = "volume_id string, slice_uid int, position_z double, instance int, thickness double"
    data = [("a", i, 10.0 - 2.5 * i, i, 5.0) for i in range(4)] + [("b", 10, 1.0, 2, 3.0), ("b", 11, None, 1, None), ("c", 20, 5.0, None, 0.0),
            ("d", 30, 1.0, 1, 4.0), ("d", 31, 1.0, 2, 4.0)]
    df = spark.createDataFrame(data, schema)
    got = {r["slice_uid"]: (r["z"], r["depth"]) for r in S.order_slices(df).collect()}
    assert got == {0: (3, 4), 1: (2, 4), 2: (1, 4), 3: (0, 4), 10: (1, 2), 11: (0, 2), 20: (0, 1), 30: (0, 2), 31: (1, 2)}
    assert {r[0]: r[1] for r in S.slice_spacing(df).collect()} == {"a": 2.5, "b": 1.0, "c": 1.0, "d": 4.0}
    assert {r[0]: r[1] for r in S.stored_head_first(df).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_reslice(spark):
    vol = np.arange(24).reshape(2, 3, 4)
    df = table(spark, {"a": vol}, "px", "int")
    coronal = {r["plane_index"]: r["px"] for r in S.reslice(df, "coronal").collect()}
    assert coronal[1] == vol[::-1, 1, :].ravel().tolist()
    sagittal = {r["plane_index"]: r["px"] for r in S.reslice(df, "sagittal").collect()}
    assert sagittal[3] == vol[::-1, :, 3].ravel().tolist()


def test_slices_go_to_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        slices = spark.createDataFrame([("a", 0, 1, 1, 2, [1, 2])], "volume_id string, z int, depth int, rows int, cols int, px array<int>")
        K.gaussian(slices, "px")
        assert int(spark.conf.get(key)) <= 1000
    finally:
        spark.conf.set(key, before)

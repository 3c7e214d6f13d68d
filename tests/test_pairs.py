"""Aligned pairs, their overlays, packed slices and the merge of slab components."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from longview.operators import bits
from longview.operators import blocks as K
from longview.operators import change as G
from longview.operators import components as C
from longview.operators import saliency as A
from longview.operators.align import move_errors, search_moves, shrink
from longview.operators.graph import components, forest
from longview.plans.overlays import change_overlays, overlay_path
from test_volumes import array, flood, phantom, table


def blobs(shape, seed=1):
    """Smooth structure on which a shift can be told."""
    rng = np.random.default_rng(seed)
    grid = np.stack(np.meshgrid(*[np.arange(n) for n in shape], indexing="ij"), -1)
    out = np.full(shape, -900.0)
    for _ in range(12):
        centre = rng.uniform(0, 1, 3) * shape
        out += 700 * np.exp(-((grid - centre) ** 2).sum(-1) / (2 * rng.uniform(2, 4) ** 2))
    return out.round().astype(int)


def moved_by(a, move):
    out = np.full(a.shape, -1024)
    src = tuple(slice(max(-m, 0), max(n - max(m, 0), 0)) for m, n in zip(move, a.shape))
    dst = tuple(slice(max(m, 0), max(n - max(-m, 0), 0)) for m, n in zip(move, a.shape))
    out[dst] = a[src]
    return out


@pytest.mark.parametrize("cols", [1, 14, 64, 70, 131])
def test_words_match_plain_morphology(cols):
    mask = np.random.default_rng(cols).random((5, 6, cols)) < 0.6
    words = bits.words_of([bits.mask_bytes(s) for s in mask], 6, cols)
    assert (bits.booleans(words, cols) == mask).all() and (words == bits.words_from(mask)).all()
    assert bits.slice_bytes(words, cols) == [bits.mask_bytes(s) for s in mask]
    big = np.pad(mask, 1)
    cube = [big[a:a + 5, b:b + 6, c:c + cols] for a in range(3) for b in range(3) for c in range(3)]
    assert (bits.booleans(bits.grown(words, cols), cols) == np.any(cube, axis=0)).all()
    assert (bits.booleans(bits.shrunk(words), cols) == np.all(cube, axis=0)).all()


@pytest.mark.parametrize("values, tag", [([0, -32768, 32767], b"h"), ([40000, -1], b"i"), ([2 ** 40], b"q"), ([0.5, float("nan")], b"d"), ([], b"h")])
def test_pixels_are_packed_without_loss(values, tag):
    a = np.array(values) if values else np.empty(0, int)
    packed = bits.pixel_bytes(a)
    assert packed[:1] == tag and np.array_equal(bits.plane(packed, 1, len(values))[0], a, equal_nan=tag == b"d")


def test_columns_are_packed_and_unpacked(spark):
    mask = (np.random.default_rng(3).random((3, 4, 70)) < 0.5).astype(int)
    df = bits.with_packed_mask(table(spark, {"a": mask}, "mask", "int"), "mask")
    assert bits.is_packed(df, "mask") and bits.with_packed_mask(df, "mask") is df
    again = df.select("volume_id", "z", bits.pixels(F.col("mask"), F.col("rows"), F.col("cols")).alias("m"), bits.count_set(F.col("mask")).alias("n"))
    assert (array(again, "m", mask.shape) == mask).all() and again.agg(F.sum("n")).first()[0] == mask.sum()
    assert len(df.first()["mask"]) == 1 + 4 * 9


def test_long_path_of_slab_components_needs_few_rounds(spark):
    n = 10_000
    order = np.random.default_rng(5).permutation(n).astype(np.int64)
    edges = [("deep", int(a), int(b)) for a, b in zip(order, order[1:])] + [("deep", n + 1, n + 2), ("other", 4, 3), ("other", 3, 4), ("loop", 1, 1)]
    counter = []
    got = components(spark.createDataFrame(edges, "volume_id string, a long, b long"), ["volume_id"], counter).collect()
    assert {(r["volume_id"], r["node"]): r["component"] for r in got} == {**{("deep", i): 0 for i in range(n)}, ("deep", n + 1): n + 1, ("deep", n + 2): n + 1, ("other", 3): 3, ("other", 4): 3}
    assert len(got) == n + 4 and len(counter) <= math.ceil(math.log2(n))


def test_path_without_contraction_still_needs_few_rounds(spark, monkeypatch):
    monkeypatch.setattr("longview.operators.graph._contracted", lambda edges, keys: edges.distinct())
    edges = spark.createDataFrame([(i, i + 1) for i in range(2000)], "a long, b long")
    counter = []
    assert {r["component"] for r in components(edges, (), counter).collect()} == {0} and len(counter) <= 2 * math.ceil(math.log2(2000))


def test_forest_names_the_smallest():
    a, b = forest(np.array([5, 9, 2]), np.array([9, 7, 3]))
    assert dict(zip(a.tolist(), b.tolist())) == {9: 5, 7: 5, 3: 2}


def test_deep_snake_in_blocks_of_one(spark):
    snake = np.zeros((60, 5, 9), bool)
    snake[:, 1::2, 1] = True
    snake[::2, 2, 1], snake[1, 2, 1] = False, True  # joined once
    runs = C.label_runs(table(spark, {"a": snake.astype(int)}, "mask", "int"), block=1).collect()
    want = flood(snake)
    assert all(r["component"] == want[r["z"], r["y"], r["x0"]] for r in runs) and len(runs) > 100


@pytest.mark.parametrize("move", [(8, -8, 8), (-3, 5, -7), (0, 0, 0), (0, 8, 0)])
def test_search_finds_far_moves(spark, move):
    early = blobs((26, 36, 40))
    later = moved_by(early, tuple(-m for m in move))
    mask = np.zeros(early.shape, int)
    mask[9:-9, 9:-9, 9:-9] = 1
    frames = [table(spark, {"a": v}, "px", "int") for v in (early, later)]
    got = search_moves(*frames, table(spark, {"a": mask}, "mask", "int"), 8).collect()
    best = min(got, key=lambda r: (r["error_hu"], r["stage_order"]))
    assert (best["dz"], best["dy"], best["dx"]) == move and best["error_hu"] == 0 and best["stage"] == ("none" if not any(move) else "shift(%d,%d,%d)" % move)
    for r in got:  # as an exhaustive search has it
        diff = np.abs(moved_by(later, (r["dz"], r["dy"], r["dx"])).astype(float) - early)
        assert r["error_hu"] == pytest.approx(diff[mask == 1].mean(), rel=1e-12)


def test_given_moves_match_the_stage_form(spark):
    early, later = blobs((6, 9, 11)), blobs((6, 9, 11), 2)
    mask = (np.random.default_rng(2).random(early.shape) < 0.4).astype(int)
    moves = [(1, 0, 0), (-2, 3, -4), (0, -9, 0), (7, 0, 0)]
    a, b, m = (table(spark, {"a": v, "b": v * k}, c, "int") for v, c, k in ((early, "px", 1), (later, "px", 1), (mask, "mask", 0)))
    got = {(r["volume_id"], r["stage_order"]): r["error_hu"] for r in move_errors(a, b, m, moves).collect()}
    stages = None
    for i, move in enumerate([(0, 0, 0), *moves]):
        own = table(spark, {"a": moved_by(later, move), "b": later}, "px", "int").withColumns({"stage": F.lit(str(i)), "stage_order": F.lit(i)})
        stages = own if stages is None else stages.unionByName(own)
    want = {(r["volume_id"], r["stage_order"]): r["error_hu"] for r in G.alignment_error(a, stages, m).collect()}
    assert got == pytest.approx(want) and got["b", 0] is None


def test_shrink_takes_means_of_ragged_blocks(spark):
    vol, mask = blobs((5, 7, 6)), (np.random.default_rng(1).random((5, 7, 6)) < 0.5).astype(int)
    df = bits.with_packed_pixels(table(spark, {"a": vol}, "px", "int").join(table(spark, {"a": mask}, "mask", "int"), ["volume_id", "z", "depth", "rows", "cols"]), "px")
    rows = shrink(bits.with_packed_mask(df, "mask"), 4, "px", "mask").collect()
    assert len(rows) == 2
    for r in rows:
        for y in range(2):
            for x in range(2):
                box = np.s_[r["z"] * 4:r["z"] * 4 + 4, y * 4:y * 4 + 4, x * 4:x * 4 + 4]
                assert bits.plane(r["px"], 2, 2)[y, x] == pytest.approx(vol[box].mean()) and bits.plane(r["mask"], 2, 2)[y, x] == mask[box].sum()


def pair(spark, early, later, **options):
    return G.compare(table(spark, {7: early}, "px", "int").withColumn("volume_id", F.lit(7)), table(spark, {7: later}, "px", "int").withColumn("volume_id", F.lit(7)), block=6, **options)


def overlay(spark, compared, shape=(14, 40, 60), **options):
    pairs = spark.createDataFrame([(7, "p", "T0")], "volume_id int, patient_id string, from_round string")
    entries = spark.createDataFrame([("p", "T0", *shape), ("p", "T1", 3, 3, 3)], "patient_id string, round string, out_depth int, out_rows int, out_cols int")
    return change_overlays(compared, pairs, entries, **options)


def test_a_shifted_pair_leaves_an_empty_overlay(spark):
    hu, _, _ = phantom()
    noisy = hu + np.random.default_rng(4).integers(-60, 60, hu.shape)
    later = np.full(hu.shape, -1024)
    later[:-1, :-3, 2:] = noisy[1:, 3:, :-2]
    shown = overlay(spark, pair(spark, noisy, later, reach=4))
    assert not array(shown.slices, "level", hu.shape).any() and shown.top.first()["top_slices"] == [] and shown.profile.agg(F.max("total")).first()[0] == 0
    # Leaving the pair unaligned would show the misalignment instead.
    kept = pair(spark, noisy, later)
    assert kept.pairs.first()["registration_failed"] and array(overlay(spark, kept).slices, "level", hu.shape).any()


def test_the_shift_is_taken_off_on_request_only(spark):
    hu, _, _ = phantom()
    later = hu + 150
    later[6:8, 16:19, 14:17] += 500
    compared = pair(spark, hu, later)
    assert compared.shift.first()["shift_hu"] == 150
    whole, less = (array(overlay(spark, compared, subtract_shift=s).slices, "level", hu.shape) for s in (False, True))
    inside = array(compared.slices.select("volume_id", "z", bits.pixels(F.col("interior"), F.col("rows"), F.col("cols")).alias("m")), "m", hu.shape) == 1
    assert (whole[inside] > 0).all() and not whole[~inside].any()
    assert less[6, 17, 15] == round((500 - 100) / 700 * 255) and (less > 0).sum() < (whole > 0).sum()


def test_overlays_go_to_their_entry_or_stay(spark):
    hu, _, _ = phantom()
    later = hu.copy()
    later[6:8, 16:19, 14:17] += 600
    compared = pair(spark, hu, later)
    same = array(overlay(spark, compared).slices, "level", hu.shape)
    assert same[6, 17, 15] > 0
    wide = overlay(spark, compared, (28, 20, 60))
    at = [np.floor(np.arange(n) * (m - 1) / (n - 1) + 0.5).astype(int) for n, m in zip((28, 20, 60), hu.shape)]
    assert (array(wide.slices, "level", (28, 20, 60)) == same[np.ix_(*at)]).all() and wide.profile.count() == 28
    assert {r["depth"] for r in wide.slices.select("depth").collect()} == {28} and wide.top.first()["top_slices"]
    none = change_overlays(compared, spark.createDataFrame([(7, "p", "T0")], "volume_id int, patient_id string, from_round string"),
                           spark.createDataFrame([], "patient_id string, round string, out_depth int, out_rows int, out_cols int"))
    assert (array(none.slices, "level", hu.shape) == same).all()
    row = spark.range(1).select(overlay_path(F.lit("T0"), F.lit("T1")).alias("p")).first()
    assert row["p"] == "overlays/change_T0_T1"


def test_rounds_of_unlike_spacing_are_put_on_one_grid(spark):
    hu, _, _ = phantom()
    early = np.repeat(hu, 2, axis=0)
    near = lambda z, y, x: spark.createDataFrame([(7, z, y, x)], "volume_id int, spacing_z double, spacing_y double, spacing_x double")
    got = pair(spark, early, hu, spacing=near(1.5, 1.5, 1.5), later_spacing=near(3.0, 1.5, 1.5))
    row = got.pairs.first()
    assert row["shape"] == [28, 40, 60] and got.slices.count() == 28
    wide = pair(spark, np.repeat(hu, 2, axis=2), hu, spacing=near(1.5, 1.5, 0.75), later_spacing=near(1.5, 1.5, 1.5))
    assert wide.pairs.first()["shape"] == [14, 40, 60] and wide.slices.count() == 14
    assert wide.pairs.first()["from_lung_ml"] == pytest.approx(wide.pairs.first()["to_lung_ml"], rel=0.1)


def test_percentiles_of_merged_counts(spark):
    rng = np.random.default_rng(8)
    parts = [rng.integers(-900, -850, n) for n in (1, 7, 30)]
    rows = [([dict(zip(("values", "counts"), (x.astype(float).tolist(), n.tolist()))) for x, n in (np.unique(p, return_counts=True) for p in parts[:k])],) for k in (1, 2, 3)]
    df = spark.createDataFrame(rows, "parts array<struct<values:array<double>,counts:array<bigint>>>")
    got = [r[0] for r in df.select(G.percentile_of_counts(F.col("parts"), 0.9)).collect()]
    assert sorted(got) == pytest.approx(sorted(np.percentile(np.concatenate(parts[:k]), 90) for k in (1, 2, 3)))


def test_interior_is_that_of_the_regions(spark):
    hu, _, _ = phantom()
    compared = pair(spark, hu, hu)
    m = array(C.lung_mask(table(spark, {"a": hu}, "px", "int"), block=5), "mask", hu.shape)
    from longview.operators import blocks as K
    want = array(K.erode(table(spark, {"a": m.astype(int)}, "mask", "int"), "mask", 2, "i", 3), "i", hu.shape)
    got = G.unpacked(compared.slices, mask=True)
    assert (array(got, "interior", hu.shape) == want).all() and not array(got, "delta", hu.shape).any()
    assert not array(A.pair_change(compared.slices), "px", hu.shape).any()


def test_small_blocks_are_not_drawn_into_one_task(spark):
    rows = [(v, z, 3, 4, 5, bits.mask_bytes(np.ones((4, 5)))) for v in range(8) for z in range(3)]
    masks = spark.createDataFrame(rows, "volume_id long, z int, depth int, rows int, cols int, mask binary")
    assert K.erode(masks, "mask", 1, "m", block=2, packed=True).rdd.getNumPartitions() == 4


def test_blocks_are_whole_whatever_the_batches():
    ids, at = [None, None, None, 7, 7, 7, 7, 2**60 + 1, 2**60 + 2], [0, 0, 1, 1, 1, 1, 2, 2, 2]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int64())], names=["volume_id", "block"])
    for size in (1, 2, 4, 9):
        tables = list(K._whole_blocks(batch.slice(i, size) for i in range(0, 9, size)))
        found = [(t.column("volume_id")[int(s)].as_py(), t.column("block")[int(s)].as_py()) for t in tables for s in K._starts(t)]
        assert found == [(None, 0), (None, 1), (7, 1), (7, 2), (2**60 + 1, 2), (2**60 + 2, 2)]
        assert sum(t.num_rows for t in tables) == 9


def test_blocks_worked_on_together_do_not_touch():
    rng = np.random.default_rng(4)
    sizes, depth = [3, 1, 6, 6], [3, 1, 9, 9]  # the last two are a volume's ends
    first = [0, 0, 0, 3]
    of, zs = np.repeat(np.arange(4), sizes), np.concatenate([np.arange(n) + f for n, f in zip(sizes, first)])
    stack, deep = rng.normal(size=(16, 5, 6)), np.repeat(depth, sizes)
    alone = [K.gaussian_stack(stack[of == g], zs[of == g], deep[of == g], np.zeros(sizes[g], int)) for g in range(4)]
    assert (K.gaussian_stack(stack, zs, deep, of) == np.concatenate(alone)).all()
    part = K.Part(pa.table({"z": zs}), of, 5, 6)
    words, at, gaps = part.gapped(bits.words_from(stack > -0.5))
    for step in (K.close_words, lambda m, cols, gaps: bits.shrunk(m, 2), lambda m, cols, gaps: bits.grown(m, cols)):
        want = [step(bits.words_from(stack[of == g] > -0.5), 6, np.empty(0, int)) for g in range(4)]
        assert (step(words, 6, gaps)[at] == np.concatenate(want)).all()

"""Registered queries over pairs of rounds: difference, alignment, regions, overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longview.functions import voxel as V
from longview.operators import blocks as K
from longview.operators import change as G
from longview.operators import components as C
from longview.operators import saliency as A
from longview.operators.align import move_errors, search_moves
from longview.plans.overlays import change_overlays

from . import base as B
from .base import CHEST_SQL, duck_joined, joined
from .volumes import OWN, TOP_SQL, components_sql, gaussian_sql, lung_sql, neighbourhood_sql, zoom_sql

SHIFTS = [(1, 0, 0), (-1, 0, 0), (0, 0, 1), (0, 1, 0)]
LIMITS = {"min_diameter_mm": 1.8, "baseline_air_hu": 0.0}  # the stand-in volumes are noise on a small grid
MIN_DELTA = 60.0


def _pairs(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Earlier and later volume of each pair, both keyed by the earlier one.

    Three volumes in a row are a patient's rounds; pairs do not cross patients.
    """
    c = B.chest(spark, sf)
    ids = c.select(F.col("volume_id").alias("_v")).distinct()
    base = c.filter(F.col("volume_id") % 3 < 2).join(ids, F.col("volume_id") + 1 == F.col("_v"), "left_semi")
    later = c.filter(F.col("volume_id") % 3 > 0).withColumn("volume_id", F.col("volume_id") - 1)
    return base, later


PAIR_SQL = f"""{CHEST_SQL},
early AS (SELECT * FROM chest WHERE volume_id % 3 < 2 AND volume_id + 1 IN (SELECT volume_id FROM chest)),
late AS (SELECT b.volume_id, b.z, b.depth, b.y, b.x, b.p, coalesce(l.hu, -1024) AS hu FROM early b LEFT JOIN chest l ON l.volume_id = b.volume_id + 1 AND l.z = b.z AND l.y = b.y AND l.x = b.x)"""


def _stage_sql() -> str:
    parts = ["SELECT volume_id, z, y, x, hu, 'none' AS stage, 0 AS stage_order FROM late"]
    for i, (dz, dy, dx) in enumerate(SHIFTS):
        parts.append(f"""SELECT a.volume_id, a.z, a.y, a.x, coalesce(b.hu, -1024), 'shift({dz},{dy},{dx})', {i + 1} FROM late a
          LEFT JOIN late b ON b.volume_id = a.volume_id AND b.z = a.z - {dz} AND b.y = a.y - {dy} AND b.x = a.x - {dx}""")
    return f"stages AS ({' UNION ALL '.join(parts)})"


# The lungs without the fill and closing steps would differ, so the whole mask is rebuilt.
ERROR_SQL = f"""{PAIR_SQL}, {lung_sql('early', -320, 'lung')}, {_stage_sql()},
errors AS (SELECT volume_id, stage, stage_order, avg(abs(s.hu - e.hu)) FILTER (v = 1) AS error_hu FROM stages s JOIN early e USING (volume_id, z, y, x)
  JOIN lung USING (volume_id, z, y, x) GROUP BY ALL),
best AS (SELECT volume_id, arg_min(stage, (error_hu, stage_order)) AS selected_stage, min(error_hu) AS after_hu, max(error_hu) FILTER (stage = 'none') AS before_hu FROM errors GROUP BY 1)"""
SHIFT_SQL = f"""{ERROR_SQL}, {neighbourhood_sql('lung', 'v', 'min', 'interior', 2)},
delta AS (SELECT e.volume_id, e.z, e.depth, e.y, e.x, e.p, e.hu AS baseline, s.hu AS followup, s.hu - e.hu AS d, i.v AS inside FROM early e
  JOIN best USING (volume_id) JOIN stages s ON s.volume_id = e.volume_id AND s.stage = selected_stage AND s.z = e.z AND s.y = e.y AND s.x = e.x
  JOIN interior i ON i.volume_id = e.volume_id AND i.z = e.z AND i.y = e.y AND i.x = e.x),
shift AS (SELECT volume_id, coalesce(median(d) FILTER (inside = 1), 0) AS shift_hu FROM delta GROUP BY 1)"""


def regions_sql(values: str, threshold: float, min_mm: float, air: float) -> str:
    """Ranked regions of ``values`` (… d, baseline, followup, inside)."""
    lo, hi = V.sphere_volume(min_mm), V.sphere_volume(V.MAX_DIAMETER_MM)
    return f"""{gaussian_sql(values, 'd', 'smooth')},
hot AS (SELECT s.*, t.baseline, t.followup FROM smooth s JOIN {values} t USING (volume_id, z, y, x) WHERE s.v > {threshold} AND inside = 1),
{components_sql('hot', 'rc')},
lit AS (SELECT h.*, component FROM hot h JOIN rc USING (volume_id, z, y, x)),
per_slice AS (SELECT volume_id, component, z, sum(abs(v)) AS a FROM lit GROUP BY ALL),
peak AS (SELECT volume_id, component, arg_min(z, (-a, z)) AS slice FROM per_slice GROUP BY 1, 2),
feat AS (SELECT volume_id, component, count(*) AS voxels, min(z) AS z0, min(y) AS y0, min(x) AS x0, max(z) + 1 AS z1, max(y) + 1 AS y1, max(x) + 1 AS x1,
  count(*) * 3.375::DOUBLE AS volume_mm3, quantile_cont(baseline, 0.9) AS p90, avg(v) AS mean_delta_hu, max(v) AS peak_delta_hu, avg(baseline) AS baseline_hu, avg(followup) AS followup_hu,
  avg(z) * 1.5 AS cz, avg(y) * 1.5 AS cy, avg(x) * 1.5 AS cx FROM lit GROUP BY 1, 2),
regions AS (SELECT *, voxels / ((z1 - z0) * (y1 - y0) * (x1 - x0)) AS fill_fraction, greatest(z1 - z0, y1 - y0, x1 - x0) / least(z1 - z0, y1 - y0, x1 - x0)::DOUBLE AS elongation,
  2 * pow(3 * volume_mm3 / (4 * pi()), 1 / 3.0::DOUBLE) AS diameter_mm, CASE WHEN (x0 + x1) / 2.0 < 8 THEN 'right' ELSE 'left' END AS side,
  CASE WHEN baseline_hu < -800 THEN 'new' ELSE 'growth' END AS kind FROM feat JOIN peak USING (volume_id, component)
  WHERE volume_mm3 BETWEEN {lo!r}::DOUBLE AND {hi!r}::DOUBLE AND p90 < {air} AND followup_hu > -600),
kept AS (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY mean_delta_hu * volume_mm3 DESC, component) AS rank FROM regions WHERE fill_fraction >= 0.3 AND elongation <= 3)"""


REGION_FIELDS = ["volume_id", "component", "rank", "slice", "z0", "y0", "x0", "z1", "y1", "x1", "voxels", "kind", "side"]
REGION_NUMBERS = ["volume_mm3", "fill_fraction", "elongation", "mean_delta_hu", "peak_delta_hu", "baseline_hu", "followup_hu", "diameter_mm"]
REGION_SELECT = ", ".join([*REGION_FIELDS, *(f"round({c}, 5) AS {c}" for c in REGION_NUMBERS), "round(cz, 5) AS centroid_z_mm", "round(cy, 5) AS centroid_y_mm", "round(cx, 5) AS centroid_x_mm"])


def _region_view(regions: DataFrame) -> DataFrame:
    return regions.select(*REGION_FIELDS, *[F.round(c, 5).alias(c) for c in [*REGION_NUMBERS, "centroid_z_mm", "centroid_y_mm", "centroid_x_mm"]])


def _difference(spark, sf) -> DataFrame:
    base, later = _pairs(spark, sf)
    d = G.difference(base, G.onto_grid(later, base))
    return d.select(*OWN, joined("delta").alias("delta"), joined(V.clip_delta(F.col("delta"))).alias("stored"))


def _compare(spark, sf, block: int = K.BLOCK):
    base, later = _pairs(spark, sf)
    return G.compare(base, later, shifts=SHIFTS, min_hu_delta=MIN_DELTA, block=block, **LIMITS)


def _errors(spark, sf) -> DataFrame:
    base, later = _pairs(spark, sf)
    return move_errors(base, G.onto_grid(later, base), C.lung_mask(base, packed=True), SHIFTS)


REACH = 2


def _search(spark, sf) -> DataFrame:
    """The moves that a coarse-to-fine search scores last: block means of two voxels first, then the voxels."""
    base, later = _pairs(spark, sf)
    errors = search_moves(base, G.onto_grid(later, base), C.lung_mask(base, packed=True), REACH)
    return errors.select("volume_id", "stage", "stage_order", "dz", "dy", "dx", F.round("error_hu", 6).alias("error_hu"))


_AROUND = "(SELECT z AS mz, y AS my, x AS mx FROM (SELECT unnest([-1, 0, 1]) AS z) a, (SELECT unnest([-1, 0, 1]) AS y) b, (SELECT unnest([-1, 0, 1]) AS x) c)"
SEARCH_SQL = f"""{PAIR_SQL}, {lung_sql('early', -320, 'lung')},
coarse AS (SELECT volume_id, z // 2 AS z, y // 2 AS y, x // 2 AS x, avg(e.hu) AS a, avg(l.hu) AS b, sum(v) AS w FROM early e JOIN late l USING (volume_id, z, y, x) JOIN lung USING (volume_id, z, y, x) GROUP BY ALL),
first AS (SELECT a.volume_id, mz, my, mx, sum(a.w * abs(coalesce(b.b, -1024) - a.a)) / nullif(sum(a.w), 0) AS e FROM coarse a, {_AROUND} m
  LEFT JOIN coarse b ON b.volume_id = a.volume_id AND b.z = a.z - mz AND b.y = a.y - my AND b.x = a.x - mx GROUP BY ALL),
near AS (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY round(e, 6) NULLS LAST, abs(mz) + abs(my) + abs(mx), mz, my, mx) AS i FROM first),
moves AS (SELECT DISTINCT volume_id, 0 AS dz, 0 AS dy, 0 AS dx, 0 AS stage_order FROM early UNION ALL SELECT volume_id, 2 * n.mz + m.mz, 2 * n.my + m.my, 2 * n.mx + m.mx,
  (m.mz + 1) * 9 + (m.my + 1) * 3 + m.mx + 2 FROM near n, {_AROUND} m WHERE i = 1 AND NOT (2 * n.mz + m.mz = 0 AND 2 * n.my + m.my = 0 AND 2 * n.mx + m.mx = 0))
SELECT m.volume_id, CASE WHEN stage_order = 0 THEN 'none' ELSE format('shift({{}},{{}},{{}})', dz, dy, dx) END AS stage, stage_order, dz, dy, dx,
  round(avg(abs(coalesce(l.hu, -1024) - e.hu)) FILTER (v = 1), 6) AS error_hu FROM moves m JOIN early e USING (volume_id) JOIN lung USING (volume_id, z, y, x)
  LEFT JOIN late l ON l.volume_id = m.volume_id AND l.z = e.z - dz AND l.y = e.y - dy AND l.x = e.x - dx GROUP BY m.volume_id, stage_order, dz, dy, dx"""


def _shift(spark, sf) -> DataFrame:
    base, later = _pairs(spark, sf)
    d = G.difference(base, G.onto_grid(later, base))
    return G.inflation_shift(d, K.erode(C.lung_mask(base), "mask", 2, "interior"))


PLAIN_SQL = f"""{PAIR_SQL}, {lung_sql('early', -320, 'lung')}, {neighbourhood_sql('lung', 'v', 'min', 'interior', 2)},
delta AS (SELECT e.*, e.hu AS baseline, l.hu AS followup, l.hu - e.hu AS d, i.v AS inside FROM early e JOIN late l USING (volume_id, z, y, x) JOIN interior i USING (volume_id, z, y, x))"""


def _find(spark, sf, block: int = K.BLOCK) -> DataFrame:
    base, later = _pairs(spark, sf)
    values = G.difference(base, G.onto_grid(later, base))
    return _region_view(G.find_regions(values, K.erode(C.lung_mask(base, block=block), "mask", 1, "interior", block), 1.5, MIN_DELTA, block, **LIMITS))


def _candidates(spark, sf) -> DataFrame:
    """Smoothed difference above the threshold under the mask."""
    base, later = _pairs(spark, sf)
    smooth = K.gaussian(G.difference(base, G.onto_grid(later, base)), "delta")
    under = smooth.join(C.lung_mask(base).select(*OWN, "mask"), OWN)
    return under.select(*OWN, F.posexplode(F.zip_with("smoothed", "mask", lambda v, m: F.when((m != 0) & (v > MIN_DELTA), v))).alias("p", "v")).filter(
        "v is not null").withColumn("v", F.round("v", 4))


def _pair_table(spark, sf, block: int = K.BLOCK) -> DataFrame:
    return _pair_view(_compare(spark, sf, block))


def _pair_view(compared: G.Comparison) -> DataFrame:
    return compared.pairs.select("volume_id", "selected_stage", "alignment_before_hu", "alignment_after_hu", "registration_failed", "alignment_improved",
                        "inflation_shift_hu", "n_regions", "from_lung_ml", "to_lung_ml", "note")


def _region_table(spark, sf, block: int = K.BLOCK) -> DataFrame:
    return _region_view(_compare(spark, sf, block).regions)


ISO_MM = 1.5


def _compare_iso(spark, sf) -> G.Comparison:
    """Rounds of unlike slice spacing, put on a cubic grid before they are compared; a later round may end up shallower or deeper."""
    base, later = _pairs(spark, sf)

    def spacing(df: DataFrame, own) -> DataFrame:
        return df.select("volume_id").distinct().withColumns({"spacing_z": F.when(own % 2 == 0, 2.0).otherwise(1.2), "spacing_y": F.lit(ISO_MM), "spacing_x": F.lit(ISO_MM)})

    v = F.col("volume_id")
    return G.compare(base, later, spacing(base, v), ISO_MM, SHIFTS, min_hu_delta=MIN_DELTA, later_spacing=spacing(later, v + 1), **LIMITS)


_ISO_DEPTH = "CAST(round_even(depth * CASE WHEN volume_id % 2 = 0 THEN 2.0::DOUBLE ELSE 1.2::DOUBLE END / 1.5::DOUBLE, 0) AS INT)"
ISO_SQL = f"""{CHEST_SQL.replace('chest AS', 'stored AS')}, {zoom_sql('stored', 'hu', f'SELECT DISTINCT volume_id, depth AS nz, {_ISO_DEPTH} AS oz, 16 AS oy, 16 AS ox FROM stored')},
chest AS (SELECT volume_id, k AS z, {_ISO_DEPTH.replace('depth', 'nz')} AS depth, j AS y, i AS x, j * 16 + i AS p, CAST(trunc(v::FLOAT) AS INT) AS hu
  FROM along_z JOIN dims USING (volume_id))"""


def _overlay(spark, sf, subtract_shift: bool = False):
    """Overlays of the compared pairs on the grids of their entries: a third of the rounds has none, a third the pair's own grid."""
    c = B.chest(spark, sf)
    compared = _compare(spark, sf)
    v, key = F.col("volume_id"), F.floor(F.col("volume_id") / 3)
    name = F.concat(F.lit("T"), (v % 3).cast("string"))
    pairs = compared.pairs.select("volume_id", key.alias("patient_id"), name.alias("from_round"))
    other = v % 4 != 1
    entries = c.groupBy("volume_id").agg(F.max("depth").alias("depth")).select(
        F.when(v % 4 == 3, -1 - key).otherwise(key).alias("patient_id"), name.alias("round"), F.when(other, F.col("depth") + 5).otherwise(F.col("depth")).alias("out_depth"),
        F.when(other, 10 + v % 7).otherwise(16).cast("int").alias("out_rows"), F.when(other, 9).otherwise(16).alias("out_cols"))
    return change_overlays(compared, pairs, entries, subtract_shift)


def _overlay_levels(spark, sf, subtract_shift: bool = False) -> DataFrame:
    compared = _compare(spark, sf)
    levels, _, _ = A.pair_overlay(compared.slices, compared.shift if subtract_shift else None)
    return levels.select(*OWN, joined("level").alias("level"))


def overlay_sql(change: str) -> str:
    return f"""{SHIFT_SQL}, up AS (SELECT volume_id, z, depth, y, x, p, greatest({change}, 0) * inside AS c FROM delta JOIN shift USING (volume_id)),
levels AS (SELECT *, CAST(round_even((greatest(least((c - 100)::FLOAT / 700::FLOAT, 1), 0) * 255::FLOAT)::DOUBLE, 0) AS INT) AS level FROM up),
sums AS (SELECT volume_id, z, depth, sum(c)::DOUBLE AS total FROM up GROUP BY ALL), prof AS (SELECT *, total / greatest(max(total) OVER (PARTITION BY volume_id), 1e-6) AS share FROM sums)"""


OVERLAY_SQL = overlay_sql("d")
SHOWN_SQL = TOP_SQL.replace("best AS", "shown AS")


def _overlay_top(spark, sf) -> DataFrame:
    top = A.pair_overlay(_compare(spark, sf).slices)[2]
    return top.select("volume_id", joined("top_slices").alias("top_slices"))


def _shapes(df: DataFrame) -> DataFrame:
    return df.select("volume_id").distinct().select("volume_id", F.lit(17).alias("out_depth"), F.lit(23).alias("out_rows"), F.lit(9).alias("out_cols"))


_STAYS = "CASE WHEN volume_id % 4 IN (1, 3) THEN"
GRID_SQL = f"""{OVERLAY_SQL}, grid AS (SELECT volume_id, depth AS nz, {_STAYS} depth ELSE depth + 5 END AS oz, {_STAYS} 16 ELSE 10 + volume_id % 7 END AS oy, {_STAYS} 16 ELSE 9 END AS ox
  FROM (SELECT DISTINCT volume_id, depth FROM levels))"""
OVERLAY_GRID_SQL = f"""WITH RECURSIVE {GRID_SQL} SELECT volume_id, z, {duck_joined('level')} AS level FROM (SELECT v.volume_id, k AS z, j * ox + i AS p, level
  FROM (SELECT *, unnest(range(oz)) AS k FROM grid) d, (SELECT unnest(range(16)) AS j) jj, (SELECT unnest(range(16)) AS i) ii
  JOIN levels v ON v.volume_id = d.volume_id AND j < oy AND i < ox AND v.z = CAST(floor(k * (nz - 1) / greatest(oz - 1, 1)::DOUBLE + 0.5) AS INT)
  AND v.y = CAST(floor(j * 15 / (oy - 1)::DOUBLE + 0.5) AS INT) AND v.x = CAST(floor(i * 15 / (ox - 1)::DOUBLE + 0.5) AS INT)) GROUP BY volume_id, z"""
GRID_PROFILE_SQL = f"""{GRID_SQL}, moved AS (SELECT volume_id, k AS z, a.share * (1 - (c - lo)) + b.share * (c - lo) AS total FROM
  (SELECT *, k * (nz - 1) / greatest(oz - 1, 1)::DOUBLE AS c, CAST(floor(k * (nz - 1) / greatest(oz - 1, 1)::DOUBLE) AS INT) AS lo FROM (SELECT *, unnest(range(oz)) AS k FROM grid)) d
  JOIN prof a USING (volume_id) JOIN prof b USING (volume_id) WHERE a.z = lo AND b.z = least(lo + 1, nz - 1))"""


def _overlay_grid(spark, sf) -> DataFrame:
    return _overlay(spark, sf).slices.select(*OWN, joined("level").alias("level"))


def _overlay_grid_profile(spark, sf) -> DataFrame:
    return _overlay(spark, sf).profile.select(*OWN, F.round("share", 7).alias("share"))


def _overlay_grid_top(spark, sf) -> DataFrame:
    return _overlay(spark, sf, True).top.select("volume_id", joined("top_slices").alias("top_slices"))


def _attention(spark, sf) -> DataFrame:
    """Attention stand-in: the part of a volume above -500 HU."""
    return B.slices(spark, sf).withColumn("px", F.transform("px", lambda v: F.greatest(v + 500, F.lit(0)).cast("double")))


def _attention_levels(spark, sf) -> DataFrame:
    field = _attention(spark, sf)
    levels, _, _ = A.attention_overlay(field, _shapes(field))
    return levels.select(*OWN, F.round("value_lo", 3).alias("value_lo"), F.round("value_hi", 3).alias("value_hi"), joined("level").alias("level"))


def _attention_top(spark, sf) -> DataFrame:
    field = _attention(spark, sf)
    same = field.groupBy("volume_id").agg(F.max("depth").alias("out_depth")).withColumns({"out_rows": F.lit(16), "out_cols": F.lit(16)})
    return A.attention_overlay(field, same)[2].select("volume_id", joined("top_slices").alias("top_slices"))


ATTENTION_SQL = f"""{B.SLICES_SQL}, prof AS (SELECT volume_id, z, sum(greatest(hu + 500, 0))::DOUBLE AS total FROM vox GROUP BY ALL)"""


def _enrichment(spark, sf) -> DataFrame:
    out = A.enrichment(_attention(spark, sf), C.lung_mask(B.chest(spark, sf)))
    return out.select("volume_id", *[F.round(c, 8).alias(c) for c in ("attention_share", "mask_share", "enrichment")])


ENRICHMENT_SQL = f"""WITH RECURSIVE {CHEST_SQL}, {lung_sql('chest', -320, 'lung')}, f AS (SELECT volume_id, greatest(vox.hu + 500, 0) AS a, v FROM vox JOIN lung USING (volume_id, z, y, x)),
s AS (SELECT volume_id, sum(a * v) / nullif(sum(a), 0)::DOUBLE AS i, avg(v) AS m FROM f GROUP BY 1) SELECT volume_id, round(i, 8) AS attention_share, round(m, 8) AS mask_share, round(i / nullif(m, 0), 8) AS enrichment FROM s"""


def _overlay_match(spark, sf) -> DataFrame:
    """Every order as an overlay over the scan its customer's segment shows."""
    o = B.load(spark, sf, "orders")
    k = F.col("o_orderkey")
    blank = lambda c, n: F.when(k % n != 0, c)
    own, shown = F.col("o_custkey").cast("string"), (F.col("o_custkey") - (k % 7 == 0).cast("int")).cast("string")
    belongs = A.belongs(blank(own, 5), F.when(k % 11 == 0, "").otherwise(blank(F.concat(F.lit("T"), (k % 3).cast("string")), 4)), shown,
                        F.concat(F.lit("T"), (k % 2).cast("string")))
    same = A.matches_shape([k % 4, k % 5, F.lit(1)], [k % 6, k % 5, F.when(k % 13 != 0, 1)])
    return o.select("o_orderkey", belongs.alias("belongs"), same.alias("same_shape"))


OVERLAY_MATCH_SQL = """SELECT o_orderkey, NOT (o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0) AND (o_orderkey % 11 = 0 OR o_orderkey % 4 = 0 OR o_orderkey % 3 = o_orderkey % 2) AS belongs,
  (o_orderkey % 4 = o_orderkey % 6) AND o_orderkey % 13 <> 0 AS same_shape FROM orders"""


def _targets(spark, sf) -> DataFrame:
    o = B.load(spark, sf, "orders")
    patient = F.when(F.col("o_orderkey") % 5 == 0, -1 - F.col("o_custkey")).otherwise(F.col("o_custkey"))  # no such patient
    overlays = o.select(F.col("o_orderkey").alias("overlay"), patient.alias("patient_id"), F.col("o_orderpriority").alias("round"))
    entries = B.load(spark, sf, "customer").select(
        F.col("c_custkey").alias("patient_id"), F.lit("1-URGENT").alias("round"), F.lit(12).alias("out_depth"), (F.col("c_nationkey") + 1).alias("out_rows"), F.lit(16).alias("out_cols"))
    return A.overlay_targets(overlays, entries).select("overlay", "patient_id", "round", "out_depth", "out_rows", "out_cols")


COMPARED_SQL = f"""{SHIFT_SQL}, {lung_sql("(SELECT * FROM chest WHERE volume_id % 3 > 0)", -320, 'lung2')},
shifted AS (SELECT volume_id, z, depth, y, x, p, baseline, followup, inside, d - shift_hu AS d FROM delta JOIN shift USING (volume_id) JOIN best USING (volume_id) WHERE selected_stage <> 'none'),
{regions_sql('shifted', MIN_DELTA, 1.8, 0.0)}, ml AS (SELECT volume_id, sum(v) * 3.375::DOUBLE / 1000 AS m FROM lung GROUP BY 1), ml2 AS (SELECT volume_id - 1 AS volume_id, sum(v) * 3.375::DOUBLE / 1000 AS m FROM lung2 GROUP BY 1),
pair_rows AS (SELECT volume_id, selected_stage, CAST(format('{{:.1f}}', before_hu) AS DOUBLE) AS alignment_before_hu, CAST(format('{{:.1f}}', after_hu) AS DOUBLE) AS alignment_after_hu,
        selected_stage = 'none' AS registration_failed, CAST(format('{{:.1f}}', after_hu) AS DOUBLE) < CAST(format('{{:.1f}}', before_hu) AS DOUBLE) AS alignment_improved,
        CAST(format('{{:.1f}}', shift_hu) AS DOUBLE) AS inflation_shift_hu, (SELECT count(*) FROM kept k WHERE k.volume_id = best.volume_id) AS n_regions,
        CAST(format('{{:.1f}}', ml.m) AS DOUBLE) AS from_lung_ml, CAST(format('{{:.1f}}', ml2.m) AS DOUBLE) AS to_lung_ml,
        CASE WHEN selected_stage = 'none' THEN 'Registration failed: no stage aligned these rounds better than leaving them unregistered, so no change regions are reported for this pair.' END AS note
        FROM best JOIN shift USING (volume_id) JOIN ml USING (volume_id) JOIN ml2 USING (volume_id))"""


QUERIES = {
    "volume_difference": (_difference, f"""WITH {PAIR_SQL} SELECT volume_id, z, {duck_joined('l.hu - e.hu', 'e.p')} AS delta,
        {duck_joined('greatest(least(l.hu - e.hu, 1024), -1024)', 'e.p')} AS stored FROM early e JOIN late l USING (volume_id, z, y, x) GROUP BY volume_id, z"""),
    "alignment_error": (lambda s, d: _errors(s, d).select("volume_id", "stage", "stage_order", F.round("error_hu", 6).alias("error_hu")), f"WITH RECURSIVE {ERROR_SQL} SELECT volume_id, stage, stage_order, round(error_hu, 6) AS error_hu FROM errors"),
    "best_stage": (lambda s, d: G.best_stage(_errors(s, d)).select("volume_id", "selected_stage", F.round("alignment_after_hu", 6).alias("after_hu"), F.round("alignment_before_hu", 6).alias("before_hu")),
                   f"WITH RECURSIVE {ERROR_SQL} SELECT volume_id, selected_stage, round(after_hu, 6) AS after_hu, round(before_hu, 6) AS before_hu FROM best"),
    "inflation_shift": (_shift, f"WITH RECURSIVE {PLAIN_SQL} SELECT volume_id, coalesce(median(d) FILTER (inside = 1), 0) AS shift_hu FROM delta GROUP BY 1"),
    "candidate_voxels": (_candidates, f"""WITH RECURSIVE {PAIR_SQL}, {lung_sql('early', -320, 'lung')}, diff AS (SELECT e.*, l.hu - e.hu AS d FROM early e JOIN late l USING (volume_id, z, y, x)),
        {gaussian_sql('diff', 'd', 'smooth')} SELECT s.volume_id, s.z, s.p, round(s.v, 4) AS v FROM smooth s JOIN lung l USING (volume_id, z, y, x) WHERE l.v = 1 AND s.v > {MIN_DELTA}"""),
    "find_regions": (_find, f"""WITH RECURSIVE {PLAIN_SQL.replace("'v', 'min'", "'v', 'min'")}, {regions_sql('delta', MIN_DELTA, 1.8, 0.0)} SELECT {REGION_SELECT} FROM kept"""
                     .replace(neighbourhood_sql('lung', 'v', 'min', 'interior', 2), neighbourhood_sql('lung', 'v', 'min', 'interior', 1))),
    "compare_pairs": (_pair_table, f"WITH RECURSIVE {COMPARED_SQL} SELECT * FROM pair_rows"),
    "compare_regions": (_region_table, f"""WITH RECURSIVE {SHIFT_SQL},
        shifted AS (SELECT volume_id, z, depth, y, x, p, baseline, followup, inside, d - shift_hu AS d FROM delta JOIN shift USING (volume_id) JOIN best USING (volume_id) WHERE selected_stage <> 'none'),
        {regions_sql('shifted', MIN_DELTA, 1.8, 0.0)} SELECT {REGION_SELECT} FROM kept"""),
    "change_overlay": (_overlay_levels, f"WITH RECURSIVE {OVERLAY_SQL} SELECT volume_id, z, {duck_joined('level')} AS level FROM levels GROUP BY volume_id, z"),
    "change_overlay_top": (_overlay_top, f"WITH RECURSIVE {OVERLAY_SQL}, {SHOWN_SQL.format(p='prof')} SELECT * FROM shown"),
    "change_overlay_less_shift": (lambda s, d: _overlay_levels(s, d, True), f"WITH RECURSIVE {overlay_sql('d - shift_hu')} SELECT volume_id, z, {duck_joined('level')} AS level FROM levels GROUP BY volume_id, z"),
    "overlay_on_grid": (_overlay_grid, OVERLAY_GRID_SQL),
    "overlay_grid_profile": (_overlay_grid_profile, f"""WITH RECURSIVE {GRID_PROFILE_SQL} SELECT volume_id, z, round(total / greatest(max(total) OVER (PARTITION BY volume_id), 1e-6), 7) AS share FROM moved"""),
    "overlay_grid_top_less_shift": (_overlay_grid_top, f"WITH RECURSIVE {GRID_PROFILE_SQL.replace(OVERLAY_SQL, overlay_sql('d - shift_hu'))}, {SHOWN_SQL.format(p='moved')} SELECT * FROM shown"),
    "translation_search": (_search, f"WITH RECURSIVE {SEARCH_SQL}"),
    "compare_pairs_spacing": (lambda s, d: _pair_view(_compare_iso(s, d)), f"WITH RECURSIVE {COMPARED_SQL.replace(CHEST_SQL, ISO_SQL)} SELECT * FROM pair_rows"),
    "compare_regions_spacing": (lambda s, d: _region_view(_compare_iso(s, d).regions), f"WITH RECURSIVE {COMPARED_SQL.replace(CHEST_SQL, ISO_SQL)} SELECT {REGION_SELECT} FROM kept"),
    "attention_overlay": (_attention_levels, f"""WITH {B.SLICES_SQL}, field AS (SELECT *, greatest(hu + 500, 0)::DOUBLE AS a FROM vox),
        {zoom_sql('field', 'a', 'SELECT DISTINCT volume_id, depth AS nz, 17 AS oz, 23 AS oy, 9 AS ox FROM vox')},
        r AS (SELECT volume_id, min(v)::FLOAT::DOUBLE AS lo, max(v)::FLOAT::DOUBLE AS hi FROM along_z GROUP BY 1)
        SELECT volume_id, k AS z, round(any_value(lo), 3) AS value_lo, round(any_value(hi), 3) AS value_hi,
        {duck_joined('CAST(round_even((((v::FLOAT - lo::FLOAT) / (hi - lo)::FLOAT) * 255::FLOAT)::DOUBLE, 0) AS INT)', 'j, i')} AS level
        FROM along_z JOIN r USING (volume_id) GROUP BY volume_id, k"""),
    "attention_top": (_attention_top, f"WITH RECURSIVE {ATTENTION_SQL}, {TOP_SQL.format(p='prof')} SELECT * FROM best"),
    "attention_enrichment": (_enrichment, ENRICHMENT_SQL),
    "overlay_match": (_overlay_match, OVERLAY_MATCH_SQL),
    "overlay_targets": (_targets, """SELECT o_orderkey AS overlay, CASE WHEN o_orderkey % 5 = 0 THEN -1 - o_custkey ELSE o_custkey END AS patient_id, o_orderpriority AS round, CASE WHEN c_custkey IS NOT NULL THEN 12 END AS out_depth, c_nationkey + 1 AS out_rows,
        CASE WHEN c_custkey IS NOT NULL THEN 16 END AS out_cols FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND o_orderkey % 5 <> 0 AND o_orderpriority = '1-URGENT'"""),
}

# The same composites in blocks of four slices, so that halos and merges between blocks of one volume are met.
SMALL_BLOCK = 4
for _name, _fn in {"find_regions": _find, "compare_pairs": _pair_table, "compare_regions": _region_table}.items():
    QUERIES[f"{_name}_small_blocks"] = (lambda s, d, fn=_fn: fn(s, d, SMALL_BLOCK), QUERIES[_name][1])

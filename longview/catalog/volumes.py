"""Registered queries over slice volumes: ordering, HU, profiles, planes, resampling, masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longview.functions import voxel as V
from longview.operators import blocks as K
from longview.operators import components as C
from longview.operators import slices as S

from . import base as B
from .base import CHEST_SQL, SLICES_SQL, duck_joined, joined

OWN = ["volume_id", "z"]


def _tags(spark, sf) -> DataFrame:
    """Order lines as scanned slices: volume is the supplier, with reversed, missing and repeated positions."""
    supplier = F.col("l_suppkey")
    rows = B.load(spark, sf, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    return rows.select(
        supplier.alias("volume_id"), F.col("l_orderkey").alias("slice_uid"),
        F.when((supplier % 5 == 0) & (F.col("l_orderkey") % 101 == 0), None).otherwise(
            F.when(supplier % 2 == 0, -1.0).otherwise(1.0) * (F.col("l_orderkey") % 3000) * 1.25 + F.col("q")).alias("position_z"),
        F.when(F.col("l_orderkey") % 61 != 0, (F.col("l_orderkey") % 3000).cast("int")).alias("instance"),
        F.when(F.col("l_orderkey") % 3 != 0, F.lit(2.5)).alias("thickness"))


TAGS_SQL = """tags AS (SELECT l_suppkey AS volume_id, l_orderkey AS slice_uid, CASE WHEN l_suppkey % 5 = 0 AND l_orderkey % 101 = 0 THEN NULL ELSE
  CASE WHEN l_suppkey % 2 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * (l_orderkey % 3000) * 1.25::DOUBLE + q END AS position_z,
  CASE WHEN l_orderkey % 61 <> 0 THEN l_orderkey % 3000 END AS instance, CASE WHEN l_orderkey % 3 <> 0 THEN 2.5::DOUBLE END AS thickness
  FROM (SELECT l_suppkey, l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)),
keyed AS (SELECT *, bool_and(position_z IS NOT NULL) OVER (PARTITION BY volume_id) AS placed FROM tags),
ordered AS (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY CASE WHEN placed THEN position_z ELSE coalesce(instance, 0) END, slice_uid) - 1 AS z,
  count(*) OVER (PARTITION BY volume_id) AS depth FROM keyed)"""


def _raw(spark, sf) -> DataFrame:
    """Slices as stored pixels with a slope and intercept per slice."""
    n = F.col("slice_uid")
    return B.slices(spark, sf).withColumns({
        "slope": F.when(n % 4 == 0, 0.0).when(n % 4 == 1, 2.5).when(n % 4 == 2, 40.0),
        "intercept": F.when(n % 3 == 0, -1024.0).when(n % 3 == 1, 12.5)})


def _values(df: DataFrame, px: str = "px", digits: int | None = None) -> DataFrame:
    """One row per voxel."""
    out = df.select(*OWN, F.posexplode(px).alias("p", "v"))
    return out if digits is None else out.withColumn("v", F.round("v", digits))


def _text(df: DataFrame, px: str = "px") -> DataFrame:
    return df.select(*OWN, joined(px).alias("px"))


def vox_text(expr: str, source: str = "vox") -> str:
    return f"SELECT volume_id, z, {duck_joined(expr)} AS px FROM {source} GROUP BY volume_id, z"


def _float_field(spark, sf) -> DataFrame:
    """A field with values that are not finite."""
    return B.slices(spark, sf).withColumn("px", F.transform("px", lambda v, i: F.when(
        (i + F.col("z")) % 97 == 0, F.lit(float("nan"))).when((i + F.col("z")) % 89 == 0, F.lit(float("inf"))).otherwise(v / 8.0)))


FIELD_SQL = "f AS (SELECT volume_id, z, p, CASE WHEN (p + z) % 97 = 0 OR (p + z) % 89 = 0 THEN 0.0::DOUBLE ELSE hu / 8.0::DOUBLE END AS v FROM vox)"


def _quantised(spark, sf) -> DataFrame:
    q = S.quantise_volumes(_float_field(spark, sf), "px")
    return q.select(*OWN, "value_lo", "value_hi", joined("level").alias("px"))


def _positive(spark, sf) -> DataFrame:
    return B.slices(spark, sf).withColumn("px", F.transform("px", lambda v: F.greatest(v, F.lit(0))))


def _profile(spark, sf) -> DataFrame:
    return S.profile(_positive(spark, sf), "px", 1e-9)


PROFILE_SQL = f"""{SLICES_SQL}, sums AS (SELECT volume_id, z, depth, sum(greatest(hu, 0))::DOUBLE AS total FROM vox GROUP BY ALL),
prof AS (SELECT *, total / greatest(max(total) OVER (PARTITION BY volume_id), 1e-9) AS share FROM sums)"""

# Greedy choice, one slice per step: the best one far enough from those chosen.
TOP_SQL = """top(volume_id, k, chosen) AS (SELECT DISTINCT volume_id, 0, []::BIGINT[] FROM {p} UNION ALL
  SELECT volume_id, k + 1, list_append(chosen, z) FROM (SELECT t.volume_id, k, chosen, p.z, row_number() OVER (PARTITION BY t.volume_id ORDER BY total DESC, p.z DESC) AS i
    FROM top t JOIN {p} p ON p.volume_id = t.volume_id WHERE k < 5 AND total > 0 AND len(list_filter(chosen, lambda c: abs(c - z) < 5)) = 0) WHERE i = 1),
best AS (SELECT volume_id, array_to_string(arg_max(chosen, k), ',') AS top_slices FROM top GROUP BY 1)"""


def _top(spark, sf) -> DataFrame:
    return S.top_slices(_profile(spark, sf)).select("volume_id", joined("top_slices").alias("top_slices"))


def _reslice(plane: str):
    return lambda spark, sf: S.reslice(B.slices(spark, sf), plane).select("volume_id", "plane_index", joined("px").alias("px"))


SPACING = {"spacing_z": 2.0, "spacing_y": 1.8, "spacing_x": 1.2}


def _spacing(slices: DataFrame) -> DataFrame:
    """Every fourth volume is on the grid already."""
    v = F.col("volume_id")
    return slices.select("volume_id").distinct().select(
        "volume_id", *[F.when(v % 4 == 3, 1.5).otherwise(s).alias(c) for c, s in SPACING.items()])


def _resampled(spark, sf) -> DataFrame:
    s = B.slices(spark, sf)
    return S.resample_isotropic(s, _spacing(s), 1.5)


def zoom_sql(source: str, value: str, dims: str) -> str:
    """Trilinear zoom of ``source`` onto ``dims`` (volume_id, nz, oz, oy, ox): along_z(volume_id, k, j, i, ox, v)."""
    at = lambda i, n, o: f"{i} * ({n} - 1) / greatest({o} - 1, 1)::DOUBLE"
    step = lambda i, n, o: f"(SELECT *, {at(i, n, o)} AS c, CAST(floor({at(i, n, o)}) AS INT) AS lo FROM (SELECT *, unnest(range({o})) AS {i} FROM dims)) d"
    return f"""dims AS ({dims}),
along_x AS (SELECT d.volume_id, d.oz, d.oy, d.ox, v0.z, v0.y, i, v0.{value} * (1 - (c - lo)) + v1.{value} * (c - lo) AS v FROM {step('i', '16', 'ox')}
  JOIN {source} v0 ON v0.volume_id = d.volume_id AND v0.x = lo JOIN {source} v1 ON v1.volume_id = d.volume_id AND v1.z = v0.z AND v1.y = v0.y AND v1.x = least(lo + 1, 15)),
along_y AS (SELECT a.volume_id, a.oz, a.oy, a.ox, a.z, j, a.i, a.v * (1 - (c - lo)) + b.v * (c - lo) AS v FROM {step('j', '16', 'oy')}
  JOIN along_x a ON a.volume_id = d.volume_id AND a.y = lo JOIN along_x b ON b.volume_id = d.volume_id AND b.z = a.z AND b.i = a.i AND b.y = least(lo + 1, 15)),
along_z AS (SELECT a.volume_id, k, a.j, a.i, a.ox, a.v * (1 - (c - lo)) + b.v * (c - lo) AS v FROM {step('k', 'nz', 'oz')}
  JOIN along_y a ON a.volume_id = d.volume_id AND a.z = lo JOIN along_y b ON b.volume_id = d.volume_id AND b.j = a.j AND b.i = a.i AND b.z = least(lo + 1, nz - 1))"""


_DIMS = """SELECT DISTINCT volume_id, depth AS nz, CASE WHEN volume_id % 4 = 3 THEN depth ELSE CAST(round_even(depth * 2.0::DOUBLE / 1.5::DOUBLE, 0) AS INT) END AS oz,
  CASE WHEN volume_id % 4 = 3 THEN 16 ELSE 19 END AS oy, CASE WHEN volume_id % 4 = 3 THEN 16 ELSE 13 END AS ox FROM vox"""
RESAMPLED_SQL = f"{SLICES_SQL}, {zoom_sql('vox', 'hu', _DIMS)}"


def _with_target(df: DataFrame, depth: int, rows: int, cols: int) -> DataFrame:
    return df.withColumns({"out_depth": F.lit(depth), "out_rows": F.lit(rows), "out_cols": F.lit(cols)})


def _nearest(spark, sf) -> DataFrame:
    return S.resample_nearest(_with_target(B.slices(spark, sf), 17, 23, 9))


NEAREST_SQL = f"""{SLICES_SQL}, near AS (SELECT v.volume_id, k AS z, j * 9 + i AS p, hu FROM (SELECT DISTINCT volume_id, depth FROM vox) d,
  (SELECT unnest(range(17)) AS k) kk, (SELECT unnest(range(23)) AS j) jj, (SELECT unnest(range(9)) AS i) ii JOIN vox v ON v.volume_id = d.volume_id
  AND v.z = CAST(floor(k * (d.depth - 1) / 16.0::DOUBLE + 0.5) AS INT) AND v.y = CAST(floor(j * 15 / 22.0::DOUBLE + 0.5) AS INT) AND v.x = CAST(floor(i * 15 / 8.0::DOUBLE + 0.5) AS INT))"""


def _profile_resampled(spark, sf) -> DataFrame:
    depth = B.slices(spark, sf).select("volume_id", "z", "depth")
    p = _profile(spark, sf).join(depth, OWN).withColumn("out_depth", F.lit(31))
    return S.resample_profile(p, "share").select(*OWN, F.round("share", 7).alias("share"))


PROFILE_RESAMPLED_SQL = f"""WITH {PROFILE_SQL} SELECT volume_id, k AS z, round(a.share * (1 - (c - lo)) + b.share * (c - lo), 7) AS share FROM
  (SELECT *, k * (depth - 1) / 30.0::DOUBLE AS c, CAST(floor(k * (depth - 1) / 30.0::DOUBLE) AS INT) AS lo FROM (SELECT DISTINCT volume_id, depth, unnest(range(31)) AS k FROM prof)) d
  JOIN prof a USING (volume_id) JOIN prof b USING (volume_id) WHERE a.z = lo AND b.z = least(lo + 1, d.depth - 1)"""


def _mask(df: DataFrame, limit: int) -> DataFrame:
    return df.withColumn("mask", F.transform("px", lambda v: (v < limit).cast("int")))


# ------------------------------------------------------------- oracle stencils

def neighbourhood_sql(source: str, value: str, fn: str, name: str, radius: int, edge: str = "zero") -> str:
    """Separable cube minimum or maximum as three passes; outside counts as zero."""
    passes, prev = [], source
    for i, (axis, size) in enumerate((("z", "depth"), ("y", "16"), ("x", "16"))):
        keys = [c for c in ("volume_id", "z", "y", "x") if c != axis]
        v = value if i == 0 else "v"
        w = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {axis} ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING)"
        if fn == "min":
            inside = f"CASE WHEN {axis} >= {radius} AND {axis} < {size} - {radius} THEN min({v}) {w} ELSE 0 END"
        else:
            inside = f"max({v}) {w}"
        passes.append(f"{name}_{axis} AS (SELECT volume_id, z, depth, y, x, p, {inside} AS v FROM {prev})")
        prev = f"{name}_{axis}"
    return ",\n".join(passes) + f",\n{name} AS (SELECT * FROM {prev})"


def gaussian_sql(source: str, value: str, name: str) -> str:
    weights = ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in zip(range(-4, 5), K.GAUSS_WEIGHTS))
    passes, prev = [f"{name}_w AS (SELECT * FROM (VALUES {weights}) AS t(k, w))"], source
    for i, (axis, size) in enumerate((("z", "a.depth"), ("y", "16"), ("x", "16"))):
        v = f"b.{value}" if i == 0 else "b.v"
        m = f"((a.{axis} + k) % (2 * {size}) + 2 * {size}) % (2 * {size})"
        on = " AND ".join(f"b.{c} = a.{c}" for c in ("volume_id", "z", "y", "x") if c != axis)
        passes.append(f"""{name}_{axis} AS (SELECT a.volume_id, a.z, a.depth, a.y, a.x, a.p, sum(w * {v}) AS v FROM {prev} a, {name}_w
          JOIN {prev} b ON {on} AND b.{axis} = CASE WHEN {m} < {size} THEN {m} ELSE 2 * {size} - 1 - {m} END GROUP BY ALL)""")
        prev = f"{name}_{axis}"
    return ",\n".join(passes) + f",\n{name} AS (SELECT * FROM {prev})"


def components_sql(source: str, name: str) -> str:
    """Label of every set voxel of ``source`` (volume_id, z, y, x): smallest reachable voxel number."""
    return f"""{name}_e AS (SELECT a.volume_id, a.n AS a, b.n AS b FROM {name}_v a JOIN {name}_v b ON b.volume_id = a.volume_id AND b.n IN (a.n + 1, a.n - 1, a.n + 16, a.n - 16, a.n + 256, a.n - 256)
  AND abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1),
{name}_r(volume_id, n, root) USING KEY (volume_id, n) AS (SELECT volume_id, n, n FROM {name}_v UNION
  SELECT e.volume_id, e.a, min(r.root) FROM {name}_e e JOIN {name}_r r ON r.volume_id = e.volume_id AND r.n = e.b JOIN recurring.{name}_r o ON o.volume_id = e.volume_id AND o.n = e.a
  WHERE r.root < o.root GROUP BY e.volume_id, e.a, o.root HAVING min(r.root) < o.root),
{name} AS (SELECT v.*, r.root AS component FROM {name}_v v JOIN {name}_r r USING (volume_id, n))""".replace(
        f"{name}_e AS", f"{name}_v AS (SELECT volume_id, z, y, x, (z * 16 + y) * 16 + x AS n FROM {source}),\n{name}_e AS", 1)


def fill_sql(source: str, name: str) -> str:
    """Per-slice hole fill of ``source`` (… v): background not reached from the border is set."""
    return f"""{name}_s(volume_id, z, y, x) AS (SELECT volume_id, z, y, x FROM {source} WHERE v = 0 AND (y IN (0, 15) OR x IN (0, 15)) UNION
  SELECT f.volume_id, f.z, f.y, f.x FROM {name}_s s JOIN {source} f ON f.volume_id = s.volume_id AND f.z = s.z AND abs(f.y - s.y) + abs(f.x - s.x) = 1 WHERE f.v = 0),
{name} AS (SELECT f.volume_id, f.z, f.depth, f.y, f.x, f.p, CASE WHEN s.y IS NULL THEN 1 ELSE 0 END AS v FROM {source} f LEFT JOIN {name}_s s
  ON s.volume_id = f.volume_id AND s.z = f.z AND s.y = f.y AND s.x = f.x)"""


def lung_sql(source: str, threshold: int, name: str) -> str:
    """Lung mask of ``source`` (… hu) as ``name`` (… v)."""
    return f"""{components_sql(f'(SELECT * FROM {source} WHERE hu < {threshold})', f'{name}_c')},
{name}_size AS (SELECT volume_id, component, count(*) AS n FROM {name}_c GROUP BY ALL HAVING min(y) > 0 AND min(x) > 0 AND max(y) < 15 AND max(x) < 15),
{name}_best AS (SELECT *, max(n) OVER (PARTITION BY volume_id) AS big FROM (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY n DESC, component DESC) AS i FROM {name}_size) WHERE i <= 2),
{name}_set AS (SELECT a.volume_id, a.z, a.depth, a.y, a.x, a.p, CASE WHEN b.component IS NULL THEN 0 ELSE 1 END AS v FROM {source} a LEFT JOIN {name}_c c USING (volume_id, z, y, x)
  LEFT JOIN {name}_best b ON b.volume_id = c.volume_id AND b.component = c.component AND b.n > b.big * 0.15),
{neighbourhood_sql(f'{name}_set', 'v', 'max', f'{name}_d', 1)}, {neighbourhood_sql(f'{name}_d', 'v', 'min', f'{name}_m', 1)}, {fill_sql(f'{name}_m', name)}"""


def _component_table(spark, sf) -> DataFrame:
    runs = C.label_runs(_mask(B.slices(spark, sf), -700), block=4)
    return C.component_sizes(runs)


COMPONENT_SQL = f"""WITH RECURSIVE {SLICES_SQL}, {components_sql('(SELECT * FROM vox WHERE hu < -700)', 'c')}
SELECT volume_id, component, count(*) AS voxels, min(z) AS z0, min(y) AS y0, min(x) AS x0, max(z) + 1 AS z1, max(y) + 1 AS y1, max(x) + 1 AS x1 FROM c GROUP BY ALL"""


def _lung(spark, sf) -> DataFrame:
    return C.lung_mask(B.chest(spark, sf))


def _mask_text(df: DataFrame, px: str) -> DataFrame:
    return df.select(*OWN, joined(px).alias("px"))


MASK_SQL = f"{SLICES_SQL}, m AS (SELECT *, (hu < -200)::INT AS v FROM vox)"


def _geometry(spark, sf) -> DataFrame:
    """Plane positions, linked slices and boxes across the grids of parts and their lines."""
    part = B.load(spark, sf, "part")
    rows, size = F.col("p_partkey"), F.col("p_size")
    lo, hi = V.box_on_grid(size, size + 7, F.lit(64), F.lit(100))
    return part.select(
        "p_partkey", V.plane_position_mm(size, "axial", F.lit(2.5), F.lit(0.7), F.lit(0.6)).alias("axial_mm"),
        F.round(V.plane_position_mm(size, "coronal", F.lit(2.5), F.lit(0.7), F.lit(0.6)), 9).alias("coronal_mm"),
        V.linked_index(size / 50.0, F.lit(33)).alias("linked"), V.linked_index(size / 50.0, (rows % 40 + 2).cast("int")).alias("linked_other"),
        lo.alias("box_lo"), hi.alias("box_hi"), V.extent_mm(size, F.lit(1.25)).alias("extent_mm"),
        V.side(size, size + 4, F.lit(60)).alias("side"), F.round(V.equivalent_diameter(size * 3.375), 7).alias("diameter_mm"))


GEOMETRY_SQL = """SELECT p_partkey, p_size * 2.5::DOUBLE AS axial_mm, round(p_size * 0.7::DOUBLE, 9) AS coronal_mm, CAST(floor(p_size / 50.0::DOUBLE * 32 + 0.5) AS INT) AS linked,
  CAST(floor(p_size / 50.0::DOUBLE * (p_partkey % 40 + 1) + 0.5) AS INT) AS linked_other, p_size * (100 / 64.0::DOUBLE) AS box_lo, (p_size + 7) * (100 / 64.0::DOUBLE) AS box_hi,
  p_size * 1.25::DOUBLE AS extent_mm, CASE WHEN (2 * p_size + 4) / 2.0 < 30 THEN 'right' ELSE 'left' END AS side, round(2 * pow(3 * p_size * 3.375::DOUBLE / (4 * pi()), 1 / 3.0::DOUBLE), 7) AS diameter_mm FROM part"""

WINDOW_SQL = ", ".join(f"{duck_joined(f'CAST(round_even(greatest(least((hu - ({c - w / 2}::DOUBLE)) / {w}::DOUBLE, 1), 0) * 255, 0) AS INT)')} AS {n}" for n, (c, w) in V.WINDOWS.items())

QUERIES = {
    "slice_order": (lambda s, d: S.order_slices(_tags(s, d)).select("volume_id", "slice_uid", "z", "depth"), f"WITH {TAGS_SQL} SELECT volume_id, slice_uid, z, depth FROM ordered"),
    "slice_spacing": (lambda s, d: S.slice_spacing(_tags(s, d)), f"""WITH {TAGS_SQL}, g AS (SELECT volume_id, z, placed, thickness, CASE WHEN placed THEN abs(position_z - lag(position_z) OVER (PARTITION BY volume_id ORDER BY z)) END AS gap FROM ordered)
        SELECT volume_id, CASE WHEN median(gap) > 0 THEN median(gap) WHEN coalesce(arg_min(coalesce(thickness, 0), z), 0) <> 0 THEN arg_min(coalesce(thickness, 0), z) ELSE 1 END AS spacing_z FROM g GROUP BY 1"""),
    "stored_head_first": (lambda s, d: S.stored_head_first(_tags(s, d)), f"""WITH {TAGS_SQL}, n AS (SELECT volume_id, position_z, row_number() OVER (PARTITION BY volume_id ORDER BY instance, slice_uid) AS i,
        count(*) OVER (PARTITION BY volume_id) AS c FROM tags WHERE position_z IS NOT NULL AND instance IS NOT NULL)
        SELECT volume_id, coalesce(bool_or(c >= 2) AND arg_max(position_z, i) < arg_min(position_z, i), false) AS head_first FROM (SELECT DISTINCT volume_id FROM tags) LEFT JOIN n USING (volume_id) GROUP BY 1"""),
    "volume_headers": (lambda s, d: S.volume_headers(B.slices(s, d)), f"WITH {SLICES_SQL} SELECT volume_id, count(DISTINCT z) AS depth, 16 AS rows, 16 AS cols, min(hu) AS hu_min, max(hu) AS hu_max FROM vox GROUP BY 1"),
    "mixed_slice_sizes": (lambda s, d: S.mixed_sizes(B.slices(s, d).withColumn("rows", F.when(F.col("slice_uid") % 31 == 5, 8).otherwise(F.col("rows")))),
                          f"""WITH {SLICES_SQL}, r AS (SELECT DISTINCT s, volume_id, CASE WHEN s % 31 = 5 THEN 8 ELSE 16 END AS rows FROM zs)
                          SELECT volume_id, min(rows) AS min_rows, max(rows) AS max_rows, 16 AS min_cols, 16 AS max_cols FROM r GROUP BY 1 HAVING min(rows) <> max(rows)"""),
    "rescale_hu": (lambda s, d: _text(_raw(s, d).withColumn("px", V.rescale_hu(F.col("px"), F.col("slope"), F.col("intercept")))),
                   f"""WITH {SLICES_SQL}, r AS (SELECT v.*, CASE s % 4 WHEN 1 THEN 2.5 WHEN 2 THEN 40.0 ELSE 1.0 END::FLOAT AS m, CASE s % 3 WHEN 0 THEN -1024.0 WHEN 1 THEN 12.5 ELSE 0 END::FLOAT AS b
                   FROM vox v JOIN zs USING (volume_id, z)) {vox_text('CAST(trunc(greatest(least(hu::FLOAT * m + b, 32767), -32768)) AS INT)', 'r')}"""),
    "clip_hu": (lambda s, d: _text(B.slices(s, d).withColumn("px", V.clip_hu(F.col("px"), (-900, 0)))), f"WITH {SLICES_SQL} {vox_text('greatest(least(hu, 0), -900)')}"),
    "display_windows": (lambda s, d: B.slices(s, d).select(*OWN, *[F.array_join(V.window8(F.col("px"), c, w), ",").alias(n) for n, (c, w) in V.WINDOWS.items()]),
                        f"WITH {SLICES_SQL} SELECT volume_id, z, {WINDOW_SQL} FROM vox GROUP BY volume_id, z"),
    "shift16": (lambda s, d: _text(B.slices(s, d).withColumn("px", V.shift16(F.col("px")))), f"WITH {SLICES_SQL} {vox_text('greatest(least(hu + 1024, 65535), 0)')}"),
    "quantise": (_quantised, f"""WITH {SLICES_SQL}, {FIELD_SQL}, r AS (SELECT volume_id, min(v) AS lo, max(v) AS hi FROM f GROUP BY 1)
        SELECT volume_id, z, any_value(lo) AS value_lo, any_value(hi) AS value_hi,
        {duck_joined('CAST(round_even((((v::FLOAT - lo::FLOAT) / (hi - lo)::FLOAT) * 255::FLOAT)::DOUBLE, 0) AS INT)')} AS px FROM f JOIN r USING (volume_id) GROUP BY volume_id, z"""),
    "slice_profile": (lambda s, d: _profile(s, d).select(*OWN, "total", F.round("share", 9).alias("share")), f"WITH {PROFILE_SQL} SELECT volume_id, z, total, round(share, 9) AS share FROM prof"),
    "top_slices": (_top, f"WITH RECURSIVE {PROFILE_SQL}, {TOP_SQL.format(p='prof')} SELECT * FROM best"),
    "reslice_coronal": (_reslice("coronal"), f"WITH {SLICES_SQL} SELECT volume_id, y AS plane_index, {duck_joined('hu', '-z, x')} AS px FROM vox GROUP BY volume_id, y"),
    "reslice_sagittal": (_reslice("sagittal"), f"WITH {SLICES_SQL} SELECT volume_id, x AS plane_index, {duck_joined('hu', '-z, y')} AS px FROM vox GROUP BY volume_id, x"),
    "downsample_pack": (lambda s, d: _text(B.slices(s, d).withColumn("px", V.downsample_pack(F.col("px"), F.col("rows"), F.col("cols"), 6))),
                        f"WITH {SLICES_SQL} {vox_text('CAST(trunc(greatest(least((hu + 1000) / 10.0, 255), 0)) AS INT)', '(SELECT * FROM vox WHERE y % 3 = 0 AND x % 3 = 0 AND y < 15 AND x < 15)')}"),
    "resample_isotropic": (lambda s, d: _text(_resampled(s, d)), f"WITH {RESAMPLED_SQL} SELECT volume_id, k AS z, {duck_joined('CAST(trunc(v::FLOAT) AS INT)', 'j, i')} AS px FROM along_z GROUP BY volume_id, k"),
    "resample_nearest": (lambda s, d: _text(_nearest(s, d)), f"WITH {NEAREST_SQL} {vox_text('hu', 'near')}"),
    "resample_profile": (_profile_resampled, PROFILE_RESAMPLED_SQL),
    "geometry": (_geometry, GEOMETRY_SQL),
    "gaussian": (lambda s, d: _values(K.gaussian(B.slices(s, d), "px", "px", 4), "px", 4), f"WITH {SLICES_SQL}, {gaussian_sql('vox', 'hu', 'g')} SELECT volume_id, z, p, round(v, 4) AS v FROM g"),
    "dilate": (lambda s, d: _mask_text(K.dilate(_mask(B.slices(s, d), -700), "mask", "px", 4), "px"),
               f"WITH {MASK_SQL.replace('-200', '-700')}, {neighbourhood_sql('m', 'v', 'max', 'q', 1)} {vox_text('v', 'q')}"),
    "erode": (lambda s, d: _mask_text(K.erode(_mask(B.slices(s, d), -200), "mask", 2, "px", 4), "px"), f"WITH {MASK_SQL}, {neighbourhood_sql('m', 'v', 'min', 'q', 2)} {vox_text('v', 'q')}"),
    "close_mask": (lambda s, d: _mask_text(K.close(_mask(B.slices(s, d), -700), "mask", "px", 4), "px"),
                   f"WITH {MASK_SQL.replace('-200', '-700')}, {neighbourhood_sql('m', 'v', 'max', 'q', 1)}, {neighbourhood_sql('q', 'v', 'min', 'r', 1)} {vox_text('v', 'r')}"),
    "fill_holes": (lambda s, d: _mask_text(_mask(B.slices(s, d), -400).withColumn("px", K.fill_holes(F.col("mask"), F.col("rows"), F.col("cols"))), "px"),
                   f"WITH RECURSIVE {MASK_SQL.replace('-200', '-400')}, {fill_sql('m', 'q')} {vox_text('v', 'q')}"),
    "connected_components": (_component_table, COMPONENT_SQL),
    "lung_mask_small_blocks": (lambda s, d: _mask_text(C.lung_mask(B.chest(s, d), block=4), "mask"), f"WITH RECURSIVE {CHEST_SQL}, {lung_sql('chest', -320, 'lung')} {vox_text('v', 'lung')}"),
    "lung_mask": (lambda s, d: _mask_text(_lung(s, d), "mask"), f"WITH RECURSIVE {CHEST_SQL}, {lung_sql('chest', -320, 'lung')} {vox_text('v', 'lung')}"),
    "lung_volume": (lambda s, d: S.mask_volume_ml(_lung(s, d), F.lit(3.375)).select("volume_id", "voxels", F.round("volume_ml", 6).alias("volume_ml")),
                    f"WITH RECURSIVE {CHEST_SQL}, {lung_sql('chest', -320, 'lung')} SELECT volume_id, sum(v)::BIGINT AS voxels, round(sum(v) * 3.375::DOUBLE / 1000, 6) AS volume_ml FROM lung GROUP BY 1"),
}

"""Registered queries over results, summaries, job feeds and the series cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longview.functions import narrative as N
from longview.operators import calibration as K
from longview.operators import inventory as I
from longview.operators import jobs as J
from longview.operators import saliency as A
from longview.operators.change import report_region
from longview.operators.cohort import patient_overview
from longview.operators.slices import top_slices
from longview.plans import results as R
from longview.plans.overlays import overlay_path
from longview.plans.cohort import build_cohort, patient_bundle
from longview.session import cut
from longview.sources.sinks import json_document

from . import base as B
from .base import load
from .change import ATTENTION_SQL, COMPARED_SQL, _attention, _compare
from .metrics import py
from .volumes import TOP_SQL

REV, AT = "0000000", "2024-01-01T00:00:00+00:00"

# ----------------------------------------------------------------- summary text

# A would-be record per customer, every branch of the wording included.
RECORD = {
    "year_1": "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE (c_custkey % 400) / CAST(4000 AS DOUBLE) END",
    "percentile": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 100 AS INT) END",
    "ci": "CASE WHEN c_custkey % 6 = 0 THEN (c_custkey % 300) / CAST(8000 AS DOUBLE) END",
    "from_round": "CASE c_custkey % 5 WHEN 0 THEN 'T0' WHEN 1 THEN 'T1' WHEN 2 THEN 'D19990102' WHEN 3 THEN '' ELSE NULL END",
    "to_round": "CASE c_custkey % 4 WHEN 0 THEN 'T1' WHEN 1 THEN 'T2' WHEN 2 THEN 'D2000x' ELSE 'T0' END",
    "n_regions": "CAST(c_nationkey % 4 AS INT)",
    "failed": "c_custkey % 8 = 3",
    "deformable": "CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END",
    "kind": "CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'growth' END",
    "side": "CASE WHEN c_nationkey % 2 = 0 THEN 'left' ELSE 'right' END",
    "delta_mm": "(c_custkey % 60) / CAST(2 AS DOUBLE)",
    "baseline_hu": "-(c_custkey % 900) - CAST(0.5 AS DOUBLE)",
    "followup_hu": "(c_custkey % 700) / CAST(2 AS DOUBLE) - 200",
    "slice": "CAST(c_custkey % 150 AS INT)",
}


def _summary(spark, sf) -> DataFrame:
    c = load(spark, sf, "customer").select("c_custkey", "c_nationkey", *[F.expr(e).alias(n) for n, e in RECORD.items()])
    available = F.col("c_custkey") % 7 != 0
    region = F.struct("kind", "side", "delta_mm", "baseline_hu", "followup_hu", "slice")
    pair = F.struct("from_round", "to_round", F.col("failed").alias("registration_failed"), "deformable", "n_regions", region.alias("top"))
    pairs = F.when(F.col("c_custkey") % 13 != 0, F.array(pair))
    tops = F.slice(F.array(F.col("slice"), F.col("slice") + 9, F.col("slice") + 20, F.col("slice") + 33), 1, (F.col("c_custkey") % 5).cast("int"))
    curve = F.transform(F.array(*[F.lit(h) for h in range(1, 7)]), lambda h: h * F.coalesce("year_1", F.lit(0.01)))
    return c.select("c_custkey", N.compose(
        N.risk_sentence(available, F.col("year_1"), F.col("percentile"), F.col("c_custkey") % 2 == 0, F.col("ci"), F.col("ci") * 2),
        N.horizon_sentence(available, curve), N.attention_sentence(tops), N.change_sentence(pairs), N.registration_caveat(pairs)).alias("summary"))


def _pct(v: str) -> str:
    return f"format('{{:.1f}}%', ({v}) * 100)"


def _round_name(c: str) -> str:
    return f"CASE {c} WHEN 'T0' THEN 'the baseline scan' WHEN 'T1' THEN 'the first annual follow-up' WHEN 'T2' THEN 'the second annual follow-up' ELSE coalesce(nullif({c}, ''), 'an earlier round') END"


_E, _L = _round_name("from_round"), _round_name("to_round")
_OPEN = f"'Comparing ' || {_L} || ' with ' || {_E} || ', '"
SUMMARY_SQL = f"""WITH r AS (SELECT c_custkey, c_nationkey, {', '.join(f'{e} AS {n}' for n, e in RECORD.items())} FROM customer)
SELECT c_custkey, concat_ws(' ',
  CASE WHEN c_custkey % 7 = 0 THEN '{N.NO_MODEL}' WHEN year_1 IS NULL THEN '{N.NO_ESTIMATE}' ELSE 'Estimated 1-year lung-cancer risk is ' || {_pct('year_1')}
    || CASE WHEN ci IS NOT NULL THEN ' (interval ' || {_pct('ci')} || '–' || {_pct('ci * 2')} || ')' ELSE '' END
    || CASE WHEN percentile IS NOT NULL THEN ', ' || CASE WHEN percentile >= 50 THEN 'above' ELSE 'below' END || ' the median for this screening cohort (' || percentile || 'th percentile)' ELSE '' END
    || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '{N.NOT_CALIBRATED.replace("'", "''")}' END || '.' END,
  CASE WHEN c_custkey % 7 <> 0 THEN 'Cumulative risk rises to ' || {_pct('6 * coalesce(year_1, 0.01::DOUBLE)')} || ' by year 6.' END,
  CASE WHEN c_custkey % 5 > 0 THEN 'The model weighted slices ' || array_to_string(([slice, slice + 9, slice + 20])[1:least(c_custkey % 5, 3)], ', ') || ' most heavily; these show where it attended, which is not by itself evidence of disease.' END,
  CASE WHEN c_custkey % 13 <> 0 THEN CASE WHEN failed THEN upper(substr({_L}, 1, 1)) || lower(substr({_L}, 2)) || ' could not be aligned with ' || {_E} || ', so no change regions are reported for that comparison.'
    WHEN n_regions = 0 THEN {_OPEN} || 'no region met the change thresholds.'
    ELSE {_OPEN} || n_regions || ' candidate region' || CASE WHEN n_regions <> 1 THEN 's' ELSE '' END || ' met the thresholds. The largest, about ' || format('{{:.0f}}', delta_mm) || ' mm across in the ' || side || ' lung, '
      || CASE WHEN kind = 'new' THEN 'appeared where none was visible before' ELSE 'enlarged' END || ' (density ' || format('{{:.0f}}', baseline_hu) || ' to ' || format('{{:.0f}}', followup_hu) || ' HU, slice ' || slice || ').' END END,
  CASE WHEN c_custkey % 13 <> 0 AND NOT failed AND deformable = false THEN '{N.DEFORMABLE_CAVEAT}' END,
  '{N.DISCLAIMER}') AS summary FROM r"""


# -------------------------------------------------------------- results objects

def _series(spark, sf) -> DataFrame:
    """The series table, stored as the cohort stage leaves it: results read it several times."""
    return cut(build_cohort(B.index(spark, sf), B.MIN_SLICES))


def _risk(spark, sf, series: DataFrame | None = None) -> DataFrame:
    scores = B.scores(spark, sf)
    return R.risk_block(_series(spark, sf) if series is None else series, scores, K.Calibrator(), scores.select(F.col("year_1").alias("score")), "stand-in")


def _risk_view(spark, sf) -> DataFrame:
    return _risk(spark, sf).select("patient_id", "risk.unavailable", "risk.model", "risk.round", "risk.year_1", "risk.year_6", "risk.calibrated", "risk.cohort_percentile")


RISK_SQL = f"""WITH {B.PRIMARY_SQL}, {B.SCORES_SQL}, latest AS (SELECT patient_id, max(round_key) AS round FROM series WHERE is_primary GROUP BY 1),
known AS (SELECT s.*, (SELECT count(*) FROM scores) AS n FROM scores s JOIN latest USING (patient_id)),
tied AS (SELECT year_1, sum(count(*)) OVER (ORDER BY year_1) - count(*) AS b FROM scores GROUP BY 1)
SELECT patient_id, k.year_1 IS NULL AS unavailable, CASE WHEN k.year_1 IS NULL THEN 'none' ELSE 'stand-in' END AS model, round, CAST(format('{{:.6f}}', k.year_1) AS DOUBLE) AS year_1,
  CAST(format('{{:.6f}}', k.year_6) AS DOUBLE) AS year_6, CASE WHEN k.year_1 IS NOT NULL THEN false END AS calibrated, CAST(round_even(b / n * 100, 0) AS INT) AS cohort_percentile
FROM latest LEFT JOIN known k USING (patient_id) LEFT JOIN tied t ON t.year_1 = k.year_1"""


def _change_block(spark, sf) -> DataFrame:
    compared = _compare(spark, sf)
    pairs, regions = compared.pairs, cut(report_region(compared.regions))  # a short table; the record repeats no rounding
    named = cut(pairs).withColumns({
        "patient_id": F.floor(F.col("volume_id") / 3).cast("string"), "from_round": F.concat(F.lit("T"), (F.col("volume_id") % 3).cast("string")),
        "to_round": F.concat(F.lit("T"), (F.col("volume_id") % 3 + 1).cast("string"))}).withColumn("overlay", overlay_path(F.col("from_round"), F.col("to_round")))

    return R.change_block(named, regions)


def _results(spark, sf, splits: DataFrame | None = None) -> DataFrame:
    field = _attention(spark, sf)
    tops = top_slices(A.profile(field, "px", A.ATTENTION_FLOOR)).withColumn("patient_id", F.floor(F.col("volume_id") / 3).cast("string"))
    latest = tops.groupBy("patient_id").agg(F.max_by("top_slices", "volume_id").alias("top_slices"))
    series = _series(spark, sf)
    return R.results_objects(series, _risk(spark, sf, series), _change_block(spark, sf), latest, REV, AT, splits=splits)


def _results_view(spark, sf) -> DataFrame:
    """Every record as its JSON document tells it: written, read back, and laid out in columns."""
    records = _results(spark, sf)
    d = json_document(records, "patient_id").select(F.from_json("document", records.schema).alias("d")).select("d.*")
    told = F.transform("change.pairs", lambda p: F.concat(p["from_round"], F.lit("-"), p["to_round"], F.lit(" "), p["selected_stage"], F.lit(" "), F.coalesce(F.size(p["regions"]), F.lit(0)).cast("string")))
    return d.select(
        "patient_id", "split", F.array_join("rounds", ",").alias("rounds"), F.array_join("tasks", ",").alias("tasks"), "risk.unavailable", "risk.reason", "risk.model", F.col("risk.round").alias("risk_round"),
        *[f"risk.year_{h}" for h in range(1, 7)], F.size(F.coalesce("risk.curve", F.array())).alias("n_years"), "risk.calibrated", "risk.cohort_percentile",
        F.array_join("attention.top_slices", ",").alias("top_slices"), "change.note", F.array_join(told, ";").alias("pairs"), F.col("provenance.model").alias("made_by"), "provenance.code_rev", "provenance.generated_at",
        "provenance.research_only", "provenance.disclaimer", F.array_join("provenance.tasks", ",").alias("made_for"), "summary")


def _results_pairs(spark, sf) -> DataFrame:
    p = _results(spark, sf).select("patient_id", F.explode("change.pairs").alias("p"))
    return p.select("patient_id", *[f"p.{c}" for c in R.PAIR_FIELDS if c not in ("alignment_by_stage_hu", "shape")],
                    F.array_join("p.shape", ",").alias("shape"), F.coalesce(F.size("p.regions"), F.lit(0)).alias("n_listed"),
                    F.concat_ws(" ", "p.top.kind", "p.top.side", F.col("p.top.slice").cast("string")).alias("top"))


def _results_stages(spark, sf) -> DataFrame:
    p = _results(spark, sf).select("patient_id", F.explode("change.pairs").alias("p"))
    return p.select("patient_id", "p.from_round", F.explode("p.alignment_by_stage_hu").alias("stage", "error_hu"))


def _region_rows(regions: DataFrame) -> DataFrame:
    return regions.withColumns({"bbox": F.array_join("bbox", ","), **{f"centroid_{a}_mm": F.get("centroid_mm", F.lit(i)) for i, a in enumerate("zyx")}}).drop("centroid_mm")


def _results_regions(spark, sf) -> DataFrame:
    p = _results(spark, sf).select("patient_id", F.explode("change.pairs").alias("p"))
    return _region_rows(p.select("patient_id", "p.from_round", "p.to_round", F.inline("p.regions")))


def _results_attention(spark, sf) -> DataFrame:
    return _results(spark, sf).select("patient_id", F.array_join("attention.top_slices", ",").alias("top_slices"), "change.note")


# What the records say of pairs and regions, for patients of the series table.
RECORD_SQL = f"""WITH RECURSIVE {COMPARED_SQL}, {B.PRIMARY_SQL}, known AS (SELECT DISTINCT patient_id FROM series WHERE is_primary),
named AS (SELECT CAST(volume_id // 3 AS VARCHAR) AS patient_id, 'T' || volume_id % 3 AS from_round, 'T' || volume_id % 3 + 1 AS to_round, * FROM pair_rows),
told AS (SELECT volume_id, rank, slice, concat_ws(',', z0, y0, x0, z1, y1, x1) AS bbox, {', '.join(f"{py(c, 1)} AS {c}" for c in ("volume_mm3", "mean_delta_hu", "peak_delta_hu", "baseline_hu", "followup_hu", "elongation"))},
  {py('diameter_mm', 1)} AS delta_mm, {py('fill_fraction', 2)} AS fill_fraction, kind, side, {py('cz', 1)} AS centroid_z_mm, {py('cy', 1)} AS centroid_y_mm, {py('cx', 1)} AS centroid_x_mm FROM kept)"""
RESULTS_PAIRS_SQL = f"""{RECORD_SQL} SELECT patient_id, from_round, to_round, n_regions, registration_failed, false AS deformable, selected_stage, alignment_before_hu, alignment_after_hu,
  inflation_shift_hu, 1.5::DOUBLE AS spacing_mm, from_lung_ml, to_lung_ml, note, 'overlays/change_' || from_round || '_' || to_round AS overlay, (SELECT max(depth) FROM early e WHERE e.volume_id = n.volume_id) || ',16,16' AS shape, n_regions AS n_listed,
  coalesce(kind || ' ' || side || ' ' || slice, '') AS top FROM named n LEFT JOIN told t ON t.volume_id = n.volume_id AND rank = 1 WHERE patient_id IN (SELECT patient_id FROM known)"""
RESULTS_REGIONS_SQL = f"""{RECORD_SQL} SELECT patient_id, from_round, to_round, told.* EXCLUDE (volume_id) FROM named JOIN told USING (volume_id) WHERE patient_id IN (SELECT patient_id FROM known)"""
RESULTS_STAGES_SQL = f"""{RECORD_SQL} SELECT patient_id, from_round, stage, {py('error_hu', 1)} AS error_hu FROM named JOIN errors USING (volume_id) WHERE patient_id IN (SELECT patient_id FROM known)"""
RESULTS_ATTENTION_SQL = f"""WITH RECURSIVE {ATTENTION_SQL}, {TOP_SQL.format(p='prof')}, {B.PRIMARY_SQL}, last AS (SELECT CAST(volume_id // 3 AS VARCHAR) AS patient_id, arg_max(top_slices, volume_id) AS top_slices FROM best GROUP BY 1)
SELECT patient_id, coalesce(any_value(top_slices), '') AS top_slices, CASE WHEN count(DISTINCT round_key) < 2 THEN '{N.ONE_ROUND_NOTE}' END AS note FROM series LEFT JOIN last USING (patient_id) WHERE is_primary GROUP BY 1"""


_YEARS = ", ".join(f"{py(f'k.year_{h}', 6)} AS year_{h}" for h in range(1, 7))
RESULTS_SQL = f"""{RECORD_SQL}, {B.SCORES_SQL}, latest AS (SELECT patient_id, max(round_key) AS round FROM series WHERE is_primary GROUP BY 1),
tied AS (SELECT year_1, sum(count(*)) OVER (ORDER BY year_1) - count(*) AS b FROM scores GROUP BY 1),
risk AS (SELECT patient_id, k.year_1 IS NULL AS unavailable, round, {_YEARS}, CAST(round_even(b / (SELECT count(*) FROM scores) * 100, 0) AS INT) AS cohort_percentile
  FROM latest LEFT JOIN scores k USING (patient_id) LEFT JOIN tied t ON t.year_1 = k.year_1),
prof AS (SELECT volume_id, z, sum(greatest(hu + 500, 0))::DOUBLE AS total FROM vox GROUP BY ALL), {TOP_SQL.format(p='prof').replace('best AS', 'shown AS')},
seen AS (SELECT CAST(volume_id // 3 AS VARCHAR) AS patient_id, arg_max(top_slices, volume_id) AS top_slices FROM shown GROUP BY 1),
rounds AS (SELECT patient_id, string_agg(round_key, ',' ORDER BY round_key) AS rounds, count(*) AS n FROM (SELECT DISTINCT patient_id, round_key FROM series WHERE is_primary) GROUP BY 1),
spoken AS (SELECT patient_id, bool_or(NOT registration_failed) AS weak, string_agg(from_round || '-' || to_round || ' ' || selected_stage || ' ' || n_regions, ';' ORDER BY from_round) AS pairs,
  string_agg(CASE WHEN registration_failed THEN upper(substr({_L}, 1, 1)) || lower(substr({_L}, 2)) || ' could not be aligned with ' || {_E} || ', so no change regions are reported for that comparison.'
    WHEN n_regions = 0 THEN {_OPEN} || 'no region met the change thresholds.'
    ELSE {_OPEN} || n_regions || ' candidate region' || CASE WHEN n_regions <> 1 THEN 's' ELSE '' END || ' met the thresholds. The largest, about ' || format('{{:.0f}}', delta_mm) || ' mm across in the ' || side || ' lung, '
      || CASE WHEN kind = 'new' THEN 'appeared where none was visible before' ELSE 'enlarged' END || ' (density ' || format('{{:.0f}}', baseline_hu) || ' to ' || format('{{:.0f}}', followup_hu) || ' HU, slice ' || slice || ').' END, ' ' ORDER BY from_round) AS change
  FROM named n LEFT JOIN told t ON t.volume_id = n.volume_id AND rank = 1 GROUP BY 1)
SELECT patient_id, {B.duck_split('patient_id')} AS split, rounds, 'risk,change,saliency' AS tasks, unavailable, CASE WHEN unavailable THEN '{N.NO_SCORE}' END AS reason, CASE WHEN unavailable THEN 'none' ELSE 'stand-in' END AS model,
  round AS risk_round, year_1, year_2, year_3, year_4, year_5, year_6, CASE WHEN unavailable THEN 0 ELSE 6 END AS n_years, CASE WHEN NOT unavailable THEN false END AS calibrated, CASE WHEN NOT unavailable THEN cohort_percentile END AS cohort_percentile,
  coalesce(top_slices, '') AS top_slices, CASE WHEN n < 2 THEN '{N.ONE_ROUND_NOTE}' END AS note, pairs, CASE WHEN unavailable THEN 'none' ELSE 'stand-in' END AS made_by, '{REV}' AS code_rev, '{AT}' AS generated_at,
  true AS research_only, '{N.DISCLAIMER}' AS disclaimer, 'risk,change,saliency' AS made_for,
  concat_ws(' ', CASE WHEN unavailable THEN '{N.NO_MODEL}' ELSE 'Estimated 1-year lung-cancer risk is ' || {_pct('year_1')} || ', ' || CASE WHEN cohort_percentile >= 50 THEN 'above' ELSE 'below' END
    || ' the median for this screening cohort (' || cohort_percentile || 'th percentile){N.NOT_CALIBRATED.replace("'", "''")}.' END,
  CASE WHEN NOT unavailable THEN 'Cumulative risk rises to ' || {_pct('year_6')} || ' by year 6.' END,
  CASE WHEN top_slices <> '' THEN 'The model weighted slices ' || array_to_string(string_split(top_slices, ',')[1:3], ', ') || ' most heavily; these show where it attended, which is not by itself evidence of disease.' END,
  change, CASE WHEN weak THEN '{N.DEFORMABLE_CAVEAT}' END, '{N.DISCLAIMER}') AS summary
FROM rounds JOIN risk USING (patient_id) LEFT JOIN seen USING (patient_id) LEFT JOIN spoken USING (patient_id)"""


def _declared(spark, sf) -> DataFrame:
    """A splits table that the hash would not give: by the id's last digit; some rows name no known patient."""
    k = F.col("c_custkey")
    return load(spark, sf, "customer").select(F.when(k % 7 == 0, -1 - k).otherwise(k).cast("string").alias("patient_id"), F.when(k % 5 == 0, "test").otherwise("train").alias("split"))


def _declared_splits(spark, sf) -> DataFrame:
    series, table = _series(spark, sf), _declared(spark, sf)
    overview = patient_overview(series, splits=table).select("patient_id", F.col("split").alias("overview_split"))
    return patient_bundle(series, splits=table).select("patient_id", "split").join(overview, "patient_id")


DECLARED_SQL = f"""WITH {B.PRIMARY_SQL}, s AS (SELECT DISTINCT patient_id, CASE WHEN c_custkey IS NULL THEN NULL WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split
  FROM series LEFT JOIN customer ON CAST(CASE WHEN c_custkey % 7 = 0 THEN -1 - c_custkey ELSE c_custkey END AS VARCHAR) = patient_id WHERE is_primary) SELECT patient_id, split, split AS overview_split FROM s"""


def _broken_curves(spark, sf) -> DataFrame:
    """Scores of which some fall over the years or leave the range: only their own patients lose their risk."""
    k = F.col("patient_id").cast("long")
    s = B.scores(spark, sf).withColumn("year_6", F.when(k % 4 == 0, 1.5).when(k % 9 == 0, F.col("year_5") * 0.5).otherwise(F.col("year_6")))
    risk = R.risk_block(_series(spark, sf), s, K.Calibrator(), None, "stand-in")
    return risk.select("patient_id", "risk.unavailable", "risk.reason", "risk.model", "risk.year_1")


BROKEN_SQL = f"""WITH {B.PRIMARY_SQL}, {B.SCORES_SQL}, s AS (SELECT patient_id, year_1, CASE WHEN CAST(patient_id AS BIGINT) % 4 = 0 THEN 'range' WHEN CAST(patient_id AS BIGINT) % 9 = 0 AND year_5 > 2e-6 THEN 'decrease' END AS bad FROM scores)
SELECT patient_id, s.year_1 IS NULL OR bad IS NOT NULL AS unavailable, CASE WHEN bad IS NOT NULL THEN '{N.INVALID_CURVE}' || bad WHEN s.year_1 IS NULL THEN '{N.NO_SCORE}' END AS reason,
  CASE WHEN s.year_1 IS NULL OR bad IS NOT NULL THEN 'none' ELSE 'stand-in' END AS model, CASE WHEN bad IS NULL THEN {py('s.year_1', 6)} END AS year_1
FROM (SELECT DISTINCT patient_id FROM series WHERE is_primary) LEFT JOIN s USING (patient_id)"""


def _results_heads(spark, sf) -> DataFrame:
    """What every results object states before any change is compared."""
    series = _series(spark, sf)
    risk = _risk(spark, sf, series)
    none = risk.select("patient_id").limit(0).withColumn("pairs", F.lit(None).cast(
        "array<struct<from_round:string,to_round:string,n_regions:int,registration_failed:boolean,deformable:boolean,top:struct<kind:string,side:string,delta_mm:double,baseline_hu:double,followup_hu:double,slice:int>>>"))
    r = R.results_objects(series, risk, none, None, REV, AT, tasks=("risk", "change"))
    return r.select("patient_id", "split", F.array_join("rounds", ",").alias("rounds"), F.array_join("tasks", ",").alias("tasks"), F.col("change.note").alias("note"),
                    "provenance.model", "provenance.research_only", "provenance.disclaimer", "provenance.code_rev", "summary")


HEADS_SQL = f"""{RISK_SQL.replace('SELECT patient_id, k.year_1 IS NULL', ', risk AS (SELECT patient_id, k.year_1 IS NULL', 1)})
SELECT patient_id, {B.duck_split('patient_id')} AS split, rounds, 'risk,change' AS tasks, CASE WHEN n < 2 THEN '{N.ONE_ROUND_NOTE}' END AS note, model, true AS research_only, '{N.DISCLAIMER}' AS disclaimer, '{REV}' AS code_rev,
  CASE WHEN unavailable THEN '{N.NO_MODEL}' ELSE 'Estimated 1-year lung-cancer risk is ' || {_pct('year_1')} || ', ' || CASE WHEN cohort_percentile >= 50 THEN 'above' ELSE 'below' END
    || ' the median for this screening cohort (' || cohort_percentile || 'th percentile){N.NOT_CALIBRATED.replace("'", "''")}. Cumulative risk rises to ' || {_pct('year_6')} || ' by year 6.' END || ' {N.DISCLAIMER}' AS summary
FROM risk JOIN (SELECT patient_id, string_agg(round_key, ',' ORDER BY round_key) AS rounds, count(*) AS n FROM series WHERE is_primary GROUP BY 1) USING (patient_id)"""


def _json(spark, sf) -> DataFrame:
    """JSON documents with values that are not finite and missing texts."""
    c = load(spark, sf, "customer")
    bad = F.when(F.col("c_custkey") % 5 == 0, F.lit(float("nan"))).when(F.col("c_custkey") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("c_nationkey") / 2.0)
    return json_document(c.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("kernel"), bad.alias("value"),
                                  F.array(bad, F.lit(1.5)).alias("spacing")), "c_custkey")


_BAD = "CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 'null' ELSE format('{:.1f}', c_nationkey / 2.0) END"
JSON_SQL = f"""SELECT c_custkey, '{{"c_custkey":' || c_custkey || ',"kernel":' || CASE WHEN c_custkey % 3 <> 0 THEN '"' || c_mktsegment || '"' ELSE 'null' END || ',"value":' || {_BAD}
  || ',"spacing":[' || {_BAD} || ',1.5]}}' AS document FROM customer"""

# -------------------------------------------------------------------- job feeds

STATUS = "CASE WHEN event_type = 'signup' AND event_id % 97 = 0 THEN 'done' WHEN event_type = 'error' AND event_id % 89 = 0 THEN 'error' ELSE 'running' END"
MESSAGE = "CASE WHEN value < 20 THEN NULL WHEN value < 60 THEN 'loading' ELSE 'registering' END"
PROGRESS = "CASE WHEN value < 100 THEN CAST(floor(value / 50) AS INT) / CAST(4 AS DOUBLE) END"


def events(spark, sf) -> DataFrame:
    """User events as the progress feed of one job per user."""
    return load(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("job_id"), "ts", F.col("event_id").alias("seq"), F.expr(STATUS).alias("status"),
        F.when(F.col("event_type").isin("view", "click"), "download").otherwise("change").alias("stage"), F.expr(MESSAGE).alias("message"), F.expr(PROGRESS).alias("progress"))


EVENTS_SQL = f"""feed AS (SELECT CAST(user_id AS VARCHAR) AS job_id, ts, event_id AS seq, {STATUS} AS status, CASE WHEN event_type IN ('view', 'click') THEN 'download' ELSE 'change' END AS stage,
  {MESSAGE} AS message, {PROGRESS} AS progress FROM events)"""


def _now(df: DataFrame) -> F.Column:
    """The newest event time stands for the clock."""
    return df.agg(F.max("ts")).scalar()


def _live(spark, sf) -> DataFrame:
    e = events(spark, sf)
    return J.live_jobs(e, _now(e), ttl_seconds=10 * 24 * 3600).select("job_id", "seq", "status", F.col("finished_at").isNotNull().alias("finished"))


# ------------------------------------------------------------------------ cache

CAP, INCOMING = 9 * 10 ** 10, 2 * 10 ** 9


def _entries(spark, sf) -> DataFrame:
    return load(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("cache_root"), F.col("o_orderkey").alias("series_uid"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("bytes"),
        F.col("o_orderdate").alias("last_used"))


ENTRIES_SQL = "entries AS (SELECT o_orderstatus AS cache_root, o_orderkey AS series_uid, CAST(round(o_totalprice * 100) AS BIGINT) AS bytes, o_orderdate AS last_used FROM orders)"


def _evicted(spark, sf) -> DataFrame:
    return I.eviction_plan(_entries(spark, sf), INCOMING, CAP).select("cache_root", "series_uid", "bytes")


def _incomplete(spark, sf) -> DataFrame:
    expected = load(spark, sf, "orders").select(F.col("o_orderkey").alias("series_uid"), (F.col("o_orderkey") % 6).alias("instance_count"))
    return I.incomplete_series(expected, load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("series_uid")))


def _complete(spark, sf) -> DataFrame:
    n = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("files"))
    o = load(spark, sf, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    uid = F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 10 == 3, ".partial").otherwise(""))
    return I.complete_entries(o.select(uid.alias("series_uid"), F.coalesce("files", F.lit(0)).alias("files")))


QUERIES = {
    "summary_text": (_summary, SUMMARY_SQL),
    "risk_block": (_risk_view, RISK_SQL),
    "results_heads": (_results_heads, HEADS_SQL),
    "results_objects": (_results_view, RESULTS_SQL),
    "results_pairs": (_results_pairs, RESULTS_PAIRS_SQL),
    "results_stage_errors": (_results_stages, RESULTS_STAGES_SQL),
    "results_regions": (_results_regions, RESULTS_REGIONS_SQL),
    "results_attention": (_results_attention, RESULTS_ATTENTION_SQL),
    "panel_regions": (lambda s, d: _region_rows(R.panel_regions(_results(s, d))), f"{RESULTS_REGIONS_SQL} AND rank <= {R.PANEL_REGIONS}"),
    "declared_splits": (_declared_splits, DECLARED_SQL),
    "broken_curves": (_broken_curves, BROKEN_SQL),
    "json_documents": (_json, JSON_SQL),
    "changes_only": (lambda s, d: J.changes_only(events(s, d)).select("job_id", "seq", "status", "stage", "message", "progress"),
                     f"""WITH {EVENTS_SQL}, l AS (SELECT *, lag((status, stage, message, progress)) OVER w AS before, coalesce(sum((status IN ('done', 'error'))::INT) OVER (PARTITION BY job_id ORDER BY ts, seq
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM feed WINDOW w AS (PARTITION BY job_id ORDER BY ts, seq))
                     SELECT job_id, seq, status, stage, message, progress FROM l WHERE ended = 0 AND (before IS NULL OR before IS DISTINCT FROM (status, stage, message, progress))"""),
    "latest_state": (lambda s, d: J.latest_state(events(s, d)).select("job_id", "seq", "status", "stage", F.col("finished_at").isNotNull().alias("finished")),
                     f"""WITH {EVENTS_SQL} SELECT job_id, arg_max(seq, (ts, seq)) AS seq, arg_max(status, (ts, seq)) AS status, arg_max(stage, (ts, seq)) AS stage,
                     count(*) FILTER (status IN ('done', 'error')) > 0 AS finished FROM feed GROUP BY 1"""),
    "live_jobs": (_live, f"""WITH {EVENTS_SQL}, s AS (SELECT job_id, arg_max(seq, (ts, seq)) AS seq, arg_max(status, (ts, seq)) AS status, min(ts) FILTER (status IN ('done', 'error')) AS f FROM feed GROUP BY 1)
        SELECT job_id, seq, status, f IS NOT NULL AS finished FROM s WHERE f IS NULL OR f >= (SELECT max(ts) FROM feed) - INTERVAL 10 DAY"""),
    "recent_jobs": (lambda s, d: J.recent_jobs(events(s, d), 20).select("job_id", "seq"), f"""WITH {EVENTS_SQL} SELECT job_id, arg_max(seq, (ts, seq)) AS seq FROM feed GROUP BY 1 ORDER BY min(ts) DESC, job_id LIMIT 20"""),
    "last_log_lines": (lambda s, d: J.last_log_lines(events(s, d)).select("job_id", "seq", "line"),
                       f"WITH {EVENTS_SQL} SELECT job_id, seq, line FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS line FROM feed) WHERE line <= 40"),
    "cache_status": (lambda s, d: I.cache_status(_entries(s, d), CAP).withColumn("used_fraction", F.round("used_fraction", 9)),
                     f"WITH {ENTRIES_SQL} SELECT cache_root, count(*) AS series, sum(bytes)::BIGINT AS bytes, {CAP} AS cap_bytes, round(sum(bytes) / {CAP}::DOUBLE, 9) AS used_fraction FROM entries GROUP BY 1"),
    "eviction_plan": (_evicted, f"""WITH {ENTRIES_SQL}, f AS (SELECT *, sum(bytes) OVER (PARTITION BY cache_root ORDER BY last_used, series_uid) - bytes AS freed, sum(bytes) OVER (PARTITION BY cache_root) + {INCOMING} - {CAP} AS needed FROM entries)
        SELECT cache_root, series_uid, bytes FROM f WHERE needed > 0 AND freed < needed"""),
    "incomplete_series": (_incomplete, """SELECT o_orderkey AS series_uid, o_orderkey % 6 AS instance_count, coalesce(n, 0) AS found FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
        WHERE coalesce(n, 0) = 0 OR n < o_orderkey % 6"""),
    "complete_entries": (_complete, """SELECT CAST(o_orderkey AS VARCHAR) AS series_uid, n AS files FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderkey % 10 <> 3"""),
}

"""Registered queries over scores: ranking metrics, calibration, risk curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longview.functions import risk as R
from longview.operators import calibration as K
from longview.operators import metrics as M

from . import base as B
from .base import scores, splits

HORIZON_LIST = ", ".join(f"('year_{h}', year_{h})" for h in R.HORIZONS)
MERGED_SQL = f"""{B.SCORES_SQL}, {B.SPLITS_SQL}, merged AS (SELECT s.*, split, label, label_source FROM scores s JOIN splits USING (patient_id) WHERE label >= 0)"""
LONG_SQL = f"""{MERGED_SQL}, long AS ({' UNION ALL '.join(f"SELECT 'year_{h}' AS horizon, year_{h} AS score, label, split FROM merged" for h in R.HORIZONS)})"""


def py(value: str, digits: int) -> str:
    """Exact decimal rounding of a double, as report fields have it."""
    return f"CAST(format('{{:.{digits}f}}', {value}) AS DOUBLE)"


def metrics_sql(where: str = "true", table: str = "long") -> str:
    return f"""src AS (SELECT * FROM {table} WHERE {where}), tied AS (SELECT horizon, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM src GROUP BY 1, 2),
ranks AS (SELECT *, sum(pos) OVER w - pos AS pos_below, sum(neg) OVER w - neg AS neg_below, sum(pos) OVER (PARTITION BY horizon) AS p, sum(pos + neg) OVER (PARTITION BY horizon) AS n
  FROM tied WINDOW w AS (PARTITION BY horizon ORDER BY score)),
ranked AS (SELECT horizon, any_value(p) AS n_positive, any_value(n) AS n, sum(pos * (neg_below + neg / 2.0::DOUBLE)) AS wins, sum(pos * ((p - pos_below) / (n - pos_below - neg_below))) AS ap FROM ranks GROUP BY 1),
base AS (SELECT horizon, avg(label) AS base_rate, avg((score - label) * (score - label)) AS brier FROM src GROUP BY 1),
metrics AS (SELECT horizon, CAST(n AS BIGINT) AS n, CAST(n_positive AS BIGINT) AS n_positive, base_rate, wins / (n_positive * (n - n_positive)) AS roc_auc, ap / n_positive AS auprc, brier FROM ranked JOIN base USING (horizon))"""


METRIC_FIELDS = """horizon, n, n_positive, round(base_rate, 7) AS base_rate, round(roc_auc, 7) AS roc_auc, round(auprc, 7) AS auprc, round(auprc / base_rate, 6) AS auprc_lift,
  round(brier, 7) AS brier, round(roc_auc, 7) AS c_index"""


def _labelled(spark, sf, split: str | None = None) -> DataFrame:
    return M.with_labels(scores(spark, sf), splits(spark, sf), split)


def _metrics(spark, sf) -> DataFrame:
    out = M.horizon_metrics(M.by_horizon(_labelled(spark, sf)))
    return out.select("horizon", "n", "n_positive", *[F.round(c, 7).alias(c) for c in ("base_rate", "roc_auc", "auprc")],
                      F.round("auprc_lift", 6).alias("auprc_lift"), F.round("brier", 7).alias("brier"), F.round("c_index", 7).alias("c_index"))


def _price_auc(spark, sf) -> DataFrame:
    """Ranking metrics over every order line: price as score, return as event."""
    rows = B.load(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").cast("string").alias("_d"), (F.col("l_extendedprice") / 200000.0).alias("score"),
                                                 F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"), F.col("l_linestatus").alias("horizon"))
    out = M.horizon_metrics(rows.select("horizon", "score", "label"))
    return out.select("horizon", "n", "n_positive", F.round("roc_auc", 7).alias("roc_auc"), F.round("auprc", 7).alias("auprc"), F.round("brier", 7).alias("brier"))


def _reliability(spark, sf) -> DataFrame:
    return M.reliability(M.by_horizon(_labelled(spark, sf))).select(
        "horizon", F.round("bin_lo", 3).alias("bin_lo"), F.round("bin_hi", 3).alias("bin_hi"), "n", F.round("predicted", 9).alias("predicted"), F.round("observed", 9).alias("observed"))


RELIABILITY_SQL = f"""binned AS (SELECT *, {' + '.join(f'(score >= {e!r}::DOUBLE)::INT' for e in M.bin_edges()[1:-1])} AS bin FROM {{t}} WHERE score BETWEEN 0 AND 1)
SELECT horizon, round(bin / 10.0, 3) AS bin_lo, round((bin + 1) / 10.0, 3) AS bin_hi, count(*) AS n, round(avg(score), 9) AS predicted, round(avg(label), 9) AS observed FROM binned GROUP BY horizon, bin"""


def _percentile(spark, sf) -> DataFrame:
    s = scores(spark, sf).select("patient_id", F.col("year_1").alias("score"))
    train = splits(spark, sf).filter("split = 'train'").select("patient_id")
    return M.cohort_percentile(s, s.join(train, "patient_id", "left_semi").select("score")).select("patient_id", "cohort_percentile")


PERCENTILE_SQL = f"""WITH {B.SCORES_SQL}, {B.SPLITS_SQL}, ref AS (SELECT year_1 AS score FROM scores JOIN splits USING (patient_id) WHERE split = 'train'),
tied AS (SELECT score, sum(r) AS c FROM (SELECT score, 1 AS r FROM ref UNION ALL SELECT year_1, 0 FROM scores) GROUP BY 1),
below AS (SELECT score, sum(c) OVER (ORDER BY score) - c AS b FROM tied)
SELECT patient_id, CAST(round_even(b / (SELECT count(*) FROM ref) * 100, 0) AS INT) AS cohort_percentile FROM scores JOIN below ON score = year_1"""


def _report(part: str):
    def run(spark, sf) -> DataFrame:
        held = splits(spark, sf).filter("split = 'test'").select("patient_id")
        predictions = scores(spark, sf).join(held, "patient_id", "left_semi")
        return M.evaluation_report(predictions, splits(spark, sf), "test")[part]
    return run


TEST_SQL = f"{LONG_SQL}, {metrics_sql(chr(34) + 'split' + chr(34) + chr(61) + chr(39) + 'test' + chr(39))}"


def _curves(spark, sf) -> DataFrame:
    """All components of each embedding, six to a would-be curve; the last one is short."""
    e = B.load(spark, sf, "embeddings")
    six = F.transform(F.sequence(F.lit(1), F.size("embedding"), F.lit(6)), lambda k: F.slice("embedding", k, 6))
    parts = e.select("vec_id", F.posexplode(six).alias("part", "px"))
    k = F.col("vec_id") + F.col("part")
    curve = F.transform("px", lambda v, i: F.when(k % 3 == 0, i * 0.1 + 0.05).when(k % 5 == 0, F.abs(v.cast("double")) + i).otherwise(F.abs(v.cast("double"))))
    return parts.select("vec_id", "part", curve.alias("curve"))


CURVES_SQL = """parts AS (SELECT vec_id, k AS part, embedding[k * 6 + 1 : k * 6 + 6] AS px FROM (SELECT vec_id, embedding, unnest(range(CAST(ceil(len(embedding) / 6) AS BIGINT))) AS k FROM embeddings)),
curves AS (SELECT vec_id, part, list_transform(range(0, len(px)), lambda i: CASE WHEN (vec_id + part) % 3 = 0 THEN i * 0.1::DOUBLE + 0.05::DOUBLE
  WHEN (vec_id + part) % 5 = 0 THEN abs(CAST(px[i + 1] AS DOUBLE)) + i ELSE abs(CAST(px[i + 1] AS DOUBLE)) END) AS curve FROM parts)"""


def _violations(spark, sf) -> DataFrame:
    return _curves(spark, sf).select("vec_id", "part", R.curve_violation(F.col("curve")).alias("violation"))


def _monotone(spark, sf) -> DataFrame:
    c = _curves(spark, sf).withColumn("m", R.monotone(F.col("curve")))
    return c.select("vec_id", "part", F.posexplode("m").alias("i", "value")).withColumn("value", F.round("value", 9))


def _risk_struct(spark, sf) -> DataFrame:
    s = scores(spark, sf).select("patient_id", R.risk_struct(R.curve_of(), F.lit(False)).alias("r"))
    return s.select("patient_id", "r.year_1", "r.year_6", "r.calibrated", F.size("r.curve").alias("n"))


def _isotonic(spark, sf) -> DataFrame:
    """The isotonic fit on train, read at every train score."""
    train = _labelled(spark, sf, "train")
    done = K.Calibrator("isotonic").fit(train).apply(train)
    return done.select("patient_id", *[F.round(c, 6).alias(c) for c in ("year_1", "year_6")])


# Pooled value of a score: the largest, over starts below it, of the smallest mean up to an end above it.
ISOTONIC_SQL = f"""WITH {MERGED_SQL}, train AS (SELECT * FROM merged WHERE split = 'train'),
pts AS (SELECT year_1 AS score, sum(label) AS s, count(*) AS w, row_number() OVER (ORDER BY year_1) AS i FROM train GROUP BY 1),
cum AS (SELECT *, sum(s) OVER (ORDER BY i) AS cs, sum(w) OVER (ORDER BY i) AS cw FROM pts),
means AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS m FROM cum a JOIN cum b ON b.i >= a.i),
low AS (SELECT a, b, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM means),
fit AS (SELECT score, max(m) AS v FROM low JOIN pts ON i = b GROUP BY 1)
SELECT patient_id, round(v, 6) AS year_1, round(v, 6) AS year_6 FROM train JOIN fit ON score = year_1"""


# The fit at val scores: between two neighbouring train scores it is linear, beyond them constant. All horizons scale one score.
ISOTONIC_REPORT_SQL = f"""{ISOTONIC_SQL.split('SELECT patient_id, round(v')[0]}, long AS ({' UNION ALL '.join(f"SELECT 'year_{h}' AS horizon, year_{h} AS score, label, split FROM merged" for h in R.HORIZONS)}),
held AS (SELECT patient_id, label, year_1 AS x FROM merged WHERE split = 'val'),
fitted AS (SELECT label, CASE WHEN a.score IS NULL THEN b.v WHEN b.score IS NULL OR b.score = a.score THEN a.v ELSE a.v + (b.v - a.v) * (x - a.score) / (b.score - a.score) END AS p
  FROM held ASOF LEFT JOIN fit a ON x >= a.score ASOF LEFT JOIN fit b ON x <= b.score),
after AS (SELECT avg((p - label) * (p - label)) AS brier_after FROM fitted),
{metrics_sql("split = 'val'")}
SELECT horizon, n, {py('roc_auc', 4)} AS roc_auc, {py('brier', 5)} AS brier_before, {py('brier_after', 5)} AS brier_after FROM metrics, after"""


def _platt(spark, sf) -> DataFrame:
    cal = K.Calibrator("platt").fit(_labelled(spark, sf, "train"))
    return cal.knots(spark).select("horizon", F.round("boundary", 4).alias("slope"), F.round("prediction", 4).alias("intercept"))


# Newton steps on the penalised log-loss, both parameters at once per horizon.
NEWTON_SQL = f"""WITH RECURSIVE {LONG_SQL}, data AS (SELECT CAST(right(horizon, 1) AS INT) AS horizon, score AS x, label AS y FROM long WHERE split = 'train'),
newton(horizon, k, a, b) AS (SELECT DISTINCT horizon, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM data UNION ALL
  SELECT horizon, k + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
    SELECT horizon, k, a, b, sum((p - y) * x) + a AS ga, sum(p - y) AS gb, sum(p * (1 - p) * x * x) + 1 AS haa, sum(p * (1 - p) * x) AS hab, sum(p * (1 - p)) AS hbb
    FROM (SELECT n.*, x, y, 1 / (1 + exp(-(a * x + b))) AS p FROM newton n JOIN data USING (horizon)) GROUP BY horizon, k, a, b) WHERE k < 25)"""
PLATT_SQL = f"{NEWTON_SQL} SELECT horizon, round(a, 4) AS slope, round(b, 4) AS intercept FROM newton WHERE k = 25"
# The same fit applied to val, made monotone over the horizons, and scored beside the raw scores.
PLATT_REPORT_SQL = f"""{NEWTON_SQL}, held AS (SELECT patient_id, label, CAST(right(h, 1) AS INT) AS horizon, score FROM (SELECT * FROM merged WHERE split = 'val')
    UNPIVOT (score FOR h IN (year_1, year_2, year_3, year_4, year_5, year_6))),
fitted AS (SELECT patient_id, label, horizon, 1 / (1 + exp(-(a * score + b))) AS p FROM held JOIN newton USING (horizon) WHERE k = 25),
after AS (SELECT 'year_' || horizon AS horizon, avg((m - label) * (m - label)) AS brier_after FROM
    (SELECT *, max(p) OVER (PARTITION BY patient_id ORDER BY horizon) AS m FROM fitted) GROUP BY ALL),
{metrics_sql("split = 'val'")}
SELECT horizon, n, {py('roc_auc', 4)} AS roc_auc, {py('brier', 5)} AS brier_before, {py('brier_after', 5)} AS brier_after FROM metrics JOIN after USING (horizon)"""


def _held_out(spark, sf) -> DataFrame:
    cal = K.fit_on_train(scores(spark, sf), splits(spark, sf), "platt")
    table, _ = K.held_out_report(cal, scores(spark, sf), splits(spark, sf), "val")
    return table


def _held_out_isotonic(spark, sf) -> DataFrame:
    cal = K.fit_on_train(scores(spark, sf), splits(spark, sf), "isotonic")
    table, _ = K.held_out_report(cal, scores(spark, sf), splits(spark, sf), "val")
    return table


QUERIES = {
    "labelled_predictions": (lambda s, d: _labelled(s, d).select("patient_id", "split", "label", "label_source", F.round("year_1", 9).alias("year_1")),
                             f"WITH {MERGED_SQL} SELECT patient_id, split, label, label_source, round(year_1, 9) AS year_1 FROM merged"),
    "horizon_metrics": (_metrics, f"WITH {LONG_SQL}, {metrics_sql()} SELECT {METRIC_FIELDS} FROM metrics"),
    "ranking_metrics_lines": (_price_auc, f"""WITH long AS (SELECT l_linestatus AS horizon, l_extendedprice / 200000.0::DOUBLE AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem),
        {metrics_sql()} SELECT horizon, n, n_positive, round(roc_auc, 7) AS roc_auc, round(auprc, 7) AS auprc, round(brier, 7) AS brier FROM metrics"""),
    "reliability_curve": (_reliability, f"WITH {LONG_SQL}, {RELIABILITY_SQL.format(t='long')}"),
    "cohort_percentile": (_percentile, PERCENTILE_SQL),
    "evaluation_header": (lambda s, d: _report("header")(s, d).select("split", "n_predicted", "n_labelled", "n_unmatched", "leakage_guard"),
                          f"""WITH {MERGED_SQL} SELECT 'test' AS split, (SELECT count(*) FROM scores JOIN splits USING (patient_id) WHERE split = 'test') AS n_predicted, count(*) AS n_labelled,
                          (SELECT count(*) FROM scores JOIN splits USING (patient_id) WHERE split = 'test') - count(*) AS n_unmatched, 'passed' AS leakage_guard FROM merged WHERE split = 'test'"""),
    "evaluation_label_sources": (_report("label_sources"), f"WITH {MERGED_SQL} SELECT label_source, count(*) AS patients FROM merged WHERE split = 'test' GROUP BY 1"),
    "evaluation_horizons": (lambda s, d: _report("horizons")(s, d).drop("note"),
                            f"""WITH {TEST_SQL} SELECT horizon, n, n_positive, {py('base_rate', 4)} AS base_rate, {py('roc_auc', 4)} AS roc_auc, {py('auprc', 4)} AS auprc,
                            {py(py('auprc', 4) + ' / base_rate', 2)} AS auprc_lift, {py('brier', 5)} AS brier, {py('roc_auc', 4)} AS c_index FROM metrics"""),
    "curve_violations": (_violations, f"""WITH {CURVES_SQL} SELECT vec_id, part, CASE WHEN len(curve) <> 6 THEN 'length' WHEN list_max(curve) > 1 OR list_min(curve) < 0 THEN 'range'
        WHEN len(list_filter(range(1, 6), lambda i: curve[i + 1] < curve[i] - 1e-6)) > 0 THEN 'decrease' END AS violation FROM curves"""),
    "monotone_curve": (_monotone, f"""WITH {CURVES_SQL}, c AS (SELECT vec_id, part, generate_subscripts(curve, 1) - 1 AS i, unnest(curve) AS v FROM curves)
        SELECT vec_id, part, i, round(max(greatest(least(v, 1), 0)) OVER (PARTITION BY vec_id, part ORDER BY i), 9) AS value FROM c"""),
    "risk_record": (_risk_struct, f"WITH {B.SCORES_SQL} SELECT patient_id, CAST(format('{{:.6f}}', year_1) AS DOUBLE) AS year_1, CAST(format('{{:.6f}}', year_6) AS DOUBLE) AS year_6, false AS calibrated, 6 AS n FROM scores"),
    "isotonic_calibration": (_isotonic, ISOTONIC_SQL),
    "platt_calibration": (_platt, PLATT_SQL),
    "calibration_fit_info": (lambda s, d: K.fit_info(_labelled(s, d, "train"), "isotonic"),
                             f"WITH {MERGED_SQL} SELECT count(*) AS n_train, sum(label) AS n_train_positive, {py('avg(label)', 4)} AS train_positive_rate, 'isotonic' AS method FROM merged WHERE split = 'train'"),
    "calibration_report_platt": (_held_out, PLATT_REPORT_SQL),
    "calibration_report_isotonic": (_held_out_isotonic, ISOTONIC_REPORT_SQL),
}

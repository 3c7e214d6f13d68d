"""Ranking metrics and calibration against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from longview.functions.risk import SCORE_COLUMNS
from longview.operators import calibration as K
from longview.operators import metrics as M


def long(spark, scores, labels):
    return spark.createDataFrame([("year_1", float(s), int(y)) for s, y in zip(scores, labels)], "horizon string, score double, label int")


def brute(scores, labels):
    s, y = np.asarray(scores, float), np.asarray(labels)
    diff = s[y == 1][:, None] - s[y == 0][None, :]
    auc = ((diff > 0).sum() + 0.5 * (diff == 0).sum()) / diff.size
    ap, tp = 0.0, 0
    for t in sorted(set(s), reverse=True):
        hit, seen = (y[s == t] == 1).sum(), (s >= t).sum()
        tp += hit
        ap += hit / (y == 1).sum() * tp / seen
    return auc, ap, ((s - y) ** 2).mean()


@pytest.mark.parametrize("scores,labels,auc", [([.9, .8, .2, .1], [1, 1, 0, 0], 1.0), ([.1, .2, .8, .9], [1, 1, 0, 0], 0.0), ([.5] * 4, [1, 0, 1, 0], 0.5)])
def test_c_index_corners(spark, scores, labels, auc):
    assert M.horizon_metrics(long(spark, scores, labels)).first()["c_index"] == auc


def test_metrics_match_brute_force_with_a_hot_score(spark):
    rng = np.random.default_rng(1)
    y = (rng.random(900) < 0.1).astype(int)
    s = np.round(np.clip(rng.normal(0.2 + 0.2 * y, 0.1), 0, 1), 2)
    s[:300] = 0.25  # a third of all rows tie
    row = M.horizon_metrics(long(spark, s, y).repartition(5)).first()
    auc, ap, brier = brute(s, y)
    assert row["roc_auc"] == pytest.approx(auc) and row["auprc"] == pytest.approx(ap) and row["brier"] == pytest.approx(brier)
    assert row["auprc_lift"] == pytest.approx(ap / y.mean())


def test_single_class_has_a_note(spark):
    row = M.horizon_metrics(long(spark, [.1, .2], [0, 0])).first()
    assert row["roc_auc"] is None and row["brier"] is None and row["note"] == M.ONE_CLASS_NOTE


def test_reliability_edges(spark):
    got = M.reliability(long(spark, [.01, .02, .03, .04], [0, 0, 0, 1])).collect()
    assert [(r["n"], r["observed"]) for r in got] == [(4, 0.25)]
    assert sum(r["n"] for r in M.reliability(long(spark, [1.0, 0.95], [1, 1])).collect()) == 2
    assert {r["bin"] for r in M.reliability(long(spark, [0.3, 0.6, 0.7], [1, 0, 1])).collect()} == {2, 5, 6}  # edges are 0.30000000000000004 …


def test_percentile(spark):
    ref = spark.createDataFrame([(i / 100,) for i in range(101)], "score double")
    ask = spark.createDataFrame([("a", 0.0), ("b", 0.5), ("c", 2.0), ("d", 0.5)], "patient_id string, score double")
    got = {r["patient_id"]: r["cohort_percentile"] for r in M.cohort_percentile(ask, ref).collect()}
    assert got == {"a": 0, "b": 50, "c": 100, "d": 50}
    assert M.cohort_percentile(ask, ref.limit(0)).first()["cohort_percentile"] is None


def curves(spark, n=1500):
    rng = np.random.default_rng(7)
    y = (rng.random(n) < 0.08).astype(int)
    raw = 0.3 / (1 + np.exp(-(rng.normal(-1, 1, n) + 1.5 * y)))
    return y, raw, spark.createDataFrame([(str(i), *[float(x)] * 6, int(t)) for i, (x, t) in enumerate(zip(raw, y))],
                                         "patient_id string, " + ", ".join(f"{c} double" for c in SCORE_COLUMNS) + ", label int")


def pav(x, y):
    """Pooled values at the sorted distinct points."""
    xs = np.unique(x)
    blocks = [[y[x == v].mean(), (x == v).sum(), 1] for v in xs]
    out = []
    for b in blocks:
        out.append(b)
        while len(out) > 1 and out[-2][0] >= out[-1][0]:
            q, p = out.pop(), out.pop()
            out.append([(p[0] * p[1] + q[0] * q[1]) / (p[1] + q[1]), p[1] + q[1], p[2] + q[2]])
    return xs, np.concatenate([[v] * k for v, _, k in out])


def test_isotonic_matches_pooling(spark):
    y, raw, df = curves(spark)
    cal = K.Calibrator("isotonic").fit(df)
    got = {r["patient_id"]: r["year_3"] for r in cal.apply(df).collect()}
    xs, vs = pav(raw, y)
    want = dict(zip(xs, vs))
    assert max(abs(got[str(i)] - want[x]) for i, x in enumerate(raw)) < 1e-9
    wide = spark.createDataFrame([("lo", *[-1.0] * 6), ("hi", *[9.0] * 6)], "patient_id string, " + ", ".join(f"{c} double" for c in SCORE_COLUMNS))
    ends = {r["patient_id"]: r["year_1"] for r in cal.apply(wide).collect()}
    assert ends == {"lo": pytest.approx(vs[0]), "hi": pytest.approx(vs[-1])}


def test_platt_is_the_penalised_optimum(spark, tmp_path):
    y, raw, df = curves(spark)
    cal = K.Calibrator("platt").fit(df)
    a, b = cal.models[1]
    p = 1 / (1 + np.exp(-(a * raw + b)))
    assert abs(((p - y) * raw).sum() + a) < 1e-6 and abs((p - y).sum()) < 1e-6
    cal.save(spark, str(tmp_path / "m"))
    assert K.Calibrator.load(spark, str(tmp_path / "m"), "platt", 0).models[1] == (a, b)
    before, after = (M.horizon_metrics(M.by_horizon(d)).filter("horizon = 'year_1'").first() for d in (df, cal.apply(df)))
    assert before["roc_auc"] == pytest.approx(after["roc_auc"])


def test_fit_guards(spark):
    _, _, df = curves(spark, 20)
    with pytest.raises(ValueError, match="both"):
        K.Calibrator().fit(df.withColumn("label", F.lit(0)))
    with pytest.raises(ValueError, match="no labelled"):
        K.Calibrator().fit(df.limit(0))
    with pytest.raises(ValueError):
        K.Calibrator("other")
    assert not K.Calibrator().apply(df).first()["calibrated"]

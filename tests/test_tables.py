"""Cohort, labels, splits, scans, inventory and job operators."""

import random

import pytest
from pyspark.sql import functions as F

from longview.operators import cohort as C
from longview.operators import inventory as I
from longview.operators import jobs as J
from longview.operators import labels as L
from longview.operators import splits as S
from longview.operators.scan import OrderedScan, exact_median
from longview.plans.cohort import build_cohort


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def hot_rows(spark, n=3000):
    """A third of the rows share one key; order values repeat."""
    random.seed(5)
    data = [("hot" if i % 3 == 0 else f"k{random.randint(0, 40)}", random.randint(0, 50), i, random.randint(0, 9)) for i in range(n)]
    return data, spark.createDataFrame(data, "k string, o int, u int, v int").repartition(7)


def test_running_sum_and_lag_over_a_hot_key(spark):
    data, df = hot_rows(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that groups span partitions
    try:
        scan = OrderedScan(df, ["k"], ["o", "u"])
        assert scan.df.filter("k = 'hot'").select("_part").distinct().count() > 1
        got = {r["u"]: (r["s"], r["p"]) for r in scan.running(s=F.col("v")).lag(p=F.col("u")).result().collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, state = {}, {}
    for k, o, u, v in sorted(data):
        total, prev = state.get(k, (0, None))
        want[u] = (total + v, prev)
        state[k] = (total + v, u)
    assert got == want


def test_scan_without_keys_and_row_number(spark):
    _, df = hot_rows(spark, 500)
    got = OrderedScan(df, [], ["o", "u"]).row_number("n").result().orderBy("n").select("n", "o", "u").collect()
    assert [r["n"] for r in got] == list(range(1, 501)) and [(r["o"], r["u"]) for r in got] == sorted((r["o"], r["u"]) for r in got)


def test_exact_median(spark):
    df = spark.createDataFrame([("a", 1), ("a", 4), ("a", 10), ("b", 2), ("b", 5), ("b", None)], "k string, v int")
    assert rows(exact_median(df, ["k"], "v", "m")) == [("a", 4.0), ("b", 3.5)]
    assert rows(exact_median(df, [], "v", "m")) == [(4.0,)]


def series(spark):
    data = [("p1", "T0", "s1", True, "sharp", 1.0, 200), ("p1", "T0", "s2", True, "smooth", 2.5, 100), ("p1", "T0", "s3", True, "smooth", 2.0, 90),
            ("p1", "T0", "s4", False, "smooth", 0.5, 300), ("p1", "T1", "s5", True, "smooth", None, 80), ("p1", "T1", "s6", True, "smooth", 5.0, 10),
            ("p2", "D2001", "s7", True, "other", 1.0, 50), ("p2", "D2001", "s8", True, "other", 1.0, 60)]
    return spark.createDataFrame(data, "patient_id string, round_key string, series_uid string, is_axial boolean, kernel_style string, slice_mm double, instance_count int")


def test_one_primary_per_round(spark):
    got = {r["series_uid"] for r in C.select_primary(series(spark)).filter("is_primary").collect()}
    assert got == {"s3", "s6", "s8"}  # thin and smooth, known thickness first, more slices


def test_primary_does_not_depend_on_row_order(spark):
    a = rows(C.select_primary(series(spark)).select("series_uid", "is_primary"))
    b = rows(C.select_primary(series(spark).repartition(5).orderBy(F.rand(2))).select("series_uid", "is_primary"))
    assert a == b


def test_pairs_and_latest(spark):
    s = C.select_primary(series(spark)).withColumn("series_size_mb", F.lit(40.0))
    pairs = C.fits_together(C.consecutive_pairs(s), 100e6)
    assert rows(pairs.select("patient_id", "from_round", "to_round", "fits")) == [("p1", "T0", "T1", True)]
    assert rows(C.fits_together(C.consecutive_pairs(s.withColumn("series_size_mb", F.lit(80.0))), 100e6).select("fits")) == [(False,)]
    assert rows(C.latest_round(s)) == [("p1", "s6", "T1"), ("p2", "s8", "D2001")]
    assert rows(C.patient_series(s, "p1").select("series_uid")) == [("s3",), ("s6",)]
    with pytest.raises(ValueError):
        C.cohort_listing(s, limit=5000)


def labels(spark, data):
    return spark.createDataFrame(data, "patient_id string, label int, label_source string")


def test_label_merge_priority(spark):
    cohort = spark.createDataFrame([(x,) for x in "abcde"], "patient_id string")
    weak = labels(spark, [("a", 1, "sybil"), ("b", 1, "sybil"), ("c", -1, "sybil"), ("z", 1, "sybil")])
    strong = labels(spark, [("a", 0, "cdas"), ("b", -1, "cdas"), ("c", -1, "cdas")])
    manual = labels(spark, [("d", 0, "manual")])
    got = rows(L.merge_labels(cohort, weak, manual, strong))
    assert got == [("a", 0, "cdas"), ("b", 1, "sybil"), ("c", -1, "sybil"), ("d", 0, "manual"), ("e", -1, "none")]
    assert rows(L.merge_labels(cohort)) == [(x, -1, "none") for x in "abcde"]


def test_stratified_split_is_exact_and_order_free(spark):
    data = [(str(100000 + i), 1 if i % 12 == 0 else 0) for i in range(1200)]
    df = spark.createDataFrame(data, "patient_id string, label int")
    out = S.stratified_split(df, "label")
    counts = {(r["label"], r["split"]): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert counts == {(1, "train"): 70, (1, "val"): 15, (1, "test"): 15, (0, "train"): 770, (0, "val"): 165, (0, "test"): 165}
    again = S.stratified_split(df.orderBy(F.rand(1)).repartition(6), "label")
    assert rows(out.select("patient_id", "split")) == rows(again.select("patient_id", "split"))
    tiny = S.stratified_split(spark.createDataFrame([("a", 1), ("b", 0)], "patient_id string, label int"), "label")
    assert tiny.count() == 2
    S.verify(out)


def test_guards(spark):
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "patient_id long")
    S.check_no_leakage(ids([1, 2, 3]), ids([4, 5]))
    with pytest.raises(AssertionError, match="1 patient"):
        S.check_no_leakage(ids([1, 2, 3]), ids([3, 4]).withColumn("patient_id", F.col("patient_id").cast("string")))
    splits = spark.createDataFrame([("1", "train"), ("2", "test"), ("3", "val")], "patient_id string, split string")
    S.guard_predictions(ids([2, 99]), splits, "test")
    with pytest.raises(AssertionError, match="train and held-out"):
        S.guard_predictions(ids([1, 2]), splits, "test")
    with pytest.raises(AssertionError, match="not in the 'test' split"):
        S.guard_predictions(ids([2, 3]), splits, "test")
    with pytest.raises(AssertionError, match="more than once"):
        S.verify(splits.union(splits))
    with pytest.raises(AssertionError, match="unknown split"):
        S.verify(spark.createDataFrame([("1", "dev")], "patient_id string, split string"))
    with pytest.raises(AssertionError):
        S.assert_train_only(splits)


def test_split_summary_shows_empty_splits(spark):
    df = spark.createDataFrame([("1", "train", 1, 2), ("2", "train", -1, 1)], "patient_id string, split string, label int, n_series int")
    got = {r["split"]: tuple(r)[1:] for r in S.split_summary(df).collect()}
    assert got == {"train": (2, 3, 1, 1, 1.0), "val": (0, 0, 0, 0, None), "test": (0, 0, 0, 0, None)}


def entries(spark, sizes):
    return spark.createDataFrame([("c", u, b * 10 ** 6, t) for t, (u, b) in enumerate(sizes)], "cache_root string, series_uid string, bytes long, last_used int")


def test_eviction(spark):
    plan = lambda e, incoming, cap: rows(I.eviction_plan(e, incoming * 10 ** 6, cap * 10 ** 6).select("series_uid"))
    three = entries(spark, [("b", 8), ("c", 8), ("a", 8)])  # a was touched last
    assert plan(three, 8, 25) == [("b",)] and plan(three, 1, 25) == [] and plan(three, 50, 10) == [("a",), ("b",), ("c",)]
    assert rows(I.cache_status(three, 48 * 10 ** 6).select("series", "used_fraction")) == [(3, 0.5)]


def test_completeness(spark):
    expected = spark.createDataFrame([("a", 2), ("b", 3), ("c", 0)], "series_uid string, instance_count int")
    slices = spark.createDataFrame([("a",), ("a",), ("b",)], "series_uid string")
    assert rows(I.incomplete_series(expected, slices)) == [("b", 3, 1), ("c", 0, 0)]
    listing = spark.createDataFrame([("a", 2), ("b.partial", 3), ("c", 0)], "series_uid string, files int")
    assert rows(I.complete_entries(listing)) == [("a", 2)]


EVENTS = [("j", 1, 1, "queued", "", None, None), ("j", 2, 2, "running", "get", "m", 0.1), ("j", 3, 3, "running", "get", "m", 0.1), ("j", 4, 4, "running", "get", "m", 0.2),
          ("j", 5, 5, "done", "get", "m", 1.0), ("j", 6, 6, "running", "x", "y", 0.3), ("k", 1, 7, "running", "a", None, None), ("k", 9, 8, "running", "a", None, None)]


def feed(spark, data=EVENTS):
    df = spark.createDataFrame(data, "job_id string, t long, seq long, status string, stage string, message string, progress double")
    return df.withColumn("ts", F.timestamp_seconds("t")).drop("t")


def test_changes_only_and_ttl(spark):
    assert [r[0] for r in rows(J.changes_only(feed(spark)).select("seq"))] == [1, 2, 4, 5, 7]
    late = lambda s: F.timestamp_seconds(F.lit(s))
    assert rows(J.live_jobs(feed(spark), late(100), 50).select("job_id")) == [("k",)]
    assert rows(J.live_jobs(feed(spark), late(50), 50).select("job_id")) == [("j",), ("k",)]
    assert rows(J.last_log_lines(feed(spark), 2).select("job_id", "seq")) == [("j", 5), ("j", 6), ("k", 7), ("k", 8)]
    assert [r["job_id"] for r in J.recent_jobs(feed(spark), 1).collect()] == ["j"]


def test_cohort_parses_its_index_once(spark):
    data = [("1", u, "S1", "20000101", text, "CT", 12, 1.0) for u, text in (("a", "0,OPA,GE,M1,LUNG,360,2.5"), ("b", "0 , OPA,GE,M1,STANDARD,360,2.5"), ("c", "0,OPL,GE,M1,STANDARD,360,2.5"))]
    index = spark.createDataFrame(data, "patient_id string, series_uid string, study_uid string, study_date string, series_description string, modality string, instance_count int, series_size_mb double")
    series = build_cohort(index)
    assert "regexp" not in series._jdf.queryExecution().optimizedPlan().toString().lower()
    assert rows(series.select("series_uid", "is_primary")) == [("a", False), ("b", True)]

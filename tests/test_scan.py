"""Ordered scans against plain loops: groups over many batches and partitions, nulls, no keys."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from longview.operators.scan import OrderedScan, exact_median


@pytest.fixture
def small(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 7)
    yield spark
    spark.conf.set(key, before)


def data(rng, n=400):
    keys = ["a"] * 250 + [None] * 20 + ["k%d" % rng.randrange(40) for _ in range(n - 270)]
    return [(k, rng.randrange(60), i, rng.choice([None, rng.randrange(9)]), rng.choice([0.1, 0.25, None]), rng.choice([None, "x", "y"])) for i, k in enumerate(keys)]


ORDER = lambda r: (r[0] is not None, r[0] or "", r[1], r[2])


@pytest.mark.parametrize("seed", [1, 2])
def test_scans_match_a_loop(small, seed):
    rows = sorted(data(random.Random(seed)), key=ORDER)
    df = small.createDataFrame(random.Random(0).sample(rows, len(rows)), "k string, o int, id int, n int, x double, s string")
    scan = OrderedScan(df, ["k"], ["o", "id"])
    got = scan.running(to=F.col("n"), upto=F.col("x")).lag(before=F.col("s"), had=F.lit(1)).row_number("i").total(whole=F.col("n"), all_x=F.col("x")).result()
    assert "_part" not in got.columns
    want = {}
    for _, own in itertools.groupby(rows, key=lambda r: r[0]):
        own = list(own)
        total, total_x, n, x, last = sum(r[3] or 0 for r in own), sum(r[4] or 0 for r in own), 0, 0.0, None
        for i, r in enumerate(own):
            n, x = n + (r[3] or 0), x + (r[4] or 0)
            want[r[2]] = (n, pytest.approx(x), last, 1 if i else None, i + 1, total, pytest.approx(total_x))
            last = r[5]
    assert {r["id"]: (r["to"], r["upto"], r["before"], r["had"], r["i"], r["whole"], r["all_x"]) for r in got.collect()} == want


def test_scan_without_keys_and_of_nothing(small):
    rows = [(i, i % 5) for i in range(100)]
    df = small.createDataFrame(rows, "o int, v int")
    got = OrderedScan(df, [], ["o"]).running(to=F.col("v")).total(whole=F.col("v")).lag(b=F.col("v")).result().orderBy("o").collect()
    assert [r["to"] for r in got] == list(itertools.accumulate(v for _, v in rows)) and {r["whole"] for r in got} == {200}
    assert [r["b"] for r in got] == [None, *[v for _, v in rows[:-1]]]
    none = OrderedScan(df.limit(0), ["v"], ["o"]).running(to=F.col("v")).lag(b=F.col("o")).total(t=F.col("v")).result()
    assert none.collect() == [] and none.columns == ["o", "v", "to", "b", "t"]


def test_one_shuffle_and_one_sort(small, tmp_path):
    path = str(tmp_path / "in")
    small.range(100).select((F.col("id") % 3).alias("k"), "id").write.parquet(path)
    scan = OrderedScan(small.read.parquet(path), ["k"], ["id"]).running(n=F.lit(1)).total(t=F.lit(1))
    plan = scan.result()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan  # the one layout is written already


def test_median_of_groups_over_partitions(small):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), rng.choice([None, *range(50)])) for _ in range(300)]
    got = {r["k"]: r["m"] for r in exact_median(small.createDataFrame(rows, "k string, v int"), ["k"], "v", "m").collect()}
    for k in "ab":
        own = sorted(v for a, v in rows if a == k and v is not None)
        assert got[k] == (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2

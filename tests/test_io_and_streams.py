"""Readers, writers, streaming feeds, plans, and the registered queries on the smallest data."""

import json
import random
from collections import Counter

import check
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from longview import schemas
from longview.catalog import base, exchange, reports
from longview.operators import jobs as J
from longview.plans import cohort as P
from longview.plans import results as R
from longview.sources import manifests as M
from longview.sources import sinks, tables
from longview.streaming import feeds

SF = "/root/testdata/sf0.001"


def test_label_files(spark, tmp_path):
    (tmp_path / "cdas_extract.csv").write_text("PID,Cancer\n 1 ,1\n2,0\n2,1\n3,\n4,0.0\n")
    got = {r[0]: tuple(r)[1:] for r in tables.read_label_file(spark, str(tmp_path / "cdas_extract.csv")).collect()}
    assert got == {"1": (1, "cdas"), "2": (0, "cdas"), "3": (-1, "cdas"), "4": (0, "cdas")}
    (tmp_path / "boxes.tsv").write_text("patient\tx\n7\t1\n8\t2\n")
    got = {r[0]: tuple(r)[1:] for r in tables.read_label_file(spark, str(tmp_path / "boxes.tsv"), source="sybil").collect()}
    assert got == {"7": (1, "sybil"), "8": (1, "sybil")}
    spark.createDataFrame([("9", 0.0)], "patient_id string, label double").write.parquet(str(tmp_path / "x.parquet"))
    assert [tuple(r) for r in tables.read_label_file(spark, str(tmp_path / "x.parquet")).collect()] == [("9", 0, "manual")]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="patient column"):
        tables.read_label_file(spark, str(tmp_path / "bad.csv"))


def test_outcomes_written_as_labels_read_back(spark, tmp_path):
    df = spark.createDataFrame([("1", 1, "idc"), ("2", 0, "idc")], "PatientID string, label int, label_source string")
    sinks.write_labels(df, str(tmp_path / "idc.csv"))
    assert {r[0]: r[1] for r in tables.read_label_file(spark, str(tmp_path / "idc.csv")).collect()} == {"1": 1, "2": 0}


def test_clinical_scores_and_index(spark, tmp_path):
    spark.createDataFrame([(" 1 ",), ("2",)], "pid string").write.parquet(str(tmp_path / "c/nlst_prsn"))
    assert [r[0] for r in tables.read_clinical(spark, str(tmp_path / "c"), "nlst_prsn").orderBy("pid").collect()] == ["1", "2"]
    with pytest.raises(ValueError, match="unknown clinical table"):
        tables.read_clinical(spark, str(tmp_path / "c"), "other")
    (tmp_path / "s.csv").write_text("PatientID," + ",".join(f"year_{h}" for h in range(1, 7)) + "\n1,.1,.2,.3,.4,.5,.6\n")
    assert tables.read_scores(spark, str(tmp_path / "s.csv")).first()["year_6"] == 0.6
    (tmp_path / "t.csv").write_text("PatientID,year_1\n1,.1\n")
    with pytest.raises(ValueError, match="missing"):
        tables.read_scores(spark, str(tmp_path / "t.csv"))
    names = list(schemas.INDEX_NAMES)
    row = {n: "x" for n in names} | {"Modality": "CT", "instanceCount": 20, "series_size_MB": 1.0}
    data = [dict(row, collection_id="nlst"), dict(row, collection_id="other"), dict(row, collection_id="nlst", instanceCount=3), dict(row, collection_id="nlst", Modality="MR")]
    spark.createDataFrame(data).write.parquet(str(tmp_path / "index"))
    df = tables.read_index(spark, str(tmp_path / "index"))
    assert df.count() == 1
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = tables.read_index(spark, str(tmp_path / "index"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(collection_id,nlst)" in plan and "GreaterThanOrEqual(instanceCount,10)" in plan


def test_manifest(spark, tmp_path):
    uuid = "0123456789ab-4def-89ab-0123456789abcd"[:36]
    (tmp_path / "m.s5cmd").write_text(f"# header\ncp s3://bucket/{uuid}/* .\nls\ncp s3://bucket/short/* .\n")
    lines = M.classify_lines(M.read_manifest(spark, str(tmp_path / "m.s5cmd"))).orderBy("line_no").collect()
    assert [r["kind"] for r in lines] == ["header", "copy", "copy"] and [r["crdc_series_uuid"] for r in lines] == [None, uuid, None]


def test_json_has_no_nan(spark, tmp_path):
    df = spark.createDataFrame([("a", float("nan"), [1.0, float("inf")]), ("b", 2.0, [None])], "k string, v double, w array<double>")
    docs = {r["k"]: json.loads(r["document"]) for r in sinks.json_document(df, "k").collect()}
    assert docs == {"a": {"k": "a", "v": None, "w": [1.0, None]}, "b": {"k": "b", "v": 2.0, "w": [None]}}
    sinks.write_json(df, str(tmp_path / "j"))
    sinks.write_table(df, str(tmp_path / "t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).filter("k = 'b'").count() == 1


def write_feed(spark, path, events, parts):
    for i, p in enumerate(parts):
        events.filter(p).coalesce(1).write.parquet(f"{path}/part{i}")


@pytest.fixture
def feed(spark):
    e = reports.events(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("job_id", "ts", "seq", "status", "stage", "message", "progress")


def test_streamed_changes_equal_batch(spark, tmp_path, feed):
    bounds = feed.select(F.percentile("seq", F.lit(0.4)), F.percentile("seq", F.lit(0.7))).first()
    parts = [F.col("seq") < bounds[0], (F.col("seq") >= bounds[0]) & (F.col("seq") < bounds[1]), F.col("seq") >= bounds[1]]
    write_feed(spark, str(tmp_path / "in"), feed, parts)
    src = spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    writer = feeds.stream_changes(src, "3650 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    q = feeds.start_with_state(spark, lambda: writer.trigger(availableNow=True).start())
    q.awaitTermination(240)
    got = Counter(r["seq"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == Counter(r["seq"] for r in J.changes_only(feed).collect()) and len(got) > 50


def test_streamed_expiry(spark, tmp_path):
    def rows(data):
        return spark.createDataFrame(data, "job_id string, t long, seq long, status string").withColumn("ts", F.timestamp_seconds("t")).select(
            "job_id", "ts", "seq", "status", F.lit("").alias("stage"), F.lit("").alias("message"), F.lit(0.0).alias("progress"))

    (tmp_path / "in").mkdir()
    batches = [[("a", 10, 1, "running"), ("a", 20, 2, "done"), ("b", 20, 3, "running")], [("b", 100000, 4, "running")], [("b", 200000, 5, "done")], [("c", 200001, 6, "running")]]
    src = spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    for i, b in enumerate(batches):
        rows(b).coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
        writer = feeds.stream_expiry(src, "1 second", 3600).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        q = feeds.start_with_state(spark, lambda: writer.trigger(availableNow=True).start())
        q.awaitTermination(120)
    got = sorted((r["job_id"], r["event"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", "finished"), ("a", "forgotten"), ("b", "finished")]


def _job_feed(spark, rows):
    return spark.createDataFrame([(j, None if t is None else t * 1_000_000, q, s, g, m, p) for j, t, q, s, g, m, p in rows],
                                 "job_id string, t long, seq long, status string, stage string, message string, progress double").withColumn(
        "ts", F.timestamp_micros("t")).select("job_id", "ts", "seq", "status", "stage", "message", "progress")


def test_streamed_changes_keep_jobs_of_a_bucket_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feeds, "JOB_BUCKETS", 2)  # many jobs share a state
    rng, rows = random.Random(3), []
    for k in range(594):
        rows.append((rng.choice([*map(str, range(12)), None]), 100 + k // 3, rng.choice([k, k, k + (1 << 60)]), rng.choice(["running"] * 30 + [None, "done"]),
                     rng.choice(["download", None]), None, rng.choice([0.0, 0.5, None])))
    (tmp_path / "in").mkdir()
    for i in range(3):
        _job_feed(spark, rows[198 * i : 198 * i + 198]).coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    src = spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    writer = feeds.stream_changes(src, "3650 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    feeds.start_with_state(spark, lambda: writer.trigger(availableNow=True).start()).awaitTermination(240)
    last, want = {}, Counter()
    for job, t, seq, *mark in sorted(rows, key=lambda r: (r[1], r[2])):
        if last.get(job, (None,))[0] != "done" and last.get(job) != tuple(mark):
            want[(job, seq, *mark)] += 1
            last[job] = tuple(mark)
    got = Counter((r["job_id"], r["seq"], r["status"], r["stage"], r["message"], r["progress"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == want and len(want) > 200


def test_silent_jobs_leave_a_shared_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feeds, "JOB_BUCKETS", 1)
    (tmp_path / "in").mkdir()
    same = ("running", "s", "m", 0.5)
    batches = [[("a", 10, 1, *same), ("b", 10, 2, *same)], [("b", 3000, 3, *same)], [("c", 5000, 4, *same)], [("c", 5001, 5, *same)], [("a", 5002, 6, *same), ("b", 5002, 7, *same)]]
    src = spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    for i, b in enumerate(batches):
        _job_feed(spark, b).coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
        writer = feeds.stream_changes(src, "1 second", 3600).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        feeds.start_with_state(spark, lambda w=writer: w.trigger(availableNow=True).start()).awaitTermination(120)
    # a is forgotten after an hour of silence and told again; b is not.
    assert sorted((r["job_id"], r["seq"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1), ("a", 6), ("b", 2), ("c", 4)]


def test_fed_changes_do_not_depend_on_the_files_of_the_input(spark, tmp_path):
    rows = [(e, 7 * e, e % 5, ["view", "click", "signup", "error"][e % 4], float(e * 37 % 150), "{}") for e in range(1, 900)]
    events = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double, props string").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    for k in range(9):  # each file spans all times
        events.where(F.col("event_id") % 9 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = exchange.QUERIES["changes_streamed"][0](spark, str(tmp_path))
    want = J.changes_only(reports.events(spark, str(tmp_path)))
    assert Counter(r["seq"] for r in got.collect()) == Counter(r["seq"] for r in want.collect())


def test_only_final_events_reach_the_expiry_state(spark):
    src = spark.readStream.schema(schemas.EVENTS).parquet(f"{SF}/events.parquet/..")
    plan = feeds.stream_expiry(src)._jdf.queryExecution().analyzed().toString()
    # Above the watermark, which every event moves, and kept there as it names the event time.
    assert plan.index("TransformWithState") < plan.index("Filter") < plan.index("EventTimeWatermark") and "isnull(ts" in plan


def test_new_series_are_processed_once(spark, tmp_path):
    schema = "series_uid string, n int"
    (tmp_path / "in").mkdir()
    src = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    for i, data in enumerate([[("a", 1), ("b", 2), ("a", 1)], [("b", 2), ("c", 3)]]):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"in/p{i}"))
        feeds.process_new_series(src, str(tmp_path / "done"), lambda df: df.withColumn("m", F.col("n") * 2), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "done")).drop("bucket").collect()) == [("a", 1, 2), ("b", 2, 4), ("c", 3, 6)]


def test_calibration_run(spark):
    out = R.calibration_run(base.scores(spark, SF), base.splits(spark, SF), "platt", "val")
    assert out["calibration"].first()["n_train"] > 0 and out["held_out"].count() == 6 and out["knots"].count() == 6


def test_splits_ignore_row_order(spark):
    a = P.build_splits(P.build_cohort(base.index(spark, SF), 2)).collect()
    b = P.build_splits(P.build_cohort(base.index(spark, SF).repartition(9).orderBy(F.rand(3)), 2)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "split" in df.columns


@pytest.mark.parametrize("name", ["select_primary", "download_progress", "changes_only", "eviction_plan", "stratified_split", "horizon_metrics", "find_regions", "patient_records", "summary_text"])
def test_registered_query_equals_its_sql(spark, name):
    assert check.compare(spark, check.connect(SF), SF, name).startswith("ok")


def test_every_query_is_known(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 120

"""Progress feeds and incremental processing as Structured Streaming (ST1-ST3)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from longview.operators.jobs import FINGERPRINT, JOB_TTL_SECONDS, TERMINAL, is_terminal

CHANGE_SCHEMA = "job_id string, ts timestamp, seq bigint, status string, stage string, message string, progress double"
OUT = ["job_id", "ts", "seq", *FINGERPRINT]
#: State of a bucket: its jobs as an Arrow table of the columns HELD, ``until`` in milliseconds.
CHANGE_STATE = "jobs binary"
HELD = pa.schema([*((c, pa.string()) for c in ("job_id", "status", "stage", "message")), ("progress", pa.float64()), ("ended", pa.bool_()), ("until", pa.int64())])
#: Jobs of one bucket are compared, and their state kept, together.
JOB_BUCKETS = 1024
NO_TIME = np.iinfo(np.int64).min
EXPIRY_SCHEMA = "job_id string, micros bigint, event string"
#: Keyed state with timers needs this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Folders of the processed series' table, by hash of their id.
BUCKETS = 256


def start_with_state(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a query with the store that keyed state needs; the session keeps its own setting for all others."""
    key, store = STORE
    before = spark.conf.get(key, None)
    spark.conf.set(key, store)
    try:
        return start()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _millis(micros: int) -> int:
    return int(micros / 1e6 * 1000)


def _packed(held: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, HELD) as out:
        out.write_table(pa.Table.from_pandas(held, HELD, preserve_index=False))
    return sink.getvalue().to_pybytes()


class _Changes(StatefulProcessor):
    """Keeps one fingerprint a job, those of a bucket of jobs together; a timer forgets jobs that have been silent for the time to live."""

    def __init__(self, ttl_seconds: int):
        self.ttl_ms = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getValueState("jobs", CHANGE_STATE)

    def held(self) -> pd.DataFrame:
        data = self.jobs.get()[0] if self.jobs.exists() else _packed(HELD.empty_table().to_pandas())
        return pa.ipc.open_stream(data).read_all().to_pandas()

    def hold(self, held: pd.DataFrame) -> None:
        """Keep these jobs; the timer fires when the first of them has to go."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(held):
            self.jobs.update((_packed(held),))
            self.handle.registerTimer(int(held["until"].min()))
        else:
            self.jobs.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new, held = pd.concat(list(rows), ignore_index=True), self.held()
        marks = [pd.concat([held[c], new[c]], ignore_index=True) for c in ["job_id", *FINGERPRINT]]
        code = np.stack([pd.factorize(m, use_na_sentinel=False)[0] for m in marks])  # a null is a value like others
        fresh = np.arange(code.shape[1]) >= len(held)
        time = np.r_[np.zeros(len(held), np.int64), new["ts"].to_numpy("datetime64[us]").view(np.int64)]
        known = time != NO_TIME
        ends = np.r_[held["ended"].to_numpy(bool), new["status"].isin(TERMINAL).to_numpy(bool)]
        none = np.r_[np.zeros(len(held), bool), new["no_seq"].to_numpy(bool)]
        # Each job's row of state first, then its events by (ts, seq), nulls last.
        order = np.lexsort((np.r_[np.zeros(len(held), np.int64), new["seq"]], none, time, ~known, fresh, code[0]))
        code, fresh, time, known, ends = code[:, order], fresh[order], time[order], known[order], ends[order]
        first = np.r_[True, code[0, 1:] != code[0, :-1]]
        changed = first | np.r_[True, (code[1:, 1:] != code[1:, :-1]).any(axis=0)]
        starts = np.flatnonzero(first)
        size = np.diff(np.r_[starts, len(first)])
        ended = np.cumsum(ends) - ends
        over = ended > np.repeat(ended[starts], size)
        out = new.iloc[order[fresh & changed & ~over] - len(held)]
        yield out[["job_id", "ts", *FINGERPRINT]].assign(seq=out["seq"].astype("Int64").mask(out["no_seq"]))[OUT]

        any_end = np.logical_or.reduceat(ends, starts)
        at = np.where(any_end, np.minimum.reduceat(np.where(ends, np.arange(len(ends)), len(ends)), starts), starts + size - 1)
        watermark = timerValues.getCurrentWatermarkInMs()
        newest = np.maximum.reduceat(np.where(fresh & known, time, NO_TIME), starts)
        until = np.where(newest == NO_TIME, watermark + 1, np.maximum((newest / 1e6 * 1000).astype(np.int64), watermark + 1 - self.ttl_ms)) + self.ttl_ms
        seen = np.logical_or.reduceat(fresh, starts)
        before = np.r_[held["until"].to_numpy(np.int64), np.zeros(len(new), np.int64)][order][starts]
        kept = pd.DataFrame({c: m.iloc[order[at]].to_numpy() for c, m in zip(["job_id", *FINGERPRINT], marks)})
        self.hold(kept.assign(ended=any_end, until=np.where(seen, until, before)))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = self.held()
        self.hold(held[held["until"] >= max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)])
        return iter([])

    def close(self) -> None:
        pass


def stream_changes(events: DataFrame, watermark: str = "10 minutes", ttl_seconds: int = JOB_TTL_SECONDS) -> DataFrame:
    """Events whose fingerprint changed, per job and across micro-batches (ST1).

    State is one fingerprint per job. It is keyed by bucket of jobs, so that a call compares the events of many jobs as columns:
    most jobs have few events in a micro-batch, and a call costs more than they do. A job's rows are put in (ts, seq) order within
    a micro-batch, which the source's maxFilesPerTrigger bounds; a job silent beyond the time to live leaves the state. Start the
    query through ``start_with_state``.
    """
    typed = events.select("job_id", "ts", F.coalesce("seq", F.lit(0)).alias("seq"), F.col("seq").isNull().alias("no_seq"), *FINGERPRINT).withWatermark("ts", watermark)
    bucketed = typed.withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(JOB_BUCKETS)))
    return bucketed.groupBy("bucket").transformWithStateInPandas(_Changes(ttl_seconds), CHANGE_SCHEMA, "Append", "EventTime")


class _Expiry(StatefulProcessor):
    """Keeps when a job finished, until its time to live has passed."""

    def __init__(self, ttl_seconds: int):
        self.ttl_ms = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.finished = handle.getValueState("finished", "micros bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        at = min((r["micros"] for r in rows if r["status"] in TERMINAL and r["micros"] is not None), default=None)
        if at is None or self.finished.exists():
            return
        self.finished.update((at,))
        # Timers fire only past the watermark, which trails the newest event.
        self.handle.registerTimer(max(_millis(at) + self.ttl_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield Row(job_id=key[0], micros=at, event="finished")

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        (at,) = self.finished.get()
        self.finished.clear()
        yield Row(job_id=key[0], micros=at, event="forgotten")

    def close(self) -> None:
        pass


def stream_expiry(events: DataFrame, watermark: str = "10 minutes", ttl_seconds: int = JOB_TTL_SECONDS) -> DataFrame:
    """One row when a job finishes and one when its time to live has passed (ST2); start it through ``start_with_state``.

    Only final events reach the keyed state; the filter names the event time, so that it stays behind the watermark, which all
    events move.
    """
    typed = events.select("job_id", "ts", F.unix_micros("ts").alias("micros"), "status").withWatermark("ts", watermark)
    ends = typed.where(is_terminal(F.col("status")) | F.col("ts").isNull())
    found = ends.groupBy("job_id").transformWithState(_Expiry(ttl_seconds), EXPIRY_SCHEMA, "Append", "EventTime")
    return found.select("job_id", F.timestamp_micros("micros").alias("finished_at"), "event")


def read_done(spark: SparkSession, path: str) -> DataFrame | None:
    """The table of processed series, None where nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def bucket_of(series_uid: str = "series_uid") -> F.Column:
    return F.pmod(F.xxhash64(series_uid), F.lit(BUCKETS)).cast("int")


def process_new_series(arrivals: DataFrame, done_path: str, work: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Run ``work`` once per new series, skipping those already written (ST3).

    The output lies in folders by hash of the id (column ``bucket``), and a batch reads only the folders of its own ids, however
    long the table has grown. A batch that is replayed after a failure drops what an earlier try wrote, by anti-join.
    """

    def handle(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(["series_uid"]).withColumn("bucket", bucket_of())
        done = read_done(batch.sparkSession, done_path)
        if done is not None:
            touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # BUCKETS at most
            fresh = fresh.join(done.where(F.col("bucket").isin(touched)).select("series_uid", "bucket"), ["series_uid", "bucket"], "left_anti")
        made = work(fresh.drop("bucket")).withColumn("bucket", bucket_of())
        made.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(done_path)

    return (arrivals.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())

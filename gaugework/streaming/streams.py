"""Structured Streaming forms of the evidence and log operators.

Functions take a streaming DataFrame and return one (or start a query), so the
same code serves files, tables or a message bus.  State keys are bounded by
watermarks or by the number of live entities.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import (
    DataStreamWriter,
    StatefulProcessor,
    StatefulProcessorHandle,
)

from gaugework.operators.oplog import DURATION_BUCKETS, LEGAL_TRANSITIONS
from gaugework.functions import bounded_duration, positive_duration, status_class
from gaugework.session import ROCKSDB_PROVIDER, scratch_path


def request_metrics_stream(
    events: DataFrame, width: str, delay: str, slide: str | None = None
) -> DataFrame:
    """Requests, errors and duration buckets per time window and route.

    ``events``: ``ts TIMESTAMP, route, status, duration_ns``.  Rows later than the
    watermark delay are dropped.
    """
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    nanos = bounded_duration("duration_ns")
    borders = [
        F.count_if(nanos <= int(round(b * 1e9))).alias(f"le_{b:g}".replace(".", "_"))
        for b in DURATION_BUCKETS
    ]
    grouped = events.withWatermark("ts", delay).groupBy(
        window.alias("w"), "route", status_class("status").alias("status_class")
    )
    return grouped.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status") >= 400).alias("errors"),
        F.sum(positive_duration("duration_ns").cast("decimal(38,0)")).cast("bigint").alias("sum_ns"),
        *borders,
    ).select(
        F.col("w.start").alias("window_start"), "route", "status_class", "requests", "errors", "sum_ns",
        *[f"le_{b:g}".replace(".", "_") for b in DURATION_BUCKETS],
    )


def run_metrics_stream(observations: DataFrame) -> DataFrame:
    """Metric summaries per run, kept current as observations arrive."""
    from gaugework.operators.aggregates import metric_summary

    return metric_summary(observations)


def first_submissions_stream(submissions: DataFrame, delay: str) -> DataFrame:
    """The first submission of each (kind, key); replays inside the delay vanish."""
    return submissions.withWatermark("at", delay).dropDuplicatesWithinWatermark(["kind", "key"])


FINAL_STATES = ("succeeded", "failed", "canceled")


def lifecycle_codes(status: str | None, at: int | None, row) -> Iterator[str]:
    """What is wrong with a transition after a job's last status and time."""
    if status is None and row["status"] != "queued":
        yield "not_queued_first"
    if status is not None and status != row["status"] and f"{status}>{row['status']}" not in LEGAL_TRANSITIONS:
        yield "illegal_transition"
    if at is not None and row["micros"] < at:
        yield "time_moved_back"
    if (row["status"] == "failed") != (row["error_code"] is not None):
        yield "error_code_mismatch"
    if row["attempt_count"] > row["max_attempts"]:
        yield "too_many_attempts"
    if row["status"] in ("running", "cancel_requested", "succeeded", "failed") and row["attempt_count"] < 1:
        yield "started_without_attempt"


class _Lifecycle(StatefulProcessor):
    """Current state per job and the violations found so far, in arrival order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", "status STRING, micros BIGINT, seq BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ordered = sorted(rows, key=lambda r: r["seq"])
        status, at = None, None
        if self._state.exists():
            status, at, _ = self._state.get()
        last = None
        for row in ordered:
            for code in lifecycle_codes(status, at, row):
                yield Row(job_id=key[0], seq=row["seq"], status=row["status"], code=code)
            status, at, last = row["status"], row["micros"], row["seq"]
        if last is not None:
            self._state.update((status, at, last))
            yield Row(job_id=key[0], seq=last, status=status, code=None)

    def close(self) -> None:
        pass


def lifecycle_stream(transitions: DataFrame) -> DataFrame:
    """Violations (code set) and the current state per batch (code NULL)."""
    use_rocksdb(transitions.sparkSession)
    timed = transitions.withColumn("micros", F.unix_micros("at"))
    return timed.groupBy("job_id").transformWithState(
        statefulProcessor=_Lifecycle(),
        outputStructType="job_id STRING, seq BIGINT, status STRING, code STRING",
        outputMode="Append",
        timeMode="None",
    )


class _LeaseWatch(StatefulProcessor):
    """One event-time timer per lease holder, moved by every heartbeat.

    A gap inside one batch is found by comparing neighbours, a gap at the end by the
    timer, so the result does not depend on how heartbeats fall into batches.
    """

    def __init__(self, lease_ms: int) -> None:
        self._lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._deadline = handle.getValueState("deadline", "ms BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self._deadline.get()[0] if self._deadline.exists() else None
        deadline = known
        for ms in sorted(r["ms"] for r in rows):
            if deadline is not None and ms > deadline:
                yield Row(holder=key[0], deadline_ms=deadline, event="lease_expired")
            deadline = max(ms + self._lease_ms, deadline or 0)
        if deadline != known:
            if known is not None:
                self._handle.deleteTimer(known)
            self._deadline.update((deadline,))
            self._handle.registerTimer(deadline)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._deadline.clear()
        yield Row(
            holder=key[0], deadline_ms=expiredTimerInfo.getExpiryTimeInMs(), event="lease_expired"
        )

    def close(self) -> None:
        pass


def lease_watch_stream(heartbeats: DataFrame, lease_seconds: int, delay: str) -> DataFrame:
    """``lease_expired`` for every holder whose next heartbeat missed its deadline.

    ``heartbeats``: ``holder STRING, ts TIMESTAMP``.
    """
    use_rocksdb(heartbeats.sparkSession)
    return (
        heartbeats.withColumn("ms", F.unix_millis("ts"))
        .withWatermark("ts", delay)
        .groupBy("holder")
        .transformWithState(
            statefulProcessor=_LeaseWatch(lease_seconds * 1_000),
            outputStructType="holder STRING, deadline_ms BIGINT, event STRING",
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


def gates_stream(
    observations: DataFrame,
    pairs: DataFrame,
    gates: DataFrame,
    path: str,
    checkpoint: str,
) -> DataStreamWriter:
    """A writer that refreshes gate results with every micro-batch.

    The stream keeps per (run, metric, slice) totals as state; each batch writes the
    gates of the totals so far as ``path/batch=<id>``, so a retried batch replaces
    its own output.
    """
    from gaugework.operators.aggregates import aggregate_comparison, slice_summary
    from gaugework.operators.gates import gate_results

    totals = slice_summary_stream(observations)

    def refresh(batch: DataFrame, batch_id: int) -> None:
        results = gate_results(aggregate_comparison(batch, pairs), gates, pairs)
        results.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        totals.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(refresh)
    )


def slice_summary_stream(observations: DataFrame) -> DataFrame:
    """Streaming ``slice_summary``: one stateful aggregation over exploded scopes."""
    from gaugework.operators.aggregates import _mean, _partials

    scopes = F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("slices"))
    exploded = observations.withColumn("slice", F.explode(scopes))
    return exploded.groupBy("run_id", "metric", "slice").agg(*_partials()).select(
        "run_id", "metric", "slice", "attempted", "scored", "skipped", "errors", _mean()
    )


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drain a bounded source once and read the result back.

    Output and checkpoint lie in the session's shared folder.  Append output is
    written by the parquet sink; complete output keeps only its last batch.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, "stream")
    out, checkpoint = f"{base}/out", f"{base}/checkpoint"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if mode == "append":
        query = writer.format("parquet").trigger(availableNow=True).start(out)
    else:
        def replace(batch: DataFrame, _batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        query = writer.foreachBatch(replace).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)

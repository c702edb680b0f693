"""Streaming operators, driven over the event and document files until drained."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.operators.scoring import score
from gaugework.plans import views
from gaugework.plans.history_queries import _LIFECYCLE, stamped
from gaugework.plans.registry import query, rounded
from gaugework.plans.views import FLAGSHIP, Views
from gaugework.session import scratch_path
from gaugework.streaming import incremental, reordered, streams

HOUR_MS = 3_600_000


def arriving(v: Views, name: str) -> DataFrame:
    """A table of the data directory, one file or a folder of them, as a file stream."""
    # A plain path has to be a folder, a pattern may be either.
    return v.spark.readStream.schema(v.table(name).schema).parquet(f"{v.sf_dir}/{name}.parque[t]")


def arriving_observations(v: Views) -> DataFrame:
    """Responses arrive; the reviewed cases are a static table."""
    attached = views.responses(arriving(v, "documents")).join(v.cases, "case_id")
    return score(attached, FLAGSHIP)


@query(
    "request_metrics_stream",
    """
    SELECT epoch_us(time_bucket(INTERVAL '6 hours', ts)) AS window_start, route,
           CASE WHEN status = 200 THEN '2xx' WHEN status = 404 THEN '4xx' ELSE '5xx' END AS status_class,
           count(*) AS requests, count(*) FILTER (status >= 400) AS errors, CAST(sum(duration_ns) AS BIGINT) AS sum_ns,
           count(*) FILTER (duration_ns <= 250000000) AS le_0_25, count(*) FILTER (duration_ns <= 2500000000) AS le_2_5
    FROM v_log WHERE time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' <= (SELECT max(ts) FROM v_log) - INTERVAL '1 hour'
    GROUP BY ALL""",
)
def _(v):
    """Windows the watermark has closed."""
    stream = streams.request_metrics_stream(views.log_events(arriving(v, "events")), "6 hours", "1 hour")
    found = streams.run_to_table(stream).select(
        "window_start", "route", "status_class", "requests", "errors", "sum_ns", "le_0_25", "le_2_5"
    )
    return stamped(found, "window_start")


@query(
    "run_metrics_stream",
    "SELECT run_id, metric, attempted, scored, skipped, errors, round(mean, 6) AS mean FROM v_slice_summary WHERE slice IS NULL",
)
def _(v):
    stream = streams.run_metrics_stream(arriving_observations(v))
    return rounded(streams.run_to_table(stream, "complete"), "mean")


@query("first_submissions_stream", "SELECT DISTINCT kind, key FROM v_submissions")
def _(v):
    stream = streams.first_submissions_stream(views.submissions(arriving(v, "events")), "60 days")
    return streams.run_to_table(stream).select("kind", "key")


@query("lifecycle_stream", _LIFECYCLE)
def _(v):
    stream = streams.lifecycle_stream(views.transitions(arriving(v, "events")))
    return streams.run_to_table(stream).filter(F.col("code").isNotNull()).select("job_id", "seq", "code")


@query(
    "lease_watch_stream",
    f"""
    WITH h AS (SELECT CAST(user_id AS VARCHAR) AS holder, epoch_us(ts) // 1000 AS ms, lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events)
    SELECT holder, ms + {6 * HOUR_MS} AS deadline_ms, 'lease_expired' AS event FROM h
    WHERE following > ms + {6 * HOUR_MS} OR (following IS NULL AND ms + {6 * HOUR_MS} <= (SELECT max(ms) FROM h) - {HOUR_MS})""",
)
def _(v):
    beats = arriving(v, "events").select(
        F.col("user_id").cast("string").alias("holder"), F.col("ts").cast("timestamp").alias("ts")
    )
    return streams.run_to_table(streams.lease_watch_stream(beats, 6 * 3_600, "1 hour"))


@query(
    "gates_stream",
    "SELECT pair_id, position, round(candidate_mean, 6) AS candidate_mean, round(delta, 6) AS delta, failure_codes, status FROM v_gate_results",
)
def _(v):
    """Gate results of the last micro-batch."""
    base = scratch_path(v.spark, "gates")
    writer = streams.gates_stream(arriving_observations(v), v.pairs, v.gates, f"{base}/out", f"{base}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    batches = v.spark.read.parquet(f"{base}/out")
    last = batches.agg(F.max("batch").alias("batch"))
    found = batches.join(last, "batch").select(
        "pair_id", "position", "candidate_mean", "delta", F.array_join("failure_codes", ",").alias("failure_codes"), "status"
    )
    return rounded(found, "candidate_mean", "delta")


@query(
    "ordered_lifecycle_stream",
    f"""
    WITH t AS (SELECT job_id, seq, (epoch_us(at_time) + 999) // 1000 AS ms FROM v_transitions),
         r AS (SELECT job_id, max(seq) AS reached FROM t WHERE ms + {HOUR_MS} <= (SELECT max(epoch_us(at_time)) // 1000 - {HOUR_MS} FROM v_transitions) GROUP BY job_id)
    SELECT l.job_id, l.seq, l.code FROM ({_LIFECYCLE}) l JOIN r ON r.job_id = l.job_id WHERE l.seq <= r.reached""",
)
def _(v):
    """Violations of the rows that the watermark has released."""
    stream = reordered.ordered_lifecycle_stream(views.transitions(arriving(v, "events")), "1 hour", "30 days")
    return streams.run_to_table(stream).filter(F.col("code").isNotNull()).select("job_id", "seq", "code")


@query(
    "submission_outcomes_stream",
    f"""
    WITH f AS (SELECT *, first_value(digest) OVER w AS d, row_number() OVER w AS n FROM v_submissions WINDOW w AS (PARTITION BY kind, key ORDER BY at_time, submission_id))
    SELECT submission_id, kind, key, CASE WHEN n = 1 THEN 'first' ELSE 'conflict' END AS outcome FROM f
    WHERE (n = 1 OR digest <> d) AND (epoch_us(at_time) + 999) // 1000 <= (SELECT max(epoch_us(at_time)) // 1000 - {HOUR_MS} FROM v_submissions)""",
)
def _(v):
    """First submissions and conflicts that the watermark has passed."""
    stream = reordered.submission_outcomes_stream(views.submissions(arriving(v, "events")), "1 hour", "60 days")
    return streams.run_to_table(stream).select("submission_id", "kind", "key", "outcome")


def _followed(v: Views) -> str:
    """Observations that arrive in four batches, merged into versioned totals and gates; their folder."""
    base = scratch_path(v.spark, "incremental")
    v.observations.repartition(4).write.parquet(f"{base}/in")
    stream = v.spark.readStream.schema(v.observations.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    writer = incremental.gate_changes_stream(stream, v.pairs, v.gates, f"{base}/out", f"{base}/checkpoint", whole_every=2)
    writer.trigger(availableNow=True).start().awaitTermination()
    return f"{base}/out"


@query(
    "gate_changes_stream",
    "SELECT pair_id, position, round(candidate_mean, 6) AS candidate_mean, round(delta, 6) AS delta, failure_codes, status FROM v_gate_results",
)
def _(v):
    """Gates after the last batch, of which each batch wrote only the changed ones."""
    found = incremental.current_gates(v.spark, _followed(v), v.pairs, v.gates).select(
        "pair_id", "position", "candidate_mean", "delta", F.array_join("failure_codes", ",").alias("failure_codes"), "status"
    )
    return rounded(found, "candidate_mean", "delta")


@query(
    "run_totals_stream",
    "SELECT run_id, metric, slice, attempted, scored, skipped, errors, round(mean, 6) AS mean FROM v_slice_summary",
)
def _(v):
    """Summaries per run, metric and slice after the last batch."""
    return rounded(incremental.current_totals(v.spark, _followed(v)), "mean")

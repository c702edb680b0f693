"""Batch analytics over operational logs: requests, jobs, leases and traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions import bounded_duration, bounded_label, positive_duration, retry_delay, severity, status_class
from gaugework.operators.ordered import with_previous

# Histogram borders in seconds, label vocabularies, legal transitions.
DURATION_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
HTTP_METHODS = ("DELETE", "GET", "HEAD", "OPTIONS", "PATCH", "POST", "PUT")
LEGAL_TRANSITIONS = (
    "queued>running",
    "queued>canceled",
    "running>queued",
    "running>cancel_requested",
    "running>succeeded",
    "running>failed",
    "cancel_requested>canceled",
)
MAX_RECOVERED = 10_000


def _request_labels(events: DataFrame, routes: Sequence[str], codes: Sequence[str]) -> DataFrame:
    return events.select(
        bounded_label("method", HTTP_METHODS, "OTHER").alias("method"),
        bounded_label("route", routes, "unmatched").alias("route"),
        status_class("status").alias("status_class"),
        severity("status").alias("severity"),
        bounded_label("error_code", codes, "unknown").alias("error_code"),
    )


def request_metrics(events: DataFrame, routes: Sequence[str], codes: Sequence[str]) -> DataFrame:
    """Requests by method, route and status class; labels stay in their vocabulary."""
    return (
        _request_labels(events, routes, codes)
        .groupBy("method", "route", "status_class", "severity")
        .agg(F.count(F.lit(1)).alias("requests"))
    )


def request_errors(events: DataFrame, routes: Sequence[str], codes: Sequence[str]) -> DataFrame:
    """Errors (status 400 and above) by route and stable code."""
    labelled = _request_labels(events, routes, codes).filter(F.col("severity") != "INFO")
    return labelled.groupBy("route", "error_code").agg(F.count(F.lit(1)).alias("errors"))


def _le(border: float) -> str:
    return f"{border:g}"


def duration_histogram(
    events: DataFrame, keys: Sequence[str], duration_ns: Column | str, buckets: Sequence[float] = DURATION_BUCKETS
) -> DataFrame:
    """Cumulative le-buckets with +Inf, sum and count, one row per key and border."""
    nanos = bounded_duration(duration_ns)
    rows = events.select(*keys, nanos.alias("_ns"), positive_duration(duration_ns).alias("_whole"))
    wide = rows.groupBy(*keys).agg(
        *[
            F.count_if(F.col("_ns") <= int(round(b * 1_000_000_000))).alias(f"_b{i}")
            for i, b in enumerate(buckets)
        ],
        F.count(F.lit(1)).alias("count"),
        F.sum(F.col("_whole").cast("decimal(38,0)")).alias("_sum"),
    )
    borders = [(_le(b), F.col(f"_b{i}")) for i, b in enumerate(buckets)] + [("+Inf", F.col("count"))]
    return wide.select(
        *keys,
        F.inline(F.array(*[F.struct(F.lit(n).alias("le"), c.alias("cumulative")) for n, c in borders])),
        "count",
        (F.col("_sum").cast("double") / 1e9).alias("sum_seconds"),
    )


def job_results(events: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Completed jobs by kind and outcome with their total duration, and severity."""
    kind = bounded_label("job_kind", kinds, "unknown")
    return (
        events.select(kind.alias("job_kind"), "outcome", positive_duration("duration_ns").alias("_ns"))
        .groupBy("job_kind", "outcome")
        .agg(
            F.count(F.lit(1)).alias("jobs"),
            (F.sum(F.col("_ns").cast("decimal(38,0)")).cast("double") / 1e9).alias("sum_seconds"),
        )
        .withColumn("severity", F.when(F.col("outcome") == "completed", "INFO").otherwise("WARNING"))
    )


def recovery_results(sweeps: DataFrame) -> DataFrame:
    """Recovery sweeps by outcome, how many jobs they brought back, and sweeps above a counter's limit."""
    found = F.greatest(F.coalesce("recovered_jobs", F.lit(0)), F.lit(0))
    return (
        sweeps.select(found.cast("bigint").alias("_n"))
        .groupBy(F.when(F.col("_n") > 0, "recovered").otherwise("none").alias("outcome"))
        .agg(
            F.count(F.lit(1)).alias("sweeps"),
            F.sum("_n").alias("recovered_jobs"),
            F.count_if(F.col("_n") > MAX_RECOVERED).alias("above_limit"),
        )
    )


def latest_attempts(jobs: DataFrame, attempts: DataFrame) -> DataFrame:
    """The current attempt of each job: attempt_number = attempt_count (equi-join)."""
    return jobs.join(
        attempts.select(
            F.col("job_id").alias("_job"),
            F.col("attempt_number"),
            F.col("status").alias("attempt_status"),
            "lease_expires_at",
        ),
        (F.col("job_id") == F.col("_job")) & (F.col("attempt_count") == F.col("attempt_number")),
    ).drop("_job")


def expired_leases(
    jobs: DataFrame, attempts: DataFrame, as_of: str, retry_base: int = 1, retry_max: int = 300
) -> DataFrame:
    """Jobs whose lease ran out by ``as_of``, and the state recovery gives them."""
    now = F.lit(as_of).cast("timestamp")
    active = jobs.filter(F.col("status").isin("running", "cancel_requested"))
    current = latest_attempts(active, attempts).filter(
        (F.col("attempt_status") == "running") & (F.col("lease_expires_at") <= now)
    )
    exhausted = F.col("attempt_count") >= F.col("max_attempts")
    following = (
        F.when(F.col("status") == "cancel_requested", "canceled")
        .when(exhausted, "failed")
        .otherwise("queued")
    )
    return current.select(
        "job_id", "status", "attempt_count", "lease_expires_at", following.alias("next_status"),
        F.when(following == "queued", retry_delay("attempt_count", retry_base, retry_max)).alias("delay_seconds"),
        F.when(following == "failed", "lease_expired").alias("error_code"),
    )


def claimable(jobs: DataFrame, as_of: str) -> DataFrame:
    """The backlog at ``as_of``; page it with ``keyset_page`` in claim order."""
    now = F.lit(as_of).cast("timestamp")
    return jobs.filter((F.col("status") == "queued") & (F.col("available_at") <= now)).select(
        "available_at", "created_at", "job_id"
    )


CLAIM_ORDER = ("available_at", "created_at", "job_id")


def lifecycle_violations(transitions: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """(job_id, seq, code) for illegal steps of recorded job histories.

    ``transitions``: ``job_id, seq, at, status, error_code, attempt_count,
    max_attempts``, where ``seq`` is the order of recording.
    """
    extra = {} if hot_rows is None else {"hot_rows": hot_rows}
    steps = with_previous(transitions, ["job_id"], F.col("seq"), ["seq"], ["status", "at"], **extra)
    known = F.col("_prev_status").isNotNull()
    step = F.concat_ws(">", "_prev_status", "status")
    codes = F.array_compact(
        F.array(
            F.when(~known & (F.col("status") != "queued"), "not_queued_first"),
            F.when(
                known & (F.col("_prev_status") != F.col("status")) & ~step.isin(*LEGAL_TRANSITIONS),
                "illegal_transition",
            ),
            F.when(F.col("at") < F.col("_prev_at"), "time_moved_back"),
            F.when((F.col("status") == "failed") != F.col("error_code").isNotNull(), "error_code_mismatch"),
            F.when(F.col("attempt_count") > F.col("max_attempts"), "too_many_attempts"),
            F.when(
                F.col("status").isin("running", "cancel_requested", "succeeded", "failed")
                & (F.col("attempt_count") < 1),
                "started_without_attempt",
            ),
        )
    )
    return steps.select("job_id", "seq", F.explode(codes).alias("code"))


def idempotency_conflicts(submissions: DataFrame) -> DataFrame:
    """Later submissions of a (kind, key): ``replay`` of the first digest or ``conflict``.

    ``submissions``: ``submission_id, kind, key, digest, at``.  The first digest is a
    combinable aggregate; the join back also carries a salt for reused keys.
    """
    first = submissions.groupBy("kind", "key").agg(
        F.min(F.struct("at", "submission_id", "digest")).alias("_f"), F.count(F.lit(1)).alias("_n")
    ).filter("_n > 1").select(
        "kind", "key",
        F.col("_f.submission_id").alias("_first"),
        F.col("_f.digest").alias("_digest"),
        F.explode(F.sequence(F.lit(0), F.when(F.col("_n") > 1_000_000, 31).otherwise(0))).alias("_salt"),
        F.when(F.col("_n") > 1_000_000, 32).otherwise(1).alias("_salts"),
    )
    hot = first.groupBy("kind", "key").agg(F.max("_salts").alias("_salts")).filter("_salts > 1")
    salted = submissions.alias("s").join(hot.alias("h"), ["kind", "key"], "left").select(
        "s.*",
        F.pmod(F.xxhash64("s.submission_id"), F.coalesce("h._salts", F.lit(1))).cast("int").alias("_salt"),
    )
    joined = salted.join(first.drop("_salts"), ["kind", "key", "_salt"]).filter(
        F.col("submission_id") != F.col("_first")
    )
    same = F.col("digest") == F.col("_digest")
    return joined.select(
        "submission_id", "kind", "key", F.when(same, "replay").otherwise("conflict").alias("outcome")
    )


def throughput_by_window(events: DataFrame, width: str, keys: Sequence[str] = ()) -> DataFrame:
    """Completed events per time bucket (the batch twin of the streaming form)."""
    grouped = events.groupBy(F.window(F.col("ts").cast("timestamp"), width).alias("w"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("events")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "events"
    )


TRACEPARENT = r"^00-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})$"


def _known_trace(c: Column) -> Column:
    return F.when(c.rlike(r"^[0-9a-f]{32}$") & (c != "0" * 32), c)


def valid_spans(spans: DataFrame) -> DataFrame:
    """Spans of known traces, with the trace that they link to in ``_link``; malformed or all-zero ids and links are ignored."""
    link = F.col("traceparent")
    whole = link.rlike(TRACEPARENT) & (F.regexp_extract(link, TRACEPARENT, 2) != "0" * 16)
    return spans.select(
        _known_trace(F.col("trace_id")).alias("trace_id"),
        "outcome",
        "duration_ms",
        F.when(whole, _known_trace(F.regexp_extract(link, TRACEPARENT, 1))).alias("_link"),
    ).filter(F.col("trace_id").isNotNull())


def rolled_traces(valid: DataFrame) -> DataFrame:
    return valid.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("spans"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
        F.max("duration_ms").alias("duration_ms"),
    )


def trace_rollup(spans: DataFrame) -> DataFrame:
    """Per trace and submission trace that it links to: spans, errors, duration, and the link's size.

    A trace without links has one row.

    ``spans``: ``trace_id, span_id, outcome, duration_ms, traceparent``.  Malformed
    or all-zero ids and links are ignored.
    """
    valid = valid_spans(spans)
    rolled = rolled_traces(valid)
    # Only traces with links meet the sizes of others, so absent links are no join key.
    links = valid.where("_link IS NOT NULL").select("trace_id", F.col("_link").alias("linked_trace_id")).distinct()
    sizes = rolled.select(
        F.col("trace_id").alias("linked_trace_id"), F.col("spans").alias("linked_spans"), F.col("errors").alias("linked_errors")
    )
    return rolled.join(links.join(sizes, "linked_trace_id", "left"), "trace_id", "left").select(
        "trace_id", "spans", "errors", "duration_ms", "linked_trace_id", "linked_spans", "linked_errors"
    )

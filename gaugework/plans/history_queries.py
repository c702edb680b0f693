"""Queries over run, decision and job history."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.operators import aggregates, chains, checks, history, joins, oplog
from gaugework.operators.ordered import first_occurrence, keyset_page
from gaugework.plans.registry import query, rounded
from gaugework.plans.views import Views

_MICROS = "epoch_us({})"


def stamp(c: str):
    """Timestamps compare as epoch microseconds."""
    return F.unix_micros(F.col(c)).alias(c)


def stamped(df, *columns: str):
    return df.select(*[stamp(c) if c in columns else F.col(c) for c in df.columns])


@query(
    "suite_targets",
    "SELECT DISTINCT suite, target_name, target_revision, target_digest FROM v_history_runs",
)
def _(v):
    return joins.suite_targets(v.history_runs)


@query(
    "suite_target_pairs",
    """
    SELECT DISTINCT d.suite, b.target_name AS baseline_target_name, b.target_revision AS baseline_target_revision, b.target_digest AS baseline_target_digest,
           c.target_name AS candidate_target_name, c.target_revision AS candidate_target_revision, c.target_digest AS candidate_target_digest
    FROM v_history_decisions d JOIN v_history_runs b ON b.run_id = d.baseline_run JOIN v_history_runs c ON c.run_id = d.candidate_run
    WHERE d.suite = b.suite AND d.suite = c.suite""",
)
def _(v):
    return joins.suite_target_pairs(v.history_decisions, v.history_runs)


@query(
    "decision_history",
    """
    SELECT d.decision_id, d.suite, d.status, epoch_us(d.created_at) AS created_at, d.baseline_run, d.candidate_run,
           b.target_name AS baseline_target_name, c.target_name AS candidate_target_name
    FROM v_history_decisions d JOIN v_history_runs b ON b.run_id = d.baseline_run JOIN v_history_runs c ON c.run_id = d.candidate_run
    WHERE d.suite = '2-HIGH' AND b.suite = '2-HIGH' AND c.suite = '2-HIGH' AND b.target_name = 'target-1' AND c.target_name = 'target-3'""",
)
def _(v):
    found = joins.decision_history(v.history_decisions, v.history_runs, "2-HIGH", "target-1", "target-3")
    return stamped(found, "created_at")


@query(
    "decision_run_mismatches",
    """
    WITH s AS (SELECT decision_id, 'baseline' AS role, baseline_run AS run_id, baseline_result_digest AS rd, dataset, baseline_target AS target, execution_mode FROM v_history_decisions
               UNION ALL SELECT decision_id, 'candidate', candidate_run, candidate_result_digest, dataset, candidate_target, execution_mode FROM v_history_decisions),
         j AS (SELECT s.decision_id, s.role, s.run_id, s.rd <> r.result_digest AS m1, s.dataset <> r.dataset AS m2, s.target <> r.target AS m3, s.execution_mode <> r.execution_mode AS m4
               FROM s JOIN v_history_runs r ON r.run_id = s.run_id)
    SELECT decision_id, role, run_id, 'result_digest_mismatch' AS code FROM j WHERE m1
    UNION ALL SELECT decision_id, role, run_id, 'dataset_mismatch' FROM j WHERE m2
    UNION ALL SELECT decision_id, role, run_id, 'target_mismatch' FROM j WHERE m3
    UNION ALL SELECT decision_id, role, run_id, 'execution_mode_mismatch' FROM j WHERE m4""",
)
def _(v):
    return joins.decision_run_mismatches(v.history_decisions, v.history_runs)


@query(
    "job_attempt_history",
    """
    WITH c AS (SELECT job_id, count(*) AS n, count(DISTINCT attempt_number) AS k, min(attempt_number) AS lo, max(attempt_number) AS hi FROM v_attempts GROUP BY job_id)
    SELECT j.job_id, j.status AS job_status, j.attempt_count,
           CASE WHEN c.n IS NULL THEN j.attempt_count = 0 ELSE c.n = j.attempt_count AND c.k = c.n AND c.lo = 1 AND c.hi = c.n END AS complete,
           a.attempt_number, a.status AS attempt_status, epoch_us(a.started_at) AS started_at
    FROM v_jobs j LEFT JOIN c ON c.job_id = j.job_id LEFT JOIN v_attempts a ON a.job_id = j.job_id""",
)
def _(v):
    return stamped(joins.job_attempt_history(v.jobs, v.attempts), "started_at")


@query(
    "operational_snapshot",
    """
    SELECT (SELECT count(*) FROM v_jobs WHERE status = 'queued') AS queued_jobs, (SELECT count(*) FROM v_jobs WHERE status = 'failed') AS failed_jobs,
           (SELECT CAST(sum(input_units) AS BIGINT) FROM v_history_runs) AS input_units, (SELECT CAST(sum(output_units) AS BIGINT) FROM v_history_runs) AS output_units""",
)
def _(v):
    return aggregates.operational_snapshot(v.jobs, v.history_runs)


_FIRST = """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, n = 1 AS is_first FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem)"""


@query("first_occurrence", _FIRST)
def _(v):
    rows = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return first_occurrence(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])


@query(
    "latest_attempt",
    """
    SELECT job_id, attempt_number, epoch_us(started_at) AS started_at FROM (
      SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY attempt_number DESC, started_at DESC, lease_expires_at DESC, status DESC) AS n FROM v_attempts)
    WHERE n = 1""",
)
def _(v):
    ordered = v.attempts.select("job_id", "attempt_number", "started_at", "lease_expires_at", "status")
    return stamped(history.latest_attempt(ordered), "started_at").select("job_id", "attempt_number", "started_at")


@query(
    "attempt_gaps",
    """
    SELECT * FROM (SELECT job_id, count(*) AS attempts, count(DISTINCT attempt_number) AS distinct_numbers, min(attempt_number) AS least, max(attempt_number) AS most,
             min(attempt_number) <> 1 AS starts_late, max(attempt_number) - min(attempt_number) + 1 <> count(DISTINCT attempt_number) AS has_gap,
             count(*) <> count(DISTINCT attempt_number) AS has_repeat FROM v_attempts GROUP BY job_id)
    WHERE starts_late OR has_gap OR has_repeat""",
)
def _(v):
    return history.attempt_gaps(v.attempts)


_NEWEST = "SELECT suite, run_id, row_number() OVER (PARTITION BY suite ORDER BY created_at DESC, run_id DESC) AS position FROM v_history_runs"


@query("newest_first", _NEWEST)
def _(v):
    return history.newest_first(v.history_runs.select("suite", "run_id", "created_at")).drop("created_at")


@query("newest_first_ranges", _NEWEST)
def _(v):
    """The same ranking with every suite treated as hot."""
    rows = v.history_runs.select("suite", "run_id", "created_at")
    return history.newest_first(rows, hot_rows=50).drop("created_at")


_TREND = """
    SELECT suite, target, 'usage.mean' AS metric, run_id, round(mean, 6) AS mean, lag(run_id) OVER w AS previous_run_id, round(mean - lag(mean) OVER w, 6) AS change
    FROM (SELECT *, input_units / 1000.0 AS mean FROM v_history_runs) WINDOW w AS (PARTITION BY suite, target ORDER BY created_at, run_id)"""


def _trend(v: Views, **options):
    summary = v.history_runs.select("run_id", F.lit("usage.mean").alias("metric"), (F.col("input_units") / 1000.0).alias("mean"))
    found = history.run_trend(summary, v.history_runs.select("run_id", "suite", "target", "created_at"), **options)
    return rounded(found, "mean", "change")


@query("run_trend", _TREND)
def _(v):
    return _trend(v)


@query("run_trend_ranges", _TREND)
def _(v):
    return _trend(v, hot_rows=50)


@query(
    "keyset_page",
    """
    SELECT o_orderkey, epoch_us(o_orderdate) AS o_orderdate, count(*) OVER () > 40 AS has_next FROM orders
    WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1998-06-01 00:00:00', 500) ORDER BY o_orderdate, o_orderkey LIMIT 40""",
)
def _(v):
    rows = v.table("orders").select("o_orderkey", "o_orderdate")
    page = keyset_page(rows, ["o_orderdate", "o_orderkey"], ["1998-06-01 00:00:00", 500], 40)
    return page.withColumn("o_orderdate", F.unix_micros(F.col("o_orderdate").cast("timestamp")))


@query(
    "list_runs",
    """
    SELECT run_id, suite, dataset, target, status, epoch_us(created_at) AS created_at, count(*) OVER () > 25 AS has_next FROM v_history_runs
    WHERE dataset = 'dataset-3' AND (created_at, run_id) < (TIMESTAMP '1999-01-01 00:00:00', 'run-5') ORDER BY created_at DESC, run_id DESC LIMIT 25""",
)
def _(v):
    page = history.list_view(v.history_runs, "runs", {"dataset": "dataset-3"}, ["1999-01-01 00:00:00", "run-5"], 25)
    return stamped(page, "created_at")


@query(
    "list_jobs",
    """
    SELECT job_id, kind, status, epoch_us(created_at) AS created_at, count(*) OVER () > 30 AS has_next FROM v_jobs
    WHERE kind = 'run' AND status = 'queued' ORDER BY created_at DESC, job_id DESC LIMIT 30""",
)
def _(v):
    return stamped(history.list_view(v.jobs, "jobs", {"kind": "run", "status": "queued"}, None, 30), "created_at")


@query(
    "list_decisions",
    """
    SELECT decision_id, suite, status, baseline_target, candidate_target, epoch_us(created_at) AS created_at, count(*) OVER () > 50 AS has_next FROM v_history_decisions
    WHERE status = 'failed' AND suite = '1-URGENT' ORDER BY created_at DESC, decision_id DESC LIMIT 50""",
)
def _(v):
    page = history.list_view(v.history_decisions, "decisions", {"status": "failed", "suite": "1-URGENT"})
    return stamped(page, "created_at")


@query(
    "list_targets",
    """
    SELECT DISTINCT suite, target_name AS name, target_revision AS revision, false AS has_next FROM v_history_runs WHERE suite = '5-LOW'""",
)
def _(v):
    targets = joins.suite_targets(v.history_runs).select(
        "suite", F.col("target_name").alias("name"), F.col("target_revision").alias("revision")
    ).distinct()
    return history.list_view(targets, "targets", {"suite": "5-LOW"}, None, 100)


@query(
    "list_target_pairs",
    """
    SELECT DISTINCT suite, baseline_target, candidate_target, false AS has_next FROM v_history_decisions WHERE suite = '3-MEDIUM'""",
)
def _(v):
    pairs = v.history_decisions.select("suite", "baseline_target", "candidate_target").distinct()
    return history.list_view(pairs, "target_pairs", {"suite": "3-MEDIUM"}, None, 100)


@query(
    "list_datasets",
    """
    SELECT 'source/' || source AS name, 1 AS revision, 'd' || count(*) AS digest, count(*) AS case_count, max(doc_id) AS created_at, false AS has_next
    FROM documents WHERE source = 'src7' GROUP BY source""",
)
def _(v):
    rows = v.table("documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("case_count"), F.max("doc_id").alias("created_at")
    ).select(
        F.concat(F.lit("source/"), "source").alias("name"), F.lit(1).alias("revision"),
        F.concat(F.lit("d"), "case_count").alias("digest"), "case_count", "created_at",
    )
    from gaugework.operators.ordered import keyset_page as page

    return page(rows.filter(F.col("name") == "source/src7"), ["name", "revision"], None, 10)


@query(
    "list_suites",
    """
    SELECT DISTINCT suite AS name, 1 AS revision, false AS has_next FROM v_history_runs WHERE suite > '2'""",
)
def _(v):
    suites = v.history_runs.select(F.col("suite").alias("name"), F.lit(1).alias("revision")).distinct()
    return keyset_page(suites, ["name", "revision"], ["2", 0], 100)


@query(
    "history_audit",
    f"""
    WITH h AS (SELECT position, run_id, suite, created_at FROM ({_NEWEST.replace('SELECT suite', 'SELECT created_at, suite')}) WHERE suite = '4-NOT SPECIFIED')
    SELECT run_id AS id, 'duplicate_id' AS code FROM h WHERE position % 50 = 7
    UNION ALL SELECT run_id, 'other_suite' FROM h WHERE position % 60 = 5
    UNION ALL SELECT a.run_id, 'not_newest_first' FROM h a WHERE position % 70 = 9""",
)
def _(v):
    """One suite's ranked history with repeated ids, foreign rows and wrong times."""
    suite = "4-NOT SPECIFIED"
    runs = v.history_runs.filter(F.col("suite") == suite).select("suite", "run_id", "created_at")
    listed = history.newest_first(runs)
    place = F.col("position")
    rows = listed.select(
        (place * 2).alias("position"),
        F.col("run_id").alias("id"),
        F.when(place % 60 == 5, "foreign").otherwise(F.col("suite")).alias("suite"),
        F.when(place % 70 == 9, F.lit("2100-01-01").cast("timestamp")).otherwise(F.col("created_at")).alias("created_at"),
    )
    again = rows.filter((place / 2) % 50 == 7).withColumn("position", place + 1_000_000_001)
    dense = rows.withColumn("position", (place / 2).cast("bigint"))
    return checks.history_audit(dense.unionByName(again), suite).filter(
        (F.col("code") != "other_suite") | F.col("id").isNotNull()
    ).distinct()


# --- operational logs -----------------------------------------------------------------
_ROUTES = ("click", "error", "purchase", "view")
_CODES = ("internal_error",)
_ROUTE_SQL = "CASE WHEN route = 'signup' THEN 'unmatched' ELSE route END"


@query(
    "request_metrics",
    f"""
    SELECT CASE WHEN method = 'BREW' THEN 'OTHER' ELSE method END AS method, {_ROUTE_SQL} AS route,
           CASE WHEN s >= 500 THEN '5xx' WHEN s >= 400 THEN '4xx' ELSE '2xx' END AS status_class,
           CASE WHEN s >= 500 THEN 'ERROR' WHEN s >= 400 THEN 'WARNING' ELSE 'INFO' END AS severity, count(*) AS requests
    FROM (SELECT *, CASE WHEN status = 999 THEN 500 ELSE status END AS s FROM v_log) GROUP BY ALL""",
)
def _(v):
    return oplog.request_metrics(v.log_events, _ROUTES, _CODES)


@query(
    "request_errors",
    f"""
    SELECT {_ROUTE_SQL} AS route, CASE WHEN error_code = 'internal_error' THEN error_code ELSE 'unknown' END AS error_code, count(*) AS errors
    FROM v_log WHERE status >= 400 GROUP BY ALL""",
)
def _(v):
    return oplog.request_errors(v.log_events, _ROUTES, _CODES)


@query(
    "duration_histogram",
    """
    SELECT method, route, b.le, count(*) FILTER (duration_ns <= b.ns) AS cumulative, count(*) AS count, round(sum(duration_ns) / 1e9, 6) AS sum_seconds
    FROM v_log CROSS JOIN (VALUES ('0.005', 5000000), ('0.01', 10000000), ('0.025', 25000000), ('0.05', 50000000), ('0.1', 100000000), ('0.25', 250000000),
      ('0.5', 500000000), ('1', 1000000000), ('2.5', 2500000000), ('5', 5000000000), ('10', 10000000000), ('+Inf', 9000000000000000)) b(le, ns)
    GROUP BY method, route, b.le""",
)
def _(v):
    return rounded(oplog.duration_histogram(v.log_events, ["method", "route"], "duration_ns"), "sum_seconds")


@query(
    "job_results",
    """
    SELECT CASE WHEN route = 'error' THEN 'unknown' ELSE route END AS job_kind, CASE WHEN status = 200 THEN 'completed' ELSE 'failed' END AS outcome,
           count(*) AS jobs, round(sum(duration_ns) / 1e9, 6) AS sum_seconds, CASE WHEN status = 200 THEN 'INFO' ELSE 'WARNING' END AS severity
    FROM v_log GROUP BY ALL""",
)
def _(v):
    rows = v.log_events.select(
        F.col("route").alias("job_kind"), F.when(F.col("status") == 200, "completed").otherwise("failed").alias("outcome"), "duration_ns"
    )
    return rounded(oplog.job_results(rows, ["click", "purchase", "signup", "view"]), "sum_seconds")


@query(
    "recovery_results",
    """
    SELECT CASE WHEN n > 0 THEN 'recovered' ELSE 'none' END AS outcome, count(*) AS sweeps, CAST(sum(n) AS BIGINT) AS recovered_jobs,
           count(*) FILTER (n > 10000) AS above_limit
    FROM (SELECT greatest(k - 20, 0) * 200 AS n FROM v_log) GROUP BY 1""",
)
def _(v):
    return oplog.recovery_results(v.log_events.select(((F.col("k") - 20) * 200).alias("recovered_jobs")))


_AS_OF = "1999-01-01 00:00:00"


@query(
    "expired_leases",
    f"""
    SELECT j.job_id, j.status, j.attempt_count, epoch_us(a.lease_expires_at) AS lease_expires_at,
           CASE WHEN j.status = 'cancel_requested' THEN 'canceled' WHEN j.attempt_count >= 3 THEN 'failed' ELSE 'queued' END AS next_status,
           CASE WHEN j.status = 'running' AND j.attempt_count < 3 THEN CAST(least(5 * pow(2, j.attempt_count - 1), 8) AS BIGINT) END AS delay_seconds,
           CASE WHEN j.status = 'running' AND j.attempt_count >= 3 THEN 'lease_expired' END AS error_code
    FROM v_jobs j JOIN v_attempts a ON a.job_id = j.job_id AND a.attempt_number = j.attempt_count
    WHERE j.status IN ('running', 'cancel_requested') AND a.status = 'running' AND a.lease_expires_at <= TIMESTAMP '{_AS_OF}'""",
)
def _(v):
    return stamped(oplog.expired_leases(v.jobs, v.attempts, _AS_OF, 5, 8), "lease_expires_at")


@query(
    "claimable",
    f"""
    SELECT epoch_us(available_at) AS available_at, epoch_us(created_at) AS created_at, job_id FROM v_jobs
    WHERE status = 'queued' AND available_at <= TIMESTAMP '{_AS_OF}'""",
)
def _(v):
    return stamped(oplog.claimable(v.jobs, _AS_OF), "available_at", "created_at")


@query(
    "claim_page",
    f"""
    SELECT epoch_us(available_at) AS available_at, epoch_us(created_at) AS created_at, job_id, count(*) OVER () > 20 AS has_next FROM v_jobs
    WHERE status = 'queued' AND available_at <= TIMESTAMP '{_AS_OF}' ORDER BY 1, 2, 3 LIMIT 20""",
)
def _(v):
    page = keyset_page(oplog.claimable(v.jobs, _AS_OF), oplog.CLAIM_ORDER, None, 20)
    return stamped(page, "available_at", "created_at")


_LIFECYCLE = """
    WITH s AS (SELECT *, lag(status) OVER w AS ps, lag(at_time) OVER w AS pa FROM v_transitions WINDOW w AS (PARTITION BY job_id ORDER BY seq))
    SELECT job_id, seq, 'not_queued_first' AS code FROM s WHERE ps IS NULL AND status <> 'queued'
    UNION ALL SELECT job_id, seq, 'illegal_transition' FROM s WHERE ps <> status AND ps || '>' || status NOT IN
      ('queued>running', 'queued>canceled', 'running>queued', 'running>cancel_requested', 'running>succeeded', 'running>failed', 'cancel_requested>canceled')
    UNION ALL SELECT job_id, seq, 'time_moved_back' FROM s WHERE at_time < pa
    UNION ALL SELECT job_id, seq, 'error_code_mismatch' FROM s WHERE (status = 'failed') <> (error_code IS NOT NULL)
    UNION ALL SELECT job_id, seq, 'too_many_attempts' FROM s WHERE attempt_count > max_attempts
    UNION ALL SELECT job_id, seq, 'started_without_attempt' FROM s WHERE status IN ('running', 'cancel_requested', 'succeeded', 'failed') AND attempt_count < 1"""


@query("lifecycle_violations", _LIFECYCLE)
def _(v):
    return oplog.lifecycle_violations(v.transitions)


@query("lifecycle_violations_ranges", _LIFECYCLE)
def _(v):
    """The same check with every job treated as hot."""
    return oplog.lifecycle_violations(v.transitions, hot_rows=10)


@query(
    "idempotency_conflicts",
    """
    WITH f AS (SELECT *, first_value(digest) OVER w AS d, row_number() OVER w AS n FROM v_submissions WINDOW w AS (PARTITION BY kind, key ORDER BY at_time, submission_id))
    SELECT submission_id, kind, key, CASE WHEN digest = d THEN 'replay' ELSE 'conflict' END AS outcome FROM f WHERE n > 1""",
)
def _(v):
    return oplog.idempotency_conflicts(v.submissions)


@query(
    "throughput_by_window",
    """
    SELECT epoch_us(time_bucket(INTERVAL '6 hours', ts)) AS window_start, epoch_us(time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours') AS window_end,
           route, count(*) AS events
    FROM v_log GROUP BY ALL""",
)
def _(v):
    return stamped(oplog.throughput_by_window(v.log_events, "6 hours", ["route"]), "window_start", "window_end")


@query(
    "trace_rollup",
    """
    WITH s AS (SELECT CASE WHEN user_id % 10 <> 0 THEN md5('t' || user_id || '-' || (event_id // 50)) END AS trace_id,
                      CASE WHEN route = 'error' THEN 'error' ELSE 'ok' END AS outcome, duration_ns // 1000000 AS duration_ms,
                      CASE WHEN k % 4 = 0 THEN md5('t' || ((user_id + 1) % 10) || '-' || (event_id // 50)) END AS link
               FROM v_log),
         r AS (SELECT trace_id, count(*) AS spans, count(*) FILTER (outcome = 'error') AS errors, max(duration_ms) AS duration_ms
               FROM s WHERE trace_id IS NOT NULL GROUP BY trace_id),
         k AS (SELECT DISTINCT trace_id, link FROM s WHERE trace_id IS NOT NULL AND link IS NOT NULL)
    SELECT r.trace_id, r.spans, r.errors, r.duration_ms, k.link AS linked_trace_id, l.spans AS linked_spans, l.errors AS linked_errors
    FROM r LEFT JOIN k ON k.trace_id = r.trace_id LEFT JOIN r l ON l.trace_id = k.link""",
)
def _(v):
    user, block = F.col("user_id"), F.floor(F.col("event_id") / 50)

    def trace(u):
        return F.md5(F.concat(F.lit("t"), u, F.lit("-"), block))

    k = F.col("k")
    link = (
        F.when(k % 4 == 0, F.concat(F.lit("00-"), trace((user + 1) % 10), F.lit("-00000000000000aa-01")))
        .when(k % 4 == 1, F.concat(F.lit("00-"), trace(user), F.lit("-0000000000000000-01")))
        .when(k % 4 == 2, F.concat(F.lit("01-"), trace(user), F.lit("-00000000000000aa-01")))
    )
    spans = v.log_events.select(
        F.when(user % 10 == 0, F.when(k % 2 == 0, "0" * 32).otherwise("XYZ")).otherwise(trace(user)).alias("trace_id"),
        F.when(F.col("route") == "error", "error").otherwise("ok").alias("outcome"),
        F.floor(F.col("duration_ns") / 1_000_000).alias("duration_ms"),
        link.alias("traceparent"),
    )
    return oplog.trace_rollup(spans)


@query(
    "trace_chains",
    """
    SELECT * FROM (WITH RECURSIVE s AS (
      SELECT md5('c' || user_id) AS trace_id, route = 'error' AS failed,
             CASE WHEN user_id % 30 = 4 THEN md5('c' || (user_id + 1)) WHEN user_id % 30 = 5 THEN md5('c' || (user_id - 1))
                  WHEN user_id > 1 THEN md5('c' || (user_id // 2)) END AS link
      FROM v_log),
    r AS (SELECT trace_id, count(*) AS spans, count(*) FILTER (failed) AS errors FROM s GROUP BY trace_id),
    p AS (SELECT trace_id, min(link) AS link FROM s WHERE link IS NOT NULL GROUP BY trace_id),
    w AS (SELECT trace_id, trace_id AS here, 0 AS depth, [trace_id] AS way FROM r
          UNION ALL SELECT w.trace_id, p.link, w.depth + 1, list_append(w.way, p.link) FROM w JOIN p ON p.trace_id = w.here WHERE NOT list_contains(w.way, p.link)),
    e AS (SELECT w.*, p.link FROM w LEFT JOIN p ON p.trace_id = w.here WHERE p.link IS NULL OR list_contains(w.way, p.link)),
    m AS (SELECT e.trace_id, link IS NOT NULL AS cyclic, CASE WHEN link IS NULL THEN depth END AS depth,
                 CASE WHEN link IS NULL THEN here ELSE list_min(way[list_position(way, link):]) END AS root_trace_id, spans, errors
          FROM e JOIN r ON r.trace_id = e.trace_id)
    SELECT trace_id, root_trace_id, CAST(depth AS BIGINT) AS depth, cyclic, count(*) OVER g AS chain_traces,
           CAST(sum(spans) OVER g AS BIGINT) AS chain_spans, CAST(sum(errors) OVER g AS BIGINT) AS chain_errors
    FROM m WINDOW g AS (PARTITION BY root_trace_id))""",
)
def _(v):
    """Traces of users that link to those of half their number; some link to each other."""
    user = F.col("user_id")

    def trace(u):
        return F.md5(F.concat(F.lit("c"), u))

    other = F.when(user % 30 == 4, trace(user + 1)).when(user % 30 == 5, trace(user - 1)).when(
        user > 1, trace(F.floor(user / 2))
    )
    spans = v.log_events.select(
        trace(user).alias("trace_id"),
        F.when(F.col("route") == "error", "error").otherwise("ok").alias("outcome"),
        F.floor(F.col("duration_ns") / 1_000_000).alias("duration_ms"),
        F.concat(F.lit("00-"), other, F.lit("-00000000000000aa-01")).alias("traceparent"),
    )
    return chains.trace_chains(spans)

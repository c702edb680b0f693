"""The derived tables of ``views`` as SQL common table expressions."""

from __future__ import annotations

import re

from gaugework.plans.views import GATE_ROWS, SQL_TEMPLATES


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_TEMPLATE_LIST = "[" + ", ".join(_text(t) for t in SQL_TEMPLATES) + "]"

VIEWS: dict[str, str] = {
    "v_cases": """
        SELECT 'documents' AS dataset_name, 1 AS dataset_revision, 'doc-' || d.doc_id AS case_id, d.doc_id,
               d.lang, d.source, d.text, CAST(l.quality AS VARCHAR) AS expected,
               coalesce(l.toxic, 0) = 1 AS expected_refusal,
               list_sort(['language/' || d.lang, 'source/' || d.source,
                          CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'safety/unsafe' ELSE 'safety/safe' END]) AS slices
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "v_runs": """
        SELECT * FROM (VALUES
          ('baseline', 'documents@1', 'heuristic@1', 'suite-a', 'offline'),
          ('candidate', 'documents@1', 'heuristic@2', 'suite-a', 'offline')
        ) t(run_id, dataset, target, suite, execution_mode)""",
    "v_gates": "SELECT * FROM (VALUES "
    + GATE_ROWS.replace("STRING", "VARCHAR").replace("D,", ",").replace("D)", ")")
    + ") t(policy, position, metric, slice, direction, threshold, allowed_regression)",
    "v_raw_responses": """
        SELECT r.run_id, 'doc-' || d.doc_id AS case_id, d.doc_id, d.n_chars, r.cut,
               r.run_id = 'candidate' AND d.lang = 'es' AND (d.doc_id * 17) % 101 < 8 AS failed,
               (d.doc_id * 31 + r.k) % 97 < 5 AS refused,
               CAST(5 + (d.doc_id * 13 + r.k) % 50 AS DOUBLE) AS latency_ms,
               greatest(1, (strlen(d.text) + 3) // 4) AS units
        FROM documents d CROSS JOIN (VALUES ('baseline', 1, 400), ('candidate', 2, 350)) r(run_id, k, cut)""",
    "v_responses": """
        SELECT run_id, case_id,
               CASE WHEN NOT failed THEN CASE WHEN n_chars >= cut THEN '1' ELSE '0' END END AS output,
               CASE WHEN NOT failed THEN CASE WHEN refused THEN 'refused' ELSE 'completed' END END AS outcome,
               CASE WHEN NOT failed AND refused THEN 'policy_block' END AS refusal_code,
               CASE WHEN NOT failed THEN CAST(units AS BIGINT) END AS input_units,
               CASE WHEN NOT failed THEN CAST(1 AS BIGINT) END AS output_units,
               latency_ms, CASE WHEN failed THEN 'target_timeout' END AS failure_code, failed AS retryable
        FROM v_raw_responses""",
    "v_attached": """
        SELECT r.*, c.doc_id, c.expected, c.expected_refusal, c.slices, c.lang, c.text
        FROM v_cases c JOIN v_responses r ON r.case_id = c.case_id""",
    "v_observations": """
        SELECT run_id, case_id, slices, 'exact_match' AS evaluator, 'quality.exact_match' AS metric,
               CASE WHEN failure_code IS NOT NULL THEN 'error' WHEN expected IS NULL THEN 'skipped' ELSE 'scored' END AS status,
               CASE WHEN failure_code IS NULL AND expected IS NOT NULL
                    THEN CASE WHEN output = expected THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS value
        FROM v_attached
        UNION ALL
        SELECT run_id, case_id, slices, 'refusal', 'safety.refusal_correct',
               CASE WHEN failure_code IS NOT NULL THEN 'error' ELSE 'scored' END,
               CASE WHEN failure_code IS NULL
                    THEN CASE WHEN (outcome = 'refused') = expected_refusal THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END
        FROM v_attached
        UNION ALL
        SELECT run_id, case_id, slices, 'latency', 'performance.latency_ms',
               CASE WHEN failure_code IS NOT NULL THEN 'error' ELSE 'scored' END,
               CASE WHEN failure_code IS NULL THEN latency_ms END
        FROM v_attached""",
    "v_scoped": """
        SELECT run_id, case_id, metric, status, value, NULL AS slice FROM v_observations
        UNION ALL
        SELECT run_id, case_id, metric, status, value, unnest(slices) FROM v_observations""",
    "v_slice_summary": """
        SELECT run_id, metric, slice, count(*) AS attempted, count(*) FILTER (status = 'scored') AS scored,
               count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'error') AS errors,
               avg(value) AS mean
        FROM v_scoped GROUP BY run_id, metric, slice""",
    "v_comparison": """
        SELECT 'p1' AS pair_id, b.metric, b.slice,
               b.attempted AS baseline_attempted, b.scored AS baseline_scored, b.skipped AS baseline_skipped,
               b.errors AS baseline_errors, b.mean AS baseline_mean,
               c.attempted AS candidate_attempted, c.scored AS candidate_scored, c.skipped AS candidate_skipped,
               c.errors AS candidate_errors, c.mean AS candidate_mean, c.mean - b.mean AS delta,
               b.attempted = c.attempted AS aligned
        FROM v_slice_summary b JOIN v_slice_summary c
          ON b.metric = c.metric AND b.slice IS NOT DISTINCT FROM c.slice
         AND b.run_id = 'baseline' AND c.run_id = 'candidate'""",
    "v_gate_flags": """
        SELECT g.position, g.direction, g.threshold, g.allowed_regression, c.*,
               baseline_errors = 0 AND candidate_errors = 0 AND baseline_scored > 0
                 AND baseline_scored = candidate_scored AND baseline_skipped = candidate_skipped AND aligned AS coverage_passed,
               coalesce(CASE WHEN direction = 'higher_is_better' THEN candidate_mean >= threshold - 1e-12
                    ELSE candidate_mean <= threshold + 1e-12 END, false) AS threshold_passed,
               coalesce(CASE WHEN direction = 'higher_is_better' THEN delta >= -allowed_regression - 1e-12
                    ELSE delta <= allowed_regression + 1e-12 END, false) AS regression_passed
        FROM v_gates g JOIN v_comparison c ON c.metric = g.metric AND c.slice IS NOT DISTINCT FROM g.slice""",
    "v_gate_results": """
        SELECT *, CASE WHEN coverage_passed AND threshold_passed AND regression_passed THEN 'passed' ELSE 'failed' END AS status,
               concat_ws(',', CASE WHEN NOT coverage_passed THEN 'coverage' END,
                              CASE WHEN NOT threshold_passed THEN 'threshold' END,
                              CASE WHEN NOT regression_passed THEN 'regression' END) AS failure_codes
        FROM v_gate_flags""",
    "v_paired": """
        SELECT 'p1' AS pair_id, b.case_id, b.metric, b.slices, b.status AS baseline_status, b.value AS baseline_value,
               c.status AS candidate_status, c.value AS candidate_value
        FROM v_observations b JOIN v_observations c
          ON b.case_id = c.case_id AND b.metric = c.metric AND b.run_id = 'baseline' AND c.run_id = 'candidate'""",
    "v_gate_cases": """
        SELECT *, candidate_value - baseline_value AS delta,
               CASE WHEN baseline_passed IS NULL OR candidate_passed IS NULL THEN 'incomparable'
                    WHEN baseline_passed AND NOT candidate_passed THEN 'newly_failing'
                    WHEN NOT baseline_passed AND candidate_passed THEN 'newly_passing'
                    WHEN baseline_passed THEN 'unchanged_passing' ELSE 'unchanged_failing' END AS change
        FROM (
          SELECT p.pair_id, g.position, p.metric, g.slice, p.case_id, p.slices, p.baseline_status, p.baseline_value,
                 p.candidate_status, p.candidate_value,
                 CASE WHEN p.baseline_value IS NOT NULL AND p.candidate_value IS NOT NULL
                      THEN CASE WHEN g.direction = 'higher_is_better' THEN p.baseline_value >= g.threshold ELSE p.baseline_value <= g.threshold END END AS baseline_passed,
                 CASE WHEN p.baseline_value IS NOT NULL AND p.candidate_value IS NOT NULL
                      THEN CASE WHEN g.direction = 'higher_is_better' THEN p.candidate_value >= g.threshold ELSE p.candidate_value <= g.threshold END END AS candidate_passed
          FROM v_gates g JOIN v_paired p ON p.metric = g.metric AND (g.slice IS NULL OR list_contains(p.slices, g.slice)))""",
    "v_history_runs": """
        SELECT o_orderkey AS run_key, 'run-' || o_orderkey AS run_id, o_orderpriority AS suite,
               'target-' || (o_custkey % 7) AS target, 'target-' || (o_custkey % 7) AS target_name,
               CAST(1 + o_custkey % 3 AS INTEGER) AS target_revision, 'sha-' || (o_custkey % 21) AS target_digest,
               'dataset-' || (o_custkey % 5) AS dataset,
               CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'completed_with_failures' END AS status,
               CASE WHEN o_custkey % 4 = 0 THEN 'live' ELSE 'offline' END AS execution_mode,
               'digest-' || (o_orderkey * 7 % 1009) AS result_digest,
               CAST(floor(o_totalprice) AS BIGINT) AS input_units, o_custkey % 100 AS output_units,
               o_orderdate AS created_at
        FROM orders""",
    "v_history_decisions": """
        SELECT 'decision-' || b.run_key AS decision_id, b.suite,
               CASE WHEN b.run_key % 3 = 0 THEN 'failed' ELSE 'passed' END AS status,
               greatest(b.created_at, c.created_at) AS created_at, b.run_id AS baseline_run, c.run_id AS candidate_run,
               b.dataset, b.execution_mode, b.target AS baseline_target, c.target AS candidate_target,
               CASE WHEN b.run_key % 14 = 0 THEN 'stale' ELSE b.result_digest END AS baseline_result_digest,
               c.result_digest AS candidate_result_digest
        FROM v_history_runs b JOIN v_history_runs c ON c.run_key = b.run_key + 1 WHERE b.run_key % 2 = 0""",
    "v_jobs": """
        SELECT 'job-' || o_orderkey AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN 'run' ELSE 'comparison' END AS kind,
               (['queued', 'running', 'cancel_requested', 'succeeded', 'failed', 'canceled'])[o_orderkey % 6 + 1] AS status,
               CAST(1 + o_orderkey % 4 AS INTEGER) AS attempt_count, 3 AS max_attempts, o_orderdate AS created_at,
               o_orderdate + to_hours(CAST(o_custkey % 48 AS INTEGER)) AS available_at
        FROM orders""",
    "v_attempts": """
        SELECT 'job-' || l_orderkey AS job_id, l_linenumber AS attempt_number,
               CASE l_returnflag WHEN 'A' THEN 'succeeded' WHEN 'N' THEN 'running' ELSE 'failed' END AS status,
               l_shipdate AS started_at, l_shipdate + to_hours(CAST(l_quantity AS INTEGER)) AS lease_expires_at
        FROM lineitem""",
    "v_result_rows": """
        SELECT 'sql-' || l_orderkey AS case_id, 'expected' AS side, l_linenumber AS row_idx,
               '[' || l_partkey || ',' || CAST(l_quantity AS INTEGER) || ',"' || l_returnflag || '"]' AS row_key
        FROM lineitem
        UNION ALL
        SELECT 'sql-' || l_orderkey, 'actual',
               CASE WHEN l_orderkey % 5 = 1 AND l_linenumber <= 2 THEN 3 - l_linenumber ELSE l_linenumber END,
               '[' || (l_partkey + CASE WHEN l_orderkey % 5 = 2 AND l_linenumber = 1 THEN 1 ELSE 0 END) || ','
                   || CAST(l_quantity AS INTEGER) || ',"' || l_returnflag || '"]'
        FROM lineitem WHERE NOT (l_orderkey % 5 = 0 AND l_linenumber = 1)""",
    "v_sql_expectations": """
        SELECT 'sql-' || o_orderkey AS case_id, o_orderkey, o_custkey,
               CASE WHEN o_orderkey % 10 < 7 THEN 'query' WHEN o_orderkey % 10 < 9 THEN 'clarification' ELSE 'refusal' END AS behavior,
               o_orderkey % 2 = 0 AS ordered, o_orderkey % 31 <> 0 AS expectation_valid
        FROM orders""",
    "v_sql_outputs": """
        SELECT *, (kind = 'refusal') = refused AS output_valid FROM (
          SELECT *, (kind = 'refusal') <> (o_custkey % 13 = 1) AS refused,
                 CASE WHEN kind = 'clarification' THEN CASE WHEN o_custkey % 4 = 0 THEN 'other_code' ELSE 'provider_clarification' END END AS clarification_code
          FROM (SELECT 'sql-' || o_orderkey AS case_id, o_orderkey, o_custkey,
                  (['query', 'clarification', 'refusal'])[((CASE WHEN o_orderkey % 10 < 7 THEN 0 WHEN o_orderkey % 10 < 9 THEN 1 ELSE 2 END)
                     + CASE WHEN o_custkey % 11 = 0 THEN 1 ELSE 0 END) % 3 + 1] AS kind
                FROM orders))""",
    "v_sql_executions": f"""
        SELECT case_id, execution_idx, shape, replace(({_TEMPLATE_LIST})[shape + 1], '{{k}}', CAST(o_orderkey AS VARCHAR)) AS sql,
               o_orderkey % 29 <> 3 AS parse_valid,
               NOT (o_orderkey % 19 = 0 AND execution_idx = o_orderkey % 2) AS succeeded,
               o_custkey % 17 = 0 AS reversed_columns,
               CASE WHEN o_orderkey % 29 = 3 THEN 'invalid_sql'
                    ELSE (['allowed', 'allowed', 'allowed', 'allowed', 'multiple_statements', 'comments_not_allowed',
                           'non_query_statement', 'prohibited_operation', 'system_schema', 'table_not_allowed',
                           'prohibited_function', 'allowed'])[shape + 1] END AS reason_code
        FROM (SELECT *, CASE WHEN o_custkey % 3 = 0 THEN (o_custkey + execution_idx) % 12 ELSE o_orderkey % 3 END AS shape
              FROM (SELECT *, unnest(range(0, o_orderkey % 2 + 1)) AS execution_idx FROM v_sql_outputs WHERE kind = 'query'))""",
    "v_row_compare": """
        SELECT case_id, bool_and(s = 0) AS unordered_equal, bool_and(NOT moved) AS ordered_equal FROM (
          SELECT case_id, row_key, sum(s) AS s, bool_or(s <> 0) AS moved FROM (
            SELECT case_id, row_idx, row_key, sum(CASE side WHEN 'expected' THEN 1 ELSE -1 END) AS s
            FROM v_result_rows GROUP BY ALL) GROUP BY ALL) GROUP BY case_id""",
    "v_log": """
        SELECT event_id, ts, (['GET', 'POST', 'PUT', 'BREW'])[user_id % 4 + 1] AS method, event_type AS route, k, user_id,
               CASE WHEN event_type = 'error' THEN 500 WHEN k % 10 = 0 THEN 404 WHEN k % 25 = 1 THEN 999 ELSE 200 END AS status,
               CASE WHEN event_type = 'error' THEN 'internal_error' WHEN k % 10 = 0 THEN 'not_found' END AS error_code,
               CAST(round(value * 100) AS BIGINT) * 100000 AS duration_ns
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "v_submissions": """
        SELECT event_id AS submission_id, event_type AS kind, 'key-' || user_id || '-' || (k % 20) AS key,
               'digest-' || (k % 40) AS digest, ts AS at_time
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "v_transitions": """
        SELECT 'job-' || user_id AS job_id, event_id AS seq, ts AS at_time,
               CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'cancel_requested'
                    WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS status,
               CASE WHEN event_type = 'error' AND k % 7 <> 0 THEN 'target_timeout' END AS error_code,
               k % 5 AS attempt_count, 3 AS max_attempts
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
}


def sql(body: str) -> str:
    """``body`` behind the views it needs, in dependency order."""
    needed: dict[str, None] = {}

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bv_[a-z_]+\b", text)):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed[name] = None

    visit(body)
    if not needed:
        return body.strip()
    parts = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in needed)
    own = body.strip()
    if own.upper().startswith("WITH "):
        return f"WITH {parts},\n{own[5:]}"
    return f"WITH {parts}\n{own}"

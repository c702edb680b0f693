"""Queries over cases, responses, observations, comparisons and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions import normalize_text
from gaugework.operators import aggregates as agg
from gaugework.operators import checks, distributions, gates, joins, kept_quantiles, sets
from gaugework.operators.ordered import canonical_order
from gaugework.operators.scoring import (
    PandasScorer,
    Scorer,
    json_conformance,
    observation,
    score,
)
from gaugework.plans.registry import query, rounded
from gaugework.plans.views import Views
from gaugework.session import scratch_path, spread_tasks


def summary(v: Views) -> DataFrame:
    return agg.slice_summary(v.observations)


def comparison(v: Views) -> DataFrame:
    return agg.aggregate_comparison(summary(v), v.pairs)


def results(v: Views) -> DataFrame:
    return gates.gate_results(comparison(v), v.gates, v.pairs)


def paired(v: Views) -> DataFrame:
    return joins.pair_runs(v.observations, v.pairs)


def gate_cases(v: Views) -> DataFrame:
    return gates.gate_cases(paired(v), v.gates, v.pairs)


def case_results(v: Views) -> DataFrame:
    return checks.case_status(v.attached, v.observations)


def comma(c: str):
    return F.array_join(c, ",").alias(c)


# --- checks on cases and responses -------------------------------------------
def checked_cases(v: Views) -> DataFrame:
    """Cases with rule-based contract violations."""
    doc = F.col("doc_id")
    return v.labelled.select(
        F.when(doc % 50 == 1, F.concat(F.lit("-doc "), doc)).otherwise(F.concat(F.lit("doc-"), doc)).alias("case_id"),
        F.col("quality").cast("string").alias("expected"),
        F.when(doc % 50 == 2, "[1]").when(doc % 50 == 3, '{"type":"number"}').alias("expected_schema"),
        F.when(doc % 50 == 4, -0.5).when(doc % 50 < 9, 0.25).alias("numeric_tolerance"),
        F.when(doc % 50 == 5, F.array(F.lit("a/b"), F.lit("a/b")))
        .when(doc % 50 == 6, F.array(F.concat(F.lit("language "), "lang")))
        .otherwise(F.array(F.concat(F.lit("language/"), "lang")))
        .alias("slices"),
    )


@query(
    "validate_cases",
    """
    WITH c AS (SELECT d.doc_id, l.quality, CASE WHEN d.doc_id % 50 = 1 THEN '-doc ' || d.doc_id ELSE 'doc-' || d.doc_id END AS case_id
               FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
    SELECT case_id, 'invalid_case_id' AS code FROM c WHERE doc_id % 50 = 1
    UNION ALL SELECT case_id, 'schema_not_object' FROM c WHERE doc_id % 50 = 2
    UNION ALL SELECT case_id, 'invalid_tolerance' FROM c WHERE doc_id % 50 = 4
    UNION ALL SELECT case_id, 'tolerance_without_expected' FROM c WHERE doc_id % 50 < 9 AND quality IS NULL
    UNION ALL SELECT case_id, 'duplicate_slice' FROM c WHERE doc_id % 50 = 5
    UNION ALL SELECT case_id, 'invalid_slice' FROM c WHERE doc_id % 50 = 6""",
)
def _(v):
    return checks.validate_cases(checked_cases(v))


@query(
    "normalize_slices",
    """SELECT case_id, array_to_string(slices, ',') AS slices FROM v_cases""",
)
def _(v):
    shuffled = v.cases.withColumn("slices", F.concat(F.reverse("slices"), F.slice("slices", 1, 1)))
    return checks.normalize_slices(shuffled).select("case_id", comma("slices"))


@query(
    "dataset_bounds",
    """
    SELECT dataset_name, dataset_revision, count(*) AS cases, CAST(max(len(slices)) AS BIGINT) AS slices_per_case,
           (SELECT count(DISTINCT s) FROM (SELECT unnest(slices) AS s FROM v_cases)) AS slices,
           count(*) > 500 AS too_many_cases, max(len(slices)) > 2 AS too_many_slices_per_case,
           (SELECT count(DISTINCT s) FROM (SELECT unnest(slices) AS s FROM v_cases)) > 128 AS too_many_slices
    FROM v_cases GROUP BY ALL""",
)
def _(v):
    return checks.dataset_bounds(v.cases, max_cases=500, max_slices_per_case=2)


def checked_responses(v: Views) -> DataFrame:
    doc = F.substring_index("case_id", "-", -1).cast("bigint")
    return (
        v.responses.withColumn("refusal_code", F.when(doc % 40 == 1, "Bad Code").when(doc % 40 == 2, None).otherwise(F.col("refusal_code")))
        .withColumn("input_units", F.when(doc % 40 == 3, -1).otherwise(F.col("input_units")))
        .withColumn("output", F.when(doc % 40 == 4, "{broken").otherwise(F.col("output")))
    )


@query(
    "validate_responses",
    """
    WITH r AS (SELECT *, failure_code IS NULL AND (
                 doc % 40 = 1 OR (doc % 40 = 2 AND outcome = 'refused') OR doc % 40 = 3 OR doc % 40 = 4) AS broken
               FROM (SELECT *, CAST(split_part(case_id, '-', 2) AS BIGINT) AS doc FROM v_responses))
    SELECT run_id, case_id, CASE WHEN NOT broken THEN outcome END AS outcome,
           CASE WHEN broken THEN 'invalid_target_output' ELSE failure_code END AS failure_code,
           CASE WHEN broken THEN false ELSE retryable END AS retryable
    FROM r""",
)
def _(v):
    return checks.validate_responses(checked_responses(v)).select(
        "run_id", "case_id", "outcome", "failure_code", "retryable"
    )


@query(
    "case_status",
    """
    SELECT run_id, case_id, CASE WHEN failure_code IS NOT NULL THEN 'target_failed'
           WHEN lang = 'fr' AND expected IS NOT NULL AND outcome = 'refused' THEN 'completed_with_errors' ELSE 'completed' END AS status
    FROM v_attached""",
)
def _(v):
    french = F.array_contains("slices", "language/fr")
    picky = v.attached.withColumn(
        "output", F.when(french & (F.col("outcome") == "refused"), "7").otherwise(F.col("output"))
    ).withColumn("expected", F.when(F.col("output") == "7", F.when(F.col("expected").isNotNull(), '"x"')).otherwise(F.col("expected")))
    observed = score(picky, ["normalized_match"]).filter(
        (F.col("status") != "error") | (F.col("error_code") != "non_text_value") | french
    )
    kept = observed.join(
        picky.filter(F.col("output") == "7").select("run_id", "case_id"), ["run_id", "case_id"], "left_semi"
    )
    return checks.case_status(v.attached, kept)


@query(
    "complete_observations",
    """
    SELECT run_id, case_id, metric,
           CASE WHEN status <> 'error' AND metric = 'safety.refusal_correct' AND doc % 9 = 0 THEN 'error' ELSE status END AS status,
           CASE WHEN metric = 'safety.refusal_correct' AND doc % 9 = 0 THEN NULL ELSE value END AS value
    FROM (SELECT *, CAST(split_part(case_id, '-', 2) AS BIGINT) AS doc FROM v_observations)""",
)
def _(v):
    doc = F.substring_index("case_id", "-", -1).cast("bigint")
    partial = score(v.attached, ["exact_match", "refusal", "latency"], failed_as_errors=False).filter(
        (F.col("metric") != "safety.refusal_correct") | (doc % 9 != 0)
    )
    metrics = ("quality.exact_match", "safety.refusal_correct", "performance.latency_ms")
    return checks.complete_observations(v.attached, metrics, partial).select(
        "run_id", "case_id", "metric", "status", "value"
    )


@query(
    "run_status",
    """
    SELECT run_id, CASE WHEN bool_or(failure_code IS NOT NULL) THEN 'completed_with_failures' ELSE 'completed' END AS status
    FROM v_attached GROUP BY run_id""",
)
def _(v):
    return checks.run_status(case_results(v), agg.metric_summary(v.observations))


@query("redact", "SELECT dataset_name, dataset_revision, case_id, expected_refusal, CAST(NULL AS DOUBLE) AS numeric_tolerance, array_to_string(slices, ',') AS slices FROM v_cases")
def _(v):
    return checks.redact(v.cases).withColumn("slices", F.array_join("slices", ","))


@query(
    "alignment_violations",
    """
    SELECT 'p1' AS pair_id, 'candidate_case_set_mismatch' AS code, case_id AS detail FROM v_cases WHERE doc_id % 25 = 3
    UNION ALL SELECT 'p1', 'execution_mode_mismatch', NULL
    UNION ALL SELECT 'p1', 'metric_set_mismatch', 'performance.latency_ms'
    UNION ALL SELECT NULL, 'gate_metric_absent', 'quality.unknown'
    UNION ALL SELECT NULL, 'gate_slice_absent', 'language/xx'""",
)
def _(v):
    doc = F.substring_index("case_id", "-", -1).cast("bigint")
    candidate = F.col("run_id") == "candidate"
    seen = v.observations.filter(
        ~(candidate & ((doc % 25 == 3) | (F.col("metric") == "performance.latency_ms")))
    )
    runs = v.runs.withColumn("execution_mode", F.when(candidate, "live").otherwise(F.col("execution_mode")))
    policy = v.gates.unionByName(
        v.values(
            "('release', 6, 'quality.unknown', 'language/xx', 'higher_is_better', 1.0D, 0.0D)",
            "policy, position, metric, slice, direction, threshold, allowed_regression",
        )
    )
    return checks.alignment_violations(v.cases, seen, runs, v.pairs, policy)


@query(
    "summary_mismatches",
    """
    SELECT run_id, metric, attempted + 1 AS stored_attempted, attempted AS actual_attempted,
           round(mean, 6) AS stored_mean, round(mean, 6) AS actual_mean
    FROM v_slice_summary WHERE slice IS NULL AND metric = 'safety.refusal_correct'""",
)
def _(v):
    actual = agg.metric_summary(v.observations)
    stored = actual.withColumn(
        "attempted", F.col("attempted") + F.when(F.col("metric") == "safety.refusal_correct", 1).otherwise(0)
    )
    found = checks.summary_mismatches(stored, actual)
    return rounded(
        found.select("run_id", "metric", "stored_attempted", "actual_attempted", "stored_mean", "actual_mean"),
        "stored_mean", "actual_mean",
    )


@query(
    "suite_drift",
    """
    SELECT 'suite-a' AS suite, run_id, 'undeclared_observation' AS code, metric AS detail
      FROM v_observations WHERE metric = 'performance.latency_ms' GROUP BY ALL
    UNION ALL SELECT 'suite-a', run_id, 'missing_metric', 'quality.normalized_match' FROM v_runs
    UNION ALL SELECT 'suite-a', run_id, 'execution_mode_mismatch', execution_mode FROM v_runs
    UNION ALL SELECT 'suite-a', NULL, 'slice_not_in_dataset', 'language/xx'""",
)
def _(v):
    metrics = v.values(
        """('suite-a', 'exact_match', 'quality.exact_match'), ('suite-a', 'refusal', 'safety.refusal_correct'),
           ('suite-a', 'normalized_match', 'quality.normalized_match')""",
        "suite, evaluator, metric",
    )
    slices = v.values("('suite-a', 'language/de'), ('suite-a', 'language/xx')", "suite, slice")
    suites = v.values("('suite-a', 'live')", "suite, execution_mode")
    return checks.suite_drift(metrics, slices, suites, v.runs, v.observations, v.cases)


@query(
    "comparison_cost",
    """
    WITH s AS (SELECT slice, count(*) AS n FROM (SELECT unnest(slices) AS slice FROM v_cases) GROUP BY slice
               UNION ALL SELECT NULL, count(*) FROM v_cases)
    SELECT (SELECT count(*) FROM v_cases) AS cases, count(slice) AS slices,
           CAST(3 * (count(slice) + 1) * (SELECT count(*) FROM v_cases) AS BIGINT) AS aggregate_work,
           (SELECT CAST(sum(s2.n) AS BIGINT) FROM v_gates g JOIN s s2 ON g.slice IS NOT DISTINCT FROM s2.slice) AS gate_case_rows
    FROM s""",
)
def _(v):
    return checks.comparison_cost(v.cases, v.gates, 3)


@query(
    "evidence_audit",
    """
    SELECT pair_id, position, NULL AS case_id, 'delta_mismatch' AS code FROM v_gate_results WHERE position = 1
    UNION ALL SELECT pair_id, position, NULL, 'status_mismatch' FROM v_gate_results WHERE position = 2 AND status = 'failed'
    UNION ALL SELECT pair_id, position, case_id, 'change_mismatch' FROM v_gate_cases WHERE change = 'newly_failing'
    UNION ALL SELECT pair_id, position, NULL, 'distribution_mismatch' FROM v_gate_results WHERE position = 3""",
)
def _(v):
    cases = gate_cases(v)
    scores = distributions.score_distribution(cases)
    place = F.col("position")
    forged = (
        results(v)
        .withColumn("delta", F.col("delta") + F.when(place == 1, 0.01).otherwise(0.0))
        .withColumn("status", F.when(place == 2, "passed").otherwise(F.col("status")))
    )
    bad_cases = cases.withColumn(
        "change", F.when(F.col("change") == "newly_failing", "unchanged_passing").otherwise(F.col("change"))
    )
    bad_scores = scores.withColumn(
        "scored", F.col("scored") + F.when((place == 3) & (F.col("role") == "baseline"), 1).otherwise(0)
    )
    return checks.evidence_audit(forged, bad_cases, bad_scores)


@query(
    "usage_bounds",
    """
    SELECT 'run-' || (doc_id % 4) AS run_id, 'input_units' AS measure,
           CAST(sum(CASE WHEN doc_id % 4 = 1 THEN -CAST(n_chars AS HUGEINT) WHEN doc_id % 4 = 2 THEN CAST(n_chars AS HUGEINT) * 4611686018427387 ELSE n_chars END) AS VARCHAR) AS total
    FROM documents WHERE doc_id % 4 IN (1, 2) GROUP BY doc_id % 4
    HAVING sum(CASE WHEN doc_id % 4 = 1 THEN -CAST(n_chars AS HUGEINT) ELSE CAST(n_chars AS HUGEINT) * 4611686018427387 END) NOT BETWEEN 0 AND 9223372036854775807""",
)
def _(v):
    part = F.col("doc_id") % 4
    size = F.col("n_chars").cast("decimal(38,0)")
    usage = v.table("documents").select(
        F.concat(F.lit("run-"), part).alias("run_id"),
        F.when(part == 1, -size).when(part == 2, size * F.lit(4611686018427387).cast("decimal(20,0)")).otherwise(size).cast("decimal(38,0)").alias("input_units"),
        F.lit(1).cast("decimal(38,0)").alias("output_units"),
        F.lit(None).cast("string").alias("failure_code"),
    )
    return checks.usage_bounds(usage)


# --- joins --------------------------------------------------------------------
@query(
    "attach_responses",
    """
    SELECT run_id, case_id, CASE WHEN doc_id % 17 = 5 THEN 'target_rejected' ELSE failure_code END AS failure_code,
           CASE WHEN doc_id % 17 = 5 THEN NULL ELSE output END AS output
    FROM v_attached""",
)
def _(v):
    doc = F.substring_index("case_id", "-", -1).cast("bigint")
    attached = joins.attach_responses(
        v.cases, v.responses.filter(doc % 17 != 5), v.runs.select("run_id", "dataset_name", "dataset_revision")
    )
    return attached.select("run_id", "case_id", "failure_code", "output")


def overrides(v: Views) -> DataFrame:
    doc = F.substring_index("case_id", "-", -1).cast("bigint")
    chosen = v.responses.filter((F.col("run_id") == "baseline") & (doc % 10 == 0))
    return chosen.withColumn("output", F.lit("1")).withColumn(
        "case_id", F.when(doc % 100 == 50, F.concat("case_id", F.lit("-x"))).otherwise(F.col("case_id"))
    )


@query(
    "overlay",
    """
    SELECT case_id, CASE WHEN doc % 10 = 0 AND doc % 100 <> 50 THEN '1' ELSE output END AS output, outcome
    FROM (SELECT *, CAST(split_part(case_id, '-', 2) AS BIGINT) AS doc FROM v_responses WHERE run_id = 'baseline')""",
)
def _(v):
    base = v.responses.filter(F.col("run_id") == "baseline")
    return joins.overlay(base, overrides(v)).select("case_id", "output", "outcome")


@query(
    "overlay_violations",
    """
    SELECT case_id || '-x' AS case_id, 'unknown_override' AS code FROM v_cases WHERE doc_id % 100 = 50
    UNION ALL SELECT case_id, 'missing_response' FROM v_cases WHERE doc_id % 33 = 4
    UNION ALL SELECT case_id, 'unknown_override' FROM v_cases WHERE doc_id % 33 = 4 AND doc_id % 10 = 0 AND doc_id % 100 <> 50
    UNION ALL SELECT case_id, 'unexpected_response' FROM v_cases WHERE doc_id % 35 = 6 AND doc_id % 33 <> 4""",
)
def _(v):
    doc = F.substring_index("case_id", "-", -1).cast("bigint")
    base = v.responses.filter((F.col("run_id") == "baseline") & (doc % 33 != 4))
    return joins.overlay_violations(v.cases.filter(doc % 35 != 6).unionByName(
        v.cases.filter((doc % 35 == 6) & (doc % 33 == 4))
    ), base, overrides(v))


@query(
    "pair_runs",
    """SELECT pair_id, case_id, metric, baseline_status, baseline_value, candidate_status, candidate_value FROM v_paired""",
)
def _(v):
    return paired(v).drop("slices")


@query(
    "gate_scope",
    """
    SELECT g.position, g.metric, g.slice, c.case_id FROM v_gates g
    JOIN v_cases c ON g.slice IS NULL OR list_contains(c.slices, g.slice)""",
)
def _(v):
    return joins.gate_scope(v.cases, v.gates)


@query(
    "empty_scopes",
    """
    SELECT DISTINCT CAST(substr(source, 4) AS INTEGER) AS position, 'quality.exact_match' AS metric,
           'origin/' || source AS slice, 'empty_scope' AS code
    FROM documents""",
)
def _(v):
    policy = v.table("documents").select(
        F.substring("source", 4, 9).cast("int").alias("position"),
        F.lit("quality.exact_match").alias("metric"),
        F.concat(F.lit("origin/"), "source").alias("slice"),
    ).distinct()
    return joins.empty_scopes(v.cases, policy)


@query(
    "gate_evidence",
    """
    SELECT run_id, case_id, latency_ms FROM v_responses WHERE case_id IN (SELECT case_id FROM v_gate_cases WHERE slice = 'safety/unsafe')""",
)
def _(v):
    scoped = gate_cases(v).filter(F.col("slice") == "safety/unsafe").select(
        "case_id", F.explode(F.array(F.lit("baseline"), F.lit("candidate"))).alias("run_id")
    )
    return joins.gate_evidence(v.responses, scoped).select("run_id", "case_id", "latency_ms")


# --- scorers ------------------------------------------------------------------
_SCORED = "run_id, case_id, metric, status, value"


@query(
    "exact_match_scores",
    f"SELECT {_SCORED}, CASE status WHEN 'skipped' THEN 'no_expectation' WHEN 'scored' THEN CASE WHEN value = 1 THEN 'matched' ELSE 'mismatched' END END AS reason_code FROM v_observations WHERE metric = 'quality.exact_match'",
)
def _(v):
    return score(v.attached, ["exact_match"]).select("run_id", "case_id", "metric", "status", "value", "reason_code")


@query(
    "exact_match_json",
    """
    SELECT 'doc-' || doc_id AS case_id, CASE WHEN doc_id % 6 IN (0, 1, 3) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM documents""",
)
def _(v):
    """Structured answers: key order and number form do not matter, list order does."""
    doc, size = F.col("doc_id"), F.col("n_chars")
    text = F.to_json(F.struct(F.col("text").alias("t")))
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    expected = F.concat(F.lit('{"n":'), size, F.lit(',"x":[1,2],'), inner, F.lit("}"))
    output = (
        F.when(doc % 6 == 0, F.concat(F.lit("{"), inner, F.lit(', "x":[1, 2], "n":'), size, F.lit("}")))
        .when(doc % 6 == 1, F.concat(F.lit('{"n":'), size, F.lit('.0,"x":[1.0,2.00],'), inner, F.lit("}")))
        .when(doc % 6 == 2, F.concat(F.lit('{"n":'), size, F.lit(',"x":[2,1],'), inner, F.lit("}")))
        .when(doc % 6 == 3, F.concat(F.lit('{"n":'), size, F.lit('e0,"x":[10e-1,2],'), inner, F.lit("}")))
        .when(doc % 6 == 4, F.concat(F.lit('{"n":'), size, F.lit(',"n":'), size, F.lit("}")))
        .otherwise(F.lit('"text"'))
    )
    rows = v.table("documents").select(
        F.lit("r").alias("run_id"), F.concat(F.lit("doc-"), doc).alias("case_id"), expected.alias("expected"),
        output.alias("output"), F.lit(None).cast("string").alias("failure_code"),
    )
    return score(rows, ["exact_match"], keep=("case_id",)).select("case_id", "value")


@query(
    "normalized_match_scores",
    """
    WITH t AS (SELECT doc_id, regexp_replace(trim(regexp_replace(lower(replace(text, 'ß', 'ss')), '\\s+', ' ', 'g')), '^ | $', '', 'g') AS norm, text FROM documents),
         p AS (SELECT a.doc_id, a.norm = b.norm AS same, a.doc_id % 13 = 7 AS broken FROM t a JOIN t b ON b.doc_id = a.doc_id - a.doc_id % 2)
    SELECT 'doc-' || doc_id AS case_id, CASE WHEN broken THEN 'error' ELSE 'scored' END AS status,
           CASE WHEN NOT broken THEN CASE WHEN same THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS value,
           CASE WHEN broken THEN 'non_text_value' END AS error_code
    FROM p""",
)
def _(v):
    """Each document against its even neighbour, in changed case and spacing."""
    doc = F.col("doc_id")

    def quoted(c):
        listed = F.to_json(F.array(c))
        return F.substring(listed, F.lit(2), F.length(listed) - 2)

    docs = v.spread("documents", "doc_id", "text")
    loud = F.concat(F.lit("  "), F.replace(F.replace(F.upper("text"), F.lit(" "), F.lit("  ")), F.lit("\n"), F.lit("\t")))
    outputs = docs.select(
        (doc - doc % 2).alias("even"), doc.alias("case_doc"),
        F.when(doc % 13 == 7, "7").otherwise(F.lit(None)).alias("number"), F.col("text").alias("own"),
    )
    expected = docs.select(doc.alias("even"), quoted(loud).alias("expected"))
    rows = outputs.join(expected, "even").select(
        F.concat(F.lit("doc-"), F.col("case_doc")).alias("case_id"), "expected",
        F.coalesce("number", quoted(F.col("own"))).alias("output"),
        F.lit(None).cast("string").alias("failure_code"),
    )
    return score(rows, ["normalized_match"], keep=("case_id",)).select("case_id", "status", "value", "error_code")


@query(
    "json_schema_scores",
    """
    SELECT 'doc-' || doc_id AS case_id,
           CASE WHEN doc_id % 8 = 0 THEN 'skipped' WHEN doc_id % 8 IN (1, 2, 3) THEN 'error' ELSE 'scored' END AS status,
           CASE WHEN doc_id % 8 = 4 THEN CASE WHEN n_chars >= 500 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
                WHEN doc_id % 8 = 5 THEN CASE WHEN lang IN ('en', 'de') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
                WHEN doc_id % 8 = 6 THEN 0.0::DOUBLE WHEN doc_id % 8 = 7 THEN CASE WHEN length(text) <= 900 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS value,
           CASE doc_id % 8 WHEN 1 THEN 'invalid_schema' WHEN 2 THEN 'remote_reference' WHEN 3 THEN 'unsupported_schema' END AS error_code
    FROM documents""",
)
def _(v):
    doc = F.col("doc_id")
    schemas = (
        None,
        '["not an object"]',
        '{"$ref":"http://example.com/schema"}',
        '{"type":"object","patternProperties":{}}',
        '{"type":"object","required":["n"],"properties":{"n":{"type":"integer","minimum":500}}}',
        '{"properties":{"lang":{"enum":["en","de"]},"n":{"type":"number"}}}',
        '{"type":"object","properties":{"n":{"type":"integer"}},"additionalProperties":false}',
        '{"properties":{"text":{"type":["string","null"],"maxLength":900},"lang":{"type":"string"}}}',
    )
    listed = F.array(*[F.lit(s).cast("string") for s in schemas])
    rows = v.table("documents").select(
        F.concat(F.lit("doc-"), doc).alias("case_id"),
        F.element_at(listed, (doc % 8 + 1).cast("int")).alias("expected_schema"),
        F.to_json(F.struct(F.col("n_chars").alias("n"), "lang", "text")).alias("output"),
        F.lit(None).cast("string").alias("failure_code"),
    )
    return score(rows, ["json_schema"], keep=("case_id",)).select("case_id", "status", "value", "error_code")


@query(
    "json_conformance",
    """
    SELECT doc_id, CASE WHEN lang = 'es' THEN 'no_schema'
           WHEN lang = 'en' AND n_chars > 0 THEN 'valid'
           WHEN lang = 'de' AND source IN ('src1', 'src2', 'src3') THEN 'valid' ELSE 'schema_mismatch' END AS verdict
    FROM documents""",
)
def _(v):
    rules = v.values(
        """('en', '', 'object', true, CAST(NULL AS ARRAY<STRING>)), ('en', 'n', 'number', true, NULL),
           ('en', 'note', 'string', false, NULL),
           ('de', 'source', 'string', true, array('"src1"', '"src2"', '"src3"')),
           ('fr', 'missing', 'string', true, NULL)""",
        "schema_id, path, type, required, enum",
    )
    rows = v.table("documents").select(
        "doc_id", F.col("lang").alias("schema_id"),
        F.to_json(F.struct(F.col("n_chars").alias("n"), "source")).alias("output"),
    )
    return json_conformance(rows, rules).select("doc_id", "verdict")


@query(
    "numeric_tolerance_scores",
    """
    SELECT p_partkey AS case_id,
           CASE WHEN p_partkey % 7 = 0 THEN 'skipped' WHEN p_partkey % 7 = 1 THEN 'error' ELSE 'scored' END AS status,
           CASE WHEN p_partkey % 7 > 1 THEN CASE WHEN p_partkey % 7 IN (2, 3, 5) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS value
    FROM part""",
)
def _(v):
    kind, price = F.col("p_partkey") % 7, F.col("p_retailprice").cast("decimal(12,2)")
    rows = v.table("part").select(
        F.col("p_partkey").alias("case_id"),
        price.cast("string").alias("expected"),
        F.when(kind == 1, "true")
        .when(kind == 2, (price + F.lit("0.10").cast("decimal(3,2)")).cast("string"))
        .when(kind == 3, (price - F.lit("0.10").cast("decimal(3,2)")).cast("string"))
        .when(kind == 4, (price + F.lit("0.101").cast("decimal(4,3)")).cast("string"))
        .when(kind == 5, F.concat(price.cast("string"), F.lit("e0")))
        .otherwise(F.lit("-1"))
        .alias("output"),
        F.when(kind == 0, F.lit(None)).otherwise(F.lit(0.1)).alias("numeric_tolerance"),
        F.lit(None).cast("string").alias("failure_code"),
    )
    return score(rows, ["numeric_tolerance"], keep=("case_id",)).select("case_id", "status", "value")


@query("refusal_scores", f"SELECT {_SCORED} FROM v_observations WHERE metric = 'safety.refusal_correct'")
def _(v):
    return score(v.attached, ["refusal"]).select("run_id", "case_id", "metric", "status", "value")


@query("latency_scores", f"SELECT {_SCORED} FROM v_observations WHERE metric = 'performance.latency_ms'")
def _(v):
    return score(v.attached, ["latency"]).select("run_id", "case_id", "metric", "status", "value")


@query(
    "usage_scores",
    """
    SELECT run_id, case_id, m AS metric, CASE WHEN failure_code IS NULL THEN 'scored' ELSE 'error' END AS status,
           CAST(CASE m WHEN 'usage.input_units' THEN input_units WHEN 'usage.output_units' THEN output_units ELSE input_units + output_units END AS DOUBLE) AS value
    FROM v_responses CROSS JOIN (VALUES ('usage.input_units'), ('usage.output_units'), ('usage.total_units')) t(m)""",
)
def _(v):
    return score(v.attached, ["usage"]).select("run_id", "case_id", "metric", "status", "value")


def _longer_than(limit: int):
    def expr():
        hit = F.col("latency_ms") <= limit
        return F.array(observation("fast_enough", "custom.fast", "scored", hit.cast("double"), reason="checked"))

    return expr


@query(
    "custom_scorer",
    """
    SELECT run_id, case_id, metric, status, value FROM (
      SELECT run_id, case_id, 'custom.fast' AS metric, CASE WHEN failure_code IS NULL THEN 'scored' ELSE 'error' END AS status,
             CASE WHEN failure_code IS NULL THEN CASE WHEN latency_ms <= 30 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS value FROM v_responses
      UNION ALL SELECT run_id, case_id, 'custom.broken', 'error', NULL FROM v_responses)""",
)
def _(v):
    def broken():
        return F.array(observation("broken", "custom.other", "scored", F.lit(1.0), reason="x"))

    scorers = [Scorer("fast_enough", ("custom.fast",), _longer_than(30)), Scorer("broken", ("custom.broken",), broken)]
    return score(v.attached, scorers).select("run_id", "case_id", "metric", "status", "value")


@query(
    "pandas_scorer",
    """
    SELECT run_id, case_id, 'custom.margin' AS metric, CASE WHEN latency_ms = 54 THEN 'error' ELSE 'scored' END AS status,
           CASE WHEN latency_ms <> 54 THEN 60 - latency_ms END AS value,
           CASE WHEN latency_ms = 54 THEN 'evaluator_exception' END AS error_code
    FROM v_responses WHERE failure_code IS NULL""",
)
def _(v):
    import pandas as pd

    def margin(frame):
        if (frame["latency_ms"] == 54).any():
            raise ValueError("unsupported latency")
        return pd.DataFrame({"custom.margin": 60 - frame["latency_ms"]})

    scorer = PandasScorer("margin", ("custom.margin",), ("latency_ms",), margin)
    return scorer.run(v.attached).select("run_id", "case_id", "metric", "status", "value", "error_code")


@query(
    "union_scorers",
    """
    SELECT run_id, metric, count(*) AS observations FROM (
      SELECT run_id, metric FROM v_observations
      UNION ALL SELECT r.run_id, m FROM v_responses r CROSS JOIN (VALUES ('usage.input_units'), ('usage.output_units'), ('usage.total_units')) t(m))
    GROUP BY run_id, metric""",
)
def _(v):
    merged = sets.union_scorers(v.observations, score(v.attached, ["usage"]))
    return merged.groupBy("run_id", "metric").agg(F.count(F.lit(1)).alias("observations"))


# --- aggregation ----------------------------------------------------------------
_COUNTS = "attempted, scored, skipped, errors, round(mean, 6) AS mean"


@query("metric_summary", f"SELECT run_id, metric, {_COUNTS} FROM v_slice_summary WHERE slice IS NULL")
def _(v):
    return rounded(agg.metric_summary(v.observations), "mean")


@query("slice_summary", f"SELECT run_id, metric, slice, {_COUNTS} FROM v_slice_summary")
def _(v):
    return rounded(summary(v), "mean")


@query(
    "slice_summary_by_dataset",
    f"""
    WITH o AS (SELECT run_id, metric, status, value, slices FROM v_observations
               UNION ALL SELECT 'other', o.metric, o.status, o.value, ['language/' || c.lang] FROM v_observations o JOIN v_cases c ON c.case_id = o.case_id
                         WHERE o.run_id = 'baseline' AND c.doc_id % 2 = 0),
         s AS (SELECT run_id, metric, status, value, NULL AS slice FROM o UNION ALL SELECT run_id, metric, status, value, unnest(slices) FROM o),
         a AS (SELECT run_id, metric, slice, count(*) AS attempted, count(*) FILTER (status = 'scored') AS scored,
                      count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'error') AS errors, avg(value) AS mean
               FROM s GROUP BY run_id, metric, slice)
    SELECT run_id, metric, slice, {_COUNTS} FROM a""",
)
def _(v):
    """Runs of two datasets that share case ids; a case's slices are those of the run's dataset."""
    even = F.regexp_extract("case_id", "[0-9]+$", 0).cast("bigint") % 2 == 0
    language = F.filter("slices", lambda s: s.startswith("language/"))
    other = v.cases.filter(even).withColumns({"dataset_name": F.lit("other"), "slices": language})
    cases = v.cases.unionByName(other).select("dataset_name", "dataset_revision", "case_id", "slices")
    again = v.observations.filter((F.col("run_id") == "baseline") & even).withColumn("run_id", F.lit("other"))
    runs = v.runs.select("run_id", "dataset_name", "dataset_revision").unionByName(
        v.values("('other', 'other', 1)", "run_id, dataset_name, dataset_revision")
    )
    observations = v.observations.unionByName(again).drop("slices")
    return rounded(agg.slice_summary(observations, cases, runs), "mean")


@query(
    "aggregate_comparison",
    """
    SELECT pair_id, metric, slice, baseline_scored, baseline_skipped, baseline_errors, candidate_scored, candidate_skipped,
           candidate_errors, round(baseline_mean, 6) AS baseline_mean, round(candidate_mean, 6) AS candidate_mean,
           round(delta, 6) AS delta FROM v_comparison""",
)
def _(v):
    return rounded(
        comparison(v).drop("baseline_attempted", "candidate_attempted", "aligned"), "baseline_mean", "candidate_mean", "delta"
    )


@query(
    "slice_inventory",
    "SELECT dataset_name, dataset_revision, slice, count(*) AS cases FROM (SELECT dataset_name, dataset_revision, unnest(slices) AS slice FROM v_cases) GROUP BY ALL",
)
def _(v):
    return agg.slice_inventory(v.cases)


@query(
    "case_status_counts",
    """
    SELECT run_id, count(*) AS attempted, count(*) FILTER (failure_code IS NULL) AS completed,
           CAST(0 AS BIGINT) AS completed_with_errors, count(*) FILTER (failure_code IS NOT NULL) AS target_failed
    FROM v_attached GROUP BY run_id""",
)
def _(v):
    return agg.case_status_counts(case_results(v))


@query(
    "usage_totals",
    "SELECT run_id, CAST(sum(input_units) AS BIGINT) AS input_units, CAST(sum(output_units) AS BIGINT) AS output_units FROM v_responses GROUP BY run_id",
)
def _(v):
    return agg.usage_totals(v.responses)


_CHANGES = ", ".join(f"count(*) FILTER (change = '{c}') AS {c}" for c in gates.CHANGES)


@query("change_counts", f"SELECT pair_id, position, {_CHANGES} FROM v_gate_cases GROUP BY pair_id, position")
def _(v):
    return gates.change_counts(gate_cases(v), results(v))


@query(
    "dataset_profile",
    """
    SELECT 'documents' AS dataset_name, 'language' AS family, lang AS member, count(*) AS cases,
           CASE lang WHEN 'en' THEN CAST(250 AS BIGINT) WHEN 'de' THEN CAST(1 AS BIGINT) END AS expected_cases,
           coalesce(CASE lang WHEN 'en' THEN count(*) = 250 WHEN 'de' THEN count(*) = 1 END, true) AS as_expected
    FROM documents GROUP BY lang""",
)
def _(v):
    return agg.dataset_profile(v.cases, ["language"], {"language/en": 250, "language/de": 1})


@query(
    "failure_breakdown",
    """
    SELECT run_id, 'target' AS stage, failure_code AS code, true AS retryable, count(*) AS cases
    FROM v_responses WHERE failure_code IS NOT NULL GROUP BY ALL""",
)
def _(v):
    return agg.failure_breakdown(v.responses)


# --- gates ----------------------------------------------------------------------
@query(
    "gate_results",
    """
    SELECT pair_id, position, metric, slice, round(baseline_mean, 6) AS baseline_mean, round(candidate_mean, 6) AS candidate_mean,
           round(delta, 6) AS delta, coverage_passed, threshold_passed, regression_passed, failure_codes, status
    FROM v_gate_results""",
)
def flagship(v: Views) -> DataFrame:
    found = results(v).select(
        "pair_id", "position", "metric", "slice", "baseline_mean", "candidate_mean", "delta",
        "coverage_passed", "threshold_passed", "regression_passed", comma("failure_codes"), "status",
    )
    return rounded(found, "baseline_mean", "candidate_mean", "delta")


@query(
    "gate_cases",
    """SELECT pair_id, position, metric, slice, case_id, baseline_value, candidate_value, round(delta, 6) AS delta, baseline_passed, candidate_passed, change FROM v_gate_cases""",
)
def _(v):
    return rounded(gate_cases(v).drop("slices", "baseline_status", "candidate_status"), "delta")


@query(
    "decisions",
    """
    SELECT pair_id, CASE WHEN bool_and(status = 'passed') THEN 'passed' ELSE 'failed' END AS status,
           count(*) AS gates, count(*) FILTER (status = 'failed') AS failed_gates FROM v_gate_results GROUP BY pair_id""",
)
def _(v):
    return gates.decisions(results(v), v.pairs)


_STRICT = """
  ('strict', 0, 'quality.exact_match', CAST(NULL AS STRING), 'higher_is_better', 0.0D, 1.0D),
  ('strict', 1, 'quality.unknown', CAST(NULL AS STRING), 'higher_is_better', 0.0D, 1.0D),
  ('strict', 2, 'quality.exact_match', 'language/xx', 'higher_is_better', 0.0D, 1.0D),
  ('open', 0, 'quality.exact_match', 'source/src1', 'higher_is_better', 0.0D, 1.0D)
"""
_JUDGED = """
    pairs AS (SELECT * FROM (VALUES ('p1', 'strict'), ('p2', 'open'), ('p3', 'open'), ('p4', 'none')) t(pair_id, policy)),
    gates AS (SELECT * FROM (VALUES {gates}) t(policy, position, metric, slice, direction, threshold, allowed_regression)),
    judged AS (
      SELECT p.pair_id, p.policy, g.position, g.metric, g.slice, c.candidate_mean,
             coalesce(c.baseline_errors = 0 AND c.candidate_errors = 0 AND c.baseline_scored > 0 AND c.aligned
               AND c.baseline_scored = c.candidate_scored AND c.baseline_skipped = c.candidate_skipped, false) AS covered,
             coalesce(c.candidate_mean >= g.threshold - 1e-12, false) AS above,
             coalesce(c.delta >= -g.allowed_regression - 1e-12, false) AS kept
      FROM pairs p JOIN gates g USING (policy)
      LEFT JOIN v_comparison c ON p.pair_id IN ('p1', 'p2') AND c.metric = g.metric AND c.slice IS NOT DISTINCT FROM g.slice)""".replace(
    "{gates}", _STRICT.replace("STRING", "VARCHAR").replace("D,", ",").replace("D)", ")")
)


def judged_by_policy(v: Views) -> tuple[DataFrame, DataFrame]:
    """Gate results of pairs under two policies, one pair without evidence and one without gates."""
    pairs = v.values(
        "('p1', 'baseline', 'candidate', 'strict'), ('p2', 'baseline', 'candidate', 'open'),"
        " ('p3', 'absent-1', 'absent-2', 'open'), ('p4', 'baseline', 'candidate', 'none')",
        "pair_id, baseline_run, candidate_run, policy",
    )
    policy = v.values(_STRICT, "policy, position, metric, slice, direction, threshold, allowed_regression")
    return gates.gate_results(agg.aggregate_comparison(summary(v), pairs), policy, pairs), pairs


@query(
    "gate_results_by_policy",
    f"""
    WITH {_JUDGED}
    SELECT pair_id, policy, position, metric, slice, round(candidate_mean, 6) AS candidate_mean,
           concat_ws(',', CASE WHEN NOT covered THEN 'coverage' END, CASE WHEN NOT above THEN 'threshold' END,
                     CASE WHEN NOT kept THEN 'regression' END) AS failure_codes,
           CASE WHEN covered AND above AND kept THEN 'passed' ELSE 'failed' END AS status
    FROM judged""",
)
def _(v):
    found, _ = judged_by_policy(v)
    return rounded(
        found.select("pair_id", "policy", "position", "metric", "slice", "candidate_mean", comma("failure_codes"), "status"),
        "candidate_mean",
    )


@query(
    "decisions_by_policy",
    f"""
    WITH {_JUDGED}
    SELECT p.pair_id, CASE WHEN count(j.pair_id) > 0 AND bool_and(covered AND above AND kept) THEN 'passed' ELSE 'failed' END AS status,
           count(j.pair_id) AS gates, count(*) FILTER (j.pair_id IS NOT NULL AND NOT (covered AND above AND kept)) AS failed_gates
    FROM pairs p LEFT JOIN judged j ON j.pair_id = p.pair_id GROUP BY p.pair_id""",
)
def _(v):
    return gates.decisions(*judged_by_policy(v))


@query("newly_failing", "SELECT pair_id, case_id, metric, slice FROM v_gate_cases WHERE change = 'newly_failing'")
def _(v):
    return gates.newly_failing(gate_cases(v))


@query(
    "case_review",
    """
    SELECT case_id, change FROM v_gate_cases
    WHERE metric = 'quality.exact_match' AND slice IS NULL AND list_contains(slices, 'language/en') AND change = 'unchanged_failing'
      AND case_id > 'doc-2' ORDER BY case_id LIMIT 20""",
)
def _(v):
    from gaugework.operators.ordered import keyset_page

    chosen = gates.case_review(gate_cases(v), "quality.exact_match", None, "language/en", "unchanged_failing")
    return keyset_page(chosen.select("case_id", "change"), ["case_id"], ["doc-2"], 20).drop("has_next")


@query(
    "gate_triage",
    """
    SELECT pair_id, position, status,
           CASE WHEN slice IS NULL THEN 'all' WHEN split_part(slice, '/', 1) IN ('language', 'task', 'answerability', 'safety') THEN split_part(slice, '/', 1) ELSE 'all' END AS family,
           CASE split_part(metric, '.', 2) WHEN 'exact_match' THEN 'Exact match' WHEN 'refusal_correct' THEN 'Refusal correct' ELSE 'Latency ms' END
             || CASE WHEN slice IS NULL THEN '' ELSE ' · ' || split_part(slice, '/', 2) END AS label,
           CASE status WHEN 'failed' THEN 0 ELSE 1 END AS triage_rank
    FROM v_gate_results""",
)
def _(v):
    return gates.gate_triage(results(v))


@query(
    "compile_policy",
    """
    WITH g AS (SELECT DISTINCT source AS suite, 'quality.exact_match' AS metric, 'language/' || lang AS slice FROM documents),
         p AS (SELECT DISTINCT 'src' || (s_suppkey % 20) AS suite, s_nationkey AS b, s_nationkey % 5 AS c FROM supplier)
    SELECT p.suite, 'target' AS baseline_name, p.b AS baseline_revision, 'target' AS candidate_name, p.c AS candidate_revision, g.metric, g.slice
    FROM p JOIN g ON g.suite = p.suite WHERE p.b <> p.c""",
)
def _(v):
    suite_gates = v.table("documents").select(
        F.col("source").alias("suite"), F.lit("quality.exact_match").alias("metric"),
        F.concat(F.lit("language/"), "lang").alias("slice"),
    ).distinct()
    pairs = v.table("supplier").select(
        F.concat(F.lit("src"), F.col("s_suppkey") % 20).alias("suite"),
        F.lit("target").alias("baseline_name"), F.col("s_nationkey").alias("baseline_revision"),
        F.lit("target").alias("candidate_name"), (F.col("s_nationkey") % 5).alias("candidate_revision"),
    ).distinct()
    return gates.compile_policy(suite_gates, pairs).drop("policy")


@query(
    "canonical_order",
    "SELECT metric, slice, case_id, change FROM v_gate_cases",
)
def _(v):
    return canonical_order(gate_cases(v)).select("metric", "slice", "case_id", "change")


# --- distributions --------------------------------------------------------------
_STATS = """CAST(count(x) AS BIGINT) AS sample_count, {w}min(x){e} AS minimum, {w}quantile_disc(x, 0.5){e} AS p50,
       {w}quantile_disc(x, 0.95){e} AS p95, {w}max(x){e} AS maximum, round({w}avg(x){e}, 6) AS mean"""


def _stats(suppress: bool = False) -> str:
    w, e = ("CASE WHEN count(x) >= 20 THEN ", " END") if suppress else ("", "")
    return _STATS.format(w=w, e=e)


@query(
    "quantile_summary",
    f"""
    SELECT l_returnflag, l_linestatus, {_stats()}, false AS suppressed, count(x) < 20 AS small_sample
    FROM (SELECT l_returnflag, l_linestatus, CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS x FROM lineitem)
    GROUP BY l_returnflag, l_linestatus""",
)
def _(v):
    value = F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice"))
    return rounded(distributions.quantile_summary(v.table("lineitem"), ["l_returnflag", "l_linestatus"], value), "mean")


@query(
    "kept_quantiles",
    f"""
    SELECT l_suppkey, {_stats()}, count(x) BETWEEN 1 AND 4 AS suppressed, count(x) < 20 AS small_sample
    FROM (SELECT l_suppkey, CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS x FROM lineitem)
    GROUP BY l_suppkey""",
)
def _(v):
    """Sketches stored per supplier and flag, read back and merged per supplier; groups stay below a sketch's size."""
    path = scratch_path(v.spark, "kept")
    value = F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice"))
    kept_quantiles.kept_distribution(v.table("lineitem"), ["l_suppkey", "l_returnflag"], value).write.parquet(path)
    merged = kept_quantiles.merged_distribution(v.spark.read.parquet(path), ["l_suppkey"])
    return rounded(kept_quantiles.read_distribution(merged, ["l_suppkey"], suppress_below=5), "mean")


@query(
    "quantile_summary_ranges",
    f"""
    SELECT l_returnflag, {_stats()} FROM (SELECT l_returnflag, l_extendedprice AS x FROM lineitem) GROUP BY l_returnflag""",
)
def _(v):
    """The same operator with every group treated as hot (cut into value ranges)."""
    found = distributions.quantile_summary(v.table("lineitem"), ["l_returnflag"], "l_extendedprice", hot_rows=100)
    return rounded(found.drop("suppressed", "small_sample"), "mean")


@query(
    "quantile_summary_approx",
    "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS sample_count, min(l_quantity) AS minimum, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.95) AS p95, max(l_quantity) AS maximum FROM lineitem GROUP BY l_returnflag",
)
def _(v):
    """Sketch form; exact here because the values are few and well inside its error."""
    found = distributions.quantile_summary(v.table("lineitem"), ["l_returnflag"], "l_quantity", approx=True)
    return found.drop("suppressed", "small_sample", "mean")


_SIDES = """
    (SELECT pair_id, position, metric, slice, 'baseline' AS role, baseline_status AS st, baseline_value AS x FROM v_gate_cases
     UNION ALL SELECT pair_id, position, metric, slice, 'candidate', candidate_status, candidate_value FROM v_gate_cases)"""


@query(
    "score_distribution",
    f"""
    SELECT pair_id, position, metric, slice, role, count(*) AS attempted, count(*) FILTER (st = 'scored') AS scored,
           count(*) FILTER (st = 'skipped') AS skipped, count(*) FILTER (st = 'error') AS errors, {_stats()}
    FROM {_SIDES} GROUP BY ALL""",
)
def _(v):
    found = distributions.score_distribution(gate_cases(v)).drop("suppressed", "small_sample")
    return rounded(found, "mean")


@query(
    "delta_distribution",
    f"""
    SELECT pair_id, position, metric, slice, count(*) AS attempted, count(x) AS compared, count(*) - count(x) AS incomparable, {_stats()}
    FROM (SELECT *, delta AS x FROM v_gate_cases) GROUP BY ALL""",
)
def _(v):
    found = distributions.delta_distribution(gate_cases(v)).drop("suppressed", "small_sample")
    return rounded(found, "mean")


@query(
    "operational_distribution",
    f"""
    WITH m AS (SELECT g.pair_id, g.position, g.metric, g.slice, r.run_id AS role, r.failure_code, u.measure,
                 CASE u.measure WHEN 'latency_ms' THEN r.latency_ms WHEN 'input_units' THEN r.input_units
                      WHEN 'output_units' THEN r.output_units ELSE r.input_units + r.output_units END::DOUBLE AS x
               FROM v_gate_cases g JOIN v_responses r ON r.case_id = g.case_id
               CROSS JOIN (VALUES ('latency_ms'), ('input_units'), ('output_units'), ('total_units')) u(measure))
    SELECT pair_id, position, metric, slice, role, measure, count(*) AS attempted, count(x) AS measured, count(*) - count(x) AS unavailable,
           count(failure_code) AS target_failures, {_stats(True)}, count(x) BETWEEN 1 AND 19 AS suppressed
    FROM m GROUP BY ALL""",
)
def _(v):
    found = distributions.operational_distribution(v.responses, gate_cases(v), v.pairs).drop("small_sample")
    return rounded(found, "mean")


# --- set relations ----------------------------------------------------------------
@query(
    "slice_subset",
    """
    SELECT DISTINCT 'language/' || lang || CASE WHEN n_chars > 2000 THEN '-long' ELSE '' END AS slice FROM documents WHERE n_chars > 2000""",
)
def _(v):
    from gaugework.operators.aggregates import slice_inventory

    long = F.when(F.col("n_chars") > 2000, "-long").otherwise("")
    required = v.table("documents").select(F.concat(F.lit("language/"), F.col("lang"), long).alias("slice"))
    return sets.slice_subset(required, slice_inventory(v.cases))


@query(
    "set_equal",
    """
    SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def _(v):
    return sets.set_equal(v.table("documents"), v.table("labels"), ["doc_id"])


@query(
    "multiset_difference",
    """
    WITH a AS (SELECT l_partkey, l_quantity FROM lineitem),
         b AS (SELECT l_partkey, l_quantity FROM lineitem WHERE l_linenumber <> 4),
         ca AS (SELECT l_partkey, l_quantity, count(*) AS n FROM a GROUP BY ALL),
         cb AS (SELECT l_partkey, l_quantity, count(*) AS n FROM b GROUP BY ALL)
    SELECT ca.l_partkey, ca.l_quantity, ca.n AS left_copies, CAST(coalesce(cb.n, 0) AS BIGINT) AS right_copies
    FROM ca LEFT JOIN cb USING (l_partkey, l_quantity) WHERE ca.n <> coalesce(cb.n, 0)""",
)
def _(v):
    rows = v.table("lineitem")
    return sets.multiset_difference(rows, rows.filter("l_linenumber <> 4"), ["l_partkey", "l_quantity"])


_DIFFERING = """
    SELECT * EXCLUDE (l, r), CAST(sum(l) AS BIGINT) AS left_copies, CAST(sum(r) AS BIGINT) AS right_copies
    FROM (SELECT *, 1 AS l, 0 AS r FROM lineitem UNION ALL SELECT *, 0, 1 FROM lineitem WHERE {right})
    GROUP BY ALL HAVING sum(l) <> sum(r)"""


@query("multiset_difference_all", _DIFFERING.format(right="l_linenumber <> 4"))
def _(v):
    rows = v.table("lineitem")
    return sets.multiset_difference(rows, rows.filter("l_linenumber <> 4"), rows.columns)


@query("multiset_equal_all", f"SELECT count(*) = 0 AS equal, count(*) AS differing_rows FROM ({_DIFFERING.format(right='true')})")
def _(v):
    rows = v.table("lineitem")
    return sets.multiset_equal(rows, rows.repartition(spread_tasks(rows), "l_suppkey"), rows.columns)


@query("multiset_equal", "SELECT true AS equal, CAST(0 AS BIGINT) AS differing_rows")
def _(v):
    rows = v.table("lineitem")
    shuffled = rows.repartition(spread_tasks(rows), "l_suppkey")
    return sets.multiset_equal(rows, shuffled, rows.columns)


@query(
    "normalize_text",
    """
    SELECT doc_id, md5(trim(regexp_replace(lower(replace(text, 'ß', 'ss')), '\\s+', ' ', 'g'))) AS norm_md5 FROM documents""",
)
def _(v):
    return v.table("documents").select("doc_id", F.md5(normalize_text("text")).alias("norm_md5"))


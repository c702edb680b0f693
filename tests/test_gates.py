"""Comparison and gates on small fixtures with hand-computed results."""

import pytest
from helpers import ATTACHED, attached_row, rows
from pyspark.sql import functions as F

from gaugework.operators import aggregates, checks, gates, joins
from gaugework.operators.scoring import score

PAIRS = "pair_id STRING, baseline_run STRING, candidate_run STRING, policy STRING"
GATES = "policy STRING, position INT, metric STRING, slice STRING, direction STRING, threshold DOUBLE, allowed_regression DOUBLE"


def compare(spark, data, policy, scorers=("exact_match", "refusal", "latency")):
    attached = spark.createDataFrame(data, ATTACHED)
    pairs = spark.createDataFrame([("p", "base", "cand", "release")], PAIRS)
    gate_rows = spark.createDataFrame([("release", *g) for g in policy], GATES)
    observations = score(attached, scorers)
    comparison = aggregates.aggregate_comparison(aggregates.slice_summary(observations), pairs)
    results = gates.gate_results(comparison, gate_rows, pairs)
    cases = gates.gate_cases(joins.pair_runs(observations, pairs), gate_rows, pairs)
    return observations, comparison, results, cases


def three_cases(candidate_en='"wrong"', refusal="completed", failure=None):
    def side(run, en, outcome, failed):
        refused = outcome == "refused"
        return [
            attached_row(run_id=run, case_id="quality-de", slices=["language/de"], expected='"a"', output='"a"', failure_code=failed),
            attached_row(run_id=run, case_id="quality-en", slices=["language/en"], expected='"a"', output=en),
            attached_row(
                run_id=run, case_id="refusal-en", slices=["language/en", "safety/refusal"], expected='"no"', output='"no"',
                expected_refusal=True, outcome=outcome, refusal_code="x" if refused else None,
            ),
        ]

    return side("base", '"a"', "refused", None) + side("cand", candidate_en, refusal, failure)


def test_three_cases(spark):
    policy = [
        (0, "quality.exact_match", None, "higher_is_better", 0.6, 0.34),
        (1, "safety.refusal_correct", "safety/refusal", "higher_is_better", 1.0, 0.0),
    ]
    _, comparison, results, cases = compare(spark, three_cases(), policy)
    found = {r.position: r for r in results.collect()}
    assert found[0].status == "passed" and found[0].delta == pytest.approx(-1 / 3, abs=1e-12)
    assert found[1].status == "failed" and found[1].failure_codes == ["threshold", "regression"]
    english = comparison.filter("metric = 'quality.exact_match' AND slice = 'language/en'").first()
    assert english.candidate_mean == 0.5 and english.baseline_mean == 1.0
    assert rows(gates.newly_failing(cases), "case_id", "slice") == [("quality-en", None), ("refusal-en", "safety/refusal")]
    assert gates.decisions(results, results.select("pair_id").distinct()).first().status == "failed"
    counts = {r.position: r for r in gates.change_counts(cases, results).collect()}
    assert counts[0].newly_failing == 1 and counts[0].unchanged_passing == 2 and counts[0].incomparable == 0


def test_identical_runs_pass(spark):
    policy = [(0, "quality.exact_match", None, "higher_is_better", 1.0, 0.0)]
    _, comparison, results, _ = compare(spark, three_cases('"a"', "refused"), policy)
    assert results.first().status == "passed"
    assert {r.delta for r in comparison.collect()} == {0.0}


def test_boundaries_pass(spark):
    policy = [(0, "quality.exact_match", None, "higher_is_better", 2 / 3, 1 / 3)]
    assert compare(spark, three_cases(), policy)[2].first().status == "passed"


def test_one_failed_response_breaks_coverage_only_first(spark):
    policy = [(0, "quality.exact_match", None, "higher_is_better", 0.9, 0.0)]
    result = compare(spark, three_cases(failure="target_exception"), policy)[2].first()
    assert result.failure_codes == ["coverage", "threshold", "regression"]
    assert result.candidate_errors == 1 and result.candidate_attempted == 3


def test_tampered_summary_is_found(spark):
    observations = compare(spark, three_cases(), [])[0]
    actual = aggregates.metric_summary(observations)
    stored = actual.withColumn("mean", F.when((F.col("run_id") == "cand") & (F.col("metric") == "quality.exact_match"), 1.0).otherwise(F.col("mean")))
    found = checks.summary_mismatches(stored, actual).collect()
    assert [(r.run_id, r.metric) for r in found] == [("cand", "quality.exact_match")]
    assert checks.summary_mismatches(actual, actual).count() == 0


def test_null_slice_gate_is_not_a_wildcard(spark):
    policy = [(0, "quality.exact_match", None, "higher_is_better", 0.6, 0.5), (1, "quality.exact_match", "language/en", "higher_is_better", 0.6, 0.5)]
    cases = compare(spark, three_cases(), policy)[3]
    assert gates.case_review(cases, "quality.exact_match", None).count() == 3
    assert gates.case_review(cases, "quality.exact_match", "language/en").count() == 2
    assert gates.case_review(cases, "quality.exact_match", None, "safety/refusal").count() == 1
    assert gates.case_review(cases, "quality.exact_match", None, change="newly_failing").count() == 1


def release_cases(run, wrong=(), unrefused=()):
    data = []
    for lang in ("de", "en"):
        for i in range(1, 17):
            case = f"quality-{lang}-{i:03d}"
            text = f'"verified-{lang}-{i:03d}"'
            data.append(attached_row(
                run_id=run, case_id=case, expected=text, output='"incorrect"' if case in wrong else text,
                expected_schema='{"type":"string"}',
                slices=["answerability/answerable", f"language/{lang}", "safety/safe", "task/qa"],
            ))
        for i in range(1, 5):
            case = f"refusal-{lang}-{i:03d}"
            refused = case not in unrefused
            data.append(attached_row(
                run_id=run, case_id=case, expected='"refused"', output='"refused"', expected_refusal=True,
                outcome="refused" if refused else "completed", refusal_code="policy_block" if refused else None,
                expected_schema='{"type":"string"}',
                slices=["answerability/unanswerable", f"language/{lang}", "safety/refusal", "task/refusal"],
            ))
    return data


RELEASE_POLICY = [
    (0, "quality.exact_match", None, "higher_is_better", 0.95, 0.05),
    (1, "quality.exact_match", "language/de", "higher_is_better", 0.95, 0.05),
    (2, "safety.refusal_correct", "safety/refusal", "higher_is_better", 1.0, 0.0),
    (3, "performance.latency_ms", None, "lower_is_better", 5.0, 0.0),
]


def test_forty_case_release(spark):
    data = release_cases("base") + release_cases("cand", ("quality-de-001", "quality-en-001"), ("refusal-de-001",))
    _, _, results, cases = compare(spark, data, RELEASE_POLICY, ("exact_match", "refusal", "latency", "json_schema"))
    found = {r.position: (r.baseline_mean, r.candidate_mean, r.delta, r.status) for r in results.collect()}
    assert found[0] == (1.0, 0.95, -0.05, "passed")
    assert found[1] == (1.0, 0.95, -0.05, "passed")
    assert found[2] == (1.0, 0.875, -0.125, "failed")
    assert found[3] == (5.0, 5.0, 0.0, "passed")
    failing = {r.case_id for r in gates.newly_failing(cases).collect()}
    assert failing == {"quality-de-001", "quality-en-001", "refusal-de-001"}
    triage = gates.gate_triage(results).collect()
    assert [r.position for r in triage] == [2, 0, 1, 3]
    assert [r.label for r in triage] == ["Refusal correct · refusal", "Exact match", "Exact match · de", "Latency ms"]


def test_hundred_case_summary(spark):
    data = []
    for i in range(1, 101):
        base = {"run_id": "r", "case_id": f"offline-{i:03d}"}
        if i <= 70:
            data.append(attached_row(**base, expected=f'"Answer {i}"', output=f'"Answer {i}"', slices=["scenario/echo", "tier/core"]))
        elif i <= 80:
            data.append(attached_row(**base, expected=f'"ANSWER {i}"', output=f'"ANSWER {i}"', slices=["scenario/uppercase", "tier/core"]))
        elif i <= 85:
            data.append(attached_row(**base, expected=str(i), output=str(i + 0.05), numeric_tolerance=0.1, slices=["scenario/numeric", "tier/edge"]))
        elif i <= 90:
            data.append(attached_row(**base, expected='"no"', output='"no"', expected_refusal=True, outcome="refused", refusal_code="policy_block", slices=["safety/refusal", "tier/edge"]))
        else:
            text = f'{{"answer":{i},"ok":true}}'
            schema = '{"additionalProperties":false,"properties":{"answer":{"type":"integer"},"ok":{"const":true}},"required":["answer","ok"],"type":"object"}'
            data.append(attached_row(**base, expected=text, output=text, expected_schema=schema, slices=["contract/json", "tier/edge"]))
    attached = spark.createDataFrame(data, ATTACHED)
    summary = aggregates.metric_summary(score(attached, ["exact_match", "json_schema", "numeric_tolerance", "refusal", "latency"]))
    found = {r.metric: (r.mean, r.scored, r.skipped, r.errors) for r in summary.collect()}
    assert found == {
        "quality.exact_match": (0.95, 100, 0, 0),
        "quality.json_schema_valid": (1.0, 10, 90, 0),
        "quality.numeric_within_tolerance": (1.0, 5, 95, 0),
        "safety.refusal_correct": (1.0, 100, 0, 0),
        "performance.latency_ms": (5.0, 100, 0, 0),
    }
    sizes = rows(aggregates.slice_inventory(attached.select("slices")), "slice", "cases")
    assert ("tier/core", 80) in sizes and ("tier/edge", 20) in sizes


def test_run_status_ignores_low_scores(spark):
    observations = compare(spark, three_cases(), [])[0]
    attached = spark.createDataFrame(three_cases(), ATTACHED)
    statuses = checks.case_status(attached, observations)
    found = checks.run_status(statuses, aggregates.metric_summary(observations))
    assert rows(found) == [("base", "completed"), ("cand", "completed")]


def test_salted_join_equals_broadcast(spark):
    data = release_cases("base") + release_cases("cand", ("quality-de-001",), ())
    plain = compare(spark, data, RELEASE_POLICY)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "0b")
    try:
        salted = compare(spark, data, RELEASE_POLICY)
        for a, b in zip(plain[1:], salted[1:], strict=True):
            assert rows(a) == rows(b)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_gate_scope_lists_empty_slices(spark):
    cases = spark.createDataFrame([("c1", ["a/x"]), ("c2", [])], "case_id STRING, slices ARRAY<STRING>")
    policy = spark.createDataFrame([("r", k, "m", s, "h", 0.0, 0.0) for k, s in enumerate([None, "a/x", "a/y"])], GATES)
    assert rows(joins.gate_scope(cases, policy), "position", "case_id") == [(0, "c1"), (0, "c2"), (1, "c1")]
    assert rows(joins.empty_scopes(cases, policy), "position", "code") == [(2, "empty_scope")]


def test_gates_without_evidence_fail(spark):
    policy = [
        (0, "quality.exact_match", None, "higher_is_better", 0.0, 1.0),
        (1, "quality.unknown", None, "higher_is_better", 0.0, 1.0),
        (2, "quality.exact_match", "language/xx", "higher_is_better", 0.0, 1.0),
    ]
    _, comparison, results, _ = compare(spark, three_cases(), policy)
    found = {r.position: r for r in results.collect()}
    assert {k: r.status for k, r in found.items()} == {0: "passed", 1: "failed", 2: "failed"}
    assert found[1].failure_codes == ["coverage", "threshold", "regression"]
    pairs = spark.createDataFrame(
        [("p", "base", "cand", "release"), ("ghost", "x", "y", "release"), ("free", "base", "cand", "other")], PAIRS
    )
    gate_rows = spark.createDataFrame([("release", *policy[0])], GATES)
    judged = gates.gate_results(comparison, gate_rows, pairs)
    assert rows(judged, "pair_id", "status") == [("ghost", "failed"), ("p", "passed")]
    assert rows(gates.decisions(judged, pairs)) == [("free", "failed", 0, 0), ("ghost", "failed", 1, 1), ("p", "passed", 1, 0)]


def test_pairs_with_differing_labels_and_repeats(spark):
    ddl = "run_id STRING, case_id STRING, slices ARRAY<STRING>, metric STRING, status STRING, value DOUBLE"
    data = [
        ("base", "a", ["x"], "m", "scored", 1.0), ("cand", "a", ["x", "y"], "m", "scored", 0.0),
        ("base", "b", ["x"], "m", "scored", 1.0), ("cand", "b", ["x"], "m", "scored", 1.0), ("cand", "b", ["x"], "m", "error", None),
    ]
    pairs = spark.createDataFrame([("p", "base", "cand", "release")], PAIRS)
    found = rows(joins.pair_runs(spark.createDataFrame(data, ddl), pairs), "case_id", "slices", "baseline_status", "candidate_status", "candidate_value")
    assert found == [("a", ["x", "y"], "scored", "scored", 0.0), ("b", ["x"], "scored", "error", None)]


def test_datasets_may_share_case_ids(spark):
    observations = spark.createDataFrame(
        [("r1", "c1", "m", "scored", 1.0), ("r2", "c1", "m", "scored", 0.0)],
        "run_id STRING, case_id STRING, metric STRING, status STRING, value DOUBLE",
    )
    cases = spark.createDataFrame(
        [("one", 1, "c1", ["a/x"]), ("two", 1, "c1", ["a/y"])],
        "dataset_name STRING, dataset_revision INT, case_id STRING, slices ARRAY<STRING>",
    )
    runs = spark.createDataFrame([("r1", "one", 1), ("r2", "two", 1)], "run_id STRING, dataset_name STRING, dataset_revision INT")
    want = [("r1", "a/x", 1, 1.0), ("r1", None, 1, 1.0), ("r2", "a/y", 1, 0.0), ("r2", None, 1, 0.0)]
    assert rows(aggregates.slice_summary(observations, cases, runs), "run_id", "slice", "attempted", "mean") == want
    named = observations.join(runs, "run_id")
    assert rows(aggregates.slice_summary(named, cases), "run_id", "slice", "attempted", "mean") == want
    with pytest.raises(ValueError, match="datasets"):
        aggregates.slice_summary(observations, cases)

import pandas as pd
import pytest
from helpers import ATTACHED, attached_row, rows
from pyspark.sql import functions as F

from gaugework.operators import scoring
from gaugework.operators.scoring import PandasScorer, Scorer, observation, score


def observed(spark, scorer, **given):
    df = spark.createDataFrame([attached_row(**given)], ATTACHED)
    row = score(df, [scorer]).first()
    return row.status, row.value, row.reason_code, row.error_code


@pytest.mark.parametrize(
    "output, expected, outcome",
    [
        ('"Answer"', '"answer"', ("scored", 0.0, "mismatched", None)),
        ('{"a":1,"b":2}', '{"b":2,"a":1}', ("scored", 1.0, "matched", None)),
        ("[1,2]", "[2,1]", ("scored", 0.0, "mismatched", None)),
        ("1.0", "1", ("scored", 1.0, "matched", None)),
        ("1e0", "1", ("scored", 1.0, "matched", None)),
        ("true", "1", ("scored", 0.0, "mismatched", None)),
        ("1", None, ("skipped", None, "no_expectation", None)),
        ("1", "null", ("skipped", None, "no_expectation", None)),
    ],
)
def test_exact_match(spark, output, expected, outcome):
    assert observed(spark, "exact_match", output=output, expected=expected) == outcome


@pytest.mark.parametrize(
    "output, expected, outcome",
    [
        ('"  Straße\\n"', '"STRASSE"', ("scored", 1.0, "matched", None)),
        ('"Café"', '"CAFÉ"', ("scored", 1.0, "matched", None)),
        ('"answer!"', '"answer"', ("scored", 0.0, "mismatched", None)),
        ("1", '"1"', ("error", None, None, "non_text_value")),
        ('"1"', "1", ("error", None, None, "non_text_value")),
        ('"x"', None, ("skipped", None, "no_expectation", None)),
    ],
)
def test_normalized_match(spark, output, expected, outcome):
    assert observed(spark, "normalized_match", output=output, expected=expected) == outcome


@pytest.mark.parametrize(
    "output, expected, tolerance, outcome",
    [
        ("1.1", "1.0", 0.1, ("scored", 1.0, "within_tolerance", None)),
        (repr(0.1 + 0.2), "0.3", 1e-15, ("scored", 1.0, "within_tolerance", None)),
        ("1.101", "1.0", 0.1, ("scored", 0.0, "outside_tolerance", None)),
        ('"1"', "1", 0.1, ("error", None, None, "non_numeric_value")),
        ("true", "1", 0.1, ("error", None, None, "non_numeric_value")),
        ("1", "1", None, ("skipped", None, "no_tolerance", None)),
        ("1", None, 0.1, ("skipped", None, "no_tolerance", None)),
        ("1e300", "1e300", 0.1, ("scored", 1.0, "within_tolerance", None)),
    ],
)
def test_numeric(spark, output, expected, tolerance, outcome):
    assert observed(spark, "numeric_tolerance", output=output, expected=expected, numeric_tolerance=tolerance) == outcome


def test_refusal_looks_at_the_outcome_only(spark):
    assert observed(spark, "refusal", output='"I cannot"', expected_refusal=True)[1] == 0.0
    assert observed(spark, "refusal", outcome="refused", refusal_code="x", expected_refusal=True)[1] == 1.0


def test_latency_and_usage(spark):
    assert observed(spark, "latency", latency_ms=1.23456789)[1] == 1.234568
    df = spark.createDataFrame([attached_row(input_units=3, output_units=4)], ATTACHED)
    assert rows(score(df, ["usage"]), "metric", "value") == [
        ("usage.input_units", 3.0), ("usage.output_units", 4.0), ("usage.total_units", 7.0),
    ]


SCHEMA = '{"additionalProperties":false,"properties":{"answer":{"type":"integer"},"ok":{"const":true}},"required":["answer","ok"],"type":"object"}'


REFERRING = (
    '{"type":"object","properties":{"a":{"$ref":"#/$defs/pos"},"b":{"$ref":"#/$defs/also"},"c":{"title":"t","$ref":"#/$defs/a~1b~0"}},'
    '"$defs":{"pos":{"type":"integer","minimum":0},"also":{"$ref":"#/$defs/pos"},"a/b~":{"type":"string"}}}'
)


@pytest.mark.parametrize(
    "output, schema, outcome",
    [
        ('{"answer":91,"ok":true}', SCHEMA, ("scored", 1.0, "valid", None)),
        ('{"answer":91.0,"ok":true}', SCHEMA, ("scored", 1.0, "valid", None)),
        ('{"answer":91.5,"ok":true}', SCHEMA, ("scored", 0.0, "schema_mismatch", None)),
        ('{"answer":91,"ok":false}', SCHEMA, ("scored", 0.0, "schema_mismatch", None)),
        ('{"answer":91}', SCHEMA, ("scored", 0.0, "schema_mismatch", None)),
        ('{"answer":91,"ok":true,"x":1}', SCHEMA, ("scored", 0.0, "schema_mismatch", None)),
        ('"text"', '{"type":"string"}', ("scored", 1.0, "valid", None)),
        ("1", '{"type":["string","null"]}', ("scored", 0.0, "schema_mismatch", None)),
        ("null", '{"type":["string","null"]}', ("scored", 1.0, "valid", None)),
        ("7", '{"type":"number"}', ("scored", 1.0, "valid", None)),
        ("7", '{"type":"nonsense"}', ("error", None, None, "invalid_schema")),
        ("7", "[1]", ("error", None, None, "invalid_schema")),
        ("7", '{"$ref":"http://example.com/x"}', ("error", None, None, "remote_reference")),
        ("7", '{"allOf":[]}', ("error", None, None, "unsupported_schema")),
        ("7", None, ("skipped", None, "no_schema", None)),
        ('{"a":5}', REFERRING, ("scored", 1.0, "valid", None)),
        ('{"a":-5}', REFERRING, ("scored", 0.0, "schema_mismatch", None)),
        ('{"a":5,"b":"x"}', REFERRING, ("scored", 0.0, "schema_mismatch", None)),
        ('{"b":6}', REFERRING, ("scored", 1.0, "valid", None)),
        ('{"c":"x"}', REFERRING, ("scored", 1.0, "valid", None)),
        ('{"a":1}', '{"$ref":"#/definitions/r","definitions":{"r":{"type":"object","required":["a"]}}}', ("scored", 1.0, "valid", None)),
        ('{"b":1}', '{"$ref":"#/definitions/r","definitions":{"r":{"type":"object","required":["a"]}}}', ("scored", 0.0, "schema_mismatch", None)),
        ("1", '{"$ref":"#/$defs/a","$defs":{"a":{"$ref":"#/$defs/b"},"b":{"$ref":"#/$defs/a"}}}', ("error", None, None, "invalid_schema")),
        ('{"a":1}', '{"properties":{"a":{"$ref":"#/$defs/none"}},"$defs":{}}', ("error", None, None, "invalid_schema")),
        ('{"a":1}', '{"properties":{"a":{"$ref":"#/properties/a"}}}', ("error", None, None, "invalid_schema")),
        ('{"a":1}', '{"properties":{"a":{"$ref":"#"}}}', ("error", None, None, "unsupported_schema")),
        ('{"a":1}', '{"properties":{"a":{"$ref":"#/$defs/n","minimum":0}},"$defs":{"n":{"type":"integer"}}}', ("error", None, None, "unsupported_schema")),
        ('{"a":1}', '{"properties":{"a":{"$ref":"other.json"}}}', ("error", None, None, "remote_reference")),
        ('{"a":"$ref"}', '{"properties":{"a":{"const":"$ref"}}}', ("scored", 1.0, "valid", None)),
    ],
)
def test_json_schema(spark, output, schema, outcome):
    assert observed(spark, "json_schema", output=output, expected_schema=schema) == outcome


def test_failed_targets_are_errors_for_every_metric(spark):
    df = spark.createDataFrame([attached_row(failure_code="target_timeout", output=None)], ATTACHED)
    found = score(df, ["exact_match", "usage"])
    assert rows(found, "status", "error_code") == [("error", "target_timeout")] * 4
    assert score(df, ["exact_match"], failed_as_errors=False).count() == 0


def test_scorer_sets_must_be_unique_and_not_empty():
    with pytest.raises(ValueError):
        scoring.scorer_set([])
    with pytest.raises(ValueError):
        scoring.scorer_set(["usage", "usage"])
    with pytest.raises(ValueError):
        scoring.scorer_set(["refusal", Scorer("other", (scoring.REFUSAL,), lambda: None)])


def test_custom_scorer_contract(spark):
    def nan():
        return F.array(observation("bad", "m.nan", "scored", F.lit(float("nan")), reason="x"))

    def twice():
        one = observation("two", "m.two", "scored", F.lit(1.0), reason="x")
        return F.array(one, one)

    df = spark.createDataFrame([attached_row(output="1")], ATTACHED)
    found = score(df, [Scorer("bad", ("m.nan",), nan), Scorer("two", ("m.two",), twice)])
    assert rows(found, "metric", "error_code") == [
        ("m.nan", "invalid_evaluator_output"), ("m.two", "invalid_evaluator_output"),
    ]


def test_pandas_scorer_isolates_failing_rows(spark):
    def length(frame):
        if frame["output"].eq("boom").any():
            raise RuntimeError("no")
        return pd.DataFrame({"m.length": frame["output"].str.len()})

    data = [attached_row(case_id=f"c{i}", output="boom" if i == 37 else "x" * i) for i in range(60)]
    df = spark.createDataFrame(data, ATTACHED).coalesce(1)
    found = PandasScorer("length", ("m.length",), ("output",), length).run(df).collect()
    assert len(found) == 60
    assert [(r.case_id, r.error_code) for r in found if r.status == "error"] == [("c37", "evaluator_exception")]
    assert sum(r.value for r in found if r.value is not None) == sum(i for i in range(60) if i != 37)


def test_pandas_scorer_with_wrong_columns(spark):
    scorer = PandasScorer("odd", ("m.a",), ("output",), lambda f: pd.DataFrame({"m.b": f["output"]}))
    df = spark.createDataFrame([attached_row(output="1")], ATTACHED)
    assert rows(scorer.run(df), "status", "error_code") == [("error", "invalid_evaluator_output")]

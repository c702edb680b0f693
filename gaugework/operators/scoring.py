"""Deterministic scorers as column expressions.

Every scorer yields an array of observation structs for one attached row (a case
with its recorded response).  All requested scorers are concatenated and exploded
once, so scoring any number of metrics is one scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions import (
    canonical_json,
    is_canonical_number,
    json_kind,
    normalize_text,
    parse_strict,
)
from gaugework.schemas import OBSERVATION_STRUCT, OBSERVATIONS

# Metric names.
EXACT_MATCH = "quality.exact_match"
NORMALIZED_MATCH = "quality.normalized_match"
JSON_VALID = "quality.json_schema_valid"
NUMERIC = "quality.numeric_within_tolerance"
REFUSAL = "safety.refusal_correct"
LATENCY = "performance.latency_ms"
INPUT_UNITS = "usage.input_units"
OUTPUT_UNITS = "usage.output_units"
TOTAL_UNITS = "usage.total_units"


@dataclass(frozen=True)
class Scorer:
    """A named set of metrics and the expression that observes all of them."""

    name: str
    metrics: tuple[str, ...]
    expr: Callable[[], Column]


def observation(
    evaluator: str,
    metric: str,
    status: Column | str,
    value: Column | None = None,
    reason: Column | str | None = None,
    error: Column | str | None = None,
) -> Column:
    def lit(x, kind="string"):
        return (x if isinstance(x, Column) else F.lit(x)).cast(kind)

    return F.struct(
        F.lit(evaluator).alias("evaluator"),
        F.lit(metric).alias("metric"),
        lit(status).alias("status"),
        lit(value, "double").alias("value"),
        lit(reason).alias("reason_code"),
        lit(error).alias("error_code"),
    )


def _scored(evaluator: str, metric: str, value: Column, reason) -> Column:
    return observation(evaluator, metric, "scored", value, reason=reason)


def _matched(evaluator: str, metric: str, hit: Column, yes="matched", no="mismatched"):
    return _scored(
        evaluator, metric, hit.cast("double"), F.when(hit, yes).otherwise(F.lit(no))
    )


def _no_expectation() -> Column:
    expected = F.col("expected")
    return expected.isNull() | (F.trim(expected) == "null")


def _exact_match() -> Column:
    name = "exact_match"
    same = F.coalesce(
        (F.col("output") == F.col("expected"))
        | (canonical_json("output") == canonical_json("expected")),
        F.lit(False),
    )
    return F.array(
        F.when(
            _no_expectation(),
            observation(name, EXACT_MATCH, "skipped", reason="no_expectation"),
        ).otherwise(_matched(name, EXACT_MATCH, same))
    )


def _json_text(c: str) -> Column:
    """The text behind a JSON string; plain quoted texts need no parse."""
    raw = F.col(c)
    plain = raw.rlike(r'^"[^"\\]*"$')
    inner = F.substring(raw, F.lit(2), F.length(raw) - 2)
    return F.when(plain, inner).otherwise(
        F.try_variant_get(parse_strict(c), "$", "string")
    )


def _normalized_match() -> Column:
    name = "normalized_match"
    text = (json_kind("expected") == "string") & (json_kind("output") == "string")
    same = normalize_text(_json_text("output")) == normalize_text(_json_text("expected"))
    return F.array(
        F.when(
            _no_expectation(),
            observation(name, NORMALIZED_MATCH, "skipped", reason="no_expectation"),
        )
        .when(
            ~F.coalesce(text, F.lit(False)),
            observation(name, NORMALIZED_MATCH, "error", error="non_text_value"),
        )
        .otherwise(_matched(name, NORMALIZED_MATCH, F.coalesce(same, F.lit(False))))
    )


def _numeric_tolerance() -> Column:
    name = "numeric_tolerance"
    numbers = is_canonical_number("output") & is_canonical_number("expected")
    actual, expected = F.col("output"), F.col("expected")
    tolerance = F.col("numeric_tolerance")
    exact = (
        F.abs(actual.try_cast("decimal(38,18)") - expected.try_cast("decimal(38,18)"))
        <= tolerance.cast("string").try_cast("decimal(38,18)")
    )
    loose = F.abs(actual.try_cast("double") - expected.try_cast("double")) <= tolerance
    close = F.coalesce(exact, loose, F.lit(False))
    return F.array(
        F.when(
            tolerance.isNull() | _no_expectation(),
            observation(name, NUMERIC, "skipped", reason="no_tolerance"),
        )
        .when(~numbers, observation(name, NUMERIC, "error", error="non_numeric_value"))
        .otherwise(
            _matched(name, NUMERIC, close, "within_tolerance", "outside_tolerance")
        )
    )


def _refusal() -> Column:
    hit = (F.col("outcome") == "refused") == F.col("expected_refusal")
    return F.array(_matched("refusal", REFUSAL, F.coalesce(hit, F.lit(False))))


def _latency() -> Column:
    return F.array(
        _scored("latency", LATENCY, F.round("latency_ms", 6), "observed")
    )


def _usage() -> Column:
    used, made = F.col("input_units"), F.col("output_units")
    values = ((INPUT_UNITS, used), (OUTPUT_UNITS, made), (TOTAL_UNITS, used + made))
    return F.array(*[_scored("usage", m, v.cast("double"), "observed") for m, v in values])


# --- JSON conformance -------------------------------------------------------
# The rule keywords understood here; any other keyword that restricts a value is
# reported as ``unsupported_schema`` instead of being ignored.
ROOT_KEYWORDS = (
    "$schema", "$id", "$comment", "title", "description", "default", "examples",
    "type", "enum", "const", "required", "properties", "additionalProperties", "$defs", "definitions",
)
# What may stand next to a reference without restricting a value.
BESIDE_REFERENCE = ("$ref", "$schema", "$id", "$comment", "title", "description", "default", "examples", "$defs", "definitions")
REFERENCE_STEPS = 16
PROPERTY_KEYWORDS = (
    "$comment", "title", "description", "default", "examples",
    "type", "enum", "const", "minimum", "maximum", "minLength", "maxLength",
)
TYPE_NAMES = ("object", "array", "string", "number", "integer", "boolean", "null")


def _variant_kind(v: Column) -> Column:
    """JSON Schema type of a variant; whole numbers are ``integer``."""
    shape = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    return (
        F.when(shape == "VOID", "null")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape == "STRING", "string")
        .when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "array")
        .when(number == F.floor(number), "integer")
        .otherwise("number")
    )


def _names(v: Column, path: str) -> Column:
    """A keyword that is one name or a list of names, as a list."""
    many = F.try_variant_get(v, path, "array<string>")
    return F.coalesce(many, F.array(F.try_variant_get(v, path, "string")))


def _value_ok(rule: Column, v: Column) -> Column:
    kind = _variant_kind(v)
    text = F.to_json(v)
    types = F.transform(
        F.try_variant_get(rule, "$.type", "array<string>"), lambda t: t
    )
    single = F.try_variant_get(rule, "$.type", "string")
    accepted = F.array(kind, F.when(kind == "integer", "number").otherwise(kind))
    type_ok = (
        F.when(F.try_variant_get(rule, "$.type", "variant").isNull(), F.lit(True))
        .when(types.isNotNull(), F.arrays_overlap(types, accepted))
        .otherwise(F.array_contains(accepted, single))
    )
    const = F.to_json(F.try_variant_get(rule, "$.const", "variant"))
    options = F.transform(
        F.try_variant_get(rule, "$.enum", "array<variant>"), lambda o: F.to_json(o)
    )
    number = F.when(kind.isin("integer", "number"), F.try_variant_get(v, "$", "double"))
    size = F.when(kind == "string", F.length(F.try_variant_get(v, "$", "string")))
    limits = (
        (number, "$.minimum", "double", lambda a, b: a >= b),
        (number, "$.maximum", "double", lambda a, b: a <= b),
        (size, "$.minLength", "int", lambda a, b: a >= b),
        (size, "$.maxLength", "int", lambda a, b: a <= b),
    )
    ok = type_ok & F.coalesce(text == const, F.lit(True))
    ok = ok & F.coalesce(F.array_contains(options, text), F.lit(True))
    for actual, path, kind_name, holds in limits:
        bound = F.try_variant_get(rule, path, kind_name)
        ok = ok & F.coalesce(holds(actual, bound), F.lit(True))
    return F.coalesce(ok, F.lit(False))


def _let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """Name intermediate values inside an expression, so each is computed once."""
    bound = F.struct(*[value.alias(name) for name, value in values.items()])
    return F.element_at(F.transform(F.array(bound), body), 1)


def _strings() -> Column:
    return F.array().cast("array<string>")


def _verdict(s: Column) -> Column:
    """Verdict from the named parts of a schema and a value."""
    rules, value, root, properties = s["rules"], s["value"], s["root"], s["properties"]
    names, required, closed = F.map_keys(s["fields"]), s["required"], s["closed"]
    keys = F.map_keys(root)
    field_types = F.transform(
        F.map_values(properties), lambda p: F.coalesce(_names(p, "$.type"), _strings())
    )
    declared = F.concat(_names(rules, "$.type"), F.coalesce(F.flatten(field_types), _strings()))
    known_types = F.forall(declared, lambda t: t.isNull() | t.isin(*TYPE_NAMES))
    malformed = (
        root.isNull()
        | ~F.coalesce(known_types, F.lit(True))
        | (F.array_contains(keys, "required") & required.isNull())
        | (F.array_contains(keys, "properties") & properties.isNull())
    )
    plain_root = F.forall(keys, lambda k: k.isin(*ROOT_KEYWORDS))
    plain_fields = F.forall(
        F.map_values(properties),
        lambda p: F.coalesce(
            F.forall(
                F.map_keys(F.try_variant_get(p, "$", "map<string,variant>")),
                lambda k: k.isin(*PROPERTY_KEYWORDS),
            ),
            F.lit(False),
        ),
    )
    has_all = F.forall(required, lambda name: F.array_contains(names, name))
    fields_ok = F.forall(
        F.map_entries(properties),
        lambda e: F.coalesce(
            ~F.array_contains(names, e["key"])
            | _value_ok(e["value"], F.try_element_at(s["fields"], e["key"])),
            F.lit(True),
        ),
    )
    extra = F.array_except(names, F.coalesce(F.map_keys(properties), _strings()))
    no_extra = F.coalesce(closed, F.lit(True)) | (F.size(extra) == 0)
    holds = (
        _value_ok(rules, value)
        & F.coalesce(has_all, F.lit(True))
        & F.coalesce(fields_ok, F.lit(True))
        & F.coalesce(no_extra, F.lit(True))
    )
    return (
        F.when(F.coalesce(malformed, F.lit(True)), "invalid_schema")
        .when(~(plain_root & F.coalesce(plain_fields, F.lit(True))), "unsupported_schema")
        .when(F.coalesce(holds, F.lit(False)), "valid")
        .otherwise("schema_mismatch")
    )


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _targets(root: Column) -> Column:
    """Parts of a schema by the reference that names them."""
    none = F.map_from_arrays(_strings(), F.array().cast("array<variant>"))

    def of(place: str) -> Column:
        held = F.coalesce(_object(F.try_element_at(root, F.lit(place))), none)
        return F.transform_keys(
            held,
            lambda k, _: F.concat(F.lit(f"#/{place}/"), F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))),
        )

    return F.map_concat(*[of(place) for place in ("$defs", "definitions", "properties")])


def _resolved(v: Column, targets: Column) -> Column:
    """What local references lead to; NULL where they go round or name a part that is not there.

    References next to other rules, and those that name no direct part of the schema, stay as they are.
    """

    def reference(at: Column) -> Column:
        held = _object(at)
        ref = F.try_variant_get(F.try_element_at(held, F.lit("$ref")), "$", "string")
        alone = F.forall(F.map_keys(held), lambda k: k.isin(*BESIDE_REFERENCE))
        return F.when(alone & ref.rlike(r"^#/(\$defs|definitions|properties)/[^/]+$"), ref)

    def followed(at: Column, _: Column) -> Column:
        return F.when(reference(at).isNotNull(), F.try_element_at(targets, reference(at))).otherwise(at)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(REFERENCE_STEPS)), v, followed)
    return _let({"end": end}, lambda s: F.when(reference(s["end"]).isNull(), s["end"]))


def _with_references(rules: Column) -> Column:
    """``rules``, ``properties`` and whether all local references ``lead`` somewhere."""

    def found(s: Column) -> Column:
        return _let(
            {"rules": _resolved(s["rules"], s["targets"]), "targets": s["targets"]},
            lambda t: _let(
                {
                    "rules": t["rules"],
                    "properties": F.transform_values(
                        _object(F.try_element_at(_object(t["rules"]), F.lit("properties"))), lambda _, p: _resolved(p, t["targets"])
                    ),
                },
                lambda u: F.struct(
                    u["rules"].alias("rules"),
                    u["properties"].alias("properties"),
                    (
                        u["rules"].isNotNull()
                        & F.coalesce(F.forall(F.map_values(u["properties"]), lambda p: p.isNotNull()), F.lit(True))
                    ).alias("lead"),
                ),
            ),
        )

    return _let({"rules": rules, "targets": _targets(_object(rules))}, found)


def json_conforms(output: Column | str, schema: Column | str) -> Column:
    """``valid``, ``schema_mismatch``, ``invalid_schema``, ``remote_reference``,
    ``unsupported_schema`` or NULL without a schema, all inside one row.

    References to the schema's own ``$defs``, ``definitions`` and ``properties`` are followed;
    those that go round or name nothing make an ``invalid_schema``."""
    out = F.col(output) if isinstance(output, str) else output
    text = F.col(schema) if isinstance(schema, str) else schema

    def parts(parsed: Column) -> Column:
        value = parsed["value"]
        plain = F.struct(
            parsed["rules"].alias("rules"),
            F.try_variant_get(parsed["rules"], "$.properties", "map<string,variant>").alias("properties"),
            F.lit(True).alias("lead"),
        )
        followed = F.when(text.contains('"$ref"'), _with_references(parsed["rules"])).otherwise(plain)
        return _let({"schema": followed, "value": value}, named)

    def named(parsed: Column) -> Column:
        rules, value = parsed["schema"]["rules"], parsed["value"]
        verdict = _let(
            {
                "rules": rules,
                "value": value,
                "root": F.try_variant_get(rules, "$", "map<string,variant>"),
                "properties": parsed["schema"]["properties"],
                "required": F.try_variant_get(rules, "$.required", "array<string>"),
                "closed": F.try_variant_get(rules, "$.additionalProperties", "boolean"),
                "fields": F.try_variant_get(value, "$", "map<string,variant>"),
            },
            _verdict,
        )
        return F.when(parsed["schema"]["lead"], verdict).otherwise("invalid_schema")

    return (
        F.when(text.isNull() | (F.trim(text) == "null"), F.lit(None).cast("string"))
        .when(F.coalesce(json_kind(text) != "object", F.lit(True)), "invalid_schema")
        .when(text.rlike(r'"\$ref"\s*:\s*"(?!#)'), "remote_reference")
        .otherwise(_let({"rules": parse_strict(text), "value": parse_strict(out)}, parts))
    )


def _json_schema() -> Column:
    name = "json_schema"
    verdict = json_conforms("output", "expected_schema")
    return F.transform(
        F.array(verdict),
        lambda v: F.when(
            v.isNull(), observation(name, JSON_VALID, "skipped", reason="no_schema")
        )
        .when(
            v.isin("valid", "schema_mismatch"),
            _scored(name, JSON_VALID, (v == "valid").cast("double"), v),
        )
        .otherwise(observation(name, JSON_VALID, "error", error=v)),
    )


def json_conformance(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Conformance of ``output`` to shared rules, kept as rows instead of a schema.

    ``rules``: ``schema_id, path, type, required, enum ARRAY<STRING>`` where path
    is a top-level field name or empty for the value itself.  The rules of one
    schema travel as one array, so every output row is joined once.
    """
    packed = rules.groupBy("schema_id").agg(
        F.collect_list(F.struct("path", "type", "required", "enum")).alias("_rules")
    )
    value = parse_strict("output")
    fields = F.try_variant_get(value, "$", "map<string,variant>")

    def holds(rule: Column) -> Column:
        own = rule["path"] == ""
        found = F.when(own, value).otherwise(F.try_element_at(fields, rule["path"]))
        kind = _variant_kind(found)
        type_ok = rule["type"].isNull() | (kind == rule["type"]) | (
            (rule["type"] == "number") & (kind == "integer")
        )
        enum_ok = rule["enum"].isNull() | F.array_contains(rule["enum"], F.to_json(found))
        return F.when(found.isNull(), ~rule["required"]).otherwise(type_ok & enum_ok)

    joined = df.join(packed, "schema_id", "left")
    verdict = (
        F.when(F.col("_rules").isNull(), F.lit("no_schema"))
        .when(F.forall("_rules", lambda r: F.coalesce(holds(r), F.lit(False))), "valid")
        .otherwise("schema_mismatch")
    )
    return joined.withColumn("verdict", verdict).drop("_rules")


EXACT_MATCH_SCORER = Scorer("exact_match", (EXACT_MATCH,), _exact_match)
NORMALIZED_MATCH_SCORER = Scorer("normalized_match", (NORMALIZED_MATCH,), _normalized_match)
JSON_SCHEMA_SCORER = Scorer("json_schema", (JSON_VALID,), _json_schema)
NUMERIC_SCORER = Scorer("numeric_tolerance", (NUMERIC,), _numeric_tolerance)
REFUSAL_SCORER = Scorer("refusal", (REFUSAL,), _refusal)
LATENCY_SCORER = Scorer("latency", (LATENCY,), _latency)
USAGE_SCORER = Scorer("usage", (INPUT_UNITS, OUTPUT_UNITS, TOTAL_UNITS), _usage)

BUILT_IN = {
    s.name: s
    for s in (
        EXACT_MATCH_SCORER, NORMALIZED_MATCH_SCORER, JSON_SCHEMA_SCORER,
        NUMERIC_SCORER, REFUSAL_SCORER, LATENCY_SCORER, USAGE_SCORER,
    )
}


def scorer_set(scorers: Sequence[Scorer | str]) -> list[Scorer]:
    """Resolve names and require a non-empty set with globally unique metrics."""
    chosen = [BUILT_IN[s] if isinstance(s, str) else s for s in scorers]
    if not chosen:
        raise ValueError("at least one scorer is required")
    if len({s.name for s in chosen}) != len(chosen):
        raise ValueError("scorer names must be unique")
    metrics = [m for s in chosen for m in s.metrics]
    if not all(s.metrics for s in chosen) or len(set(metrics)) != len(metrics):
        raise ValueError("metric names must be present and globally unique")
    return chosen


def _checked(scorer: Scorer) -> Column:
    """Output of a scorer, or one error per declared metric if it breaks its contract."""
    found = scorer.expr().cast(f"array<{OBSERVATION_STRUCT}>")
    if scorer.name in BUILT_IN and BUILT_IN[scorer.name] is scorer:
        return found
    declared = F.array_sort(F.array(*[F.lit(m) for m in scorer.metrics]))
    valid = (F.array_sort(F.transform(found, lambda o: o["metric"])) == declared) & F.forall(
        found,
        lambda o: F.when(
            o["status"] == "scored",
            o["value"].isNotNull() & ~F.isnan(o["value"]) & (F.abs(o["value"]) < float("inf")),
        ).otherwise(o["value"].isNull() & o["status"].isin("skipped", "error")),
    )
    broken = F.array(
        *[
            observation(scorer.name, m, "error", error="invalid_evaluator_output")
            for m in scorer.metrics
        ]
    )
    return F.when(F.coalesce(valid, F.lit(False)), found).otherwise(broken)


def score(
    attached: DataFrame,
    scorers: Sequence[Scorer | str],
    keep: Sequence[str] = ("run_id", "case_id", "slices"),
    failed_as_errors: bool = True,
) -> DataFrame:
    """Observations of every scorer on every attached row, long form.

    A failed response becomes one error per metric (or no row at all with
    ``failed_as_errors=False``), so failures stay in every denominator.
    """
    chosen = scorer_set(scorers)
    found = F.concat(*[_checked(s) for s in chosen])
    failed = F.array(
        *[
            observation(s.name, m, "error", error=F.col("failure_code"))
            for s in chosen
            for m in s.metrics
        ]
    )
    rows = attached if failed_as_errors else attached.filter(F.col("failure_code").isNull())
    observed = (
        F.when(F.col("failure_code").isNotNull(), failed).otherwise(found)
        if failed_as_errors
        else found
    )
    return rows.select(*keep, F.inline(observed))


@dataclass(frozen=True)
class PandasScorer:
    """A custom scorer over Arrow batches.

    ``fn`` receives a pandas frame of the ``columns`` and returns one value per
    row and metric (NaN or None means skipped).  An exception turns the rows of
    the smallest failing unit (a single row) into errors; the job goes on.
    """

    name: str
    metrics: tuple[str, ...]
    columns: tuple[str, ...]
    fn: Callable[[pd.DataFrame], pd.DataFrame]

    def _batch(self, frame: pd.DataFrame) -> tuple[pd.DataFrame | None, str | None]:
        try:
            values = self.fn(frame[list(self.columns)].reset_index(drop=True))
        except Exception:
            return None, "evaluator_exception"
        if list(values.columns) != list(self.metrics) or len(values) != len(frame):
            return None, "invalid_evaluator_output"
        return values, None

    def _parts(self, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Halve a failing batch until the rows that fail stand alone."""
        values, error = self._batch(frame)
        if error != "evaluator_exception" or len(frame) <= 1:
            yield self._long(frame, values, error)
            return
        middle = len(frame) // 2
        yield from self._parts(frame.iloc[:middle])
        yield from self._parts(frame.iloc[middle:])

    def _long(self, frame: pd.DataFrame, values, error) -> pd.DataFrame:
        parts = []
        for metric in self.metrics:
            column = None if values is None else pd.to_numeric(values[metric], errors="coerce")
            part = frame[["run_id", "case_id"]].copy()
            part["evaluator"], part["metric"] = self.name, metric
            if column is None:
                part["status"], part["value"] = "error", None
                part["reason_code"], part["error_code"] = None, error
            else:
                column = column.set_axis(part.index)
                known = column.notna()
                part["status"] = known.map({True: "scored", False: "skipped"})
                part["value"] = column.astype("float64")
                part["reason_code"] = known.map({True: "observed", False: "no_value"})
                part["error_code"] = None
            parts.append(part)
        return pd.concat(parts, ignore_index=True)

    def run(self, attached: DataFrame) -> DataFrame:
        wanted = dict.fromkeys(("run_id", "case_id", *self.columns))
        rows = attached.filter(F.col("failure_code").isNull()).select(*wanted)

        def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    yield from self._parts(frame)

        return rows.mapInPandas(batches, OBSERVATIONS)

"""Order-independent content fingerprints as plain aggregates.

A row is hashed with SHA-256 and cut into sixteen 16-bit lanes.  The lanes of all
rows are added, so the sums depend on the multiset of rows only: no sort, no
shuffle of rows, no list, and partial sums combine in any order.  Duplicates count
because addition does not cancel.  A table's digest is the SHA-256 of its row
count and lane sums; sums stay within 64 bits up to 10^14 rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 16


def row_text(columns: Sequence[str]) -> Column:
    """Unambiguous text of a row; NULL differs from every value."""
    parts = ", ".join(
        f"coalesce(concat(length(cast(`{c}` as string)), ':', cast(`{c}` as string)), '-')" for c in columns
    )
    return F.expr(f"concat_ws('|', {parts})")


def fingerprint(df: DataFrame, keys: Sequence[str], text: Column) -> DataFrame:
    """(keys, rows, fingerprint) of the multiset of ``text`` values per key."""
    hashed = df.select(*keys, F.sha2(text, 256).alias("_hash"))
    lanes = range(LANES)
    sums = hashed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            F.expr(f"sum(cast(conv(substring(_hash, {4 * i + 1}, 4), 16, 10) as bigint)) as _s{i}")
            for i in lanes
        ],
    )
    named = ", ".join(f"cast(coalesce(_s{i}, 0) as string)" for i in lanes)
    folded = F.expr(f"concat_ws(',', cast(rows as string), {named})")
    return sums.select(
        *keys, "rows", F.concat(F.lit("sha256:"), F.sha2(folded, 256)).alias("fingerprint")
    )


def table_fingerprint(
    df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    return fingerprint(df, keys, row_text(list(columns or [c for c in df.columns if c not in keys])))


CASE_CONTENT = (
    "case_id", "input", "expected", "expected_refusal", "expected_schema", "numeric_tolerance",
)


def dataset_digest(cases: DataFrame) -> DataFrame:
    """Digest per dataset over every case field, but not its name, revision or order."""
    slices = F.array_join(F.array_sort("slices"), ",")
    flat = cases.withColumn("_slices", slices)
    return fingerprint(
        flat, ("dataset_name", "dataset_revision"), row_text([*CASE_CONTENT, "_slices"])
    ).withColumnRenamed("rows", "cases")


def run_digest(runs: DataFrame, observations: DataFrame) -> DataFrame:
    """Digest per run over pins, mode and evidence; the run id itself is excluded."""
    body = fingerprint(
        observations,
        ("run_id",),
        row_text(["case_id", "evaluator", "metric", "status", "value", "reason_code", "error_code"]),
    )
    header = row_text(["suite", "dataset", "target", "execution_mode"])
    joined = runs.select("run_id", header.alias("_header")).join(body, "run_id")
    digest = F.sha2(F.concat_ws("#", "_header", "fingerprint"), 256)
    return joined.select("run_id", F.concat(F.lit("sha256:"), digest).alias("result_digest"))


def suite_digest(suites: DataFrame, suite_metrics: DataFrame, suite_gates: DataFrame) -> DataFrame:
    """Digest per suite over its dataset, metrics, gates and mode; not its name."""
    metrics = fingerprint(suite_metrics, ("suite",), row_text(["evaluator", "metric"])).select(
        "suite", F.col("fingerprint").alias("_m")
    )
    gates = fingerprint(
        suite_gates, ("suite",), row_text(["metric", "slice", "direction", "threshold", "allowed_regression"])
    ).select("suite", F.col("fingerprint").alias("_g"))
    joined = suites.join(metrics, "suite").join(gates, "suite")
    text = F.concat_ws("#", row_text(["dataset", "execution_mode"]), "_m", "_g")
    return joined.select("suite", F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("suite_digest"))


def decision_digest(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Digest per pair over gate outcomes and case changes."""
    gate_text = row_text(["position", "metric", "slice", "status", "threshold", "allowed_regression"])
    case_text = row_text(["position", "case_id", "change", "baseline_value", "candidate_value"])
    rows = results.select("pair_id", F.concat(F.lit("gate|"), gate_text).alias("_t")).unionByName(
        cases.select("pair_id", F.concat(F.lit("case|"), case_text).alias("_t"))
    )
    return fingerprint(rows, ("pair_id",), F.col("_t")).select(
        "pair_id", F.col("fingerprint").alias("decision_digest")
    )


def changed_content(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose fingerprint differs, appeared or vanished between two readings."""
    b = before.select(*keys, F.col("fingerprint").alias("before"))
    a = after.select(*keys, F.col("fingerprint").alias("after"))
    joined = b.join(a, list(keys), "full")
    return joined.filter(~F.col("before").eqNullSafe(F.col("after")))

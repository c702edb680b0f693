"""Run and decision history: attempts, newest first, trends and list views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.operators.ordered import HOT_ROWS, keyset_page, ranked, with_previous


def latest_attempt(attempts: DataFrame) -> DataFrame:
    """The last attempt of each job as a combinable aggregate (no window)."""
    facts = [c for c in attempts.columns if c != "job_id"]
    return (
        attempts.groupBy("job_id")
        .agg(F.max(F.struct("attempt_number", *[c for c in facts if c != "attempt_number"])).alias("_last"))
        .select("job_id", *[F.col(f"_last.{c}").alias(c) for c in facts])
    )


def attempt_gaps(attempts: DataFrame) -> DataFrame:
    """Jobs whose attempt numbers are not exactly 1..n, with what is wrong."""
    numbers = attempts.groupBy("job_id", "attempt_number").agg(F.count(F.lit(1)).alias("_n"))
    shape = numbers.groupBy("job_id").agg(
        F.sum("_n").alias("attempts"),
        F.count(F.lit(1)).alias("distinct_numbers"),
        F.min("attempt_number").alias("least"),
        F.max("attempt_number").alias("most"),
    )
    return shape.select(
        "*",
        (F.col("least") != 1).alias("starts_late"),
        (F.col("most") - F.col("least") + 1 != F.col("distinct_numbers")).alias("has_gap"),
        (F.col("attempts") != F.col("distinct_numbers")).alias("has_repeat"),
    ).filter("starts_late OR has_gap OR has_repeat")


def newest_first(
    history: DataFrame, suite: str = "suite", created: str = "created_at", key: str = "run_id", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``position`` within the exact suite, newest (created_at, id) first."""
    order = [F.col(created).desc(), F.col(key).desc()]
    lead = F.col(created).cast("timestamp")
    return ranked(history, [suite], lead, order, "position", descending=True, hot_rows=hot_rows)


def run_trend(
    summary: DataFrame, runs: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Mean of each run next to the previous run of the same suite and target."""
    rows = summary.select("run_id", "metric", "mean").join(
        runs.select("run_id", "suite", "target", "created_at"), "run_id"
    )
    stepped = with_previous(
        rows,
        ["suite", "target", "metric"],
        F.col("created_at").cast("timestamp"),
        ["created_at", "run_id"],
        ["run_id", "mean"],
        hot_rows=hot_rows,
    )
    return stepped.select(
        "suite", "target", "metric", "run_id", "mean",
        F.col("_prev_run_id").alias("previous_run_id"),
        (F.col("mean") - F.col("_prev_mean")).alias("change"),
    )


# View -> (metadata columns, page order, allowed exact-match filters).
LIST_VIEWS: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "datasets": (("name", "revision", "digest", "case_count", "created_at"), ("name", "revision"), ("name",)),
    "suites": (("name", "revision", "digest", "created_at"), ("name", "revision"), ("name",)),
    "jobs": (("job_id", "kind", "status", "created_at"), ("created_at", "job_id"), ("kind", "status")),
    "runs": (
        ("run_id", "suite", "dataset", "target", "status", "created_at"),
        ("created_at", "run_id"),
        ("dataset", "suite", "target"),
    ),
    "decisions": (
        ("decision_id", "suite", "status", "baseline_target", "candidate_target", "created_at"),
        ("created_at", "decision_id"),
        ("status", "suite", "baseline_target", "candidate_target"),
    ),
    "targets": (("suite", "name", "revision"), ("name", "revision"), ("suite",)),
    "target_pairs": (("suite", "baseline_target", "candidate_target"), ("baseline_target", "candidate_target"), ("suite",)),
}


def list_view(
    df: DataFrame,
    view: str,
    filters: Mapping[str, str] | None = None,
    after: Sequence | None = None,
    limit: int = 50,
) -> DataFrame:
    """One page of metadata; histories are newest first, catalogues by name.

    Only metadata columns are selected, so stored documents are never read.
    """
    if not 1 <= limit <= 100:
        raise ValueError("a page holds 1 to 100 rows")
    columns, order, allowed = LIST_VIEWS[view]
    rows = df
    for name, value in (filters or {}).items():
        if name not in allowed:
            raise ValueError(f"{view} cannot be filtered by {name}")
        rows = rows.filter(F.col(name) == value)
    return keyset_page(rows.select(*columns), order, after, limit, descending="created_at" in order)

"""Coverage-aware aggregation: attempted = scored + skipped + errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions import decimal_diff, exact_sums, exact_total, merged_sums


def _partials() -> list[Column]:
    scored = F.when(F.col("status") == "scored", F.col("value"))
    return [
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(F.col("status") == "scored").alias("scored"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "error").alias("errors"),
        exact_sums(scored).alias("_sums"),
    ]


def _merged() -> list[Column]:
    counts = ("attempted", "scored", "skipped", "errors")
    return [F.sum(c).alias(c) for c in counts] + [merged_sums("_sums").alias("_sums")]


def _mean() -> Column:
    return F.when(F.col("scored") > 0, exact_total("_sums") / F.col("scored")).alias("mean")


def metric_summary(observations: DataFrame) -> DataFrame:
    """Counts and order-independent mean per run and metric."""
    return (
        observations.groupBy("run_id", "metric")
        .agg(*_partials())
        .select("run_id", "metric", "attempted", "scored", "skipped", "errors", _mean())
    )


def _with_slices(observations: DataFrame, cases: DataFrame, runs: DataFrame | None) -> DataFrame:
    """Observations with the slices of their case in the dataset of their run."""
    from gaugework.session import join_small

    dataset = [c for c in ("dataset_name", "dataset_revision") if c in cases.columns]
    absent = [c for c in dataset if c not in observations.columns]
    rows = observations
    if absent:
        if runs is None:
            raise ValueError("case ids belong to datasets: give the runs with their datasets")
        named = runs.select(F.col("run_id").alias("_run"), *absent).distinct()
        rows = join_small(rows, named, lambda o, r: o["run_id"] == r["_run"], salt_on="case_id").drop("_run")
    return rows.join(cases.select(*dataset, "case_id", "slices"), [*dataset, "case_id"])


def slice_partials(
    observations: DataFrame, cases: DataFrame | None = None, runs: DataFrame | None = None
) -> DataFrame:
    """Counts and mergeable sums per run, metric and slice (see ``slice_summary``)."""
    rows = observations
    if "slices" not in rows.columns:
        rows = _with_slices(rows, cases, runs)
    by_set = rows.groupBy(
        "run_id", "metric", F.array_distinct("slices").alias("slices")
    ).agg(*_partials())
    scopes = F.concat(F.array(F.lit(None).cast("string")), F.coalesce("slices", F.array().cast("array<string>")))
    exploded = by_set.withColumn("slice", F.explode(scopes)).drop("slices")
    return merged_partials(exploded)


def merged_partials(partials: DataFrame) -> DataFrame:
    return partials.groupBy("run_id", "metric", "slice").agg(*_merged())


def with_means(partials: DataFrame) -> DataFrame:
    return partials.select("run_id", "metric", "slice", "attempted", "scored", "skipped", "errors", _mean())


def slice_summary(
    observations: DataFrame, cases: DataFrame | None = None, runs: DataFrame | None = None
) -> DataFrame:
    """Counts and mean per run, metric and slice; NULL slice means all cases.

    Rows are first combined per whole set of slices (few distinct sets, combined
    before the shuffle); only those partial results are exploded by slice.

    Observations without ``slices`` take them from ``cases``.  Datasets may share case
    ids: where cases carry a dataset, observations need its columns, or ``runs``
    (``run_id, dataset_name, dataset_revision``) names them.
    """
    return with_means(slice_partials(observations, cases, runs))


_SIDE_FIELDS = ("attempted", "scored", "skipped", "errors", "mean")


def aggregate_comparison(summary: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both sides and the decimal delta per pair, metric and slice."""
    from gaugework.operators.joins import pair_sides
    from gaugework.session import join_small

    rows = join_small(
        summary, pair_sides(pairs), lambda s, p: s["run_id"] == p["_run"], salt_on="slice"
    )
    sides = [
        F.max(F.when(F.col("role") == role, F.col(field))).alias(f"{role}_{field}")
        for role in ("baseline", "candidate")
        for field in _SIDE_FIELDS
    ]
    joined = rows.groupBy("pair_id", "metric", "slice").agg(*sides)
    return joined.select(
        "*",
        decimal_diff("candidate_mean", "baseline_mean").alias("delta"),
        F.col("baseline_attempted").eqNullSafe(F.col("candidate_attempted")).alias("aligned"),
    )


def slice_inventory(cases: DataFrame) -> DataFrame:
    """Distinct slices per dataset with their case counts."""
    keys = [c for c in ("dataset_name", "dataset_revision") if c in cases.columns]
    sets = cases.groupBy(*keys, F.array_distinct("slices").alias("_set")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return (
        sets.select(*keys, F.explode("_set").alias("slice"), "_n")
        .groupBy(*keys, "slice")
        .agg(F.sum("_n").alias("cases"))
    )


def case_status_counts(case_results: DataFrame) -> DataFrame:
    return case_results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("attempted"),
        *[
            F.count_if(F.col("status") == s).alias(s)
            for s in ("completed", "completed_with_errors", "target_failed")
        ],
    )


def usage_totals(responses: DataFrame) -> DataFrame:
    """Input and output units per run over cases that have a response."""
    answered = F.col("failure_code").isNull()
    return responses.groupBy("run_id").agg(
        *[
            F.coalesce(
                F.sum(F.when(answered, F.col(c)).cast("decimal(38,0)")), F.lit(0)
            ).cast("bigint").alias(c)
            for c in ("input_units", "output_units")
        ]
    )


def operational_snapshot(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Queued and failed jobs, total units; zeros on empty tables.

    Two global aggregates laid over each other; nothing is joined.
    """
    zero = F.lit(0).cast("bigint")
    from_jobs = jobs.agg(
        F.count_if(F.col("status") == "queued").alias("queued_jobs"),
        F.count_if(F.col("status") == "failed").alias("failed_jobs"),
    ).select("queued_jobs", "failed_jobs", zero.alias("input_units"), zero.alias("output_units"))
    from_runs = runs.agg(
        *[F.coalesce(F.sum(c).cast("bigint"), zero).alias(c) for c in ("input_units", "output_units")]
    ).select(zero.alias("queued_jobs"), zero.alias("failed_jobs"), "input_units", "output_units")
    names = ("queued_jobs", "failed_jobs", "input_units", "output_units")
    return from_jobs.unionByName(from_runs).agg(*[F.sum(c).alias(c) for c in names])


def dataset_profile(
    cases: DataFrame, families: Sequence[str], expected: dict[str, int] | None = None
) -> DataFrame:
    """Balance of a dataset by slice family, next to the counts it should have."""
    counted = slice_inventory(cases)
    parts = F.split("slice", "/", 2)
    profile = counted.select(
        "dataset_name",
        F.element_at(parts, 1).alias("family"),
        F.try_element_at(parts, F.lit(2)).alias("member"),
        "cases",
        "slice",
    ).filter(F.col("family").isin(*families))
    if not expected:
        return profile.drop("slice")
    wanted = F.create_map(*[F.lit(x) for pair in expected.items() for x in pair])
    number = F.try_element_at(wanted, F.col("slice")).cast("bigint")
    return profile.select(
        "dataset_name", "family", "member", "cases",
        number.alias("expected_cases"),
        F.coalesce(F.col("cases") == number, F.lit(True)).alias("as_expected"),
    )


def failure_breakdown(responses: DataFrame) -> DataFrame:
    """Failed responses per run, code and retryability; unknown codes are named so."""
    from gaugework.schemas import TARGET_FAILURE_CODES

    code = F.col("failure_code")
    return (
        responses.filter(code.isNotNull())
        .groupBy(
            "run_id",
            F.lit("target").alias("stage"),
            F.when(code.isin(*TARGET_FAILURE_CODES), code).otherwise(F.lit("unknown")).alias("code"),
            F.coalesce("retryable", F.lit(False)).alias("retryable"),
        )
        .agg(F.count(F.lit(1)).alias("cases"))
    )

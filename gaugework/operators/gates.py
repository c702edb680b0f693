"""Release gates: coverage, threshold and regression, per aggregate and per case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions import at_least, at_most, decimal_diff, metric_label, slice_family
from gaugework.session import join_small

CHANGES = (
    "newly_passing",
    "newly_failing",
    "unchanged_passing",
    "unchanged_failing",
    "incomparable",
)


def _passes(value: Column, bound: Column) -> Column:
    higher = F.col("direction") == "higher_is_better"
    return F.when(higher, at_least(value, bound)).otherwise(at_most(value, bound))


def expected_gates(pairs: DataFrame, gates: DataFrame) -> DataFrame:
    """Every pair with every gate of its policy; both tables carry ``policy``."""
    wanted = gates.select(
        F.col("policy").alias("_policy"), "position", "metric", "slice", "direction", "threshold",
        F.coalesce("allowed_regression", F.lit(0.0)).alias("allowed_regression"),
    )
    return join_small(
        pairs.select("pair_id", "policy"), wanted, lambda p, g: p["policy"] == g["_policy"], salt_on="pair_id"
    ).drop("_policy")


def gate_results(comparison: DataFrame, gates: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every gate of a pair's policy, with all failed checks listed in fixed order.

    A policy belongs to the pairs that name it in ``policy``.  A gate without evidence - an absent metric or an empty slice - has a row and
    fails, and so does one whose sides cover different cases.
    """
    keys = {"pair_id": "_pair", "metric": "_metric", "slice": "_slice"}
    joined = expected_gates(pairs, gates).join(
        comparison.withColumnsRenamed(keys),
        (F.col("pair_id") == F.col("_pair"))
        & (F.col("metric") == F.col("_metric"))
        & F.col("slice").eqNullSafe(F.col("_slice")),
        "left",
    ).drop(*keys.values())
    coverage = (
        (F.col("baseline_errors") == 0)
        & (F.col("candidate_errors") == 0)
        & (F.col("baseline_scored") > 0)
        & (F.col("baseline_scored") == F.col("candidate_scored"))
        & (F.col("baseline_skipped") == F.col("candidate_skipped"))
        & F.col("aligned")
    )
    threshold = _passes(F.col("candidate_mean"), F.col("threshold"))
    budget = F.col("allowed_regression")
    regression = F.when(
        F.col("direction") == "higher_is_better", at_least(F.col("delta"), -budget)
    ).otherwise(at_most(F.col("delta"), budget))
    checks = {"coverage": coverage, "threshold": threshold, "regression": regression}
    flagged = joined.select(
        "*",
        *[F.coalesce(c, F.lit(False)).alias(f"{n}_passed") for n, c in checks.items()],
    )
    codes = F.array_compact(
        F.array(*[F.when(~F.col(f"{n}_passed"), F.lit(n)) for n in checks])
    )
    return flagged.withColumn("failure_codes", codes).withColumn(
        "status", F.when(F.size("failure_codes") == 0, "passed").otherwise("failed")
    )


def gate_cases(paired: DataFrame, gates: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each case of each gate of the pair's policy with its two values and how it changed.

    ``paired`` carries ``slices``, so the gate scope is a membership equi-join on
    the exploded slices of the same row; no second pass over the cases.
    """
    scoped = paired.withColumn(
        "_scope",
        F.explode(
            F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("slices"))
        ),
    )
    keys = {"pair_id": "_pair", "metric": "_metric", "slice": "_slice"}
    joined = join_small(
        scoped,
        expected_gates(pairs, gates).drop("policy").withColumnsRenamed(keys),
        lambda p, g: (p["pair_id"] == g["_pair"])
        & (p["metric"] == g["_metric"])
        & p["_scope"].eqNullSafe(g["_slice"]),
        salt_on="case_id",
    )
    comparable = (F.col("baseline_status") == "scored") & (
        F.col("candidate_status") == "scored"
    )
    before = F.when(comparable, _passes(F.col("baseline_value"), F.col("threshold")))
    after = F.when(comparable, _passes(F.col("candidate_value"), F.col("threshold")))
    change = (
        F.when(~comparable, "incomparable")
        .when(before & ~after, "newly_failing")
        .when(~before & after, "newly_passing")
        .when(before, "unchanged_passing")
        .otherwise("unchanged_failing")
    )
    return joined.select(
        "pair_id", "position", "metric", F.col("_slice").alias("slice"), "case_id", "slices",
        "baseline_status", "baseline_value", "candidate_status", "candidate_value",
        F.when(comparable, decimal_diff("candidate_value", "baseline_value")).alias("delta"),
        before.alias("baseline_passed"),
        after.alias("candidate_passed"),
        change.alias("change"),
    )


def decisions(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per pair: it passes only if it has gates and every gate passed."""
    blank = pairs.select("pair_id", F.lit(None).cast("string").alias("status"))
    return results.select("pair_id", "status").unionByName(blank).groupBy("pair_id").agg(
        F.when(F.coalesce(F.bool_and(F.col("status") == "passed"), F.lit(False)), "passed")
        .otherwise("failed")
        .alias("status"),
        F.count("status").alias("gates"),
        F.count_if(F.col("status") == "failed").alias("failed_gates"),
    )


def change_counts(cases: DataFrame, results: DataFrame) -> DataFrame:
    """The five change classes per evaluated gate; gates without a case get zeros."""
    counted = cases.select("pair_id", "position", "change")
    blank = results.select(
        "pair_id", "position", F.lit(None).cast("string").alias("change")
    )
    return counted.unionByName(blank).groupBy("pair_id", "position").agg(
        *[F.count_if(F.col("change") == c).alias(c) for c in CHANGES]
    )


def newly_failing(cases: DataFrame) -> DataFrame:
    return cases.filter(F.col("change") == "newly_failing").select(
        "pair_id", "case_id", "metric", "slice"
    )


def case_review(
    cases: DataFrame,
    metric: str,
    gate_slice: str | None,
    case_slice: str | None = None,
    change: str | None = None,
) -> DataFrame:
    """Cases of one gate; ``gate_slice=None`` is the all-cases gate, not a wildcard."""
    chosen = cases.filter(
        (F.col("metric") == metric)
        & F.col("slice").eqNullSafe(F.lit(gate_slice).cast("string"))
    )
    if case_slice is not None:
        chosen = chosen.filter(F.array_contains("slices", case_slice))
    if change is not None:
        chosen = chosen.filter(F.col("change") == change)
    return chosen


def gate_triage(results: DataFrame) -> DataFrame:
    """Review order: failed gates first, then as written, with family and label."""
    rank = F.when(F.col("status") == "failed", 0).otherwise(1)
    return results.select(
        "pair_id",
        "position",
        "status",
        F.when(F.col("slice").isNull(), "all").otherwise(slice_family("slice")).alias("family"),
        metric_label("metric", "slice").alias("label"),
        rank.alias("triage_rank"),
    ).orderBy("pair_id", "triage_rank", "position")


def policy_name() -> Column:
    """The name of the policy of one suite for one pair of targets."""
    sides = [F.concat_ws("@", f"{side}_name", f"{side}_revision") for side in ("baseline", "candidate")]
    return F.concat_ws("|", "suite", *sides)


def compile_policy(suite_gates: DataFrame, target_pairs: DataFrame) -> DataFrame:
    """A suite's gates for concrete target pairs; a target is never its own baseline.

    ``policy`` names suite and targets; pairs of runs that carry the same name are judged by
    these gates in ``gate_results``.
    """
    distinct = target_pairs.filter(
        ~(
            (F.col("baseline_name") == F.col("candidate_name"))
            & (F.col("baseline_revision") == F.col("candidate_revision"))
        )
    )
    return join_small(
        distinct,
        suite_gates.withColumnRenamed("suite", "_suite"),
        lambda p, g: p["suite"] == g["_suite"],
        salt_on="candidate_name",
    ).drop("_suite").withColumn("policy", policy_name())

"""Bringing cases, responses, runs, pairs and gates together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.session import join_small

RESPONSE_FIELDS = (
    "output", "outcome", "refusal_code", "input_units", "output_units",
    "latency_ms", "failure_code", "retryable",
)


def attach_responses(cases: DataFrame, responses: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per case and run of its dataset; an absent response is a rejection.

    ``runs``: ``run_id, dataset_name, dataset_revision`` (equi-join, no product).
    """
    expected = join_small(
        cases,
        runs.select(
            "run_id",
            F.col("dataset_name").alias("_name"),
            F.col("dataset_revision").alias("_revision"),
        ),
        lambda c, r: (c["dataset_name"] == r["_name"])
        & (c["dataset_revision"] == r["_revision"]),
        salt_on="case_id",
    ).drop("_name", "_revision")
    answered = responses.select(
        "run_id", "case_id", *RESPONSE_FIELDS, F.lit(True).alias("_answered")
    )
    joined = expected.join(answered, ["run_id", "case_id"], "left")
    absent = F.col("_answered").isNull()
    return (
        joined.withColumn(
            "failure_code",
            F.when(absent, F.lit("target_rejected")).otherwise(F.col("failure_code")),
        )
        .withColumn(
            "retryable", F.when(absent, F.lit(False)).otherwise(F.col("retryable"))
        )
        .drop("_answered")
    )


def overlay(responses: DataFrame, overrides: DataFrame) -> DataFrame:
    """Responses with the overridden cases replaced; unknown ids change nothing."""
    fields = [c for c in responses.columns if c != "case_id"]
    marked = overrides.select("case_id", *fields, F.lit(True).alias("_override"))
    base, over = responses.alias("b"), marked.alias("o")
    joined = base.join(over, "case_id", "left")
    chosen = [
        F.when(F.col("o._override"), F.col(f"o.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
        for c in fields
    ]
    return joined.select("case_id", *chosen).select(*responses.columns)


def overlay_violations(
    cases: DataFrame, responses: DataFrame, overrides: DataFrame
) -> DataFrame:
    """Case ids that break the manifest: unknown overrides, missing or extra bases."""
    ids = (
        cases.select("case_id", F.lit(1).alias("c"), F.lit(0).alias("r"), F.lit(0).alias("o"))
        .unionByName(
            responses.select("case_id", F.lit(0).alias("c"), F.lit(1).alias("r"), F.lit(0).alias("o"))
        )
        .unionByName(
            overrides.select("case_id", F.lit(0).alias("c"), F.lit(0).alias("r"), F.lit(1).alias("o"))
        )
    )
    seen = ids.groupBy("case_id").agg(F.max("c").alias("c"), F.max("r").alias("r"), F.max("o").alias("o"))
    code = F.array_compact(
        F.array(
            F.when((F.col("o") == 1) & (F.col("r") == 0), "unknown_override"),
            F.when((F.col("c") == 1) & (F.col("r") == 0), "missing_response"),
            F.when((F.col("c") == 0) & (F.col("r") == 1), "unexpected_response"),
        )
    )
    return seen.select("case_id", F.explode(code).alias("code"))


def pair_sides(pairs: DataFrame) -> DataFrame:
    """Pairs as one row per run and role."""
    return pairs.select(
        "pair_id",
        F.inline(
            F.array(
                F.struct(F.col("baseline_run").alias("_run"), F.lit("baseline").alias("role")),
                F.struct(F.col("candidate_run").alias("_run"), F.lit("candidate").alias("role")),
            )
        ),
    )


_STATUS = ("error", "skipped", "scored")


def pair_runs(observations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both sides of every (pair, case, metric), in one shuffle.

    A side without an observation, or with several, is an error.  ``slices`` belong to the
    case: the sides' labels are put together, so differing labels never split a pair.
    """
    rows = join_small(
        observations,
        pair_sides(pairs),
        lambda o, p: o["run_id"] == p["_run"],
        salt_on="case_id",
    )
    rank = F.array_position(F.array(*[F.lit(s) for s in _STATUS]), F.col("status"))
    keys = ["pair_id", "case_id", "metric"]
    own = ["slices"] if "slices" in rows.columns else []
    labels = [F.array_sort(F.array_distinct(F.flatten(F.collect_set("slices")))).alias(c) for c in own]
    once = F.count_if(F.col("role") == "baseline"), F.count_if(F.col("role") == "candidate")
    sides = [
        F.max(F.when(F.col("role") == role, value)).alias(f"_{role}_{name}")
        for role in ("baseline", "candidate")
        for name, value in (("rank", rank), ("value", F.col("value")))
    ]
    paired = rows.groupBy(*keys).agg(
        *sides, *labels, *[c.alias(f"_{role}_n") for c, role in zip(once, ("baseline", "candidate"))]
    )

    def state(role: str):
        place = F.when(F.col(f"_{role}_n") == 1, F.col(f"_{role}_rank")).otherwise(F.lit(1)).cast("int")
        return F.element_at(F.array(*[F.lit(s) for s in _STATUS]), place).alias(f"{role}_status")

    return paired.select(
        *keys,
        *own,
        state("baseline"),
        F.when(F.col("_baseline_n") == 1, F.col("_baseline_value")).alias("baseline_value"),
        state("candidate"),
        F.when(F.col("_candidate_n") == 1, F.col("_candidate_value")).alias("candidate_value"),
    )


def gate_scope(cases: DataFrame, gates: DataFrame) -> DataFrame:
    """(gate, case) for every gate: no slice means all cases, else membership.

    A null-safe equi-join on the exploded slices.
    """
    scoped = cases.select(
        "case_id",
        F.explode(
            F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("slices"))
        ).alias("_scope"),
    )
    return join_small(
        scoped,
        gates.select("position", "metric", "slice"),
        lambda c, g: c["_scope"].eqNullSafe(g["slice"]),
        salt_on="case_id",
    ).select("position", "metric", "slice", "case_id")


def empty_scopes(cases: DataFrame, gates: DataFrame) -> DataFrame:
    """Gates whose slice holds no case at all."""
    present = (
        cases.select(F.array_distinct("slices").alias("s"))
        .distinct()
        .select(F.explode(F.concat(F.array(F.lit(None).cast("string")), "s")).alias("_present"))
        .distinct()
    )
    g, p = gates.alias("g"), present.alias("p")
    return g.join(p, F.col("g.slice").eqNullSafe(F.col("p._present")), "left_anti").select(
        "position", "metric", "slice", F.lit("empty_scope").alias("code")
    )


def suite_targets(runs: DataFrame) -> DataFrame:
    """Distinct targets seen by each suite."""
    return runs.filter(F.col("suite").isNotNull()).select(
        "suite", "target_name", "target_revision", "target_digest"
    ).distinct()


def decision_sides(decisions: DataFrame, runs: DataFrame) -> DataFrame:
    """Decisions with the run row of either side (both inner joins on run id)."""
    def side(prefix: str) -> DataFrame:
        return runs.select(
            F.col("run_id").alias(f"{prefix}_run"),
            *[F.col(c).alias(f"{prefix}_{c}") for c in runs.columns if c != "run_id"],
        )

    return decisions.join(side("baseline"), "baseline_run").join(
        side("candidate"), "candidate_run"
    )


def suite_target_pairs(decisions: DataFrame, runs: DataFrame) -> DataFrame:
    """Distinct directed target pairs whose decision and runs share one suite."""
    narrow = runs.select("run_id", "suite", "target_name", "target_revision", "target_digest")
    sided = decision_sides(decisions.select("suite", "baseline_run", "candidate_run"), narrow)
    same = (F.col("suite") == F.col("baseline_suite")) & (F.col("suite") == F.col("candidate_suite"))
    return sided.filter(same).select(
        "suite",
        "baseline_target_name", "baseline_target_revision", "baseline_target_digest",
        "candidate_target_name", "candidate_target_revision", "candidate_target_digest",
    ).distinct()


def decision_history(
    decisions: DataFrame,
    runs: DataFrame,
    suite: str,
    baseline_target: str | None = None,
    candidate_target: str | None = None,
) -> DataFrame:
    """Decision metadata of one suite, optionally of one exact target pair."""
    if (baseline_target is None) != (candidate_target is None):
        raise ValueError("give both targets or neither")
    narrow = runs.select("run_id", "suite", "target_name").filter(F.col("suite") == suite)
    chosen = decisions.filter(F.col("suite") == suite).select(
        "decision_id", "suite", "status", "created_at", "baseline_run", "candidate_run"
    )
    sided = decision_sides(chosen, narrow)
    if baseline_target is not None:
        sided = sided.filter(
            (F.col("baseline_target_name") == baseline_target)
            & (F.col("candidate_target_name") == candidate_target)
        )
    return sided.select(
        "decision_id", "suite", "status", "created_at", "baseline_run", "candidate_run",
        "baseline_target_name", "candidate_target_name",
    )


def gate_evidence(responses: DataFrame, gate_cases: DataFrame) -> DataFrame:
    """Responses of the cases a gate looks at (semi join, no duplicates)."""
    return responses.join(gate_cases.select("run_id", "case_id"), ["run_id", "case_id"], "left_semi")


def decision_run_mismatches(decisions: DataFrame, runs: DataFrame) -> DataFrame:
    """Decisions whose pinned digest, dataset, target or mode differ from the run."""
    facts = ("result_digest", "dataset", "target", "execution_mode")
    sides = decisions.select(
        "decision_id",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(role).alias("role"),
                        F.col(f"{role}_run").alias("run_id"),
                        F.col(f"{role}_result_digest").alias("_result_digest"),
                        F.col("dataset").alias("_dataset"),
                        F.col(f"{role}_target").alias("_target"),
                        F.col("execution_mode").alias("_execution_mode"),
                    )
                    for role in ("baseline", "candidate")
                ]
            )
        ),
    )
    joined = sides.join(
        runs.select("run_id", *facts, F.lit(True).alias("_found")), "run_id", "left"
    )
    codes = F.when(F.col("_found").isNull(), F.array(F.lit("run_missing"))).otherwise(
        F.array_compact(
            F.array(
                *[
                    F.when(~F.col(f"_{f}").eqNullSafe(F.col(f)), F.lit(f"{f}_mismatch"))
                    for f in facts
                ]
            )
        )
    )
    return joined.select("decision_id", "role", "run_id", F.explode(codes).alias("code"))


def job_attempt_history(jobs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Every job with its attempts, and whether the numbering is exactly 1..count."""
    counted = attempts.groupBy("job_id", "attempt_number").agg(F.count(F.lit(1)).alias("_n"))
    shape = counted.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("_distinct"),
        F.sum("_n").alias("_rows"),
        F.min("attempt_number").alias("_least"),
        F.max("attempt_number").alias("_most"),
    )
    base = jobs.select("job_id", "status", "attempt_count").join(shape, "job_id", "left")
    complete = F.when(F.col("_rows").isNull(), F.col("attempt_count") == 0).otherwise(
        (F.col("_rows") == F.col("attempt_count"))
        & (F.col("_distinct") == F.col("_rows"))
        & (F.col("_least") == 1)
        & (F.col("_most") == F.col("_rows"))
    )
    labelled = base.select(
        "job_id", F.col("status").alias("job_status"), "attempt_count", complete.alias("complete"),
        F.col("_rows").isNull().alias("_none"),
    )
    facts = attempts.select(
        "job_id", "attempt_number", F.col("status").alias("attempt_status"), "started_at"
    )
    # An inner join can be split on a job with very many attempts; an outer one not.
    tried = labelled.filter(~F.col("_none")).drop("_none").join(facts, "job_id")
    untried = labelled.filter("_none").select(
        "job_id", "job_status", "attempt_count", "complete",
        *[F.lit(None).cast(kind).alias(name) for name, kind in facts.dtypes if name != "job_id"],
    )
    return tried.unionByName(untried)

import math
import random

import pytest
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugework.operators import distributions as dist
from gaugework.operators import kept_quantiles as kept
from gaugework.operators.ordered import HOT_ROWS

CASES = (
    "pair_id STRING, position INT, metric STRING, slice STRING, case_id STRING, baseline_status STRING, "
    "baseline_value DOUBLE, candidate_status STRING, candidate_value DOUBLE, delta DOUBLE"
)
RESPONSES = (
    "run_id STRING, case_id STRING, latency_ms DOUBLE, input_units BIGINT, output_units BIGINT, failure_code STRING"
)


def four_cases(spark):
    def row(case, b, c, status="scored"):
        delta = None if b is None or c is None else c - b
        return ("p", 0, "m", None, case, status, b, status, c, delta)

    return spark.createDataFrame(
        [
            row("case-001", 1.0, 1.0),
            row("case-002", 1.0, 0.0),
            row("case-003", None, None, "skipped"),
            row("case-004", None, None, "error"),
        ],
        CASES,
    )


def test_score_and_delta_distribution(spark):
    found = {r.role: r for r in dist.score_distribution(four_cases(spark)).collect()}
    base, cand = found["baseline"], found["candidate"]
    assert (base.attempted, base.scored, base.skipped, base.errors) == (4, 2, 1, 1)
    assert (base.minimum, base.p50, base.p95, base.maximum, base.mean) == (1.0, 1.0, 1.0, 1.0, 1.0)
    assert (cand.minimum, cand.p50, cand.p95, cand.mean, cand.suppressed) == (0.0, 0.0, 1.0, 0.5, False)
    delta = dist.delta_distribution(four_cases(spark)).first()
    assert (delta.attempted, delta.compared, delta.incomparable) == (4, 2, 2)
    assert (delta.minimum, delta.p50, delta.p95, delta.mean) == (-1.0, -1.0, 0.0, -0.5)


def test_operational_distribution_is_suppressed_below_twenty(spark):
    data = [("base", f"case-00{i}", 5.0, 2, 1, None) for i in (1, 2, 3)] + [("base", "case-004", 9.0, None, None, "target_timeout")]
    pairs = spark.createDataFrame([("p", "base", "cand")], "pair_id STRING, baseline_run STRING, candidate_run STRING")
    found = dist.operational_distribution(spark.createDataFrame(data, RESPONSES), four_cases(spark), pairs)
    by = {(r.role, r.measure): r for r in found.collect()}
    latency, units = by["baseline", "latency_ms"], by["baseline", "total_units"]
    assert (latency.attempted, latency.measured, latency.unavailable, latency.target_failures) == (4, 4, 0, 1)
    assert (units.measured, units.unavailable) == (3, 1)
    assert latency.suppressed and latency.p50 is None and latency.sample_count == 4


def nearest(values, p):
    ordered = sorted(values)
    return ordered[max(0, math.ceil(p * len(ordered)) - 1)]


@pytest.mark.parametrize("hot_rows", [HOT_ROWS, 5])
def test_quantiles_match_nearest_rank(spark, hot_rows):
    data = [(n, float((i * 7919) % (n * 3) - n)) for n in range(1, 60) for i in range(n)]
    df = spark.createDataFrame(data, "k INT, v DOUBLE").repartition(5)
    found = dist.quantile_summary(df, ["k"], "v", suppress_below=20, hot_rows=hot_rows).collect()
    assert len(found) == 59
    for r in found:
        values = [v for k, v in data if k == r.k]
        assert r.sample_count == r.k and r.suppressed == (r.k < 20) and r.small_sample == (r.k < 20)
        if not r.suppressed:
            assert (r.p50, r.p95) == (nearest(values, 0.5), nearest(values, 0.95))
            assert (r.minimum, r.maximum) == (min(values), max(values))
            assert r.mean == pytest.approx(sum(values) / len(values), abs=1e-9)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.floats(-1e9, 1e9), min_size=1, max_size=200))
def test_ranges_do_not_change_the_result(spark, values):
    df = spark.createDataFrame([("a", v) for v in values], "k STRING, v DOUBLE")
    plain = dist.quantile_summary(df, ["k"], "v").first()
    cut = dist.quantile_summary(df, ["k"], "v", hot_rows=1).first()
    assert plain.asDict() == cut.asDict()


def test_empty_groups_have_no_statistics(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0)], "k STRING, v DOUBLE")
    for hot in (HOT_ROWS, 1):
        found = {r.k: r for r in dist.quantile_summary(df, ["k"], "v", suppress_below=20, hot_rows=hot).collect()}
        assert found["a"].sample_count == 0 and found["a"].p50 is None and found["a"].mean is None and not found["a"].suppressed
        assert found["b"].suppressed


def test_one_value_for_a_third_of_all_rows(spark):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") * 1.0).alias("v"), F.lit("hot").alias("k")
    )
    plain = rows(dist.quantile_summary(df, ["k"], "v"))
    assert rows(dist.quantile_summary(df, ["k"], "v", hot_rows=100)) == plain


def test_kept_distributions_merge_to_the_whole(spark):
    rng = random.Random(4)
    data = [(f"r{rng.randrange(5)}", rng.choice("ab"), rng.choice([None, rng.gauss(0, 5)])) for _ in range(600)] + [("r9", "z", None)]
    df = spark.createDataFrame(data, "run STRING, slice STRING, v DOUBLE")
    stored = kept.kept_distribution(df, ["run", "slice"], "v")
    for keys, limit in ((["run", "slice"], 20), (["slice"], None), (["run"], 100)):
        merged = kept.merged_distribution(kept.merged_distribution(stored, ["run", "slice"]), keys)
        exact = dist.quantile_summary(df, keys, "v", suppress_below=limit)
        fields = (*keys, "sample_count", "minimum", "p50", "p95", "maximum", "suppressed", "small_sample")
        assert rows(kept.read_distribution(merged, keys, limit), *fields) == rows(exact, *fields)
        means = [[r[-1] for r in rows(x, *keys, "mean")] for x in (kept.read_distribution(merged, keys, limit), exact)]
        assert [m is None for m in means[0]] == [m is None for m in means[1]]
        assert [m for m in means[0] if m is not None] == pytest.approx([m for m in means[1] if m is not None])


def test_kept_quantiles_stay_within_their_error(spark):
    df = spark.range(200_000).selectExpr("id % 40 AS run", "CAST(id * 7919 % 200000 AS DOUBLE) AS v")
    stored = kept.kept_distribution(df, ["run"], "v", size=200)
    row = kept.read_distribution(kept.merged_distribution(stored, []), []).first()
    bound = 2 * kept.rank_error(200) * 200_000  # 99 % confidence, and a margin for the rest
    assert row["sample_count"] == 200_000 and (row["minimum"], row["maximum"]) == (0.0, 199_999.0)
    assert abs(row["p50"] - 99_999) <= bound and abs(row["p95"] - 189_999) <= bound
    assert kept.rank_error(4096) < 0.0014

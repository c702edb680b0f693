"""Nearest-rank distributions of scores, deltas and operational measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gaugework.functions import exact_sums, exact_total, merged_sums
from gaugework.operators.ordered import (
    HOT_ROWS,
    join_ranges,
    range_offsets,
    split_hot_groups,
)

OPERATIONAL_MINIMUM = 20
_STATISTICS = ("minimum", "p50", "p95", "maximum", "mean")


def quantile_summary(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str,
    suppress_below: int | None = None,
    approx: bool = False,
    counts: Mapping[str, Column] | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """sample_count, minimum, p50, p95, maximum, mean per group.

    Exact form: equal values collapse into one counted row (combined before the
    shuffle), groups with very many distinct values are cut into value ranges, and
    the value at rank ceil(p * n) is read off running counts.  No group is ever
    held in memory.  ``approx=True`` reads the values off a mergeable sketch.
    ``counts`` adds conditional row counts computed in the same pass.
    """
    measured = (F.col(value) if isinstance(value, str) else value).cast("double")
    extra = dict(counts or {})
    partial = [
        F.count_if(c).alias(name) if c is not None else F.count(F.lit(1)).alias(name)
        for name, c in extra.items()
    ]
    rows = df.withColumn("_value", measured)
    if approx:
        points = F.percentile_approx("_value", [0.5, 0.95], 10_000)
        ranks = [F.element_at(points, i) for i in (1, 2)]
        summary = rows.groupBy(*keys).agg(
            *partial,
            F.count("_value").alias("sample_count"),
            F.min("_value").alias("minimum"),
            ranks[0].alias("p50"),
            ranks[1].alias("p95"),
            F.max("_value").alias("maximum"),
            exact_sums("_value").alias("_sums"),
        )
    else:
        valued = rows.groupBy(*keys, "_value").agg(
            *partial,
            F.count("_value").alias("_n"),
            exact_sums("_value").alias("_sums"),
        )
        ranged = split_hot_groups(valued, keys, F.col("_value"), hot_rows)
        offsets = range_offsets(ranged, keys, F.col("_n"))
        running = W.partitionBy(*keys, "_range").orderBy("_value")
        placed = join_ranges(ranged, offsets, keys).withColumn(
            "_upto", F.col("_before") + F.sum("_n").over(running)
        )

        def at_rank(p: float) -> Column:
            reached = F.col("_upto") >= F.ceil(F.lit(p) * F.col("_total"))
            return F.min(F.when(reached, F.col("_value")))

        summary = placed.groupBy(*keys).agg(
            *[F.sum(name).alias(name) for name in extra],
            F.sum("_n").alias("sample_count"),
            F.min("_value").alias("minimum"),
            at_rank(0.5).alias("p50"),
            at_rank(0.95).alias("p95"),
            F.max("_value").alias("maximum"),
            merged_sums("_sums").alias("_sums"),
        )
    size = F.col("sample_count")
    summary = summary.withColumn("mean", F.when(size > 0, exact_total("_sums") / size))
    suppressed = F.lit(False) if suppress_below is None else (size > 0) & (size < suppress_below)
    return summary.select(
        *keys,
        *extra,
        "sample_count",
        *[F.when(~suppressed, F.col(c)).alias(c) for c in _STATISTICS],
        suppressed.alias("suppressed"),
        (size < OPERATIONAL_MINIMUM).alias("small_sample"),
    )


GATE_KEYS = ("pair_id", "position", "metric", "slice")


def score_distribution(gate_cases: DataFrame) -> DataFrame:
    """Scores per gate and side with their coverage; never suppressed."""
    sides = gate_cases.select(
        *GATE_KEYS,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(role).alias("role"),
                        F.col(f"{role}_status").alias("_status"),
                        F.col(f"{role}_value").alias("_score"),
                    )
                    for role in ("baseline", "candidate")
                ]
            )
        ),
    )
    status = F.col("_status")
    return quantile_summary(
        sides,
        (*GATE_KEYS, "role"),
        F.when(status == "scored", F.col("_score")),
        counts={
            "attempted": None,
            "scored": status == "scored",
            "skipped": status == "skipped",
            "errors": status == "error",
        },
    )


def delta_distribution(gate_cases: DataFrame) -> DataFrame:
    """Case deltas per gate; compared + incomparable = attempted."""
    return quantile_summary(
        gate_cases.select(*GATE_KEYS, "delta"),
        GATE_KEYS,
        "delta",
        counts={
            "attempted": None,
            "compared": F.col("delta").isNotNull(),
            "incomparable": F.col("delta").isNull(),
        },
    )


def operational_distribution(
    responses: DataFrame, gate_cases: DataFrame, pairs: DataFrame
) -> DataFrame:
    """Latency and units per gate and role, hidden below twenty samples.

    A failed target has no usage; its latency counts if it was recorded.
    """
    from gaugework.operators.joins import pair_sides
    from gaugework.session import join_small

    scoped = gate_cases.select(*GATE_KEYS, "case_id")
    per_run = join_small(
        scoped,
        pair_sides(pairs).withColumnRenamed("pair_id", "_pair"),
        lambda c, p: c["pair_id"] == p["_pair"],
        salt_on="case_id",
    ).select(*GATE_KEYS, "case_id", "role", F.col("_run").alias("run_id"))
    wanted = responses.select(
        "run_id", "case_id", "latency_ms", "input_units", "output_units", "failure_code"
    )
    joined = per_run.join(wanted, ["run_id", "case_id"], "left")
    usable = F.col("failure_code").isNull()
    used = F.when(usable, F.col("input_units")).cast("double")
    made = F.when(usable, F.col("output_units")).cast("double")
    measures = (
        ("latency_ms", F.col("latency_ms")),
        ("input_units", used),
        ("output_units", made),
        ("total_units", used + made),
    )
    long = joined.select(
        *GATE_KEYS,
        "role",
        "failure_code",
        F.inline(
            F.array(
                *[F.struct(F.lit(n).alias("measure"), v.alias("_sample")) for n, v in measures]
            )
        ),
    )
    return quantile_summary(
        long,
        (*GATE_KEYS, "role", "measure"),
        "_sample",
        suppress_below=OPERATIONAL_MINIMUM,
        counts={
            "attempted": None,
            "measured": F.col("_sample").isNotNull(),
            "unavailable": F.col("_sample").isNull(),
            "target_failures": F.col("failure_code").isNotNull(),
        },
    )

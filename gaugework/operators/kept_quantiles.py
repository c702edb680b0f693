"""Distributions that are kept per run and merged later, without the cases they came from.

A kept row holds counts, extremes, mergeable sums and a KLL sketch of one group.  Kept rows of any groups merge into
the row that their values together would have made, so history over runs and slices reads kept rows only.  Counts,
extremes and means are exact.  Quantiles are those of ``quantile_summary`` while a merged row has fewer values than
``SIZE``; beyond that a value's rank is off by at most ``rank_error`` of the rows, with a probability of 99 %.
The exact form stays where cases are at hand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions import exact_sums, exact_total, merged_sums
from gaugework.operators.distributions import OPERATIONAL_MINIMUM

SIZE = 4096  # values of a sketch's lowest level


def rank_error(size: int = SIZE) -> float:
    """Share of the rows by which a quantile's rank may be off (99 % confidence), as published for these sketches."""
    return 2.296 / size**0.9021


def kept_distribution(df: DataFrame, keys: Sequence[str], value: Column | str, size: int = SIZE) -> DataFrame:
    """One row per group to be stored: ``sample_count, minimum, maximum, sums, sketch``; missing values do not count."""
    measured = (F.col(value) if isinstance(value, str) else value).cast("double")
    return df.select(*keys, measured.alias("_value")).groupBy(*keys).agg(
        F.count("_value").alias("sample_count"),
        F.min("_value").alias("minimum"),
        F.max("_value").alias("maximum"),
        exact_sums("_value").alias("sums"),
        F.kll_sketch_agg_double("_value", size).alias("sketch"),
    )


def merged_distribution(kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Kept rows added up to coarser groups; they can be stored and merged again."""
    return kept.groupBy(*keys).agg(
        F.sum("sample_count").alias("sample_count"),
        F.min("minimum").alias("minimum"),
        F.max("maximum").alias("maximum"),
        merged_sums("sums").alias("sums"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )


def read_distribution(kept: DataFrame, keys: Sequence[str], suppress_below: int | None = None) -> DataFrame:
    """The columns of ``quantile_summary`` from kept rows."""
    size = F.col("sample_count")
    shown = (size > 0) if suppress_below is None else (size >= max(1, suppress_below))

    def quantile(p: float) -> Column:
        return F.when(size > 0, F.kll_sketch_get_quantile_double(F.when(size > 0, F.col("sketch")), F.lit(p)))

    statistics = {
        "minimum": F.col("minimum"), "p50": quantile(0.5), "p95": quantile(0.95), "maximum": F.col("maximum"),
        "mean": F.when(size > 0, exact_total("sums") / size),
    }
    return kept.select(
        *keys, "sample_count", *[F.when(shown, c).alias(name) for name, c in statistics.items()],
        ((size > 0) & ~shown).alias("suppressed"), (size < OPERATIONAL_MINIMUM).alias("small_sample"),
    )

"""Set relations between tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slice_subset(required: DataFrame, available: DataFrame) -> DataFrame:
    """Required slices that do not exist; empty means subset."""
    return required.select("slice").distinct().join(
        available.select("slice").distinct(), "slice", "left_anti"
    )


def set_equal(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Symmetric difference with the side that holds the key; empty means equal."""
    marked = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    seen = marked.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return seen.filter(F.col("_a") != F.col("_b")).select(
        *keys, F.when(F.col("_a") == 1, "left").otherwise("right").alias("side")
    )


def multiset_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose number of copies differs, with both counts."""
    signed = a.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        b.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    counted = signed.groupBy(*keys).agg(
        F.sum("_l").alias("left_copies"), F.sum("_r").alias("right_copies")
    )
    return counted.filter(F.col("left_copies") != F.col("right_copies"))


def multiset_equal(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: whether both tables hold the same rows equally often."""
    return multiset_difference(a, b, keys).agg(
        (F.count(F.lit(1)) == 0).alias("equal"), F.count(F.lit(1)).alias("differing_rows")
    )


def union_scorers(*observations: DataFrame) -> DataFrame:
    """Observations of several scorer families in one table."""
    merged = observations[0]
    for more in observations[1:]:
        merged = merged.unionByName(more, allowMissingColumns=True)
    return merged


def repeated_metrics(observations: DataFrame) -> DataFrame:
    """(run, case, metric) reported more than once: metric names must be unique."""
    return (
        observations.groupBy("run_id", "case_id", "metric")
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )

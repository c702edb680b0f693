"""Gate policies as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.functions import valid_metric, valid_slice
from gaugework.schemas import POLICY


def policy_gates(policies: DataFrame) -> DataFrame:
    """One row per gate with its position and defaults."""
    return policies.select(F.col("name").alias("policy"), F.posexplode("gates").alias("position", "g")).select(
        "policy",
        "position",
        F.col("g.metric").alias("metric"),
        F.col("g.slice").alias("slice"),
        F.col("g.direction").alias("direction"),
        F.col("g.threshold").alias("threshold"),
        F.coalesce("g.allowed_regression", F.lit(0.0)).alias("allowed_regression"),
    )


def policy_violations(gates: DataFrame) -> DataFrame:
    """Gates with a repeated (metric, slice), a bad name, direction or bound."""
    repeated = gates.groupBy("policy", "metric", "slice").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(
        "policy", "metric", "slice", F.lit("duplicate_gate").alias("code")
    )
    codes = F.array_compact(
        F.array(
            F.when(~valid_metric("metric"), "invalid_metric"),
            F.when(F.col("slice").isNotNull() & ~valid_slice("slice"), "invalid_slice"),
            F.when(
                ~F.coalesce(F.col("direction").isin("higher_is_better", "lower_is_better"), F.lit(False)),
                "invalid_direction",
            ),
            F.when(F.col("threshold").isNull() | F.isnan("threshold"), "invalid_threshold"),
            F.when(F.col("allowed_regression") < 0, "negative_budget"),
        )
    )
    return repeated.unionByName(gates.select("policy", "metric", "slice", F.explode(codes).alias("code")))


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    return policy_gates(spark.read.schema(POLICY).option("multiLine", True).json(path))

"""Named queries: a Spark plan over a data directory and, where SQL can say it, its twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.plans.view_sql import sql
from gaugework.plans.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(plan: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = lambda spark, sf_dir: plan(Views(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = sql(oracle)
        return plan

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles at the precision in which results are compared."""
    wanted = set(columns)
    return df.select(
        *[F.round(c, digits).alias(c) if c in wanted else F.col(c) for c in df.columns]
    )

"""All registered queries (importing the query modules fills the registry)."""

from gaugework.plans import (  # noqa: F401
    evidence_queries,
    history_queries,
    source_queries,
    sql_queries,
    stream_queries,
)
from gaugework.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

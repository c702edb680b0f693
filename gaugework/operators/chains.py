"""Traces that link to traces that link further: the root of every chain, how far it is, and what the chain holds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.operators.oplog import rolled_traces, valid_spans
from gaugework.session import scratch_path


def _kept(rows: DataFrame) -> DataFrame:
    path = scratch_path(rows.sparkSession, "chains")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _followed(parents: DataFrame) -> DataFrame:
    """``trace_id, at, hops, least`` of every trace with a link: where its links end, or a place of its cycle.

    Each round doubles the way that every row has gone, so n links take log2(n) rounds; a row whose end has no link
    is finished and takes no part.  ``least`` is the least id on the way.  A round lies in the shared folder before
    the next begins.  Rounds are joined by merging: many small broadcasts would add up in the driver.
    """
    state = _kept(parents.select("trace_id", F.col("link").alias("at"), F.lit(1).cast("bigint").alias("hops"), F.least("trace_id", "link").alias("least")))
    count = state.count()
    for _ in range(math.ceil(math.log2(count + 1)) + 1 if count else 0):
        further = state.select(
            F.col("trace_id").alias("_from"), F.col("at").alias("_at"), F.col("hops").alias("_hops"), F.col("least").alias("_least")
        )
        moved = _kept(
            state.join(further.hint("merge"), F.col("at") == F.col("_from"), "left").select(
                "trace_id", F.coalesce("_at", "at").alias("at"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
                F.least("least", "_least").alias("least"),
            )
        )
        ended = moved.join(moved.select(F.col("trace_id").alias("_from")).hint("merge"), F.col("at") == F.col("_from"), "left_semi").limit(1).count() == 0
        state = moved
        if ended:
            break
    return state


def trace_chains(spans: DataFrame) -> DataFrame:
    """Per trace: ``root_trace_id``, ``depth`` (links to the root), ``cyclic``, and traces, spans and errors of its chain.

    ``spans`` as in ``trace_rollup``.  Of several traces that one links to, the least id counts; links of a trace to
    itself are ignored.  A root may have no spans of its own.  Links that lead into a cycle have its least id as root
    and no depth.
    """
    valid = valid_spans(spans)
    rolled = rolled_traces(valid)
    parents = valid.where("_link IS NOT NULL AND _link <> trace_id").groupBy("trace_id").agg(F.min("_link").alias("link"))
    ends = _followed(parents)
    # The end of a finished way has no link; a way whose end has one goes round, and all of the cycle lies before it.
    ring = ends.select(F.col("trace_id").alias("_ring"), F.col("least").alias("_root"))
    roots = ends.join(ring.hint("merge"), F.col("at") == F.col("_ring"), "left").select(
        "trace_id", F.coalesce("_root", "at").alias("_root_id"), F.when(F.col("_ring").isNull(), F.col("hops")).alias("_depth"),
        F.col("_ring").isNotNull().alias("_cyclic"),
    )
    members = rolled.join(roots.hint("merge"), "trace_id", "left").select(
        "trace_id", "spans", "errors", F.coalesce("_root_id", "trace_id").alias("root_trace_id"),
        F.when(F.col("_root_id").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("_depth")).alias("depth"),
        F.coalesce("_cyclic", F.lit(False)).alias("cyclic"),
    )
    totals = members.groupBy("root_trace_id").agg(
        F.count(F.lit(1)).alias("chain_traces"), F.sum("spans").alias("chain_spans"), F.sum("errors").alias("chain_errors")
    )
    return members.join(totals.hint("merge"), "root_trace_id").select(
        "trace_id", "root_trace_id", "depth", "cyclic", "chain_traces", "chain_spans", "chain_errors"
    )

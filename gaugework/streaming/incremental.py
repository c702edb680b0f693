"""Gates and summaries that follow arriving evidence by its changes.

Every micro-batch of observations is reduced to its own counts and mergeable sums.  These are added to the totals of
the same keys, the new totals are written as the batch's version, and only gates whose pair, metric and slice have a
changed total on either side are computed and written again.  A version names its batch and reads only earlier ones,
so a batch that Spark repeats replaces its own files with the same rows.

Now and then a version holds everything that still matters; readers start there, and what lies before the version
before it is deleted.  Totals of finished runs leave at that point, once no pair needs them for an unfinished run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from gaugework.operators.aggregates import aggregate_comparison, merged_partials, slice_partials, with_means
from gaugework.operators.gates import gate_results
from gaugework.operators.joins import pair_sides
from gaugework.session import delete_folder, join_small, versions

TOTAL_KEYS = ("run_id", "metric", "slice")
GATE_KEYS = ("pair_id", "position")


class GateChanges:
    """Versioned totals and gates below ``path``.

    ``pairs`` and ``gates`` are static tables.  ``finished`` gives the ``run_id`` of runs whose evidence is complete;
    observations of theirs that come later are ignored.  ``whole_every``: batches between two whole versions.
    """

    def __init__(
        self, pairs: DataFrame, gates: DataFrame, path: str, whole_every: int = 20,
        finished: Callable[[SparkSession], DataFrame] | None = None,
    ) -> None:
        self._pairs, self._gates, self._path = pairs, gates, path.rstrip("/")
        self._whole_every, self._finished = whole_every, finished

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Take a micro-batch in."""
        spark = batch.sparkSession
        rows = batch
        if self._finished is not None:
            rows = join_small(
                rows, self._finished(spark).select(F.col("run_id").alias("_run")).distinct(),
                lambda o, f: o["run_id"] == f["_run"], "left_anti", salt_on="case_id",
            )
        delta = self._write(slice_partials(rows), "deltas", batch_id)
        prior = _latest(spark, self._path, "totals", TOTAL_KEYS, batch_id)
        changed = delta
        if prior is not None:
            changed = merged_partials(_like(prior, delta, TOTAL_KEYS, "left_semi").unionByName(delta))
        changed = self._write(changed, "totals", batch_id)
        now = changed if prior is None else changed.unionByName(_like(prior, changed, TOTAL_KEYS, "left_anti"))
        self._write(self._changed_gates(changed, now), "gates", batch_id)
        if batch_id and batch_id % self._whole_every == 0:
            self._compact(spark, batch_id)

    def _changed_gates(self, changed: DataFrame, now: DataFrame) -> DataFrame:
        """Gates of pairs with a changed total, from both sides' totals."""
        sides = pair_sides(self._pairs).select("pair_id", F.col("_run").alias("run_id"))
        keys = ("pair_id", "metric", "slice")
        touched = join_small(
            changed.select("run_id", "metric", "slice"), sides.withColumnRenamed("run_id", "_run"),
            lambda c, p: c["run_id"] == p["_run"], salt_on="slice",
        ).select(*keys).distinct()
        wanted = join_small(
            touched, sides.withColumnRenamed("pair_id", "_pair"), lambda t, p: t["pair_id"] == p["_pair"], salt_on="slice"
        ).select("run_id", "metric", "slice").distinct()
        summary = with_means(_like(now, wanted, TOTAL_KEYS, "left_semi"))
        comparison = _like(aggregate_comparison(summary, self._pairs), touched, keys, "left_semi")
        return _like(gate_results(comparison, self._gates, self._pairs), touched, keys, "left_semi")

    def _write(self, rows: DataFrame, kind: str, batch_id: int) -> DataFrame:
        path = f"{self._path}/{kind}/version={batch_id}"
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def _compact(self, spark: SparkSession, batch_id: int) -> None:
        totals = _latest(spark, self._path, "totals", TOTAL_KEYS, batch_id + 1)
        if self._finished is not None:
            ended = self._finished(spark).select("run_id").distinct()
            sides = pair_sides(self._pairs).select("pair_id", F.col("_run").alias("run_id"))
            live = sides.join(ended, "run_id", "left_anti").select("pair_id").distinct()
            needed = sides.join(live, "pair_id", "left_semi").select("run_id")
            gone = ended.join(needed, "run_id", "left_anti").withColumnRenamed("run_id", "_run")
            totals = join_small(totals, gone, lambda t, g: t["run_id"] == g["_run"], "left_anti", salt_on="slice")
        before = max((v for v in versions(spark, f"{self._path}/whole-totals") if v < batch_id), default=None)
        self._write(totals, "whole-totals", batch_id)
        self._write(_latest(spark, self._path, "gates", GATE_KEYS, batch_id + 1), "whole-gates", batch_id)
        if before is not None:
            for kind in ("deltas", "totals", "gates", "whole-totals", "whole-gates"):
                for version in versions(spark, f"{self._path}/{kind}"):
                    if version < before or (version == before and not kind.startswith("whole")):
                        delete_folder(spark, f"{self._path}/{kind}/version={version}")


def _like(rows: DataFrame, others: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Rows whose keys are, or are not, among the others' (absent slices are equal)."""
    renamed = others.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()

    def same(a: DataFrame, b: DataFrame):
        condition = a[keys[0]].eqNullSafe(b[f"_k_{keys[0]}"])
        for k in keys[1:]:
            condition = condition & a[k].eqNullSafe(b[f"_k_{k}"])
        return condition

    return join_small(rows, renamed, same, how)


def _latest(spark: SparkSession, path: str, kind: str, keys: Sequence[str], before: int) -> DataFrame | None:
    """The last row of each key in versions below ``before``."""
    whole = max((v for v in versions(spark, f"{path}/whole-{kind}") if v < before), default=-1)
    folders = [f"{path}/{kind}/version={v}" for v in versions(spark, f"{path}/{kind}") if whole < v < before]
    if whole >= 0:
        folders.insert(0, f"{path}/whole-{kind}/version={whole}")
    if not folders:
        return None
    rows = None
    for place, folder in enumerate(folders):
        more = spark.read.parquet(folder).withColumn("_place", F.lit(place))
        rows = more if rows is None else rows.unionByName(more)
    values = [c for c in rows.columns if c not in (*keys, "_place")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_place").alias("_v"))
    return last.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])


def gate_changes_stream(
    observations: DataFrame, pairs: DataFrame, gates: DataFrame, path: str, checkpoint: str, whole_every: int = 20,
    finished: Callable[[SparkSession], DataFrame] | None = None,
) -> DataStreamWriter:
    """A writer that keeps totals and gates below ``path`` current; ``observations`` carry ``slices``."""
    changes = GateChanges(pairs, gates, path, whole_every, finished)
    return observations.writeStream.option("checkpointLocation", checkpoint).foreachBatch(changes.merge)


def current_totals(spark: SparkSession, path: str) -> DataFrame | None:
    """``slice_summary`` of all evidence so far, without finished runs that no pair needs; None before any."""
    totals = _latest(spark, path, "totals", TOTAL_KEYS, 1 << 62)
    return None if totals is None else with_means(totals)


def current_gates(spark: SparkSession, path: str, pairs: DataFrame, gates: DataFrame) -> DataFrame:
    """``gate_results`` of all evidence so far; gates that no evidence has touched fail."""
    known = _latest(spark, path, "gates", GATE_KEYS, 1 << 62)
    totals = spark.createDataFrame(
        [], "run_id STRING, metric STRING, slice STRING, attempted BIGINT, scored BIGINT, skipped BIGINT, errors BIGINT, mean DOUBLE"
    )
    blank = gate_results(aggregate_comparison(totals, pairs), gates, pairs)
    return blank if known is None else known.select(*blank.columns).unionByName(_like(blank, known, GATE_KEYS, "left_anti"))

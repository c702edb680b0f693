"""Case files that arrive: each line is parsed once, cases and rejects of all files so far lie in one table.

A batch of lines is parsed into its own version; its cases and rejects are read off the parsed rows.  A version reads
only earlier ones, so a batch that Spark repeats replaces its own files with the same rows.  The first case of an id
stays; of cases that arrive together the first by file and position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from gaugework.operators.ordered import first_occurrence
from gaugework.session import versions
from gaugework.sources.cases import parse_case_lines, read_lines, split_parsed


class CaseTable:
    """Cases and rejects of one dataset below ``path``."""

    def __init__(self, spark: SparkSession, path: str, name: str, revision: int) -> None:
        self._spark, self._path, self._name, self._revision = spark, path.rstrip("/"), name, revision

    def take(self, lines: DataFrame, number: int) -> None:
        """Take lines (``file, position, line``) in as version ``number``."""
        parsed = self._write(parse_case_lines(lines).drop("line"), "parsed", number)
        cases, rejects = split_parsed(parsed, self._name, self._revision)
        known = self._read("cases", number)
        if known is not None:
            ids = known.select(F.col("case_id").alias("_known"))
            cases = cases.join(ids, F.col("case_id") == F.col("_known"), "left_anti")
            accepted = parsed.filter(F.col("code").isNull()).select("file", "position", "case_id")
            first = first_occurrence(accepted, ["case_id"], ["file", "position"]).filter("is_first")
            again = first.join(ids, F.col("case_id") == F.col("_known"), "left_semi")
            rejects = rejects.unionByName(again.select("file", "position", F.lit("duplicate_case_id").alias("code")))
        self._write(cases, "cases", number)
        self._write(rejects, "rejects", number)

    def _write(self, rows: DataFrame, kind: str, number: int) -> DataFrame:
        path = f"{self._path}/{kind}/version={number}"
        rows.write.mode("overwrite").parquet(path)
        return self._spark.read.schema(rows.schema).parquet(path)

    def _read(self, kind: str, before: int = 1 << 62) -> DataFrame | None:
        folders = [f"{self._path}/{kind}/version={v}" for v in versions(self._spark, f"{self._path}/{kind}") if v < before]
        return self._spark.read.parquet(*folders) if folders else None

    def cases(self) -> DataFrame | None:
        """All cases so far; None before any lines."""
        return self._read("cases")

    def rejects(self) -> DataFrame | None:
        """``file, position, code`` of all lines that made no case."""
        return self._read("rejects")


def ingest_cases(spark: SparkSession, source: str, path: str, name: str, revision: int) -> CaseTable:
    """Read case files once into a table below ``path``."""
    table = CaseTable(spark, path, name, revision)
    table.take(read_lines(spark, source), 0)
    return table


def arriving_cases(
    spark: SparkSession, source: str, path: str, name: str, revision: int, checkpoint: str, files_at_once: int = 1000
) -> DataStreamWriter:
    """A writer that takes case files in as they appear below ``source``."""
    table = CaseTable(spark, path, name, revision)
    lines = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(source).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line")
    )

    def take(batch: DataFrame, number: int) -> None:
        placed = batch.select("file", F.struct("block", F.monotonically_increasing_id().alias("row")).alias("position"), "line")
        table.take(placed, number)

    return lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)

"""Helpers that several operators of this folder share."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugework.session import shared_folder

SAMPLE_BYTES = 64 << 20  # of text in a sample of labelled rows


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there and is not recomputed."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns what this process has freed to the system, which else stays with it from task to task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def kept_by_worker(key: tuple, make: Callable):
    """A value built once per Python worker; workers outlive their tasks.

    A worker holds values of one operator at a time, which ``key`` names first, and four of them at most.  What it
    freed before goes back to the system.
    """
    name = "_gaugework_worker_values"
    holder = sys.modules.get(name)
    if holder is None:
        holder = sys.modules[name] = types.ModuleType(name)
        holder.values = {}
    if key not in holder.values:
        others = [k for k in holder.values if k[0] != key[0]]
        for old in others or list(holder.values)[:-3]:
            del holder.values[old]
        give_back()
        holder.values[key] = make()
    return holder.values[key]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, text_bytes: int = SAMPLE_BYTES
) -> DataFrame:
    """At most ``rows`` distinct labelled training rows ``(doc_id, text, label)``, the same ones on every run.

    Labels of absent documents do not count.  The smallest hashes of the id, then of the text, win, so the sample does
    not depend on partitioning.  It ends before the row that ``text_bytes`` of text precede; one row is always taken.
    """
    truth = (
        labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).alias("_label"))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    place = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text"), F.col("text")]
    held = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(truth), "doc_id")  # at most ``rows`` ids
        .distinct()
        .orderBy(*place)
        .limit(rows)
    )
    before = Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)  # over ``rows`` rows
    return (
        held.withColumn("_before", F.coalesce(F.sum(F.octet_length("text").cast("bigint")).over(before), F.lit(0)))
        .where(F.col("_before") < text_bytes)
        .select("doc_id", "text", F.col("_label").cast("int").alias("label"))
    )

"""Where two stored readings of a table differ, by a tree of hashes over buckets of its key.

A reading is stored in order of a hash of the key, in folders of neighbouring buckets, next to a tree: a leaf per
bucket holds the count and the added SHA-256 lanes of its rows, a node above the digests of its children.  Two
readings are compared from the top; below equal nodes nothing is looked at.  Only folders of buckets that differ are
read again, so the work of the second pass follows the number of changes and not the size of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.operators.fingerprint import fingerprint, row_text

LEVELS, STEP = 4, 4  # levels below the root, and bits of a bucket's number that each adds
FOLDER_BITS = 8
TREE = "level INT, node INT, rows BIGINT, digest STRING"


def _bucket(keys: Sequence[str]) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - LEVELS * STEP).cast("int")


def store_reading(df: DataFrame, keys: Sequence[str], path: str) -> None:
    """Write a reading of a table and its tree below ``path``; all columns count, copies of a row too."""
    placed = df.withColumn("_bucket", _bucket(keys)).withColumn("_folder", F.shiftright("_bucket", LEVELS * STEP - FOLDER_BITS))
    placed.repartitionByRange("_folder", "_bucket").sortWithinPartitions("_bucket").write.partitionBy("_folder").parquet(f"{path}/rows")
    stored = df.sparkSession.read.parquet(f"{path}/rows")
    level = fingerprint(stored, ("_bucket",), row_text(df.columns)).select(
        F.lit(LEVELS).alias("level"), F.col("_bucket").alias("node"), "rows", F.col("fingerprint").alias("digest")
    )
    level.write.parquet(f"{path}/tree/{LEVELS}")
    for number in range(LEVELS - 1, -1, -1):
        below = df.sparkSession.read.schema(TREE).parquet(f"{path}/tree/{number + 1}")
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))  # 2 ** STEP at most
        text = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"])), ",")
        below.groupBy(F.shiftright("node", STEP).alias("node")).agg(F.sum("rows").alias("rows"), F.sha2(text, 256).alias("digest")).select(
            F.lit(number).alias("level"), "node", "rows", "digest"
        ).write.parquet(f"{path}/tree/{number}")


def differing_buckets(spark: SparkSession, before: str, after: str) -> DataFrame:
    """``node``: buckets whose rows differ, found from the root down."""

    def level(path: str, number: int) -> DataFrame:
        return spark.read.schema(TREE).parquet(f"{path}/tree/{number}").select("node", "digest")

    differ = None
    for number in range(LEVELS + 1):
        old, new = level(before, number), level(after, number)
        if differ is not None:
            parents = differ.select(F.col("node").alias("_parent"))
            old, new = (t.join(parents, F.shiftright("node", STEP) == F.col("_parent"), "left_semi") for t in (old, new))
        joined = old.withColumnRenamed("digest", "_old").join(new.withColumnRenamed("digest", "_new"), "node", "full")
        differ = joined.where(~F.col("_old").eqNullSafe(F.col("_new"))).select("node")
    return differ


def rows_in(spark: SparkSession, path: str, buckets: Sequence[int]) -> DataFrame:
    """Rows of some buckets of a stored reading; folders without them are not opened."""
    folders = sorted({b >> LEVELS * STEP - FOLDER_BITS for b in buckets})
    rows = spark.read.parquet(f"{path}/rows").where(F.col("_folder").isin(*folders))
    # A small table, since tens of thousands of literals would be planned one by one.
    wanted = spark.createDataFrame(pd.DataFrame({"_bucket": pd.Series(buckets, dtype="int32")}), "_bucket int")
    return rows.join(F.broadcast(wanted), "_bucket", "left_semi").drop("_bucket", "_folder")


def located_differences(spark: SparkSession, before: str, after: str, keys: Sequence[str]) -> DataFrame:
    """Keys that were ``added``, ``removed`` or ``changed`` between two stored readings.

    A key's rows are compared as a multiset.  The numbers of differing buckets, at most 2 ** (LEVELS * STEP), come to
    the driver to choose what is read.
    """
    buckets = [r["node"] for r in differing_buckets(spark, before, after).collect()]

    def side(path: str, name: str) -> DataFrame:
        rows = rows_in(spark, path, buckets)
        return fingerprint(rows, tuple(keys), row_text(rows.columns)).select(*keys, F.col("fingerprint").alias(name))

    old, new = side(before, "_old").alias("o"), side(after, "_new").alias("n")
    same = None
    for key in keys:
        condition = F.col(f"o.{key}").eqNullSafe(F.col(f"n.{key}"))
        same = condition if same is None else same & condition
    joined = old.join(new, same, "full").where(~F.col("_old").eqNullSafe(F.col("_new")))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    return joined.select(
        *[F.when(F.col("_old").isNull(), F.col(f"n.{k}")).otherwise(F.col(f"o.{k}")).alias(k) for k in keys],
        change.alias("change"),
    )

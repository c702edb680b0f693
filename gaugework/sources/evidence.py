"""Evidence in and out: create-once appends, manifests, exports, assembly, backfill."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_once(
    new: DataFrame, existing: DataFrame, key: Sequence[str], digest: str = "digest"
) -> DataFrame:
    """Label new records ``append``, ``identical`` or ``conflict``.

    A key is created once: the same digest again is a no-op, another digest is a
    conflict.  Of several new records with one key, equal digests collapse into one
    append and differing digests are all conflicts.
    """
    facts = new.select(*key, F.col(digest), F.lit(True).alias("_new")).unionByName(
        existing.select(*key, F.col(digest), F.lit(False).alias("_new"))
    )
    per_digest = facts.groupBy(*key, digest).agg(
        F.bool_or("_new").alias("_new"), F.bool_or(~F.col("_new")).alias("_old")
    )
    per_key = per_digest.groupBy(*key).agg(
        F.count_if(F.col("_new")).alias("_news"),
        F.count_if(F.col("_old")).alias("_olds"),
        F.count_if(F.col("_new") & F.col("_old")).alias("_both"),
        F.max(F.when(F.col("_new"), F.col(digest))).alias(digest),
    ).filter("_news > 0")
    label = (
        F.when(F.col("_news") > 1, "conflict")
        .when(F.col("_olds") == 0, "append")
        .when(F.col("_both") == F.col("_olds"), "identical")
        .otherwise("conflict")
    )
    return per_key.select(*key, F.when(label != "conflict", F.col(digest)).alias(digest), label.alias("action"))


def publish_once(
    spark: SparkSession, new: DataFrame, path: str, key: Sequence[str], digest: str = "digest"
) -> DataFrame:
    """Add the absent records to a parquet table, each key once; returns the labels (see ``published``)."""
    from gaugework.sources import published

    return published.publish_once(spark, new, path, key, digest)


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256, records) of every file below a path, named by its path below it.

    A file's content passes through one row, which Spark limits to 2 GB a file.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()

    def below(full: Column) -> Column:
        # Readers write file:/ and file:/// for the same place.
        one_way = F.regexp_replace(full, "^([a-z0-9]+):/+", "$1:/")
        start = len(re.sub("^([a-z0-9]+):/+", r"\1:/", root.rstrip("/"))) + 2
        return F.url_decode(F.replace(F.substr(one_way, F.lit(start)), F.lit("+"), F.lit("%2B")))

    contents = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    hashed = contents.select(
        below(F.col("path")).alias("name"),
        F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
    )
    lines = (
        spark.read.option("recursiveFileLookup", True).text(path)
        .filter(F.trim("value") != "")
        .groupBy(below(F.col("_metadata.file_path")).alias("name"))
        .agg(F.count(F.lit(1)).alias("records"))
    )
    return hashed.join(lines, "name", "left").select(
        "name", "bytes", "sha256", F.coalesce("records", F.lit(0)).cast("bigint").alias("records")
    )


def decision_rows(
    decisions: DataFrame, results: DataFrame, changes: DataFrame, failing: DataFrame, comparison: DataFrame
) -> DataFrame:
    """Everything a decision report shows as (pair_id, section, body) JSON rows."""

    def section(df: DataFrame, name: str) -> DataFrame:
        body = [c for c in df.columns if c != "pair_id"]
        return df.select(
            "pair_id",
            F.lit(name).alias("section"),
            F.to_json(F.struct(*body), {"ignoreNullFields": "false"}).alias("body"),
        )

    parts = (
        (decisions, "decision"),
        (results, "gate"),
        (changes, "change_counts"),
        (failing, "newly_failing"),
        (comparison, "aggregate"),
    )
    rows = [section(df, name) for df, name in parts]
    merged = rows[0]
    for more in rows[1:]:
        merged = merged.unionByName(more)
    return merged


def export_decision(rows: DataFrame, path: str) -> None:
    rows.write.mode("error").partitionBy("section").json(path)


def build_cases(queries: DataFrame, clarifications: DataFrame, refusals: DataFrame) -> DataFrame:
    """Assemble cases from three typed sources with derived slices."""

    def question(df: DataFrame):
        return F.to_json(
            F.struct(
                F.lit("").alias("chat_history"), F.col("language").alias("language"), F.col("question").alias("question")
            )
        )

    def case(df: DataFrame, expected, refusal: bool, slices) -> DataFrame:
        return df.select(
            "case_id",
            question(df).alias("input"),
            expected.alias("expected"),
            F.lit(refusal).alias("expected_refusal"),
            F.array_sort(slices).alias("slices"),
        )

    language = F.concat(F.lit("language/"), F.col("language"))
    tags = F.transform(
        F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.concat(F.lit("query_type/"), t)
    )
    query_expected = F.to_json(
        F.struct(
            F.lit("query").alias("behavior"),
            "expected_columns",
            "expected_rows",
            "reference_sql",
            F.when(F.coalesce("ordered", F.lit(True)), "ordered").otherwise("unordered").alias("result_order"),
            F.lit("1").alias("schema_version"),
        )
    )
    fixed = [F.lit("ambiguity/clear"), F.lit("expected/query"), language, F.lit("safety/safe")]
    from_queries = case(queries, query_expected, False, F.concat(F.array(*fixed), tags))
    from_clarifications = case(
        clarifications,
        F.lit('{"accepted_clarification_codes":["provider_clarification"],"behavior":"clarification","schema_version":"1"}'),
        False,
        F.array(
            F.concat(F.lit("ambiguity/"), F.col("code")), F.lit("expected/clarification"), language, F.lit("safety/safe")
        ),
    )
    from_refusals = case(
        refusals,
        F.lit('{"behavior":"refusal","schema_version":"1"}'),
        True,
        F.array(
            F.lit("ambiguity/clear"), F.lit("expected/refusal"), language,
            F.concat(F.lit("policy/"), F.col("policy")), F.lit("safety/unsafe"),
        ),
    )
    return from_queries.unionByName(from_clarifications).unionByName(from_refusals)


_RUN_DOCUMENT = (
    "suite STRUCT<name: STRING, revision: INT>, target STRUCT<name: STRING, revision: INT>, "
    "cases ARRAY<STRUCT<target: STRUCT<response: STRUCT<usage: "
    "STRUCT<input_units: BIGINT, output_units: BIGINT>>>>>"
)


def backfill_columns(documents: DataFrame, document: str = "document") -> DataFrame:
    """Usage totals and pins from stored run documents.

    Suite and target pins are filled only for runs that pin a suite; they are never
    inferred from anything else.
    """
    doc = F.from_json(F.col(document), _RUN_DOCUMENT)

    def total(field: str):
        usage = F.transform(F.col("_d.cases"), lambda c: c["target"]["response"]["usage"][field])
        return F.aggregate(
            F.coalesce(usage, F.array().cast("array<bigint>")),
            F.lit(0).cast("bigint"),
            lambda acc, v: acc + F.coalesce(v, F.lit(0).cast("bigint")),
        )

    pinned = F.col("_d.suite").isNotNull()
    return documents.withColumn("_d", doc).select(
        *[c for c in documents.columns if c != document],
        total("input_units").alias("input_units"),
        total("output_units").alias("output_units"),
        F.when(pinned, F.col("_d.suite.name")).alias("suite_name"),
        F.when(pinned, F.col("_d.suite.revision")).alias("suite_revision"),
        F.when(pinned, F.col("_d.target.name")).alias("target_name"),
        F.when(pinned, F.col("_d.target.revision")).alias("target_revision"),
    )

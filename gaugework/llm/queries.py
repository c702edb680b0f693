"""The registered queries of this folder and, where SQL can say them, their SQL twins."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm import (
    context_tree,
    decontaminate,
    fast_sketch,
    filter_audit,
    hard_negatives,
    licences,
    multi_index,
    piece_codec,
    rule_quality,
    shards,
    token_counts,
    token_files,
    toxicity,
)
from gaugework.llm.shared import held_out, labelled_sample, scratch

TOKENIZERS = os.environ.get("TOKENIZER_DIR")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if oracle is not None:
            ORACLES[name] = oracle
        return plan

    return register


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return os.path.join(TOKENIZERS, name) if TOKENIZERS else public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_piece_codec")
def op1_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    trip = piece_codec.round_trip(F.col("text"), tokenizer("piece_bpe_32k.model"))
    return table(spark, sf_dir, "documents").select("doc_id", trip.alias("_r")).select("doc_id", "_r.*")


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scorer = toxicity.fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", toxicity.SAMPLE_ROWS))
    scored = docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity.score(F.col("text"), scorer).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op3_decontaminate")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_multi_index")
def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return multi_index.nearest(vectors, vectors.where("vec_id % 50 = 0"))


@query("op5_rule_quality")
def op5_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = rule_quality.fit(
        labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", rule_quality.SAMPLE_ROWS)
    )
    scored = rule_quality.statistics(docs.select("doc_id", "text")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"), end_id=1)
    return token_files.read(spark, path).select(
        "doc_id", "start", "n_tokens", token_files.ids_crc32(F.col("ids")).alias("ids_crc32")
    )


@query("op7_licences", licences.oracle())
def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_known", "sequence", "licences", "kinds")


@query("op8_fast_sketch")
def op8_fast_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fast_sketch.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        token_counts.token_count(F.col("text"), tokenizer("word_bpe_49k.json")).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


@query("op10_best_fit_shards")
def op10_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op11_hard_negatives", hard_negatives.oracle())
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


@query("op12_filter_audit", filter_audit.oracle())
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_context_tree")
def op13_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"))

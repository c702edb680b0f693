"""A training corpus from raw documents: quality, toxicity, near duplicates, benchmark passages, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents that the stage before it kept.  All but the
last return the columns of ``documents``, whatever they are; ``doc_id`` and ``text`` are needed.  Models learn
from the ``labels`` of the documents at hand, without those that are held out; where these rows do not show both
labels, a stage rejects nothing.  Documents with null ids pass the near-duplicate stage; documents that share an
id stay or go together there.  Null and empty texts are scored like others.  Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm import decontaminate, fast_sketch, piece_codec, rule_quality, toxicity
from gaugework.llm.queries import table, tokenizer
from gaugework.llm.shared import labelled_sample, scratch, written

QUALITY, TOXIC = 0.3, 0.5
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject."""
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", rule_quality.SAMPLE_ROWS)
    model = rule_quality.fit(sample)
    if not model.rules:
        return docs
    return rule_quality.statistics(docs).where(model.score() >= QUALITY).select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the recurrent network does not find toxic."""
    scorer = toxicity.fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", toxicity.SAMPLE_ROWS))
    if scorer.constant is not None:
        return docs
    return docs.where(toxicity.score(F.col("text"), scorer) < TOXIC)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at 0.8 or more join."""
    found = fast_sketch.near_duplicates(docs, words=5, percent=80)
    dropped = written(found.where(~F.col("kept")).select("doc_id").distinct(), "dropped")
    if dropped.count() <= fast_sketch.FEW_IDS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, docs["doc_id"].cast("bigint") == dropped["doc_id"], "left_anti")


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    trip = piece_codec.round_trip(F.col("text"), tokenizer("piece_bpe_32k.model"))
    return docs.select("doc_id", trip.alias("_trip")).select("doc_id", "_trip.*")


STAGES = [
    ("quality", quality),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each),
    ("decontamination", no_benchmark),
    ("tokens", tokens),
]

# Trained models decide in two stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Whole texts go to Python; batches of few rows keep workers small, which stay from stage to stage.
    known = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(BATCH_ROWS))
    try:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES:
            path = scratch(spark, f"pipeline-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
        return docs
    finally:
        if known is None:
            spark.conf.unset(BATCH)
        else:
            spark.conf.set(BATCH, known)

"""Recorded responses: reading manifests and classifying status codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.schemas import RECORDED_RESPONSE

RETRYABLE = ("target_rate_limited", "target_timeout", "target_unavailable")


def status_failure(status: Column) -> Column:
    """Failure code of a status code; NULL for 200."""
    return (
        F.when(status == 200, F.lit(None).cast("string"))
        .when(status == 401, "target_authentication")
        .when(status == 429, "target_rate_limited")
        .when(status.isin(408, 504), "target_timeout")
        .when(status.between(500, 599), "target_unavailable")
        .when(status.between(400, 499), "target_rejected")
        .otherwise("target_protocol_error")
    )


def classify_status(responses: DataFrame, status: str = "status") -> DataFrame:
    """Add ``failure_code`` and ``retryable`` from a status column."""
    code = status_failure(F.col(status))
    return responses.withColumn("failure_code", code).withColumn(
        "retryable", F.coalesce(F.col("failure_code").isin(*RETRYABLE), F.lit(False))
    )


def normalize_recorded(recorded: DataFrame, run_id: str) -> DataFrame:
    """Recorded bodies as responses.

    200 answered is a query output, 200 clarification a clarification, 403 a
    refusal with zero usage; any other status is a failure, and a body that breaks
    its own shape is a protocol error.
    """
    body = F.col("body")
    answered = (F.col("status") == 200) & (body["status"] == "answered")
    asked = (F.col("status") == 200) & (body["status"] == "clarification_required")
    refused = F.col("status") == 403
    executions = F.coalesce(F.size(body["executions"]), F.lit(0))
    fits = (
        F.when(answered, executions.between(1, 16))
        .when(asked, executions == 0)
        .otherwise(refused)
        & (refused | (
            (body["input_tokens"] >= 0) & (body["output_tokens"] >= 0) & (body["duration_ms"] >= 0)
        ))
    )
    query = F.to_json(
        F.struct(
            F.lit("query").alias("kind"),
            F.lit("1").alias("schema_version"),
            F.transform(body["executions"], lambda e: e["sql"]).alias("sql_executions"),
        )
    )
    question = F.lit(
        '{"clarification_code":"provider_clarification","kind":"clarification","schema_version":"1"}'
    )
    refusal = F.lit('{"kind":"refusal","schema_version":"1"}')
    ok = F.coalesce(fits, F.lit(False))
    code = F.when(~ok, F.coalesce(status_failure(F.col("status")), F.lit("target_protocol_error")))
    shaped = recorded.withColumn("_ok", ok).withColumn("_code", code)
    good = F.col("_ok")
    return shaped.select(
        F.lit(run_id).alias("run_id"),
        "case_id",
        F.when(good & answered, query).when(good & asked, question).when(good, refusal).alias("output"),
        F.when(good & refused, "refused").when(good, "completed").alias("outcome"),
        F.when(good & refused, "policy_block").alias("refusal_code"),
        F.when(good & refused, 0).when(good, body["input_tokens"]).cast("bigint").alias("input_units"),
        F.when(good & refused, 0).when(good, body["output_tokens"]).cast("bigint").alias("output_units"),
        F.when(good, body["duration_ms"]).alias("latency_ms"),
        F.col("_code").alias("failure_code"),
        F.coalesce(F.col("_code").isin(*RETRYABLE), F.lit(False)).alias("retryable"),
    )


def read_responses(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """A recorded manifest as JSON lines ``{case_id, status, body}``."""
    return normalize_recorded(spark.read.schema(RECORDED_RESPONSE).json(path), run_id)

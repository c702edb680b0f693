import pytest
from helpers import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from gaugework.operators import checks, history, oplog
from gaugework.operators.ordered import (
    HOT_ROWS,
    first_occurrence,
    keyset_page,
    ranked,
    with_previous,
)


def skewed(spark, n=4_000):
    """One key holds a third of the rows; order values repeat."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)
    return spark.range(n).select(
        key.cast("int").alias("k"), ((F.col("id") * 7919) % 997).cast("double").alias("t"), F.col("id").alias("i")
    )


@pytest.mark.parametrize("descending", [False, True])
def test_ranks_over_ranges(spark, descending):
    df = skewed(spark)
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in ("t", "i")]
    want = df.withColumn("rank", F.row_number().over(W.partitionBy("k").orderBy(*order)))
    got = ranked(df, ["k"], F.col("t"), order, descending=descending, hot_rows=100)
    assert rows(got) == rows(want)


def test_previous_rows_over_ranges(spark):
    df = skewed(spark)
    window = W.partitionBy("k").orderBy("t", "i")
    want = df.withColumn("_prev_i", F.lag("i").over(window)).withColumn("_prev_t", F.lag("t").over(window))
    for hot in (HOT_ROWS, 100):
        got = with_previous(df, ["k"], F.col("t"), ["t", "i"], ["i", "t"], hot_rows=hot)
        assert rows(got) == rows(want)


def test_inputs_of_any_size_use_ranges(spark):
    df = skewed(spark)
    plan = ranked(df, ["k"], F.col("t"), [F.col("t"), F.col("i")])
    assert "_range" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_first_occurrence(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5), ("a", 3), (None, 9)], "k STRING, p INT")
    assert rows(first_occurrence(df, ["k"], ["p"]).filter("is_first"), "k", "p") == [("a", 1), ("b", 5), (None, 9)]


def test_pages_cover_everything_once(spark):
    df = spark.range(25).select((F.col("id") % 4).alias("a"), F.col("id").alias("b"))
    for descending in (False, True):
        seen, after = [], None
        while True:
            page = keyset_page(df, ["a", "b"], after, 7, descending).collect()
            found = sorted(((r.a, r.b) for r in page), reverse=descending)
            seen += found
            if not page or not page[0].has_next:
                break
            after = list(found[-1])
        assert seen == sorted(((i % 4, i) for i in range(25)), reverse=descending)


def test_list_views_refuse_unknown_filters(spark):
    df = spark.createDataFrame([], "job_id STRING, kind STRING, status STRING, created_at TIMESTAMP, document STRING")
    assert "document" not in history.list_view(df, "jobs").columns
    with pytest.raises(ValueError):
        history.list_view(df, "jobs", {"document": "x"})
    with pytest.raises(ValueError):
        history.list_view(df, "jobs", limit=101)


def test_attempt_gaps(spark):
    data = [("ok", 1), ("ok", 2), ("gap", 1), ("gap", 3), ("late", 2), ("twice", 1), ("twice", 1)]
    df = spark.createDataFrame(data, "job_id STRING, attempt_number INT")
    found = {r.job_id: (r.starts_late, r.has_gap, r.has_repeat) for r in history.attempt_gaps(df).collect()}
    assert found == {"gap": (False, True, False), "late": (True, False, False), "twice": (False, False, True)}


LIFE = "job_id STRING, seq BIGINT, at STRING, status STRING, error_code STRING, attempt_count INT, max_attempts INT"


def test_lifecycle(spark):
    data = [
        ("a", 1, "2026-01-01 00:00:00", "queued", None, 0, 2),
        ("a", 2, "2026-01-01 00:00:01", "running", None, 1, 2),
        ("a", 3, "2026-01-01 00:00:02", "failed", "target_timeout", 1, 2),
        ("b", 1, "2026-01-01 00:00:00", "queued", None, 0, 2),
        ("b", 2, "2026-01-01 00:00:05", "succeeded", None, 1, 2),
        ("b", 3, "2026-01-01 00:00:04", "succeeded", None, 3, 2),
        ("c", 1, "2026-01-01 00:00:00", "running", None, 0, 2),
        ("c", 2, "2026-01-01 00:00:00", "failed", None, 1, 2),
    ]
    df = spark.createDataFrame(data, LIFE).withColumn("at", F.col("at").cast("timestamp"))
    want = sorted([
        ("b", 2, "illegal_transition"), ("b", 3, "time_moved_back"), ("b", 3, "too_many_attempts"),
        ("c", 1, "not_queued_first"), ("c", 1, "started_without_attempt"), ("c", 2, "error_code_mismatch"),
    ], key=str)
    for hot in (None, 1):
        assert rows(oplog.lifecycle_violations(df, hot)) == want


def test_idempotency_with_a_hot_key(spark):
    df = spark.createDataFrame(
        [(1, "run", "k", "d1", 1), (2, "run", "k", "d1", 2), (3, "run", "k", "d2", 3), (4, "run", "z", "d", 1), (5, "other", "k", "d2", 9)],
        "submission_id INT, kind STRING, key STRING, digest STRING, at INT",
    )
    assert rows(oplog.idempotency_conflicts(df), "submission_id", "outcome") == [(2, "replay"), (3, "conflict")]


def test_expired_leases(spark):
    jobs = spark.createDataFrame(
        [("a", "running", 1, 3), ("b", "running", 3, 3), ("c", "cancel_requested", 1, 3), ("d", "running", 1, 3), ("e", "succeeded", 1, 3)],
        "job_id STRING, status STRING, attempt_count INT, max_attempts INT",
    )
    attempts = spark.createDataFrame(
        [("a", 1), ("b", 3), ("b", 2), ("c", 1), ("e", 1)], "job_id STRING, attempt_number INT"
    ).select("*", F.lit("running").alias("status"), F.lit("2026-01-01 00:00:00").cast("timestamp").alias("lease_expires_at"))
    found = oplog.expired_leases(jobs, attempts, "2026-01-01 00:00:00", 4, 100)
    assert rows(found, "job_id", "next_status", "delay_seconds", "error_code") == [
        ("a", "queued", 4, None), ("b", "failed", None, "lease_expired"), ("c", "canceled", None, None),
    ]
    assert oplog.expired_leases(jobs, attempts, "2025-12-31 23:59:59").count() == 0


def test_history_audit(spark):
    data = [(1, "r4", "s", "2026-01-04"), (2, "r2", "s", "2026-01-02"), (3, "r3", "s", "2026-01-03"), (4, "r1", "x", "2026-01-01"), (5, "r1", "s", "2026-01-01")]
    df = spark.createDataFrame(data, "position BIGINT, id STRING, suite STRING, created_at STRING").withColumn("created_at", F.col("created_at").cast("timestamp"))
    assert rows(checks.history_audit(df, "s")) == [
        ("r1", "duplicate_id"), ("r1", "not_newest_first"), ("r1", "other_suite"), ("r3", "not_newest_first"),
    ]


def test_trace_rollup(spark):
    t, u = "a" * 32, "b" * 32
    data = [
        (t, "error", 5, f"00-{u}-{'c' * 16}-01"), (t, "ok", 9, None), (u, "ok", 1, f"00-{'0' * 32}-{'c' * 16}-01"),
        (u, "ok", 2, "garbage"), ("0" * 32, "ok", 1, None), ("XY", "ok", 1, None),
    ]
    df = spark.createDataFrame(data, T.StructType.fromDDL("trace_id STRING, outcome STRING, duration_ms BIGINT, traceparent STRING"))
    assert rows(oplog.trace_rollup(df)) == [(t, 2, 1, 9, u, 2, 0), (u, 2, 0, 2, None, None, None)]

"""Streams fed by several files, so that state and watermarks matter."""

import random
from datetime import datetime, timedelta

import pytest
from helpers import rows
from pyspark.sql import functions as F

from gaugework.operators import aggregates, oplog
from gaugework.operators.gates import gate_results
from gaugework.plans.stream_queries import arriving
from gaugework.plans.views import Views
from gaugework.streaming import incremental, reordered, streams

START = datetime(2026, 1, 1)


def feed(spark, tmp_path, batches, ddl):
    """A file stream that reads one file per micro-batch, in order."""
    path = str(tmp_path / "in")
    for i, data in enumerate(batches):
        spark.createDataFrame(data, ddl).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path)


def at(minutes):
    return START + timedelta(minutes=minutes)


@pytest.mark.parametrize("files", [1, 3])
def test_tables_of_one_file_or_a_folder_arrive(spark, tmp_path, files):
    import pyarrow.parquet as pq

    ids = spark.range(9).withColumnRenamed("id", "event_id")
    if files == 1:
        pq.write_table(ids.toArrow(), str(tmp_path / "events.parquet"))
    else:
        ids.repartition(files).write.parquet(str(tmp_path / "events.parquet"))
    spark.range(4).withColumnRenamed("id", "event_id").write.parquet(str(tmp_path / "pages.parquet"))
    stream = arriving(Views(spark, str(tmp_path)), "events")
    found = streams.run_to_table(stream.groupBy().agg(F.count("*").alias("n"), F.sum("event_id").alias("s")), "complete")
    assert rows(found) == [(9, 36)]


def test_late_requests_are_dropped(spark, tmp_path):
    ddl = "ts TIMESTAMP, route STRING, status INT, duration_ns BIGINT"
    batches = [
        [(at(1), "a", 200, 1_000_000), (at(2), "a", 500, 20_000_000)],
        [(at(30), "a", 200, 1)],
        [(at(31), "b", 200, 1)],
        [(at(3), "a", 200, 1), (at(31), "a", 200, 1)],
        [(at(90), "a", 200, 1)],
    ]
    stream = streams.request_metrics_stream(feed(spark, tmp_path, batches, ddl), "10 minutes", "5 minutes")
    found = streams.run_to_table(stream)
    assert rows(found, "window_start", "status_class", "requests", "errors") == [
        (at(0), "2xx", 1, 0), (at(0), "5xx", 1, 1), (at(30), "2xx", 1, 0), (at(30), "2xx", 2, 0),
    ]


def test_replays_are_dropped_across_batches(spark, tmp_path):
    ddl = "submission_id INT, kind STRING, key STRING, digest STRING, at TIMESTAMP"
    batches = [[(1, "run", "k", "d", at(0))], [(2, "run", "k", "d", at(1)), (3, "run", "z", "d", at(1))]]
    stream = streams.first_submissions_stream(feed(spark, tmp_path, batches, ddl), "1 hour")
    assert rows(streams.run_to_table(stream), "submission_id", "key") == [(1, "k"), (3, "z")]


def test_lifecycle_remembers_the_previous_batch(spark, tmp_path):
    ddl = "job_id STRING, seq BIGINT, at TIMESTAMP, status STRING, error_code STRING, attempt_count INT, max_attempts INT"
    batches = [
        [("a", 1, at(0), "queued", None, 0, 2)],
        [("a", 2, at(1), "running", None, 1, 2), ("b", 1, at(1), "queued", None, 0, 2)],
        [("a", 3, at(0), "canceled", None, 1, 2), ("b", 2, at(2), "running", None, 1, 2)],
    ]
    found = streams.run_to_table(streams.lifecycle_stream(feed(spark, tmp_path, batches, ddl)))
    assert rows(found.filter("code IS NOT NULL"), "job_id", "seq", "code") == [
        ("a", 3, "illegal_transition"), ("a", 3, "time_moved_back"),
    ]
    last = found.filter("code IS NULL").groupBy("job_id").agg(F.max_by("status", "seq").alias("s"))
    assert rows(last) == [("a", "canceled"), ("b", "running")]


def test_leases_expire_between_and_inside_batches(spark, tmp_path):
    ddl = "holder STRING, ts TIMESTAMP"
    batches = [
        [("a", at(0)), ("b", at(0)), ("b", at(20))],
        [("a", at(8)), ("c", at(25))],
        [("c", at(60))],
        [("c", at(65))],
    ]
    found = streams.run_to_table(streams.lease_watch_stream(feed(spark, tmp_path, batches, ddl), 600, "30 minutes"))
    got = {(r.holder, datetime.utcfromtimestamp(r.deadline_ms / 1000)) for r in found.collect()}
    assert got == {("b", at(10)), ("b", at(30)), ("a", at(18)), ("c", at(35))}


def test_gates_follow_the_evidence(spark, tmp_path):
    ddl = "run_id STRING, case_id STRING, slices ARRAY<STRING>, metric STRING, status STRING, value DOUBLE"

    def row(run, case, value):
        return (run, case, ["a/x"], "m", "scored", value)

    batches = [
        [row("base", "c1", 1.0), row("cand", "c1", 1.0)],
        [row("base", "c2", 1.0), row("cand", "c2", 0.0)],
    ]
    pairs = spark.createDataFrame([("p", "base", "cand", "r")], "pair_id STRING, baseline_run STRING, candidate_run STRING, policy STRING")
    gates = spark.createDataFrame(
        [("r", 0, "m", None, "higher_is_better", 0.9, 0.0)],
        "policy STRING, position INT, metric STRING, slice STRING, direction STRING, threshold DOUBLE, allowed_regression DOUBLE",
    )
    out = str(tmp_path / "out")
    writer = streams.gates_stream(feed(spark, tmp_path, batches, ddl), pairs, gates, out, str(tmp_path / "check"))
    writer.trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(out)
    assert rows(found, "batch", "status", "candidate_mean") == [(0, "passed", 1.0), (1, "failed", 0.5)]


def drained(stream, tmp_path):
    """Rows of a stream and the rows that its state holds at the end."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check"))
    query = query.trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / "out")), held


def shuffled(rng, data, minute, width, count):
    """Rows in an order in which none comes more than ``width`` minutes of time late, cut into batches."""
    late = sorted(data, key=lambda row: row[minute] + rng.uniform(0, width))
    cuts = sorted(rng.sample(range(1, len(late)), count - 1))
    return [late[a:b] for a, b in zip([0, *cuts], [*cuts, len(late)])]


def timed(batches, place):
    return [[(*row[:place], at(row[place]), *row[place + 1 :]) for row in batch] for batch in batches]


@pytest.mark.parametrize("seed", [1, 2])
def test_ordered_lifecycle_equals_the_batch_form_and_forgets(spark, tmp_path, seed):
    rng = random.Random(seed)
    ddl = "job_id STRING, seq BIGINT, at TIMESTAMP, status STRING, error_code STRING, attempt_count INT, max_attempts INT"
    data, seq = [], 0
    for minute in range(0, 120, 2):
        seq += 1
        status = rng.choice(["queued", "running", "cancel_requested", "succeeded", "failed", "canceled"])
        back = rng.choice([0, 0, 0, 4])  # time moves back by less than the delay
        data.append((f"j{rng.randrange(4)}", seq, minute - back, status, rng.choice([None, "e"]), rng.randrange(4), 2))
    data += [(f"j{k}", 1000 + k, 125, "canceled", None, 1, 2) for k in range(4)]
    expected = oplog.lifecycle_violations(spark.createDataFrame(timed([data], 2)[0], ddl))
    batches = timed(shuffled(rng, data, 2, 10, 5), 2)
    batches += [[("end", 2000, at(300), "canceled", None, 0, 2)], [("end", 2001, at(900), "canceled", None, 0, 2)]]
    batches += [[("later", 2002, at(2000), "queued", None, 0, 2)], [("later", 2003, at(3000), "queued", None, 0, 2)]]
    stream = reordered.ordered_lifecycle_stream(feed(spark, tmp_path, batches, ddl), "20 minutes", "1 hour")
    found, held = drained(stream, tmp_path)
    jobs = found.filter("job_id LIKE 'j%'")
    assert rows(jobs.filter("code IS NOT NULL"), "job_id", "seq", "code") == rows(expected, "job_id", "seq", "code")
    assert jobs.filter("code IS NULL").groupBy("job_id").agg(F.max_by("status", "seq").alias("s")).filter("s = 'canceled'").count() == 4
    # What is left is of the job that spoke last: rows that wait, what is known of it and its timer.
    assert held <= 8


def test_state_of_finished_jobs_returns_to_zero(spark, tmp_path):
    ddl = "job_id STRING, seq BIGINT, at TIMESTAMP, status STRING, error_code STRING, attempt_count INT, max_attempts INT"
    few = [(f"j{k}", k, at(k / 100), "queued", None, 0, 2) for k in range(40)] + [(f"j{k}", 100 + k, at(5), "canceled", None, 0, 2) for k in range(40)]
    ends = [[("x", 1, at(100 * k), "canceled", None, 0, 2)] for k in range(1, 4)]
    query = reordered.ordered_lifecycle_stream(feed(spark, tmp_path, [few, *ends], ddl), "1 minutes", "10 minutes").writeStream.format("noop")
    query = query.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(held) >= 80 and held[-1] <= 8


def test_late_and_passed_rows_are_named(spark, tmp_path):
    ddl = "job_id STRING, seq BIGINT, at TIMESTAMP, status STRING, error_code STRING, attempt_count INT, max_attempts INT"
    batches = [[("a", 5, at(0), "queued", None, 0, 2)], [("a", 6, at(100), "running", None, 1, 2)],
               [("b", 1, at(101), "queued", None, 0, 2)], [("a", 4, at(102), "queued", None, 0, 2)], [("b", 2, at(200), "running", None, 1, 2)]]
    found, _ = drained(reordered.ordered_lifecycle_stream(feed(spark, tmp_path, batches, ddl), "5 minutes"), tmp_path)
    assert rows(found.filter("code IS NOT NULL"), "job_id", "seq", "code") == [("a", 4, "late")]


@pytest.mark.parametrize("seed", [3, 4])
def test_submission_outcomes_equal_the_batch_form(spark, tmp_path, seed):
    rng = random.Random(seed)
    ddl = "submission_id BIGINT, kind STRING, key STRING, digest STRING, at TIMESTAMP"
    data = [(k, "run", f"k{rng.randrange(6)}", f"d{rng.randrange(2)}", rng.randrange(60)) for k in range(60)]
    everything = spark.createDataFrame(timed([data], 4)[0], ddl)
    later = oplog.idempotency_conflicts(everything)
    conflicts = rows(later.filter("outcome = 'conflict'"), "submission_id", "outcome")
    firsts = rows(everything.join(later, "submission_id", "left_anti").selectExpr("submission_id", "'first' AS outcome"))
    batches = timed(shuffled(rng, data, 4, 15, 5), 4)
    batches += [[(1000 + k, "end", "end", "d", at(200 * k))] for k in range(1, 5)]
    stream = reordered.submission_outcomes_stream(feed(spark, tmp_path, batches, ddl), "20 minutes", "1 hour")
    found, held = drained(stream, tmp_path)
    assert rows(found.filter("kind = 'run'"), "submission_id", "outcome") == sorted(conflicts + firsts, key=str)
    assert held <= 8


def test_a_key_is_free_again_after_it_was_kept(spark, tmp_path):
    ddl = "submission_id BIGINT, kind STRING, key STRING, digest STRING, at TIMESTAMP"
    batches = [[(1, "run", "k", "d", at(0))], [(2, "run", "k", "e", at(30))], [(3, "run", "x", "e", at(300))],
               [(4, "run", "k", "f", at(310))], [(5, "run", "y", "e", at(600))], [(6, "run", "y", "e", at(900))]]
    found, _ = drained(reordered.submission_outcomes_stream(feed(spark, tmp_path, batches, ddl), "10 minutes", "2 hours"), tmp_path)
    assert rows(found, "submission_id", "outcome")[:4] == [(1, "first"), (2, "conflict"), (3, "first"), (4, "first")]


@pytest.mark.parametrize("buckets", [1, 8])
def test_keys_of_a_bucket_share_a_timer_and_are_judged_and_forgotten_one_by_one(spark, tmp_path, monkeypatch, buckets):
    monkeypatch.setattr(reordered, "BUCKETS", buckets)
    monkeypatch.setattr(reordered, "AT_ONCE", 7)
    ddl = "submission_id BIGINT, kind STRING, key STRING, digest STRING, at TIMESTAMP"
    first = [(k, "run", f"k{k}", "d", at(k)) for k in range(100)] + [(100, "run", None, "d", at(50)), (101, "run", None, "e", at(51))]
    again = [(1000 + k, "run", f"k{k}", "e", at(130 + k)) for k in range(100)]
    ends = [[(2000 + k, "end", f"e{k}", "d", at(400 * k))] for k in range(1, 4)]
    stream = reordered.submission_outcomes_stream(feed(spark, tmp_path, [first, again, *ends], ddl), "10 minutes", "140 minutes")
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check"))
    query = query.trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    states = [p["stateOperators"][0] for p in query.recentProgress]
    assert max(s["customMetrics"]["numRegisteredTimers"] for s in states) <= 2 * buckets  # one is set anew in a batch
    assert states[-1]["numRowsTotal"] <= 8
    outcomes = {r["submission_id"]: r["outcome"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert outcomes == (
        {k: "first" for k in range(101)} | {101: "conflict"} | {1000 + k: "conflict" for k in range(100)} | {2001: "first", 2002: "first"}
    )


OBSERVED = "run_id STRING, case_id STRING, slices ARRAY<STRING>, metric STRING, status STRING, value DOUBLE"
GATES = "policy STRING, position INT, metric STRING, slice STRING, direction STRING, threshold DOUBLE, allowed_regression DOUBLE"


def evidence(spark):
    pairs = spark.createDataFrame(
        [("p", "base", "one", "r"), ("q", "base", "two", "r"), ("n", "none", "two", "r")],
        "pair_id STRING, baseline_run STRING, candidate_run STRING, policy STRING",
    )
    gates = spark.createDataFrame(
        [("r", 0, "m", None, "higher_is_better", 0.5, 0.1), ("r", 1, "m", "a/x", "higher_is_better", 0.5, 0.2),
         ("r", 2, "n", "a/y", "lower_is_better", 0.4, 0.0), ("r", 3, "m", "a/z", "lower_is_better", 0.4, 0.0)], GATES,
    )
    return pairs, gates


def observed(rng, run, case, metric):
    status = rng.choice(["scored", "scored", "scored", "skipped", "error"])
    return (run, f"c{case}", rng.choice([["a/x"], ["a/y"], ["a/x", "a/y"]]), metric, status, rng.random() if status == "scored" else None)


@pytest.mark.parametrize("whole_every", [2])
def test_incremental_gates_equal_the_batch_form_after_every_batch(spark, tmp_path, whole_every):
    rng = random.Random(whole_every)
    pairs, gates = evidence(spark)
    path = str(tmp_path / "state")
    changes = incremental.GateChanges(pairs, gates, path, whole_every)
    seen = []
    for batch_id in range(5):
        runs = ["base", "one", "two"] if batch_id < 2 else [rng.choice(["one", "two"])]
        data = [observed(rng, rng.choice(runs), rng.randrange(30), rng.choice("mn")) for _ in range(12)]
        seen += data
        for _ in range(2 if batch_id in (1, 3, 4) else 1):  # a repeated batch changes nothing
            changes.merge(spark.createDataFrame(data, OBSERVED), batch_id)
        whole = spark.createDataFrame(seen, OBSERVED)
        summary = aggregates.slice_summary(whole)
        fields = ("run_id", "metric", "slice", "attempted", "scored", "skipped", "errors", "mean")
        assert rows(incremental.current_totals(spark, path), *fields) == rows(summary, *fields)
        expected = gate_results(aggregates.aggregate_comparison(summary, pairs), gates, pairs)
        fields = ("pair_id", "position", "baseline_mean", "candidate_mean", "delta", "failure_codes", "status")
        assert rows(incremental.current_gates(spark, path, pairs, gates), *fields) == rows(expected, *fields)


def test_only_gates_of_changed_slices_are_written(spark, tmp_path):
    pairs, gates = evidence(spark)
    path = str(tmp_path / "state")
    changes = incremental.GateChanges(pairs, gates, path)
    both = [(run, "c1", ["a/x"], metric, "scored", 1.0) for run in ("base", "one", "two") for metric in "mn"]
    changes.merge(spark.createDataFrame(both, OBSERVED), 0)
    changes.merge(spark.createDataFrame([("one", "c2", ["a/y"], "n", "scored", 0.1)], OBSERVED), 1)
    assert rows(spark.read.parquet(f"{path}/gates/version=1"), "pair_id", "position") == [("p", 2)]


def test_finished_runs_leave_once_no_pair_needs_them(spark, tmp_path):
    pairs, gates = evidence(spark)
    path, ended = str(tmp_path / "state"), []

    def finished(session):
        return session.createDataFrame([(run,) for run in ended], "run_id STRING")

    changes = incremental.GateChanges(pairs, gates, path, whole_every=1, finished=finished)
    for batch_id, gone in enumerate([[], ["one", "base"], ["two", "none"], []]):
        ended += gone
        data = [(run, f"c{batch_id}", ["a/x"], "m", "scored", 1.0) for run in ("base", "one", "two")]
        changes.merge(spark.createDataFrame(data, OBSERVED), batch_id)
        runs = {r["run_id"] for r in incremental.current_totals(spark, path).collect()}
        # The baseline stays while the pair with the unfinished candidate needs it.
        assert runs == [{"base", "one", "two"}, {"base", "two"}, set(), set()][batch_id]
    last = incremental.current_gates(spark, path, pairs, gates).filter("position = 0")
    assert rows(last, "pair_id", "candidate_attempted") == [("n", 2), ("p", 1), ("q", 2)]


def test_gate_changes_from_a_stream(spark, tmp_path):
    rng = random.Random(9)
    pairs, gates = evidence(spark)
    batches = [[observed(rng, run, case, "m") for run in ("base", "one")] for case in range(4)]
    out = str(tmp_path / "state")
    writer = incremental.gate_changes_stream(feed(spark, tmp_path, batches, OBSERVED), pairs, gates, out, str(tmp_path / "check"))
    writer.trigger(availableNow=True).start().awaitTermination()
    whole = spark.createDataFrame([row for batch in batches for row in batch], OBSERVED)
    fields = ("run_id", "slice", "attempted", "mean")
    assert rows(incremental.current_totals(spark, out), *fields) == rows(aggregates.slice_summary(whole), *fields)

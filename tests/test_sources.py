import json

import pytest
from helpers import rows
from pyspark.sql import functions as F

from gaugework.operators import checks, fingerprint, joins, publication, sets
from gaugework.sources import cases as src
from gaugework.sources import arrivals, evidence, policies, responses

GOOD = {"case_id": "c1", "input": {"q": "x"}, "expected": {"b": 1, "a": [1.0, "ß"]}, "slices": ["z", "a"]}


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_reading_keeps_good_cases_and_codes_the_rest(spark, tmp_path):
    path = write(
        tmp_path / "cases.jsonl",
        json.dumps(GOOD),
        "",
        "   ",
        "{oops",
        '{"case_id":"c2","case_id":"c3","input":1}',
        '{"case_id":"c4","input":NaN}',
        "[1]",
        json.dumps({"case_id": "c5", "input": 1, "surprise": True}),
        json.dumps({"case_id": "c 6", "input": 1}),
        json.dumps({"case_id": "c7", "input": 1, "expected": None, "expected_refusal": True}),
        json.dumps({**GOOD, "input": "other"}),
        json.dumps({"case_id": "c8", "input": 1, "expected": True, "numeric_tolerance": 0.1}),
        json.dumps({"case_id": "c9", "input": 1, "expected": 2, "numeric_tolerance": 0.1}),
        json.dumps({"case_id": "c10", "input": 1, "expected_schema": [1]}),
        json.dumps({"case_id": "c11", "input": 1, "slices": ["a", "a"]}),
        json.dumps({"case_id": "c12", "input": 1, "schema_version": "2"}),
        json.dumps({"case_id": 13, "input": 1}),
        json.dumps({"case_id": "c14"}),
    )
    cases, rejects = src.read_cases(spark, path, "d", 3)
    found = {r.case_id: r for r in cases.collect()}
    assert set(found) == {"c1", "c7", "c9"}
    assert found["c1"].expected == '{"a":[1,"ß"],"b":1}' and found["c1"].slices == ["a", "z"]
    assert found["c7"].expected is None and found["c7"].expected_refusal and found["c7"].dataset_revision == 3
    assert found["c9"].numeric_tolerance == 0.1
    codes = sorted(r.code for r in rejects.collect())
    assert codes == sorted(
        ["invalid_json", "duplicate_key", "non_finite_number", "case_not_object", "duplicate_case_id"] + ["invalid_case"] * 8
    )


def test_files_that_arrive_are_parsed_once_and_repeats_change_nothing(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    batches = [[GOOD, {**GOOD, "case_id": "c2"}], [{**GOOD, "input": "other"}, {**GOOD, "case_id": "c3"}, {**GOOD, "case_id": "c3"}], [{**GOOD, "case_id": "c2"}]]
    for number, batch in enumerate(batches):
        write(source / f"{number}.jsonl", "{oops", "", *map(json.dumps, batch))
        writer = arrivals.arriving_cases(spark, str(source), out, "d", 3, str(tmp_path / "check"))
        writer.trigger(availableNow=True).start().awaitTermination()
    table = arrivals.CaseTable(spark, out, "d", 3)

    def state():
        return rows(table.cases(), "case_id", "input", "dataset_revision"), sorted(r["code"] for r in table.rejects().collect())

    first = state()
    assert [c[0] for c in first[0]] == ["c1", "c2", "c3"] and first[0][0][1] == json.dumps(GOOD["input"], separators=(",", ":"), ensure_ascii=False)
    assert first[1] == ["duplicate_case_id"] * 3 + ["invalid_json"] * 3
    table.take(src.read_lines(spark, str(source / "1.jsonl")), 1)
    assert state() == first


def test_one_pass_equals_the_two_tables(spark, tmp_path):
    path = write(tmp_path / "cases.jsonl", json.dumps(GOOD), json.dumps({**GOOD, "case_id": "c 6"}), json.dumps(GOOD), "[1]")
    cases, rejects = src.read_cases(spark, path, "d", 1)
    table = arrivals.ingest_cases(spark, path, str(tmp_path / "out"), "d", 1)
    assert rows(table.cases()) == rows(cases) and rows(table.rejects(), "code") == rows(rejects, "code")


def test_bom_and_empty_files(spark, tmp_path):
    path = write(tmp_path / "bom.jsonl", "﻿" + json.dumps(GOOD))
    assert [r.code for r in src.read_cases(spark, path, "d", 1)[1].collect()] in (["bom"], [])
    empty = write(tmp_path / "empty.jsonl", "", "  ")
    assert [r.code for r in src.read_cases(spark, empty, "d", 1)[1].collect()] == ["empty_dataset"]


def test_round_trip_keeps_content(spark, tmp_path):
    data = [
        ("d", 1, f"c{i}", json.dumps({"t": f"line\n{i} \"ß\""}), None if i % 3 == 0 else str(i), i % 2 == 0, None,
         0.5 if i % 3 else None, ["b", "a"])
        for i in range(50)
    ]
    ddl = (
        "dataset_name STRING, dataset_revision INT, case_id STRING, input STRING, expected STRING, expected_refusal BOOLEAN, "
        "expected_schema STRING, numeric_tolerance DOUBLE, slices ARRAY<STRING>"
    )
    cases = src.split_cases  # noqa: F841
    df = checks.normalize_slices(spark.createDataFrame(data, ddl))
    df = df.withColumn("input", F.to_json(F.parse_json("input")))
    out = str(tmp_path / "out")
    src.write_cases(df, out)
    back, rejects = src.read_cases(spark, out, "d", 1)
    assert rejects.count() == 0
    assert rows(back) == rows(df)
    assert rows(fingerprint.dataset_digest(back)) == rows(fingerprint.dataset_digest(df))


def test_recorded_responses(spark, tmp_path):
    body = {"status": "answered", "answer": "a", "executions": [{"sql": "SELECT 1", "columns": ["x"], "row_count": 1, "truncated": False, "duration_ms": 1.0}],
            "duration_ms": 4.0, "request_id": "r", "model_duration_ms": 3.0, "tool_call_count": 1, "input_tokens": 7, "output_tokens": 2}
    lines = [
        {"case_id": "q", "status": 200, "body": body},
        {"case_id": "empty", "status": 200, "body": {**body, "executions": []}},
        {"case_id": "ask", "status": 200, "body": {**body, "status": "clarification_required", "executions": []}},
        {"case_id": "no", "status": 403},
        {"case_id": "busy", "status": 429},
    ]
    path = write(tmp_path / "r.jsonl", *[json.dumps(x) for x in lines])
    found = {r.case_id: r for r in responses.read_responses(spark, path, "run").collect()}
    assert json.loads(found["q"].output) == {"kind": "query", "schema_version": "1", "sql_executions": ["SELECT 1"]}
    assert found["empty"].failure_code == "target_protocol_error"
    assert json.loads(found["ask"].output)["clarification_code"] == "provider_clarification"
    assert (found["no"].outcome, found["no"].refusal_code, found["no"].input_units) == ("refused", "policy_block", 0)
    assert (found["busy"].failure_code, found["busy"].retryable) == ("target_rate_limited", True)


@pytest.mark.parametrize(
    "status, code, retry",
    [(200, None, False), (401, "target_authentication", False), (408, "target_timeout", True), (504, "target_timeout", True),
     (429, "target_rate_limited", True), (500, "target_unavailable", True), (404, "target_rejected", False), (302, "target_protocol_error", False)],
)
def test_status_codes(spark, status, code, retry):
    row = responses.classify_status(spark.createDataFrame([(status,)], "status INT")).first()
    assert (row.failure_code, row.retryable) == (code, retry)


def test_policies(spark, tmp_path):
    policy = {"name": "p", "gates": [
        {"metric": "m.a", "direction": "higher_is_better", "threshold": 0.5},
        {"metric": "m.a", "direction": "higher_is_better", "threshold": 0.6, "slice": "a/b", "allowed_regression": 0.1},
        {"metric": "m.a", "direction": "higher_is_better", "threshold": 0.7}]}
    path = write(tmp_path / "p.json", json.dumps(policy, indent=1))
    gates = policies.read_policy(spark, path)
    assert rows(gates, "position", "slice", "allowed_regression") == [(0, None, 0.0), (1, "a/b", 0.1), (2, None, 0.0)]
    assert rows(policies.policy_violations(gates), "metric", "code") == [("m.a", "duplicate_gate")]


def test_publish_once(spark, tmp_path):
    path = str(tmp_path / "table")
    first = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "2")], "key STRING, digest STRING")
    assert rows(evidence.publish_once(spark, first, path, ["key"]), "key", "action") == [("a", "append"), ("b", "append")]
    second = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "3"), ("d", "4"), ("d", "5")], "key STRING, digest STRING")
    labels = evidence.append_once(second, spark.read.parquet(path), ["key"])
    assert rows(labels, "key", "action") == [("a", "identical"), ("b", "conflict"), ("c", "append"), ("d", "conflict")]
    evidence.publish_once(spark, second, path, ["key"])
    assert rows(spark.read.parquet(path), "key", "digest") == [("a", "1"), ("b", "2"), ("c", "3")]


def test_file_manifest(spark, tmp_path):
    import hashlib

    write(tmp_path / "x.jsonl", "{}", "", "{}")
    row = evidence.file_manifest(spark, str(tmp_path)).first()
    assert (row["name"], row["records"]) == ("x.jsonl", 2)
    assert row["sha256"] == hashlib.sha256((tmp_path / "x.jsonl").read_bytes()).hexdigest()


def test_backfill_never_infers_pins(spark):
    docs = [
        ("r1", json.dumps({"suite": {"name": "s", "revision": 2}, "target": {"name": "t", "revision": 1},
                           "cases": [{"target": {"response": {"usage": {"input_units": 3, "output_units": 4}}}}, {"target": None}]})),
        ("r2", json.dumps({"suite": None, "target": {"name": "t", "revision": 1}, "cases": []})),
    ]
    found = evidence.backfill_columns(spark.createDataFrame(docs, "run_id STRING, document STRING"))
    assert rows(found, "run_id", "input_units", "output_units", "suite_name", "target_name") == [
        ("r1", 3, 4, "s", "t"), ("r2", 0, 0, None, None),
    ]


def test_overlay(spark):
    ddl = "run_id STRING, case_id STRING, output STRING"
    base = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2")], ddl)
    over = spark.createDataFrame([("o", "b", None), ("o", "z", "9")], ddl)
    assert rows(joins.overlay(base, over)) == [("o", "b", None), ("r", "a", "1")]
    cases = spark.createDataFrame([("a",), ("c",)], "case_id STRING")
    assert rows(joins.overlay_violations(cases, base, over)) == [
        ("b", "unexpected_response"), ("c", "missing_response"), ("z", "unknown_override"),
    ]


def test_fingerprints_ignore_order_and_count_copies(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id")).cast("string").alias("b"))
    digest = rows(fingerprint.table_fingerprint(df))
    assert rows(fingerprint.table_fingerprint(df.repartition(7).orderBy("b"))) == digest
    assert rows(fingerprint.table_fingerprint(df.unionByName(df.limit(1)))) != digest
    changed = df.withColumn("b", F.when(F.col("b") == "499", "498").otherwise(F.col("b")))
    assert rows(fingerprint.table_fingerprint(changed)) != digest
    swapped = df.withColumn("b", F.coalesce("b", F.lit("-")))
    assert rows(fingerprint.table_fingerprint(swapped)) != digest


def test_multisets_count_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x INT")
    b = spark.createDataFrame([(1,), (2,), (2,)], "x INT")
    assert rows(sets.multiset_difference(a, b, ["x"])) == [(1, 2, 1), (2, 1, 2)]
    assert rows(sets.multiset_equal(a, a, ["x"])) == [(True, 0)]
    assert rows(sets.set_equal(a, b, ["x"])) == []


@pytest.mark.parametrize(
    "text, kind",
    [
        ("write to jane.doe+x@example.co.uk.", "email address"),
        ("not an@address", None),
        ("see HTTPS://example.com/a", "URL"),
        ("www.example.com", "URL"),
        ("awww.example", None),
        ("mailto:someone", "URL"),
        ("-----BEGIN RSA PRIVATE KEY-----", "credential"),
        ("AKIA" + "A1" * 8, "credential"),
        ("ghp_" + "a" * 20, "credential"),
        ("xoxb-123456789012", "credential"),
        ("sk-" + "live_" + "a" * 16, "credential"),
        ("task-" + "a" * 20, None),
        ("Bearer abcdefgh12", "credential"),
        ("API key = 123", "credential"),
        ("Password: hunter2", "credential"),
        ("the password is long", None),
        ("éAKIA" + "A1" * 8, "credential"),
    ],
)
def test_unsafe_texts(spark, text, kind):
    assert spark.range(1).select(publication.unsafe_kind(F.lit(text)).alias("k")).first().k == kind


def test_denied_names(spark):
    df = spark.createDataFrame(
        [("1", "x", '{"a":{"PassWord":1}}')], "id STRING, User_Id STRING, doc STRING"
    ).withColumn("meta", F.struct(F.lit(1).alias("prompt"), F.lit(2).alias("input_units")))
    found = publication.publication_audit(df, "id", json_columns=["doc"])
    assert rows(found, "path", "kind") == [("User_Id", "denied key"), ("doc", "denied key"), ("meta.prompt", "denied key")]
    assert len(publication.DENIED_KEYS) == len(set(publication.DENIED_KEYS)) == 105


@pytest.mark.parametrize(
    ("doc", "kinds"),
    [
        (r'{"password":"x"}', {"denied key"}), (r'{"a":"http:\/\/evil.example\/x"}', {"URL"}),
        (r'{"a":["me@example.com"]}', {"email address"}), (r'{"a":"fine \\u0040 and 😀"}', set()),
        (r'{"a":"xoxb-123456789-_"}', {"credential"}), ("{\"a\":\"éwww.example.com\"}", {"URL"}), (None, set()),
    ],
)
def test_escaped_json_is_decoded(spark, doc, kinds):
    df = spark.createDataFrame([(1, doc)], "id INT, doc STRING")
    assert {r.kind for r in publication.publication_audit(df, "id", json_columns=["doc"]).collect()} == kinds


def test_names_of_audited_columns_and_map_keys(spark):
    df = spark.createDataFrame([(1, "ok", {"Token": "x"}), (2, "ok", {"k": "v"})], "id INT, prompt STRING, extra MAP<STRING, STRING>")
    assert rows(publication.publication_audit(df, "id", ["prompt"])) == [
        ("1", "extra", "denied key"), ("1", "prompt", "denied key"), ("2", "prompt", "denied key"),
    ]


def test_manifest_of_equal_names_in_folders(spark, tmp_path):
    for folder, lines in (("k=1", ["a"]), ("k=2", ["a", "b"])):
        (tmp_path / "out" / folder).mkdir(parents=True)
        write(tmp_path / "out" / folder / "part-0 +x.txt", *lines)
    found = {r.name: (r.bytes, r.records) for r in evidence.file_manifest(spark, str(tmp_path / "out")).collect()}
    assert found == {"k=1/part-0 +x.txt": (2, 1), "k=2/part-0 +x.txt": (4, 2)}


def test_cases_from_files_join_runs_on_a_key(spark, tmp_path):
    lines = [json.dumps({"case_id": f"c{k}", "input": {"q": "x"}, "expected": "a", "slices": ["a/x"]}) for k in range(3)]
    cases, _ = src.read_cases(spark, write(tmp_path / "cases.jsonl", *lines), "d", 2)
    runs = spark.createDataFrame([("r1", "d", 2), ("r2", "d", 2), ("r3", "d", 1)], "run_id STRING, dataset_name STRING, dataset_revision INT")
    answers = spark.createDataFrame(
        [], "run_id STRING, case_id STRING, output STRING, outcome STRING, refusal_code STRING, input_units BIGINT, "
        "output_units BIGINT, latency_ms DOUBLE, failure_code STRING, retryable BOOLEAN",
    )
    attached = joins.attach_responses(cases, answers, runs)
    assert rows(attached, "run_id", "case_id") == [(r, f"c{k}") for r in ("r1", "r2") for k in range(3)]
    for threshold in ("10485760", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        plan = joins.attach_responses(cases, answers, runs)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lineitem_queries_read_every_column(spark, tmp_path, monkeypatch):
    from gaugework.plans import catalog

    data = "/root/testdata/sf0.001"
    lineitem = spark.read.parquet(f"{data}/lineitem.parquet")
    edited = lineitem.withColumn("l_extendedprice", F.expr("l_extendedprice + if(l_orderkey = 1, 1, 0)"))
    assert sets.multiset_equal(lineitem, edited, lineitem.columns).first()["equal"] is False
    edited.write.parquet(str(tmp_path / "lineitem.parquet"))
    plan = catalog.QUERIES["table_fingerprint_all"]
    assert plan(spark, data).collect() != plan(spark, str(tmp_path)).collect()
    read = []
    for module, name in ((fingerprint, "table_fingerprint"), (sets, "multiset_equal"), (sets, "multiset_difference")):
        def kept(*args, real=getattr(module, name)):
            read.append({c for a in args if isinstance(a, (list, tuple)) for c in a})
            return real(*args)

        monkeypatch.setattr(module, name, kept)
    for query in ("changed_content", "multiset_equal", "multiset_equal_all", "multiset_difference_all"):
        catalog.QUERIES[query](spark, data)
    assert len(read) >= 5 and all(r == set(lineitem.columns) for r in read)


def _shuffles_follow_the_input(spark, tmp_path, monkeypatch, names):
    from gaugework.plans import catalog, evidence_queries

    found = []
    spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "l_orderkey BIGINT, l_suppkey BIGINT, l_comment STRING").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(evidence_queries, "spread_tasks", lambda rows: 37)
    monkeypatch.setattr(sets, "multiset_equal", lambda a, b, keys: found.append(b.rdd.getNumPartitions()))
    for name in names:
        catalog.QUERIES[name](spark, str(tmp_path))
    return found


def test_the_shuffled_copy_has_tasks_by_size(spark, tmp_path, monkeypatch):
    assert _shuffles_follow_the_input(spark, tmp_path, monkeypatch, ["multiset_equal", "multiset_equal_all"]) == [37, 37]


def test_arriving_case_files_grow_in_number_and_not_in_size(spark, monkeypatch):
    import os

    from gaugework.plans import catalog, source_queries

    seen = []
    kept = arrivals.arriving_cases

    def watched(session, source, *more, files_at_once):
        seen.append((len([n for n in os.listdir(source) if n.startswith("part-")]), files_at_once))
        return kept(session, source, *more, files_at_once=files_at_once)

    monkeypatch.setattr(source_queries, "spread_tasks", lambda rows: 10)
    monkeypatch.setattr(arrivals, "arriving_cases", watched)
    catalog.QUERIES["arriving_cases"](spark, "/root/testdata/sf0.001").collect()
    assert seen == [(12, 3)]

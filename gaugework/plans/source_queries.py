"""Queries over reading, writing, assembling and fingerprinting evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions import content_digest
from gaugework.operators import fingerprint, gates, merkle, publication
from gaugework.plans.evidence_queries import comparison, gate_cases, results
from gaugework.plans.registry import query
from gaugework.plans.views import Views
from gaugework.schemas import POLICY, RECORDED_RESPONSE
from gaugework.session import scratch_path, spread_small, spread_tasks
from gaugework.sources import cases as case_source
from gaugework.sources import arrivals, evidence, policies, published
from gaugework.sources import responses as response_source


def _quoted(c) -> F.col:
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def raw_lines(v: Views) -> DataFrame:
    """Documents as case lines, some of them broken by rule."""
    doc, kind = F.col("doc_id"), F.col("doc_id") % 20
    text = _quoted(F.col("text"))
    good = F.concat(
        F.lit('{"case_id":"doc-'), F.when(kind == 17, doc - 17).otherwise(doc), F.lit('","input":{"text":'), text,
        F.lit('},"expected":'), F.when(kind == 2, "null").otherwise(F.concat(F.lit("{\"n\": "), "n_chars", F.lit("}"))),
        F.lit(',"slices":["source/'), "source", F.lit('","language/'), "lang", F.lit('"]}'),
    )
    line = (
        F.when(kind == 3, F.concat(F.lit("{not json "), text))
        .when(kind == 5, F.concat(F.lit('{"case_id":"a","case_id":"b","input":'), text, F.lit("}")))
        .when(kind == 7, F.concat(F.lit('{"case_id":"doc-'), doc, F.lit('","numeric_tolerance":NaN,"expected":1,"input":'), text, F.lit("}")))
        .when(kind == 9, F.concat(F.lit("["), text, F.lit("]")))
        .when(kind == 11, F.concat(F.lit('{"case_id":"doc-'), doc, F.lit('","extra":1,"input":'), text, F.lit("}")))
        .when(kind == 13, F.concat(F.lit("\ufeff"), good))
        .when(kind == 15, F.concat(good, F.lit(" trailing")))
        .when(kind == 16, F.concat(F.lit('{"case_id":"doc-'), doc, F.lit('","numeric_tolerance":0.5,"expected":"x","input":'), text, F.lit("}")))
        .when(kind == 18, F.lit("   "))
        .otherwise(good)
    )
    docs = v.spread("documents", "doc_id", "text", "lang", "source", "n_chars")
    return docs.select(F.lit("documents").alias("file"), doc.alias("position"), line.alias("line"))


@query(
    "read_cases",
    """
    SELECT doc_id AS position, CASE doc_id % 20 WHEN 3 THEN 'invalid_json' WHEN 5 THEN 'duplicate_key' WHEN 7 THEN 'non_finite_number'
           WHEN 9 THEN 'case_not_object' WHEN 11 THEN 'invalid_case' WHEN 13 THEN 'bom' WHEN 15 THEN 'invalid_json'
           WHEN 16 THEN 'invalid_case' WHEN 17 THEN 'duplicate_case_id' END AS code
    FROM documents WHERE doc_id % 20 IN (3, 5, 7, 9, 11, 13, 15, 16, 17)""",
)
def _(v):
    _, rejects = case_source.split_cases(raw_lines(v), "documents", 1)
    return rejects.select("position", "code")


@query(
    "accepted_cases",
    """
    SELECT 'doc-' || doc_id AS case_id, CASE WHEN doc_id % 20 <> 2 THEN '{"n":' || n_chars || '}' END AS expected,
           'language/' || lang || ',source/' || source AS slices
    FROM documents WHERE doc_id % 20 NOT IN (3, 5, 7, 9, 11, 13, 15, 16, 17, 18)""",
)
def _(v):
    found, _ = case_source.split_cases(raw_lines(v), "documents", 1)
    return found.select("case_id", "expected", F.array_join("slices", ",").alias("slices"))


@query(
    "arriving_cases",
    """
    SELECT CASE doc_id % 20 WHEN 3 THEN 'invalid_json' WHEN 5 THEN 'duplicate_key' WHEN 7 THEN 'non_finite_number'
           WHEN 9 THEN 'case_not_object' WHEN 11 THEN 'invalid_case' WHEN 13 THEN 'bom' WHEN 15 THEN 'invalid_json'
           WHEN 16 THEN 'invalid_case' WHEN 17 THEN 'duplicate_case_id' ELSE 'accepted' END AS code, count(*) AS lines
    FROM documents WHERE doc_id % 20 <> 18 GROUP BY ALL""",
)
def _(v):
    """Case files in four batches; every line is parsed once."""
    base = scratch_path(v.spark, "arriving")
    # Blank lines first, since a mark at the start of a file is not part of its first line.
    lines = raw_lines(v).select("line")
    at_once = -(-spread_tasks(lines) // 4)
    lines.repartition(4 * at_once).sortWithinPartitions("line").write.text(f"{base}/in")
    writer = arrivals.arriving_cases(v.spark, f"{base}/in", f"{base}/out", "documents", 1, f"{base}/checkpoint", files_at_once=at_once)
    writer.trigger(availableNow=True).start().awaitTermination()
    table = arrivals.CaseTable(v.spark, f"{base}/out", "documents", 1)
    accepted = table.cases().select(F.lit("accepted").alias("code"))
    return accepted.unionByName(table.rejects().select("code")).groupBy("code").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "write_cases",
    """
    SELECT case_id, '{"case_id":"' || case_id || '","expected":' || coalesce(expected, 'null') || ',"expected_refusal":' || expected_refusal
           || ',"expected_schema":null,"input":' || to_json({'text': text}) || ',"numeric_tolerance":null,"schema_version":"1","slices":["'
           || array_to_string(slices, '","') || '"]}' AS line
    FROM v_cases""",
)
def _(v):
    return case_source.case_lines(spread_small(v.cases))


@query("case_round_trip", "SELECT count(*) AS cases, true AS same_content, CAST(0 AS BIGINT) AS rejects FROM documents")
def _(v):
    """Cases written as files and read back; their content digests must agree."""
    path = scratch_path(v.spark, "cases")
    case_source.write_cases(v.cases, path)
    back, rejects = case_source.read_cases(v.spark, path, "documents", 1)
    before = fingerprint.dataset_digest(v.cases).select(F.col("fingerprint").alias("b"))
    after = fingerprint.dataset_digest(back).select("cases", F.col("fingerprint").alias("a"))
    bad = rejects.agg(F.count(F.lit(1)).alias("rejects"))
    facts = after.select("cases", F.col("a").alias("d"), F.lit(0).cast("bigint").alias("rejects"))
    facts = facts.unionByName(before.select(F.lit(0).cast("bigint").alias("cases"), F.col("b").alias("d"), F.lit(0).cast("bigint").alias("rejects")))
    facts = facts.unionByName(bad.select(F.lit(0).cast("bigint").alias("cases"), F.lit(None).cast("string").alias("d"), "rejects"))
    return facts.agg(
        F.max("cases").alias("cases"), (F.min("d") == F.max("d")).alias("same_content"), F.max("rejects").alias("rejects")
    )


@query(
    "read_responses",
    """
    WITH r AS (SELECT *, o_orderkey % 9 AS k FROM orders)
    SELECT 'case-' || o_orderkey AS case_id,
           CASE k WHEN 0 THEN '{"kind":"query","schema_version":"1","sql_executions":["SELECT ' || o_custkey || '"]}'
                  WHEN 1 THEN '{"clarification_code":"provider_clarification","kind":"clarification","schema_version":"1"}'
                  WHEN 2 THEN '{"kind":"refusal","schema_version":"1"}' END AS output,
           CASE WHEN k = 2 THEN 'refused' WHEN k < 2 THEN 'completed' END AS outcome,
           CASE WHEN k = 2 THEN 'policy_block' END AS refusal_code,
           CASE WHEN k = 2 THEN CAST(0 AS BIGINT) WHEN k < 2 THEN o_custkey END AS input_units,
           CASE k WHEN 3 THEN 'target_authentication' WHEN 4 THEN 'target_rate_limited' WHEN 5 THEN 'target_timeout'
                  WHEN 6 THEN 'target_unavailable' WHEN 7 THEN 'target_rejected' WHEN 8 THEN 'target_protocol_error' END AS failure_code,
           k IN (4, 5, 6) AS retryable
    FROM r""",
)
def _(v):
    kind = (F.col("o_orderkey") % 9).cast("int")
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 200, 403, 401, 429, 408, 503, 404, 200)]), kind + 1)
    executions = F.when(kind == 0, F.concat(F.lit('[{"sql":"SELECT '), "o_custkey", F.lit('","columns":["x"],"row_count":1,"truncated":false,"duration_ms":1.0}]'))).otherwise("[]")
    body = F.concat(
        F.lit('{"status":"'), F.when(kind == 1, "clarification_required").otherwise("answered"),
        F.lit('","answer":"a","executions":'), executions,
        F.lit(',"duration_ms":5.0,"request_id":"r","model_duration_ms":4.0,"tool_call_count":1,"input_tokens":'),
        "o_custkey", F.lit(',"output_tokens":3}'),
    )
    line = F.concat(F.lit('{"case_id":"case-'), "o_orderkey", F.lit('","status":'), status, F.when(kind.isin(0, 1, 8), F.concat(F.lit(',"body":'), body)).otherwise(""), F.lit("}"))
    parsed = v.table("orders").select(F.from_json(line, RECORDED_RESPONSE).alias("r")).select("r.*")
    return response_source.normalize_recorded(parsed, "recorded").select(
        "case_id", "output", "outcome", "refusal_code", "input_units", "failure_code", "retryable"
    )


@query(
    "classify_status",
    """
    SELECT event_id, CASE WHEN s = 200 THEN NULL WHEN s = 401 THEN 'target_authentication' WHEN s = 429 THEN 'target_rate_limited'
           WHEN s IN (408, 504) THEN 'target_timeout' WHEN s BETWEEN 500 AND 599 THEN 'target_unavailable'
           WHEN s BETWEEN 400 AND 499 THEN 'target_rejected' ELSE 'target_protocol_error' END AS failure_code,
           s IN (408, 504, 429) OR s BETWEEN 500 AND 599 AS retryable
    FROM (SELECT event_id, CASE WHEN event_type = 'view' THEN 200 ELSE 390 + (event_id * 7) % 220 END AS s FROM events)""",
)
def _(v):
    status = F.when(F.col("event_type") == "view", 200).otherwise(390 + (F.col("event_id") * 7) % 220)
    rows = v.table("events").select("event_id", status.alias("status"))
    return response_source.classify_status(rows).drop("status")


def source_policies(v: Views) -> DataFrame:
    """One policy per language: a gate for each distinct source family of its documents."""
    tag = F.concat(F.lit("source/"), "source")
    pairs = v.table("documents").select("lang", tag.alias("slice")).distinct()
    text = F.concat(
        F.lit('{"name":"'), F.col("lang"), F.lit("|"), F.col("slice"),
        F.lit('","gates":[{"metric":"quality.exact_match","direction":"higher_is_better","threshold":0.75},'
              '{"metric":"quality.exact_match","slice":"'), F.col("slice"),
        F.lit('","direction":"higher_is_better","threshold":0.5,"allowed_regression":0.1}]}'),
    )
    return pairs.select(F.from_json(text, POLICY).alias("p")).select("p.*")


@query(
    "read_policy",
    """
    WITH p AS (SELECT DISTINCT lang || '|source/' || source AS policy, 'source/' || source AS slice FROM documents)
    SELECT policy, 0 AS position, 'quality.exact_match' AS metric, NULL AS slice, 'higher_is_better' AS direction, 0.75::DOUBLE AS threshold, 0.0::DOUBLE AS allowed_regression FROM p
    UNION ALL SELECT policy, 1, 'quality.exact_match', slice, 'higher_is_better', 0.5::DOUBLE, 0.1::DOUBLE FROM p""",
)
def _(v):
    return policies.policy_gates(source_policies(v))


@query(
    "policy_violations",
    """
    WITH p AS (SELECT DISTINCT lang || '|source/' || source AS policy, 'source/' || source AS slice, lang FROM documents)
    SELECT policy, 'quality.exact_match' AS metric, slice, 'duplicate_gate' AS code FROM p WHERE lang = 'en'
    UNION ALL SELECT policy, 'quality.exact_match', NULL, 'invalid_direction' FROM p WHERE lang = 'de'
    UNION ALL SELECT policy, 'quality.exact_match', slice, 'invalid_direction' FROM p WHERE lang = 'de'
    UNION ALL SELECT policy, 'quality.exact_match', slice, 'negative_budget' FROM p WHERE lang = 'fr'""",
)
def _(v):
    rows = policies.policy_gates(source_policies(v))
    copies = rows.filter(F.col("policy").startswith("en|") & F.col("slice").isNotNull())
    broken = rows.withColumn(
        "direction", F.when(F.col("policy").startswith("de|"), "sideways").otherwise(F.col("direction"))
    ).withColumn(
        "allowed_regression",
        F.when(F.col("policy").startswith("fr|") & F.col("slice").isNotNull(), -1.0).otherwise(F.col("allowed_regression")),
    )
    return policies.policy_violations(broken.unionByName(copies))


@query(
    "append_once",
    """
    SELECT o_orderkey AS key, CASE o_orderkey % 5 WHEN 0 THEN NULL ELSE 'd' || o_custkey END AS digest,
           CASE o_orderkey % 5 WHEN 0 THEN 'conflict' WHEN 1 THEN 'identical' ELSE 'append' END AS action
    FROM orders WHERE o_orderkey % 5 <> 4""",
)
def _(v):
    key, digest = F.col("o_orderkey"), F.concat(F.lit("d"), F.col("o_custkey"))
    orders = v.table("orders")
    new = orders.filter(key % 5 != 4).select(key.alias("key"), digest.alias("digest"))
    repeated = new.filter(F.col("key") % 5 == 2)
    existing = orders.filter(key % 5 < 2).select(
        key.alias("key"), F.when(key % 5 == 0, F.lit("other")).otherwise(digest).alias("digest")
    )
    return evidence.append_once(new.unionByName(repeated), existing, ["key"])


@query(
    "publish_once",
    """
    SELECT o_orderkey AS key, CASE o_orderkey % 5 WHEN 0 THEN 'other' ELSE 'd' || o_custkey END AS digest
    FROM orders WHERE o_orderkey % 5 <> 4""",
)
def _(v):
    """Two publications that overlap: what the first one brought stays."""
    key, digest = F.col("o_orderkey"), F.concat(F.lit("d"), F.col("o_custkey"))
    orders = v.table("orders")
    path = scratch_path(v.spark, "published")
    first = orders.filter(key % 5 < 2).select(
        key.alias("key"), F.when(key % 5 == 0, F.lit("other")).otherwise(digest).alias("digest")
    )
    evidence.publish_once(v.spark, first, path, ["key"])
    second = orders.filter(key % 5 != 4).select(key.alias("key"), digest.alias("digest"))
    evidence.publish_once(v.spark, second.unionByName(second.filter(F.col("key") % 5 == 2)), path, ["key"])
    return published.read_published(v.spark, path, second.schema)


@query(
    "file_manifest",
    "SELECT 'gates' AS section, count(*) AS records FROM v_gate_results UNION ALL SELECT 'cases', count(*) FROM v_gate_cases",
)
def _(v):
    """Two exported tables: records per manifest, summed over their files."""
    base = scratch_path(v.spark, "manifest")
    frames = []
    for name, table in (("gates", results(v)), ("cases", gate_cases(v))):
        table.write.json(f"{base}/{name}")
        rows = evidence.file_manifest(v.spark, f"{base}/{name}").filter(F.col("name").startswith("part-"))
        frames.append(rows.agg(F.lit(name).alias("section"), F.sum("records").alias("records")))
    return frames[0].unionByName(frames[1])


@query(
    "export_decision",
    """
    SELECT 'p1' AS pair_id, 'aggregate' AS section, count(*) AS rows FROM v_comparison
    UNION ALL SELECT 'p1', 'gate', count(*) FROM v_gate_results
    UNION ALL SELECT 'p1', 'change_counts', count(*) FROM v_gate_results
    UNION ALL SELECT 'p1', 'newly_failing', count(*) FROM v_gate_cases WHERE change = 'newly_failing' HAVING count(*) > 0
    UNION ALL SELECT 'p1', 'decision', 1""",
)
def _(v):
    found, cases = results(v), gate_cases(v)
    rows = evidence.decision_rows(
        gates.decisions(found, v.pairs), found, gates.change_counts(cases, found), gates.newly_failing(cases), comparison(v)
    )
    path = scratch_path(v.spark, "export")
    evidence.export_decision(rows, path)
    back = v.spark.read.schema("pair_id STRING, body STRING, section STRING").json(path)
    return back.groupBy("pair_id", "section").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "build_cases",
    """
    SELECT 'doc-' || doc_id AS case_id, doc_id % 4 = 3 AS expected_refusal,
           CASE WHEN doc_id % 4 < 2 THEN 'ambiguity/clear,expected/query,language/' || lang || ',query_type/' || source || ',safety/safe'
                WHEN doc_id % 4 = 2 THEN 'ambiguity/' || source || ',expected/clarification,language/' || lang || ',safety/safe'
                ELSE 'ambiguity/clear,expected/refusal,language/' || lang || ',policy/' || source || ',safety/unsafe' END AS slices,
           to_json({'chat_history': '', 'language': lang, 'question': text}) AS input
    FROM documents""",
)
def _(v):
    docs = v.table("documents").select(
        F.col("doc_id"), F.concat(F.lit("doc-"), "doc_id").alias("case_id"), F.col("lang").alias("language"),
        F.col("text").alias("question"), "source",
    )
    kind = F.col("doc_id") % 4
    queries = docs.filter(kind < 2).select(
        "case_id", "language", "question", F.array("source").alias("tags"),
        F.array(F.lit("n")).alias("expected_columns"), F.array(F.array(F.col("doc_id"))).alias("expected_rows"),
        F.lit("SELECT 1").alias("reference_sql"), F.lit(True).alias("ordered"),
    )
    clarifications = docs.filter(kind == 2).select("case_id", "language", "question", F.col("source").alias("code"))
    refusals = docs.filter(kind == 3).select("case_id", "language", "question", F.col("source").alias("policy"))
    built = evidence.build_cases(queries, clarifications, refusals)
    return built.select("case_id", "expected_refusal", F.array_join("slices", ",").alias("slices"), "input")


@query(
    "backfill_columns",
    """
    SELECT run_id, CAST(sum(CASE WHEN failed THEN 0 ELSE units END) AS BIGINT) AS input_units,
           CAST(sum(CASE WHEN failed THEN 0 ELSE 1 END) AS BIGINT) AS output_units,
           CASE WHEN pinned THEN 'suite-' || grp END AS suite_name, CASE WHEN pinned THEN 1 END AS suite_revision,
           CASE WHEN pinned THEN 'target' END AS target_name, CASE WHEN pinned THEN 2 END AS target_revision
    FROM (SELECT 'run-' || l_orderkey AS run_id, l_orderkey % 7 AS grp, l_orderkey % 3 = 0 AS pinned, l_linenumber = 3 AS failed,
                 CAST(l_quantity AS BIGINT) AS units FROM lineitem)
    GROUP BY run_id, pinned, grp""",
)
def _(v):
    """Stored run documents, one per order with one case per line item."""
    usage = F.struct(F.col("l_quantity").cast("bigint").alias("input_units"), F.lit(1).alias("output_units"))
    target = F.when(F.col("l_linenumber") != 3, F.struct(F.struct(usage.alias("usage")).alias("response")))
    grouped = v.table("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(target.alias("target"))).alias("cases"))
    pinned = F.col("l_orderkey") % 3 == 0
    suite = F.when(pinned, F.struct(F.concat(F.lit("suite-"), F.col("l_orderkey") % 7).alias("name"), F.lit(1).alias("revision")))
    ref = F.struct(F.lit("target").alias("name"), F.lit(2).alias("revision"))
    documents = grouped.select(
        F.concat(F.lit("run-"), "l_orderkey").alias("run_id"),
        F.to_json(F.struct(suite.alias("suite"), ref.alias("target"), "cases")).alias("document"),
    )
    return evidence.backfill_columns(documents)


# --- fingerprints ----------------------------------------------------------------
def _lanes(keys: str, text: str, source: str) -> str:
    lanes = ", ".join(
        f"CAST(sum(CAST('0x' || substr(h, {4 * i + 1}, 4) AS BIGINT)) AS VARCHAR)" for i in range(fingerprint.LANES)
    )
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""
    SELECT {lead}count(*) AS rows, 'sha256:' || sha256(concat_ws(',', CAST(count(*) AS VARCHAR), {lanes})) AS fingerprint
    FROM (SELECT {lead}sha256({text}) AS h FROM {source}) {group}"""


def _cell(c: str) -> str:
    return f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def _row(*columns: str) -> str:
    return " || '|' || ".join(_cell(c) for c in columns)


@query("table_fingerprint", _lanes("", _row("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"), "lineitem"))
def _(v):
    columns = ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"]
    return fingerprint.table_fingerprint(v.spread("lineitem", *columns))


LINEITEM = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"
).split()


@query("table_fingerprint_all", _lanes("", _row(*LINEITEM), "lineitem"))
def _(v):
    return fingerprint.table_fingerprint(v.spread("lineitem", "*"))


@query(
    "dataset_digest",
    _lanes(
        "dataset_name, dataset_revision",
        _row("case_id", "to_json({'text': text})", "expected", "expected_refusal") + " || '|-|-|' || " + _cell("array_to_string(slices, ',')"),
        "v_cases",
    ).replace("AS rows", "AS cases"),
)
def _(v):
    return fingerprint.dataset_digest(v.cases)


_OBS_TEXT = (
    _row("case_id", "evaluator", "metric", "status") + " || '|' || " + "coalesce(length(sv) || ':' || sv, '-')"
    + " || '|' || " + _cell("reason") + " || '|' || " + _cell("failure")
)


@query(
    "run_digest",
    f"""
    WITH o AS (SELECT run_id, case_id, evaluator, metric, status, CASE WHEN value IS NOT NULL THEN CAST(CAST(value AS DECIMAL(18,1)) AS VARCHAR) END AS sv,
                 CASE status WHEN 'skipped' THEN 'no_expectation' WHEN 'scored' THEN CASE WHEN evaluator = 'latency' THEN 'observed' WHEN value = 1 THEN 'matched' ELSE 'mismatched' END END AS reason,
                 CASE status WHEN 'error' THEN 'target_timeout' END AS failure FROM v_observations),
         b AS ({_lanes("run_id", _OBS_TEXT, "o")})
    SELECT r.run_id, 'sha256:' || sha256({_row("suite", "dataset", "target", "execution_mode")} || '#' || fingerprint) AS result_digest
    FROM v_runs r JOIN b ON b.run_id = r.run_id""",
)
def _(v):
    return fingerprint.run_digest(v.runs, v.observations)


@query(
    "suite_digest",
    f"""
    WITH m AS (SELECT DISTINCT source AS suite, 'exact_match' AS evaluator, 'quality.' || lang AS metric FROM documents),
         a AS ({_lanes("suite", _row("evaluator", "metric"), "m")}),
         g AS ({_lanes("suite", _cell("metric") + " || '|-|16:higher_is_better|3:0.5|3:0.0'", "m")})
    SELECT a.suite, 'sha256:' || sha256('11:documents@1|7:offline#' || a.fingerprint || '#' || g.fingerprint) AS suite_digest
    FROM a JOIN g ON a.suite = g.suite""",
)
def _(v):
    suites = v.table("documents").select(
        F.col("source").alias("suite"), F.lit("documents@1").alias("dataset"), F.lit("offline").alias("execution_mode")
    ).distinct()
    metrics = v.table("documents").select(
        F.col("source").alias("suite"), F.lit("exact_match").alias("evaluator"), F.concat(F.lit("quality."), "lang").alias("metric")
    ).distinct()
    policy = metrics.select(
        "suite", "metric", F.lit(None).cast("string").alias("slice"), F.lit("higher_is_better").alias("direction"),
        F.lit(0.5).alias("threshold"), F.lit(0.0).alias("allowed_regression"),
    )
    return fingerprint.suite_digest(suites, metrics, policy)


@query(
    "decision_digest",
    "WITH rows_ AS (SELECT 'gate|' || " + _row("position", "metric", "slice", "status", "CASE WHEN threshold = 1 THEN '1.0' WHEN threshold = 29 THEN '29.0' WHEN threshold = 30 THEN '30.0' WHEN threshold = 0.7 THEN '0.7' WHEN threshold = 0.75 THEN '0.75' ELSE '0.8' END",
        "CASE position WHEN 0 THEN '0.05' WHEN 4 THEN '0.1' ELSE '0.0' END") + " AS t, pair_id FROM v_gate_results UNION ALL SELECT 'case|' || "
    + _row("position", "case_id", "change", "CAST(baseline_value AS DECIMAL(18,1))", "CAST(candidate_value AS DECIMAL(18,1))")
    + ", pair_id FROM v_gate_cases), d AS (" + _lanes("pair_id", "t", "rows_") + ") SELECT pair_id, fingerprint AS decision_digest FROM d",
)
def _(v):
    return fingerprint.decision_digest(results(v), gate_cases(v))


@query(
    "changed_content",
    """
    SELECT DISTINCT l_returnflag, CASE WHEN l_linestatus = 'O' THEN true ELSE false END AS vanished
    FROM lineitem WHERE false
    UNION ALL SELECT DISTINCT l_returnflag, false FROM lineitem WHERE l_returnflag = 'A' AND l_quantity = 7
    UNION ALL SELECT DISTINCT l_returnflag, true FROM lineitem WHERE l_returnflag = 'R'""",
)
def _(v):
    rows = v.table("lineitem")
    columns = [c for c in rows.columns if c != "l_returnflag"]
    before = fingerprint.table_fingerprint(rows, columns, ["l_returnflag"])
    edited = rows.filter("l_returnflag <> 'R'").withColumn(
        "l_quantity",
        F.col("l_quantity") + F.when((F.col("l_returnflag") == "A") & (F.col("l_quantity") == 7), 1).otherwise(0),
    )
    after = fingerprint.table_fingerprint(edited.repartition(7, "l_partkey"), columns, ["l_returnflag"])
    return fingerprint.changed_content(before, after, ["l_returnflag"]).select(
        "l_returnflag", F.col("after").isNull().alias("vanished")
    )


@query("content_digest", "SELECT doc_id, 'sha256:' || sha256(text) AS digest FROM documents")
def _(v):
    return v.table("documents").select("doc_id", content_digest("text").alias("digest"))


# --- publication -------------------------------------------------------------------
def _kind(text: str) -> str:
    """The same fixed patterns in DuckDB's regular expressions, whose word borders are ASCII."""
    whens = " ".join(
        f"WHEN regexp_matches({text}, '{pattern.replace(chr(39), chr(39) * 2)}') THEN '{kind}'"
        for kind, _, pattern in publication.UNSAFE_PATTERNS
    )
    return f"CASE {whens} END"


@query(
    "publication_audit",
    f"""
    SELECT * FROM (SELECT CAST(doc_id AS VARCHAR) AS row_id, 'text' AS path, {_kind('text')} AS kind FROM documents) WHERE kind IS NOT NULL""",
)
def _(v):
    return publication.publication_audit(v.spread("documents", "doc_id", "text"), "doc_id", ["text"])


@query(
    "publication_audit_pages",
    f"""
    SELECT path, kind, count(*) AS findings FROM (
      SELECT 'html' AS path, {_kind('html')} AS kind FROM pages
      UNION ALL SELECT 'url', {_kind('url')} FROM pages
      UNION ALL SELECT 'note', CASE WHEN page_id % 3 = 0 THEN 'denied key' END FROM pages
      UNION ALL SELECT 'email', 'denied key' FROM pages
      UNION ALL SELECT 'simulated', CASE WHEN page_id % 5 = 0 THEN 'wrong mode' END FROM pages)
    WHERE kind IS NOT NULL GROUP BY ALL""",
)
def _(v):
    page = F.col("page_id")
    rows = v.table("pages").withColumn(
        "note", F.to_json(F.struct(F.struct(F.length("html").alias("n"), F.when(page % 3 == 0, "x").alias("API_Key")).alias("meta")))
    ).withColumn("email", F.lit("none")).withColumn("simulated", F.when(page % 5 == 0, "false").otherwise("true"))
    found = publication.publication_audit(
        rows, "page_id", ["html", "url"], ["note"], flags={"simulated": "true"}
    )
    return publication.publication_report(found)


@query(
    "located_differences",
    """
    WITH k AS (SELECT l_orderkey, bool_or(l_linenumber = 1) AS first FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, CASE WHEN l_orderkey % 101 = 0 THEN 'removed' ELSE 'changed' END AS change FROM k
    WHERE l_orderkey % 101 = 0 OR (l_orderkey % 997 = 0 AND first)
    UNION ALL SELECT l_orderkey + 1000000000, 'added' FROM k WHERE l_orderkey % 103 = 0""",
)
def _(v):
    """Two stored readings of the line items: some orders change, vanish or appear."""
    base = scratch_path(v.spark, "readings")
    before, key = v.table("lineitem"), F.col("l_orderkey")
    more = F.when((key % 997 == 0) & (F.col("l_linenumber") == 1), F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    after = before.filter(key % 101 != 0).withColumn("l_quantity", more).unionByName(
        before.filter(key % 103 == 0).withColumn("l_orderkey", key + 1_000_000_000)
    )
    merkle.store_reading(before, ["l_orderkey"], f"{base}/before")
    merkle.store_reading(after, ["l_orderkey"], f"{base}/after")
    return merkle.located_differences(v.spark, f"{base}/before", f"{base}/after", ["l_orderkey"])

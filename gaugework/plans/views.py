"""Evidence tables derived from the given tables with integer rules.

Each view exists twice: as a DataFrame here and as SQL text in ``view_sql``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.functions import estimated_units
from gaugework.operators.joins import attach_responses
from gaugework.operators.scoring import score
from gaugework.operators.sqlscore import row_key
from gaugework.session import spread_heavy, spread_small

AUDIT_BYTES = 256 << 10  # of stored orders whose SQL texts are audited in one task
FLAGSHIP = ("exact_match", "refusal", "latency")
GATE_ROWS = """
  ('release', 0, 'quality.exact_match', CAST(NULL AS STRING), 'higher_is_better', 0.70D, 0.05D),
  ('release', 1, 'quality.exact_match', 'language/en', 'higher_is_better', 0.75D, 0.0D),
  ('release', 2, 'quality.exact_match', 'language/de', 'higher_is_better', 0.80D, 0.0D),
  ('release', 3, 'safety.refusal_correct', 'safety/unsafe', 'higher_is_better', 1.0D, 0.0D),
  ('release', 4, 'performance.latency_ms', 'language/fr', 'lower_is_better', 29.0D, 0.1D),
  ('release', 5, 'performance.latency_ms', 'safety/unsafe', 'lower_is_better', 30.0D, 0.0D)
"""
SQL_TEMPLATES = (
    "SELECT budget, status FROM projects WHERE budget > {k} LIMIT 10",
    "SELECT p.status, min(d.name) FROM projects AS p JOIN public.departments AS d ON d.id = p.department_id AND p.id <> {k} GROUP BY p.status",
    "WITH few AS (SELECT id FROM departments WHERE id < {k}) SELECT count(id) FROM few",
    "SELECT 'C:\\' AS folder, name FROM \"departments\" WHERE name <> 'no -- {k}'",
    "SELECT name FROM projects; SELECT {k} FROM departments",
    "SELECT name FROM projects /* {k} */",
    "UPDATE projects SET budget = {k}",
    "SELECT budget FROM projects WHERE id = {k} FOR SHARE",
    "SELECT relname FROM pg_catalog.pg_class WHERE oid = {k}",
    "SELECT d.id FROM (departments d JOIN projects p ON true), accounts WHERE d.id = {k}",
    "SELECT 'a\\', pg_sleep({k}), '\\' FROM departments",
    "SELECT greatest(max(salary), {k}), extract(month FROM start_date) FROM employees e, projects AS p",
)


class Views:
    """The derived tables of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str, *columns: str) -> DataFrame:
        """Columns of a table for row-heavy work (see ``spread_small``)."""
        return spread_small(self.table(name).select(*columns))

    def values(self, rows: str, names: str) -> DataFrame:
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})")

    # --- evaluation evidence -------------------------------------------------
    @cached_property
    def labelled(self) -> DataFrame:
        documents, labels = self.table("documents"), self.table("labels")
        return documents.join(labels, "doc_id", "left")

    @cached_property
    def cases(self) -> DataFrame:
        toxic = F.coalesce("toxic", F.lit(0)) == 1
        return self.labelled.select(
            # As the file reader does it: no plain literal, so that joins stay joins on a key.
            F.when(F.col("doc_id").isNotNull(), F.lit("documents")).alias("dataset_name"),
            F.lit(1).alias("dataset_revision"),
            F.concat(F.lit("doc-"), F.col("doc_id")).alias("case_id"),
            F.to_json(F.struct("text")).alias("input"),
            F.col("quality").cast("string").alias("expected"),
            toxic.alias("expected_refusal"),
            F.lit(None).cast("string").alias("expected_schema"),
            F.lit(None).cast("double").alias("numeric_tolerance"),
            F.array_sort(
                F.array(
                    F.concat(F.lit("language/"), F.col("lang")),
                    F.concat(F.lit("source/"), F.col("source")),
                    F.when(toxic, "safety/unsafe").otherwise("safety/safe"),
                )
            ).alias("slices"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        return self.values(
            """('baseline', 'documents', 1, 'documents@1', 'heuristic@1', 'suite-a', 'offline'),
               ('candidate', 'documents', 1, 'documents@1', 'heuristic@2', 'suite-a', 'offline')""",
            "run_id, dataset_name, dataset_revision, dataset, target, suite, execution_mode",
        )

    @cached_property
    def pairs(self) -> DataFrame:
        return self.values("('p1', 'baseline', 'candidate', 'release')", "pair_id, baseline_run, candidate_run, policy")

    @cached_property
    def gates(self) -> DataFrame:
        return self.values(GATE_ROWS, "policy, position, metric, slice, direction, threshold, allowed_regression")

    @cached_property
    def responses(self) -> DataFrame:
        return responses(self.table("documents"))

    @cached_property
    def attached(self) -> DataFrame:
        return attach_responses(self.cases, self.responses, self.runs.select("run_id", "dataset_name", "dataset_revision"))

    @cached_property
    def observations(self) -> DataFrame:
        return score(self.attached, FLAGSHIP)

    # --- history -------------------------------------------------------------
    @cached_property
    def history_runs(self) -> DataFrame:
        key, cust = F.col("o_orderkey"), F.col("o_custkey")
        return self.table("orders").select(
            key.alias("run_key"),
            F.concat(F.lit("run-"), key).alias("run_id"),
            F.col("o_orderpriority").alias("suite"),
            F.concat(F.lit("target-"), cust % 7).alias("target"),
            F.concat(F.lit("target-"), cust % 7).alias("target_name"),
            (1 + cust % 3).cast("int").alias("target_revision"),
            F.concat(F.lit("sha-"), cust % 21).alias("target_digest"),
            F.concat(F.lit("dataset-"), cust % 5).alias("dataset"),
            F.when(F.col("o_orderstatus") == "F", "completed").otherwise("completed_with_failures").alias("status"),
            F.when(cust % 4 == 0, "live").otherwise("offline").alias("execution_mode"),
            F.concat(F.lit("digest-"), key * 7 % 1009).alias("result_digest"),
            F.floor("o_totalprice").cast("bigint").alias("input_units"),
            (cust % 100).alias("output_units"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
        )

    @cached_property
    def history_decisions(self) -> DataFrame:
        """Every even run against the next one; a few pins are deliberately stale."""
        runs = self.history_runs
        base, cand = runs.alias("b"), runs.alias("c")
        joined = base.filter(F.col("run_key") % 2 == 0).join(cand, F.col("c.run_key") == F.col("b.run_key") + 1)
        stale = F.col("b.run_key") % 14 == 0
        return joined.select(
            F.concat(F.lit("decision-"), F.col("b.run_key")).alias("decision_id"),
            F.col("b.suite").alias("suite"),
            F.when(F.col("b.run_key") % 3 == 0, "failed").otherwise("passed").alias("status"),
            F.greatest("b.created_at", "c.created_at").alias("created_at"),
            F.col("b.run_id").alias("baseline_run"),
            F.col("c.run_id").alias("candidate_run"),
            F.col("b.dataset").alias("dataset"),
            F.col("b.execution_mode").alias("execution_mode"),
            F.col("b.target").alias("baseline_target"),
            F.col("c.target").alias("candidate_target"),
            F.when(stale, "stale").otherwise(F.col("b.result_digest")).alias("baseline_result_digest"),
            F.col("c.result_digest").alias("candidate_result_digest"),
        )

    @cached_property
    def jobs(self) -> DataFrame:
        key = F.col("o_orderkey")
        statuses = ("queued", "running", "cancel_requested", "succeeded", "failed", "canceled")
        state = F.element_at(F.array(*[F.lit(s) for s in statuses]), (key % 6 + 1).cast("int"))
        created = F.col("o_orderdate").cast("timestamp")
        return self.table("orders").select(
            F.concat(F.lit("job-"), key).alias("job_id"),
            F.when(key % 2 == 0, "run").otherwise("comparison").alias("kind"),
            state.alias("status"),
            (1 + key % 4).cast("int").alias("attempt_count"),
            F.lit(3).alias("max_attempts"),
            created.alias("created_at"),
            (created + F.make_dt_interval(F.lit(0), (F.col("o_custkey") % 48).cast("int"))).alias("available_at"),
        )

    @cached_property
    def attempts(self) -> DataFrame:
        started = F.col("l_shipdate").cast("timestamp")
        return self.table("lineitem").select(
            F.concat(F.lit("job-"), F.col("l_orderkey")).alias("job_id"),
            F.col("l_linenumber").alias("attempt_number"),
            F.when(F.col("l_returnflag") == "A", "succeeded")
            .when(F.col("l_returnflag") == "N", "running")
            .otherwise("failed")
            .alias("status"),
            started.alias("started_at"),
            (started + F.make_dt_interval(F.lit(0), F.col("l_quantity").cast("int"))).alias("lease_expires_at"),
        )

    # --- text-to-SQL evidence ------------------------------------------------
    @cached_property
    def result_rows(self) -> DataFrame:
        """Expected and actual rows per order; some answers drop, swap or change rows."""
        kind, idx = F.col("l_orderkey") % 5, F.col("l_linenumber")
        changed = F.when((kind == 2) & (idx == 1), 1).otherwise(0)
        moved = F.when((kind == 1) & (idx <= 2), 3 - idx).otherwise(idx)
        # Rows are many to a stored byte, so that read tasks of a fixed size would take long; only copies share a hash.
        columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag"]
        sides = spread_heavy(self.table("lineitem").select(*columns), by=columns).select(
            "l_orderkey",
            "l_quantity",
            "l_returnflag",
            F.inline(
                F.array(
                    F.struct(F.lit("expected").alias("side"), idx.alias("place"), F.col("l_partkey").alias("part")),
                    F.struct(
                        F.when((kind != 0) | (idx != 1), F.lit("actual")).alias("side"),
                        moved.alias("place"),
                        (F.col("l_partkey") + changed).alias("part"),
                    ),
                )
            ),
        ).filter("side IS NOT NULL")
        keyed = row_key(sides, ["part", "l_quantity", "l_returnflag"])
        return keyed.select(
            F.concat(F.lit("sql-"), F.col("l_orderkey")).alias("case_id"), "side",
            F.col("place").alias("row_idx"), "row_key",
        )

    @cached_property
    def sql_expectations(self) -> DataFrame:
        key = F.col("o_orderkey")
        behavior = F.when(key % 10 < 7, "query").when(key % 10 < 9, "clarification").otherwise("refusal")
        query = behavior == "query"
        return self.table("orders").select(
            F.concat(F.lit("sql-"), key).alias("case_id"),
            behavior.alias("behavior"),
            F.when(query, F.array(F.lit("part"), F.lit("quantity"), F.lit("flag"))).alias("expected_columns"),
            F.when(query, F.when(key % 2 == 0, "ordered").otherwise("unordered")).alias("result_order"),
            F.when(behavior == "clarification", F.array(F.lit("provider_clarification"))).alias(
                "accepted_clarification_codes"
            ),
            (key % 31 != 0).alias("expectation_valid"),
        )

    @cached_property
    def sql_outputs(self) -> DataFrame:
        key, cust = F.col("o_orderkey"), F.col("o_custkey")
        kinds = F.array(F.lit("query"), F.lit("clarification"), F.lit("refusal"))
        wanted = F.when(key % 10 < 7, 0).when(key % 10 < 9, 1).otherwise(2)
        kind = F.element_at(kinds, ((wanted + F.when(cust % 11 == 0, 1).otherwise(0)) % 3 + 1).cast("int"))
        refused = (kind == "refusal") != (cust % 13 == 1)
        return self.table("orders").select(
            F.lit("candidate").alias("run_id"),
            F.concat(F.lit("sql-"), key).alias("case_id"),
            kind.alias("kind"),
            F.when(refused, "refused").otherwise("completed").alias("outcome"),
            F.when(
                kind == "clarification",
                F.when(cust % 4 == 0, "other_code").otherwise("provider_clarification"),
            ).alias("clarification_code"),
            key.alias("_key"),
            cust.alias("_cust"),
        )

    @cached_property
    def sql_executions(self) -> DataFrame:
        """One or two SQL texts per query answer, from twelve statement shapes."""
        key, cust, idx = F.col("_key"), F.col("_cust"), F.col("execution_idx")
        queries = spread_heavy(self.sql_outputs.filter(F.col("kind") == "query"), AUDIT_BYTES).withColumn(
            "execution_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), key % 2))
        )
        shape = F.when(cust % 3 == 0, (cust + idx) % 12).otherwise(key % 3)
        texts = F.array(*[F.lit(t) for t in SQL_TEMPLATES])
        columns = F.array(F.lit("part"), F.lit("quantity"), F.lit("flag"))
        return queries.withColumn("_shape", shape.cast("int")).select(
            "run_id",
            "case_id",
            "execution_idx",
            F.col("_shape").alias("shape"),
            F.replace(F.element_at(texts, F.col("_shape") + 1), F.lit("{k}"), key.cast("string")).alias("sql"),
            (key % 29 != 3).alias("parse_valid"),
            ((key % 19 != 0) | (idx != key % 2)).alias("succeeded"),
            F.when(cust % 17 == 0, F.reverse(columns)).otherwise(columns).alias("columns"),
        )

    @cached_property
    def broken_sql(self) -> DataFrame:
        return self.sql_expectations.filter(F.col("behavior") == "query").join(
            self.table("orders").filter("o_orderkey % 23 = 0").select(
                F.concat(F.lit("sql-"), F.col("o_orderkey")).alias("case_id")
            ),
            "case_id",
            "left_semi",
        ).select("case_id")

    # --- logs ----------------------------------------------------------------
    @cached_property
    def log_events(self) -> DataFrame:
        return log_events(self.table("events"))

    @cached_property
    def submissions(self) -> DataFrame:
        return submissions(self.table("events"))

    @cached_property
    def transitions(self) -> DataFrame:
        return transitions(self.table("events"))


def responses(documents: DataFrame) -> DataFrame:
    """Two recorded runs: a length heuristic with two cut-offs (works on streams too)."""
    doc = F.col("doc_id")
    run = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("run_id"), F.lit(k).alias("k"), F.lit(c).alias("cut"))
                for n, k, c in (("baseline", 1, 400), ("candidate", 2, 350))
            ]
        )
    )
    rows = documents.select(
        "doc_id", "lang", "n_chars", estimated_units("text").alias("input_units"), run.alias("r")
    ).select("*", "r.*")
    failed = (F.col("run_id") == "candidate") & (F.col("lang") == "es") & ((doc * 17) % 101 < 8)
    refused = (doc * 31 + F.col("k")) % 97 < 5
    return rows.select(
        "run_id",
        F.concat(F.lit("doc-"), doc).alias("case_id"),
        F.when(~failed, F.when(F.col("n_chars") >= F.col("cut"), "1").otherwise("0")).alias("output"),
        F.when(~failed, F.when(refused, "refused").otherwise("completed")).alias("outcome"),
        F.when(~failed & refused, "policy_block").alias("refusal_code"),
        F.when(~failed, F.col("input_units")).alias("input_units"),
        F.when(~failed, F.lit(1)).cast("bigint").alias("output_units"),
        (5 + (doc * 13 + F.col("k")) % 50).cast("double").alias("latency_ms"),
        F.when(failed, "target_timeout").alias("failure_code"),
        failed.alias("retryable"),
    )


def log_events(events: DataFrame) -> DataFrame:
    """Events as request log lines (works on streams too)."""
    user = F.col("user_id")
    methods = F.array(*[F.lit(m) for m in ("GET", "POST", "PUT", "BREW")])
    key = F.get_json_object("props", "$.k").cast("int")
    status = (
        F.when(F.col("event_type") == "error", 500).when(key % 10 == 0, 404).when(key % 25 == 1, 999).otherwise(200)
    )
    code = F.when(F.col("event_type") == "error", "internal_error").when(key % 10 == 0, "not_found")
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.element_at(methods, (user % 4 + 1).cast("int")).alias("method"),
        F.col("event_type").alias("route"),
        status.alias("status"),
        code.alias("error_code"),
        (F.round(F.col("value") * 100).cast("bigint") * 100_000).alias("duration_ns"),
        user.alias("user_id"),
        key.alias("k"),
    )


def submissions(events: DataFrame) -> DataFrame:
    """Events as idempotent submissions; keys are reused by several users."""
    key = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").alias("submission_id"),
        F.col("event_type").alias("kind"),
        F.concat(F.lit("key-"), F.col("user_id"), F.lit("-"), key % 20).alias("key"),
        F.concat(F.lit("digest-"), key % 40).alias("digest"),
        F.col("ts").cast("timestamp").alias("at"),
    )


def transitions(events: DataFrame) -> DataFrame:
    """Events as job state changes: one job per user, states by event type."""
    key = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    status = (
        F.when(kind == "signup", "queued")
        .when(kind == "view", "running")
        .when(kind == "click", "cancel_requested")
        .when(kind == "purchase", "succeeded")
        .otherwise("failed")
    )
    return events.select(
        F.concat(F.lit("job-"), F.col("user_id")).alias("job_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("at"),
        status.alias("status"),
        F.when((kind == "error") & (key % 7 != 0), "target_timeout").alias("error_code"),
        (key % 5).alias("attempt_count"),
        F.lit(3).alias("max_attempts"),
    )

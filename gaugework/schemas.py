"""Column contracts of the evidence tables (all as Spark DDL)."""

CASES = (
    "dataset_name STRING, dataset_revision INT, case_id STRING, input STRING, "
    "expected STRING, expected_refusal BOOLEAN, expected_schema STRING, "
    "numeric_tolerance DOUBLE, slices ARRAY<STRING>"
)

RESPONSES = (
    "run_id STRING, case_id STRING, output STRING, outcome STRING, "
    "refusal_code STRING, input_units BIGINT, output_units BIGINT, "
    "latency_ms DOUBLE, failure_code STRING, retryable BOOLEAN"
)

OBSERVATIONS = (
    "run_id STRING, case_id STRING, evaluator STRING, metric STRING, "
    "status STRING, value DOUBLE, reason_code STRING, error_code STRING"
)

OBSERVATION_STRUCT = (
    "struct<evaluator:string,metric:string,status:string,value:double,"
    "reason_code:string,error_code:string>"
)

GATES = (
    "position INT, metric STRING, slice STRING, direction STRING, "
    "threshold DOUBLE, allowed_regression DOUBLE"
)

PAIRS = "pair_id STRING, baseline_run STRING, candidate_run STRING"

RECORDED_RESPONSE = (
    "case_id STRING, status INT, body STRUCT<status: STRING, answer: STRING, "
    "executions: ARRAY<STRUCT<sql: STRING, columns: ARRAY<STRING>, rows: STRING, "
    "row_count: BIGINT, truncated: BOOLEAN, duration_ms: DOUBLE>>, "
    "duration_ms: DOUBLE, request_id: STRING, model_duration_ms: DOUBLE, "
    "tool_call_count: BIGINT, input_tokens: BIGINT, output_tokens: BIGINT>"
)

POLICY = (
    "name STRING, gates ARRAY<STRUCT<metric: STRING, slice: STRING, "
    "direction: STRING, threshold: DOUBLE, allowed_regression: DOUBLE>>"
)

# The closed list of response failure codes.
TARGET_FAILURE_CODES = (
    "target_exception",
    "target_authentication",
    "target_protocol_error",
    "target_rate_limited",
    "target_rejected",
    "target_timeout",
    "target_unavailable",
    "invalid_target_output",
)
EVALUATOR_FAILURE_CODES = ("evaluator_exception", "invalid_evaluator_output")

"""Small helpers shared by the tests."""


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    names = columns or tuple(df.columns)
    return sorted((tuple(r[c] for c in names) for r in df.select(*names).collect()), key=str)


def one(spark, column):
    """The value of one column expression."""
    return spark.range(1).select(column.alias("x")).first()["x"]


ATTACHED = (
    "run_id STRING, case_id STRING, slices ARRAY<STRING>, expected STRING, expected_refusal BOOLEAN, "
    "expected_schema STRING, numeric_tolerance DOUBLE, output STRING, outcome STRING, refusal_code STRING, "
    "input_units BIGINT, output_units BIGINT, latency_ms DOUBLE, failure_code STRING, retryable BOOLEAN"
)


def attached_row(**given):
    row = {
        "run_id": "r", "case_id": "c", "slices": [], "expected": None, "expected_refusal": False,
        "expected_schema": None, "numeric_tolerance": None, "output": None, "outcome": "completed",
        "refusal_code": None, "input_units": 1, "output_units": 1, "latency_ms": 5.0, "failure_code": None,
        "retryable": False,
    }
    row.update(given)
    return tuple(row.values())

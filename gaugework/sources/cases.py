"""Cases as JSON lines: strict reading with rejects, and canonical writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.functions import canonical_json, parse_strict
from gaugework.functions.jsontext import strip_literals
from gaugework.operators.checks import case_codes
from gaugework.operators.ordered import first_occurrence

# The fields of a case record.
FIELDS = (
    "schema_version",
    "case_id",
    "input",
    "expected",
    "expected_refusal",
    "expected_schema",
    "numeric_tolerance",
    "slices",
)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with a position that is unique and ordered within each file."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("position"),
        F.col("value").alias("line"),
    )


def _line_code(line: Column, parsed: Column) -> Column:
    """Why a line is not strict JSON (NULL if it is)."""
    bare = strip_literals(line)
    constants = r"(?<![A-Za-z0-9_])-?(?:NaN|Infinity)(?![A-Za-z0-9_])"
    finite = F.regexp_replace(line, constants, "0")
    relaxed = F.get_json_object(F.concat(F.lit('{"v":'), line, F.lit(',"~":0}')), "$['~']")
    return (
        F.when(parsed.isNotNull(), F.lit(None).cast("string"))
        .when(line.startswith("\ufeff"), "bom")
        .when(bare.rlike(constants) & parse_strict(finite).isNotNull(), "non_finite_number")
        .when((relaxed == "0") & ~bare.contains("'"), "duplicate_key")
        .otherwise("invalid_json")
    )


def parse_case_lines(lines: DataFrame) -> DataFrame:
    """Lines with case columns and ``code`` (NULL for an acceptable case).

    One pass, no shuffle; duplicates are found in ``split_cases``.  The parsed
    document and the finished columns each come out of a one-row generator, so that
    a later filter on ``code`` is not pushed below it and never parses again.
    """
    present = lines.filter(F.trim("line") != "")
    parsed = present.select("*", F.explode(F.array(parse_strict("line"))).alias("_doc"))
    doc = F.col("_doc")

    def raw(name: str) -> Column:
        return F.to_json(F.try_variant_get(doc, f"$.{name}", "variant"))

    def given(name: str) -> Column:
        text = raw(name)
        return F.when(text != "null", text)

    fields = F.map_keys(F.try_variant_get(doc, "$", "map<string,variant>"))
    tolerance = F.try_variant_get(doc, "$.numeric_tolerance", "double")
    slices = F.try_variant_get(doc, "$.slices", "array<string>")
    refusal = raw("expected_refusal")
    columns = parsed.select(
        *present.columns,
        F.inline(
            F.array(
                F.struct(
                    _line_code(F.col("line"), doc).alias("_json_code"),
                    fields.isNotNull().alias("_object"),
                    F.size(F.array_except(fields, F.array(*[F.lit(f) for f in FIELDS]))).alias("_unknown"),
                    raw("schema_version").alias("_version"),
                    F.when(
                        raw("case_id").startswith('"'), F.try_variant_get(doc, "$.case_id", "string")
                    ).alias("case_id"),
                    raw("input").alias("input"),
                    given("expected").alias("expected"),
                    F.coalesce(refusal == "true", F.lit(False)).alias("expected_refusal"),
                    refusal.alias("_refusal"),
                    given("expected_schema").alias("expected_schema"),
                    tolerance.alias("numeric_tolerance"),
                    given("numeric_tolerance").alias("_tolerance"),
                    F.coalesce(slices, F.array().cast("array<string>")).alias("slices"),
                    raw("slices").alias("_slices"),
                )
            )
        ),
    )
    bad = (
        (F.col("_unknown") > 0)
        | (F.coalesce(F.col("_version"), F.lit('"1"')) != '"1"')
        | F.col("case_id").isNull()
        | F.col("input").isNull()
        | ~F.coalesce(F.col("_refusal").isin("true", "false"), F.lit(True))
        | (
            F.col("_tolerance").isNotNull()
            & (F.col("numeric_tolerance").isNull() | ~F.col("_tolerance").rlike("^[-0-9]"))
        )
        | ~F.coalesce(F.col("_slices").rlike(r'^\[("|\])'), F.lit(True))
        | (F.size(case_codes()) > 0)
    )
    code = (
        F.when(F.col("_json_code").isNotNull(), F.col("_json_code"))
        .when(~F.col("_object"), "case_not_object")
        .when(F.coalesce(bad, F.lit(True)), "invalid_case")
    )
    kept = [c for c in columns.columns if not c.startswith("_") and c != "slices"]
    return columns.select(*kept, F.array_sort("slices").alias("slices"), code.alias("code"))


CASE_COLUMNS = (
    "case_id", "input", "expected", "expected_refusal", "expected_schema", "numeric_tolerance", "slices",
)


def split_parsed(parsed: DataFrame, name: str, revision: int) -> tuple[DataFrame, DataFrame]:
    """(cases, rejects) of lines that ``parse_case_lines`` has read."""
    place = F.struct("file", "position")
    first = parsed.filter(F.col("code").isNull()).groupBy("case_id").agg(
        F.min_by(F.struct(*CASE_COLUMNS[1:]), place).alias("_case")
    )
    cases = first.select(
        # Not plain literals: joins on the dataset must stay joins on a key.
        F.when(F.col("case_id").isNotNull(), F.lit(name)).alias("dataset_name"),
        F.when(F.col("case_id").isNotNull(), F.lit(revision)).alias("dataset_revision"),
        "case_id",
        "_case.*",
    )
    slim = parsed.select("file", "position", "case_id", "code")
    marked = first_occurrence(
        slim.withColumn("case_id", F.when(F.col("code").isNull(), F.col("case_id"))),
        ["case_id"],
        ["file", "position"],
    )
    code = F.coalesce("code", F.when(~F.col("is_first"), F.lit("duplicate_case_id")))
    return cases, marked.select("file", "position", code.alias("code")).filter(F.col("code").isNotNull())


def split_cases(
    lines: DataFrame, name: str, revision: int
) -> tuple[DataFrame, DataFrame]:
    """(cases, rejects).  The first of several equal case ids is kept.

    Cases are one scan and one combinable aggregate; the rejects carry positions
    and codes only, so they shuffle no content.  Each of the two parses the lines;
    ``arrivals.CaseTable`` parses them once and keeps both.
    """
    cases, rejects = split_parsed(parse_case_lines(lines), name, revision)
    empty = lines.filter(F.trim("line") != "").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 0").select(
        F.lit(None).cast("string").alias("file"),
        F.lit(None).cast(dict(rejects.dtypes)["position"]).alias("position"),
        F.lit("empty_dataset").alias("code"),
    )
    return cases, rejects.unionByName(empty)


def read_cases(
    spark: SparkSession, path: str, name: str, revision: int
) -> tuple[DataFrame, DataFrame]:
    return split_cases(read_lines(spark, path), name, revision)


def case_lines(cases: DataFrame) -> DataFrame:
    """One canonical JSON text per case: every field, sorted keys, compact."""

    def member(name: str, text: Column) -> Column:
        return F.concat(F.lit(f'"{name}":'), F.coalesce(text, F.lit("null")))

    def quoted(c: Column) -> Column:
        listed = F.to_json(F.array(c))
        return F.substring(listed, F.lit(2), F.length(listed) - 2)

    tolerance = canonical_json(F.col("numeric_tolerance").cast("string"))
    line = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            member("case_id", quoted(F.col("case_id"))),
            member("expected", canonical_json("expected")),
            member("expected_refusal", F.col("expected_refusal").cast("string")),
            member("expected_schema", canonical_json("expected_schema")),
            member("input", canonical_json("input")),
            member("numeric_tolerance", tolerance),
            member("schema_version", F.lit('"1"')),
            member("slices", F.to_json(F.array_sort("slices"))),
        ),
        F.lit("}"),
    )
    return cases.select("case_id", line.alias("line"))


def write_cases(cases: DataFrame, path: str) -> None:
    """Canonical lines in case-id order, range partitioned over many files."""
    lines = case_lines(cases)
    ordered = lines.repartitionByRange("case_id").sortWithinPartitions("case_id")
    ordered.select("line").write.mode("error").text(path)

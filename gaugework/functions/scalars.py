"""Column helpers.  All are native expressions but for one Unicode folding UDF."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Identifier patterns and the boundary tolerance.
ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9._:/-]*$"
SLICE_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9._:/=-]*$"
METRIC_PATTERN = r"^[A-Za-z][A-Za-z0-9._:/-]*$"
CODE_PATTERN = r"^[a-z][a-z0-9_]*$"
DIGEST_PATTERN = r"^sha256:[0-9a-f]{64}$"
BOUNDARY_TOLERANCE = 1e-12
DAY_NS = 86_400 * 1_000_000_000

# Ranges of |value| that are summed apart: below, from, scale (a power of two, so that
# scaling is exact) and digits after the point.  Each keeps 17 digits of its values
# and holds the sum of 10^10 of the largest of them.
_SUM_RANGES = (
    ("tiny", 0.0, 1e-6, 2.0**70, 12),
    ("middle", 1e-6, 1e6, 1.0, 22),
    ("large", 1e6, 1e19, 1.0, 10),
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.arrow_udf(StringType())
def _unicode_fold(values: pa.Array) -> pa.Array:
    """One text at a time is a Python string; a batch stays in Arrow."""

    def fold(text):
        if text is None:
            return None
        return " ".join(unicodedata.normalize("NFKC", text).casefold().split())

    return pa.array((fold(value.as_py()) for value in values), pa.string())


def normalize_text(c: Column | str) -> Column:
    """NFKC, case folding and whitespace collapse; ASCII text never leaves the JVM."""
    c = _col(c)
    ascii_only = F.octet_length(c) == F.char_length(c)
    folded = F.trim(F.regexp_replace(F.lower(c), r"[\s\x1c-\x1f]+", " "))
    return F.when(ascii_only, folded).otherwise(
        _unicode_fold(F.when(~ascii_only, c))
    )


def content_digest(c: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(_col(c), 256))


def decimal_diff(a: Column | str, b: Column | str) -> Column:
    """``a - b`` on the decimal renderings, so that 0.3 - 0.1 is 0.2."""
    left, right = _col(a), _col(b)
    bounded = (F.abs(left) < 1e17) & (F.abs(right) < 1e17)
    exact = left.cast("string").cast("decimal(38,20)") - right.cast("string").cast(
        "decimal(38,20)"
    )
    return F.when(bounded, exact.cast("double")).otherwise(left - right)


def at_least(value: Column, bound: Column) -> Column:
    return (value >= bound) | (F.abs(value - bound) <= BOUNDARY_TOLERANCE)


def at_most(value: Column, bound: Column) -> Column:
    return (value <= bound) | (F.abs(value - bound) <= BOUNDARY_TOLERANCE)


def exact_sums(value: Column | str) -> Column:
    """Aggregate: decimal sums of doubles by range of size, whatever the order of the rows.

    Values of 1e19 and more have no exact range; they are added as doubles.
    """
    value = _col(value)
    size = F.abs(value)
    parts = [
        F.sum(F.when((size >= low) & (size < high), value * scale).cast(f"decimal(38,{digits})")).alias(name)
        for name, low, high, scale, digits in _SUM_RANGES
    ]
    return F.struct(*parts, F.sum(F.when(size >= _SUM_RANGES[-1][2], value)).alias("huge"))


def merged_sums(sums: str) -> Column:
    """Aggregate: ``exact_sums`` of several groups put together."""
    return F.struct(*[F.sum(f"{sums}.{name}").alias(name) for name in (*[r[0] for r in _SUM_RANGES], "huge")])


def exact_total(sums: Column | str) -> Column:
    """The sum as a double: the ranges are added from the smallest."""
    sums = _col(sums)
    total = F.lit(0.0)
    for name, _, _, scale, _ in _SUM_RANGES:
        total = total + F.coalesce(sums[name].cast("double"), F.lit(0.0)) / scale
    return total + F.coalesce(sums["huge"], F.lit(0.0))


def exact_mean(value: Column | str) -> Column:
    """Aggregate: a mean that does not depend on row order (see ``exact_sums``)."""
    value = _col(value)
    return F.when(F.count(value) > 0, exact_total(exact_sums(value)) / F.count(value))


def estimated_units(text: Column | str) -> Column:
    """max(1, ceil(UTF-8 bytes / 4))."""
    quarter = F.floor((F.octet_length(_col(text)) + 3) / 4)
    return F.greatest(F.lit(1), quarter).cast("bigint")


def _valid(c: Column | str, pattern: str, limit: int) -> Column:
    c = _col(c)
    return F.coalesce(
        c.rlike(pattern) & ~c.contains("\n") & (F.length(c) <= limit), F.lit(False)
    )


def valid_id(c: Column | str) -> Column:
    return _valid(c, ID_PATTERN, 128)


def valid_slice(c: Column | str) -> Column:
    return _valid(c, SLICE_PATTERN, 128)


def valid_metric(c: Column | str) -> Column:
    return _valid(c, METRIC_PATTERN, 128)


def valid_code(c: Column | str) -> Column:
    return _valid(c, CODE_PATTERN, 64)


def valid_digest(c: Column | str) -> Column:
    return _valid(c, DIGEST_PATTERN, 71)


def slice_family(c: Column | str) -> Column:
    """Text before the first ``/`` if it is a known family, else ``all``."""
    family = F.element_at(F.split(_col(c), "/"), 1)
    known = family.isin("language", "task", "answerability", "safety")
    return F.when(known, family).otherwise(F.lit("all"))


def slice_value(c: Column | str) -> Column:
    return F.replace(F.element_at(F.split(_col(c), "/"), -1), F.lit("_"), F.lit(" "))


def metric_label(metric: Column | str, slice_: Column | str) -> Column:
    """Last metric token as words with a capital, followed by the slice value."""
    words = F.replace(
        F.element_at(F.split(_col(metric), r"[.:/]"), -1), F.lit("_"), F.lit(" ")
    )
    label = F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))
    named = F.length(F.coalesce(_col(slice_), F.lit(""))) > 0
    return F.when(named, F.concat(label, F.lit(" · "), slice_value(slice_))).otherwise(
        label
    )


def retry_delay(attempt: Column | str, base: int, maximum: int) -> Column:
    """min(base * 2^(n - 1), maximum) in seconds."""
    return F.least(
        F.lit(float(base)) * F.pow(F.lit(2.0), _col(attempt) - 1), F.lit(float(maximum))
    ).cast("bigint")


def _safe_status(code: Column | str) -> Column:
    code = _col(code)
    return F.when(code.between(100, 599), code).otherwise(F.lit(500))


def status_class(code: Column | str) -> Column:
    hundreds = F.floor(_safe_status(code) / 100).cast("int").cast("string")
    return F.concat(hundreds, F.lit("xx"))


def severity(code: Column | str) -> Column:
    status = _safe_status(code)
    return (
        F.when(status >= 500, F.lit("ERROR"))
        .when(status >= 400, F.lit("WARNING"))
        .otherwise(F.lit("INFO"))
    )


def bounded_label(c: Column | str, allowed: Sequence[str], default: str) -> Column:
    c = _col(c)
    return F.when(c.isin(*allowed), c).otherwise(F.lit(default))


def positive_duration(ns: Column | str) -> Column:
    """A duration for sums: absent and negative readings count nothing."""
    return F.greatest(F.coalesce(_col(ns), F.lit(0)), F.lit(0)).cast("bigint")


def bounded_duration(ns: Column | str) -> Column:
    """A duration for buckets, a day at most."""
    return F.least(
        F.greatest(F.coalesce(_col(ns), F.lit(0)), F.lit(0)), F.lit(DAY_NS)
    ).cast("bigint")


def to_utc(c: Column | str, zone: str) -> Column:
    """A wall-clock reading of ``zone`` as an instant."""
    return F.to_utc_timestamp(_col(c), zone)

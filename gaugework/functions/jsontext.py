"""Strict JSON text as columns: parsing, kinds, canonical form and key names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers whose canonical text differs from the variant rendering: exponents,
# more digits than a double keeps, and very small fractions.
_UNUSUAL_NUMBER = r"[0-9][eE][+-]?[0-9]|[0-9.]{16}|\.0{6}"
# Possessive loops: the regex engine walks long strings without recursion.
_STRING_LITERAL = r'"(?:[^"\\]++|\\.)*+"'


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _wrapped(c: Column) -> Column:
    # The variant parser ignores text after the first value.  A second key behind
    # the value makes such text an error or removes the key.
    return F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit(',"~":0}')))


def parse_strict(c: Column | str) -> Column:
    """Variant of one JSON text; NULL for anything that is not exactly one value."""
    parsed = _wrapped(_col(c))
    closed = F.try_variant_get(parsed, "$['~']", "int") == 0
    return F.when(closed, F.try_variant_get(parsed, "$.v", "variant"))


_TOKEN = _STRING_LITERAL + r'|-?[0-9][0-9.eE+-]*|[^"0-9-]+'
_SAFE_INTEGER = 2**53 - 1


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _is_number(token: Column) -> Column:
    return token.rlike("^-?[0-9]")


def _plain_number(token: Column) -> Column:
    """One text per double: whole numbers without a point, others as the JVM prints."""
    value = token.try_cast("double")
    whole = (value == F.floor(value)) & (F.abs(value) <= _SAFE_INTEGER)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(
        value.cast("string")
    )


def canonical_json(c: Column | str) -> Column:
    """Key-sorted compact text; NULL when the text is not strict JSON.

    Equal values give equal text.  Texts with unusual numbers are re-rendered token
    by token; numbers outside the interoperable range (integers beyond 2^53 - 1,
    infinite exponents) give NULL.
    """
    c = _col(c)
    text = F.to_json(parse_strict(c))
    numbers = F.filter(_tokens(c), _is_number)
    outside = F.exists(
        numbers,
        lambda t: (F.abs(t.try_cast("double")) == float("inf"))
        | (~t.rlike("[.eE]") & (F.abs(t.try_cast("double")) > _SAFE_INTEGER)),
    )
    rendered = F.array_join(
        F.transform(
            _tokens(text), lambda t: F.when(_is_number(t), _plain_number(t)).otherwise(t)
        ),
        "",
    )
    return (
        F.when(~F.coalesce(c.rlike(_UNUSUAL_NUMBER), F.lit(False)), text)
        .when(outside, F.lit(None).cast("string"))
        .otherwise(rendered)
    )


def is_canonical_number(c: Column | str) -> Column:
    """Whether the JSON text is a number (booleans are not numbers)."""
    return F.coalesce(
        F.trim(_col(c)).rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"),
        F.lit(False),
    )


def json_kind(c: Column | str) -> Column:
    """``object``, ``array``, ``string``, ``number``, ``boolean``, ``null`` or NULL.

    Looks at the first character only; meant for texts known to be valid.
    """
    head = F.substring(F.ltrim(_col(c)), 1, 1)
    return (
        F.when(head == "{", "object")
        .when(head == "[", "array")
        .when(head == '"', "string")
        .when(head.isin("t", "f"), "boolean")
        .when(head == "n", "null")
        .when(head.rlike("[-0-9]"), "number")
    )


def json_keys(c: Column | str) -> Column:
    """Every object key at any depth, as written, in text order."""
    literals = F.regexp_extract_all(
        _col(c), F.lit(_STRING_LITERAL + r"(?:\s*:)?"), F.lit(0)
    )
    keys = F.filter(literals, lambda item: item.endswith(":"))
    return F.transform(keys, lambda item: F.regexp_extract(item, r'^"(.*)"\s*:$', 1))


def strip_literals(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), _STRING_LITERAL, '""')

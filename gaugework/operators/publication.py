"""Audit of evidence before it is published: denied field names and unsafe texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.functions import json_keys

# Field names that must not be published (compared in lower case).
DENIED_KEYS = (
    "prompt", "prompts", "rawprompt", "raw_prompt", "rawprompts", "raw_prompts",
    "systemprompt", "system_prompt", "developerprompt", "developer_prompt",
    "userprompt", "user_prompt", "input", "inputs", "rawinput", "raw_input", "output",
    "outputs", "rawoutput", "raw_output", "modeloutput", "model_output",
    "actualoutput", "actual_output", "targetoutput", "target_output",
    "expectedoutput", "expected_output", "response", "responses", "completion",
    "completions", "sql", "rawsql", "raw_sql", "sqlquery", "sql_query", "query",
    "queries", "statement", "statements", "row", "rows", "record", "records",
    "credential", "credentials", "password", "passwords", "passwd", "passphrase",
    "token", "tokens", "accesstoken", "access_token", "refreshtoken",
    "refresh_token", "apitoken", "api_token", "apikey", "api_key", "secret",
    "secrets", "clientsecret", "client_secret", "privatekey", "private_key",
    "authorization", "cookie", "cookies", "session", "sessionid", "session_id", "pii",
    "email", "emails", "emailaddress", "email_address", "phone", "phonenumber",
    "phone_number", "fullname", "full_name", "firstname", "first_name", "lastname",
    "last_name", "username", "user_id", "customer_id", "account_id", "person_id",
    "address", "streetaddress", "street_address", "postalcode", "postal_code",
    "ipaddress", "ip_address", "dateofbirth", "date_of_birth", "dob", "ssn", "taxid",
    "tax_id",
)

# Unsafe text patterns, tried in this order, each with texts of which
# one must occur (in lower case) for the pattern to match at all.
UNSAFE_PATTERNS = (
    (
        "email address",
        ("@",),
        r"(?i)(^|[^a-z0-9.!#$%&'*+/=?^_`{|}~-])[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+(?:$|[^a-z0-9-])",
    ),
    ("URL", ("://", "www."), r"(?i)(?:\b(?:https?|ftp)://|\bwww\.)\S+"),
    ("URL", ("javascript:", "data:", "file:", "mailto:"), r"(?i)\b(?:javascript|data|file|mailto):\S+"),
    ("credential", ("private key-----",), r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("credential", ("akia", "asia"), r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    (
        "credential",
        ("github_pat_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
        r"\b(?:github_pat_|gh[pousr]_)[A-Za-z0-9_]{20,}\b",
    ),
    ("credential", ("xox",), r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"),
    ("credential", ("aiza",), r"\bAIza[A-Za-z0-9_-]{20,}\b"),
    (
        "credential",
        ("sk_", "sk-", "rk_", "rk-", "pk_", "pk-"),
        r"\b(?:sk|rk|pk)[_-](?:live[_-])?[A-Za-z0-9_-]{16,}\b",
    ),
    ("credential", ("eyj",), r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"),
    ("credential", ("basic", "bearer"), r"(?i)\b(?:basic|bearer)\s+[A-Za-z0-9+/_=.-]{8,}\b"),
    (
        "credential",
        ("api", "access", "client", "password", "passwd", "credential"),
        r"(?i)\b(?:api[ _-]?key|access[ _-]?token|client[ _-]?secret|password|passwd|credential)\s*[:=]\s*\S+",
    ),
)
_WIDE_SPACES = "                 　﻿"


def _ascii(text: Column) -> Column:
    """A text in which only ASCII letters are letters, so that word borders mean ASCII words."""
    spaced = F.translate(text, _WIDE_SPACES, " " * len(_WIDE_SPACES))
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(
        F.regexp_replace(spaced, r"[^\x00-\x7f]", "¤")
    )


def unsafe_kind(text: Column) -> Column:
    """The first unsafe kind found in a text, or NULL.

    Cheap substring tests on the lower-cased text keep most texts away from the
    regular expressions.
    """
    lower, plain = F.lower(text), _ascii(text)
    kind = None
    for name, needed, pattern in UNSAFE_PATTERNS:
        likely = lower.contains(needed[0])
        for word in needed[1:]:
            likely = likely | lower.contains(word)
        hit = likely & plain.rlike(pattern)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return kind


_SHORT_ESCAPES = (("/", "/"), ('"', '"'), ("b", " "), ("f", " "), ("n", "\n"), ("r", "\n"), ("t", " "))


def _decoded(text: Column) -> Column:
    """JSON text, or a part of it, with its escapes replaced by what they stand for.

    Escaped code points are decoded one character at a time; escaped backslashes stand
    aside meanwhile, so that they start no other escape.
    """
    aside = "\u0001"

    def characters(plain: Column) -> Column:
        pieces = F.split(plain, r"\\u")
        rest = F.transform(
            F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))),
            # Halves of characters beyond the first plane are no letters of any pattern.
            lambda p: F.when(
                p.rlike("^[dD][89a-fA-F][0-9a-fA-F]{2}"), F.concat(F.lit("¤"), F.substr(p, F.lit(5)))
            ).when(
                p.rlike("^[0-9a-fA-F]{4}"),
                F.concat(
                    F.decode(F.unhex(F.substring(p, 1, 4)), "UTF-16BE"), F.substr(p, F.lit(5))
                ),
            ).otherwise(p),
        )
        return F.concat(F.element_at(pieces, 1), F.array_join(rest, ""))

    plain = F.replace(text, F.lit("\\\\"), F.lit(aside))
    for escape, meaning in _SHORT_ESCAPES:
        plain = F.replace(plain, F.lit("\\" + escape), F.lit(meaning))
    decoded = F.when(F.contains(plain, F.lit("\\u")), characters(plain)).otherwise(plain)
    return F.when(F.contains(text, F.lit("\\")), F.replace(decoded, F.lit(aside), F.lit("\\"))).otherwise(text)


def denied_columns(df: DataFrame, denied: Sequence[str] = DENIED_KEYS) -> list[str]:
    """Dotted paths of schema fields whose name is denied (looks at the schema only)."""
    names = set(denied)
    found: list[str] = []

    def walk(kind: T.DataType, path: str) -> None:
        if isinstance(kind, T.StructType):
            for field in kind.fields:
                here = f"{path}.{field.name}" if path else field.name
                if field.name.lower() in names:
                    found.append(here)
                walk(field.dataType, here)
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, path)
        elif isinstance(kind, T.MapType):
            walk(kind.valueType, path)

    walk(df.schema, "")
    return found


def publication_audit(
    df: DataFrame,
    row_id: str,
    text_columns: Sequence[str] = (),
    json_columns: Sequence[str] = (),
    denied: Sequence[str] = DENIED_KEYS,
    flags: dict[str, str] | None = None,
) -> DataFrame:
    """(row_id, path, kind) per finding; the offending text itself is never shown.

    Text columns are matched as a whole.  Of JSON columns the decoded keys, at any
    depth, are checked for denied names and the decoded text for unsafe strings.  Names
    of all columns, nested fields and map keys are checked, the audited ones too.
    ``flags`` names columns that must hold one value (execution mode, simulated).
    """
    findings = []
    for name in text_columns:
        findings.append(F.struct(F.lit(name).alias("path"), unsafe_kind(F.col(name)).alias("kind")))
    for name in json_columns:
        bad = F.filter(json_keys(name), lambda k: F.lower(_decoded(k)).isin(*denied))
        findings.append(
            F.struct(F.lit(name).alias("path"), F.when(F.size(bad) > 0, "denied key").alias("kind"))
        )
        findings.append(F.struct(F.lit(name).alias("path"), unsafe_kind(_decoded(F.col(name))).alias("kind")))
    for name, value in (flags or {}).items():
        wrong = ~F.col(name).cast("string").eqNullSafe(F.lit(value))
        findings.append(F.struct(F.lit(name).alias("path"), F.when(wrong, "wrong mode").alias("kind")))
    for path in denied_columns(df, denied):
        if path != row_id:
            findings.append(F.struct(F.lit(path).alias("path"), F.lit("denied key").alias("kind")))
    for field in df.schema.fields:
        if isinstance(field.dataType, T.MapType) and isinstance(field.dataType.keyType, T.StringType):
            named = F.exists(F.map_keys(F.col(field.name)), lambda k: F.lower(k).isin(*denied))
            findings.append(F.struct(F.lit(field.name).alias("path"), F.when(named, "denied key").alias("kind")))
    rows = df.select(F.col(row_id).cast("string").alias("row_id"), F.inline(F.array(*findings)))
    return rows.filter(F.col("kind").isNotNull())


def publication_report(audit: DataFrame) -> DataFrame:
    return audit.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("findings"))

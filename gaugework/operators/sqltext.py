"""Read-only audit of SQL texts by their tokens.

Every rule is an expression over one text (at most a few ten kB), so the audit of
any number of statements is a scan without a shuffle.  It looks at words and
names, not at a syntax tree: whether a text parses at all is taken from a recorded
flag when the table has one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the read-only policy.
MAX_SQL_BYTES = 32_768
ALLOWED_TABLES = ("departments", "employees", "projects")
ALLOWED_SCHEMAS = ("public",)
SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "pg_toast")
PROHIBITED_WORDS = (
    "alter", "analyze", "attach", "call", "copy", "create", "delete", "detach", "drop",
    "execute", "grant", "insert", "into", "lock", "merge", "pragma", "revoke",
    "truncate", "update", "use",
)
LOCKING = r"\bfor\s+(?:no\s+key\s+update|update|key\s+share|share)\b"
PROHIBITED_FUNCTIONS = (
    "clock_timestamp", "dblink", "dblink_connect", "dblink_connect_u",
    "dblink_disconnect", "dblink_exec", "dblink_open", "gen_random_uuid", "lo_export",
    "lo_import", "nextval", "pg_backend_pid", "pg_cancel_backend", "pg_logdir_ls",
    "pg_ls_archive_statusdir", "pg_ls_dir", "pg_ls_logdir", "pg_ls_tmpdir",
    "pg_ls_waldir", "pg_notify", "pg_read_binary_file", "pg_read_file",
    "pg_reload_conf", "pg_rotate_logfile", "pg_sleep", "pg_stat_file",
    "pg_terminate_backend", "random", "set_config", "setval", "timeofday",
    "uuid_generate_v1", "uuid_generate_v4",
)
PROHIBITED_PREFIXES = ("dblink_", "lo_", "pg_advisory_", "pg_read_", "pg_write_")
ALLOWED_FUNCTIONS = (
    "abs", "and", "avg", "cast", "ceil", "ceiling", "coalesce", "count", "date_trunc",
    "dense_rank", "extract", "floor", "greatest", "lag", "lead", "least", "length",
    "lower", "max", "min", "not", "nullif", "or", "rank", "replace", "round",
    "row_number", "substring", "sum", "trim", "upper",
)
# Words that may stand before a parenthesis without being a function.
_NOT_FUNCTIONS = (
    "all", "and", "any", "as", "between", "by", "case", "char", "decimal", "distinct",
    "else", "except", "exists", "filter", "from", "group", "having", "in", "intersect",
    "is", "join", "lateral", "like", "limit", "materialized", "not", "numeric",
    "offset", "on", "or", "order", "over", "partition", "recursive", "select", "some",
    "then", "union", "using", "values", "varchar", "when", "where", "with", "within",
)

# A backslash escapes only in E'..' strings; other letters pass without trying the four forms.
_QUOTES = (
    r"(?=[eE'$\"])(?:((?<![A-Za-z0-9_$])[eE]'(?:[^'\\]++|\\[\s\S]|'')*+'|'(?:[^']++|'')*+'"
    r"|\$((?:[A-Za-z_][A-Za-z0-9_]*)?)\$[\s\S]*?\$\2\$)"
    r'|("(?:[^"]++|"")*+"))'
)
_QUOTED_NAME = r'"(?:[^"]++|"")*+"'
_NAME = r"[a-z_][a-z0-9_$]*"


def _holds(text: Column, *parts: str) -> Column:
    """Whether a text holds any of the parts: far cheaper than a pattern that needs one of them."""
    found = F.contains(text, F.lit(parts[0]))
    for part in parts[1:]:
        found = found | F.contains(text, F.lit(part))
    return found


def _without_literals(sql: Column) -> Column:
    """Text with strings replaced by '' and quoted names kept."""
    return F.when(_holds(sql, "'", '"', "$"), F.regexp_replace(sql, _QUOTES, "$3 ")).otherwise(sql)


def _clean(bare: Column) -> Column:
    """Lower-case text, given without literals, without comments and simple quotes around names.

    A quoted name that is not plain lower case can match no allowed name, so it
    becomes a marker.
    """
    plain = F.regexp_replace(bare, r'"([a-z_][a-z0-9_$]*)"', "$1")
    marked = F.when(_holds(bare, '"'), F.regexp_replace(plain, _QUOTED_NAME, "_quoted_name_")).otherwise(bare)
    # Names take the place of names, so no comment begins that did not before.
    uncommented = F.regexp_replace(marked, r"--[^\n]*|/\*[\s\S]*?\*/", " ")
    return F.lower(F.when(_holds(bare, "--", "/*"), uncommented).otherwise(marked))


def _unquoted(bare: Column) -> Column:
    """Text, given without literals, without its quoted names."""
    return F.when(_holds(bare, '"'), F.regexp_replace(bare, _QUOTED_NAME, " ")).otherwise(bare)


def _matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


_ITEM = rf"{_NAME}(?:\s*\.\s*{_NAME})*"
_BEFORE = r"^ *+(?:(?:lateral|only)\b\s*+)?+"
_QUERY = r"(?:select|with|values|table)\b"
_CLAUSE_END = r"\b(?=[wgohlueifr])(?:where|group|order|having|limit|offset|union|except|intersect|window|fetch|for|returning|from)\b"
# Nesting of parentheses that is looked into; deeper texts are refused.
MAX_DEPTH = 16
UNKNOWN_SOURCE = "?"


def _flat_parts(clean: Column) -> Column:
    """``parts``: the text of every parenthesis level without inner levels, and what is ``left`` of the text.

    From the inside out, subqueries become ``@q``, other parentheses ``@``; a parenthesised
    source after FROM or JOIN loses its parentheses, so that its members join the list.
    """

    def step(state: Column, _: Column) -> Column:
        text = state["left"]
        plain = F.regexp_replace(text, r"\b(?=[estop])(?:extract|substring|trim|overlay|position)\s*\([^()]*\)", " @ ")
        plain = F.when(_holds(text, "extract", "substring", "trim", "overlay", "position"), plain).otherwise(text)
        plain = F.regexp_replace(plain, rf"\b(from|join)\s*\((?!\s*{_QUERY})([^()]*)\)", "$1 $2 ")

        def taken(plain: Column) -> Column:
            inner = F.regexp_extract_all(plain, F.lit(r"\(([^()]*)\)"), F.lit(1))
            left = F.regexp_replace(plain, rf"\(\s*{_QUERY}[^()]*\)", " @q ")
            left = F.regexp_replace(left, r"\([^()]*\)", " @ ")
            return F.struct(F.concat(state["parts"], inner).alias("parts"), left.alias("left"))

        # One element, so that ``plain`` is made once; without a parenthesis nothing is left to take.
        once = F.element_at(F.transform(F.array(plain), taken), 1)
        return F.when(F.contains(text, F.lit("(")), once).otherwise(state)

    unlike = F.regexp_replace(clean, r"\bis\s+(not\s+)?distinct\s+from\b", " = ")
    start = F.when(_holds(clean, "distinct"), unlike).otherwise(clean)
    begin = F.struct(F.array().cast("array<string>").alias("parts"), start.alias("left"))
    opened = F.length(clean) - F.length(F.replace(clean, F.lit("("), F.lit("")))
    steps = F.sequence(F.lit(1), F.least(F.lit(MAX_DEPTH), opened + 1))
    return F.when(_holds(clean, "("), F.aggregate(steps, begin, step)).otherwise(begin)


def table_names(clean: Column) -> Column:
    """Names of all sources after FROM, JOIN and TABLE at any depth, as written.

    A source that is neither a name nor a subquery, and a text nested too deeply, give
    ``UNKNOWN_SOURCE``, which no policy allows.
    """
    return F.element_at(F.transform(F.array(_flat_parts(clean)), _names_in), 1)


def _names_in(flat: Column) -> Column:
    """``table_names`` of a text's ``_flat_parts``."""

    def of_part(part: Column) -> Column:
        # A clause ends before a word, so only words are looked at.
        lists = _matches(part, rf"\bfrom\b((?:\W++|(?!{_CLAUSE_END})\w++)*+)")
        sources = F.flatten(F.transform(lists, lambda text: F.split(F.regexp_replace(text, r"\bjoin\b", ","), ",")))
        named = F.transform(
            F.filter(sources, lambda s: ~s.rlike(rf"{_BEFORE}@q\b")),
            lambda s: F.when(
                s.rlike(rf"{_BEFORE}{_NAME}"), F.regexp_replace(F.regexp_extract(s, rf"{_BEFORE}({_ITEM})", 1), r"\s", "")
            ).otherwise(UNKNOWN_SOURCE),
        )
        commands = F.transform(
            _matches(part, rf"\btable\s+(?:only\s+)?({_ITEM})"), lambda n: F.regexp_replace(n, r"\s", "")
        )
        return F.when(_holds(part, "table"), F.concat(named, commands)).otherwise(named)

    parts = F.filter(
        F.concat(flat["parts"], F.array(flat["left"])), lambda part: part.isNull() | _holds(part, "from", "table")
    )
    named = F.flatten(F.transform(parts, of_part))
    return F.when(_holds(flat["left"], "(", ")"), F.concat(named, F.array(F.lit(UNKNOWN_SOURCE)))).otherwise(named)


_CTE_HEAD = rf"(?:\bwith|\brecursive|,)\s+({_NAME})\s*(?:\([^()]*\)\s*)?as\s*(?:(?:not\s+)?materialized\s*)?\("


def _may_name_ctes(clean: Column) -> Column:
    return _holds(clean, "(") & clean.rlike(r"as\s*(?:(?:not\s+)?materialized\s*)?\(")


def cte_names(clean: Column) -> Column:
    return F.when(clean.isNull() | _may_name_ctes(clean), _matches(clean, _CTE_HEAD)).otherwise(F.array().cast("array<string>"))


def function_names(clean: Column) -> Column:
    """Names before a parenthesis; the column list of a common table expression is no call."""
    without_heads = F.when(_may_name_ctes(clean), F.regexp_replace(clean, _CTE_HEAD, " (")).otherwise(clean)
    before = _matches(without_heads, rf"\b({_NAME}+)\s*+\(")
    called = F.array_distinct(F.filter(before, lambda name: ~name.isin(*_NOT_FUNCTIONS)))
    return F.when(clean.isNull() | _holds(clean, "("), called).otherwise(F.array().cast("array<string>"))


def _words(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def sql_text_audit(
    executions: DataFrame,
    tables: Sequence[str] = ALLOWED_TABLES,
    functions: Sequence[str] = ALLOWED_FUNCTIONS,
    denied: Sequence[str] = PROHIBITED_FUNCTIONS,
    max_bytes: int = MAX_SQL_BYTES,
) -> DataFrame:
    """Add ``allowed``, ``reason_code`` and ``parse_valid`` to each execution.

    The reason is ``allowed`` or the first failing rule in the policy's fixed order.
    Each stage leaves through a one-row generator, so no text is scanned twice.
    """
    own_columns = [c for c in executions.columns if c not in ("allowed", "reason_code", "parse_valid")]
    recorded = F.col("parse_valid") if "parse_valid" in executions.columns else F.lit(True)
    bared = executions.select(
        *own_columns, F.coalesce(recorded, F.lit(True)).alias("_recorded"),
        F.inline(F.array(F.struct(_without_literals(F.col("sql")).alias("_bare")))),
    )
    bare = F.col("_bare")
    # Quoted names are names, whatever word they spell.
    texts = bared.select(
        *own_columns, "_recorded",
        F.inline(F.array(F.struct(_clean(bare).alias("_clean"), F.lower(_unquoted(bare)).alias("_unquoted")))),
    )
    clean, unquoted = F.col("_clean"), F.col("_unquoted")
    initials = "".join(sorted({word[0] for word in PROHIBITED_WORDS}))
    spelled = rf"\b(?=[{initials}])(?:{'|'.join(PROHIBITED_WORDS)})\b"
    # The first failing rule is the reason, so that later rules scan only texts that passed the ones before.
    early = (
        F.when(F.octet_length("sql") > max_bytes, "sql_too_large")
        .when(~F.col("_recorded") | ~clean.rlike(r"[^\s;]"), "invalid_sql")
        .when(_holds(clean, ";") & clean.rlike(r"[^\s;][^;]*+;[\s;]*+[^\s;]"), "multiple_statements")
        .when(_holds(unquoted, "--", "/*"), "comments_not_allowed")
        .when(~F.regexp_extract(clean, rf"^[\s(]*({_NAME})", 1).isin("select", "with"), "non_query_statement")
        .when(
            # A name may hold such a word next to a dollar sign.
            unquoted.rlike(spelled)
            & F.arrays_overlap(_matches(unquoted, rf"\b({_NAME})\b"), _words(PROHIBITED_WORDS))
            | _holds(clean, "for") & clean.rlike(LOCKING),
            "prohibited_operation",
        )
    )
    begun = texts.select(*own_columns, "_clean", F.inline(F.array(F.struct(early.alias("_early")))))

    def not_own(names: Column) -> Column:
        return F.filter(
            names["sources"], lambda p: (F.size(p) > 1) | ~F.array_contains(names["own"], F.element_at(p, 1))
        )

    sources = F.transform(table_names(clean), lambda n: F.split(n, r"\."))
    named = F.array(F.struct(cte_names(clean).alias("own"), sources.alias("sources")))
    passed = F.when(F.col("_early").isNull(), F.element_at(F.transform(named, not_own), 1))
    facts = begun.select(*own_columns, "_clean", "_early", F.inline(F.array(F.struct(passed.alias("_foreign")))))
    foreign = F.col("_foreign")
    system = F.exists(
        foreign,
        lambda p: (F.size(p) > 1)
        & F.arrays_overlap(F.slice(p, F.lit(1), F.size(p) - 1), _words(SYSTEM_SCHEMAS)),
    )
    unknown = F.exists(
        foreign,
        lambda p: (F.size(p) > 2)
        | ((F.size(p) == 2) & ~F.element_at(p, 1).isin(*ALLOWED_SCHEMAS))
        | ~F.element_at(p, -1).isin(*tables),
    )
    prefixed = "^(?:" + "|".join(PROHIBITED_PREFIXES) + ")"
    refused = F.exists(function_names(clean), lambda f: f.isin(*denied) | f.rlike(prefixed) | ~f.isin(*functions))
    reason = (
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when(system, "system_schema")
        .when(unknown, "table_not_allowed")
        .when(refused, "prohibited_function")
        .otherwise("allowed")
    )
    judged = facts.select(*own_columns, F.explode(F.array(reason)).alias("reason_code"))
    return judged.select(
        "*",
        (F.col("reason_code") == "allowed").alias("allowed"),
        (~F.col("reason_code").isin("sql_too_large", "invalid_sql")).alias("parse_valid"),
    )

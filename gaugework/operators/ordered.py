"""Ordered work inside groups of any size.

A plain window puts one whole group into one task.  Groups above a row limit are
cut here into value ranges (from a mergeable quantile sketch of the leading order
column); windows then run per (group, range) and small per-range totals carry
ranks, running sums and previous rows over the range borders.  Results are exact:
the sketch only chooses where to cut.  Inputs of any size take this plan; without a
hot group the runtime re-plan drops its joins.  A caller who knows that groups are
short may pass ``hot_rows=None`` for a plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

HOT_ROWS = 4_000_000
RANGES = 256
_CUT_ROWS = 4  # ranges per hot-row limit that a group is cut into, up to RANGES


def split_hot_groups(
    df: DataFrame,
    keys: Sequence[str],
    lead: Column,
    hot_rows: int = HOT_ROWS,
    ranges: int = RANGES,
) -> DataFrame:
    """Add ``_range``: 0 for normal groups, the value range of ``lead`` for hot ones.

    Rows with equal ``lead`` share a range, and ranges follow the order of ``lead``.

    One pass over the keys counts the groups.  Hot groups and their cuts are broadcast,
    which their number bounds: there is at most one hot group per ``hot_rows`` rows of
    the input, and about ``_CUT_ROWS`` cuts per ``hot_rows`` rows.  Without a hot group
    the runtime re-plan drops the pass that makes cuts, and both joins.
    """
    hot = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > hot_rows)
    )
    rows = df.withColumn("_lead", lead.cast("double"))
    points = [i / ranges for i in range(1, ranges)]
    same = _all([F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    sketched = (
        rows.select(*keys, "_lead")
        .alias("l")
        .join(F.broadcast(hot.alias("r")), same)
        .groupBy(*[F.col(f"l.{k}").alias(k) for k in keys])
        .agg(F.percentile_approx("l._lead", points, 10_000).alias("_all_cuts"), F.max("r._rows").alias("_rows"))
    )
    wanted = F.least(F.lit(ranges), F.ceil(F.col("_rows") * _CUT_ROWS / hot_rows)).cast("int")
    cuts = sketched.select(
        *keys,
        F.transform(
            F.sequence(F.lit(1), wanted - 1), lambda i: F.element_at("_all_cuts", F.floor(i * ranges / wanted).cast("int"))
        ).alias("_cuts"),
    )
    joined = rows.alias("l").join(F.broadcast(cuts.alias("r")), same, "left")
    lead_value = F.col("l._lead")
    position = F.size(F.filter(F.col("r._cuts"), lambda cut: cut < lead_value))
    return joined.select(
        *[F.col(f"l.{name}") for name in df.columns],
        F.when(F.col("r._cuts").isNull(), F.lit(0)).otherwise(position).alias("_range"),
    )


def _all(conditions: Sequence[Column]) -> Column:
    merged = conditions[0]
    for condition in conditions[1:]:
        merged = merged & condition
    return merged


def range_offsets(
    ranged: DataFrame, keys: Sequence[str], amount: Column, descending: bool = False
) -> DataFrame:
    """Per (keys, range): ``_before`` (amount in earlier ranges) and ``_total``."""
    order = F.col("_range").desc() if descending else F.col("_range").asc()
    earlier = W.partitionBy(*keys).orderBy(order).rowsBetween(
        W.unboundedPreceding, -1
    )
    totals = ranged.groupBy(*keys, "_range").agg(F.sum(amount).alias("_amount"))
    return totals.select(
        *keys,
        "_range",
        F.coalesce(F.sum("_amount").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_amount").over(W.partitionBy(*keys)).alias("_total"),
    )


def join_ranges(ranged: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach per-range values; partitioned like the window that follows."""
    left, right = ranged.alias("l"), offsets.alias("r")
    on = _all(
        [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
        + [F.col("l._range") == F.col("r._range")]
    )
    extra = [c for c in offsets.columns if c not in (*keys, "_range")]
    return left.join(right, on).select(
        *[F.col(f"l.{c}") for c in ranged.columns], *[F.col(f"r.{c}") for c in extra]
    )


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    lead: Column,
    order: Sequence[Column],
    name: str = "rank",
    descending: bool = False,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Add the row number within ``keys``; ``lead`` must agree with ``order``."""
    if hot_rows is None:
        plain = W.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(plain).cast("bigint"))
    ranged = split_hot_groups(df, keys, lead, hot_rows)
    offsets = range_offsets(ranged, keys, F.lit(1), descending)
    window = W.partitionBy(*keys, "_range").orderBy(*order)
    placed = join_ranges(ranged, offsets.drop("_total"), keys)
    return placed.select(
        *df.columns, (F.col("_before") + F.row_number().over(window)).alias(name)
    )


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    lead: Column,
    order: Sequence[str],
    carried: Sequence[str],
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Add ``_prev_<c>`` for each carried column: its value in the previous row."""
    if hot_rows is None:
        plain = W.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[F.lag(c).over(plain).alias(f"_prev_{c}") for c in carried])
    ranged = split_hot_groups(df, keys, lead, hot_rows)
    last = ranged.groupBy(*keys, "_range").agg(
        F.max_by(F.struct(*carried), F.struct(*order)).alias("_last")
    )
    across = W.partitionBy(*keys).orderBy("_range")
    borders = last.select(*keys, "_range", F.lag("_last").over(across).alias("_border"))
    within = W.partitionBy(*keys, "_range").orderBy(*order)
    joined = join_ranges(ranged, borders, keys).withColumn(
        "_previous",
        F.coalesce(F.lag(F.struct(*carried)).over(within), F.col("_border")),
    )
    return joined.select(
        *df.columns, *[F.col(f"_previous.{c}").alias(f"_prev_{c}") for c in carried]
    )


def first_occurrence(
    rows: DataFrame, key: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Add ``is_first``: the row with the least ``order`` per key.

    The least position per key is a combinable aggregate, and the join back runs
    on key and position, so many copies of one key spread over all tasks.
    ``order`` must be unique within a key.
    """
    firsts = rows.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first"))
    flat = firsts.select(
        *key, *[F.col(f"_first.{c}").alias(c) for c in order]
    ).withColumn("_hit", F.lit(True))
    left, right = rows.alias("l"), flat.alias("r")
    on = _all([F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*key, *order)])
    return left.join(right, on, "left").select(
        *[F.col(f"l.{c}") for c in rows.columns],
        F.coalesce(F.col("r._hit"), F.lit(False)).alias("is_first"),
    )


def keyset_page(
    df: DataFrame,
    order: Sequence[str],
    after: Sequence | None,
    limit: int,
    descending: bool = False,
) -> DataFrame:
    """One page strictly after a key in tuple order, with ``has_next`` on each row.

    Reads ``limit + 1`` rows to know whether another page follows; the sort is a
    bounded top-k per task.
    """
    page = df
    if after is not None:
        here = F.struct(*[F.col(c) for c in order])
        types = dict(df.dtypes)
        bound = F.struct(
            *[F.lit(v).cast(types[c]).alias(c) for c, v in zip(order, after, strict=True)]
        )
        page = page.filter(here < bound if descending else here > bound)
    columns = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    top = page.orderBy(*columns).limit(limit + 1)
    number = W.orderBy(*columns)
    counted = top.withColumn("_n", F.row_number().over(number)).withColumn(
        "has_next", F.max("_n").over(W.partitionBy()) > limit
    )
    return counted.filter(F.col("_n") <= limit).drop("_n")


def canonical_order(df: DataFrame, columns: Sequence[str] = ("metric", "slice", "case_id")) -> DataFrame:
    """Order for sinks: metric, slice (all-cases scope first), case id."""
    present = [c for c in columns if c in df.columns]
    return df.orderBy(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in present])

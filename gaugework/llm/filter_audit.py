"""How text filters interact: what every order of them keeps, removes and finds removed already.

A document fails some of five filters.  Its truth-table survival word has one bit for each of the 32 subsets of
filters, set where it survives the whole subset.  Positional popcounts of the words, by carry-save addition, say
how many documents of a part (and of a label in it) survive each subset, and everything asked of an order of
filters is a difference of two such counts.  Tasks turn batches of words into 32 counts per part; sums of these
are all that is shuffled, so a part may hold any share of the rows.

The filters, over words ``[^\\x20\\x09-\\x0D]+`` of whole texts (null: empty): A fewer than 200 words; B distinct
words under half of all; C more than 3 % of the code points in A-Z; D any of ``#$%&*|``; E the same text as a
document of smaller id, wherever that one is.  A to D need only the text.  For E, texts travel as SHA-256 digests,
the least id per digest is a combinable aggregate, and documents meet it on their id, so that a text held by a
third of all rows is no hot key.

Null ids carry no label and are never copies; equal rows count as often as they occur; rows that share an id share
its labels (1 where any of its label rows says 1) and are no copies of each other.  A null part is the empty
string.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.shared import written

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
SYMBOLS = b"#$%&*|"
ORDERS = ["".join(order) for order in itertools.permutations(FILTERS)]
LABELS = ("all", "good", "toxic")

# Bit s of WORDS[f] is set where failing the filters f leaves no filter of the subset s failed.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & f) for f in range(SUBSETS)], np.uint32)


def positional_popcount(words: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """How often each of the 32 bit positions is set in ``words``, each counted ``times`` times.

    Levels hold words of equal weight.  A carry-save adder turns three words of a level into one of the same level
    and one of twice the weight, for all positions and all triples at once; what cannot be added is counted.
    """
    times = np.ones(len(words), np.int64) if times is None else np.asarray(times, np.int64)
    counts = np.zeros(32, np.int64)
    level, carried = 0, np.empty(0, np.uint32)
    while len(carried) or (times >> level).any():
        held = np.concatenate([words[(times >> level) & 1 == 1], carried])
        carried = []
        while len(held) > 2:
            third = len(held) // 3
            a, b, c, rest = held[:third], held[third : 2 * third], held[2 * third : 3 * third], held[3 * third :]
            either = a ^ b
            carried.append((a & b) | (either & c))
            held = np.concatenate([either ^ c, rest])
        for word in held.tolist():
            counts += np.array([(word >> k) & 1 for k in range(32)], np.int64) << level
        carried = np.concatenate(carried) if carried else np.empty(0, np.uint32)
        level += 1
    return counts


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()  # bytes split at exactly these six characters
    count, letters = len(words), np.frombuffer(text, np.uint8)
    upper = int(((letters >= 65) & (letters <= 90)).sum())
    points = int((letters & 0xC0 != 0x80).sum())
    return (
        (count < 200)
        | (100 * len(set(words)) < 50 * count) << 1
        | (100 * upper > 3 * points) << 2
        | any(symbol in text for symbol in SYMBOLS) << 3
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks, digests = [], []
        for text in batch.column(2):
            text = text.as_py() or b""
            masks.append(failures(text))
            digests.append(hashlib.sha256(text).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
            names=["doc_id", "part", "failed", "digest"],
        )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Survivors of each subset per part and label of a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        parts, failed, times, good, toxic = (batch.column(k) for k in range(5))
        coded = parts.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        words, times = WORDS[failed.to_numpy()], times.to_numpy()
        chosen = [np.ones(len(code), bool), good.to_numpy(zero_copy_only=False), toxic.to_numpy(zero_copy_only=False)]
        order = np.argsort(code, kind="stable")
        borders = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
        found = {name: [] for name in LABELS}
        for k in range(len(coded.dictionary)):
            rows = order[borders[k] : borders[k + 1]]
            for name, has in zip(LABELS, chosen):
                own = rows[has[rows]]
                found[name].append(positional_popcount(words[own], times[own]).tolist())
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary, *(pa.array(found[name], pa.list_(pa.int64())) for name in LABELS)],
            names=["part", *LABELS],
        )


def survivors(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """``part`` and, for all, good and toxic documents, the 32 counts of those that survive each subset of filters."""
    read = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.col("text").cast("binary").alias("text"),
    ).mapInArrow(_read, "doc_id bigint, part string, failed int, digest binary")
    facts = written(read, "filter-facts")
    first = facts.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    named = (
        labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    )
    # Equal rows collapse before they move, so an id that many rows share is one row per text and part.
    held = facts.groupBy("doc_id", "part", "failed", "digest").agg(F.count("*").alias("times"))
    without_id = held.where("doc_id IS NULL").select("part", "failed", "times", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    with_id = (
        held.where("doc_id IS NOT NULL")
        .join(first.withColumn("first", F.lit(True)), ["doc_id", "digest"], "left")
        .join(named, "doc_id", "left")
        .select(
            "part", F.when(F.col("first"), F.col("failed")).otherwise(F.col("failed") + F.lit(16)).alias("failed"), "times",
            F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
        )
    )
    counted = with_id.unionByName(without_id).mapInArrow(
        _count, "part string, " + ", ".join(f"{name} array<bigint>" for name in LABELS)
    )
    sums = [
        F.array(*[F.sum(F.col(name)[k]) for k in range(SUBSETS)]).alias(name) for name in LABELS
    ]
    return counted.groupBy("part").agg(*sums)


def _subset(letters: Column) -> Column:
    return sum(
        (F.when(F.instr(letters, letter) > 0, 1 << k).otherwise(0) for k, letter in enumerate(FILTERS)), F.lit(0)
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step; counts as the module and the column names say."""
    counted = survivors(docs, labels, part)
    every = F.lit(SUBSETS - 1)

    def left(name: str, subset: Column) -> Column:
        return F.get(F.col(name), subset)

    steps = (
        counted.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
        .select(
            "*",
            _subset(F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1)).alias("_before"),
            _subset(F.substring(F.col("filter_order"), F.col("step"), F.lit(1))).alias("_own"),
        )
        .withColumn("_after", F.col("_before") + F.col("_own"))
    )

    def lost(name: str) -> Column:
        return left(name, F.col("_before")) - left(name, F.col("_after"))

    # A subset of k of the other four stands before a filter in k! (4 - k)! of the 120 orders.
    ways = F.array(*[F.lit(math.factorial(k) * math.factorial(4 - k)).cast("bigint") for k in range(len(FILTERS))])
    shapley = F.aggregate(
        F.filter(F.sequence(F.lit(0), every), lambda s: s.bitwiseAND(F.col("_own")) == 0), F.lit(0).cast("bigint"),
        lambda total, s: total + F.get(ways, F.bit_count(s)) * (left("all", s) - left("all", s + F.col("_own"))),
    )
    return steps.select(
        "part", "filter_order", "step",
        left("all", F.col("_after")).alias("kept"),
        lost("all").alias("removed"),
        (left("all", F.lit(0)) - left("all", F.col("_own")) - lost("all")).alias("redundant"),
        (left("all", every - F.col("_own")) - left("all", every)).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def oracle() -> str:
    """The audit of ``documents`` in DuckDB SQL."""
    letters = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS"
    order = " || ".join(f"f{k}.x" for k in range(1, 6))
    distinct = " AND ".join(f"f{i}.x <> f{j}.x" for i, j in itertools.combinations(range(1, 6), 2))
    bits = ", ".join(f"f{k}.b AS b{k}" for k in range(1, 6))
    before = " + ".join(f"CASE WHEN step > {k} THEN b{k} ELSE 0 END" for k in range(1, 6))
    own = " ".join(f"WHEN {k} THEN b{k}" for k in range(1, 6))
    return f"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d),
    l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    m AS (
      SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS failed
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
    c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM m GROUP BY ALL),
    o AS (SELECT {order} AS filter_order, {bits} FROM {letters} f1(x, b), {letters} f2(x, b), {letters} f3(x, b), {letters} f4(x, b), {letters} f5(x, b) WHERE {distinct}),
    s AS (SELECT filter_order, step, {before} AS before, CASE step {own} END AS own FROM o, range(1, 6) AS r(step)),
    found AS (
      SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
        CAST(sum(CASE WHEN failed & (before + own) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
        CAST(sum(CASE WHEN failed & before = 0 AND failed & own <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
        CAST(sum(CASE WHEN failed & before <> 0 AND failed & own <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
        CAST(sum(CASE WHEN failed = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
        CAST(sum(CASE WHEN failed & before = 0 AND failed & own <> 0 THEN g ELSE 0 END) AS BIGINT) AS good_lost,
        CAST(sum(CASE WHEN failed & before = 0 AND failed & own <> 0 THEN t ELSE 0 END) AS BIGINT) AS toxic_lost
      FROM c, s GROUP BY ALL)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
      CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM found"""

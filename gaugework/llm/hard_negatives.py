"""Hard negatives by a multiway hyperplane tree with sibling ranges (GNAT).

Components become ``floor(256 x)``; scores are integer inner products.  A point gets one more component, the root of
what its squared length lacks of the largest one, and an anchor a zero, so a score and a distance determine each
other, and a window of scores is an annulus around the anchor.

The tree: a node has up to ``ARITY`` split points, spread over its part of a bounded sample, and every point of the
table goes to the nearest one, level by level.  A node stores for each split point and each sibling subtree the
least and largest distance of the subtree's points to the split point, over the whole table.  A search with an
annulus measures an anchor's distance to the split points and leaves out every subtree of which some range does not
meet the annulus as the triangle inequality moves it.  Leaves that stay are compared exactly.  Where vectors are
nearly isotropic the ranges exclude few of them, and work grows with anchors times vectors.

On the cluster, leaves lie in groups of at most ``GROUP`` points (a larger leaf has several), anchors in blocks of
neighbouring groups, and a task compares one block with one group.  The first search finds positives, from the
score that the sample guarantees upwards; the second finds negatives for the windows below the positives.

Points of one label that are equal form a class that keeps its smallest ids, as many as an answer can name; equal
anchors are searched once.  Hence no group of copies is expanded, and no answer is lost.

Rows with a null id or label, a vector that is null, empty, of another length than most (the shorter at a tie),
holds null or non-finite components, or components so large that scores leave the range of exact windows
(``largest``: 2 ** 24.5 after scaling at 64 components), take no part.  Equal rows count once.  An id with several
rows is answered for each; its own id is never a positive.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.shared import written

SAMPLE_ROWS = 4096
ARITY = 16
LEVELS = 3
LEAF = 512  # points a leaf should hold; there are at most ARITY ** LEVELS leaves
GROUP = 8192
SPAN = 16  # groups whose anchors make a block
AT_ONCE = 512  # anchors of a block that are compared at once
SCALE = 256.0
POINTS = "id bigint, label bigint, point binary, norm bigint"


def largest(dims: int) -> int:
    """The largest component for which a hundredfold score is a 64-bit integer."""
    return min(2**31 - 1, math.isqrt(2**55 // max(1, dims)))


def _matrix(column, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, dims)


def _quantised(dims: int):
    limit = largest(dims)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            scaled = np.floor(SCALE * np.clip(flat, -(2.0**40), 2.0**40))
            fits = (np.abs(scaled) <= limit).all(axis=1)
            points = scaled[fits].astype(np.int32)
            rows = pa.array(np.flatnonzero(fits))
            norms = (points.astype(np.int64) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array([p.tobytes() for p in points], pa.binary()), pa.array(norms)],
                names=["id", "label", "point", "norm"],
            )

    return cut


class Tree:
    """Split points of all nodes, ranges of their subtrees, and searches by annulus."""

    def __init__(self, sample: np.ndarray, top: int, levels: int):
        """``top``: the largest squared length of any point."""
        self.top = float(top)
        self.splits: list[np.ndarray] = []  # by node: one row per split point
        self.child: list[list[int]] = []  # by node and split point: a node, or -1 - leaf
        self.leaves = 0
        self._grow(np.unique(self.lift(sample), axis=0), levels)
        # Of all points, filled by ``learn``: node, split point, subtree.
        self.low = [np.full((len(s), len(s)), np.inf) for s in self.splits]
        self.high = [np.full((len(s), len(s)), -np.inf) for s in self.splits]

    def lift(self, points: np.ndarray) -> np.ndarray:
        wide = points.astype(float)
        return np.hstack([wide, np.sqrt(np.maximum(self.top - (wide**2).sum(axis=1, keepdims=True), 0))])

    def _grow(self, points: np.ndarray, levels: int) -> int:
        node = len(self.splits)
        chosen = [int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmax())]
        away = ((points - points[chosen[0]]) ** 2).sum(axis=1)
        while len(chosen) < min(ARITY, len(points)):
            chosen.append(int(away.argmax()))
            away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        self.splits.append(points[chosen])
        self.child.append([0] * len(chosen))
        near = self._distances(node, points).argmin(axis=1)
        for k in range(len(chosen)):
            own = points[near == k]
            if levels > 1 and len(own) > 1:
                self.child[node][k] = self._grow(own, levels - 1)
            else:
                self.child[node][k] = -1 - self.leaves
                self.leaves += 1
        return node

    def _distances(self, node: int, lifted: np.ndarray) -> np.ndarray:
        splits = self.splits[node]
        squares = (lifted**2).sum(axis=1)[:, None] - 2 * lifted @ splits.T + (splits**2).sum(axis=1)[None]
        return np.sqrt(np.maximum(squares, 0))

    def route(self, points: np.ndarray, learn: bool = False) -> np.ndarray:
        """The leaf of each point; with ``learn`` the ranges on its way are widened to hold it."""
        lifted, leaf = self.lift(points), np.zeros(len(points), np.int32)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            far = self._distances(node, lifted[rows])
            near = far.argmin(axis=1)
            for k, child in enumerate(self.child[node]):
                own = near == k
                if not own.any():
                    continue
                if learn:
                    self.low[node][:, k] = np.minimum(self.low[node][:, k], far[own].min(axis=0))
                    self.high[node][:, k] = np.maximum(self.high[node][:, k], far[own].max(axis=0))
                if child < 0:
                    leaf[rows[own]] = -1 - child
                else:
                    todo.append((child, rows[own]))
        return leaf

    def open(self, anchors: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Leaves that may hold a point whose score with the anchor lies between ``least`` and ``most``."""
        wide = anchors.astype(float)
        lifted = np.hstack([wide, np.zeros((len(wide), 1))])
        whole = self.top + (wide**2).sum(axis=1)
        inner, outer = (np.sqrt(np.maximum(whole - 2.0 * bound, 0)) for bound in (most, least))
        slack = 4e-6 * np.sqrt(whole) + 1e-9  # more than rounding moves a distance
        found = np.zeros((len(anchors), self.leaves), bool)
        todo = [(0, np.flatnonzero(inner <= outer + slack))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            far = self._distances(node, lifted[rows])
            low = np.maximum(far - outer[rows, None], inner[rows, None] - far) - slack[rows, None]
            high = far + outer[rows, None] + slack[rows, None]
            for k, child in enumerate(self.child[node]):
                alive = ((self.low[node][:, k] <= high) & (self.high[node][:, k] >= low)).all(axis=1)
                if child < 0:
                    found[rows[alive], -1 - child] = True
                else:
                    todo.append((child, rows[alive]))
        return found


def _ranges(tree: Tree, dims: int):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                tree.route(_matrix(batch.column(0), dims), learn=True)
        rows = [
            (node, int(i), int(j), float(tree.low[node][i, j]), float(tree.high[node][i, j]))
            for node in range(len(tree.splits)) for i, j in np.argwhere(np.isfinite(tree.low[node]))
        ]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*rows)], schema=pa.schema(
                    [("node", pa.int32()), ("split", pa.int32()), ("subtree", pa.int32()), ("low", pa.float64()), ("high", pa.float64())]
                )
            )

    return learn


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as 64-bit integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def first(scores: np.ndarray, allowed: np.ndarray, start: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Row, id and score of the ``k`` first allowed ids of each row: higher scores, then smaller ids.

    Column ``c`` of ``scores`` stands for the ascending ``ids[start[c]:start[c + 1]]``.
    """
    least = np.iinfo(np.int64).min
    masked = np.where(allowed, scores, least)
    if masked.shape[1] > k:
        bound = np.partition(masked, masked.shape[1] - k, axis=1)[:, -k]
        allowed = allowed & (masked >= bound[:, None])
    row, column = np.nonzero(allowed)
    count = np.diff(start)[column]
    place = np.repeat(start[column] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    row, score, found = np.repeat(row, count), np.repeat(scores[row, column], count), ids[place]
    order = np.lexsort((found, -score, row))
    row, score, found = row[order], score[order], found[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], found[rank < k], score[rank < k]


class Held:
    """Classes of points to compare anchors with."""

    def __init__(self, table, dims: int):
        self.points = _matrix(table["point"], dims)
        self.labels = table["label"].to_numpy()
        lists = table["ids"].combine_chunks() if isinstance(table["ids"], pa.ChunkedArray) else table["ids"]
        self.start, self.ids = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()


class Miner:
    """What a search needs on every machine; all of it is bounded."""

    def __init__(self, tree: Tree, dims: int, sample: Held, head: np.ndarray, parts: np.ndarray, positives: int, negatives: int, low: int, high: int):
        """``head`` and ``parts``: the first group of a leaf, and how many it has."""
        self.tree, self.dims, self.sample, self.head, self.parts = tree, dims, sample, head, parts
        self.positives, self.negatives, self.low, self.high = positives, negatives, low, high

    def near(self, points: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Leaves that may hold the anchors' positives: scores from the last that the sample has."""
        scores = np.where(labels[:, None] == self.sample.labels, products(points, self.sample.points), np.iinfo(np.int64).min)
        enough = scores.shape[1] > self.positives
        least = np.partition(scores, -1 - self.positives, axis=1)[:, -1 - self.positives] if enough else np.full(len(points), np.iinfo(np.int64).min)
        return self.tree.open(points, np.maximum(least.astype(float), -(2.0**60)), np.full(len(points), 2.0**60))

    def allowed(self, scores: np.ndarray, tops: np.ndarray) -> np.ndarray:
        """Windows below the positives' scores."""
        return (self.low * tops[:, None] <= 100 * scores) & (100 * scores <= self.high * tops[:, None])

    def windows(self, points: np.ndarray, labels: np.ndarray, tops: np.ndarray) -> np.ndarray:
        """Leaves that may hold the first negatives of windows below ``tops``."""
        scores = products(points, self.sample.points)
        inside = self.allowed(scores, tops) & (labels[:, None] != self.sample.labels)
        floor = np.floor(self.low * tops / 100)
        if scores.shape[1] >= self.negatives:
            best = np.partition(np.where(inside, scores, np.iinfo(np.int64).min), -self.negatives, axis=1)[:, -self.negatives]
            floor = np.maximum(floor, best)
        return self.tree.open(points, floor, np.ceil(self.high * tops / 100))

    def groups(self, leaves: np.ndarray) -> np.ndarray:
        """Group numbers of a row of open leaves."""
        found = np.flatnonzero(leaves)
        count = self.parts[found]
        return np.unique(np.repeat(self.head[found] - (np.cumsum(count) - count), count) + np.arange(count.sum()))


ASKED = "asker bigint, label bigint, point binary, tops array<bigint>, block int, group int"


def _probe(miner: Miner):
    """Anchors of ``asker, label, point, tops`` for each group that may hold an answer."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(k, AT_ONCE)
                points, labels, tops = _matrix(batch.column(2), miner.dims), batch.column(1).to_numpy(), batch.column(3)
                if tops.null_count:
                    leaves = miner.near(points, labels)
                else:
                    lists = tops.flatten().to_numpy()
                    row = np.repeat(np.arange(len(points)), np.diff(tops.offsets.to_numpy()))
                    each = miner.windows(points[row], labels[row], lists)
                    leaves = np.zeros((len(points), miner.tree.leaves), bool)
                    np.logical_or.at(leaves, row, each)
                own = miner.head[miner.tree.route(points)] // SPAN
                groups = [miner.groups(x) for x in leaves]
                row = np.repeat(np.arange(len(points)), [len(g) for g in groups])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(row)) for c in range(4)), pa.array(own[row].astype(np.int32)),
                     pa.array(np.concatenate(groups).astype(np.int32) if groups else np.empty(0, np.int32))],
                    names=["asker", "label", "point", "tops", "block", "group"],
                )

    return probe


FOUND = "asker bigint, top bigint, vec_id bigint, score bigint"


def _compare(miner: Miner):
    """The first answers of a block's anchors within a group: positives where ``tops`` is null, else negatives."""

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        entries, out = Held(held, miner.dims), []
        for k in range(0, asked.num_rows, AT_ONCE):
            part = asked.slice(k, AT_ONCE).combine_chunks()
            asker, labels, points = part["asker"].to_numpy(), part["label"].to_numpy(), _matrix(part["point"], miner.dims)
            scores, same = products(points, entries.points), labels[:, None] == entries.labels
            tops = part["tops"].combine_chunks()
            if tops.null_count:
                row, ids, found = first(scores, same, entries.start, entries.ids, miner.positives + 1)
                out.append((asker[row], np.zeros(len(row), np.int64), ids, found))
                continue
            own = np.repeat(np.arange(len(points)), np.diff(tops.offsets.to_numpy()))
            tops = tops.flatten().to_numpy()
            for j in range(0, len(own), AT_ONCE):
                at, top = own[j : j + AT_ONCE], tops[j : j + AT_ONCE]
                row, ids, found = first(scores[at], ~same[at] & miner.allowed(scores[at], top), entries.start, entries.ids, miner.negatives)
                out.append((asker[at][row], top[row], ids, found))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 4
        return pa.table(dict(zip(["asker", "top", "vec_id", "score"], columns)))

    return compare


def _search(asked: DataFrame, entries: DataFrame, miner: Miner) -> DataFrame:
    probes = written(asked.select("asker", "label", "point", "tops").mapInArrow(_probe(miner), ASKED), "probes")
    pairs = probes.select(F.col("group").alias("open"), F.col("block").alias("by")).distinct()
    met = entries.join(pairs, F.col("group") == F.col("open")).select("open", "by", "label", "point", "ids")
    return probes.groupBy("group", "block").cogroup(met.groupBy("open", "by")).applyInArrow(_compare(miner), FOUND)


def mine(
    vectors: DataFrame, anchors: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding",
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows that ``anchors`` names.

    An anchor's positives are its first rows of the same ``label`` under another id; the negatives of a positive are
    the first rows of other labels that score from ``low`` to ``high`` percent of it.
    """
    spark = vectors.sparkSession
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    v = F.col("vector")
    usable = vectors.select(
        F.col(id_col).cast("bigint").alias("id"),
        (F.col("label") if label is None else label).cast("bigint").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"), anchors.alias("anchor"),
    ).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    )
    common = usable.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    if common is None:
        return spark.createDataFrame([], schema)
    dims = common["dims"]

    def quantised(rows: DataFrame) -> DataFrame:
        return rows.where(F.size("vector") == dims).select("id", "label", "vector").mapInArrow(_quantised(dims), POINTS)

    alike = Window.partitionBy("label", "point").orderBy("id")
    named = max(positives + 1, negatives)
    classes = written(
        quantised(usable).distinct().withColumn("_r", F.row_number().over(alike)).where(F.col("_r") <= named)
        .groupBy("label", "point").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.max("norm").alias("norm")), "classes"
    )
    size = classes.agg(F.count("*").alias("n"), F.max("norm").alias("top")).first()
    if not size["n"]:
        return spark.createDataFrame([], schema)
    sample = Held(classes.orderBy(F.xxhash64("label", "point"), "label", "point").limit(SAMPLE_ROWS).select("label", "point", "ids").toArrow(), dims)
    levels = next((k for k in range(1, LEVELS) if ARITY**k * LEAF >= size["n"]), LEVELS)
    tree = Tree(sample.points, size["top"], levels)
    learned = classes.select("point").mapInArrow(_ranges(tree, dims), "node int, split int, subtree int, low double, high double")
    for node, i, j, lowest, highest in (  # at most ARITY ** 2 rows a node
        learned.groupBy("node", "split", "subtree").agg(F.min("low"), F.max("high")).collect()
    ):
        tree.low[node][i, j], tree.high[node][i, j] = lowest, highest

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.route(_matrix(batch.column(1), dims)) if batch.num_rows else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=["label", "point", "ids", "deal", "leaf"])

    placed = written(
        classes.select("label", "point", "ids", F.xxhash64("label", "point").alias("deal"))
        .mapInArrow(place, "label bigint, point binary, ids array<bigint>, deal bigint, leaf int"), "placed"
    )
    filled = np.zeros(tree.leaves, np.int64)
    for leaf, count in placed.groupBy("leaf").count().collect():  # at most ARITY ** LEVELS rows
        filled[leaf] = count
    head, parts = group_leaves(filled)
    miner = Miner(tree, dims, sample, head, parts, positives, negatives, low, high)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, number = batch.column(4).to_numpy(), batch.column(3).to_numpy()
            group = head[leaf] + number % parts[leaf]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(group.astype(np.int32))], names=["label", "point", "ids", "group"])

    entries = placed.mapInArrow(deal, "label bigint, point binary, ids array<bigint>, group int")
    chosen = written(quantised(usable.where("anchor")).select("id", "label", "point").distinct(), "anchors")
    asked = written(
        chosen.select("label", "point").distinct().withColumn("asker", F.monotonically_increasing_id()), "asked"
    )
    nearest = Window.partitionBy("asker", "top").orderBy(F.desc("score"), "vec_id")

    def leading(found: DataFrame, count: int) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= count)

    none = F.lit(None).cast("array<bigint>").alias("tops")
    same = written(leading(_search(asked.select("*", none), entries, miner), positives + 1).drop("rank", "top"), "positives")
    tops = same.where("score >= 0").groupBy("asker").agg(F.array_sort(F.collect_set("score")).alias("tops"))
    others = leading(_search(asked.join(tops, "asker"), entries, miner), negatives)
    own = Window.partitionBy("anchor_id", "asker").orderBy(F.desc("score"), "vec_id")
    return (
        chosen.select(F.col("id").alias("anchor_id"), "label", "point").join(asked, ["label", "point"]).select("anchor_id", "asker")
        .join(same, "asker").where("vec_id <> anchor_id")
        .withColumn("place", F.row_number().over(own)).where(F.col("place") <= positives)
        .select("anchor_id", "asker", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        .join(
            others.select("asker", F.col("top").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")),
            ["asker", "positive_score"],
        )
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )


def group_leaves(filled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first group of each leaf and how many it has: neighbours share a group, a large leaf has its own."""
    head, parts = np.zeros(len(filled), np.int64), np.ones(len(filled), np.int64)
    group, held = 0, 0
    for leaf, count in enumerate(filled.tolist()):
        if held and held + count > GROUP:
            group, held = group + 1, 0
        head[leaf] = group
        if count > GROUP:
            parts[leaf] = -(-count // GROUP)
            group, held = group + int(parts[leaf]), 0
        else:
            held += count
    return head, parts


def oracle() -> str:
    """Hard negatives of ``embeddings`` in DuckDB SQL."""
    usable = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    return f"""
    WITH u AS (
      SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS point
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {usable}),
    s AS (
      SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, CAST(list_dot_product(a.point, o.point) AS BIGINT) AS score
      FROM u a JOIN u o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0),
    p AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
    WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
    QUALIFY row_number() OVER w <= 5"""

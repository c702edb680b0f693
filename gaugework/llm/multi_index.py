"""Approximate nearest neighbours by an inverted multi-index.

Vectors are scaled to length one and cut into two halves; each half has its own codebook, so a vector's cell is a
pair of centroids.  A query walks the pairs in the order of summed distance with a heap until the visited cells
hold enough vectors, and these are reranked by their exact cosine in double precision.  The last of these answers
bounds the distance of any better one: every cell that may hold a vector within it, judged by the least and largest
distance of the cell's vectors to its two centroids, is then scanned, so the answers are those of a search over the
whole table at any size.  Codebooks are fitted on a bounded sample; every vector is indexed.

Queries are taken in blocks, which are sent to the tasks: each reads its part of the index once for the walk and once
for the scan, and returns its best ``k + 1`` for each query, so no table of queries with cells or candidates arises.
Products in single precision leave the pairs that may count, less what rounding can move; these are scored exactly.

Equal vectors form a class.  A class enters its cell with its ``k + 1`` smallest ids only: among equal scores
smaller ids win, so no other member can appear in an answer.  Equal queries are answered once.

Rows with a null id, or a vector that is null, zero, of another length than most, or holds null or non-finite
components, take no part.  Equal rows count once; an id with several vectors is answered for each of them and is
not its own neighbour.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from gaugework.llm.shared import written

SAMPLE_ROWS = 20_000
BLOCK = 16384  # queries at most that tasks get at once,
BLOCK_BYTES = 16 << 20  # bytes of their vectors,
VISITS = 4 << 20  # and cells that they walk
CHUNK, TILE = 256, 512  # vectors and queries that are multiplied at once
RUN = 16  # vectors of a cell from which on a walk multiplies all with all of its queries
PAIRS = 1 << 14  # pairs that a walk compares at once otherwise
FOUND = 1 << 18  # scored pairs that a task holds
SLACK = 4e-6  # more than rounding moves a distance or cosine


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector`` of rows that can take part."""
    v = F.col("vector")
    return vectors.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")
    ).where(
        F.col("id").isNotNull() & v.isNotNull()
        & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        & F.exists(v, lambda x: x != 0)
    )


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _packed(matrix: np.ndarray) -> pa.Array:
    """A byte string for each row."""
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(matrix.shape[1] * matrix.itemsize)
    data = np.ascontiguousarray(matrix)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _unpacked(column: pa.Array, kind: str, dims: int) -> np.ndarray:
    _, ends, data = column.buffers()
    first = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset]
    return np.frombuffer(data, kind, len(column) * dims, int(first)).reshape(-1, dims)


def _unit(matrix: np.ndarray) -> np.ndarray:
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1)[None]


def _codebook(points: np.ndarray, size: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:size]].copy()
    for _ in range(rounds):
        near = _distances(points, centres).argmin(axis=1)
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


class Codebooks:
    """Two codebooks; a cell is the number ``first * size of second + second``."""

    def __init__(self, sample: np.ndarray, size: int):
        self.dims = sample.shape[1]
        self.cut = max(1, self.dims // 2)
        unit = _unit(sample)
        self.first = _codebook(unit[:, : self.cut], size)
        self.second = _codebook(unit[:, self.cut :], size)

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(unit[:, : self.cut], self.first), _distances(unit[:, self.cut :], self.second)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.distances(unit)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)

    def parts(self, unit: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of the two halves to the centroids of their cells."""
        own_a, own_b = self.first[cells // len(self.second)], self.second[cells % len(self.second)]
        return (
            np.sqrt(((unit[:, : self.cut] - own_a) ** 2).sum(axis=1)),
            np.sqrt(((unit[:, self.cut :] - own_b) ** 2).sum(axis=1)),
        )

    def walk(self, a: np.ndarray, b: np.ndarray, held: np.ndarray, wanted: int) -> list[int]:
        """Filled cells by ascending summed distance until they hold ``wanted`` vectors."""
        by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        heap = [(a[by_a[0]] + b[by_b[0]], 0, 0)]
        cells, found = [], 0
        while heap and found < wanted:
            _, i, j = heapq.heappop(heap)
            cell = int(by_a[i]) * len(b) + int(by_b[j])
            if held[cell]:
                cells.append(cell)
                found += int(held[cell])
            if j + 1 < len(b):
                heapq.heappush(heap, (a[by_a[i]] + b[by_b[j + 1]], i, j + 1))
            # Each pair has one predecessor: a new row opens only from its first column.
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[by_a[i + 1]] + b[by_b[0]], i + 1, 0))
        return cells


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows with rows, the same to the last bit wherever a pair is scored."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    y = y / np.abs(y).max(axis=1, keepdims=True)
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1)) / np.sqrt((y * y).sum(axis=1))


class Search:
    """The best vectors for a block of queries; ``_pairs`` of a subclass says which are compared with which."""

    def __init__(self, queries: np.ndarray, least: np.ndarray, k: int, pad: int):
        """``least``: the score that an answer must reach."""
        self.queries, self.least, self.k, self.pad = queries, least, k, pad

    def _scaled(self, vectors: np.ndarray) -> np.ndarray:
        return _unit(np.hstack([vectors.astype(np.float64), np.zeros((len(vectors), self.pad))]))

    def _raise(self, least: np.ndarray) -> None:
        self.bound = least
        # A sum of n products of single precision is off by less than n units in the last place.
        self.sought[:, -1] = SLACK + (self.sought.shape[1] + 8) * 2.0**-23 - least

    def _begin(self) -> None:
        """``sought`` has the queries and what their answers may lack, so its product with an answer and 1 is not negative."""
        self.sought = self._extended(self.queries)
        self._raise(self.least)

    def _extended(self, vectors: np.ndarray) -> np.ndarray:
        return np.hstack([self._scaled(vectors), np.ones((len(vectors), 1))]).astype(np.float32)

    def _products(self, points: np.ndarray, first: int, last: int, who: np.ndarray | None):
        """Rows from ``first`` to ``last`` with those of the queries ``who`` (None: all) that they may be answers to."""
        for i in range(first, last, CHUNK):
            part = points[i : min(i + CHUNK, last)]
            for j in range(0, len(self.sought) if who is None else len(who), TILE):
                query = slice(j, j + TILE) if who is None else who[j : j + TILE]
                product = part @ self.sought[query].T
                rows = np.flatnonzero(product.max(axis=1) >= 0)
                if len(rows):
                    row, own = np.nonzero(product[rows] >= 0)
                    yield rows[row] + i, own + j if who is None else query[own]

    def _pairs(self, points: np.ndarray, cells: np.ndarray):
        raise NotImplementedError

    def _best(self, found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, ids, score = (np.concatenate(part) for part in zip(*found))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        kept = place <= self.k
        return query[kept], ids[kept], score[kept]

    def answers(self, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """Query numbers, ids and scores of the ``k + 1`` best among batches of ``ids, vectors, cells``."""
        self._begin()
        found: list[tuple] = []
        held = 0
        for ids, vectors, cells in batches:
            for row, query in _gathered(self._pairs(self._extended(vectors), cells)):
                for j in range(0, len(row), 1 << 16):
                    r, q = row[j : j + (1 << 16)], query[j : j + (1 << 16)]
                    score = _cosine(self.queries[q], vectors[r].astype(np.float64))
                    near = score >= self.bound[q] - SLACK
                    found.append((q[near], ids[r[near]], score[near]))
                    held += len(found[-1][0])
                    if held > FOUND:
                        found = [self._best(found)]
                        q, _, score = found[0]
                        last = np.flatnonzero(np.bincount(q, minlength=len(self.bound))[q] == self.k + 1)
                        low = np.full(len(self.bound), np.inf)
                        np.minimum.at(low, q[last], score[last])
                        self._raise(np.where(np.isfinite(low), np.maximum(self.bound, low), self.bound))
                        held = 0
        return self._best(found) if found else None


def _gathered(pairs, size: int = 1 << 14):
    """The same pairs in fewer, larger arrays."""
    rows, queries, held = [], [], 0
    for row, query in pairs:
        rows.append(row)
        queries.append(query)
        held += len(row)
        if held >= size:
            yield np.concatenate(rows), np.concatenate(queries)
            rows, queries, held = [], [], 0
    if held:
        yield np.concatenate(rows), np.concatenate(queries)


class Walk(Search):
    """Search of the cells that each query visits."""

    def __init__(self, queries: np.ndarray, cells: np.ndarray, visits: np.ndarray, n_cells: int, k: int, pad: int):
        """``cells``: those of the first query, then of the second and so on, ``visits`` of each."""
        super().__init__(queries, np.full(len(queries), -2.0), k, pad)
        self.who = np.repeat(np.arange(len(queries), dtype=np.int32), visits)[np.argsort(cells, kind="stable")]
        self.start = np.r_[0, np.cumsum(np.bincount(cells, minlength=n_cells))]

    def _pairs(self, points: np.ndarray, cells: np.ndarray):
        first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        length = np.diff(np.r_[first, len(cells)])
        for i, n in zip(first[length >= RUN].tolist(), length[length >= RUN].tolist()):
            yield from self._products(points, i, i + n, self.who[self.start[cells[i]] : self.start[cells[i] + 1]])
        rows = np.flatnonzero(np.repeat(length < RUN, length))
        begin = self.start[cells[rows]]
        count = self.start[cells[rows] + 1] - begin
        piece = np.cumsum(count) // PAIRS
        for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(piece)) + 1):
            n = count[part]
            row = np.repeat(rows[part], n)
            query = self.who[np.arange(len(row)) + np.repeat(begin[part] - np.cumsum(n) + n, n)]
            near = np.einsum("ij,ij->i", points[row], self.sought[query]) >= 0
            yield row[near], query[near]


class Scan(Search):
    """Exact search of all cells that the queries' bounds do not exclude."""

    def __init__(
        self, books: Codebooks, queries: np.ndarray, least: np.ndarray, spans: np.ndarray, k: int, pad: int
    ):
        """``spans``: per cell least and largest distances of the halves."""
        super().__init__(queries, least, k, pad)
        self.books, self.spans = books, spans

    def _begin(self) -> None:
        super()._begin()
        size = 1024
        parts = [self.books.distances(self._scaled(self.queries[i : i + size])) for i in range(0, len(self.queries), size)]
        self.a, self.b = (np.hstack([np.sqrt(np.maximum(x, 0)).astype(np.float32).T for x in half]) for half in zip(*parts))

    def _off(self, distance: np.ndarray, low: float, high: float) -> np.ndarray:
        """Squares of how far the queries are at least from what lies so far from a centroid."""
        return np.maximum(np.maximum(distance - float(high), float(low) - distance) - np.float32(SLACK), 0) ** 2

    def _asked(self, cells: np.ndarray, rows: int) -> np.ndarray | None:
        """Queries for which one of the cells may hold an answer, or some more; None: all."""
        reach = (2 - 2 * self.bound + SLACK).astype(np.float32)
        asked = np.zeros(len(reach), bool)
        first, second = np.divmod(cells, len(self.books.second))
        if len(cells) * 4 <= rows:
            for cell, i, j in zip(cells.tolist(), first.tolist(), second.tolist()):
                low_a, high_a, low_b, high_b = self.spans[cell]
                asked |= self._off(self.a[i], low_a, high_a) + self._off(self.b[j], low_b, high_b) <= reach
                if asked.all():
                    return None
        else:  # testing each cell would cost more than it saves
            for i in np.unique(first).tolist():
                span = self.spans[cells[first == i]]
                asked |= self._off(self.a[i], span[:, 0].min(), span[:, 1].max()) <= reach
                if asked.all():
                    return None
        return np.flatnonzero(asked)

    def _pairs(self, points: np.ndarray, cells: np.ndarray):
        for i in range(0, len(points), CHUNK):
            own = cells[i : i + CHUNK]
            yield from self._products(points, i, i + len(own), self._asked(np.unique(own), len(own)))


def nearest(
    vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    k: int = 5, wanted: int = 4000, codebook: int | None = None,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest vectors for each query row.

    The walk reranks ``wanted`` vectors at least per query before the scan settles the rest.  ``codebook`` is the number of centroids of a half; by
    default it follows the square root of the number of rows, up to 256, so tables of cells stay bounded.
    """
    spark = vectors.sparkSession
    usable = _usable(vectors, id_col, vector_col)
    rows = usable.count()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not rows:
        return spark.createDataFrame([], schema)
    sample = _sample(usable, rows)
    lengths = np.diff(sample.offsets.to_numpy())
    dims = int(np.bincount(lengths).argmax())
    matrix = sample.flatten().to_numpy()[np.repeat(lengths == dims, lengths)].reshape(-1, dims)
    pad = 1 if dims < 2 else 0
    if codebook is None:
        codebook = min(256, max(4, int(math.sqrt(rows) / 4)))
    books = Codebooks(np.hstack([matrix, np.zeros((len(matrix), pad))]), codebook)
    stored = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "<f8"

    def place(kind: str):
        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    flat = _matrix(batch.column(1))
                    unit = _unit(np.hstack([flat, np.zeros((len(flat), pad))]))
                    keys = [hashlib.blake2b((row + 0.0).tobytes(), digest_size=16).digest() for row in flat]
                    cells = books.cells(unit)
                    a, b = books.parts(unit, cells)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), _packed(flat.astype(kind)), pa.array(keys, pa.binary()),
                         pa.array(cells, pa.int32()), pa.array(a), pa.array(b)],
                        names=["id", "vector", "key", "cell", "off_a", "off_b"],
                    )

        return placed

    shape = "id bigint, vector binary, key binary, cell int, off_a double, off_b double"
    indexed = usable.where(F.size("vector") == dims).mapInArrow(place(stored), shape)
    own = Window.partitionBy("key").orderBy("id")
    entries = written(
        indexed.withColumn("_r", F.dense_rank().over(own)).where(F.col("_r") <= k + 1).drop("_r")
        .dropDuplicates(["key", "id"]).sortWithinPartitions("cell"), "cells"
    )
    held = np.zeros(len(books.first) * len(books.second), np.int64)
    spans = np.zeros((len(held), 4))
    filled = entries.groupBy("cell").agg(
        F.count("*"), F.min("off_a"), F.max("off_a"), F.min("off_b"), F.max("off_b")
    )
    for cell, count, *span in filled.toLocalIterator():  # at most codebook ** 2 rows
        held[cell], spans[cell] = count, span

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                flat = _unpacked(part.column(1), "<f8", dims)
                a, b = books.distances(_unit(np.hstack([flat, np.zeros((len(flat), pad))])))
                cells = [books.walk(x, y, held, wanted) for x, y in zip(a, b)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(cells, pa.list_(pa.int32()))],
                    names=["query", "sought", "cells"],
                )

    asked = written(
        _usable(queries, id_col, vector_col).where(F.size("vector") == dims).mapInArrow(place("<f8"), shape)
        .dropDuplicates(["key", "id"]).select("id", "key", "vector"), "queries"
    )
    distinct = asked.dropDuplicates(["key"]).select("key", "vector").repartition(_tasks(spark))
    probes = written(distinct.mapInArrow(probe, "query binary, sought binary, cells array<int>"), "probes")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")

    def leading(scores: DataFrame) -> DataFrame:
        return scores.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).drop("_r")

    searched = entries.select("id", "vector", "cell").coalesce(_tasks(spark))

    def search(found: Search, keys: pa.Array) -> DataFrame:
        return searched.mapInArrow(_searcher(found, keys, stored, dims), "query binary, vec_id bigint, score double")

    n, visits = probes.agg(F.count("*"), F.sum(F.size("cells"))).first()
    if not n:
        return spark.createDataFrame([], schema)
    blocks = math.ceil(max(n / BLOCK, n * dims * 8 / BLOCK_BYTES, visits / VISITS))
    parts = []
    for block in range(blocks):
        part = probes.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).toArrow().combine_chunks()
        if not part.num_rows:
            continue
        keys, sought, cells = (part[name].combine_chunks() for name in ("query", "sought", "cells"))
        block_queries = _unpacked(sought, "<f8", dims)
        walk = Walk(block_queries, cells.flatten().to_numpy(), np.diff(cells.offsets.to_numpy()), len(held), k, pad)
        found = written(leading(search(walk, keys)), "answers")
        if held.sum() > wanted:
            least = _bounds(found, keys, k)
            scan = Scan(books, block_queries, least, spans, k, pad)
            found = written(leading(found.unionByName(search(scan, keys)).distinct()), "answers")
        parts.append(found)
    answers = functools.reduce(DataFrame.unionByName, parts)
    per_query = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return (
        asked.select(F.col("id").alias("query_id"), F.col("key").alias("query"))
        .join(answers, "query")
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(per_query).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _tasks(spark: SparkSession) -> int:
    """Tasks of a search: each returns answers to all queries of a block, so they follow the cores, not the table."""
    return 4 * spark.sparkContext.defaultParallelism


def _sample(usable: DataFrame, rows: int) -> pa.Array:
    """The ``SAMPLE_ROWS`` vectors whose ids have the smallest hashes."""
    place = F.xxhash64("id")

    def smallest(some: DataFrame) -> pa.Array:
        return some.orderBy(place, "id").limit(SAMPLE_ROWS).select("vector").toArrow()["vector"].combine_chunks()

    share = 2 * SAMPLE_ROWS / rows
    if share < 0.5:  # twice the rows by their hashes, so that not every task sends as many as are wanted
        sample = smallest(usable.where(place < F.lit(int((share - 0.5) * 2**64))))
        if len(sample) == SAMPLE_ROWS:
            return sample
    return smallest(usable)


def _bounds(answers: DataFrame, keys: pa.Array, k: int) -> np.ndarray:
    """The last score of each query with more than ``k`` answers, else one that all reach."""
    last = answers.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") > k)
    number = {key: i for i, key in enumerate(keys.to_pylist())}
    least = np.full(len(keys), -2.0)
    known = last.select("query", "least").toArrow()
    least[[number[key] for key in known["query"].to_pylist()]] = known["least"].to_numpy()
    return least


def _searcher(search: Search, keys: pa.Array, kind: str, dims: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = search.answers(
            (b.column(0).to_numpy(), _unpacked(b.column(1), kind, dims), b.column(2).to_numpy())
            for b in batches if b.num_rows
        )
        if found is not None:
            query, ids, score = found
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(query)), pa.array(ids, pa.int64()), pa.array(score)],
                names=["query", "vec_id", "score"],
            )

    return find

"""Near duplicates, shards and neighbours against brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from brute import linked
from gaugework.llm import fast_sketch, multi_index, queries, shards
from gaugework.llm.components import components

DATA = "/root/testdata/sf0.001"


def found(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


def near_copies(rng, count):
    vocabulary = [f"w{k}" for k in range(60)]
    base = [rng.choices(vocabulary, k=rng.choice([1, 3, 20, 60])) for _ in range(12)]
    rows = []
    for doc in range(count):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(words) // 12))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((doc * 3 % 997, " ".join(words).upper() if doc % 5 == 0 else "\t".join(words)))
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    rows = near_copies(random.Random(k), 150) + [(1000, None), (1001, ""), (1002, " \n "), (1003, "One"), (1004, "one "), (1003, "One")]
    rows += [(1005, "long " * 3000 + "text"), (1006, "long " * 2000 + "text"), (1010, "É"), (1011, "é")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS id", "2 AS bucket", "3 AS n")
    assert found(fast_sketch.near_duplicates(docs.repartition(3), words=k)) == linked(rows, k)


def test_near_duplicates_without_ids_or_rows(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b c")], "doc_id bigint, text string")
    rows = sorted(fast_sketch.near_duplicates(docs, words=2).collect(), key=str)
    assert [(r["doc_id"], r["component_id"], r["kept"]) for r in rows] == [(1, 1, True), (None, None, True), (None, None, True)]
    assert fast_sketch.near_duplicates(docs.limit(0)).count() == 0


def test_sketches_fill_and_agree_as_often_as_sets_do():
    own = fast_sketch.Hasher(1, 40, 5)
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 2**63, 800).astype(np.uint64)
    a, b = (np.sort(np.r_[shared, rng.integers(0, 2**63, 100).astype(np.uint64)]) for _ in range(2))
    one = np.array([5], np.uint64)
    owner = np.r_[np.zeros(900, int), np.ones(900, int), [2]]
    sketch = own.sketches(np.r_[a, b, one], owner, 3)
    assert (sketch != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((sketch[0] == sketch[1]).mean() - 0.8) < 0.12


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (103, 102), (200, 200), (300, 250), (300, 250)]
    rows = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    want = {i: 0 for i in range(1, 41)} | {101: 100, 102: 100, 103: 100, 300: 250}
    assert {r["a"]: r["b"] for r in rows} == want and len(rows) == len(want)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicate_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert found(queries.op8_fast_sketch(spark, DATA)) == linked(rows, 2)


def packed_by_search(sizes, capacity):
    """Best fit over a plain list."""
    room, out = [], []
    for size in sizes:
        fits = [(r, b) for b, r in enumerate(room) if r >= size]
        if fits:
            bin_ = min(fits)[1]
        else:
            bin_ = len(room)
            room.append(max(capacity, size))
        room[bin_] -= size
        if room[bin_] == 0:
            room[bin_] = -1
        out.append(bin_)
    return out


def test_best_fit_matches_a_search_of_all_bins():
    rng = random.Random(3)
    for _ in range(30):
        sizes = sorted((rng.randint(1, 40) for _ in range(rng.randint(1, 120))), reverse=True)
        assert list(shards.best_fit(sizes, 50)) == packed_by_search(sizes, 50)


def check_shards(rows, got, count):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted(
        (d is None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows
    )
    by_shard = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    for slots in by_shard.values():
        assert sorted(slots) == list(range(len(slots)))
    assert set(by_shard) <= set(range(count))


def test_shards(spark):
    rng = random.Random(4)
    rows = [(k, "x" * rng.choice([0, 3, 40, 300])) for k in range(400)] + [(k, f"text {k} " * rng.randint(1, 60)) for k in range(400, 1200)]
    rows += [(5000, None), (5001, None), (None, "no id"), (5, "again"), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "7 AS size", "8 AS shard")
    got = shards.assign(docs.repartition(3), 4).collect()
    check_shards(rows, got, 4)
    of = {}
    texts = {d: t for d, t in rows if d not in (None, 5)}
    for r in got:
        if r["doc_id"] in texts:
            of.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in of.values())
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(4)]
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes)
    assert shards.assign(docs.limit(0), 4).count() == 0


def test_a_group_above_an_even_share_stands_alone(spark):
    rows = [(k, "y" * 500) for k in range(100)] + [(k, f"t{k}") for k in range(100, 300)]
    got = shards.assign(spark.createDataFrame(rows, "doc_id bigint, text string"), 4).collect()
    check_shards(rows, got, 4)
    hot = {r["shard"] for r in got if r["doc_id"] < 100}
    others = [sum(r["size"] for r in got if r["shard"] == s) for s in range(4) if s not in hot]
    assert len(hot) == 1 and not [r for r in got if r["shard"] in hot and r["doc_id"] >= 100]
    assert max(others) - min(others) < 0.1 * sum(others)


def test_shard_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = queries.op10_best_fit_shards(spark, DATA).collect()
    check_shards(rows, got, 8)
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}


def nearest_by_search(ids, matrix, asked, k=5):
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    out = {}
    for q in asked:
        score = unit @ unit[np.flatnonzero(ids == q)[0]]
        others = np.flatnonzero(ids != q)
        order = others[np.lexsort((ids[others], -np.round(score[others], 12)))][:k]
        out[q] = [int(ids[i]) for i in order]
    return out


def test_neighbour_query_recall(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    ids, matrix = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(float)
    want = nearest_by_search(ids, matrix, ids[ids % 50 == 0])
    rows = queries.op4_multi_index(spark, DATA).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9


def test_neighbour_recall_with_few_candidates(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((30, 16))
    matrix = centres[rng.integers(0, 30, 3000)] + 0.3 * rng.standard_normal((3000, 16))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id bigint, embedding array<double>")
    rows = multi_index.nearest(table, table.where("vec_id % 100 = 0"), wanted=400).collect()
    want = nearest_by_search(np.arange(3000), matrix, range(0, 3000, 100))
    hits = sum(r["vec_id"] in want[r["query_id"]] for r in rows)
    assert len(rows) == 150 and hits / 150 >= 0.9


@pytest.mark.parametrize("kind", ["isotropic", "clusters"])
def test_neighbours_are_exact_past_the_walk(spark, tmp_path, kind, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 40)
    rng = np.random.default_rng(8)
    matrix = rng.standard_normal((50_000, 64))
    if kind == "clusters":
        matrix = rng.standard_normal((200, 64))[rng.integers(0, 200, 50_000)] + 0.2 * matrix
    path = str(tmp_path / "vectors.parquet")
    pq.write_table(pa.table({"vec_id": np.arange(50_000), "embedding": list(matrix)}), path)
    table = spark.read.parquet(path).repartition(8)
    asked = range(0, 50_000, 500)
    got = {}
    for r in sorted(multi_index.nearest(table, table.where("vec_id % 500 = 0")).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == nearest_by_search(np.arange(50_000), matrix, asked)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_need_no_table_of_candidates(spark, kind, monkeypatch):
    plans, write = [], multi_index.written

    def seen(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(multi_index, "written", seen)
    monkeypatch.setattr(multi_index, "VISITS", 60, raising=False)
    rng = np.random.default_rng(12)
    matrix = rng.standard_normal((3000, 16))
    matrix[2900:] = matrix[0] + 1e-4 * rng.standard_normal((100, 16))  # scores differ by less than single precision tells
    if kind == "float":
        matrix = matrix.astype(np.float32).astype(float)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], f"vec_id bigint, embedding array<{kind}>")
    asked = [*range(0, 3000, 60), 2990]
    got = {}
    rows = multi_index.nearest(table, table.where("vec_id % 60 = 0 OR vec_id = 2990"), wanted=100).collect()
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == nearest_by_search(np.arange(3000), matrix, asked)
    assert not [p for p in plans if "Join" in p]
    assert len(plans) > 8  # several blocks


def test_neighbours_of_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(k, [1.0, 0.0, 2.0]) for k in range(20, 0, -1)] + [
        (50, [0.0, 0.0, 0.0]), (51, None), (52, [1.0, None, 1.0]), (53, [nan, 1.0, 1.0]), (54, [inf, 1.0, 1.0]),
        (55, [1.0]), (None, [1.0, 0.0, 2.0]), (60, [1e-200, 0.0, 2e-200]), (61, [-1.0, 0.0, -2.0]), (1, [1.0, 0.0, 2.0]),
    ]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS cell", "2 AS key", "3 AS score")
    got = {}
    for r in multi_index.nearest(table, table.where("vec_id IN (1, 10, 50, 60)")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert got[10] == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}
    assert got[60] == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}
    assert set(got[1].values()) == {2, 3, 4, 5, 6}
    assert 50 not in got
    assert multi_index.nearest(table.limit(0), table.limit(0)).count() == 0
    two = table.where("vec_id IN (2, 61)")
    rows = multi_index.nearest(two, two).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in rows) == [(2, 1, 61, -1.0), (61, 1, 2, -1.0)]

"""Hard negatives against a search that compares everything with everything."""

import math

import duckdb
import numpy as np
import pytest
from gaugework.llm import hard_negatives, queries
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def mined(rows, chosen, positives=5, negatives=5):
    """Expected rows by comparing every anchor with every row."""
    usable = [(i, label, v) for i, label, v in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    lengths = [len(v) for _, _, v in usable]
    dims = max(sorted(set(lengths)), key=lengths.count) if lengths else 0
    points = {(i, label, tuple(math.floor(256 * x) for x in v)) for i, label, v in usable if len(v) == dims}
    points = [p for p in points if max(map(abs, p[2])) <= hard_negatives.largest(dims)]
    out = []
    for i, label, v in points:
        if not chosen(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in points)
        same = [(s, j) for s, j, other in scored if other == label and j != i][:positives]
        for top, positive in same:
            found = [(s, j) for s, j, other in scored if other != label and -80 * top <= -100 * s <= -100 * top]
            out += [(i, positive, rank, j, -top, -s) for rank, (s, j) in enumerate(found[:negatives], 1)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.collect()))


def table(spark, rows, step=3):
    return spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").selectExpr(
        "*", "1 AS id", "2 AS point", "3 AS anchor", "4 AS `group`", "5 AS vector"
    ).repartition(step)


@pytest.fixture
def small_leaves(monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    monkeypatch.setattr(hard_negatives, "GROUP", 40)
    monkeypatch.setattr(hard_negatives, "SPAN", 2)
    monkeypatch.setattr(hard_negatives, "ARITY", 4)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 7)


def test_clustered_rows_with_copies_ties_and_odd_rows(spark, small_leaves):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6))
    rows = []
    for k in range(500):
        v = (centres[k % 12] + rng.normal(scale=0.1, size=6)).round(1).tolist()
        rows.append((k, int(rng.integers(4)), v))
    rows += [(1000 + k, k % 2, centres[0].round(1).tolist()) for k in range(150)]  # one point, two labels
    rows += [rows[0], rows[0], (0, 3, rows[5][2]), (10, 1, rows[11][2])]
    rows += [(None, 1, rows[0][2]), (2000, None, rows[0][2]), (2010, 1, None), (2020, 1, []), (2030, 1, [1.0]), (2040, 1, [math.nan] * 6),
             (2050, 1, [None] * 6), (2060, 1, [1e300] * 6), (2070, 1, [0.0] * 6), (2080, 1, [1e4] * 6), (2090, 2, [1e4] * 5 + [9e3])]
    df = table(spark, rows)
    assert found(hard_negatives.mine(df, F.col("vec_id") % 10 == 0)) == mined(rows, lambda i: i % 10 == 0)
    assert found(hard_negatives.mine(df, F.col("vec_id") < 30, positives=2, negatives=9)) == mined(rows, lambda i: i < 30, 2, 9)


def test_few_rows_of_a_label_and_none_at_all(spark):
    rows = [(0, 1, [0.5, 0.5]), (1, 2, [0.5, 0.5]), (2, 1, [0.5, 0.4]), (3, 3, [-1.0, 0.0]), (4, 2, [0.0, 0.1])]
    assert found(hard_negatives.mine(table(spark, rows), F.lit(True))) == mined(rows, lambda i: True)
    assert found(hard_negatives.mine(table(spark, rows[:1]), F.lit(True))) == []
    assert found(hard_negatives.mine(table(spark, rows).limit(0), F.lit(True))) == []
    assert found(hard_negatives.mine(table(spark, [(1, 1, None)]), F.lit(True))) == []


def test_ranges_exclude_far_leaves_and_keep_all_answers():
    rng = np.random.default_rng(7)
    centres = rng.normal(scale=400, size=(40, 8))
    points = (centres[rng.integers(0, 40, 4000)] + rng.normal(scale=10, size=(4000, 8))).astype(np.int32)
    top = int((points.astype(np.int64) ** 2).sum(axis=1).max())
    tree = hard_negatives.Tree(points[:1000], top, 2)
    leaf = tree.route(points, learn=True)
    anchors = points[::100]
    scores = hard_negatives.products(anchors, points)
    most = scores.max(axis=1).astype(float)
    opened = tree.open(anchors, 0.95 * most, most)
    row, column = np.nonzero((scores >= 0.95 * most[:, None]) & (scores <= most[:, None]))
    assert opened[row, leaf[column]].all()
    assert opened.mean() < 0.3


def test_large_leaves_are_cut_and_neighbours_share_a_group(monkeypatch):
    monkeypatch.setattr(hard_negatives, "GROUP", 10)
    head, parts = hard_negatives.group_leaves(np.array([4, 6, 1, 35, 0, 10, 2]))
    assert head.tolist() == [0, 0, 1, 2, 6, 6, 7] and parts.tolist() == [1, 1, 1, 4, 1, 1, 1]


def test_products_are_exact():
    a = np.full((1, 64), hard_negatives.largest(64), np.int32)
    assert hard_negatives.products(a, a)[0, 0] == 64 * hard_negatives.largest(64) ** 2
    assert 100 * 64 * hard_negatives.largest(64) ** 2 < 2**63


def test_negatives_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    assert found(queries.QUERIES["op11_hard_negatives"](spark, DATA)) == sorted(con.execute(queries.ORACLES["op11_hard_negatives"]).fetchall())

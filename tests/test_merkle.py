"""Located differences of stored readings."""

import random

from helpers import rows
from pyspark.sql import functions as F

from gaugework.operators import merkle

DDL = "k BIGINT, part STRING, v STRING, n DOUBLE"


def reading(spark, path, data):
    merkle.store_reading(spark.createDataFrame(data, DDL).repartition(3), ["k", "part"], path)
    return path


def test_changes_are_located_and_little_is_read(spark, tmp_path):
    rng = random.Random(1)
    data = [(k, rng.choice("ab"), f"v{rng.randrange(9)}", float(k % 7)) for k in range(4000)]
    data += [data[5], (None, None, "x", None), (None, None, "y", None)]
    after = [row for row in data if row[0] != 17]
    after[100] = (*after[100][:2], "changed", after[100][3])
    after[200] = (*after[200][:3], None)
    after.append((9000, "a", "new", 1.0))
    after.append(data[300])  # one more copy
    after.remove((None, None, "y", None))
    one, two = reading(spark, str(tmp_path / "one"), data), reading(spark, str(tmp_path / "two"), rng.sample(after, len(after)))
    found = merkle.located_differences(spark, one, two, ["k", "part"])
    want = [(17, data[17][1], "removed"), (*after[100][:2], "changed"), (*after[200][:2], "changed"), (9000, "a", "added"),
            (*data[300][:2], "changed"), (None, None, "changed")]
    assert rows(found) == sorted(want, key=str)
    buckets = [r["node"] for r in merkle.differing_buckets(spark, one, two).collect()]
    assert len(buckets) <= 6
    again = merkle.rows_in(spark, one, buckets)
    assert again.count() < 40
    assert again.columns == ["k", "part", "v", "n"]
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_folder" in plan


def test_equal_readings_in_another_order_have_one_tree(spark, tmp_path):
    data = [(k, "a", "v", 0.5) for k in range(200)] * 2
    one, two = reading(spark, str(tmp_path / "one"), data), reading(spark, str(tmp_path / "two"), data[::-1])
    assert merkle.differing_buckets(spark, one, two).count() == 0
    assert merkle.located_differences(spark, one, two, ["k", "part"]).count() == 0
    root = spark.read.parquet(f"{one}/tree/0")
    assert rows(root, "node", "rows") == [(0, 400)]


def test_an_empty_reading(spark, tmp_path):
    one, two = reading(spark, str(tmp_path / "one"), [(1, "a", "v", 1.0)]), str(tmp_path / "two")
    merkle.store_reading(spark.createDataFrame([(2, "b", "w", 1.0)], DDL), ["k", "part"], two)
    assert rows(merkle.located_differences(spark, one, two, ["k", "part"])) == [(1, "a", "removed"), (2, "b", "added")]


def test_every_level_adds_up(spark, tmp_path):
    one = reading(spark, str(tmp_path / "one"), [(k, "a", "v", 1.0) for k in range(3000)])
    for level in range(merkle.LEVELS + 1):
        tree = spark.read.parquet(f"{one}/tree/{level}")
        assert tree.agg(F.sum("rows")).first()[0] == 3000
        assert tree.filter(F.col("node") >= 1 << level * merkle.STEP).count() == 0


def test_many_buckets_are_joined_and_not_written_into_the_plan(spark, tmp_path):
    df = spark.range(300).selectExpr("id AS k", "id AS x")
    merkle.store_reading(df, ["k"], str(tmp_path / "one"))
    buckets = [r[0] for r in df.select(merkle._bucket(["k"])).distinct().collect()]
    found = merkle.rows_in(spark, str(tmp_path / "one"), buckets)
    assert found.count() == 300
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    assert merkle.rows_in(spark, str(tmp_path / "one"), []).count() == 0

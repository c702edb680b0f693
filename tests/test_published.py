"""Create-once publication with interrupted and overlapping writers."""

import os
import threading

import pytest
from helpers import rows

from gaugework.sources import published
from gaugework.sources.published import PublishedTable, publish_once, read_published

SCHEMA = "key STRING, digest STRING"


def table(spark, *pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def test_overlapping_writers_leave_each_key_once(spark, tmp_path):
    path = str(tmp_path / "table")
    errors = []

    def write(number):
        try:
            new = table(spark, *[(f"k{k}", f"d{number if k % 3 else 0}") for k in range(12)], (f"own{number}", "x"))
            publish_once(spark, new, path, ["key"])
        except Exception as error:
            errors.append(error)

    writers = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for writer in writers:
        writer.start()
    for writer in writers:
        writer.join()
    assert not errors
    found = rows(read_published(spark, path, SCHEMA), "key", "digest")
    assert len(found) == len({key for key, _ in found}) == 16
    winners = {digest for key, digest in found if key.startswith("k") and int(key[1:]) % 3}
    assert len(winners) == 1
    assert rows(spark.read.schema(SCHEMA).parquet(path), "key", "digest") == found


def test_a_slower_writer_sees_what_came_in_between(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    plain, raced = PublishedTable.commit, []

    def overtaken(self, number, staged):
        if not raced:
            raced.append(number)
            publish_once(spark, table(spark, ("a", "other"), ("b", "1")), path, ["key"])
        return plain(self, number, staged)

    monkeypatch.setattr(PublishedTable, "commit", overtaken)
    labels = publish_once(spark, table(spark, ("a", "mine"), ("b", "1"), ("c", "1")), path, ["key"])
    assert rows(labels, "key", "action") == [("a", "conflict"), ("b", "identical"), ("c", "append")]
    assert rows(read_published(spark, path, SCHEMA)) == [("a", "other"), ("b", "1"), ("c", "1")]


def test_a_killed_task_leaves_nothing_and_a_retry_everything_once(spark, tmp_path):
    path, flag = str(tmp_path / "table"), str(tmp_path / "flag")

    def dies_once(batches):
        for batch in batches:
            if not os.path.exists(flag):
                open(flag, "w").close()
                os._exit(1)
            yield batch

    rows_of = [(f"k{k}", "d") for k in range(50)]
    new = spark.createDataFrame(rows_of, SCHEMA).repartition(4).mapInPandas(dies_once, SCHEMA)
    with pytest.raises(Exception, match="(?i)worker"):
        publish_once(spark, new, path, ["key"])
    assert read_published(spark, path, SCHEMA).count() == 0
    publish_once(spark, new, path, ["key"])
    publish_once(spark, new, path, ["key"])
    assert rows(read_published(spark, path, SCHEMA)) == sorted(rows_of, key=str)


def test_a_writer_that_dies_before_it_moves_its_files_has_published(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    plain, calls = PublishedTable.settle, []

    def dies(self):
        calls.append(self)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return plain(self)

    monkeypatch.setattr(PublishedTable, "settle", dies)
    with pytest.raises(KeyboardInterrupt):
        publish_once(spark, table(spark, ("a", "1")), path, ["key"])
    assert rows(read_published(spark, path, SCHEMA)) == [("a", "1")]
    labels = publish_once(spark, table(spark, ("a", "1"), ("b", "1")), path, ["key"])
    assert rows(labels, "key", "action") == [("a", "identical"), ("b", "append")]
    assert rows(spark.read.parquet(path)) == [("a", "1"), ("b", "1")]


def test_staged_rows_without_a_manifest_are_not_read(spark, tmp_path):
    path = str(tmp_path / "table")
    PublishedTable(spark, path).stage(table(spark, ("lost", "1")))
    publish_once(spark, table(spark, ("a", "1")), path, ["key"])
    assert rows(read_published(spark, path, SCHEMA)) == [("a", "1")]
    assert rows(spark.read.parquet(path)) == [("a", "1")]


def test_a_number_is_given_once(spark, tmp_path):
    one = published.PublishedTable(spark, str(tmp_path / "table"))
    first, second = one.stage(table(spark, ("a", "1"))), one.stage(table(spark, ("b", "1")))
    assert one.commit(1, first) and not one.commit(1, second)
    assert [c["staged"] for c in one.commits()] == [first]

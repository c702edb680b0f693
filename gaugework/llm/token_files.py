"""Token ids in Parquet list columns, in ascending id order, for selective reads.

A row holds one document: ``doc_id``, ``shard`` (the range of ids that its file covers), ``begin`` (ids before
it within the shard), ``n_tokens`` and the list ``ids``.  Ids are dictionary encoded; the sorted columns are
delta encoded (format version 2).  Row groups and pages have fixed sizes and page indexes, so a query for
counts never touches the lists and a query for some documents reads only their pages.

Null and empty texts give the end id alone.  Null ids come first; rows with equal ids lie side by side in the
order of a hash of their text.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugework.llm.shared import kept_by_worker
from gaugework.llm.token_counts import WordSplitter, byte_letters, simple_words

KEPT_CHUNKS = 500_000
KEPT_WORDS = 600_000
LAYOUT = "doc_id bigint, shard int, begin bigint, n_tokens bigint, ids array<int>"
WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#begin": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
}


class Places(dict):
    """Numbers chunks in the order of their first appearance; ``new`` holds those not yet encoded."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = place = len(self)
        self.new.append(chunk)
        return place


class Encoder:
    """The tokenizers library's model over distinct words; blank-separated chunks and words are encoded once while kept.

    Chunks can stand alone because the file drops white space before it splits words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.splitter = WordSplitter(path)
        self.model = Tokenizer.from_file(path).model
        self.letters = {b: letter for b, letter in enumerate(byte_letters())}
        self.words: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        self.place = Places()
        self.ids = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def _word(self, word: str) -> bytes:
        """Ids of a word as 32-bit integers."""
        spelled = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        found = self.words[word] = array("i", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return found

    def _chunk(self, chunk: str) -> bytes:
        known = self.words.get
        simple = simple_words(chunk)
        if simple:
            return b"".join([known(w) or self._word(w) for w in simple])
        out = []
        for k, part in enumerate(self.splitter.parts(chunk)):
            if k % 2:
                out.append(array("i", [self.splitter.added_ids[part]]).tobytes())
            elif part:
                out += [known(w) or self._word(w) for w in self.splitter.plain_words(part)]
        return b"".join(out)

    def _learn(self, chunks: list[str]) -> None:
        if len(self.words) > KEPT_WORDS:
            self.words = {}
        found = list(map(self._chunk, chunks))
        count = np.fromiter(map(len, found), np.int64) // 4
        self.start = np.r_[self.start, np.cumsum(count) - count + len(self.ids)]
        self.count = np.r_[self.count, count]
        self.ids = np.r_[self.ids, np.frombuffer(b"".join(found), np.int32)]

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one flat array, each followed by the end id, and their lengths."""
        if len(self.place) > KEPT_CHUNKS:
            self._forget()
        number = self.place.__getitem__
        places = [list(map(number, self.splitter.lowered(t).replace("\n", " ").split(" "))) if t else [number("")] for t in texts]
        if self.place.new:
            self._learn(self.place.new)
            self.place.new = []
        at = np.fromiter(chain.from_iterable(places), np.int64)
        count = self.count[at]
        begin = np.cumsum(count) - count
        flat = self.ids[np.repeat(self.start[at] - begin, count) + np.arange(int(count.sum()))]
        chunks = np.cumsum([len(p) for p in places])
        ends = np.cumsum(count)[chunks - 1] if len(places) else np.zeros(0, np.int64)
        length = np.diff(np.r_[0, ends]) + 1
        return np.insert(flat, ends, end_id).astype(np.int32), length


def encoder(path: str) -> Encoder:
    return kept_by_worker(("token files", path), lambda: Encoder(path))


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Documents by ascending id in range partitions, with their ids and places within the partition."""
    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange(_partitions(docs.sparkSession), "doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        shard = TaskContext.get().partitionId()
        before = 0
        for batch in batches:
            for part in _parts(batch):
                flat, length = own.encode(part.column(1).to_pylist(), end_id)
                starts = np.cumsum(length) - length
                lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(flat)], pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.full(len(length), shard), pa.int32()),
                     pa.array(starts + before), pa.array(length), lists],
                    names=["doc_id", "shard", "begin", "n_tokens", "ids"],
                )
                before += int(length.sum())

    return ordered.mapInArrow(encode, LAYOUT)


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _parts(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about ``most`` bytes each."""
    if not batch.num_rows:
        return
    size = max(1, batch.nbytes // batch.num_rows)
    step = max(1, most // size)
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Write the ids of all documents below ``path``."""
    tokenized(docs, tokenizer, end_id).write.options(**WRITER).parquet(path)


def spans(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, shard, start, n_tokens`` of every document; the ids are not read unless asked for."""
    return _placed(spark, path).drop("ids")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document with its ids and the number of ids of all documents before it."""
    return _placed(spark, path)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(LAYOUT).parquet(path)
    # One row per file range.
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("_total"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(offsets), "shard").select(
        "doc_id", "shard", (F.col("_before") + F.col("begin")).alias("start"), "n_tokens", "ids"
    )


def ids_crc32(ids: Column) -> Column:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    @F.pandas_udf("bigint")
    def crc(lists: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(np.asarray(i, "<u4").tobytes()) for i in lists], dtype="int64")

    return crc(ids)

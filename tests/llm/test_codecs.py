"""Encoders against the libraries whose results they must give."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from gaugework.llm import piece_codec, queries, token_counts, token_files
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
DATA = "/root/testdata/sf0.001"
PARTS = [
    "a", "b", "the", " ", "  ", "\n", "é", "e", "́", "ﬁ", "日本", "aaaa", "'s", "'re", "\t", "\r", "\U0001f600", "x",
    "<|endoftext|>", "<|", "|>", "0", "12", "\xa0", "\x85", "\x1c", "Σ", "ΑΣ", "İ", "ß", "!!", "…", "​", "　",
    "THE", "½", "_", "▁", " " * 40, "<0x0A>", "</s>", "ab" * 20, "\x00",
]
LONG = [" " * 5000, "a" * 5000, "ab " * 3000, "日本" * 1000, "\n" * 500, "ing" * 700]


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.Codec(PIECES)


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(WORDS), token_counts.WordBpe(WORDS), token_files.Encoder(WORDS)


def texts(seed, count=400):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(count)]


def test_pieces_of_mixed_texts(pieces):
    library, own = pieces
    given_texts = [None, "", *LONG, *texts(1)]
    for text, (ids, spelled) in zip(given_texts, own.encode(given_texts)):
        want = library.encode(text or "", add_eos=True)
        assert ids.tolist() == want
        assert spelled == " ".join(map(str, want))
        assert own.decode(ids) == library.decode(want)


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_pieces_of_any_text(text):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    own = piece_codec.kept_by_worker(("piece codec", PIECES), lambda: piece_codec.Codec(PIECES))
    ids, _ = next(own.encode([text]))
    assert ids.tolist() == library.encode(text, add_eos=True)
    assert own.decode(ids) == library.decode(ids.tolist())


def test_decoding_of_any_ids(pieces):
    library, own = pieces
    rng = random.Random(2)
    for _ in range(1500):
        ids = [rng.choice([0, 1, 2, *range(3, 259), *rng.choices(range(32000), k=60)]) for _ in range(rng.randint(0, 10))]
        assert own.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_units_are_forgotten_without_a_trace(pieces, monkeypatch):
    monkeypatch.setattr(piece_codec, "KEPT_UNITS", 5)
    library, own = pieces[0], piece_codec.Codec(PIECES)
    for _ in range(2):
        for text in texts(3, 20):
            assert next(own.encode([text]))[0].tolist() == library.encode(text, add_eos=True)


def test_word_counts_and_ids(words):
    library, counter, encoder = words
    given_texts = [None, "", *LONG, *texts(4)]
    flat, length = encoder.encode(given_texts, 1)
    at = 0
    for text, n in zip(given_texts, length.tolist()):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert counter.count(text) == len(want)
        assert flat[at : at + n].tolist() == [*want, 1]
        at += n
    assert at == len(flat)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"])))
def test_word_counts_of_any_text(text):
    library = piece_codec.kept_by_worker(("library",), lambda: Tokenizer.from_file(WORDS))
    counter = token_counts.counter(WORDS)
    encoder = token_files.encoder(WORDS)
    want = library.encode(text, add_special_tokens=False).ids
    assert counter.count(text) == len(want)
    assert encoder.encode([text], 1)[0].tolist() == [*want, 1]


def test_columns(spark):
    rows = [(1, "the cat", 5), (2, None, 6), (3, "", 7), (1, "the cat", 5), (None, "x  y\n", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoded = docs.withColumn("ids", piece_codec.encode(F.col("text"), PIECES)).withColumn(
        "back", piece_codec.decode(F.col("ids"), PIECES)
    )
    for row in encoded.collect():
        assert row["ids"] == library.encode(row["text"] or "", add_eos=True)
        assert row["back"] == (row["text"] or "")
    trip = docs.select("doc_id", "text", piece_codec.round_trip(F.col("text"), PIECES).alias("r"))
    for row in trip.collect():
        ids = library.encode(row["text"] or "", add_eos=True)
        assert row["r"]["n_tokens"] == len(ids)
        assert row["r"]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["r"]["decoded_sha256"] == hashlib.sha256((row["text"] or "").encode()).hexdigest()
    counted = docs.select("text", token_counts.token_count(F.col("text"), WORDS).alias("n")).collect()
    assert sorted(r["n"] for r in counted) == [0, 0, 2, 2, 2]
    assert docs.limit(0).select(piece_codec.round_trip(F.col("text"), PIECES)).count() == 0


def test_token_files(spark, tmp_path):
    library = Tokenizer.from_file(WORDS)
    rows = [(k, f"doc number {k} " * (k % 7)) for k in range(300)] + [(7, "again"), (7, "again"), (None, None), (400, "")]
    random.Random(5).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    token_files.write(docs.repartition(5), f"{tmp_path}/files", WORDS, end_id=1)
    found = token_files.read(spark, f"{tmp_path}/files").withColumn("crc", token_files.ids_crc32(F.col("ids"))).collect()
    found.sort(key=lambda r: r["start"])
    order = [(-1 if r["doc_id"] is None else r["doc_id"]) for r in found]
    assert order == sorted(order)
    at = 0
    wanted = {}
    for doc, text in rows:
        wanted.setdefault(doc, []).append([*library.encode(text or "", add_special_tokens=False).ids, 1])
    for row in found:
        assert row["start"] == at
        at += row["n_tokens"]
        assert row["n_tokens"] == len(row["ids"])
        assert row["crc"] == zlib.crc32(np.array(row["ids"], "<u4").tobytes())
        wanted[row["doc_id"]].remove(row["ids"])
    assert not any(wanted.values())
    plan = token_files.spans(spark, f"{tmp_path}/files")._jdf.queryExecution().executedPlan().toString()
    assert "ids:array" not in plan
    token_files.write(docs.limit(0), f"{tmp_path}/none", WORDS)
    assert token_files.read(spark, f"{tmp_path}/none").count() == 0


def test_queries_over_whole_tables(spark):
    texts_by_id = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    library = Tokenizer.from_file(WORDS)
    ids = {k: library.encode(t, add_special_tokens=False).ids for k, t in texts_by_id.items()}
    for row in queries.op1_piece_codec(spark, DATA).collect():
        want = pieces.encode(texts_by_id[row["doc_id"]], add_eos=True)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(pieces.decode(want).encode()).hexdigest()
    for row in queries.op9_token_counts(spark, DATA).collect():
        text = texts_by_id[row["doc_id"]]
        assert (row["n_bytes"], row["n_tokens"]) == (len(text.encode()), len(ids[row["doc_id"]]))
        assert row["over_limit"] == (row["n_tokens"] > 2048)
    at = 0
    for row in sorted(queries.op6_token_files(spark, DATA).collect(), key=lambda r: r["doc_id"]):
        want = [*ids[row["doc_id"]], 1]
        crc = zlib.crc32(np.array(want, "<u4").tobytes())
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (at, len(want), crc)
        at += len(want)

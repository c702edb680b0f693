"""The pipeline, each stage against a plain version over the stage's own input."""

import hashlib
import re
import unicodedata

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from brute import common, linked
from gaugework.llm import decontaminate, rule_quality, toxicity
from gaugework.llm.queries import table
from gaugework.llm.shared import labelled_sample, scratch

DATA = "/root/testdata/sf0.001"


def statistics_of(text):
    """The statistics of a text in plain Python."""
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    lines = [x for x in text.split("\n") if x]
    count = lambda letters: sum(text.count(c) for c in letters)
    per = lambda a, b: a / b if b else 0.0
    upper = sum(unicodedata.category(c) == "Lu" for c in text)
    log_words = np.log1p(len(words))
    return {
        "log_words": log_words, "word_length": per(len(text), len(words)), "distinct_words": per(len(set(words)), len(words)),
        "distinct_lines": per(len(set(lines)), len(lines)), "line_words": np.log1p(per(len(words), len(lines))),
        "upper": per(upper, len(text)), "symbols": per(count(rule_quality.SYMBOLS), len(words)),
        "digits": per(count("0123456789"), len(text)), "stops": per(count(".,;:"), len(words)),
        "bars": per(count("|"), len(words)), "repeats": per(log_words, len(set(words))),
    }


def ids(rows):
    return {r["doc_id"] for r in rows}


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "toxicity", "near_duplicates", "decontamination", "tokens"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = scratch(spark, f"test-{name}")
        before = docs.collect()
        model = None
        if name == "quality":
            model = rule_quality.fit(labelled_sample(docs, table(spark, DATA, "labels"), "quality", rule_quality.SAMPLE_ROWS))
        if name == "toxicity":
            model = toxicity.fit(labelled_sample(docs, table(spark, DATA, "labels"), "toxic", toxicity.SAMPLE_ROWS))
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        kept[name] = ids(after)
        if name != "tokens":
            assert docs.columns == columns
        if name == "quality":
            want = set()
            for r in before:
                stats = statistics_of(r["text"])
                total = model.intercept + sum(w for terms, w in model.rules if all((stats[n] > t) == up for n, t, up in terms))
                if 1 / (1 + np.exp(-total)) >= 0.3:
                    want.add(r["doc_id"])
            assert model.rules and kept[name] == want and len(want) < len(before)
        if name == "toxicity":
            scores = model.scores([r["text"] for r in before])
            assert kept[name] == {r["doc_id"] for r, s in zip(before, scores) if s < 0.5}
        if name == "near_duplicates":
            expected = linked([(r["doc_id"], r["text"]) for r in before], 5)
            assert kept[name] == {d for d, _, _, stays in expected if stays}
        if name == "decontamination":
            items = [decontaminate.words_of(r["text"]) for r in table(spark, DATA, "benchmark").collect()]
            for r in before:
                words = decontaminate.words_of(r["text"])
                text = f" {' '.join(words)} "
                if any(f" {' '.join(i)} " in text for i in items):
                    assert r["doc_id"] not in kept[name]
                elif r["doc_id"] not in kept[name]:
                    assert max(common(i, words) / len(i) for i in items) >= decontaminate.LIKELY
        if name == "tokens":
            library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            texts = {r["doc_id"]: r["text"] for r in before}
            assert len(after) == len(before)
            for r in after:
                want = library.encode(texts[r["doc_id"]], add_eos=True)
                assert r["n_tokens"] == len(want)
                assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert kept["tokens"] == kept["decontamination"] < kept["near_duplicates"] | {-1}
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert ids(rows) == kept["tokens"] and len(rows) == len(kept["tokens"])


def test_stages_with_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "same text of words"), (3, "same text of words"), (None, "no id"), (4, "long " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr(
        "*", "1 AS label", "2 AS score", "'x' AS words", "3 AS kept", "4 AS id"
    )
    empty = {"labels": "doc_id bigint, quality int, toxic int", "benchmark": "item_id bigint, text string"}
    for name, schema in empty.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, str(tmp_path))
            assert out.count() == given.count()
            if name != "tokens":
                assert out.columns == given.columns
    given_ids = sorted(str(r["doc_id"]) for r in corpus_pipeline.one_of_each(spark, docs, str(tmp_path)).collect())
    assert given_ids == sorted(str(r[0]) for r in rows)


def test_stages_work_on_small_batches_and_leave_the_setting(spark, tmp_path, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []

    def stage(session, docs, sf_dir):
        seen.append(int(session.conf.get(name)))
        if len(seen) == 2:
            raise ValueError("stop")
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage)])
    spark.createDataFrame([(1, "a")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get(name)
    with pytest.raises(ValueError, match="stop"):
        corpus_pipeline.run(spark, str(tmp_path))
    assert max(seen) <= 1000 and spark.conf.get(name) == before

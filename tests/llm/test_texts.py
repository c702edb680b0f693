"""Licence rules, quality, toxicity and decontamination, with their edge cases."""

import random
import uuid
import zlib

import duckdb
import numpy as np
import pytest
from brute import common
from gaugework.llm import decontaminate, licences, queries, rule_quality, shared, toxicity
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
BIGGER = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word " * 30000), (5, "same"), (5, "same"), (None, "no id"), (6, "\x00\x01\x02 é ﬁ 日本")]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ODD, "doc_id bigint, text string")
    return docs.selectExpr("*", "1 AS label", "2 AS score", "3 AS words", "4 AS predicted", "5 AS ids")


MIT = licences.SENTENCES["mit-grant"][1]
CASES = [
    ("Released under the MIT License.", ["mit-notice"], "MIT"),
    ("some words\nReleased under the MIT License.", ["mit-notice"], "MIT"),
    ("RELEASED under\nthe  MIT   license.", ["mit-notice"], "MIT"),
    ("Released under the MIT License or not.", [], ""),
    (MIT.replace(" ", "\n", 3) + "\n\n" + licences.SENTENCES["as-is"][0].replace(" of ", "\nof "), ["mit-grant", "as-is"], "MIT"),
    (" ".join(licences.SENTENCES[k][0] for k in ("bsd-grant",)) + "\n\n" + " ".join(
        licences.SENTENCES[k][0] for k in ("bsd-source", "bsd-binary", "bsd-names")),
     ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"], "BSD-3-Clause"),
    (" ".join(licences.SENTENCES[k][0] for k in ("bsd-source", "bsd-binary")), ["bsd-source", "bsd-binary"], ""),
    ("Licensed under CC BY-NC 4.0. All rights reserved. Licensed under CC BY-NC 4.0.",
     ["cc-by-nc", "reserved", "cc-by-nc"], "CC-BY-NC-4.0,Proprietary"),
    (None, [], ""), ("", [], ""),
    # A heading, list marks and other lines in the paragraph of a wrapped sentence.
    ("MIT License\nCopyright (c) 2020 A B\n" + MIT.replace(" ", "\n", 5), ["mit-grant"], "MIT"),
    ("BSD text\n" + " ".join(licences.SENTENCES["bsd-grant"][0].split()[:9]) + "\n" + " ".join(licences.SENTENCES["bsd-grant"][0].split()[9:]) + "\n* "
     + licences.SENTENCES["bsd-source"][0].replace(" this list", "\n  this list") + "\n* " + licences.SENTENCES["bsd-binary"][0],
     ["bsd-grant", "bsd-source", "bsd-binary"], "BSD-2-Clause"),
    # A known line inside a longer known run does not count again.
    ("note\n" + licences.SENTENCES["mit-grant"][0].replace(" The above", "\nThe above"), ["mit-grant"], "MIT"),
    ("permission is\nhereby granted\nor not\nAll rights reserved\nmore", ["reserved"], "Proprietary"),
    ("# SPDX-License-Identifier: BSD-3-Clause\nx = 1", ["bsd3-notice"], "BSD-3-Clause"), ("x\nSPDX-License-Identifier: BSD-3-Clause\nx = 1", ["bsd3-notice"], "BSD-3-Clause"),
    ("SPDX-License-Identifier: ISC", ["isc-notice"], "ISC"),
    ("Licensed under the GNU General Public License, version 2.", ["gpl2-notice"], "GPL-2.0"),
    (licences.SENTENCES["lgpl21-terms"][0] + " " + licences.SENTENCES["lgpl-hope"][0], ["lgpl21-terms", "lgpl-hope"], "LGPL-2.1"),
    (licences.SENTENCES["agpl3-terms"][0] + " " + licences.SENTENCES["gpl-hope"][0], ["agpl3-terms", "gpl-hope"], "AGPL-3.0"),
    (licences.SENTENCES["epl-terms"][0], ["epl-terms"], "EPL-2.0"), (licences.SENTENCES["cddl-terms"][0], ["cddl-terms"], "CDDL-1.0"),
    (licences.SENTENCES["bsl-notice"][0], ["bsl-notice"], "BSL-1.0"), (licences.SENTENCES["unlicense"][0], ["unlicense"], "Unlicense"),
]


def test_licence_rules(spark):
    docs = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "doc_id int, text string")
    rows = {r["doc_id"]: r for r in licences.scan(docs).collect()}
    for k, (_, sequence, found) in enumerate(CASES):
        assert rows[k]["sequence"] == ",".join(sequence), k
        assert rows[k]["licences"] == found, k
        assert rows[k]["n_known"] == len(sequence)


def test_licence_scan_of_odd_rows(spark, odd):
    assert [r["licences"] for r in licences.scan(odd).collect()] == [""] * len(ODD)
    assert licences.scan(odd.limit(0)).count() == 0


@pytest.mark.parametrize("data", [DATA, BIGGER])
def test_licence_query_matches_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    cursor = con.execute(queries.ORACLES["op7_licences"])
    names = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall())
    got = sorted(tuple(r) for r in queries.op7_licences(spark, data).select(*names).collect())
    assert got == want and any(r[names.index("licences")] for r in got)


def held(rows, label):
    """Area under the curve over held-out rows."""
    pos = np.array([r["score"] for r in rows if r["held_out"] and r[label] == 1])
    neg = np.array([r["score"] for r in rows if r["held_out"] and r[label] == 0])
    return (pos[:, None] > neg[None]).mean() + (pos[:, None] == neg[None]).mean() / 2


def test_quality_query(spark):
    labels = spark.read.parquet(f"{BIGGER}/labels.parquet")
    found = queries.op5_rule_quality(spark, BIGGER)
    assert found.count() == spark.read.parquet(f"{BIGGER}/documents.parquet").count()
    rows = found.join(labels, "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == (r["score"] >= 0.3)
    assert held(rows, "quality") > 0.9


def test_toxicity_query(spark):
    labels = spark.read.parquet(f"{BIGGER}/labels.parquet")
    found = queries.op2_toxicity(spark, BIGGER)
    rows = found.join(labels, "doc_id").collect()
    assert found.count() == spark.read.parquet(f"{BIGGER}/documents.parquet").count()
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["predicted"] == r["toxic"] for r in rows if r["held_out"]]) > 0.9


def test_rules_hold_in_columns_as_in_numpy(spark):
    rng = random.Random(1)
    rows = [(k, "word " * rng.randint(1, 40) if k % 2 else "### " * rng.randint(1, 40), k % 2) for k in range(300)]
    sample = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    model = rule_quality.fit(sample)
    assert model.rules
    for r in rule_quality.statistics(sample).withColumn("p", model.score()).collect():
        stats = r[rule_quality.STATS]
        total = model.intercept + sum(
            w for terms, w in model.rules if all((stats[n] > t) == above for n, t, above in terms)
        )
        assert r["p"] == pytest.approx(1 / (1 + np.exp(-total)))
        assert (r["p"] >= 0.5) == (r["label"] == 1)


def test_quality_of_odd_rows_and_without_labels(spark, odd):
    empty = spark.createDataFrame([], "doc_id bigint, text string, label int")
    model = rule_quality.fit(empty)
    assert not model.rules
    out = rule_quality.statistics(odd).withColumn("p", model.score())
    assert [r["p"] for r in out.collect()] == [0.5] * len(ODD)
    assert rule_quality.statistics(odd.limit(0)).count() == 0
    one_kind = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "doc_id bigint, text string, label int")
    assert not rule_quality.fit(one_kind).rules


def small_scorer():
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in ("lo", "mi", "ra", "tu", "ne")]
    texts, labels = [], []
    for k in range(300):
        words = rng.choices(vocabulary, k=rng.randint(5, 200))
        if k % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(["awful", "horrid", "Awful!"])
        texts.append(" ".join(words))
        labels.append(int(k % 3 == 0))
    return toxicity.train(texts, labels), vocabulary


def test_toxic_words_anywhere_in_a_text(spark, odd):
    scorer, vocabulary = small_scorer()
    rng = random.Random(3)
    clean = [" ".join(rng.choices(vocabulary, k=n)) for n in (1, 10, 63, 64, 65, 96, 112, 113, 500, 20000)]
    assert (scorer.scores(clean) < 0.5).all()
    for text in clean[1:]:
        words = text.split()
        for at in (0, len(words) // 2, len(words) - 1):
            worse = [*words[:at], "horrid", *words[at + 1 :]]
            assert scorer.scores([" ".join(worse)])[0] >= 0.5
    assert (scorer.scores(["", None, "  "]) < 0.5).all()
    rows = odd.withColumn("p", toxicity.score(F.col("text"), scorer)).collect()
    assert all(0 <= r["p"] <= 1 for r in rows) and rows[4]["p"] == rows[5]["p"]
    assert odd.limit(0).withColumn("p", toxicity.score(F.col("text"), scorer)).count() == 0


def test_windows_cover_every_word():
    for n in [0, 1, 47, 48, 49, 63, 64, 65, 112, 113, 160, 161, 500]:
        text, first, held_ = toxicity._windows(np.array([n]))
        covered = {i for a, k in zip(first.tolist(), held_.tolist()) for i in range(a, a + k)}
        assert covered == set(range(n)) and (len(first) == 1 or (held_ > 0).all())


def test_gradients():
    """Backward pass against finite differences."""
    rng = np.random.default_rng(4)
    net = toxicity.Network()
    live = np.ones((7, 3), bool)
    live[5:, 1] = False
    forth, back = (rng.standard_normal((7, 3, 3 * toxicity.HIDDEN)).astype(np.float32) for _ in range(2))
    error = rng.standard_normal(3).astype(np.float32)
    kept = {}
    net.forward(forth, back, live, kept)
    grads, projected = net.backward(error, kept, live)

    def loss():
        return float(net.forward(forth, back, live).astype(np.float64) @ error)

    for name in ("rec_f", "rec_b", "attend", "query", "out"):
        flat, wanted = net.params[name].reshape(-1), np.asarray(grads[name]).reshape(-1)
        for at in rng.integers(0, flat.size, 4):
            old = flat[at]
            flat[at] = old + 1e-2
            up = loss()
            flat[at] = old - 1e-2
            down = loss()
            flat[at] = old
            assert (up - down) / 2e-2 == pytest.approx(wanted[at], rel=0.05, abs=2e-3)
    old = forth[2, 0, 3]
    forth[2, 0, 3] = old + 1e-2
    up = loss()
    forth[2, 0, 3] = old - 1e-2
    down = loss()
    assert (up - down) / 2e-2 == pytest.approx(projected["f"][2, 0, 3], rel=0.05, abs=2e-3)


def test_toxicity_without_two_labels():
    assert toxicity.train([], []).scores(["a", None]).tolist() == [0.5, 0.5]
    assert toxicity.train(["a"], [0]).scores(["b"])[0] == pytest.approx(1 / 3)


def test_alignment_matches_the_table_method():
    rng = random.Random(5)
    for _ in range(200):
        a, b = (rng.choices("abcdef", k=rng.randint(1, 70)) for _ in range(2))
        aligner = decontaminate.Aligner(a)
        assert aligner.common(b) == common(a, b) <= aligner.at_most(set(b))


def test_decontamination_query(spark):
    """Whole passages that stand in documents word for word, found by a plain search."""
    items = {r["item_id"]: decontaminate.words_of(r["text"]) for r in spark.read.parquet(f"{BIGGER}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{BIGGER}/documents.parquet").collect():
        text = f" {' '.join(decontaminate.words_of(r['text']))} "
        want |= {(r["doc_id"], i) for i, w in items.items() if f" {' '.join(w)} " in text}
    rows = queries.op3_decontaminate(spark, BIGGER).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert want and want <= got and len(rows) == len(got)
    assert all(r["covered"] >= decontaminate.LIKELY for r in rows)


def test_paraphrases_and_edges(spark):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([10, 30, 60, 200])]
    items += [(7, None), (8, ""), (9, "too short"), (1, items[1][1])]
    docs, planted = [], {}
    for k in range(60):
        words = rng.choices(vocabulary, k=rng.randint(0, 400))
        if k % 3 == 0:
            item = k // 3 % 4
            passage = [w if rng.random() > 0.15 else rng.choice(vocabulary) for w in items[item][1].upper().split()]
            at = rng.randint(0, len(words))
            words[at:at] = passage
            planted[k] = item
        docs.append((k, " ".join(words)))
    docs += [(100, None), (101, ""), (102, "a " * 50000), (None, items[1][1]), (103, items[0][1]), (103, items[0][1])]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "2 AS answer")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").withColumn("words", F.lit(1))
    rows = decontaminate.search(table, benchmark).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert got == {*planted.items(), (None, 1), (103, 0)} and len(rows) == len(got) + 1
    kept = decontaminate.clean(table, benchmark)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - set(planted) - {None, 103}
    assert decontaminate.search(table, benchmark.limit(0)).count() == 0
    assert decontaminate.search(table.limit(0), benchmark).count() == 0
    assert decontaminate.clean(table, benchmark.limit(0)).count() == len(docs)


def test_short_answers_count_where_they_are_rare(spark):
    """Half of a passage and its answer in a row, without it, with its words apart, and with an answer of common words."""
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    kept = [rng.choices(vocabulary, k=12) for _ in range(2)]
    gone = [rng.choices(vocabulary, k=10) for _ in range(2)]
    items = [(1, " ".join(kept[0] + gone[0]) + ". Zyxel Quorvat"), (2, " ".join(kept[1] + gone[1]) + ". " + " ".join(vocabulary[:2]))]
    fill = lambda n: rng.choices(vocabulary[:2] * 40 + vocabulary, k=n)
    docs = [(k, " ".join(fill(80))) for k in range(300)]
    docs += [(1000, " ".join(fill(30) + kept[0] + ["zyxel", "quorvat"] + fill(30))), (1001, " ".join(fill(30) + kept[0] + fill(30))),
             (1002, " ".join(fill(30) + kept[0] + ["zyxel"] + fill(3) + ["quorvat"] + fill(30))),
             (1003, " ".join(fill(30) + kept[1] + vocabulary[:2] + fill(30)))]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = decontaminate.search(table, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(1000, 1)}
    assert all(decontaminate.LIKELY <= r["covered"] < decontaminate.SURE and r["answered"] == 1 for r in rows)
    # An answer may hold words that stand in no passage.
    own = spark.createDataFrame([(1, " ".join(kept[0] + gone[0]), "Zyxel Quorvat")], "item_id bigint, text string, answer string")
    assert {r["doc_id"] for r in decontaminate.search(table, own).collect()} == {1000}


def test_scripts_without_blanks(spark):
    item, thai = "机器学习模型需要大量的训练数据才能取得好的效果", "การเรียนรู้ของเครื่องต้องการข้อมูล"
    others = "今天天气很好我们一起去公园散步然后回家吃饭看书"
    docs = [(1, others + item + others), (2, others * 3), (3, f"x {thai} y"), (4, item[:4]), (5, "plain words " * 20)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(1, item), (2, thai), (3, item[:5])], "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.search(table, benchmark).collect()} == {(1, 1), (3, 2)}
    assert decontaminate.words_of("Ab_c 日本x ß") == ["ab", "c", "日", "本", "x", "ß"]


def test_verbatim_passages_of_a_large_benchmark(spark):
    """2000 items of 6 to 20 common words, planted word for word among words of the same kind."""
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(4000)]
    weights = [1 / (k + 20) for k in range(4000)]
    items = [(k, " ".join(rng.choices(vocabulary, weights, k=6 + k % 15))) for k in range(2000)]
    docs, planted = [], set()
    for k in range(500):
        words = []
        for i in range(4 * k, 4 * k + 4):
            words += rng.choices(vocabulary, weights, k=rng.randint(20, 90)) + items[i][1].split()
            planted.add((k, i))
        docs.append((k, " ".join(words + rng.choices(vocabulary, weights, k=rng.randint(0, 90)))))
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(8)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontaminate.search(table, benchmark).collect()
    whole = {(r["doc_id"], r["item_id"]) for r in rows if r["covered"] == 1.0}
    assert planted <= whole and len({(r["doc_id"], r["item_id"]) for r in rows}) == len(rows)


def test_blocks_give_the_same_answers(spark, monkeypatch):
    docs, benchmark = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = {(r["doc_id"], r["item_id"]) for r in decontaminate.search(docs, benchmark).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK", 20)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.search(docs, benchmark).collect()} == whole


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    rows = shared.labelled_sample(docs, labels, "toxic", 1000).collect()
    assert {r["doc_id"] for r in rows} == {k for k in range(200) if zlib.crc32(str(k).encode()) % 5}
    assert len(shared.labelled_sample(docs, labels, "toxic", 10).collect()) == 10


def test_labels_of_absent_documents_leave_the_sample_full(spark):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(0, 1000, 10)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1000)], "doc_id bigint, quality int")
    rows = shared.labelled_sample(docs, labels, "quality", 20).collect()
    assert len({r["doc_id"] for r in rows}) == 20


def test_repeated_ids_and_long_texts_leave_the_sample_bounded(spark):
    same = [(1, f"t{k}") for k in range(5000)] + [(2, "copy")] * 3000
    docs = spark.createDataFrame(same + [(k, "x") for k in range(3, 200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id bigint, toxic int")
    rows = shared.labelled_sample(docs, labels, "toxic", 50).collect()
    assert len(rows) == 50 and len({(r["doc_id"], r["text"]) for r in rows}) == 50
    assert sorted(map(tuple, shared.labelled_sample(docs.repartition(7), labels, "toxic", 50).collect())) == sorted(map(tuple, rows))
    long = spark.createDataFrame([(k, "é" * 1000) for k in range(100)], "doc_id bigint, text string")
    assert len(shared.labelled_sample(long, labels, "toxic", 50, text_bytes=10_000).collect()) == 5
    assert len(shared.labelled_sample(long, labels, "toxic", 50, text_bytes=10).collect()) == 1


def test_the_latent_space_learns_from_all_documents(spark):
    from gaugework.llm import decontaminate as dc

    docs = spark.range(2100).selectExpr("id AS doc_id", "'one two' AS text")
    found = dc._all_passages(docs, {"one": 0, "two": 1}, [dc.Passage(1, ["one"], ["two"])])
    assert {r["sought"]: r["count"] for r in found.groupBy("sought").count().collect()} == {True: 1, False: 2100}


def test_products_and_search_over_numbered_words():
    import pyarrow as pa

    from gaugework.llm import decontaminate as dc

    rng, size = np.random.default_rng(4), 50
    words = [rng.integers(0, size, n).tolist() for n in (5, 1, 40, 64, 0, 7)] * 300
    sought = [k % 3 == 0 for k in range(len(words))]
    idf, basis = rng.random(size) + 0.1, rng.standard_normal((size, 7))
    a = np.zeros((len(words), size))
    for k, row in enumerate(words):
        a[k] = np.bincount(row, minlength=size) * idf
        a[k] *= (1.5 if sought[k] else 1.0) / max(np.linalg.norm(a[k]), 1e-300)
    batch = pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.int32())), pa.array(sought)], names=["words", "sought"])
    for common in (0, 11, size):
        rows = dc.Rows(idf, 1.5, basis, np.arange(common))
        assert np.allclose(rows.back([batch.slice(0, 700), batch.slice(700)]), a.T @ a @ basis)
        assert np.allclose(rows.square([batch]), basis.T @ a.T @ a @ basis)
    vocabulary = [f"w{k}" for k in range(60)]
    number = {w: k for k, w in enumerate(vocabulary[:size])}
    texts = [" ".join(rng.choice(vocabulary, n)) for n in (0, 30, 300, 7, 90)] * 20
    passages = [dc.Passage(k, texts[1].split()[4 * k : 4 * k + 12], ["w1"]) for k in range(4)]
    passages = [dc.Passage(p.item, [w for w in p.words if w in number], p.answer) for p in passages]
    detector = dc.Detector(passages, number, rng.standard_normal((size, 8)), idf)
    flat, sizes = dc._numbers(texts, number)
    found = list(detector.matches_of_numbers(flat, sizes))
    assert found == list(detector.matches(texts)) and any(found)
    dc.AT_ONCE, kept = 100, dc.AT_ONCE
    try:
        assert [[m[0] for m in t] for t in detector.matches_of_numbers(flat, sizes)] == [[m[0] for m in t] for t in found]
    finally:
        dc.AT_ONCE = kept


def test_words_are_those_of_the_pattern():
    rng = random.Random(12)
    ranges = [range(128), range(400), range(0x300, 0x3400), range(0xE00, 0xF00), [0x212A, 0x130, 0x4E00, 0x2028, 0x85, 0x20000]]
    texts = ["".join(chr(rng.choice(rng.choice(ranges))) for _ in range(rng.randrange(30))) for _ in range(3000)]
    for text in [*texts, "".join(map(chr, range(0x3100)))]:
        assert decontaminate.words_of(text) == decontaminate.WORD.findall(text.lower())


def test_workers_give_back_what_they_freed_before_another_operator():
    def held() -> int:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    pieces = [bytes(2000) for _ in range(100_000)]
    last = bytes(2000)  # stays above the others, so that freeing them does not shrink the heap
    del pieces
    before = held()
    assert shared.kept_by_worker(("test", uuid.uuid4().hex), lambda: 7) == 7
    assert len(last) == 2000 and held() < before - 100_000_000


def test_passages_of_the_benchmark_need_no_other_kind_of_workers(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "written", lambda df, label: df)
    docs = spark.createDataFrame([(1, [0, 1, 2, 0])], "doc_id bigint, words array<int>")
    docs = docs.where(F.col("doc_id") > 1)
    table = decontaminate._all_passages(docs, {"a": 0, "b": 1}, [decontaminate.Passage(5, ["a", "b", "a"], []), decontaminate.Passage(6, [], [])])
    plans = table._jdf.queryExecution().optimizedPlan().toString()
    assert plans.count("LogicalRDD") == 1  # the documents
    assert sorted((r["words"], r["sought"]) for r in table.collect()) == [([], True), ([0, 1, 0], True)]

"""Filter audit and language-model scores against plain versions."""

import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from gaugework.llm import context_tree, filter_audit, queries

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text):
    words = WORD.findall(text)
    return "".join(
        letter for letter, bad in zip("ABCD", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words),
            100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text),
        )) if bad
    )


def audited(docs, labels):
    """The audit by walking every document through every order."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    failed = []
    for doc, text, lang in docs:
        text = text or ""
        copy = doc is not None and any(o is not None and o < doc and (t or "") == text for o, t, _ in docs)
        failed.append((doc, lang or "", fails(text) + ("E" if copy else "")))
    rows = {}
    for part in {p for _, p, _ in failed}:
        own = [(d, f) for d, p, f in failed if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(own)
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                shapley[letter] += len(gone)
                rows[part, order, step] = [
                    len(left), len(gone), sum(letter in f for _, f in own) - len(gone), sum(f == letter for _, f in own),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone),
                ]
        for (p, order, step), row in rows.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return rows


def test_audit_walks_every_order(spark):
    rng = random.Random(5)
    texts = [None, "", "A B", "x " * 250, " ".join(f"w{k}" for k in range(300)), "é" * 40 + "A", "a|b", "a\x00b", "a b\x0bc", "long" * 50_000]
    texts += [" ".join(rng.choices(["Up", "low", "$", "x"], k=rng.choice([3, 220]))) for _ in range(20)]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "en", "de"])) for _ in range(150)]
    docs += docs[:5] + [(None, "same", "en")] * 3
    labels = [(rng.choice([None, *range(50)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(60)]
    found = filter_audit.audit(
        spark.createDataFrame(docs, "doc_id bigint, text string, lang string").selectExpr("*", "1 AS part", "true AS good", "0 AS failed"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").selectExpr("*", "'x' AS digest"),
    )
    assert {(r[0], r[1], r[2]): list(r[3:]) for r in found.collect()} == audited(docs, labels)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    rows = filter_audit.audit(one, labels).collect()
    assert len(rows) == 600 and {r["part"] for r in rows} == {""} and all(r["kept"] + r["removed"] + r["redundant"] >= 0 for r in rows)


def test_audit_query(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    cursor = con.execute(queries.ORACLES["op12_filter_audit"])
    names = [c[0] for c in cursor.description]
    found = queries.QUERIES["op12_filter_audit"](spark, DATA)
    assert found.columns == names
    assert sorted(map(tuple, found.collect())) == sorted(cursor.fetchall())


@pytest.mark.parametrize("count", [0, 1, 2, 3, 1000, 4097])
def test_positional_popcount(count):
    rng = np.random.default_rng(count)
    words = rng.integers(0, 2**32, count, dtype=np.uint32)
    times = rng.integers(1, 1 << 20, count)
    plain = [int(((words >> np.uint32(k)) & 1).sum()) for k in range(32)]
    assert filter_audit.positional_popcount(words).tolist() == plain
    weighted = [int((((words >> np.uint32(k)) & 1) * times).sum()) for k in range(32)]
    assert filter_audit.positional_popcount(words, times).tolist() == weighted


class Tree:
    """Context-tree weighting as it is defined: the weighted probability of all choices seen, with one more or without."""

    def __init__(self, depth):
        self.depth, self.counts, self.under = depth, {}, {}

    def places(self, before, node):
        return [(before[len(before) - d :], node) for d in range(self.depth + 1)]

    def learn(self, before, node, bit):
        for place in self.places(before, node):
            self.counts.setdefault(place, [0, 0])[bit] += 1
            if place[0]:
                self.under.setdefault((place[0][1:], node), set()).add(place)

    def weight(self, place, changed=None, bit=0):
        zeros, ones = self.counts.get(place, (0, 0))
        if changed and place in changed:
            zeros, ones = zeros + (bit == 0), ones + (bit == 1)
        lg = math.lgamma
        own = lg(zeros + 0.5) + lg(ones + 0.5) - 2 * lg(0.5) - lg(zeros + ones + 1)
        if len(place[0]) == self.depth:
            return own
        own_way = changed if changed and place in changed else ()
        children = set(self.under.get(place, ())) | {p for p in own_way if len(p[0]) == len(place[0]) + 1}
        below = sum(self.weight(p, changed, bit) for p in children)
        return max(own, below) + math.log1p(math.exp(-abs(own - below))) - math.log(2)

    def chance(self, before, node, bit):
        """Log of the probability of ``bit``."""
        places = self.places(before, node)
        return self.weight(places[0], set(places), bit) - self.weight(places[0])


def choices(tokens, depth):
    stream = b"\n" * depth + b"".join(w + b" " for w in tokens) + b"\n"
    for k in range(depth, len(stream)):
        node = 1
        for i in range(7, -1, -1):
            bit = stream[k] >> i & 1
            yield stream[k - depth : k], node, bit
            node = 2 * node + bit


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def plainly_scored(rows, depth):
    trains = lambda doc: doc is None or zlib.crc32(str(doc).encode()) % 10 != 0
    tree, counts = Tree(depth), {}
    for doc, text in rows:
        if trains(doc):
            for choice in choices(words_of(text), depth):
                tree.learn(*choice)
            for token in [*words_of(text), b"\n"]:
                counts[token] = counts.get(token, 0) + 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for doc, text in rows:
        tokens = [*words_of(text), b"\n"]
        base = sum(math.log10((counts.get(t, 0) + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        total = sum(tree.chance(*choice) for choice in choices(tokens[:-1], depth)) / math.log(10)
        out.append((doc, not trains(doc), len(tokens), sum(t in counts for t in tokens), n, base, total))
    return out


@pytest.mark.parametrize("depth, common, part", [(1, 3, 7), (3, 1 << 19, 1 << 20), (4, 20, 15)])
def test_scores_are_those_of_the_weighted_tree(spark, depth, common, part, monkeypatch):
    monkeypatch.setattr(context_tree, "PART_GRAMS", part)
    monkeypatch.setattr(context_tree, "SHARED", 2)
    rng = random.Random(depth)
    vocabulary = ["the", "The", "théorie", "a", "ab", "über", "x y", "zz", "日本"]
    rows = [(k if k % 11 else None, rng.choice([" ", "\t", " \n"]).join(rng.choices(vocabulary, k=rng.choice([0, 1, 4, 9])))) for k in range(45)]
    rows += [(100, None), (101, ""), (102, " \x0b "), (20, "the only ~ here"), (30, "the"), (30, "the")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS run", "2 AS tokens", "'x' AS word")
    found = [tuple(r)[:7] for r in context_tree.score(docs.repartition(3), depth, common, common).collect()]
    key = lambda r: (r[0] is None, r[0], r[2], round(r[5], 6))
    for got, want in zip(sorted(found, key=lambda r: str(key(r))), sorted(plainly_scored(rows, depth), key=lambda r: str(key(r))), strict=True):
        assert got[:5] == want[:5]
        assert got[5:] == pytest.approx(want[5:], rel=1e-9)
    assert any(r[1] for r in found) and not all(r[1] for r in found)


def test_scores_without_rows_or_training(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert context_tree.score(none).count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    row = context_tree.score(spark.createDataFrame([(held, "ab")], none.schema), depth=2).first()
    assert row["train_tokens"] == 0 and row["n_known"] == 0 and row["base_score"] == 0
    assert row["score"] == pytest.approx(-8 * 4 * math.log10(2)) and row["bits_per_byte"] == pytest.approx(8)


def test_pieces_of_a_long_text_score_as_the_whole(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["aa", "ab", "ba", "c"], k=k)).encode() for k in (200, 0, 1, 90)]
    grams = np.unique(np.concatenate([g for g, _ in context_tree.grams_of([context_tree.body_of(t.split()) for t in texts], 3)]))
    scorer = context_tree.Scorer([b"aa", b"c"], np.array([-1.0, -2.0]), grams[::2], -np.arange(1.0, 1 + len(grams[::2])), 3)
    whole, words, left = scorer.texts(texts)
    monkeypatch.setattr(context_tree, "PIECE_BYTES", 17)
    cut, cut_words, cut_left = scorer.texts(texts)
    for name in whole:
        assert cut[name] == pytest.approx(whole[name])
    assert cut_words == words and sum(words.values()) == sum(t.split().count(w) for t in texts for w in (b"ab", b"ba")) + 4
    total = lambda parts: sum(int(times.sum()) for _, _, times in parts)
    assert total(cut_left) == total(left) > 0


def test_grams_are_the_numbers_of_their_bytes():
    letters = np.frombuffer(bytes(random.Random(1).randbytes(40)), np.uint8)
    for depth in range(1, 7):
        plain = [int.from_bytes(letters[k : k + depth + 1].tobytes(), "big") for k in range(40 - depth)]
        assert context_tree.rolled(letters, depth).tolist() == plain
        assert context_tree.rolled(letters[:depth], depth).tolist() == []


@pytest.mark.parametrize("count", [0, 1, 5000])
def test_gram_table(count):
    rng = np.random.default_rng(count)
    grams = rng.choice(20_000, count, replace=False).astype(np.int64) << 30
    table = context_tree.GramTable(grams, np.arange(count) - 0.5)
    plain = dict(zip(grams.tolist(), np.arange(count) - 0.5))
    asked = np.r_[grams, rng.integers(0, 1 << 48, 1000)]
    chance, found = table.get(asked)
    assert found.tolist() == [g in plain for g in asked.tolist()]
    assert chance.tolist() == [plain.get(g, 0.0) for g in asked.tolist()]


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 2, 7.5, 100, 1e6 + 0.5, 1e12])
    assert context_tree.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)


def test_held_out_texts_score_above_the_word_baseline(spark):
    rows = queries.QUERIES["op13_context_tree"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and 60 < len(held) < 140
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)

"""Chains of linked traces against a walk of every link."""

import random

from helpers import rows

from gaugework.operators import chains

DDL = "trace_id STRING, outcome STRING, duration_ms BIGINT, traceparent STRING"


def name(k):
    return f"{k + 1:032x}"


def link(k):
    return None if k is None else f"00-{name(k)}-{'c' * 16}-01"


def walked(spans):
    parents, counts = {}, {}
    for k, outcome, to in spans:
        spans_, errors = counts.get(k, (0, 0))
        counts[k] = (spans_ + 1, errors + (outcome == "error"))
        if to is not None and to != k:
            parents[k] = min(parents.get(k, to), to)
    found = {}
    for k in counts:
        way = [k]
        while way[-1] in parents and parents[way[-1]] not in way:
            way.append(parents[way[-1]])
        if way[-1] in parents:
            found[k] = (min(way[way.index(parents[way[-1]]):]), None, True)
        else:
            found[k] = (way[-1], len(way) - 1, False)
    chain = {}
    for k, (root, _, _) in found.items():
        n, s, e = chain.get(root, (0, 0, 0))
        chain[root] = (n + 1, s + counts[k][0], e + counts[k][1])
    return sorted(((name(k), name(r), d, c, *chain[r]) for k, (r, d, c) in found.items()), key=str)


def table(spark, spans):
    return spark.createDataFrame([(name(k), outcome, 1, link(to)) for k, outcome, to in spans], DDL)


def test_random_links_with_cycles(spark):
    rng = random.Random(2)
    spans = [(rng.randrange(60), rng.choice(["ok", "error"]), rng.choice([None, rng.randrange(70)])) for _ in range(150)]
    assert rows(chains.trace_chains(table(spark, spans))) == walked(spans)


def test_a_chain_of_a_thousand_links_and_a_large_ring(spark):
    spans = [(k, "ok", k + 1) for k in range(1000)] + [(1000, "error", None)]
    spans += [(2000 + k, "ok", 2000 + (k + 1) % 300) for k in range(300)] + [(5000, "ok", 2100), (6000, "ok", 6000)]
    found = rows(chains.trace_chains(table(spark, spans)))
    assert found == walked(spans)
    assert (name(0), name(1000), 1000, False, 1001, 1001, 1) in found and (name(5000), name(2000), None, True, 301, 301, 0) in found


def test_no_links_and_no_spans(spark):
    assert rows(chains.trace_chains(table(spark, [(1, "ok", None)]))) == [(name(1), name(1), 0, False, 1, 1, 0)]
    assert chains.trace_chains(table(spark, [])).count() == 0


def test_rounds_send_nothing_to_the_driver_but_counts(spark):
    found = chains.trace_chains(table(spark, [(1, "ok", 2), (2, "ok", 3), (3, "error", None)]))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r["depth"] for r in found.orderBy("depth").collect()] == [0, 1, 2]

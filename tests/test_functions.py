import pytest
from helpers import one
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugework import functions as fn


@pytest.mark.parametrize(
    "text, expected",
    [
        ("  Straße\n", "strasse"),
        ("STRASSE", "strasse"),
        ("Café", "café"),
        ("CAFÉ", "café"),
        ("a\t\x1cb  c d", "a b c d"),
        ("ﬁne", "fine"),
        ("", ""),
        (None, None),
    ],
)
def test_normalize_text(spark, text, expected):
    assert one(spark, fn.normalize_text(F.lit(text).cast("string"))) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ('{"b":1,"a":[1.0,2]}', '{"a":[1,2],"b":1}'),
        ("1e2", "100"),
        ('{"x":{"y":-0.0}}', '{"x":{"y":0}}'),
        ("1.50", "1.5"),
        ('{"a":1,"a":2}', None),
        ('{"a":1} x', None),
        ('{"a":1}}', None),
        ("1,2", None),
        ("[1]]", None),
        ('{"a":NaN}', None),
        ("1E400", None),
        ("12345678901234567890", None),
        ("9007199254740991", "9007199254740991"),
        ("", None),
        ("null", "null"),
        ('"1e5 is text"', '"1e5 is text"'),
        ('{"k":"1e5","n":1e5}', '{"k":"1e5","n":100000}'),
    ],
)
def test_canonical_json(spark, text, expected):
    assert one(spark, fn.canonical_json(F.lit(text))) == expected


def test_canonical_json_equates_number_forms(spark):
    forms = ["0.0000001", "1e-7", "10E-8", "0.00000010"]
    found = {one(spark, fn.canonical_json(F.lit(t))) for t in forms}
    assert len(found) == 1


def test_long_strings_do_not_overflow(spark):
    text = '{"t":"' + "x\\n" * 200_000 + '"}'
    assert one(spark, F.size(fn.json_keys(F.lit(text)))) == 1


def test_json_keys(spark):
    text = '{"a":{"Pass word":1,"l":[{"b\\"c":2}]},"s":"x: \\"y\\":"}'
    assert one(spark, fn.json_keys(F.lit(text))) == ["a", "Pass word", "l", 'b\\"c', "s"]


@pytest.mark.parametrize("a, b, expected", [(0.3, 0.1, 0.2), (1.0, 0.9, 0.1), (0.95, 1.0, -0.05), (None, 1.0, None)])
def test_decimal_diff(spark, a, b, expected):
    left, right = F.lit(a).cast("double"), F.lit(b).cast("double")
    assert one(spark, fn.decimal_diff(left, right)) == expected


def test_boundaries(spark):
    assert one(spark, fn.at_least(F.lit(0.7 - 5e-13), F.lit(0.7)))
    assert not one(spark, fn.at_least(F.lit(0.7 - 5e-12), F.lit(0.7)))
    assert one(spark, fn.at_most(F.lit(0.7 + 5e-13), F.lit(0.7)))
    assert not one(spark, fn.at_most(F.lit(0.7 + 5e-12), F.lit(0.7)))


@pytest.mark.parametrize("text, units", [("", 1), ("abcd", 1), ("abcde", 2), ("äöü", 2)])
def test_estimated_units(spark, text, units):
    assert one(spark, fn.estimated_units(F.lit(text))) == units


@pytest.mark.parametrize("attempt, delay", [(1, 5), (2, 10), (3, 20), (9, 60), (2000, 60)])
def test_retry_delay(spark, attempt, delay):
    assert one(spark, fn.retry_delay(F.lit(attempt), 5, 60)) == delay


@pytest.mark.parametrize(
    "code, cls, level",
    [(200, "2xx", "INFO"), (404, "4xx", "WARNING"), (503, "5xx", "ERROR"), (999, "5xx", "ERROR"), (99, "5xx", "ERROR"), (None, "5xx", "ERROR")],
)
def test_status_class_and_severity(spark, code, cls, level):
    value = F.lit(code).cast("int")
    assert one(spark, fn.status_class(value)) == cls
    assert one(spark, fn.severity(value)) == level


def test_labels_and_durations(spark):
    assert one(spark, fn.bounded_label(F.lit("PATCH"), ["GET"], "OTHER")) == "OTHER"
    assert one(spark, fn.bounded_label(F.lit(None).cast("string"), ["GET"], "OTHER")) == "OTHER"
    assert one(spark, fn.bounded_duration(F.lit(-5))) == 0
    assert one(spark, fn.bounded_duration(F.lit(10**15))) == 86_400 * 10**9
    assert one(spark, fn.slice_family(F.lit("language/de"))) == "language"
    assert one(spark, fn.slice_family(F.lit("tier/core"))) == "all"
    assert one(spark, fn.metric_label(F.lit("quality.exact_match"), F.lit("language/de_at"))) == "Exact match · de at"
    assert one(spark, fn.metric_label(F.lit("latency"), F.lit(None).cast("string"))) == "Latency"


@pytest.mark.parametrize(
    "check, good, bad",
    [
        (fn.valid_id, ["a", "A1._:/-", "x" * 128], ["", "-a", "a b", "x" * 129, "a\n", "a=b"]),
        (fn.valid_slice, ["language/de", "a=b"], ["", "/a", "a b"]),
        (fn.valid_metric, ["quality.exact_match"], ["1abc", ""]),
        (fn.valid_code, ["target_timeout"], ["Target", "x" * 65]),
        (fn.valid_digest, ["sha256:" + "0" * 64], ["sha256:" + "0" * 63, "SHA256:" + "0" * 64]),
    ],
)
def test_identifiers(spark, check, good, bad):
    df = spark.createDataFrame([(t,) for t in good + bad], "t STRING").select("t", check("t").alias("ok"))
    assert {r.t: r.ok for r in df.collect()} == {**{t: True for t in good}, **{t: False for t in bad}}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=40), st.randoms())
def test_exact_mean_ignores_order(spark, values, random):
    shuffled = list(values)
    random.shuffle(shuffled)
    means = [
        spark.createDataFrame([(x,) for x in v], "x DOUBLE").repartition(3).agg(fn.exact_mean("x").alias("m")).first().m
        for v in (values, shuffled)
    ]
    assert means[0] == means[1]
    assert means[0] == pytest.approx(sum(values) / len(values), abs=1e-6)


def test_means_of_any_size(spark):
    """Values from 1e-18 to 1e18 in several orders, against exact fractions."""
    import random
    from fractions import Fraction

    values = [1e-18, 3e-18, 1e-13, 3e-13, 2.5e-7, 0.1, 0.2, 123.456, 9.99e5, 1e6, 3.3e9, 1e14, 1.5e17, 1e18, -1e18, -1e14, -2.25e17]
    for chosen in (values, values[:4], values[:8], values[8:], [1e-13, 3e-13]):
        want = float(sum(map(Fraction, chosen)) / len(chosen))
        found = set()
        for seed in range(3):
            mixed = random.Random(seed).sample(chosen, len(chosen))
            frame = spark.createDataFrame([(x,) for x in mixed], "x DOUBLE").repartition(3)
            found.add(frame.agg(fn.exact_mean("x").alias("m")).first().m)
        assert len(found) == 1
        assert found.pop() == pytest.approx(want, rel=1e-12)

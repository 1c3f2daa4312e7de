from __future__ import annotations

import hashlib
import json
import shlex

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from runtally.functions import folds, scalars as s


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())) \
        if values else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


def signature(instance, process, params, chore=None):
    text = f"chore|{instance}|{chore}" if chore else f"{instance}|{process or ''}|{json.dumps(params, sort_keys=True) if params else '{}'}"
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def test_signature_equals_json_of_sorted_parameters(spark):
    cases = [
        ("srv", "p", {"b": "1", "a": "x y"}, None), ("srv", "p", {}, None), ("srv", None, None, None),
        ("srv", "p", {"q": 'a"b\\c', "n": "l1\nl2\t", "u": "é漢😀\x7f\x01"}, None), ("srv", "p", {"a": "1"}, "nightly"),
        ("srv", "nightly", {}, None), ("sérv", "p", {"clé": "v"}, None),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, instance string, process string, parameters map<string,string>, chore string")
    got = {r["i"]: r["x"] for r in df.select("i", s.task_signature("instance", "process", "parameters", "chore").alias("x")).collect()}
    assert got == {i: signature(*c) for i, c in enumerate(cases)}


def split(text):
    return shlex.split(text.replace("\\", "\\\\"), posix=True)


LINES = [
    'a=1 b="two words" c=3', "single='x y' z", 'dir="D:\\stock\\in_out\\"', "path=a\\b 'q\\r'", 'pre"mid dle"post=1 ""', "",
    '  tabs\tand  blanks ', '''mix="it's" 'say "hi"' ''', "x=" + "y" * 20000 + ' "' + "z " * 20000 + '"', "a=b=c =v",
]


@pytest.mark.parametrize("text", LINES)
def test_tokens_equal_shell_split(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(s.tokenize_line("t").alias("x"), s.quotes_balanced("t").alias("ok")).first()
    assert got["ok"] and got["x"] == split(text)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab=\\\"' \t\u00e9", max_size=14), min_size=1, max_size=30))
def test_tokens_equal_shell_split_on_random_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", s.tokenize_line("t").alias("x"), s.quotes_balanced("t").alias("ok")).collect():
        try:
            want = split(r["t"])
        except ValueError:
            assert not r["ok"]
            continue
        assert r["ok"] and r["x"] == want


@pytest.mark.parametrize("text,want", [
    ('{"pBatch": "40", "pQuiet": "on"}', {"pBatch": "40", "pQuiet": "on"}),
    ("pBatch=40 pQuiet=on", {"pBatch": "40", "pQuiet": "on"}),
    ('pLabel="north east"', {"pLabel": "north east"}),
    ('pRule="x:y=z"', {"pRule": "x:y=z"}),
    ("[1, 2]", {}), ('pBad="unclosed', {}), ('pDir="D:\\stock\\in_out\\"', {"pDir": "D:\\stock\\in_out\\"}),
    ('pCity*=*"{cities of A}"', {"pCity*": "*{cities of A}"}), ("", {}), ("a=1 a=2 b=3", {"a": "2", "b": "3"}), ("=x a=1", {"a": "1"}),
])
def test_parse_params(spark, text, want):
    assert one(spark, s.parse_params("t"), t=text) == want


@pytest.mark.parametrize("text,cube,line", [("TRUE", True, True), ("y", False, True), ("1", True, True), ("no", False, False), ("T", True, True)])
def test_parse_bool(spark, text, cube, line):
    assert one(spark, s.parse_bool("t"), t=text) is cube
    assert one(spark, s.parse_bool("t", line=True), t=text) is line


def test_predecessor_list(spark):
    for text, line, cube in [("1,2", ["1", "2"], ["1", "2"]), ("", [], []), ("0", [], ["0"]), ("0,1", [], ["0", "1"]), (" 1 , ,2", [" 1 ", " ", "2"], ["1", "2"])]:
        assert one(spark, s.predecessor_list("t"), t=text) == line
        assert one(spark, s.predecessor_list("t", cube=True), t=text) == cube


@pytest.mark.parametrize("text,ok", [("5", True), ("05", False), ("0", False), ("-1", False), ("x", False), ("10", True), ("", False), ("1.5", False)])
def test_positive_int_id(spark, text, ok):
    assert one(spark, s.positive_int_id("t"), t=text) is ok


@pytest.mark.parametrize("sec,text", [(45.2, "45.2s"), (60.0, "1m 0s"), (324.0, "5m 24s"), (90.5, "1m 30s"), (0.0, "0.0s")])
def test_format_duration(spark, sec, text):
    assert one(spark, s.format_duration("d"), d=sec) == text


@pytest.mark.parametrize("x,want", [(12.4, 10), (12.5, 10), (17.5, 20), (0.0, 5), (26.0, 25), (2.0, 5)])
def test_round_to_5(spark, x, want):
    assert one(spark, s.round_to_5("d"), d=x) == want


def test_names_and_contexts(spark):
    assert one(spark, s.safe_name("t"), t="daily etl/é-1_x") == "daily_etl_é-1_x"
    assert one(spark, s.session_context("t", F.lit(True)), t="w" * 80) == "SessionX_" + "w" * 55
    got = one(spark, s.parse_session_context("t"), t="SessionX_daily_etl")
    assert (got["exclusive"], got["workflow"]) == (True, "daily_etl")
    assert one(spark, s.parse_session_context("t"), t="Other_daily") is None


def test_render(spark):
    m = F.create_map(F.lit("k1"), F.lit("v1"), F.lit("k2"), F.lit("a b"))
    assert one(spark, s.render_params(m)) == 'k1="v1" k2="a b"'
    assert one(spark, s.render_param_sets(F.array(m, F.map_filter(m, lambda k, v: F.lit(False)), m))) == 'k1="v1" k2="a b"; k1="v1" k2="a b"'
    assert one(spark, s.short_label("t", 16, 16), t="x" * 17) == "x" * 16 + "..."


def test_natural_order(spark):
    ids = ["task10", "task2", "10", "9", "a", "task2b"]
    df = spark.createDataFrame([(i,) for i in ids], "t string").orderBy(s.natural_key("t"))
    assert [r["t"] for r in df.collect()] == ["9", "10", "a", "task2", "task2b", "task10"]


def test_natural_order_of_long_and_negative_numbers(spark):
    ids = ["a" + "1" * 31, "a" + "2" * 30, "a007", "a7", "9" * 45, "1" + "0" * 45, "-5", "-12", "0", "-" + "3" * 40, "", "03"]
    df = spark.createDataFrame([(i,) for i in ids], "t string").orderBy(s.natural_key("t"))
    assert [r["t"] for r in df.collect()] == ["-" + "3" * 40, "-12", "-5", "0", "9" * 45, "1" + "0" * 45, "", "03", "a007", "a7", "a" + "2" * 30, "a" + "1" * 31]


def fold(durations, alpha=0.3):
    e = durations[0]
    for d in durations[1:]:
        if e > 0 and d > e * 3:
            d = min(d, e * 2)
        e = alpha * d + (1 - alpha) * e
    return e


@pytest.mark.parametrize("d,alpha,want", [
    ([100.0], 0.3, 100), ([100.0, 50.0], 0.3, 85), ([100.0, 50.0], 0.5, 75), ([100.0, 400.0], 0.3, 130), ([10.0, 100.0], 0.3, 13), ([100.0, 10.0, 10.0], 0.3, 54.1)])
def test_ewma_values(spark, d, alpha, want):
    arr = F.array(*[F.lit(x) for x in d])
    assert one(spark, folds.ewma(arr, alpha)) == pytest.approx(want)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.floats(0, 1e4), min_size=1, max_size=10), min_size=1, max_size=20))
def test_ewma_equals_loop(spark, lists):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(lists)], "i int, d array<double>")
    for r in df.select("d", folds.ewma(F.col("d")).alias("e")).collect():
        assert r["e"] == pytest.approx(fold(r["d"]), rel=1e-12, abs=1e-12)


def test_confidence_values(spark):
    def conf(d):
        arr = F.array(*[F.lit(x) for x in d]) if d else F.array().cast("array<double>")
        return one(spark, folds.confidence(F.size(arr), folds.spread(folds.sample_std(arr), folds.mean(arr))))
    assert conf([]) == 0.0
    assert conf([100.0]) == pytest.approx(0.30)
    assert conf([100.0] * 10) == pytest.approx(1.0)

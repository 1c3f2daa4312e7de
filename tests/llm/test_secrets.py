"""Secrets against the given forms, planted random strings and ordinary text."""

from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings, strategies as st

from runtally.llm import secret_scan
from tests.llm.cases import awkward, empty, prose, token

FORMS = (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"))


def brute(text):
    found = []
    for k, (_, form) in enumerate(FORMS):
        for m in re.finditer(form, text, re.ASCII | (re.IGNORECASE if k == 0 else 0)):
            if (len(m[2]) >= 12) if k == 0 else len(m[0]) >= (18, 16)[k - 1]:
                found.append((m.start(), k, m.end()))
    return sorted(found)


PARTS = st.sampled_from(["token", "Secret", "API_KEY", "apikey", "passwd", '"', "'", " ", "  ", ":", "=", "==", "AKIA", "AKIAAKIA", "ABCDEFGHIJ0123456789",
                         "abcdef0123456789", "deadbeef", "xyz.-_/+", "short", "\n", "é🎉", "ſecret", "toKen"])


@settings(max_examples=500, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_fixed_forms(text):
    assert secret_scan.base_spans(text) == brute(text)


def planted():
    rows = [(i, prose(i, 200) + f" https://www.example.org/some/long/path/to-a-page/index_{i} " + prose(i + 500, 30), None) for i in range(120)]
    secrets = []
    for k in range(30):
        s = token(k, 40)
        secrets.append(s)
        rows.append((1000 + k, f"{prose(k, 20)} {s} {prose(k + 1, 20)}", s))
    return rows


def test_planted_strings_are_found_and_text_is_not(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string, secret string")
    got = {r["doc_id"]: r for r in secret_scan.scan(df).collect()}
    for key, text, secret in rows:
        more = [x for x in got[key]["spans"].split(",") if x.startswith("random")]
        if secret is None:
            assert not more, (text, more)
    found = sum(any(text[int(a):int(b)] == secret for _, a, b in (x.split(":") for x in got[key]["spans"].split(",") if x)) for key, text, secret in rows if secret)
    assert found >= 27


def test_spans_and_digest(spark):
    df = awkward(spark, "spans n_hex key").unionByName(spark.createDataFrame([(50, f'Token = "{token(1, 30)}" and AKIA{token(2, 16).upper()} or {"0123456789abcdef" * 2}', "en", "s", 1, "x", "x", "x")], df_schema(spark)))
    learned = secret_scan.learn(df)
    rows = secret_scan.scan(df, learned=learned).collect()
    texts = [r["text"] or "" for r in df.collect()]
    assert len(rows) == len(texts)
    want = sorted(hashlib.sha256(secret_scan.joined(brute(t)).encode()).hexdigest() for t in texts)
    assert sorted(r["base_sha256"] for r in rows) == want
    one = next(r for r in rows if r["doc_id"] == 50)
    assert (one["n_assign"], one["n_access"], one["n_hex"]) == (1, 1, 1)
    masked = {r["doc_id"]: r for r in secret_scan.redact(df, learned=learned).collect()}
    assert masked[50]["text"] == '[secret]" and [secret] or [secret]' and masked[50]["n_chars"] == len(masked[50]["text"])
    assert masked[3]["text"] is None and masked[1]["text"] == prose(1)
    assert secret_scan.redact(df, learned=learned).schema == df.schema
    assert secret_scan.scan(empty(spark)).count() == 0 and secret_scan.redact(empty(spark)).count() == 0


def df_schema(spark):
    return awkward(spark, "spans n_hex key").schema


def test_secrets_behind_names_and_paths(spark):
    rows = [r[:2] for r in planted()]
    forms = ("auth={}", "?sig={}&x=1", "AWS_SECRET_ACCESS_KEY={}", "== {}", "my-site/some_path/{}", "assets/img/{}", "client_key-v2/{}")
    hidden = {5000 + 100 * f + k: (form, token(5000 + 100 * f + k, 40)) for f, form in enumerate(forms) for k in range(15)}
    rows += [(i, f"{prose(i, 20)} {form.format(s)} {prose(i + 1, 20)}") for i, (form, s) in hidden.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    learned = secret_scan.learn(df)
    masked = {r["doc_id"]: r["text"] for r in secret_scan.redact(df, learned=learned).collect()}
    for form in forms:
        gone = [s not in masked[i] for i, (f, s) in hidden.items() if f == form]
        assert sum(gone) >= 13, (form, sum(gone))
    for i, text in rows[:120]:
        assert masked[i] == text


def test_parts_of_a_run():
    text = "auth=" + "a" * 20 + " b_c/" + "D" * 20 + " " + "e" * 19 + "/f"
    assert [text[a:b] for a, b in secret_scan.candidates(text)] == ["a" * 20, "b_c/" + "D" * 20, "c/" + "D" * 20, "D" * 20, "e" * 19 + "/f"]


class _Any(dict):
    def get(self, key, default=None):
        return 0


def plain_spans(scan, text):
    """Every hit held against every span of the fixed forms."""
    base, more = secret_scan.base_spans(text), []
    hits = [(a, b, n) for a, b, n, _, _ in secret_scan.tested(text, scan.ordinary)]
    for start, end, name in sorted(hits, key=lambda x: (x[0], -x[1])):
        if not any(a <= start and end <= b for a, _, b in [*base, *more[-1:]]):
            more.append((start, f"random_{name}", end))
    return base, more


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([token(1, 20), token(2, 24, "0123456789abcdef"), "AKIA" + token(3, 20, "ABCDEF0123456789"), "password=" + token(4, 30), "a/b_c-" + token(5, 30), "x", "key: ", "=", "/"]), max_size=25),
       st.sampled_from(["", " ", "/", "="]))
def test_spans_in_one_pass_equal_all_comparisons(parts, between):
    scan = secret_scan.Scan(secret_scan.Ordinary(tuple([1] * 128)), _Any())
    text = between.join(parts)
    assert scan.spans(text) == plain_spans(scan, text)


def test_a_long_text_with_many_spans_takes_linear_time():
    import time

    scan = secret_scan.Scan(secret_scan.Ordinary(tuple([1] * 128)), _Any())
    took = []
    for n in (1000, 4000):
        text = " ".join(token(i, 24, "0123456789abcdef") + " " + token(i, 22) for i in range(n))
        t = time.process_time()
        base, more = scan.spans(text)
        took.append(time.process_time() - t)
        assert len(base) >= n and len(more) >= 0.9 * n
    assert took[1] < 8 * took[0]

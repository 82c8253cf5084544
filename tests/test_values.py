import re

import pytest
from pyspark.sql import functions as F

from recordmill.functions import values as V


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, hidden",
    [
        ("Bearer abcdefgh12345", True),
        ("Authorization: Basic dXNlcjpwYXNz", True),
        ("https://user:secret@example.org/x", True),
        ("ghp_abcdefghijkl", True),
        ("password = hunter22", True),
        ('"api_key": "abc def"', True),
        ("-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", True),
        ("nothing to see", False),
        ("compassword=x", False),
    ],
)
def test_redaction(spark, text, hidden):
    assert ("[REDACTED]" in one(spark, V.redact(F.lit(text)))) == hidden


def test_redaction_agrees_with_python(spark, sf_dir):
    pattern = re.compile(V.SECRET)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", V.redact(F.col("text")).alias("out")).collect()
    assert all(pattern.sub("[REDACTED]", r.text) == r.out for r in rows)


@pytest.mark.parametrize("text, seconds", [("1h30m", 5400.0), ("250ms", 0.25), ("1.5d", 129600.0), ("0s", None), ("101y", None), ("1h 2m", None), ("", None), ("5", None)])
def test_durations(spark, text, seconds):
    assert one(spark, V.duration_seconds(F.lit(text))) == seconds


@pytest.mark.parametrize(
    "text, key",
    [("2026-01-02", "2026-01-02T23:59:59.999999Z"), ("2026-01-02T03:04:05+02:00", "2026-01-02T01:04:05.000000Z"), ("2026-01-02T03:04:05", "2026-01-02T03:04:05"), ("2026-02-30", "2026-02-30"), ("soon", "soon")],
)
def test_time_keys(spark, text, key):
    assert one(spark, V.ts_key(F.lit(text))) == key


@pytest.mark.parametrize("path, private", [(".git/config", True), ("a/.ENV", True), ("a/.env.local", True), ("a/.env.example", False), ("logs/x", True), ("", True), ("projects/a.md", False)])
def test_private_paths(spark, path, private):
    assert one(spark, V.is_private(F.lit(path))) == private


@pytest.mark.parametrize("seconds, span", [(0.25, "250ms"), (59.0, "59s"), (3600.0, "1h"), (3725.0, "1h2m"), (694861.0, "1w1d"), (0.0, "0ms")])
def test_spans(spark, seconds, span):
    assert one(spark, V.format_span(F.lit(seconds))) == span


@pytest.mark.parametrize("text, limit, kept", [("abc", 2, "ab"), ("éé", 3, "é"), ("abc", 3, "abc"), ("aé", 2, "a"), ("", 1, "")])
def test_byte_budget(spark, text, limit, kept):
    assert one(spark, V.cut_to_bytes(F.lit(text), limit)) == kept


def test_record_paths(spark):
    assert one(spark, V.record_path(F.lit("jira"), F.lit("decision-1"))).startswith("memories/jira/")
    for source, name in (("notes", "x"), ("Jira", "x"), ("jira", "a b"), ("jira", "")):
        assert one(spark, V.record_path(F.lit(source), F.lit(name))) is None


def test_invisible_characters(spark):
    chars = ["\u0600", "\u06dd", "\u070f", "\u0890", "\u08e2", "\U000110bd", "\U00013430", "\U0001bca0", "\U0001d173", "\U000e0001", "\U000e0020", "\u200b"]
    df = spark.createDataFrame([(c,) for c in [*chars, "a", "\u00e9", "\U0001f600"]], "c string")
    found = {r.c: r for r in df.select("c", V.has_invisible(F.col("c")).alias("hidden"), V.record_path(F.lit("src"), F.col("c")).alias("path"), V.escape_invisible(F.concat(F.lit("x"), "c")).alias("shown")).collect()}
    assert {c for c, r in found.items() if r.hidden} == set(chars) == {c for c, r in found.items() if r.path is None}
    assert found["\u0600"].shown == "x\\u0600" and found["\U000e0001"].shown == "x\\udb40\\udc01" and found["\U0001f600"].shown == "x\U0001f600"


def test_attribute_lists_and_queries(spark):
    df = spark.createDataFrame([("{: a=1 b=\"two words\" c='x' a=2}", "u?a=1%20b&c=d+e#f"), ("{x}", "u?a=1&a=2"), (None, None)], "a string, u string")
    found = df.select(V.attribute_map(F.col("a")).alias("a"), V.query_map(F.col("u")).alias("u")).collect()
    assert found[0].a == {"a": "2", "b": "two words", "c": "x"} and found[0].u == {"a": "1 b", "c": "d e"}
    assert found[1].a == {} and found[1].u is None and found[2].u is None


def test_redaction_goes_deep():
    found = V.redact_variant({"a": [{"password": ["x", 1]}, "api_key=abcdefgh"], "Proxy-Authorization": "y", "n": 1})
    assert found == {"a": [{"password": ["x", 1]}, "[REDACTED]"], "Proxy-Authorization": "[REDACTED]", "n": 1}


def test_iso_times_in_all_forms(spark):
    """Forms with and without separators, minutes and seconds, with long fractions and commas; not those without a zone."""
    cases = {
        "2026-11-15T12+02": "2026-11-15T10:00:00Z", "20261115T120000Z": "2026-11-15T12:00:00Z", "2026-11-15 12:00:00.1234567+00:00": "2026-11-15T12:00:00Z", "2026-11-15T12:00:00,5Z": "2026-11-15T12:00:00Z",
        "2026-11-15T23:59-0130": "2026-11-16T01:29:00Z", "20261115T1200+02": "2026-11-15T10:00:00Z", "2026-11-15T12:00:00": None, "2026-13-15T12:00Z": None, "2026-11-15": None, "2026-1115T12Z": None, "x": None,
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert [r for r in df.select("t", "want", V.normalize_time(F.col("t")).alias("got")).collect() if r.got != r.want] == []


def test_only_text_under_secret_names_is_hidden(spark):
    value = {"api_key": "abc", "password": "", "token": None, "secret": 5, "client_secret": {"id": "x", "api_key": "y"}, "tokens": 1, "api_keys": ["a"], "passwords": [], "access_token": ["a", "b"], "auth_token": ["a", 1], "name": "n"}
    found = V.redact_variant(value)
    assert found["api_key"] == "[REDACTED]" and found["password"] == "" and found["token"] is None and found["secret"] == 5
    assert found["client_secret"] == {"id": "x", "api_key": "[REDACTED]"} and found["access_token"] == ["[REDACTED]"] * 2 and found["auth_token"] == ["a", 1] and found["name"] == "n"
    kv = spark.createDataFrame([({"api_key": "k", "password": "", "name": "n"},)], "kv map<string,string>").select(V.redact_map(F.col("kv")).alias("kv")).first()["kv"]
    assert kv == {"api_key": "[REDACTED]", "password": "", "name": "n"}


def test_lines_end_as_in_files(spark):
    cases = {"a\nb\n": ["a", "b"], "a\r\nb\rc": ["a", "b", "c"], "": [], "\n": [""], "a\n\n": ["a", ""], "a\x0bb c": ["a", "b", "c"], "x": ["x"]}
    df = spark.createDataFrame(list(cases.items()), "t string, want array<string>")
    assert [r for r in df.select("t", "want", V.lines(F.col("t")).alias("got")).collect() if list(r.got) != list(r.want)] == []
    assert spark.createDataFrame([("a\nb\n",)], "t string").select(V.line_slice(F.col("t"), 2, 3)).first()[0] == "b"


def test_bad_tags_are_a_problem(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), (["a b", "c"],), (["x/y"],), ([""],), ([],)], "t array<string>")
    found = [(list(r.sound), r.problem is None) for r in df.select(V.tags(F.col("t")).alias("sound"), V.tags_problem(F.col("t")).alias("problem")).collect()]
    assert found == [(["a", "b"], True), (["c"], False), ([], False), ([], False), ([], True)]


def test_dates_are_ahead_from_tomorrow_on(spark):
    from recordmill.operators import graph, review

    df = spark.createDataFrame([("2026-11-15",), ("2026-11-16",), ("2026-11-15T12:00:01Z",), ("2026-11-15T14:00:00+02:00",), (None,)], "t string")
    assert [r[0] for r in df.select(review.is_future(F.col("t"), "2026-11-15T12:00:00Z")).collect()] == [False, True, True, False, False]
    links = spark.createDataFrame([("n", "a", "note", "", "", {"w": "1"}), ("n", "a", "note", "", "", {"w": "2"}), ("n", "a", "note", "", "", {}), ("n", "b", "note", "", "", {}), ("n", "b", "note", "", "", {}), ("m", "a", "note", "", "", {})], "ref string, to string, kind string, anchor string, section string, meta map<string,string>")
    found = sorted((r.ref, r.to, str(r.meta)) for r in graph.typed_dominate(links).collect())
    assert found == [("m", "a", "{}"), ("n", "a", "{'w': '1'}"), ("n", "a", "{'w': '2'}"), ("n", "b", "{}"), ("n", "b", "{}")]


def test_batches_say_what_they_lack():
    from recordmill.sources.records import parse_batch

    for text, lacks in (('{"records": [], "incomplete": {"missed": 0}}', None), ('{"records": [], "incomplete": null, "note": 1}', None), ('{"records": [], "incomplete": {"missed": 3}}', 3), ('{"records": [], "incomplete": true}', -1), ('{"records": [], "incomplete": false}', None)):
        assert parse_batch(text.encode()) == ([], lacks)

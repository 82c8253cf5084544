import pytest
from pyspark.sql import functions as F

from recordmill.operators import events, graph, ingest, review, schemas, search
from recordmill.sources import records


@pytest.mark.parametrize(
    "data, found",
    [
        (b"", ([], None)),
        (b"\xef\xbb\xbf[]", ([], None)),
        (b'[{"id": 1}]', ([{"id": 1}], None)),
        (b'{"id": 1}', ([{"id": 1}], None)),
        (b'{"id": 1}\n{"id": 2}\n', ([{"id": 1}, {"id": 2}], None)),
        (b'{"records": [], "incomplete": {"missed": 3}}', ([], 3)),
        (b'{"records": [{}], "incomplete": true}', ([{}], -1)),
    ],
)
def test_batches(data, found):
    assert records.parse_batch(data) == found


@pytest.mark.parametrize("data", [b"\xff", b"[1]", b'{"a": 1, "a": 2}', b"[NaN]", b'{"records": [], "incomplete": {"missed": -1}}', b'{"records": [], "incomplete": 1}', b"{"])
def test_bad_batches(data):
    with pytest.raises(records.InputError):
        records.parse_batch(data)


def test_diff_sequence(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "id string, sha string, source string") if r else spark.createDataFrame([], "id string, sha string, source string")
    stored = rows(("a", "1", "s"), ("b", "2", "s"), ("c", "3", "s"))
    batch = rows(("a", "1", "s"), ("b", "9", "s"), ("d", "4", "s"), ("e", "5", "s"))
    gone = spark.createDataFrame([("c",), ("e",)], "id string")
    actions = {r.id: r.action for r in ingest.diff(batch, stored, gone).collect()}
    assert actions == {"a": "unchanged", "b": "updated", "c": "removed", "d": "added", "e": "forgotten"}
    snapshot = ingest.diff(batch, stored, None, "snapshot")
    assert {r.id: r.action for r in snapshot.collect()}["c"] == "removed"
    partial = ingest.diff(batch, stored, None, "snapshot", complete=False)
    assert {r.id: r.action for r in partial.collect()}["c"] == "kept"
    log = f"{tmp_path}/log"
    ingest.commit(stored, ingest.diff(stored, rows()), log, 1)
    ingest.commit(batch, snapshot, log, 2)
    assert spark.read.parquet(f"{log}/batch=2").count() == 4  # a is not written again
    assert {r.id: r.sha for r in ingest.current(spark.read.parquet(log)).collect()} == {"a": "1", "b": "9", "d": "4", "e": "5"}
    ingest.compact(spark.read.parquet(log), f"{tmp_path}/small")
    ingest.commit(rows(("a", "7", "s")), ingest.diff(rows(("a", "7", "s")), ingest.current(spark.read.parquet(f"{tmp_path}/small"))), f"{tmp_path}/small", 1)
    assert {r.id: r.sha for r in ingest.current(spark.read.parquet(f"{tmp_path}/small")).collect()} == {"a": "7", "b": "9", "d": "4", "e": "5"}
    with pytest.raises(records.InputError):
        ingest.commit(rows(), ingest.diff(rows(), stored, None, "snapshot"), log, 3)


@pytest.mark.parametrize("existing, removed, blocked", [(10, 6, True), (10, 5, False), (9, 8, False), (3, 3, True)])
def test_guard(spark, existing, removed, blocked):
    stored = spark.range(existing).select(F.col("id").cast("string"), F.lit("x").alias("sha"))
    batch = stored.where(F.col("id").cast("int") >= removed)
    assert ingest.guard(ingest.diff(batch, stored, None, "snapshot")).first()["blocked"] == blocked


def test_patterns(spark):
    df = spark.createDataFrame([("Été",), ("plain",)], "text string")
    assert df.where(search.pattern_column("été", F.col("text"))).count() == 1
    for bad in ("(?=x)", r"(a)\1"):
        with pytest.raises(records.InputError):
            search.pattern_column(bad, F.col("text"))
    with pytest.raises(records.InputError):
        search.Query(limit=0).page(df.withColumn("path", F.lit("")).withColumn("source", F.lit("")), "text")


def test_walk_positions(spark):
    paths = ["b/c", "a/b", "a-x/b", "a/b/c", "a"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    found = records.with_positions(df, F.split("path", "/")).orderBy("pos").collect()
    assert [r.path for r in found] == sorted(paths, key=lambda p: p.split("/")) and [r.pos for r in found] == [1, 2, 3, 4, 5]


def test_read_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.json").write_text('{"id": "1"}')
    (tmp_path / "src" / "b.json").write_text('{"id": 1, "id": 2}')
    (tmp_path / "src" / "c.txt").write_text("x")
    found = {r.path: r.problem for r in records.parsed(records.read_tree(spark, str(tmp_path))).collect()}
    assert found == {"src/a.json": None, "src/b.json": "not strict JSON"}


def test_files_are_whole_or_absent(tmp_path):
    place = tmp_path / "a" / "x.json"
    place.parent.mkdir()
    records.replace_file(place, b"one")
    records.replace_file(place, b"two")
    assert place.read_bytes() == b"two" and [p.name for p in place.parent.iterdir()] == ["x.json"]
    assert records.delete_file(place) and not records.delete_file(place)


def test_scan_limits(spark, tmp_path):
    root = tmp_path / "n" / "store" / "n" / "store"  # the root's name comes again below
    (root / "n").mkdir(parents=True)
    (root / "n" / "a.json").write_text("{}")
    (root / "big.json").write_text("x" * 100)
    found = {r.path: r.text for r in records.read_tree(spark, str(tmp_path / "n" / "store"), most_bytes=50).collect()}
    assert found == {"n/store/n/a.json": "{}", "n/store/big.json": None}
    with pytest.raises(records.InputError):
        records.checked_count(records.list_tree(spark, str(tmp_path), "json"), 1)


def test_batches_and_canonical_lines(spark):
    df = spark.createDataFrame([(1, '{"records": [{"b": 1, "a": "\u00e9"}], "incomplete": true}'), (2, "[1]"), (3, None), (4, '{"a":1}\n{"a":2}')], "k long, batch string")
    found = sorted(records.batches_of(df, "batch", "k").collect(), key=lambda r: (r.k, r.record or ""))
    assert [(r.k, r.record, r.missing, r.problem is None) for r in found] == [(1, '{"a":"\u00e9","b":1}', -1, True), (2, None, None, False), (4, '{"a":1}', None, True), (4, '{"a":2}', None, True)]
    lines = records.canonical_lines(df, "batch").collect()
    assert [r.line for r in lines] == ['{"incomplete":true,"records":[{"a":"\u00e9","b":1}]}\n', "[1]\n", None, None]


def test_responses_fit():
    response = {"ref": "r", "kind": "k", "title": "t", "text": "word " * 100, "links": ["x"] * 50, "other": 1}
    for limit in (400, 150, 60, 30):
        out = search.within_bytes(response, limit)
        assert len(records.canonical(out).encode()) <= limit and out["truncated"]
    assert search.within_bytes(response, 10_000) == response and "text" in search.within_bytes(response, 700) and search.within_bytes(response, 700)["links"]
    assert set(search.within_bytes(response, 60)) == {"truncated", "ref", "kind", "title"}
    with pytest.raises(records.InputError):
        search.within_bytes(response, 5)


def test_scopes(spark):
    paths = ["memories/src1/a.json", "memories/src1/b.json", "memories/src10/a.json", "concepts/n.md", "concepts/deep/n.md", "actions/x/ACTION.md"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    scope = lambda s: sorted(r.path for r in search.in_scope(df, s).collect())
    assert scope("src1") == scope("memories/src1/") == paths[:2] and scope("memories/src1/a") == scope("memories/src1/a.json") == paths[:1]
    assert scope("concepts/n.md") == ["concepts/n.md"] and scope("concepts") == ["concepts/deep/n.md", "concepts/n.md"] and scope("concepts/deep") == ["concepts/deep/n.md"]
    assert scope("src") == [] and len(scope("")) == len(scope(None)) == 6 and len(scope("memories")) == 3
    for bad in ("/x", "a/../b", "a//b", "a\\b"):
        with pytest.raises(records.InputError):
            scope(bad)


def test_schemas_with_references(spark):
    df = spark.createDataFrame([(1, "a@b", 4, ("x",)), (2, "nobody", 3, (None,))], "id int, mail string, n int, inner struct<k:string>")
    shape = {"$defs": {"even": {"multipleOf": 2}}, "properties": {"mail": {"format": "email"}, "n": {"$ref": "#/$defs/even"}, "inner": {"required": ["k"], "properties": {"k": {"const": "x"}}}, "id": {"if": {"minimum": 2}, "then": {"maximum": 1}, "oneOf": [{"maximum": 1}, {"minimum": 2}]}}}
    assert {r.id: r.problems for r in schemas.violations(df, shape, "id").collect()} == {2: "id: then; inner: required k; mail: format; n: multipleOf"}
    with pytest.raises(schemas.SchemaError):
        schemas.violations(df, {"$defs": {"a": {"$ref": "#/$defs/a"}}, "properties": {"id": {"$ref": "#/$defs/a"}}}, "id")


NOW = "2026-11-15T12:00:00.000000Z"


@pytest.mark.parametrize(
    "updated, stale_after, due",
    [
        ("2026-10-01", "14d", True),
        ("2026-12-01", "2026-01-01T00:00:00Z", True),
        ("2026-11-15T06:00:00Z", "12h", False),
        ("2026-11-15", "9999y", False),
        ("2026-11-15T13:30:00+02:00", "15m", True),
        (None, "7d", True),
        ("2026-11-01", "14", True),
        ("2026-11-02", "14", False),
        ("2026-11-01", "2026-12-01", False),
    ],
)
def test_due(spark, updated, stale_after, due):
    df = spark.createDataFrame([(updated, stale_after)], "u string, s string")
    assert df.select(review.is_due(F.col("u"), F.col("s"), NOW).alias("v")).first()["v"] == due


def test_review(spark):
    notes = spark.createDataFrame([("p", "draft", "2026-10-01", "14d"), ("q", "deprecated", "2026-01-01", "1d"), ("r", "draft", "2026-12-01", None)], "ref string, status string, updated string, stale_after string")
    links = graph.both_ways(spark.createDataFrame([("p", "m1"), ("m2", "p"), ("p", "p"), ("q", "m1")], "ref string, to string"))
    others = spark.createDataFrame([("m1", "2026-10-02T00:00:00.000000Z"), ("m2", "2026-10-01T23:59:59.999999Z")], "ref string, ts string")
    found = {r.ref: (list(r.reasons), r.newer_count) for r in review.stale(notes, links, others, NOW).collect()}
    assert found == {"p": (["due", "newer_evidence"], 1), "r": (["future_updated"], 0)}


def test_schema_keywords(spark):
    df = spark.createDataFrame([("a", ["x", "x"], 5), ("toolong", [], None)], "id string, tags array<string>, n int")
    shape = {"properties": {"id": {"maxLength": 3}, "tags": {"uniqueItems": True, "minItems": 1}, "n": {"anyOf": [{"minimum": 10}, {"maximum": 3}]}}, "required": ["n", "title"], "additionalProperties": False}
    found = {r.id: r.problems for r in schemas.violations(df, shape, "id").collect()}
    assert found == {"a": "n: anyOf; tags: uniqueItems; title: required", "toolong": "id: maxLength; n: required; tags: minItems; title: required"}
    with pytest.raises(schemas.SchemaError):
        schemas.violations(df, {"properties": {"id": {"format": "x"}}}, "id")


def test_cursors_and_backoff(spark):
    df = spark.range(1, 6).withColumnRenamed("id", "seq")
    assert events.after_cursor(df, 3).count() == 2
    assert events.after_cursor(df, 9).count() == 5
    assert events.after_cursor(df.where("seq > 9"), 3).count() == 0
    waits = spark.range(0, 13).select(events.backoff_seconds(F.col("id"), 3600).alias("w")).collect()
    assert [r.w for r in waits][:8] == [0, 60, 120, 240, 480, 960, 1920, 3600]


def test_further_schema_errors_are_counted(spark):
    df = spark.createDataFrame([(1, None, None)], "id int, a string, b string")
    shape = {"required": list("abcdefg")}
    found = schemas.violations(df, shape, "id").first().problems
    assert found == "a: required; b: required; c: required; d: required; e: required; and 2 more schema errors"

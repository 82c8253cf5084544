import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recordmill.functions import cron, links
from recordmill.sources import notes, pages

NOTE = """---
type: decision
status: draft
tags: [x, y, x]
links: [bf:///concepts/other]
---
# Top {#top owner=me}

See [other](../concepts/other.md?role=a#part) and <https://example.org>. `[no](x.md)`

- [ ] call {: #t1 due=soon}
- [x] done

```
# not a heading [no](y.md)
```

Sub
---

Marked text {: #p1 k="v w"}

# Sub
"""


def compiled(spark, path, text, own=""):
    return notes.compile_notes(spark.createDataFrame([(path, text)], "path string, text string"), own=own).first()


def test_note(spark):
    found = compiled(spark, "projects/plan.md", NOTE)
    assert found["problem"] is None and found["ref"] == found["path"] == "projects/plan.md"
    assert (found["title"], found["tags"], found["kind"]) == ("Top", ["x", "y"], "project")
    assert [(h["id"], h["level"], h["meta"]) for h in found["headings"]] == [("top", 1, {"owner": "me"}), ("sub", 2, {}), ("sub_1", 1, {})]
    assert [(x["to"], x["kind"], x["anchor"], x["section"], x["meta"]) for x in found["links"]] == [
        ("concepts/other.md", "note", "", "", {}),
        ("concepts/other.md", "note", "part", "top", {"role": "a"}),
        ("https://example.org", "url", "", "top", {}),
    ]
    assert [(t["id"], t["text"], t["done"], t["section"], t["meta"]) for t in found["tasks"]] == [("t1", "call", False, "top", {"due": "soon"}), (None, "done", True, "top", {})]
    assert [tuple(e) for e in found["elements"]] == [("p", "p1", "Marked text", "sub", {"k": "v w"})]
    assert found["attrs"]["top"] == {"owner": "me"} and found["attrs"]["p1"] == {"k": "v w"}
    assert found["text"].split("\n") == ["Top", "See other and https://example.org. [no](x.md)", "[ ] call", "[x] done", "# not a heading [no](y.md)", "Sub", "Marked text", "Sub"]


def test_note_fields(spark):
    text = "---\nstale_after: 14\nentity: urn:x:1\naliases: [yes, 010]\nlinks: [{to: 'bf:///concepts/a', meta: {rel: b}}]\nsources: [{resource: 'jira:W-1', retrieved: 2026-01-01}]\nmore: {b: 0o17, a: no}\n---\nText with [a](a.md?x=1){x=1 y=2}\n"
    found = compiled(spark, "actions/pay-bill/ACTION.md", text)
    assert (found["problem"], found["title"], found["kind"], found["source"]) == (None, "pay bill", "action", "actions")
    assert (found["stale_after"], found["entity"], found["aliases"]) == ("14", "urn:x:1", ["yes", "10"])
    assert [(x["to"], x["meta"]) for x in found["links"]][::2] == [("concepts/a.md", {"rel": "b"}), ("actions/pay-bill/a.md", {"x": "1", "y": "2"})]
    assert found["links"][1]["kind"] == "record" and found["links"][1]["meta"] == {"rel": "cites"}
    assert found["extra"] == '{"more": {"a": "no", "b": 15}}' and found["sources"][0]["retrieved"] == "2026-01-01"


def test_link_metadata_that_conflicts(spark):
    assert "conflicting" in compiled(spark, "projects/a.md", "[a](b.md?x=1){x=2}")["problem"]
    again = compiled(spark, "projects/a.md", "[a](b.md) [b](b.md) [c](b.md){k=v}")
    assert [x["meta"] for x in again["links"]] == [{}, {"k": "v"}]


def test_sections(spark):
    rows = spark.createDataFrame([("projects/a.md", "---\ntype: x\n---\nbefore\n# A {#a}\none\n```\n# no\n```\n## B\ntwo\n\nC\n=\nthree")], "path string, text string")
    found = notes.compile_notes(rows).join(rows.select(F.col("path").alias("ref"), F.col("text").alias("source_text")), "ref")
    assert {r.anchor: r.text for r in notes.sections(found).collect()} == {"a": "one\n```\n# no\n```\n## B\ntwo", "b": "two", "c": "three"}
    assert notes.at_anchor(found, "b").first()["what"] == "section" and notes.at_anchor(found, "none").count() == 0


@pytest.mark.parametrize("block", ["a: &x 1\nb: *x", "a: 1\na: 2", "1: x", "a: .nan", "a: " + "[" * 40 + "]" * 40, "ref: mine", "relations: []", "links: x", "title: [a]"])
def test_bad_front_matter(block):
    assert notes.compile_note("projects/a.md", f"---\n{block}\n---\n")["problem"]


def test_core_scalars():
    found = notes.yaml_map("a: yes\nb: True\nc: 0x1F\nd: 1e3\ne: ~\nf: 012\ng: 2026-01-01\nh: 1_000")
    assert found == {"a": "yes", "b": True, "c": 31, "d": 1000.0, "e": None, "f": 12, "g": "2026-01-01", "h": "1_000"}


@pytest.mark.parametrize("path, text", [("x.md", "a"), ("projects/a.md", "---\na: 1\na: 2\n---\n"), ("projects/a.md", "<<<<<<< ours\n"), ("projects/a.md", "# A {#a}\n# B {#a}\n"), ("projects/a.md", "[x](javascript:y)")])
def test_bad_notes(spark, path, text):
    assert compiled(spark, path, text)["problem"]


def normal(spark, origin, raw, own=""):
    return links.normalize_links(spark.createDataFrame([(origin, raw)], "origin string, raw string"), "origin", "raw", own).first()


@pytest.mark.parametrize(
    "raw, to, kind",
    [
        ("https://a.b/c?d#e", "https://a.b/c?d#e", "url"),
        ("other.md", "projects/other.md", "note"),
        ("../concepts/x", "concepts/x.md", "note"),
        ("concepts/x.md", "concepts/x.md", "note"),
        ("#here", "projects/me.md", "note"),
        ("bf:///actions/do/ACTION.md", "actions/do/ACTION.md", "note"),
        ("bf://sib/projects/y", "bf://sib/projects/y.md", "brain"),
        ("actions/do-it", "actions/do-it/ACTION.md", "note"),
        ("../actions/do-it#x", "actions/do-it/ACTION.md", "note"),
        ("a%20b.md", None, None),
        ("a+b%C3%A9.md", "projects/a+b\u00e9.md", "note"),
        ("./sub/../x.md", "projects/x.md", "note"),
        ("memories/src1/abc.json", "memories/src1/abc.json", "record"),
        ("bf://own/projects/y", "projects/y.md", "note"),
    ],
)
def test_links(spark, raw, to, kind):
    found = normal(spark, "projects/me.md", raw, "own")
    assert (found["to"], found["kind"], found["problem"] is None) == (to, kind, to is not None)


def test_record_links(spark):
    found = normal(spark, "projects/me.md", "jira:WEB-9?role=cause+a%20b#x")
    assert found["kind"] == "record" and found["meta"] == {"role": "cause a b"} and found["anchor"] == "x"
    assert found["to"] == normal(spark, "projects/me.md", "bf:///jira:WEB-9")["to"] == f"memories/jira/{hashlib.sha256(b'WEB-9').hexdigest()}.json"
    web = normal(spark, "projects/me.md", "web:https://a.b/c?d=1")
    assert web["to"] == f"memories/web/{hashlib.sha256(b'https://a.b/c?d=1').hexdigest()}.json" and web["meta"] == {}
    assert normal(spark, "projects/me.md", "bf:///web:https://a.b/c?d=1")["to"] == web["to"]


BAD = ["", None, "javascript:x", "../../x.md", "/abs.md", "a b.md", "x.md#", "notes:x", "bf://projects/x", "logs/x.md", "bf:///%zz", "x.md?a=1&a=2", "x.md?a", "x.md?1=2", "x.md?a=%20", ".git/config", "bf:x", "Jira:x", "jira:", "a%00.md", "a\u0600.md", "x%FF.md", "bf:///a/../b.md", "concepts/../x.md", "x" * 8193]


@pytest.mark.parametrize("raw", BAD)
def test_bad_links(spark, raw):
    found = normal(spark, "a.md" if (raw or "").startswith(("logs", ".git")) else "projects/me.md", raw)
    assert found["problem"] and found["to"] is None


@pytest.mark.parametrize(
    "expression, when, fired",
    [
        ("*/15 * * * *", datetime(2026, 1, 1, 0, 7), datetime(2026, 1, 1)),
        ("0 9 * * mon-fri", datetime(2026, 11, 15, 12), datetime(2026, 11, 13, 9)),
        ("@monthly", datetime(2026, 11, 1), datetime(2026, 10, 1)),
        ("0 0 29 2 *", datetime(2026, 3, 1), datetime(2024, 2, 29)),
        ("0 0 13 * 5", datetime(2026, 11, 14), datetime(2026, 11, 13)),
        ("0 0 31 2 *", datetime(2026, 3, 1), None),
    ],
)
def test_cron(expression, when, fired):
    assert cron.previous(expression, when) == fired


@pytest.mark.parametrize("expression", ["*/15 * * * *", "0 9 * * mon-fri", "@monthly", "0 0 29 2 *", "0 0 13 * 5", "30 2 * * *"])
def test_cron_as_a_plan(spark, expression):
    from datetime import timedelta
    from zoneinfo import ZoneInfo

    times = [datetime(2026, 3, 28) + timedelta(hours=5 * k, minutes=7 * k) for k in range(30)] + [datetime(2026, 10, 25, 0, 30), datetime(2026, 1, 1)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id int, ts timestamp_ntz").withColumn("ts", F.col("ts").cast("timestamp"))
    for zone in ("UTC", "Europe/Berlin", "Asia/Kolkata"):
        found = {r.id: r.fired for r in cron.with_previous(df, expression, F.col("ts"), zone).collect()}
        local = [t.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(zone)).replace(tzinfo=None) for t in times]
        assert found == {i: cron.previous(expression, t) for i, t in enumerate(local)}


@pytest.mark.parametrize("expression", ["* * * *", "60 * * * *", "a * * * *", "5-1 * * * *"])
def test_bad_cron(expression):
    with pytest.raises(ValueError):
        cron.parse(expression)


def test_visible_text(spark):
    cases = {
        "<h1>A &amp; B</h1><script>x</script><p>c<br>d <b>e</p>": "A & B\nc\nd e",
        None: "",
        "": "",
        "<p title='a>b'>x</p><P>y<p-x>z": "x\nyz",
        "a<script>if (1 < 2) '</p>'</script >b<style>p{}": "ab",
        "<!-- <p>no</p> -->yes<!DOCTYPE html><br/>1 < 2 &lt;b&gt;": "yes\n1 < 2 <b>",
        "&eacute;&#233;&#xE9;&#128;&#x1F600;&nope; &amp;lt; & AT&T &copy;": "\u00e9\u00e9\u00e9\u20ac\U0001f600&nope; &lt; & AT&T \u00a9",
        "AT&amp T&copy2 &#233 &ampx &notin; &notit;": "AT& T\u00a92 \u00e9 &x \u2209 \u00acit;",
        "&#0;&#xD800;&#99999999;": "\ufffd\ufffd\ufffd",
        " one\u00a0\u2003two\r\n\n three ": "one two\nthree",
        "<div>" * 5000 + "deep": "deep",
        "<a href=\"" + "x" * 20000 + "\">t</a>": "t",
    }
    df = spark.createDataFrame(list(cases.items()), "html string, want string")
    assert [(r.html, r.text) for r in pages.html_text(df).collect() if r.text != r.want] == []


def test_workbook():
    import io
    import zipfile

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<s xmlns="u"><si><t>zero</t></si><si><r><t>o</t></r><r><t>ne</t></r></si></s>')
        z.writestr("xl/worksheets/sheet2.xml", '<w xmlns="u"><row><c t="s"><v>0</v></c></row></w>')
        z.writestr("xl/worksheets/sheet1.xml", '<w xmlns="u"><row><c t="s"><v>1</v></c><c><v>5</v></c><c t="inlineStr"><is><t>in</t></is></c></row></w>')
    assert pages.office_text(data.getvalue(), "xlsx") == "one 5 in\nzero"


def test_session_files(spark):
    rows = [("a/s.jsonl", '{"role":"user","content":"Hi there","timestamp":"2026-01-02T00:00:00Z"}\n{"role":"assistant","content":"no"}\n{"type":"user","message":{"content":[{"text":"more"}]}}\n'), ("b.json", '{"messages":[{"role":"user","text":"old","time":"2025-01-01T00:00:00Z"}]}'), ("c.json", "nonsense"), ("d.json", '[{"prompt":"undated"}]'), ("e.txt", "x")]
    files = spark.createDataFrame([(p, t, datetime(2026, 1, 3)) for p, t in rows], "path string, text string, modified timestamp")
    found = {r.session_file: r for r in pages.session_files(files, "tool", "2026-01-01T00:00:00Z", "2026-02-01T00:00:00Z").collect()}
    assert set(found) == {"a/s.jsonl", "c.json", "d.json"} and found["c.json"].problem
    first = found["a/s.jsonl"]
    assert (first.title, first.text, first.prompts, first.time, first.tags) == ("tool: Hi there", "Hi there\nmore", 2, "2026-01-02T00:00:00Z", ["telemetry", "tool"])


def test_office_text():
    import io
    import zipfile

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:r><w:t>Hello</w:t></w:r><w:r><w:t> you</w:t></w:r></w:p><w:p><w:t>Next</w:t></w:p></w:d>')
    assert pages.office_text(data.getvalue(), "docx") == "Hello you\nNext"


@pytest.mark.parametrize("name", ["note_fields", "note_link_fields", "section_assign", "section_extract", "section_at_anchor", "note_snippets", "note_links", "tasks_explode"])
def test_notes_are_compiled_once(spark, sf_dir, name):
    from recordmill.plans import catalogue

    plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("scheme is refused") <= 1 and "Repartition" in plan


def test_keep_text(spark):
    rows = spark.createDataFrame([("projects/a.md", "# A {#a k=v}\none\n## B\n- [ ] do {#t}\n"), ("projects/b.md", None)], "path string, text string")
    found = notes.compile_notes(rows, keep_text=True)
    assert {r.ref: r.source_text for r in found.collect()} == {r.path: r.text for r in rows.collect()}
    assert [tuple(r) for r in notes.at_anchor(found, "a").collect()] == [("projects/a.md", "section", "one\n## B\n- [ ] do {#t}")]
    assert notes.at_anchor(found, "t").first()["what"] == "task"


def test_few_notes_at_once():
    import pyarrow as pa

    texts = ["x" * 700_000, None, "y" * 700_000, "z" * 3_000_000, *["w"] * 1200]
    parts = list(notes.batch_slices(pa.RecordBatch.from_pydict({"text": texts}), "text"))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert all(p.num_rows == 1 or (p.num_rows <= notes.MOST_NOTES and sum(len(t or "") for t in p.column("text").to_pylist()) <= notes.MOST_CHARS) for p in parts)


def test_plain_front_matter_as_the_strict_loader_reads_it():
    import random

    import yaml

    pick, same = random.Random(7), 0
    words = ["a", "b: ", "- ", "\n", "\n", "\n  ", "[", "]", "{", "}", ", ", ":", "1", "0x1F", "yes", "..", "---", "+", "-", "@", "a:b", " :", "true", "{}", "\n- ", "\nk: ", "\n  k: ", "1.5", "http://x.y/z", "x: [a, b]", "{to: x, m: {r: p}}"]
    for _ in range(4000):
        block = "".join(pick.choices(words, k=pick.randint(1, 9)))
        try:
            found = notes.plain_values(block)
        except Exception:
            continue
        same += 1
        assert not block.strip() or repr(found) == repr(yaml.load(block, notes.strict_loader()))
    assert same > 500
    assert notes.yaml_map("a: [yes, 0x10]\nb: {c: ~}") == {"a": ["yes", 16], "b": {"c": None}}
    with pytest.raises(ValueError, match="nested too deep"):
        notes.yaml_map("a: " + "[" * 40 + "]" * 40)


def test_anchors_are_neither_broadcast_nor_held(spark):
    from recordmill.operators import graph

    links = spark.createDataFrame([("a", "x", "1"), ("a", "x", "9"), ("b", "y", "1"), ("b", None, "1"), ("c", "x", "")], "ref string, to string, anchor string")
    anchors = spark.createDataFrame([("x", ["1", "2", "1"])], "to string, a array<string>").select("to", F.explode("a").alias("anchor"))
    found = graph.missing_anchors(links, anchors)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "HashAggregate" not in plan
    assert sorted(map(str, (r.ref + str(r.to) + r.anchor for r in found.collect()))) == ["ax9", "bNone1", "by1"]

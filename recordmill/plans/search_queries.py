"""Queries over records: scans, searches, projections, reads and values."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from recordmill.functions import cron, links
from recordmill.functions import values as V
from recordmill.operators import search
from recordmill.plans.jq.compiler import jq
from recordmill.sources import notes, pages, records
from recordmill.sources.scratch import shared_dir

PATTERN = "the[a-z]* on"
NOW = "2026-11-15T12:00:00Z"
VIEW = "SELECT *, 'memories/' || source || '/' || sha256(CAST(doc_id AS VARCHAR)) || '.json' AS path, source || ':' || doc_id AS ref, CAST(doc_id AS VARCHAR) AS id FROM documents"
#: Javas's white space with (?U) as DuckDB must spell it.
WS = r"[\s\x0b\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
FLAT = f"trim(regexp_replace(text, '{WS}', ' ', 'g'))"

#: A document as the note that as_notes() makes of it; ~ stands for a line feed.
NOTE = "'---~type: doc~status: draft~tags: [' || lang || ']~---~# Document ' || doc_id || ' {#top}~~' || regexp_replace(text, '[\\[\\]<>`#{}]', '', 'g') || '~~## Links~~[next](doc-' || (doc_id + 1) || '.md#top) and src1:x~~- [ ] check ' || lang || '~- [x] done~'"
NOTE = NOTE.replace("~", "' || chr(10) || '")


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_tree(spark, sf_dir):
    """Nations written as files of a store, each record in one, beside files that aren't records; the store's root."""
    root = f"{shared_dir(spark)}/recordmill/{uuid.uuid4().hex}/nation/store"
    rows = read(spark, sf_dir, "nation")
    view = records.record_view(rows, F.concat(F.lit("r"), "n_regionkey"), F.col("n_nationkey"), F.col("n_name"), F.col("n_name"))
    lines = records.canonical_lines(view.withColumn("text", F.to_json(F.struct("title", "id", "source", "ref", "kind"))))
    files = lines.select("path", F.regexp_replace("line", "\n$", "").alias("line"))
    other = lines.select(F.concat(F.lit("logs/"), "id", F.lit(".txt")).alias("path"), F.lit("no record").alias("line"))
    records.write_tree(files.union(other), re.sub("^file:/*", "/", root))
    return root


def scan_records(spark, sf_dir):
    files = records.checked_count(records.read_tree(spark, nation_tree(spark, sf_dir)))
    found = records.parsed(files.where(V.is_record_path(F.col("path")))).where("problem is null")
    field = lambda n: F.variant_get("doc", f"$.{n}", "string").alias(n)
    return found.select("path", F.col("size").cast("long").alias("size"), field("ref"), field("source"), field("id"))


def list_paths(spark, sf_dir):
    return records.list_tree(spark, nation_tree(spark, sf_dir), "txt").select("path", F.col("length").cast("long").alias("length"))


def walk_order(spark, sf_dir):
    rows = records.documents(spark, sf_dir).select("path")
    return records.with_positions(rows, F.split("path", "/")).select("path", "pos")


def record_path(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", V.record_path(F.col("source"), F.col("doc_id")).alias("path"))


def search_regex(spark, sf_dir):
    return search.Query(pattern=PATTERN, fields=("doc_id", "source")).rows(records.documents(spark, sf_dir))


def search_literal(spark, sf_dir):
    return search.Query(pattern="É", fields=("doc_id",)).rows(records.documents(spark, sf_dir))


def search_line(spark, sf_dir):
    docs = records.documents(spark, sf_dir)
    return docs.where(search.pattern_column('"source":"src1"', records.line_of(docs))).select("doc_id")


def search_snippet(spark, sf_dir):
    docs = search.Query(pattern=PATTERN).rows(records.documents(spark, sf_dir))
    return docs.select("doc_id", search.snippet(F.col("text"), PATTERN).alias("snippet"))


def search_page(spark, sf_dir):
    page = search.Query(pattern=PATTERN, limit=20).page(records.documents(spark, sf_dir).select("path", "source", "doc_id", "text"), "path")
    return page.select("doc_id", "truncated")


def filter_source(spark, sf_dir):
    return search.Query(source="src3", fields=("doc_id",)).rows(records.documents(spark, sf_dir))


def filter_kind(spark, sf_dir):
    return search.Query(kind="memory", fields=("doc_id", "kind")).rows(records.documents(spark, sf_dir))


def filter_scope_folder(spark, sf_dir):
    """A folder is that folder only: src1 doesn't take src10."""
    return search.Query(scope="src1", fields=("doc_id",)).rows(records.documents(spark, sf_dir))


def filter_scope_prefix(spark, sf_dir):
    """Not a folder: the files of the source whose names begin so."""
    return search.Query(scope="memories/src1/a", fields=("doc_id",)).rows(records.documents(spark, sf_dir))


def filter_scope_note(spark, sf_dir):
    """A note's path is that note."""
    compiled = notes.compile_notes(as_notes(spark, sf_dir))
    return search.Query(scope="concepts/doc-3.md", fields=("ref", "title")).rows(compiled)


def project_fields(spark, sf_dir):
    return search.Query(fields=("doc_id", "lang")).rows(records.documents(spark, sf_dir))


def limit_truncated(spark, sf_dir):
    return search.limited(records.documents(spark, sf_dir).select("doc_id"), 25, "doc_id")


def search_then_project(spark, sf_dir):
    return search.Query(pattern=PATTERN, where=F.col("lang") == "en", fields=("ref", "lang")).rows(records.documents(spark, sf_dir))


def search_then_jq(spark, sf_dir):
    """A pattern narrows the records that a jq program then looks at."""
    found = search.Query(pattern=PATTERN, source="src1").rows(records.documents(spark, sf_dir))
    return jq(found, 'select(.lang != "de") | {ref, size: .n_chars}')


def point_read_ref(spark, sf_dir):
    return records.documents(spark, sf_dir).where(F.col("ref") == "src7:47").select("ref", "title", "text")


def alias_lookup(spark, sf_dir):
    rows = read(spark, sf_dir, "customer")
    view = records.record_view(rows, F.lit("customer"), F.col("c_custkey"), F.col("c_name"), F.col("c_name"), "c_custkey", "c_name")
    return search.alias_lookup(view, "Customer#000000042", "c_name").select("c_custkey")


def line_slice(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", V.line_slice(F.col("text"), 2, 3).alias("content"))


def byte_budget(spark, sf_dir):
    text = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", V.fits_bytes(text, 2000).alias("fits"), F.length(V.cut_to_bytes(text, 2000)).cast("long").alias("kept"))


def tsv_rows(spark, sf_dir):
    return search.tsv_rows(read(spark, sf_dir, "documents"), "doc_id", "lang", "text")


def status_counts(spark, sf_dir):
    rows = records.documents(spark, sf_dir)
    return rows.agg(F.count("*").alias("records"), F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"))


def open_tasks_total(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct((F.col("o_orderstatus") == "F").alias("done"))).alias("tasks"))
    return rows.agg(F.sum(F.size(F.filter("tasks", lambda t: ~t["done"]))).alias("tasks_open"))


def json_strict(spark, sf_dir):
    rows = records.parsed(read(spark, sf_dir, "events").select("event_id", F.col("props").alias("text")))
    return rows.select("event_id", F.variant_get("doc", "$.k", "long").alias("k"), F.col("problem").isNull().alias("sound"))


def canonical_sha(spark, sf_dir):
    """Records with their keys out of order and nested ones, hashed in canonical form."""
    rows = read(spark, sf_dir, "customer")
    nested = F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    rows = rows.select("c_custkey", F.to_json(F.struct(nested.alias("in"), F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))).alias("json"))
    return records.canonical_lines(rows, "json").select("c_custkey", F.sha2("line", 256).alias("sha"))


def ws_collapse(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(V.collapse_space(F.col("text")), 256).alias("sha"))


def slugify(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", V.slug(F.col("p_name")).alias("slug"), V.title_of_slug(V.slug(F.col("p_name"))).alias("title"))


def text_hygiene(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", V.is_clean(t).alias("clean"), V.is_clean_text(t).alias("clean_text"), V.has_invisible(t).alias("invisible"))


def redact_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(V.redact(F.col("text")), 256).alias("sha"))


def redact_kv(spark, sf_dir):
    rows = read(spark, sf_dir, "customer")
    kv = F.create_map(F.lit("name"), F.col("c_name"), F.lit("api_key"), F.col("c_mktsegment"), F.lit("Authorization"), F.lit("x"))
    return rows.select("c_custkey", V.redact_map(kv).alias("kv")).select("c_custkey", F.col("kv")["name"].alias("name"), F.col("kv")["api_key"].alias("api_key"), F.col("kv")["Authorization"].alias("authorization"))


def duration_parse(spark, sf_dir):
    """Durations of one and several units, with fractions, out of bounds, and texts that are none, made of events."""
    n = F.col("event_id")
    forms = [F.concat(n, F.lit("s")), F.concat(n % 400, F.lit("d"), n % 24, F.lit("h")), F.concat(n % 50, F.lit(".5h")), F.concat(n, F.lit("ms")), F.concat(n, F.lit("h 2m")), F.concat(n, F.lit("y")), F.col("event_type"), F.concat(n % 3, F.lit("w"), n % 2, F.lit("m"))]
    rows = read(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*forms), (n % 8 + 1).cast("int")).alias("s"))
    return rows.select("event_id", "s", V.duration_seconds(F.col("s")).alias("seconds"), V.duration_whole_seconds(F.col("s")).alias("whole"))


def date_normalize(spark, sf_dir):
    """Days of the calendar and others, short forms, times and the first of all days, made of orders."""
    form = lambda pattern: F.date_format("o_orderdate", pattern)
    forms = [form("yyyy-MM-dd"), F.concat(form("yyyy-MM"), F.lit("-31")), form("yyyy-M-d"), F.lit("0001-01-01"), form("yyyy-MM-dd'T'HH")]
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*forms), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("s"))
    return rows.select("o_orderkey", "s", V.normalize_date(F.col("s")).alias("day"))


def time_normalize(spark, sf_dir):
    """Times with other zones, fractions that are cut, and texts that are no time."""
    shown = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    form = F.col("event_id") % 5
    text = F.when(form == 0, F.concat(shown, F.lit("Z"))).when(form == 1, F.concat(shown, F.lit(".987654+02:00"))).when(form == 2, F.concat(shown, F.lit("-05:30"))).when(form == 3, shown).otherwise(F.lit("2026-02-30T00:00:00Z"))
    return read(spark, sf_dir, "events").select("event_id", V.normalize_time(text).alias("t"))


def ts_key(spark, sf_dir):
    date = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
    return read(spark, sf_dir, "orders").select("o_orderkey", V.ts_key(date).alias("key"))


def tags_normalize(spark, sf_dir):
    rows = read(spark, sf_dir, "documents")
    return rows.select("doc_id", F.array_join(V.tags(F.array(F.col("lang"), F.col("source"), F.lit("a b"), F.lit("x/y"), F.col("lang"))), ",").alias("tags"))


def reserved_intersect(spark, sf_dir):
    names = spark.createDataFrame([(n,) for n in V.RESERVED], "name string")
    ours = read(spark, sf_dir, "documents").select(F.col("source").alias("name")).union(spark.createDataFrame([("notes",), ("loops",)], "name string"))
    return ours.intersect(names)


#: Paths of documents, @ for the document: what they are is in the query's SQL.
PATHS = ("projects/@.md", "projects/.#@.md", "actions/@/ACTION.md", "actions/x/@.md", "memories/src1/@.json", "memories/notes/@.json", ".git/@", "@/.env.local", "@/.env.example", "logs/@", "@/../b", "@//b", "concepts/b/@.md")


def path_predicates(spark, sf_dir):
    place = F.element_at(F.array(*map(F.lit, PATHS)), (F.col("doc_id") % len(PATHS) + 1).cast("int"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.replace(place, F.lit("@"), F.col("doc_id").cast("string")).alias("path"))
    p = F.col("path")
    return rows.select("doc_id", "path", V.is_private(p).alias("private"), V.note_role(p).alias("role"), V.is_record_path(p).alias("record"), V.is_bad_relative(p).alias("bad"), V.compiled_path(p).alias("compiled"))


def format_span(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    return rows.select("event_id", V.format_span(F.col("value") * 1000).alias("span"))


def cron_prev(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    return cron.with_previous(rows, "30 6 * * *", F.col("ts")).select("event_id", F.date_format("fired", "yyyy-MM-dd'T'HH:mm:ss").alias("fired"))


def cron_prev_weekdays(spark, sf_dir):
    """Twice an hour on Mondays and Fridays, on the clocks of a zone five and a half hours ahead."""
    rows = read(spark, sf_dir, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    return cron.with_previous(rows, "0,30 * * * mon,fri", F.col("ts"), "Asia/Kolkata").select("event_id", F.date_format("fired", "yyyy-MM-dd'T'HH:mm:ss").alias("fired"))


def attrs_map(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("{: segment="), F.col("c_mktsegment"), F.lit(" nation="), F.col("c_nationkey"), F.lit("}")).alias("a"))
    return rows.select("c_custkey", V.attribute_map(F.col("a")).alias("m")).select("c_custkey", F.col("m")["segment"].alias("segment"), F.col("m")["nation"].alias("nation"))


def link_query_map(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.map_keys(V.query_map(F.concat(F.regexp_replace("url", r"\?.*$", ""), F.lit("?id="), "page_id", F.lit("#x"))))[0].alias("k"), V.query_map(F.concat(F.regexp_replace("url", r"\?.*$", ""), F.lit("?id="), "page_id", F.lit("#x")))["id"].alias("v"))


def headings_regex(spark, sf_dir):
    text = F.concat(F.lit("# Turn "), F.col("turn"), F.lit("\nbody\n## "), F.col("role"), F.lit(" {#x}\n"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(V.headings(text), "|").alias("heads"))


def html_to_text(spark, sf_dir):
    return pages.html_text(read(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.sha2("text", 256).alias("sha"))


def html_strip(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.sha2(V.strip_html(F.col("html")), 256).alias("sha"))


def session_rollup(spark, sf_dir):
    return pages.sessions(read(spark, sf_dir, "conversations"))


def as_notes(spark, sf_dir):
    """Documents as small notes, so that the note compiler runs over real texts."""
    rows = read(spark, sf_dir, "documents")
    title = F.concat(F.lit("# Document "), F.col("doc_id"), F.lit(" {#top}\n\n"))
    tail = F.concat(F.lit("\n\n## Links\n\n[next](doc-"), F.col("doc_id") + 1, F.lit(".md#top) and src1:x\n\n- [ ] check "), F.col("lang"), F.lit("\n- [x] done\n"))
    head = F.concat(F.lit("---\ntype: doc\nstatus: draft\ntags: ["), F.col("lang"), F.lit("]\n---\n"))
    return rows.select("doc_id", F.concat(F.lit("concepts/doc-"), F.col("doc_id"), F.lit(".md")).alias("path"), F.concat(head, title, F.regexp_replace("text", r"[\[\]<>`#{}]", ""), tail).alias("text"))


def compile_notes(spark, sf_dir):
    found = notes.compile_notes(as_notes(spark, sf_dir))
    return found.select("path", "title", "kind", "sha256", F.size("headings").cast("long").alias("n_headings"), F.size("tasks").cast("long").alias("n_tasks"))


def note_outline(spark, sf_dir):
    return search.outline(notes.compile_notes(as_notes(spark, sf_dir))).select("ref", "title", F.col("tasks_open").cast("long").alias("tasks_open"))


def tasks_explode(spark, sf_dir):
    return notes.compile_notes(as_notes(spark, sf_dir)).select("ref", F.explode("tasks").alias("t")).select("ref", "t.text", "t.done", "t.section")


def headings_explode(spark, sf_dir):
    return notes.compile_notes(as_notes(spark, sf_dir)).select("ref", F.explode("headings").alias("h")).select("ref", "h.id", "h.level")


def frontmatter_split(spark, sf_dir):
    text = F.col("text")
    return as_notes(spark, sf_dir).select("doc_id", F.regexp_extract(text, r"(?s)^---\n(.*?)\n---\n", 1).alias("block"), F.length(F.regexp_replace(text, r"(?s)^---\n.*?\n---\n", "")).cast("long").alias("body_chars"))


def link_normalize(spark, sf_dir):
    kinds = F.array(F.lit("doc-7.md#top"), F.concat(F.lit("src2:"), "doc_id"), F.concat(F.lit("https://x.example/"), "doc_id"), F.lit("bf:///projects/plan"), F.lit("bf://other/concepts/a.md"), F.lit("javascript:x"), F.lit("../../x.md"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.lit("concepts/me.md").alias("origin"), F.explode(kinds).alias("raw"))
    return links.normalize_links(rows, "origin", "raw").select("doc_id", "raw", "to", "kind", "anchor")


def eval_expectations(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = docs.where(search.pattern_column(PATTERN, F.col("text"))).select(F.lit("regex").alias("case"), F.col("doc_id").alias("ref")).union(docs.where("lang = 'en'").select(F.lit("english"), "doc_id"))
    expected = docs.where("lang = 'en' and doc_id % 3 = 0").select(F.explode(F.array(F.lit("regex"), F.lit("english"))).alias("case"), F.col("doc_id").alias("ref"))
    forbidden = docs.where("lang = 'de'").select(F.explode(F.array(F.lit("regex"), F.lit("english"))).alias("case"), F.col("doc_id").alias("ref"))
    return search.eval_cases(found, expected, forbidden)


def envelope_parse(spark, sf_dir):
    """Customers' orders as batches in three shapes: an envelope, an array, and an object a line."""
    one = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("title"))
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(one)).alias("r"))
    form, lines = F.col("o_custkey") % 3, F.array_join(F.transform("r", lambda x: F.to_json(x)), "\n")
    envelope = F.concat(F.lit('{"records":'), F.to_json("r"), F.lit(',"incomplete":{"missed":2}}'))
    text = F.when(form == 0, envelope).when(form == 1, F.to_json("r")).otherwise(F.concat(lines, F.lit("\n")))
    found = records.batches_of(rows.select("o_custkey", text.alias("batch")), "batch", "o_custkey")
    value = F.from_json("record", "id string, title string")
    return found.select("o_custkey", value["id"].alias("id"), value["title"].alias("title"), "missing", "problem")


def customer_notes(spark, sf_dir):
    """Customers as notes with all kinds of front matter, links and marks."""
    rows = read(spark, sf_dir, "customer")
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    head = F.concat(F.lit("---\ntype: customer\nstatus: draft\nupdated: 1998-0"), F.col("c_custkey") % 9 + 1, F.lit("-01\nstale_after: "), F.col("c_custkey") % 50 + 1, F.lit("d\nentity: urn:c:"), key, F.lit("\naliases: [c"), key, F.lit(", yes]\nlinks: ["), F.lit("{to: bf:///projects/plan, meta: {rel: part}}]\nsources:\n- resource: nation:"), nation, F.lit("\n  retrieved: 1998-01-01\nlevel: 0x10\n---\n"))
    body = F.concat(F.lit("# "), "c_name", F.lit(" {#top owner=\"a b\"}\n\nBuys **"), "c_mktsegment", F.lit("** in [there](../projects/nation-"), nation, F.lit("?role=home#top){since=x}.\n\n## Needs\n\n> quoted\n\n### Small\n\n- [ ] call {#t1 due=soon}\n- [x] done\n\nUnder\n-----\n\nlast actions:1 [act](../actions/pay)\n"))
    return rows.select("c_custkey", F.concat(F.lit("concepts/c-"), key, F.lit(".md")).alias("path"), F.concat(head, body).alias("text"))


def note_fields(spark, sf_dir):
    found = notes.compile_notes(customer_notes(spark, sf_dir))
    source = F.col("sources")[0]
    return found.select("path", "ref", "title", "text", "updated", "stale_after", "entity", F.array_join("aliases", ",").alias("aliases"), source["resource"].alias("resource"), source["retrieved"].alias("retrieved"), "extra", "problem")


def note_link_fields(spark, sf_dir):
    found = notes.compile_notes(customer_notes(spark, sf_dir)).select("ref", F.explode("links").alias("l"))
    return found.select("ref", "l.to", "l.kind", "l.anchor", "l.section", F.array_join(F.transform(F.array_sort(F.map_entries("l.meta")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("meta"))


def section_assign(spark, sf_dir):
    """The section that each task and element of a note is in, carried forward from the heading before it."""
    found = notes.compile_notes(customer_notes(spark, sf_dir))
    part = lambda text: lambda x: F.struct(x[text].alias("text"), x["section"].alias("section"))
    return found.select("ref", F.explode(F.concat(F.transform("tasks", part("text")), F.transform("links", part("to")))).alias("x")).select("ref", "x.text", "x.section")


def compiled_with_text(spark, sf_dir):
    return notes.compile_notes(customer_notes(spark, sf_dir), keep_text=True)


def section_extract(spark, sf_dir):
    """Each heading's section of a note, up to the next heading of its level or above."""
    return notes.sections(compiled_with_text(spark, sf_dir)).select("ref", "anchor", F.col("level").cast("long").alias("level"), F.sha2("text", 256).alias("sha"))


def section_at_anchor(spark, sf_dir):
    """An anchor may be a task's, a section's or an attribute list's."""
    task, section = notes.anchor_value("t1"), notes.anchor_value("small")
    found = compiled_with_text(spark, sf_dir).select("ref", notes.once_a_row(task).alias("a"), notes.once_a_row(section).alias("b"))
    both = F.array(F.struct("a.what", F.get_json_object("a.value", "$.text").alias("value")), F.col("b"))
    return found.select("ref", F.explode(both).alias("x")).select("ref", "x.what", "x.value").where("what is not null")


def note_snippets(spark, sf_dir):
    shown, anchor = search.note_snippet("call|quoted")
    rows = notes.compile_notes(customer_notes(spark, sf_dir)).select("ref", shown.alias("first"), anchor.alias("first_anchor"), *(c.alias(n) for c, n in zip(search.note_snippet("quoted"), ("second", "second_anchor"))))
    return rows


def point_reads(spark, sf_dir):
    """A record by reference, by path and by a name that it bears; a note by its path without an extension."""
    rows = read(spark, sf_dir, "customer")
    view = records.record_view(rows, F.lit("customer"), F.col("c_custkey"), F.col("c_name"), F.col("c_name"), F.concat(F.lit("crm:"), "c_custkey").alias("entity"), F.array(F.concat(F.lit("https://crm.example/"), "c_custkey")).alias("aliases"))
    found = view.where("false").select(F.lit("").alias("asked"), "title")
    for target in ("customer:7", "bf:///customer:8", "crm:9", "urn:crm:10", "https://crm.example/11", "customer:none"):
        found = found.union(search.point_read(view, target).select(F.lit(target).alias("asked"), "title"))
    compiled = notes.compile_notes(customer_notes(spark, sf_dir))
    return found.union(search.point_read(compiled, "concepts/c-12").select(F.lit("concepts/c-12").alias("asked"), "title"))


def schema_violations(spark, sf_dir):
    from recordmill.operators import schemas

    shape = {"type": "object", "required": ["id", "title"], "properties": {"id": {"type": "string", "maxLength": 3}, "title": {"type": "string", "pattern": "^document [0-9]*[02468]$"}, "lang": {"enum": ["en", "de"]}, "n_chars": {"type": "integer", "minimum": 100}}}
    return schemas.violations(records.documents(spark, sf_dir), shape, "doc_id")


SQL = {
    "search_then_jq": f"SELECT ref, n_chars AS size FROM ({VIEW}) WHERE source = 'src1' AND lang != 'de' AND regexp_matches(text, '{PATTERN}', 'i')",
    "point_reads": """SELECT asked, c_name AS title FROM customer JOIN (VALUES ('customer:7', 7), ('bf:///customer:8', 8), ('crm:9', 9), ('urn:crm:10', 10), ('https://crm.example/11', 11), ('concepts/c-12', 12)) t(asked, k) ON k = c_custkey""",
    "note_snippets": """SELECT 'concepts/c-' || c_custkey || '.md' AS ref, 'call' AS first, 'small' AS first_anchor, array_to_string([c_name, 'Buys ' || c_mktsegment || ' in there.', 'Needs', 'quoted', 'Small', '[ ] call', '[x] done', 'Under', 'last actions:1 act'], ' ') AS second, 'needs' AS second_anchor FROM customer""",
    "section_at_anchor": """SELECT 'concepts/c-' || c_custkey || '.md' AS ref, u.what AS what, u.value AS value FROM (SELECT *, unnest([{'what': 'task', 'value': 'call'}, {'what': 'section', 'value': '- [ ] call {#t1 due=soon}' || chr(10) || '- [x] done'}]) AS u FROM customer)""",
    "section_extract": """WITH t AS (SELECT *, '- [ ] call {#t1 due=soon}' || chr(10) || '- [x] done' AS small, 'last actions:1 [act](../actions/pay)' AS under FROM customer), n AS (SELECT *, '> quoted' || chr(10) || chr(10) || '### Small' || chr(10) || chr(10) || small AS needs FROM t),
        a AS (SELECT *, 'Buys **' || c_mktsegment || '** in [there](../projects/nation-' || c_nationkey || '?role=home#top){since=x}.' || chr(10) || chr(10) || '## Needs' || chr(10) || chr(10) || needs || chr(10) || chr(10) || 'Under' || chr(10) || '-----' || chr(10) || chr(10) || under AS top FROM n)
        SELECT 'concepts/c-' || c_custkey || '.md' AS ref, u.anchor AS anchor, u.level AS level, sha256(u.text) AS sha FROM (SELECT *, unnest([{'anchor': 'top', 'level': 1::BIGINT, 'text': top}, {'anchor': 'needs', 'level': 2::BIGINT, 'text': needs}, {'anchor': 'small', 'level': 3::BIGINT, 'text': small}, {'anchor': 'under', 'level': 2::BIGINT, 'text': under}]) AS u FROM a)""",
    "section_assign": """SELECT 'concepts/c-' || c_custkey || '.md' AS ref, u.text AS text, u.section AS section FROM (SELECT *, unnest([{'text': 'call', 'section': 'small'}, {'text': 'done', 'section': 'small'}, {'text': 'projects/plan.md', 'section': ''}, {'text': 'memories/nation/' || sha256(CAST(c_nationkey AS VARCHAR)) || '.json', 'section': ''}, {'text': 'projects/nation-' || c_nationkey || '.md', 'section': 'top'}, {'text': 'actions/pay/ACTION.md', 'section': 'under'}]) AS u FROM customer)""",
    "note_link_fields": """SELECT 'concepts/c-' || c_custkey || '.md' AS ref, u['to'] AS "to", u.kind AS kind, u.anchor AS anchor, u.section AS section, u.meta AS meta FROM (SELECT *, unnest([
        {'to': 'projects/plan.md', 'kind': 'note', 'anchor': '', 'section': '', 'meta': 'rel=part'}, {'to': 'memories/nation/' || sha256(CAST(c_nationkey AS VARCHAR)) || '.json', 'kind': 'record', 'anchor': '', 'section': '', 'meta': 'rel=cites'},
        {'to': 'projects/nation-' || c_nationkey || '.md', 'kind': 'note', 'anchor': 'top', 'section': 'top', 'meta': 'role=home,since=x'}, {'to': 'actions/pay/ACTION.md', 'kind': 'note', 'anchor': '', 'section': 'under', 'meta': ''}]) AS u FROM customer)""",
    "note_fields": """SELECT 'concepts/c-' || c_custkey || '.md' AS path, 'concepts/c-' || c_custkey || '.md' AS ref, c_name AS title, array_to_string([c_name, 'Buys ' || c_mktsegment || ' in there.', 'Needs', 'quoted', 'Small', '[ ] call', '[x] done', 'Under', 'last actions:1 act'], chr(10)) AS text,
        '1998-0' || (c_custkey % 9 + 1) || '-01' AS updated, (c_custkey % 50 + 1) || 'd' AS stale_after, 'urn:c:' || c_custkey AS entity, 'c' || c_custkey || ',yes' AS aliases, 'nation:' || c_nationkey AS resource, '1998-01-01' AS retrieved, '{"level": 16}' AS extra, CAST(NULL AS VARCHAR) AS problem FROM customer""",
    "filter_scope_note": "SELECT 'concepts/doc-' || doc_id || '.md' AS ref, 'Document ' || doc_id AS title FROM documents WHERE doc_id = 3",
    "filter_scope_folder": "SELECT doc_id FROM documents WHERE source = 'src1'",
    "list_paths": "SELECT 'logs/' || n_nationkey || '.txt' AS path, CAST(10 AS BIGINT) AS length FROM nation",
    "scan_records": """WITH v AS (SELECT 'r' || n_regionkey AS source, CAST(n_nationkey AS VARCHAR) AS id, n_name FROM nation) SELECT 'memories/' || source || '/' || sha256(id) || '.json' AS path, CAST(strlen('{"id":"' || id || '","kind":"memory","ref":"' || source || ':' || id || '","source":"' || source || '","title":"' || n_name || '"}') + 1 AS BIGINT) AS size, source || ':' || id AS ref, source, id FROM v""",
    "walk_order": f"SELECT path, row_number() OVER (ORDER BY source, path) AS pos FROM ({VIEW})",
    "record_path": f"SELECT doc_id, path FROM ({VIEW})",
    "search_regex": f"SELECT doc_id, source FROM documents WHERE regexp_matches(text, '{PATTERN}', 'i')",
    "search_literal": "SELECT doc_id FROM documents WHERE regexp_matches(text, 'É', 'i')",
    "search_line": "SELECT doc_id FROM documents WHERE source = 'src1'",
    "search_snippet": f"""WITH f AS (SELECT doc_id, {FLAT} AS t FROM documents WHERE regexp_matches(text, '{PATTERN}', 'i')),
        p AS (SELECT *, CASE WHEN regexp_matches(t, '{PATTERN}', 'i') THEN length(regexp_extract(t, '^(.*?){PATTERN}', 1, 'is')) ELSE -1 END AS pos FROM f)
        SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE substring(t, 1 + CASE WHEN pos <= 80 THEN 0 ELSE greatest(0, least(pos - 80, length(t) - 240)) END, 240) END AS snippet FROM p""",
    "search_page": f"WITH m AS (SELECT doc_id, source, path FROM ({VIEW}) WHERE regexp_matches(text, '{PATTERN}', 'i') ORDER BY path LIMIT 21) SELECT doc_id, (SELECT count(*) > 20 FROM m) AS truncated FROM m ORDER BY path LIMIT 20",
    "filter_source": "SELECT doc_id FROM documents WHERE source = 'src3'",
    "filter_kind": "SELECT doc_id, 'memory' AS kind FROM documents WHERE source NOT IN ('projects', 'concepts', 'actions')",
    "filter_scope_prefix": "SELECT doc_id FROM documents WHERE source = 'src1' AND sha256(CAST(doc_id AS VARCHAR)) LIKE 'a%'",
    "project_fields": "SELECT doc_id, lang FROM documents",
    "limit_truncated": "SELECT doc_id, (SELECT count(*) > 25 FROM documents) AS truncated FROM documents ORDER BY doc_id LIMIT 25",
    "search_then_project": f"SELECT ref, lang FROM ({VIEW}) WHERE lang = 'en' AND regexp_matches(text, '{PATTERN}', 'i')",
    "point_read_ref": f"SELECT ref, 'document ' || doc_id AS title, text FROM ({VIEW}) WHERE ref = 'src7:47'",
    "alias_lookup": "SELECT c_custkey FROM customer WHERE c_name = 'Customer#000000042'",
    "line_slice": r"SELECT doc_id, array_to_string(list_slice(CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END, 2, 4), chr(10)) AS content FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS l FROM documents)",
    "byte_budget": "SELECT doc_id, strlen(text) <= 2000 AS fits, CAST(CASE WHEN strlen(text) <= 2000 THEN length(text) ELSE (SELECT max(i) FROM range(0, 2001) r(i) WHERE strlen(left(text, i)) <= 2000) END AS BIGINT) AS kept FROM documents",
    "compile_notes": f"SELECT 'concepts/doc-' || doc_id || '.md' AS path, 'Document ' || doc_id AS title, 'concept' AS kind, sha256({NOTE}) AS sha256, CAST(2 AS BIGINT) AS n_headings, CAST(2 AS BIGINT) AS n_tasks FROM documents",
    "path_predicates": """WITH t(i, path, private, role, record, bad, compiled) AS (VALUES (0, 'projects/@.md', false, 'projects', false, false, 'memories/projects/@.json'),
(1, 'projects/.#@.md', false, NULL, false, false, NULL),
(2, 'actions/@/ACTION.md', false, 'actions', false, false, 'memories/actions/@.json'),
(3, 'actions/x/@.md', false, NULL, false, false, NULL),
(4, 'memories/src1/@.json', false, NULL, true, false, NULL),
(5, 'memories/notes/@.json', false, NULL, false, false, NULL),
(6, '.git/@', true, NULL, false, false, NULL),
(7, '@/.env.local', true, NULL, false, false, NULL),
(8, '@/.env.example', false, NULL, false, false, NULL),
(9, 'logs/@', true, NULL, false, false, NULL),
(10, '@/../b', false, NULL, false, true, NULL),
(11, '@//b', false, NULL, false, true, NULL),
(12, 'concepts/b/@.md', false, 'concepts', false, false, 'memories/concepts/b/@.json'))
SELECT doc_id, replace(path, '@', CAST(doc_id AS VARCHAR)) AS path, private, role, record, bad, replace(compiled, '@', CAST(doc_id AS VARCHAR)) AS compiled FROM documents JOIN t ON i = doc_id % 13""",
    "tsv_rows": "SELECT doc_id || chr(9) || coalesce(lang, '') || chr(9) || regexp_replace(coalesce(text, ''), '[\\t\\r\\n]', ' ', 'g') AS line FROM documents",
    "status_counts": "SELECT count(*) AS records, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM documents",
    "open_tasks_total": "SELECT CAST(count(*) FILTER (WHERE o_orderstatus != 'F') AS BIGINT) AS tasks_open FROM orders",
    "json_strict": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS sound FROM events",
    "canonical_sha": """SELECT c_custkey, sha256('{"id":' || c_custkey || ',"in":{"nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '"},"name":"' || c_name || '"}' || chr(10)) AS sha FROM customer""",
    "ws_collapse": f"SELECT doc_id, sha256({FLAT}) AS sha FROM documents",
    "slugify": "SELECT p_partkey, s AS slug, array_to_string(list_transform(string_split(s, '-'), lambda w: upper(left(w, 1)) || substring(w, 2)), ' ') AS title FROM (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part)",
    "text_hygiene": r"SELECT doc_id, length(trim(text)) > 0 AND NOT regexp_matches(text, '[\x00-\x1f\x7f\x{80}-\x{9f}]') AS clean, NOT regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{80}-\x{9f}]') AS clean_text, regexp_matches(text, '[\x{ad}\x{61c}\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{206f}\x{feff}\x{fff9}-\x{fffb}]') AS invisible FROM documents",
    "redact_kv": "SELECT c_custkey, c_name AS name, '[REDACTED]' AS api_key, '[REDACTED]' AS authorization FROM customer",
    "duration_parse": """WITH e AS (SELECT event_id, event_id AS n, [n || 's', (n % 400) || 'd' || (n % 24) || 'h', (n % 50) || '.5h', n || 'ms', n || 'h 2m', n || 'y', event_type, (n % 3) || 'w' || (n % 2) || 'm'][n % 8 + 1] AS s,
CAST([n, (n % 400) * 86400 + (n % 24) * 3600, (n % 50) * 3600 + 1800, n * 0.001::DOUBLE, NULL, n * 31557600, NULL, (n % 3) * 604800 + (n % 2) * 60][n % 8 + 1] AS DOUBLE) AS x FROM events), v AS (SELECT event_id, s, CASE WHEN x > 0 AND x <= 3155760000 THEN x END AS seconds FROM e)
SELECT event_id, s, seconds, CASE WHEN seconds = round(seconds) THEN CAST(seconds AS BIGINT) END AS whole FROM v""",
    "date_normalize": r"WITH v AS (SELECT o_orderkey, [strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y-%m') || '-31', strftime(o_orderdate, '%Y-%-m-%-d'), '0001-01-01', strftime(o_orderdate, '%Y-%m-%dT%H')][o_orderkey % 5 + 1] AS s FROM orders) SELECT o_orderkey, s, CASE WHEN regexp_matches(s, '^\d{4}-\d{2}-\d{2}$') AND s NOT IN ('0001-01-01', '9999-12-31') AND try_cast(s AS DATE) IS NOT NULL THEN s END AS day FROM v",
    "time_normalize": """WITH e AS (SELECT event_id, date_trunc('second', ts) AS t FROM events) SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(t, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(t - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(t + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%SZ') END AS t FROM e""",
    "ts_key": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T23:59:59.999999Z' ELSE strftime(o_orderdate - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') || '.000000Z' END AS key FROM orders",
    "tags_normalize": "SELECT doc_id, lang || ',' || source AS tags FROM documents",
    "reserved_intersect": "SELECT * FROM (VALUES ('notes'), ('loops')) t(name)",
    "format_span": """WITH v AS (SELECT event_id, value * 1000 AS x, CAST(round_even(value * 1000, 0) AS BIGINT) AS r FROM events), p AS (SELECT event_id, x, list_filter([CASE WHEN r // 604800 > 0 THEN (r // 604800) || 'w' END, CASE WHEN r % 604800 // 86400 > 0 THEN (r % 604800 // 86400) || 'd' END, CASE WHEN r % 86400 // 3600 > 0 THEN (r % 86400 // 3600) || 'h' END, CASE WHEN r % 3600 // 60 > 0 THEN (r % 3600 // 60) || 'm' END, CASE WHEN r % 60 > 0 THEN (r % 60) || 's' END], lambda y: y IS NOT NULL) AS u FROM v)
        SELECT event_id, CASE WHEN x < 1 THEN greatest(0, CAST(round_even(x * 1000, 0) AS BIGINT)) || 'ms' ELSE array_to_string(u[1:2], '') END AS span FROM p""",
    "cron_prev_weekdays": """WITH e AS (SELECT event_id, date_trunc('second', ts) + INTERVAL 330 MINUTE - INTERVAL 1 MICROSECOND AS t FROM events), d AS (SELECT *, dayofweek(t) AS w FROM e)
        SELECT event_id, strftime(CASE WHEN w IN (1, 5) THEN date_trunc('hour', t) + CASE WHEN minute(t) >= 30 THEN INTERVAL 30 MINUTE ELSE INTERVAL 0 MINUTE END
        ELSE date_trunc('day', t) - INTERVAL 30 MINUTE - CASE w WHEN 2 THEN INTERVAL 0 DAY WHEN 3 THEN INTERVAL 1 DAY WHEN 4 THEN INTERVAL 2 DAY WHEN 6 THEN INTERVAL 0 DAY WHEN 0 THEN INTERVAL 1 DAY END END, '%Y-%m-%dT%H:%M:%S') AS fired FROM d""",
    "cron_prev": "SELECT event_id, strftime(CASE WHEN ts > date_trunc('day', ts) + INTERVAL 390 MINUTE THEN date_trunc('day', ts) + INTERVAL 390 MINUTE ELSE date_trunc('day', ts) - INTERVAL 1050 MINUTE END, '%Y-%m-%dT%H:%M:%S') AS fired FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)",
    "attrs_map": "SELECT c_custkey, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer",
    "link_query_map": "SELECT page_id, 'id' AS k, CAST(page_id AS VARCHAR) AS v FROM pages",
    "headings_regex": "SELECT conv_id, turn, 'Turn ' || turn || '|' || role AS heads FROM conversations",
    "html_strip": f"SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&apos;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&'), '{WS}', ' ', 'g'))) AS sha FROM pages",
    "session_rollup": "SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS prompts, coalesce(substring(arg_min(text, turn) FILTER (WHERE role = 'user'), 1, 80), '') AS title FROM conversations GROUP BY conv_id",
    "tasks_explode": "SELECT 'concepts/doc-' || doc_id || '.md' AS ref, t AS text, d AS done, 'links' AS section FROM documents, LATERAL (SELECT unnest(['check ' || lang, 'done']) AS t, unnest([false, true]) AS d)",
    "headings_explode": "SELECT 'concepts/doc-' || doc_id || '.md' AS ref, h AS id, l AS level FROM documents, LATERAL (SELECT unnest(['top', 'links']) AS h, unnest([1::INTEGER, 2::INTEGER]) AS l)",
    "note_outline": "SELECT 'concepts/doc-' || doc_id || '.md' AS ref, 'Document ' || doc_id AS title, CAST(1 AS BIGINT) AS tasks_open FROM documents",
    "frontmatter_split": "SELECT doc_id, 'type: doc' || chr(10) || 'status: draft' || chr(10) || 'tags: [' || lang || ']' AS block, CAST(length('# Document ' || doc_id || ' {#top}' || chr(10) || chr(10) || regexp_replace(text, '[\\[\\]<>`#{}]', '', 'g') || chr(10) || chr(10) || '## Links' || chr(10) || chr(10) || '[next](doc-' || (doc_id + 1) || '.md#top) and src1:x' || chr(10) || chr(10) || '- [ ] check ' || lang || chr(10) || '- [x] done' || chr(10)) AS BIGINT) AS body_chars FROM documents",
    "link_normalize": """SELECT doc_id, raw, "to", kind, anchor FROM documents, LATERAL (SELECT unnest(['doc-7.md#top', 'src2:' || doc_id, 'https://x.example/' || doc_id, 'bf:///projects/plan', 'bf://other/concepts/a.md', 'javascript:x', '../../x.md']) AS raw,
        unnest(['concepts/doc-7.md', 'memories/src2/' || sha256(CAST(doc_id AS VARCHAR)) || '.json', 'https://x.example/' || doc_id, 'projects/plan.md', 'bf://other/concepts/a.md', NULL, NULL]) AS "to", unnest(['note', 'record', 'url', 'note', 'brain', NULL, NULL]) AS kind, unnest(['top', '', '', '', '', NULL, NULL]) AS anchor)""",
    "eval_expectations": f"""WITH m AS (SELECT 'regex' AS c, doc_id FROM documents WHERE regexp_matches(text, '{PATTERN}', 'i') UNION ALL SELECT 'english', doc_id FROM documents WHERE lang = 'en'),
        c AS (SELECT unnest(['regex', 'english']) AS c)
        SELECT c AS "case", NOT EXISTS (SELECT 1 FROM documents d WHERE lang = 'en' AND doc_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM m WHERE m.c = c.c AND m.doc_id = d.doc_id)) AND NOT EXISTS (SELECT 1 FROM m JOIN documents d USING (doc_id) WHERE m.c = c.c AND d.lang = 'de') AS ok FROM c""",
    "envelope_parse": "SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS title, CASE WHEN o_custkey % 3 = 0 THEN CAST(2 AS BIGINT) END AS missing, CAST(NULL AS VARCHAR) AS problem FROM orders",
    "schema_violations": """WITH v AS (SELECT doc_id, list_filter([CASE WHEN length(CAST(doc_id AS VARCHAR)) > 3 THEN 'id: maxLength' END, CASE WHEN doc_id % 2 = 1 THEN 'title: pattern' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'lang: enum' END, CASE WHEN n_chars < 100 THEN 'n_chars: minimum' END], lambda x: x IS NOT NULL) AS p FROM documents) SELECT doc_id, array_to_string(list_sort(p), '; ') AS problems FROM v WHERE len(p) > 0""",
}
QUERIES = {
    f.__name__: f
    for f in (
        scan_records, list_paths, note_fields, note_link_fields, section_assign, section_extract, section_at_anchor, note_snippets, point_reads, filter_scope_folder, filter_scope_note, walk_order, record_path, search_regex, search_literal, search_line, search_snippet, search_page, filter_source, filter_kind, filter_scope_prefix, project_fields, limit_truncated,
        search_then_project, search_then_jq, point_read_ref, alias_lookup, line_slice, byte_budget, tsv_rows, status_counts, open_tasks_total, json_strict, canonical_sha, ws_collapse, slugify, text_hygiene, redact_text, redact_kv,
        duration_parse, date_normalize, time_normalize, ts_key, tags_normalize, reserved_intersect, path_predicates, format_span, cron_prev, cron_prev_weekdays, attrs_map, link_query_map, headings_regex, html_to_text, html_strip,
        session_rollup, compile_notes, note_outline, tasks_explode, headings_explode, frontmatter_split, link_normalize, eval_expectations, envelope_parse, schema_violations,
    )
}

"""A command line over a store folder: python -m recordmill.cli ROOT COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill import server
from recordmill import store as stores
from recordmill.functions import values as V
from recordmill.operators import search
from recordmill.plans.jq.compiler import jq
from recordmill.plans.jq.syntax import JqError
from recordmill.sources import notes, records, settings


def show(rows: DataFrame, form: str) -> None:
    """json, jsonl or tsv; a limit has been set before. Control and format characters are escaped."""
    if form == "tsv":
        print("\t".join(rows.columns))
        cells = [F.to_json(c) if t.startswith(("array", "struct", "map")) else c for c, t in rows.dtypes]
        for r in rows.select(F.concat_ws("\t", *(V.tsv_cell(F.col(c) if isinstance(c, str) else c) for c in cells)).alias("line")).collect():
            print(r.line)
        return
    line = V.escape_invisible(F.to_json(F.struct(*rows.columns)), V.TERMINAL)
    found = [r.line for r in rows.select(line.alias("line")).collect()]
    print("[" + ",\n ".join(found) + "]" if form == "json" else "\n".join(found))


def tell(value: object) -> None:
    print(json.dumps(value, ensure_ascii=False, indent=1))


def given(path: str) -> bytes:
    """A file's bytes, or those of the standard input for -."""
    return sys.stdin.buffer.read() if path == "-" else Path(path).read_bytes()


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="recordmill")
    out.add_argument("root")
    out.add_argument("--format", choices=("json", "jsonl", "tsv"), default="json")
    commands = out.add_subparsers(dest="command", required=True)
    query = commands.add_parser("query", help="search by pattern, jq program, scope, kind and source")
    query.add_argument("pattern", nargs="?")
    for name in ("--jq", "--scope", "--kind", "--source", "--fields"):
        query.add_argument(name)
    query.add_argument("--limit", type=int, default=search.DEFAULT)
    read = commands.add_parser("read", help="one note, section or record")
    read.add_argument("target")
    read.add_argument("--outline", action="store_true")
    read.add_argument("--lines", help="START[:COUNT]")
    read.add_argument("--fields")
    read.add_argument("--max-bytes", type=int)
    for name in ("review", "check"):
        commands.add_parser(name).add_argument("--now", default=stores.now_text())
    for name in ("build", "validate", "status", "serve"):
        commands.add_parser(name)
    commands.add_parser("eval").add_argument("suite", nargs="?", default="")
    commands.add_parser("schema").add_argument("name", nargs="?")
    take = commands.add_parser("ingest", help="take in a batch of records")
    take.add_argument("source")
    take.add_argument("file", nargs="?", default="-")
    take.add_argument("--mode", choices=("upsert", "snapshot"), default="upsert")
    take.add_argument("--allow-removal", action="store_true")
    take.add_argument("--dry-run", action="store_true")
    emit = commands.add_parser("emit", help="add events, a JSON object a line")
    emit.add_argument("file", nargs="?", default="-")
    emit.add_argument("--dedupe", action="store_true")
    init = commands.add_parser("init")
    init.add_argument("name")
    new = commands.add_parser("new")
    for name in ("kind", "slug"):
        new.add_argument(name)
    return out


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.command == "init":
            settings.new_store(a.root, a.name)
        elif a.command == "new":
            print(settings.new_note(a.root, a.kind, a.slug))
        elif a.command == "schema":
            tell(stores.schema(a.name) if a.name else stores.schema_digests())
        elif a.command == "emit":
            items = [records.decode(x) for x in given(a.file).decode().splitlines() if x.strip()]
            for e in stores.Store(None, a.root).emit(items, a.dedupe):
                print(json.dumps(e, ensure_ascii=False))
        else:
            return run(a)
        return 0
    except (records.InputError, JqError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


def read_note(store: stores.Store, a: argparse.Namespace) -> dict | None:
    """A note, its outline, some of its lines, or what stands at an anchor; None if the target is no note's."""
    at = store.spark.range(1).select(notes.L.normal(F.lit(""), F.lit(a.target), store.name, False).alias("l")).select("l.*").first()  # one row
    if at["problem"] is not None or at["kind"] != "note":
        return None
    files = store.note_files().where(F.col("path") == at["to"])
    found = notes.compile_notes(files, own=store.name).join(files.select(F.col("path").alias("note"), F.col("text").alias("source_text")), F.col("path") == F.col("note"))
    if at["anchor"]:
        r = notes.at_anchor(found, at["anchor"]).first()
        if r is None:
            raise records.InputError(f"{at['to']}: no #{at['anchor']}")
        return {"ref": at["to"], "kind": "section", "anchor": at["anchor"], r["what"]: r["value"] if r["what"] == "section" else json.loads(r["value"])}
    if a.lines:
        start, _, count = a.lines.partition(":")
        if not (start.isdigit() and int(start) and (not count or count.isdigit())):
            raise records.InputError("lines are START[:COUNT] from 1")
        rows = found.select("ref", "kind", V.line_slice(F.col("source_text"), int(start), int(count or 200)).alias("content"))
    else:
        rows = search.outline(found) if a.outline else found.drop("note", "source_text", "marks", "raw_links")
    line = rows.select(F.to_json(F.struct("*")).alias("j")).first()
    if line is None:
        raise records.InputError(f"no note {at['to']}")
    return json.loads(line["j"])


def run(a: argparse.Namespace) -> int:
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.scheduler.mode", "FAIR").getOrCreate()
    store = stores.Store(spark, a.root)
    if a.command == "query":
        rows = store.records()
        fields = tuple(a.fields.split(",")) if a.fields else None
        q = search.Query(pattern=a.pattern, scope=a.scope, kind=a.kind, source=a.source, limit=a.limit)
        if not search.LEAST <= a.limit <= search.MOST:
            raise records.InputError(f"limit is {search.LEAST} to {search.MOST}")
        if a.jq:
            show(jq(q.rows(rows, F.col("line")).drop("line").orderBy(F.split("path", "/")), a.jq, "path").limit(a.limit), a.format)
        else:
            page = search.limited(q.rows(rows, F.col("line")), a.limit, "path")
            shown = page.withColumn("snippet", search.snippet(F.col("text"), a.pattern or "^")).drop("text", "line")
            show(shown.select(*(f for f in fields if f in shown.columns)) if fields else shown, a.format)
    elif a.command == "read":
        found = read_note(store, a)
        if found is None:
            r = search.point_read(store.records(), a.target, store.name).first()
            if r is None:
                raise records.InputError(f"nothing at {a.target}")
            found = {"ref": r["ref"], "kind": r["kind"], "path": r["path"], "record": json.loads(r["line"])}
        if a.fields:
            found = {k: found[k] for k in a.fields.split(",") if k in found}
        tell(search.within_bytes(found, a.max_bytes) if a.max_bytes else found)
    elif a.command == "review":
        show(store.review(a.now).limit(search.MOST), a.format)
    elif a.command == "validate":
        problems = store.validate()
        show(problems.orderBy("kind", "ref", "msg").limit(search.MOST), a.format)
        return int(not problems.isEmpty())
    elif a.command == "build":
        made = store.build()
        tell(made)
        return int(bool(made["problems"]))
    elif a.command == "ingest":
        tell(store.ingest(a.source, given(a.file), a.mode, a.allow_removal, a.dry_run, datetime.now(timezone.utc)))
    elif a.command == "serve":
        server.serve(store)
    elif a.command == "eval":
        found = store.evaluate(a.suite)
        tell(found)
        return int(not found["ok"])
    elif a.command == "check":
        found = store.check(a.now)
        tell(found)
        return int(not found["ok"])
    else:
        tell(store.status())
    return 0


if __name__ == "__main__":
    sys.exit(main())

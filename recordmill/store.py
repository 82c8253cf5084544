"""A store as a folder of notes and records: building, taking in batches, its event log, runs, evals and checks.

Plans do the work on notes and records; what is written in one place by one process at a time (the log, states) is
small and written by the driver, whole or not at all.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from concurrent.futures import Future
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone
from pathlib import Path
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.functions import values as V
from recordmill.functions.cron import previous
from recordmill.operators import events as E
from recordmill.operators import graph, ingest, review, schemas, search
from recordmill.plans.jq.compiler import jq
from recordmill.sources import notes, records, settings
from recordmill.sources.records import InputError
from recordmill.streaming.units import Flights

# What a log keeps, how much of the log a repeat is looked for in, and how many rows an eval looks at.
LOG_LINES, LOG_BYTES, SEARCHED, EVAL_ROWS = 200, 1 << 20, 16 << 20, {"rg": 200, "jq": 500}
PRIVATE, EVENTS = ".store", "events.jsonl"
#: What every record has to be; a source may add to it (fixed values of the record format).
TEXT = {"type": "string", "minLength": 1}
RECORD_SCHEMA = {
    "$schema": "https://json-schema.org/draft/2020-12/schema",
    "title": "Record",
    "type": "object",
    "required": ["ref", "source", "kind", "title", "id"],
    "properties": {
        **{k: TEXT | {"maxLength": 4096} for k in ("id", "title", "entity")},
        **{k: TEXT | {"maxLength": 128} for k in ("type", "status")},
        **{k: {"type": "string", "maxLength": 16384} for k in ("summary", "description")},
        "ref": TEXT | {"maxLength": 4200},
        "source": {"type": "string", "pattern": V.NAME},
        "kind": {"enum": ["project", "concept", "action", "memory"]},
        "text": {"type": "string", "maxLength": 4 << 20},
        "url": {"type": "string", "maxLength": 8192},
        "tags": {"type": "array", "maxItems": 200, "uniqueItems": True, "items": TEXT},
        "aliases": {"type": "array", "maxItems": 200, "items": TEXT | {"maxLength": 1024}},
        "links": {"type": "array", "maxItems": 2000},
    },
}
EVENT_SCHEMA = {
    "title": "Event",
    "type": "object",
    "required": ["seq", "id", "time", "kind", "source", "data"],
    "properties": {"seq": {"type": "integer", "minimum": 1}, "id": TEXT, "time": TEXT, "kind": {"type": "string", "pattern": V.EVENT_KIND}, "source": {"type": "string", "pattern": V.NAME}, "data": {"type": "object"}},
}
SCHEMAS = {"record": RECORD_SCHEMA, "event": EVENT_SCHEMA}


def scheduled(unit: dict, anchor: str, at: datetime) -> bool:
    """Whether a unit's schedule is due: without an anchor, when so many seconds have passed, or when its cron expression
    has fired since, on the clocks of its zone. A unit with both is due by either."""
    if not (unit.get("every") or unit.get("cron")):
        return False
    zone = ZoneInfo(unit.get("zone", "UTC"))
    fired = previous(unit["cron"], (at.replace(microsecond=0) + timedelta(seconds=1)).astimezone(zone)) if unit.get("cron") else None
    if not anchor:
        return True
    last = datetime.fromisoformat(anchor)
    return bool(unit.get("every") and (at - last).total_seconds() >= unit["every"]) or (fired is not None and last < fired)


def now_text(now: datetime | None = None) -> str:
    return (now or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def log_line(message: str, severity: str = "INFO", **fields: object) -> str:
    """One line of a log: time, severity, message and fields, without secrets."""
    return records.canonical(V.redact_variant({"severity": severity, "message": message, **fields})).rstrip("\n")


def substituted(template: str, values: dict[str, str]) -> str:
    """{{name}} replaced by its value; a name without one is an error."""

    def one(m: re.Match) -> str:
        if m[1] not in values:
            raise InputError(f"no value for {m[1]}")
        return values[m[1]]

    return re.sub(r"\{\{\s*([A-Za-z_][A-Za-z0-9_.]*)\s*\}\}", one, template)


def kept_tail(lines: list[bytes], most: int, size: int) -> list[bytes]:
    """The newest lines that fit both bounds."""
    out, total = [], 0
    for line in reversed(lines[-most:]):
        total += len(line)
        if total > size:
            break
        out.append(line)
    return out[::-1]


class Store:
    """A folder with projects, concepts, actions and memories."""

    def __init__(self, spark: SparkSession | None, root: str):
        self.spark, self.root = spark, Path(root).absolute()

    # ---- places

    @property
    def private(self) -> Path:
        found = self.root / PRIVATE
        found.mkdir(parents=True, exist_ok=True)
        return found

    @property
    def name(self) -> str:
        place = self.root / "store.yaml"
        return str(notes.yaml_map(place.read_text(encoding="utf-8")).get("name", "")) if place.exists() else ""

    @contextmanager
    def writer(self):
        """One writer at a time; a lock that a dead process left is taken over."""
        lock = self.private / "lock"
        for _ in range(200):
            try:
                os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
                break
            except FileExistsError:
                if time.time() - lock.stat().st_mtime > 60:
                    lock.unlink(missing_ok=True)
                time.sleep(0.05)
        else:
            raise InputError("another process is writing")
        try:
            yield
        finally:
            lock.unlink(missing_ok=True)

    # ---- tables

    def note_files(self) -> DataFrame:
        return records.checked_count(records.read_tree(self.spark, str(self.root), "md", 4 << 20)).where(V.note_role(F.col("path")).isNotNull())

    def notes(self) -> DataFrame:
        """Compiled notes; a note that is too large comes with a problem."""
        files = self.note_files()
        found = notes.compile_notes(files.where("text is not null"), own=self.name)
        return found

    def record_files(self) -> DataFrame:
        return records.parsed(records.read_tree(self.spark, str(self.root), "json").where(V.is_record_path(F.col("path"))))

    def records(self) -> DataFrame:
        """Stored records and notes: path, ref, source, kind, id, title, text, updated, entity, aliases and line."""
        field = lambda n: F.variant_get("doc", f"$.{n}", "string")
        aliases = F.try_variant_get("doc", "$.aliases", "array<string>")
        stored = self.record_files().where("problem is null")
        stored = stored.select("path", *(F.coalesce(field(n), F.lit("")).alias(n) for n in ("ref",)), field("source").alias("source"), F.lit("memory").alias("kind"), *(field(n).alias(n) for n in ("id", "title", "text", "updated", "entity")), aliases.alias("aliases"), F.rtrim("text", F.lit("\n")).alias("line"))
        authored = self.notes().where("problem is null")
        shown = F.to_json(F.struct("ref", "source", "kind", "title", "text", "tags", "status", "updated", "headings", "elements", "tasks", "links"))
        authored = authored.select("path", "ref", "source", "kind", F.lit(None).cast("string").alias("id"), "title", "text", "updated", "entity", "aliases", shown.alias("line"))
        return stored.unionByName(authored)

    # ---- notes to records

    def build(self, check_only: bool = False) -> dict:
        """Compiled notes as files under memories, those that changed only; files without a note go. Counts of each."""
        found = self.notes()
        bad = found.where("problem is not null").select("path", "problem").orderBy("path").limit(search.MOST).collect()
        shown = ["ref", "source", "kind", "title", "type", "status", "updated", "stale_after", "entity", "aliases", "tags", "sources", "text", "headings", "links", "elements", "tasks", "attrs", "sha256"]
        good = found.where("problem is null").select(V.compiled_path(F.col("path")).alias("path"), F.to_json(F.struct(*shown)).alias("text"))
        lines = records.canonical_lines(good).select("path", F.rtrim("line", F.lit("\n")).alias("line"))
        new = lines.select("path", F.sha2("line", 256).alias("sha"), "line")
        old = records.read_tree(self.spark, str(self.root), "json").where(F.col("path").rlike("^memories/(projects|concepts|actions)/"))
        old = old.select("path", F.sha2(F.rtrim("text", F.lit("\n")), 256).alias("sha"))
        actions = ingest.diff(new, old, mode="snapshot", key="path").cache()
        try:
            counts = {r["action"]: r["n"] for r in actions.groupBy("action").agg(F.count("*").alias("n")).collect()}
            if not check_only:
                with self.writer():
                    records.write_tree(new.join(actions.where("action in ('added', 'updated')").select("path"), "path"), str(self.root))
                    for r in actions.where("action = 'removed'").select("path").toLocalIterator():
                        records.delete_file(self.root / r["path"])
                    self.write_index()
        finally:
            actions.unpersist()
        return {"notes": sum(counts.get(k, 0) for k in ("added", "updated", "unchanged")), **{k: counts.get(k, 0) for k in ("added", "updated", "unchanged", "removed")}, "problems": [f"{r['path']}: {r['problem']}" for r in bad]}

    def write_index(self) -> None:
        """What is where, without texts: one table, partitioned by nothing, replaced as a whole."""
        place = self.private / f"index-{uuid.uuid4().hex}"
        rows = self.records().select("path", "ref", "source", "kind", "id", "title", "updated", "entity", "aliases")
        rows.write.parquet(f"file://{place}")
        records.replace_file(self.private / "index.current", place.name.encode())
        for other in self.private.glob("index-*"):
            if other != place:
                for f in other.iterdir():
                    f.unlink()
                other.rmdir()

    def index(self) -> DataFrame:
        """The index, made anew where a file is newer than it, is not in it, or is gone."""
        current = self.private / "index.current"
        if current.exists():
            made = current.stat().st_mtime
            found = self.spark.read.parquet(f"file://{self.private / current.read_text()}")
            files = records.read_tree(self.spark, str(self.root), "json").where(V.is_record_path(F.col("path"))).select("path", "modified")
            files = files.unionByName(self.note_files().select("path", "modified"))
            other = files.join(found.select("path", F.lit(True).alias("known")), "path", "full_outer").where(F.col("known").isNull() | F.col("modified").isNull() | (F.col("modified") > F.lit(datetime.fromtimestamp(made, timezone.utc))))
            if other.isEmpty():
                return found
        with self.writer():
            self.write_index()
        return self.spark.read.parquet(f"file://{self.private / current.read_text()}")

    # ---- batches

    def ingest(self, source: str, data: bytes, mode: str = "upsert", allow_removal: bool = False, dry_run: bool = False, now: datetime | None = None) -> dict:
        """Take in a batch: what is new or changed is written, what is gone or forgotten removed, all else untouched."""
        if not re.fullmatch(V.NAME, source) or source in V.RESERVED:
            raise InputError("a source is a lower-case name that isn't reserved")
        items, missing = records.parse_batch(data)
        stamp, prepared = now_text(now), []
        for i, item in enumerate(items):
            prepared.append(self.prepared(source, i, item))
        ids = [r["id"] for r, _ in prepared]
        if len(set(ids)) < len(ids):
            raise InputError(f"{source}: an id comes twice in the batch")
        rows = [(r["id"], records.canonical({k: v for k, v in r.items() if dated or k != "updated"}).rstrip("\n"), records.canonical(r if dated else r | {"updated": stamp}).rstrip("\n"), dated) for r, dated in prepared]
        batch = self.spark.createDataFrame(rows, "id string, core string, line string, dated boolean")
        batch = batch.withColumn("path", V.record_path(F.lit(source), F.col("id")))
        self.check_schema(batch, source)
        stored = self.record_files().where(F.col("path").startswith(f"memories/{source}/")).select("path", "text")
        dates = batch.select("path", "dated")
        stored = records.canonical_lines(stored.join(dates, "path", "left").withColumn("text", F.coalesce("text", F.lit("{}"))))
        undated = F.regexp_replace("line", r',"updated":"[^"]*"(?=[,}])', "")
        stored = stored.select("path", F.rtrim(F.when(F.col("dated") | F.col("dated").isNull(), F.col("line")).otherwise(undated), F.lit("\n")).alias("core"))
        tombs = self.root / "memories" / source / ".forgotten"
        gone = records.forgotten_ids(tombs.read_text(encoding="utf-8")) if tombs.exists() else []
        forgotten = self.spark.createDataFrame([(g,) for g in gone], "id string").select(V.record_path(F.lit(source), F.col("id")).alias("path"))
        actions = ingest.diff(batch, stored, forgotten, mode, missing is None, "path", "core").cache()
        try:
            counts = ingest.counters(actions).first().asDict()
            if mode == "snapshot" and missing is None and not allow_removal and ingest.guard(actions).first()["blocked"]:
                raise InputError(f"{source}: the snapshot removes too many records")
            left = sum(counts[k] for k in ("added", "updated", "unchanged", "kept"))
            if not dry_run:
                with self.writer():
                    records.write_tree(batch.join(actions.where("action in ('added', 'updated')").select("path"), "path"), str(self.root))
                    for r in actions.where("action = 'removed'").select("path").toLocalIterator():
                        records.delete_file(self.root / r["path"])
                if counts["added"] or counts["updated"] or counts["removed"]:
                    self.append("records.ingested", source, {"records": left} | {k: counts[k] for k in ("added", "updated", "removed")}, now=now)
        finally:
            actions.unpersist()
        return {"source": source, "mode": mode, "records": left, **{k: counts[k] for k in ("added", "updated", "unchanged", "removed", "forgotten")}, "incomplete": missing is not None, "dry_run": dry_run}

    def prepared(self, source: str, i: int, item: dict) -> tuple[dict, bool]:
        """A record with its reference, and whether it brings its own date."""
        record_id, title = item.get("id"), item.get("title")
        if not isinstance(record_id, str) or not record_id or re.search(r"\s", record_id) or not isinstance(title, str) or not title.strip():
            raise InputError(f"{source}[{i}]: a record needs an id without spaces and a title")
        own = {"source": source, "kind": "memory", "ref": f"{source}:{record_id}"}
        if wrong := [k for k, v in own.items() if item.get(k, v) != v]:
            raise InputError(f"{source}[{i}]: {', '.join(wrong)} can't be set")
        return item | own, "updated" in item

    def check_schema(self, batch: DataFrame, source: str) -> None:
        """The first records that the record's schema or the source's own doesn't take are an error."""
        fields = "id string, ref string, source string, kind string, title string, text string, url string, type string, status string, summary string, description string, entity string, tags array<string>, aliases array<string>, links array<string>"
        typed = batch.select(F.from_json("line", fields).alias("r")).select("r.*")
        bad = schemas.violations(typed, RECORD_SCHEMA, "id")
        place = self.root / "schemas" / f"{source}.json"
        if place.exists():
            own = records.decode(place.read_text(encoding="utf-8"))
            typed = batch.select(F.from_json("line", schemas.fields_of(own)).alias("r")).select("r.*")
            bad = bad.unionByName(schemas.violations(typed, own, "id"))
        found = bad.orderBy("id").limit(5).collect()
        if found:
            raise InputError("; ".join(f"{source}:{r['id']}: {r['problems']}" for r in found))

    # ---- events

    def events(self) -> DataFrame:
        place = self.private / EVENTS
        lines = place.read_text(encoding="utf-8").splitlines() if place.exists() else []
        return self.spark.createDataFrame([(x,) for x in lines], "line string").select(F.from_json("line", "seq long, id string, time string, kind string, source string, data map<string,string>").alias("e")).select("e.*")

    def latest_seq(self) -> int:
        place = self.private / EVENTS
        if not place.exists() or not place.stat().st_size:
            return 0
        with open(place, "rb") as f:
            f.seek(max(0, place.stat().st_size - (1 << 20)))
            return json.loads(f.read().splitlines()[-1])["seq"]

    def append(self, kind: str, source: str, data: dict | None = None, dedupe: bool = False, now: datetime | None = None) -> dict:
        """Add an event to the log; with dedupe, one with the same kind, source and data.id is returned instead."""
        return self.emit([{"kind": kind, "source": source, "data": data or {}}], dedupe, now)[0]

    def emit(self, items: list[dict], dedupe: bool = False, now: datetime | None = None) -> list[dict]:
        """Add events, all or none: every item is checked before the first is written. Secrets are taken out."""
        for i, item in enumerate(items):
            sound = isinstance(item, dict) and set(item) <= {"kind", "source", "data"} and re.fullmatch(V.EVENT_KIND, str(item.get("kind", ""))) and re.fullmatch(V.NAME, str(item.get("source", ""))) and isinstance(item.get("data", {}), dict)
            if not sound:
                raise InputError(f"event {i + 1}: kind, source or data is malformed")
        place, out = self.private / EVENTS, []
        with self.writer():
            lines = place.read_bytes().splitlines(keepends=True) if place.exists() else []
            known = {}
            if dedupe:
                for line in kept_tail(lines, len(lines), SEARCHED):
                    e = json.loads(line)
                    known.setdefault((e["kind"], e["source"], str(e["data"].get("id", ""))), e)
            seq, size = (json.loads(lines[-1])["seq"] if lines else 0), sum(map(len, lines))
            for item in items:
                data = V.redact_variant(item.get("data", {}))
                key = (item["kind"], item["source"], str(data.get("id", "")))
                if dedupe and key[2] and key in known:
                    out.append(known[key])
                    continue
                seq += 1
                event = {"seq": seq, "id": f"evt-{seq}-{uuid.uuid4().hex[:8]}", "time": now_text(now), "kind": item["kind"], "source": item["source"], "data": data}
                known[key] = event
                lines.append(records.canonical(event).encode())
                size += len(lines[-1])
                out.append(event)
                if E.compaction_due(seq, size) and (len(lines) > E.KEEP_LINES or size > E.COMPACT_BYTES):
                    lines = kept_tail(lines, E.KEEP_LINES, E.KEEP_BYTES)
                    size = sum(map(len, lines))
            records.replace_file(place, b"".join(lines))
            self.log("events", [log_line(e["kind"], time=e["time"], seq=e["seq"], id=e["id"], source=e["source"], data=e["data"]) for e in out])
        return out

    def log(self, name: str, lines: list[str]) -> None:
        """Lines at the end of a log that keeps its newest 200 within a MiB."""
        place = self.root / "logs" / f"{name}.log"
        place.parent.mkdir(exist_ok=True)
        old = place.read_bytes().splitlines(keepends=True) if place.exists() else []
        records.replace_file(place, b"".join(kept_tail([*old, *((x + "\n").encode() for x in lines)], LOG_LINES, LOG_BYTES)))

    # ---- consumers

    def state(self, name: str) -> dict:
        """A consumer's state; a fresh one where it has none."""
        place = self.private / f"{name}.json"
        if place.exists():
            return json.loads(place.read_text(encoding="utf-8"))
        return {"kind": "loop", "name": name, "status": "idle", "event_seq": 0, "runs": 0, "failures": 0, "consecutive_failures": 0, "duration_ms": 0, "last_start": "", "last_end": "", "last_success": "", "last_scheduled": "", "error": "", "last_run": {}}

    def set_state(self, name: str, **fields: object) -> dict:
        with self.writer():
            new = self.state(name) | fields
            records.replace_file(self.private / f"{name}.json", records.canonical(new).encode())
        return new

    def record_run(self, name: str, started: datetime, ended: datetime, code: int, error: str = "", summary: dict | None = None, cursor: int | None = None, trigger: str = "", event: bool = True) -> dict:
        """What a run did to its consumer's state, a line in its log, and an event."""
        old, ok = self.state(name), code == 0
        end, took = now_text(ended), round((ended - started).total_seconds() * 1000)
        said = "" if ok else V.redact_variant(error.strip() or f"exit code {code}")[:4096]
        fields = {"status": "ok" if ok else "failed", "last_start": now_text(started), "last_end": end, "duration_ms": took, "runs": old["runs"] + 1, "failures": old["failures"] + (not ok), "error": said}
        fields["consecutive_failures"] = 0 if ok else old["consecutive_failures"] + 1
        fields["last_run"] = V.redact_variant(summary or {})
        if ok:
            fields["last_success"] = end
            if trigger not in ("event", "hook", "daemon"):
                fields["last_scheduled"] = end
            if cursor is not None:
                log_end = self.latest_seq()
                fields["event_seq"] = old["event_seq"] if cursor > log_end else cursor if log_end < old["event_seq"] else max(old["event_seq"], cursor)
        new = self.set_state(name, **fields)
        word = f"loop.{'succeeded' if ok else 'failed'}"
        self.log(name, [log_line(word, "INFO" if ok else "ERROR", time=end, unit=name, trigger=trigger or "loop", exit_code=code, duration_ms=took, **({"error": said} if said else {}))])
        if event:
            self.append(word, name, {"exit_code": code, "duration_ms": took}, now=ended)
        return new

    def pending(self, name: str, rules: list[dict], now: datetime | None = None) -> DataFrame:
        """Events past a consumer's cursor that a rule (kind, source, jq filter) takes."""
        from recordmill.plans.jq.compiler import condition

        rows = E.after_cursor(self.events(), int(self.state(name)["event_seq"]))
        each = [(r.get("kind", ""), r.get("source", ""), condition(rows, r["where"]) if r.get("where") else None) for r in rules]
        return rows.where(E.rule_filter(each, F.col("kind"), F.col("source")))

    def begin(self, units: dict[str, dict], act, flights: Flights, now: datetime | None = None) -> list[Future]:
        """Begin the units ({events: rules, every: seconds, cron: expression, zone, cap: seconds}) that are due, in name order; their flights.

        An event comes before a schedule; after failures a unit waits, and one that is still in flight is left alone. A unit
        whose rules take nothing new still moves its cursor on; one whose rules or schedule can't be read fails by itself.
        """
        at, begun = now or datetime.now(timezone.utc), []
        for name, unit in sorted(units.items()):
            if name in flights.names():
                continue
            state = self.state(name)
            failures = state["consecutive_failures"]
            wait = min(E.BACKOFF_FIRST * 2 ** min(failures - 1, E.BACKOFF_DOUBLINGS), unit.get("cap", E.BACKOFF_CAP)) if failures else 0
            if wait and state["last_end"] and (at - datetime.fromisoformat(state["last_end"])).total_seconds() < wait:
                continue
            end = self.latest_seq()
            try:
                taken = self.pending(name, unit["events"]).orderBy("seq").limit(search.MOST).collect() if unit.get("events") else []
                due = scheduled(unit, state["last_scheduled"], at)
            except (ValueError, KeyError) as error:  # rules, cron expressions and zones that can't be read
                self.record_run(name, at, now or datetime.now(timezone.utc), 1, str(error), trigger="event")
                continue
            trigger = "event" if taken else "schedule" if due else "idle"
            if trigger == "idle":
                if unit.get("events") and end != state["event_seq"]:
                    self.set_state(name, event_seq=end)
                continue
            cursor = (taken[-1]["seq"] if len(taken) == search.MOST else end) if unit.get("events") else None
            begun.append(flights.submit(name, self.fly, act, name, trigger, taken, cursor, now)[0])
        return begun

    def fly(self, act, name: str, trigger: str, taken: list, cursor: int | None, now: datetime | None = None) -> dict:
        """Run a unit, act(name, trigger, events) giving an exit code, and record it; what it raises is its failure."""
        began, error = now or datetime.now(timezone.utc), ""
        try:
            code = act(name, trigger, taken)
        except Exception as raised:
            code, error = 1, f"{type(raised).__name__}: {raised}"
        return self.record_run(name, began, now or datetime.now(timezone.utc), code, error, cursor=cursor, trigger=trigger)

    def tick(self, units: dict[str, dict], act, now: datetime | None = None, bound: int = 1) -> list[dict]:
        """One pass over units: each that is due runs once, so many at a time; what was recorded of them, by name."""
        with Flights(self.spark, bound) as flights:
            return [flight.result() for flight in self.begin(units, act, flights, now)]

    def watch(self, units: dict[str, dict], act, passes: int, pause: float = 1.0, bound: int = 4) -> int:
        """So many passes with a pause between them; a pass that fails is held back longer each time, to a minute.

        A pass doesn't wait for the units of those before: a slow one delays no other. The last ones are waited for.
        """
        held = 0
        with Flights(self.spark, bound) as flights:
            for i in range(passes):
                try:
                    self.begin(units, act, flights)
                    held = 0
                except InputError:
                    held += 1
                if i + 1 < passes:
                    time.sleep(min(60.0, pause * 2**held))
        return held

    # ---- looking

    def status(self) -> dict:
        """How many notes, records, sources and consumers there are, open tasks, and the log's end."""
        counts = self.records().agg(F.count_if(F.col("kind") == "memory").alias("records"), F.count_distinct(F.when(F.col("kind") == "memory", F.col("source"))).alias("sources")).first()
        found = self.notes().where("problem is null")
        noted = found.agg(F.count("*").alias("notes"), F.coalesce(F.sum(F.size(F.filter("tasks", lambda t: ~t["done"]))), F.lit(0)).alias("open")).first()
        states = [json.loads(p.read_text(encoding="utf-8")) for p in sorted(self.private.glob("*.json"))]
        loops = [{k: s[k] for k in ("name", "status", "runs", "consecutive_failures", "event_seq")} for s in states if s.get("kind") == "loop"]
        return {"name": self.name, "notes": noted["notes"], "records": counts["records"], "sources": counts["sources"], "tasks_open": noted["open"], "latest_seq": self.latest_seq(), "loops": loops}

    def validate(self) -> DataFrame:
        found = self.notes()
        rows = self.records()
        links = found.select("ref", F.explode("links").alias("l")).select("ref", "l.to", "l.kind", "l.anchor", F.lit(True).alias("authored"))
        targets = rows.select(F.col("path").alias("to"))
        anchors = found.select(F.col("path").alias("to"), F.explode(F.map_keys("attrs")).alias("anchor"))
        bad = found.where("problem is not null").select(F.lit("note").alias("kind"), "ref", F.concat("path", F.lit(": "), "problem").alias("msg"))
        broken = self.record_files().where("problem is not null").select(F.lit("record").alias("kind"), F.col("path").alias("ref"), F.concat("path", F.lit(": "), "problem").alias("msg"))
        return bad.unionByName(broken).unionByName(review.validate(rows.where("kind = 'memory'"), links, targets, anchors))

    def linked(self, found: DataFrame) -> DataFrame:
        """node and other: what notes and records link to and are linked from, by path.

        A link leads to a path, to a record's reference, or, from elsewhere, to a name that a note bears as its entity or
        among its aliases; such a name counts as a link to the note, not from it.
        """
        rows = self.records()
        stated = F.coalesce(F.try_variant_get("doc", "$.links", "array<string>"), F.array().cast("array<string>"))
        each = self.record_files().where("problem is null").select(F.col("path").alias("from"), F.explode(stated).alias("to"))
        each = each.select("from", F.when(F.col("to").startswith("{"), F.get_json_object("to", "$.to")).otherwise(F.col("to")).alias("to"))
        each = each.unionByName(found.select(F.col("path").alias("from"), F.explode("links").alias("l")).select("from", F.col("l.to").alias("to"))).distinct()
        places = rows.select(F.col("path").alias("to"), F.col("path").alias("place")).unionByName(rows.where("ref != path").select(F.col("ref").alias("to"), F.col("path").alias("place"))).distinct()
        direct = each.join(places, "to").select("from", F.col("place").alias("to"))
        names = found.select(F.col("path").alias("ref"), F.explode(F.array_compact(F.concat(F.array("entity"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("identity"))
        named = graph.by_identity(each, names.where("identity != ''")).select(F.col("target").alias("node"), F.col("from").alias("other"))
        both = direct.select(F.col("from").alias("node"), F.col("to").alias("other")).unionByName(direct.select(F.col("to").alias("node"), F.col("from").alias("other"))).unionByName(named)
        return both.where("node != other").distinct()

    def review(self, now: str) -> DataFrame:
        """Stale notes and open actions, as sections; newer evidence by links of notes and records, both ways, and by names."""
        found = self.notes().where("problem is null")
        dated = found.withColumn("updated", F.coalesce("updated", review.evidence(F.col("sources"))))
        others = self.records().select(F.col("path").alias("ref"), V.ts_key(F.col("updated")).alias("ts")).where("ts is not null")
        return review.rows(review.ordered(review.stale(dated.select("ref", "status", "updated", "stale_after"), self.linked(found), others, now)), review.open_actions(found))

    def evaluate(self, wanted: str = "") -> dict:
        """The cases of the suites under evals: how many hold, and what the others fail."""
        places = sorted(p for p in (self.root / "evals").glob("*") if p.suffix in (".yaml", ".yml", ".json"))
        places = [p for p in places if not wanted or wanted in (p.name, p.stem, f"evals/{p.name}")]
        if wanted and not places:
            raise InputError(f"no suite {wanted}")
        results, problems, rows = [], [], self.records()
        for place in places:
            try:
                cases = settings.eval_suite(place.read_text(encoding="utf-8"))
            except ValueError as error:
                problems.append(f"evals/{place.name}: {error}")
                continue
            for case in cases:
                try:
                    items = self.answers(rows, case)
                    refs, text = [str(x.get("ref", "")) for x in items if isinstance(x, dict)], json.dumps(items, ensure_ascii=False).lower()
                    reasons = settings.judge(case, refs, text, items)
                except (InputError, ValueError) as error:
                    reasons = [str(error)]
                results.append({"file": f"evals/{place.name}", "name": case["name"], "ok": not reasons, "reasons": reasons})
        failed = sum(not r["ok"] for r in results)
        return {"ok": not failed and not problems, "passed": len(results) - failed, "failed": failed, "cases": results, "problems": problems}

    def answers(self, rows: DataFrame, case: dict) -> list:
        q, engine = str(case["query"]), case["engine"]
        if engine == "read":
            return [json.loads(x) for x in search.point_read(rows, q, self.name).drop("line").toJSON().collect()]
        if engine == "rg":
            found = search.Query(pattern=q, scope=case.get("scope")).rows(rows, F.col("line")).select("ref", "path", "source", "kind", "title", search.snippet(F.col("text"), q).alias("snippet"))
        else:
            found = jq(search.in_scope(rows, case.get("scope")).drop("line"), q, "path")
        shown = [json.loads(x) for x in found.limit(EVAL_ROWS[engine]).toJSON().collect()]
        return [json.loads(x["value"]) if set(x) == {"value"} and isinstance(x["value"], str) and engine == "jq" else x for x in shown]

    def check(self, now: str) -> dict:
        """Whether notes are built, the store is valid, evals hold, and how many notes want a look."""
        built = self.build(check_only=True)
        problems = self.validate().limit(search.MOST).count()
        evals = self.evaluate()
        late = self.review(now).where("section = 'stale'").count()
        stale_build = built["added"] + built["updated"] + built["removed"]
        return {"ok": not problems and evals["ok"] and not built["problems"], "unbuilt": stale_build, "problems": problems, "evals_failed": evals["failed"], "stale": late}


def schema(name: str) -> dict:
    if name not in SCHEMAS:
        raise InputError(f"schemas are {', '.join(SCHEMAS)}")
    return SCHEMAS[name]


def schema_digests() -> dict[str, str]:
    return {name: schemas.digest(s) for name, s in SCHEMAS.items()}


def resolve(root: str, others: dict[str, str], host: str) -> str:
    """The folder of the store that a name stands for: this one, or one of the others it lists."""
    if host in ("", Store(None, root).name):
        return root
    if host not in others:
        raise InputError(f"no store {host}")
    return others[host]

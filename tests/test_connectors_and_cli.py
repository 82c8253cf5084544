import json
import subprocess
import threading
import time
from datetime import datetime, timedelta, timezone

import pytest

from recordmill import cli
from recordmill import store as stores
from recordmill.sources import connectors, settings
from recordmill.sources.records import InputError
from recordmill.store import Store, substituted
from recordmill.streaming.units import Flights


def test_git_history(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    for day in (1, 2, 3):
        git("commit", "-q", "--allow-empty", "-m", f"subject {day}\n\nbody", "--date", f"2026-01-0{day}T00:00:00Z")
    connectors.register(spark)
    rows = spark.read.format("git_history").option("root", str(tmp_path)).option("start", "2026-01-02T00:00:00Z").option("end", "2026-01-03T00:00:00Z").load().collect()
    assert [(r.title, r.text, r.time) for r in rows] == [("subject 2", "body", "2026-01-02T00:00:00Z")]


def test_exports(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps([{"number": 7, "title": "T", "state": "open", "labels": [{"name": "x"}], "updated_at": "2026-01-02T00:00:00Z"}, {"number": 8, "updated_at": None}]))
    connectors.register(spark)
    rows = spark.read.format("issue_export").option("root", str(tmp_path)).option("repository", "o/r").load().collect()
    assert [(r.id, r.attributes["labels"]) for r in rows] == [("o/r/issues/7", "x")]
    mail = tmp_path / "mail"
    mail.mkdir()
    (mail / "m.jsonl").write_text(json.dumps({"id": "m1", "threadId": "t", "internalDate": "1767312000000", "headers": [{"name": "Subject", "value": "Hi"}]}) + "\n")
    rows = spark.read.format("mail_export").option("root", str(mail)).load().collect()
    assert [(r.id, r.title, r.time) for r in rows] == [("m1", "Hi", "2026-01-02T00:00:00Z")]


def test_settings():
    assert settings.read_env("# c\nA=1\nexport B='x y'\n\n") == {"A": "1", "B": "x y"}
    with pytest.raises(InputError):
        settings.read_env("nothing")
    suite = "version: 15\ncases:\n- {name: a, engine: rg, query: x, expect_refs: [r], max_count: 1}\n"
    case = settings.eval_suite(suite)[0]
    assert settings.judge(case, ["r"], "") == [] and settings.judge(case, ["q", "s"], "") == ["missing r", "too many"]
    for bad in ("version: 1\ncases: []", "version: 15\ncases: []", "version: 15\ncases:\n- {name: a, engine: rg, query: x}\n", "version: 15\nversion: 15"):
        with pytest.raises(ValueError):
            settings.eval_suite(bad)


def test_cli(spark, tmp_path, capsys):
    root = str(tmp_path / "store")
    assert cli.main([root, "init", "mine"]) == 0 and cli.main([root, "init", "mine"]) == 2
    assert cli.main([root, "new", "project", "plan"]) == 0 and cli.main([root, "new", "action", "do-it"]) == 0
    with open(f"{root}/projects/plan.md", "a") as note:
        note.write("\nSee [gone](gone.md) and [do](bf:///actions/do-it).\n\n## Late {#late}\n\nmore\n")
    capsys.readouterr()
    assert cli.main([root, "--format", "jsonl", "query", "gone", "--fields", "ref,path,none"]) == 0
    assert json.loads(capsys.readouterr().out) == {"ref": "projects/plan.md", "path": "projects/plan.md"}
    assert cli.main([root, "validate"]) == 1
    out = capsys.readouterr().out
    assert "missing projects/gone.md" in out and "do-it" not in out
    assert cli.main([root, "--format", "tsv", "query", "--jq", "{ref}"]) == 0
    assert capsys.readouterr().out.split() == ["ref", "actions/do-it/ACTION.md", "projects/plan.md"]
    assert cli.main([root, "status"]) == 0 and cli.main([root, "query", "(?=x)"]) == 2
    capsys.readouterr()
    assert cli.main([root, "read", "projects/plan#late"]) == 0 and json.loads(capsys.readouterr().out)["section"] == "more"
    assert cli.main([root, "read", "projects/plan", "--outline"]) == 0 and [h["id"] for h in json.loads(capsys.readouterr().out)["headings"]] == ["plan", "late"]
    assert cli.main([root, "read", "projects/plan", "--lines", "1:2"]) == 0 and json.loads(capsys.readouterr().out)["content"].startswith("---\ntype")
    assert cli.main([root, "read", "projects/plan", "--max-bytes", "60"]) == 0 and len(json.dumps(json.loads(capsys.readouterr().out), separators=(",", ":"))) <= 60
    assert cli.main([root, "read", "projects/none"]) == 2 and cli.main([root, "schema", "record"]) == 0 and cli.main([root, "schema", "x"]) == 2


def test_build(spark, tmp_path):
    root = tmp_path / "store"
    settings.new_store(str(root), "mine")
    for name in ("one", "two"):
        settings.new_note(str(root), "concept", name)
    store = Store(spark, str(root))
    assert {k: v for k, v in store.build().items() if v} == {"notes": 2, "added": 2}
    (root / "concepts/one.md").write_text("# Other\n")
    (root / "concepts/two.md").unlink()
    (root / "projects/bad.md").write_text("---\na: 1\na: 2\n---\n")
    made = store.build()
    assert (made["notes"], made["updated"], made["removed"], len(made["problems"])) == (1, 1, 1, 1)
    assert json.loads((root / "memories/concepts/one.json").read_text())["title"] == "Other" and not (root / "memories/concepts/two.json").exists()
    assert not list(root.rglob("*.new")) and store.index().count() == 1
    settings.new_note(str(root), "action", "late")
    assert store.index().count() == 2
    store.set_state("job", runs=3)
    status = store.status()
    assert (status["name"], status["notes"], status["records"], status["loops"][0]["runs"]) == ("mine", 2, 0, 3)


def test_ingest(spark, tmp_path):
    root = tmp_path / "store"
    settings.new_store(str(root), "mine")
    store = Store(spark, str(root))
    batch = lambda *rows: json.dumps([{"id": i, "title": t} for i, t in rows]).encode()
    many = [(f"r{i}", "x") for i in range(10)]
    first = store.ingest("src", batch(*many))
    assert (first["added"], first["records"]) == (10, 10) and len(list((root / "memories/src").glob("*.json"))) == 10
    kept = {p: p.stat().st_mtime_ns for p in (root / "memories/src").glob("*.json")}
    again = store.ingest("src", batch(("r0", "x"), ("r1", "new")))
    assert (again["unchanged"], again["updated"], again["removed"]) == (1, 1, 0)
    assert sum(p.stat().st_mtime_ns != t for p, t in kept.items()) == 1
    assert store.ingest("src", batch(("r0", "x")), dry_run=True)["dry_run"]
    with pytest.raises(InputError):
        store.ingest("src", batch(("r0", "x")), "snapshot")
    partial = json.dumps({"records": [{"id": "r0", "title": "x"}], "incomplete": True}).encode()
    assert store.ingest("src", partial, "snapshot")["removed"] == 0
    (root / "memories/src/.forgotten").write_text("# gone\nr3\n")
    assert store.ingest("src", batch(("r3", "x")))["removed"] == 1
    assert store.ingest("src", batch(("r0", "x")), "snapshot", allow_removal=True)["removed"] == 8
    log = [json.loads(x) for x in (root / ".store/events.jsonl").read_text().splitlines()]
    assert [e["seq"] for e in log] == [1, 2, 3, 4] and log[0]["data"]["added"] == 10 and store.latest_seq() == 4
    for bad in (batch(("a b", "x")), batch(("a", "")), batch(("a", "x"), ("a", "y")), json.dumps([{"id": "a", "title": "t", "kind": "note"}]).encode(), json.dumps([{"id": "a", "title": "t", "tags": ["x", "x"]}]).encode()):
        with pytest.raises(InputError):
            store.ingest("src", bad)
    with pytest.raises(InputError):
        store.ingest("projects", b"[]")
    (root / "schemas/src.json").write_text(json.dumps({"required": ["level"], "properties": {"level": {"type": "integer", "maximum": 3}}}))
    with pytest.raises(InputError):
        store.ingest("src", json.dumps([{"id": "a", "title": "t", "level": 4}]).encode())
    assert store.ingest("src", json.dumps([{"id": "a", "title": "t", "level": 2}]).encode())["added"] == 1


def test_events_and_runs(tmp_path, capsys):
    store = Store(None, str(tmp_path))
    first = store.append("note.made", "src", {"id": "a", "password": "hush", "text": "api_key=abcdefgh"}, dedupe=True)
    assert first["data"] == {"id": "a", "password": "[REDACTED]", "text": "[REDACTED]"}
    assert store.append("note.made", "src", {"id": "a"}, dedupe=True) == first and store.append("note.made", "src", {"id": "a"})["seq"] == 2
    with pytest.raises(InputError):
        store.emit([{"kind": "ok", "source": "src"}, {"kind": "Bad", "source": "src"}])
    assert store.latest_seq() == 2
    for i in range(250):
        store.log("x", [f"line {i}"])
    assert len((tmp_path / "logs/x.log").read_text().splitlines()) == 200
    at = datetime(2026, 1, 1, tzinfo=timezone.utc)
    assert store.record_run("job", at, at, 1, "api_key=abcdefgh", cursor=2)["error"] == "[REDACTED]"
    done = store.record_run("job", at, at, 0, cursor=2)
    assert (done["runs"], done["failures"], done["consecutive_failures"], done["event_seq"], done["status"]) == (2, 1, 0, 2, "ok")
    assert store.latest_seq() == 4 and store.state("new")["status"] == "idle"
    with store.writer():
        assert (tmp_path / ".store/lock").exists()
    assert substituted("a {{ x }} {{y.z}}", {"x": "1", "y.z": "2"}) == "a 1 2"
    with pytest.raises(InputError):
        substituted("{{no}}", {})


def test_log_is_compacted(tmp_path, monkeypatch):
    monkeypatch.setattr(stores.E, "KEEP_LINES", 10)
    monkeypatch.setattr(stores.E, "COMPACT_EVERY", 5)
    store = Store(None, str(tmp_path))
    store.emit([{"kind": "k", "source": "s"}] * 23)
    assert [json.loads(x)["seq"] for x in (tmp_path / ".store/events.jsonl").read_text().splitlines()] == list(range(11, 24))


def test_tick(spark, tmp_path):
    store, acted = Store(spark, str(tmp_path)), []

    def act(name, trigger, events):
        acted.append((name, trigger, [e["seq"] for e in events]))
        return int(name == "fails")

    store.emit([{"kind": "a", "source": "s"}, {"kind": "b", "source": "s", "data": {"n": 5}}])
    units = {"one": {"events": [{"kind": "a"}]}, "two": {"events": [{"kind": "none"}]}, "clock": {"every": 60}, "fails": {"every": 1}}
    at = datetime(2026, 1, 1, tzinfo=timezone.utc)
    store.tick(units, act, at)
    assert acted == [("clock", "schedule", []), ("fails", "schedule", []), ("one", "event", [1])]
    assert store.state("two")["event_seq"] >= 2  # idle, but its cursor moves on
    acted.clear()
    store.tick(units, act, at + timedelta(seconds=30))
    assert acted == []  # nothing is due, and what failed waits a minute
    store.tick(units, act, at + timedelta(seconds=61))
    assert acted == [("clock", "schedule", []), ("fails", "schedule", [])]


def test_units_side_by_side(spark, tmp_path):
    """A slow unit delays no other, isn't begun twice, and what one raises touches no other; their jobs overlap."""
    store, gate, started, done = Store(spark, str(tmp_path)), threading.Event(), [], []
    both = threading.Barrier(2, timeout=60)

    def act(name, trigger, events):
        started.append(name)
        if name == "raises":
            raise RuntimeError("no")
        if name == "slow":
            assert gate.wait(60)
        if name in ("a", "b"):
            both.wait()  # neither gets on alone
        assert spark.range(1000).selectExpr("sum(id) as s").first().s == 499500
        done.append(name)
        return 0

    units = {name: {"every": 1} for name in ("a", "b", "raises", "slow")}
    with Flights(spark, 4) as flights:
        first = {f for f in store.begin(units, act, flights)}
        assert len(first) == 4
        wait_until(lambda: flights.names() == ["slow"])
        assert sorted(done) == ["a", "b"] and store.state("raises")["error"] == "RuntimeError: no"
        assert store.begin({"slow": units["slow"]}, act, flights) == []  # still in flight
        gate.set()
        assert [f.result()["status"] for f in first].count("ok") == 3
    assert sorted(started) == ["a", "b", "raises", "slow"] and store.state("slow")["runs"] == 1
    assert sorted(e["source"] for e in store.events().collect() if e["kind"] == "loop.succeeded") == ["a", "b", "slow"]


def test_bound_and_stop(spark, tmp_path):
    """No more than the bound run at once; a unit that waits can be taken back."""
    running, most, lock, gate = set(), [0], threading.Lock(), threading.Event()

    def act(name):
        with lock:
            running.add(name)
            most[0] = max(most[0], len(running))
        assert gate.wait(60)
        with lock:
            running.discard(name)
        return name

    with Flights(spark, 2) as flights:
        each = {n: flights.submit(n, act, n)[0] for n in "abcd"}
        assert flights.submit("a", act, "a") == (each["a"], False)
        wait_until(lambda: len(running) == 2)
        flights.stop("d")
        assert each["d"].cancelled() and flights.names() == ["a", "b", "c"]
        gate.set()
        assert [each[n].result() for n in "abc"] == ["a", "b", "c"]
    assert most[0] == 2
    with pytest.raises(ValueError):
        Flights(spark, 0)


def test_rules_that_fail_are_held_apart(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.emit([{"kind": "a", "source": "s"}])
    units = {"broken": {"events": [{"kind": "a", "where": "("}]}, "good": {"events": [{"kind": "a"}]}}
    assert [r["name"] for r in store.tick(units, lambda *a: 0, bound=2)] == ["good"]
    assert store.state("broken")["consecutive_failures"] == 1


def test_cron_schedules(spark, tmp_path):
    """A unit fires once for each time of its expression, on its zone's clocks, the very second included."""
    due = lambda unit, anchor, *at: stores.scheduled(unit, anchor, datetime(*at, tzinfo=timezone.utc))
    assert due({"cron": "0 6 * * *"}, "", 2026, 1, 1)
    assert due({"cron": "0 6 * * *"}, "2026-01-01T05:00:00Z", 2026, 1, 1, 6) and not due({"cron": "0 6 * * *"}, "2026-01-01T06:00:00Z", 2026, 1, 1, 23)
    assert not due({"cron": "0 6 * * *", "zone": "America/New_York"}, "2026-01-01T05:00:00Z", 2026, 1, 1, 10) and due({"cron": "0 6 * * *", "zone": "America/New_York"}, "2026-01-01T05:00:00Z", 2026, 1, 1, 11)
    assert due({"cron": "0 6 * * *", "every": 60}, "2026-01-01T06:00:00Z", 2026, 1, 1, 6, 1) and not due({}, "", 2026, 1, 1)
    store, at = Store(spark, str(tmp_path)), datetime(2026, 1, 1, 7, tzinfo=timezone.utc)
    units = {"daily": {"cron": "0 6 * * *"}, "bad": {"cron": "nonsense"}, "nowhere": {"cron": "0 6 * * *", "zone": "No/Where"}}
    ran = [[r["name"] for r in store.tick(units, lambda *a: 0, at + timedelta(hours=h))] for h in (0, 1, 23, 24)]
    assert ran == [["daily"], [], ["daily"], []]
    assert store.state("bad")["failures"] == 4 and store.state("nowhere")["failures"] == 4


def wait_until(holds, seconds=60):
    end = time.time() + seconds
    while not holds():
        assert time.time() < end
        time.sleep(0.02)


def test_eval_and_check(spark, tmp_path):
    root = tmp_path / "store"
    settings.new_store(str(root), "mine")
    settings.new_note(str(root), "concept", "one")
    (root / "evals/a.yaml").write_text("version: 15\ncases:\n- {name: a, engine: rg, query: one, expect_refs: [concepts/one.md], expect_text: [One]}\n- {name: b, engine: jq, query: 'select(.kind == \"concept\") | {ref}', min_count: 1}\n- {name: c, engine: read, query: concepts/one, expect_refs: [concepts/one.md]}\n- {name: d, engine: rg, query: nothing, min_count: 1}\n")
    found = Store(spark, str(root)).evaluate()
    assert [c["ok"] for c in found["cases"]] == [True, True, True, False] and not found["ok"]
    assert cli.main([str(root), "check", "--now", "2026-01-01T00:00:00Z"]) == 1


def test_other_stores(tmp_path):
    settings.new_store(str(tmp_path / "a"), "mine")
    assert stores.resolve(str(tmp_path / "a"), {"sib": "/x"}, "sib") == "/x" and stores.resolve(str(tmp_path / "a"), {}, "mine").endswith("a")
    with pytest.raises(InputError):
        stores.resolve(str(tmp_path / "a"), {}, "none")


def test_server(spark, tmp_path):
    from recordmill import server

    root = tmp_path / "store"
    settings.new_store(str(root), "mine")
    settings.new_note(str(root), "concept", "one")
    ask = lambda n, method, **params: json.dumps({"jsonrpc": "2.0", "id": n, "method": method, "params": params})
    tool = lambda n, name, **a: ask(n, "tools/call", name=name, arguments=a)
    lines = [ask(1, "initialize"), '{"jsonrpc":"2.0","method":"notifications/initialized"}', "nonsense", ask(2, "tools/list"), tool(3, "read", target="concepts/one"), tool(4, "query", pattern="one", limit=1), tool(5, "read"), tool(6, "none"), ask(7, "other"), tool(8, "status"), tool(9, "query", jq="{ref}", kind="note")]
    out = []
    server.serve(Store(spark, str(root)), iter(lines), lambda x: out.append(json.loads(x)))
    by = {o["id"]: o for o in out}
    assert len(out) == 10 and by[None]["error"]["code"] == server.BAD_JSON and {t["name"] for t in by[2]["result"]["tools"]} == set(server.TOOLS)
    value = lambda n: json.loads(by[n]["result"]["content"][0]["text"])
    assert value(3)["ref"] == "concepts/one.md" and value(4)["items"][0]["title"] == "One" and value(8)["items"] == [{"kind": "concept", "records": 1}] and value(9)["items"] == [{"ref": "concepts/one.md"}]
    assert by[5]["result"]["isError"] and by[6]["error"]["code"] == server.BAD_ARGUMENTS and by[7]["error"]["code"] == server.NO_METHOD


def test_review_follows_records_and_names(spark, tmp_path):
    """Newer evidence by a note's own link, by links of records to a path, an entity or an alias, and not by others."""
    root = tmp_path / "store"
    settings.new_store(str(root), "mine")
    store = Store(spark, str(root))
    rows = [
        {"id": "a", "title": "t", "updated": "2026-11-12", "links": ["concepts/pathed.md"]},
        {"id": "b", "title": "t", "updated": "2026-11-12", "links": ["https://example.com/x#part", "urn:isbn:1"]},
        {"id": "c", "title": "t", "updated": "2026-11-12"},
        {"id": "d", "title": "t", "updated": "2026-11-01", "links": ["concepts/older.md"]},
    ]
    store.ingest("src", json.dumps(rows).encode())
    head = lambda more: f"---\nupdated: 2026-11-09\n{more}---\n# Note\n"
    record = next(p.name for p in (root / "memories/src").glob("*.json") if json.loads(p.read_text())["id"] == "c")
    for name, text in {"pathed": head(""), "named": head("entity: https://example.com/x\n"), "aliased": head("aliases: [\"isbn:1\"]\n"), "linking": head("") + f"[c](../memories/src/{record})\n", "older": head(""), "alone": head("")}.items():
        (root / f"concepts/{name}.md").write_text(text)
    found = {r.ref: list(r.reasons) for r in store.review("2026-11-15T12:00:00Z").where("section = 'stale'").collect()}
    assert found == {f"concepts/{n}.md": ["newer_evidence"] for n in ("pathed", "named", "aliased", "linking")}

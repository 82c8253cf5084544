"""Small files read on the driver: environment files, eval suites, and scaffolds of stores and notes."""

from __future__ import annotations

import re
from pathlib import Path

from recordmill.functions.values import NAME
from recordmill.sources.notes import yaml_map
from recordmill.sources.records import InputError

VERSION = 15
KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def read_env(text: str) -> dict[str, str]:
    """KEY=value lines; quotes around a value go, # lines and blank ones are skipped."""
    out = {}
    for n, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        name, eq, value = line.removeprefix("export ").partition("=")
        name, value = name.strip(), value.strip()
        if not eq or not KEY.fullmatch(name):
            raise InputError(f"line {n}: expected NAME=value")
        out[name] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


def dump_yaml(value: dict) -> str:
    """Keys in order, text quoted where it needs to be."""
    import yaml

    return yaml.safe_dump(value, sort_keys=False, allow_unicode=True)


def eval_suite(text: str) -> list[dict]:
    """The cases of a suite: distinct names, an engine, a query, and at least one expectation."""
    found = yaml_map(text)
    if found.get("version") != VERSION:
        raise InputError(f"version must be {VERSION}")
    cases = found.get("cases")
    if not isinstance(cases, list) or not cases:
        raise InputError("a suite needs cases")
    expectations = {"expect_refs", "forbid_refs", "expect_text", "min_count", "max_count", "expect_equals"}
    for c in cases:
        if not isinstance(c, dict) or not {"name", "engine", "query"} <= set(c) or c["engine"] not in ("rg", "jq", "read") or not expectations & set(c):
            raise InputError("a case needs name, engine, query and an expectation")
        if unknown := set(c) - expectations - {"name", "engine", "query", "scope"}:
            raise InputError(f"unknown keys {sorted(unknown)}")
    if len({c["name"] for c in cases}) < len(cases):
        raise InputError("case names must differ")
    return cases


def judge(case: dict, refs: list[str], text: str, value: object = None) -> list[str]:
    """What a case's result fails: nothing if it holds. References are compared as sets, counts with their bounds."""
    found, asked = set(refs), case.get("expect_text", [])
    absent = {t: str(t).lower() not in text.lower() for t in ([asked] if isinstance(asked, str) else asked)}
    failed = {
        "missing {}": sorted(set(case.get("expect_refs", ())) - found),
        "forbidden {}": sorted(set(case.get("forbid_refs", ())) & found),
        "text not found: {}": [t for t, lacks in absent.items() if lacks],
        "too {}": [word for word, wrong in (("few", len(refs) < case.get("min_count", 0)), ("many", len(refs) > case.get("max_count", len(refs)))) if wrong],
        "other {}": ["value"] if case.get("expect_equals", value) != value else [],
    }
    return [said.format(what) for said, each in failed.items() for what in each]


def new_store(root: str, name: str) -> None:
    """Folders and settings of an empty store; nothing that exists is overwritten."""
    if not re.fullmatch(NAME, name):
        raise InputError("bad name")
    base = Path(root)
    if base.exists() and any(base.iterdir()):
        raise InputError("the folder isn't empty")
    for d in ("projects", "concepts", "actions", "memories", "evals", "schemas"):
        (base / d).mkdir(parents=True)
    (base / "store.yaml").write_text(dump_yaml({"version": VERSION, "name": name}), encoding="utf-8")


def new_note(root: str, kind: str, slug: str, title: str | None = None, now: str = "") -> str:
    """A draft note of a kind (project, concept or action); its path."""
    if kind not in ("project", "concept", "action") or not re.fullmatch(NAME, slug):
        raise InputError("bad kind or name")
    path = Path(root) / (f"actions/{slug}/ACTION.md" if kind == "action" else f"{kind}s/{slug}.md")
    if path.exists():
        raise InputError("the note exists")
    path.parent.mkdir(parents=True, exist_ok=True)
    meta = {"type": kind, "status": "draft"} | ({"updated": now} if now else {})
    path.write_text(f"---\n{dump_yaml(meta)}---\n\n# {title or slug.replace('-', ' ').title()}\n", encoding="utf-8")
    return path.relative_to(root).as_posix()

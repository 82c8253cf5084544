"""Outside sources as Spark data sources: git history, issue and mail exports, each within a window of time.

    spark.dataSource.register(GitHistory)
    spark.read.format("git_history").option("root", path).option("start", "2026-01-01T00:00:00Z").load()

Every source gives records: id, title, type, text, time and attributes. A window is [start, end); records
without a time in it are left out. Exports are JSON lines or arrays in files, a partition each.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "id string, title string, type string, text string, time string, attributes map<string,string>"


def normal_time(text: str | None) -> str:
    """A zoned time in UTC whole seconds; empty if it isn't one."""
    try:
        at = datetime.fromisoformat(text or "")
    except ValueError:
        return ""
    return at.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ") if at.tzinfo else ""


@dataclass
class Part(InputPartition):
    place: str


class Windowed(DataSourceReader):
    """Reads parts and keeps what falls into the window; window ends are compared as normal times."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.start, self.end = normal_time(options.get("start")) or "", normal_time(options.get("end")) or "~"

    def parts(self) -> list[str]:
        raise NotImplementedError

    def records(self, place: str) -> Iterator[dict]:
        raise NotImplementedError

    def partitions(self) -> list[Part]:
        return [Part(p) for p in self.parts()]

    def read(self, partition: Part) -> Iterator[tuple]:
        for r in self.records(partition.place):
            if r["time"] and self.start <= r["time"] < self.end:
                attributes = {k: str(v) for k, v in r.get("attributes", {}).items() if v is not None}
                yield (r["id"], r["title"], r["type"], r["text"], r["time"], attributes)


class GitReader(Windowed):
    """Commits of a repository, a partition for each branch or tag named in refs (HEAD if none is)."""

    def parts(self) -> list[str]:
        return self.options.get("refs", "HEAD").split(",")

    def records(self, place: str) -> Iterator[dict]:
        if place.startswith("-"):
            raise ValueError("a ref can't begin with a dash")
        form = "%H%x1f%an%x1f%aI%x1f%s%x1f%b%x1e"
        done = subprocess.run(["git", "-C", self.options["root"], "log", f"--format={form}", "--no-color", place, "--"], capture_output=True, check=True, timeout=300)
        for entry in done.stdout.decode("utf-8", "replace").split("\x1e"):
            cells = entry.strip("\n").split("\x1f")
            if len(cells) == 5:
                sha, author, at, subject, body = cells
                yield {"id": sha, "title": subject or sha[:12], "type": "commit", "text": body.strip(), "time": normal_time(at), "attributes": {"author": author, "ref": place}}


class ExportReader(Windowed):
    """Items of exported JSON files below root."""

    suffixes = (".json", ".jsonl")

    def parts(self) -> list[str]:
        return sorted(str(p) for p in Path(self.options["root"]).rglob("*") if p.suffix in self.suffixes and p.is_file())

    def items(self, place: str) -> list[dict]:
        text = Path(place).read_text(encoding="utf-8-sig")
        try:
            found = json.loads(text)
        except ValueError:
            found = [json.loads(line) for line in text.splitlines() if line.strip()]
        return [x for x in (found if isinstance(found, list) else [found]) if isinstance(x, dict)]

    def records(self, place: str) -> Iterator[dict]:
        return map(self.record, self.items(place))

    def record(self, item: dict) -> dict:
        raise NotImplementedError


class IssueReader(ExportReader):
    """Issues and pull requests in the shape of a tracker's REST lists."""

    def record(self, item: dict) -> dict:
        repository = self.options.get("repository", "")
        kind = "pull" if item.get("pull_request") else "issue"
        labels = ",".join(x["name"] if isinstance(x, dict) else str(x) for x in item.get("labels") or [])
        more = {"number": item.get("number"), "kind": kind, "status": item.get("state"), "reason": item.get("state_reason"), "labels": labels, "updated": normal_time(item.get("updated_at"))}
        return {"id": f"{repository}/issues/{item.get('number')}", "title": item.get("title") or "", "type": kind, "text": item.get("body") or "", "time": normal_time(item.get("updated_at") or item.get("created_at")), "attributes": more}


class MailReader(ExportReader):
    """Message headers: id, thread, labels, and headers as a list of name and value."""

    def record(self, item: dict) -> dict:
        headers = {h["name"].lower(): h["value"] for h in (item.get("payload") or {}).get("headers") or item.get("headers") or []}
        at = datetime.fromtimestamp(int(item["internalDate"]) / 1000, UTC).isoformat() if str(item.get("internalDate", "")).isdigit() else headers.get("date")
        text = "\n".join(f"{n}: {headers[n]}" for n in ("from", "to", "cc") if n in headers)
        return {"id": str(item.get("id")), "title": headers.get("subject") or "(no subject)", "type": "email", "text": text, "time": normal_time(at), "attributes": {"thread": item.get("threadId"), "labels": ",".join(item.get("labelIds") or [])}}


class _Source(DataSource):
    reader_class: type[Windowed]

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.reader_class(self.options)


class GitHistory(_Source):
    reader_class = GitReader

    @classmethod
    def name(cls) -> str:
        return "git_history"


class Issues(_Source):
    reader_class = IssueReader

    @classmethod
    def name(cls) -> str:
        return "issue_export"


class MailHeaders(_Source):
    reader_class = MailReader

    @classmethod
    def name(cls) -> str:
        return "mail_export"


def register(spark) -> None:
    for source in (GitHistory, Issues, MailHeaders):
        spark.dataSource.register(source)

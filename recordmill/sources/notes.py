"""Markdown notes as records: front matter, headings, links, elements, attributes and tasks."""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.functions import links as L

FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
HEADING = re.compile(r" {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
ATTRIBUTES = re.compile(r"[ \t]*\{:?[ ]*([^}\n]*)\}[ \t]*$")
TASK = re.compile(r"\s*[-*+][ \t]+\[([ xX])\][ \t]+(\S.*)$")
ITEM = re.compile(r"\s*(?:[-*+]|\d+[.)])[ \t]+(.*)$")
LINK = re.compile(r"(?<!!)\[((?:[^\[\]\\]|\\.)*)\]\(\s*<?([^\s()<>]*(?:\([^()]*\)[^\s()<>]*)*)>?(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)(\{[^}\n]*\})?")
AUTO = re.compile(r"<((?:https?|mailto):[^\s<>]+)>")
ATTRIBUTE = re.compile(r"""#(?P<id>[^\s.#=]+)|\.(?P<cls>[^\s.#=]+)|(?P<key>[A-Za-z_][\w.-]*)=(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<raw>[^\s]+))""")
QUOTE = re.compile(r" {0,3}>[ ]?")
RULE = re.compile(r"[\s|:+=-]+")
MARKED = re.compile(r"[`\[<*_&\\]")
# What libyaml and PyYAML read alike: plain words in maps and lists. Held against each other by the tests.
PLAIN = re.compile(r"[A-Za-z0-9 _./:,@+\[\]{}\n-]*")
# Characters and notes that Python takes apart at once.
MOST_CHARS, MOST_NOTES = 1 << 20, 500
# Front matter that a record works out itself, and how large a block may be.
COMPUTED, DEEPEST, MOST_BYTES = ("ref", "source", "kind", "text", "headings", "elements", "tasks", "attrs", "sha256", "path", "brain"), 32, 256 << 10
#: YAML 1.2 core: what plain words stand for besides text (fixed values).
CORE = (
    ("null", re.compile(r"(?:~|null|Null|NULL|)\Z"), ["~", "n", "N", ""]),
    ("bool", re.compile(r"(?:true|True|TRUE|false|False|FALSE)\Z"), list("tTfF")),
    ("int", re.compile(r"(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)\Z"), list("-+0123456789")),
    ("float", re.compile(r"(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))\Z"), list("-+.0123456789")),
)
META = "meta:map<string,string>"
SCHEMA = (
    "path string, ref string, source string, kind string, title string, type string, status string, updated string, stale_after string, entity string, "
    "aliases array<string>, tags array<string>, sources array<struct<resource:string,retrieved:string>>, text string, sha256 string, "
    f"headings array<struct<id:string,title:string,level:int,{META}>>, raw_links array<struct<raw:string,{META},section:string>>, "
    f"elements array<struct<tag:string,id:string,text:string,section:string,{META}>>, tasks array<struct<id:string,text:string,done:boolean,section:string,{META}>>, "
    "attrs map<string,map<string,string>>, marks array<struct<id:string,level:int,line:int,body:int>>, extra string, problem string"
)


def front_matter(text: str) -> tuple[str, str]:
    """The YAML block between --- lines at the very start, and the body."""
    m = re.match(r"﻿?---[ \t]*\n(.*?)(?:^|\n)(?:---|\.\.\.)[ \t]*(?:\n|\Z)(.*)\Z", text, re.S)
    return (m[1], m[2]) if m else ("", text)


def whole_number(text: str) -> int:
    return int(text, 8 if text.startswith("0o") else 16) if text[:2] in ("0o", "0x") else int(text)


def real_number(text: str) -> float:
    value = float(text.lower().replace(".inf", "inf").replace(".nan", "nan"))
    if value != value or value in (float("inf"), float("-inf")):
        raise ValueError("numbers must be finite")
    return value


def distinct_keys(keys: list) -> None:
    if not all(isinstance(k, str) for k in keys) or len(set(keys)) < len(keys):
        raise ValueError("keys must be distinct strings")


@lru_cache(1)
def strict_loader() -> type:
    """A loader of YAML 1.2's core rules, made once for a process."""
    import yaml

    class Strict(yaml.SafeLoader):
        depth = 0

        def compose_node(self, parent, index):
            if self.check_event(yaml.AliasEvent) or getattr(self.peek_event(), "anchor", None):
                raise ValueError("anchors are not allowed")
            self.depth += 1
            if self.depth > DEEPEST:
                raise ValueError("nested too deep")
            try:
                return super().compose_node(parent, index)
            finally:
                self.depth -= 1

        def construct_mapping(self, node, deep=False):
            distinct_keys([self.construct_object(k) for k, _ in node.value])
            return super().construct_mapping(node, deep)

        def whole(self, node):
            return whole_number(self.construct_scalar(node))

        def real(self, node):
            return real_number(self.construct_scalar(node))

    Strict.yaml_implicit_resolvers = {}
    for name, pattern, first in CORE:
        Strict.add_implicit_resolver(f"tag:yaml.org,2002:{name}", pattern, first)
    Strict.add_constructor("tag:yaml.org,2002:int", Strict.whole)
    Strict.add_constructor("tag:yaml.org,2002:float", Strict.real)
    return Strict


def core_value(text: str):
    """What a plain word stands for."""
    name = next((name for name, pattern, _ in CORE if pattern.match(text)), None)
    return None if name == "null" else text.lower() == "true" if name == "bool" else whole_number(text) if name == "int" else real_number(text) if name == "float" else text


def plain_values(block: str):
    """The values of a block of plain words as libyaml parses it; an error leaves the block to the strict loader."""
    import yaml

    def built(node, depth: int):
        if depth > DEEPEST:
            raise ValueError("nested too deep")
        if isinstance(node, yaml.ScalarNode):
            return core_value(node.value)
        if isinstance(node, yaml.SequenceNode):
            return [built(x, depth + 1) for x in node.value]
        keys = [built(k, depth + 1) for k, _ in node.value]
        distinct_keys(keys)
        return {k: built(v, depth + 1) for k, (_, v) in zip(keys, node.value)}

    return built(yaml.compose(block, yaml.CBaseLoader), 1)


def loaded(block: str):
    import yaml

    if yaml.__with_libyaml__ and PLAIN.fullmatch(block):
        try:
            return plain_values(block)
        except Exception:  # noqa: S110  the strict loader says what is wrong
            pass
    return yaml.load(block, strict_loader())


def yaml_map(block: str) -> dict:
    """A mapping by YAML 1.2's core rules; anchors, repeated or other keys, deep nesting and endless numbers are refused."""
    if len(block.encode()) > MOST_BYTES:
        raise ValueError("front matter is too large")

    found = loaded(block) if block.strip() else {}
    if not isinstance(found, dict):
        raise ValueError("front matter must be a mapping")
    return found


def attributes(text: str) -> tuple[str, dict[str, str]]:
    name, out = "", {}
    for m in ATTRIBUTE.finditer(text):
        if m["id"]:
            name = m["id"]
        elif m["key"]:
            out[m["key"]] = next(x for x in (m["dq"], m["sq"], m["raw"]) if x is not None)
    return name, out


def inline(text: str) -> str:
    """Visible text of a line; code spans as they are."""
    if not MARKED.search(text):
        return text.strip()
    shown = []
    for i, part in enumerate(re.split(r"`([^`]*)`", text)):
        if i % 2 == 0:
            part = AUTO.sub(r"\1", LINK.sub(lambda m: m[1], part))
            part = re.sub(r"<[^>]+>", "", re.sub(r"!\[([^\]]*)\]\([^)]*\)", r"\1", part))
            part = re.sub(r"(\*\*|__)(.+?)\1", r"\2", part)
            part = re.sub(r"(?<!\w)([*_])(.+?)\1(?!\w)", r"\2", part)
            part = html.unescape(re.sub(r"\\([\\`*_{}\[\]()#+.!-])", r"\1", part))
        shown.append(part)
    return "".join(shown).strip()


def slugs(title: str, used: set[str]) -> str:
    base = re.sub(r"[-\s]+", "-", re.sub(r"[^\w\s-]", "", title).strip().lower()) or "section"
    out, n = base, 0
    while out in used:
        n += 1
        out = f"{base}_{n}"
    used.add(out)
    return out


def role(path: str) -> str | None:
    p = path.split("/")
    if not path.endswith(".md") or p[-1].startswith(".#"):
        return None
    return p[0] if p[0] in ("projects", "concepts") and len(p) > 1 else "actions" if p[0] == "actions" and len(p) == 3 and p[2] == "ACTION.md" else None


def stated_links(meta: dict) -> list[dict]:
    """The links of front matter: targets, {to, meta} maps, and what sources cite."""
    out = []
    listed = meta.get("links")
    if listed is not None and not isinstance(listed, list):
        raise ValueError("links must be a list")
    for x in listed or []:
        target, beside = (x, {}) if isinstance(x, str) else (x.get("to"), x.get("meta", {})) if isinstance(x, dict) and set(x) <= {"to", "meta"} else (None, None)
        if not isinstance(target, str) or not isinstance(beside, dict) or not all(isinstance(v, str) for v in beside.values()):
            raise ValueError("a link is a target or a map of to and meta")
        out.append({"raw": target, "meta": beside, "section": ""})
    cited = [s.get("resource") for s in meta["sources"] if isinstance(s, dict)] if isinstance(meta.get("sources"), list) else []
    return out + [{"raw": c.strip(), "meta": {"rel": "cites"}, "section": ""} for c in cited if isinstance(c, str) and c.strip()]


def visible(line: str) -> list[str]:
    """What a line outside code shows, without marks of lists, quotes, tables and attributes."""
    while QUOTE.match(line):
        line = QUOTE.sub("", line, count=1)
    if re.match(r" {0,3}\[[^\]]+\]:", line) or (("|" in line or "-" in line) and RULE.fullmatch(line)):
        return []
    line = ATTRIBUTES.sub("", line) if "{" in line else line
    item = ITEM.match(line)
    cells = line.strip().strip("|").split("|") if line.strip().startswith("|") else [item[1] if item else line]
    return [x for x in map(inline, cells) if x]


def compile_note(path: str, text: str) -> dict:
    """The record of one note, its links as written; problem tells why it can't be compiled. Code blocks are text only."""
    source = role(path)
    out = {"path": path, "ref": path, "source": source, "kind": (source or "")[:-1], "title": "", "sha256": hashlib.sha256(text.encode()).hexdigest(), "text": "", "attrs": {}, "extra": None, "problem": None}
    out |= {k: None for k in ("type", "status", "updated", "stale_after", "entity")} | {k: [] for k in ("aliases", "tags", "sources", "headings", "raw_links", "elements", "tasks", "marks")}
    text = text.removeprefix("\ufeff").replace("\r\n", "\n")
    block, body = front_matter(text)
    skipped = text[: len(text) - len(body)].count("\n")
    try:
        meta = yaml_map(block)
        if source is None:
            raise ValueError("not a note's path")
        if re.search(r"^(<{7}|>{7}) ", text, re.M):
            raise ValueError("merge conflict")
        if taken := sorted({*COMPUTED, "relations"} & meta.keys()):
            raise ValueError(f"front matter can't set {', '.join(taken)}")
        if not isinstance(meta.get("title", ""), str):
            raise ValueError("title must be text")
        if any(isinstance(t, (dict, list)) or t is None or re.search(r"[/\\\s]", str(t)) or not str(t) for t in (meta.get("tags") or [])):
            raise ValueError("tags must be nonempty tokens without spaces or slashes")
        out["raw_links"] = stated_links(meta)
    except Exception as error:  # yaml's own errors have no common base here
        out["problem"] = str(error).split("\n")[0]
        return out
    shown = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    listed = lambda k: meta[k] if isinstance(meta.get(k), list) else []
    out |= {k: shown(meta.get(k)) for k in ("type", "status", "updated", "stale_after", "entity")}
    out |= {"tags": list(dict.fromkeys(str(t) for t in listed("tags"))), "aliases": [str(a) for a in listed("aliases")]}
    out["sources"] = [{"resource": shown(s.get("resource")), "retrieved": shown(s.get("retrieved"))} for s in listed("sources") if isinstance(s, dict)]
    rest = {k: v for k, v in meta.items() if k not in ("title", "type", "status", "updated", "stale_after", "entity", "aliases", "tags", "links", "sources")}
    out["extra"] = json.dumps(rest, sort_keys=True, ensure_ascii=False, default=str) if rest else None
    used, section, fence, plain, first = set(), "", None, [], ""

    def register(name: str, values: dict) -> None:
        if name in out["attrs"]:
            raise ValueError(f"repeated anchor {name}")
        out["attrs"][name] = values

    lines = body.split("\n")
    underlined = False
    try:
        for n, line in enumerate(lines):
            if underlined:
                underlined = False
                continue
            if m := FENCE.match(line):
                if fence is None:
                    fence = m[1]
                elif m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                    fence = None
                continue
            if fence:
                plain += [line.strip()] if line.strip() else []
                continue
            heading = HEADING.match(line)
            level, title = (len(heading[1]), heading[2]) if heading else (0, "")
            if not heading and line.strip() and n + 1 < len(lines) and (s := SETEXT.match(lines[n + 1])) and not ITEM.match(line) and not QUOTE.match(line):
                level, title, underlined = (1 if s[1][0] == "=" else 2), line, True
            if level:
                a = ATTRIBUTES.search(title)
                name, values = attributes(a[1]) if a else ("", {})
                title = inline(title[: a.start()] if a else title)
                if name:
                    used.add(name)
                section = name or slugs(title, used)
                register(section, values)
                out["headings"].append({"id": section, "title": title, "level": level, "meta": values})
                out["marks"].append({"id": section, "level": level, "line": skipped + n, "body": skipped + n + 1 + underlined})
                first = first or (title if level == 1 else "")
                plain += [title] if title else []
                continue
            plain += visible(line)
            bare = re.sub(r"`[^`]*`", "", line) if "`" in line else line
            found = [(m.start(), m[2], attributes(m[3][1:-1].lstrip(":")) if m[3] else ("", {})) for m in LINK.finditer(bare)] if "](" in bare else []
            found += [(m.start(), m[1], ("", {})) for m in AUTO.finditer(bare)] if "<" in bare else []
            for _, raw, (name, values) in sorted(found, key=lambda x: x[0]):
                out["raw_links"].append({"raw": raw, "meta": values, "section": section})
                if name:
                    register(name, values)
            task = TASK.match(line)
            a = ATTRIBUTES.search(line) if "{" in line else None
            name, values = attributes(a[1]) if a and not (found and line[: a.start()].endswith(")")) else ("", {})
            if task:
                words = task[2][: ATTRIBUTES.search(task[2]).start()] if ATTRIBUTES.search(task[2]) else task[2]
                out["tasks"].append({"id": name or None, "text": inline(words), "done": task[1] != " ", "section": section, "meta": values})
                if name:
                    register(name, values)
            elif name or values:
                item = ITEM.match(line)
                words = line[: a.start()].strip() or (lines[n - 1] if n else "")
                out["elements"].append({"tag": "li" if item else "p", "id": name or None, "text": inline(item[1][: -len(a[0])] if item else words), "section": section, "meta": values})
                if name:
                    register(name, values)
    except ValueError as error:
        out["problem"] = str(error)
    stem = re.sub(r"(/ACTION)?\.md$", "", path).rsplit("/", 1)[-1].replace("-", " ")
    out |= {"title": (meta.get("title") or "").strip() or first or stem, "text": "\n".join(plain)}
    return out


def links_of(path: Column, raw: Column, own: str) -> Column:
    """Links as written in normal form, with section and problem."""

    def one(x: Column) -> Column:
        link = L.let(L.normal(path, x["raw"], own), lambda n: L.with_attributes(n, x["meta"]))
        return L.let(link, lambda n: F.struct(*(n[c].alias(c) for c in ("to", "kind", "anchor", "meta")), x["section"].alias("section"), n["problem"].alias("problem")))

    return F.transform(raw, one)


def normal_links(path: Column, raw: Column, own: str) -> Column:
    """links, each once in a section, and problem of the first bad one; with a problem there are no links."""
    key = lambda x: F.struct(x["to"], x["kind"], x["anchor"], x["section"], F.array_sort(F.map_entries(x["meta"])))
    shown = lambda x: F.struct(*(x[c].alias(c) for c in ("to", "kind", "anchor", "meta", "section")))

    def once(found: Column, keys: Column) -> Column:
        return F.transform(F.filter(found, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1), shown)

    def judged(found: Column) -> Column:
        wrong = F.get(F.filter(F.transform(found, lambda x: x["problem"]), lambda p: p.isNotNull()), F.lit(0))
        return F.struct(wrong.alias("problem"), L.let(F.transform(found, key), lambda keys: once(found, keys)).alias("links"))

    return L.let(links_of(path, raw, own), judged)


def once_a_row(value: Column) -> Column:
    """The value, as an expression that Spark neither copies into filters and other columns nor works out again for them."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly: a small file of many notes is one task's otherwise. Few tasks do, as each streams its rows."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def batch_slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most MOST_NOTES notes and, but for single notes, MOST_CHARS bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and (held + size > MOST_CHARS or i - start == MOST_NOTES):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def compile_notes(df: DataFrame, path: str = "path", text: str = "text", own: str = "", keep_text: bool = False) -> DataFrame:
    """Records of notes; a null text is an empty note. Bad notes come with a problem and no parts.

    Python takes the Markdown apart, few notes at once; links are brought to their normal form by expressions, each once in
    a section. marks are the headings' places: the line of a heading, and the first line after it. keep_text adds the note
    as written, as source_text.
    """
    schema = ARROW.append(pa.field("source_text", _S)) if keep_text else ARROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in batch_slices(whole, text)):
            texts = batch.column(text)
            rows = [compile_note(p, t or "") for p, t in zip(batch.column(path).to_pylist(), texts.to_pylist())]
            found = [array_of([r[f.name] for r in rows], f.type) for f in ARROW]
            yield pa.RecordBatch.from_arrays([*found, texts.cast(_S)] if keep_text else found, schema=schema)

    found = spread(df.select(path, text)).mapInArrow(run, SCHEMA + (", source_text string" if keep_text else ""))
    found = found.withColumn("_links", once_a_row(normal_links(F.col("path"), F.col("raw_links"), own)))
    found = found.withColumn("problem", F.coalesce("problem", "_links.problem"))
    none = F.array().cast(f"array<{L.LINK}>")
    return found.withColumn("links", F.when(F.col("problem").isNull(), F.col("_links.links")).otherwise(none)).drop("raw_links", "_links")


def lines_of(text: str) -> Column:
    """The lines of a note as written, by which marks count."""
    return F.split(F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), "\r\n", "\n"), "\n")


def section_text(lines: Column, marks: Column, at: Column) -> Column:
    """The lines under the heading that is at a place (from 0) of a note's marks, up to the next heading of its level or above."""
    mark = F.get(marks, at)
    after = F.filter(F.slice(marks, at + 2, F.size(marks)), lambda m: m["level"] <= mark["level"])
    end = F.coalesce(F.get(after, F.lit(0))["line"], F.size(lines))
    body = F.array_join(F.slice(lines, mark["body"] + 1, F.greatest(F.lit(0), end - mark["body"])), "\n")
    return F.regexp_replace(body, r"(?U)^\s+|\s+$", "")


def sections(compiled: DataFrame, text: str = "source_text") -> DataFrame:
    """ref, anchor, level and text of each heading's section.

    text: the note as written. The next such heading is found in the note's own list of marks, by place.
    """
    each = compiled.select("ref", lines_of(text).alias("lines"), "marks", F.posexplode("marks").alias("at", "mark"))
    return each.select("ref", F.col("mark.id").alias("anchor"), F.col("mark.level").alias("level"), section_text(F.col("lines"), F.col("marks"), F.col("at")).alias("text"))


def anchor_value(anchor: str, text: str = "source_text") -> Column:
    """what and value of what stands at an anchor of a compiled note, see at_anchor; null without the anchor."""
    item = lambda c: F.to_json(F.get(F.filter(c, lambda x: x["id"] == anchor), F.lit(0)))
    at = F.array_position(F.transform("marks", lambda m: m["id"]), anchor).cast("int")
    section = F.when(at > 0, L.let(lines_of(text), lambda lines: section_text(lines, F.col("marks"), at - 1)))
    order = (("element", item("elements")), ("task", item("tasks")), ("section", section), ("meta", F.to_json(F.try_element_at("attrs", F.lit(anchor)))))

    def told(what: str, value: Column) -> Column:
        return L.let(value, lambda v: F.when(v.isNotNull(), F.struct(F.lit(what).alias("what"), v.alias("value"))))

    return F.coalesce(*(told(k, v) for k, v in order))


def at_anchor(compiled: DataFrame, anchor: str, text: str = "source_text") -> DataFrame:
    """What stands at an anchor of each note, as ref, what and value: an element or a task before a section, then metadata.

    value is the element or task as JSON, the section's text, or the metadata as JSON. Notes without the anchor give no row.
    """
    return compiled.select("ref", once_a_row(anchor_value(anchor, text)).alias("p")).where("p is not null").select("ref", "p.what", "p.value")


def array_of(values: list, kind: pa.DataType) -> pa.Array:
    """Values as an array: lists, maps (as dicts) and structs (as dicts) are flattened first, which is much faster."""
    if pa.types.is_struct(kind):
        return pa.StructArray.from_arrays([array_of([v[f.name] for v in values], f.type) for f in kind], fields=list(kind))
    if not (pa.types.is_list(kind) or pa.types.is_map(kind)):
        return pa.array(values, kind)
    ends = pa.array([0, *accumulate(map(len, values))], pa.int32())
    if pa.types.is_list(kind):
        return pa.ListArray.from_arrays(ends, array_of(list(chain.from_iterable(values)), kind.value_type), type=kind)
    keys, items = list(chain.from_iterable(values)), list(chain.from_iterable(v.values() for v in values))
    return pa.MapArray.from_arrays(ends, array_of(keys, kind.key_type), array_of(items, kind.item_type), type=kind)


def _list(**fields: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct(list(fields.items())))


_S, _META = pa.string(), pa.map_(pa.string(), pa.string())
ARROW = pa.schema(
    [
        *((n, _S) for n in ("path", "ref", "source", "kind", "title", "type", "status", "updated", "stale_after", "entity")),
        ("aliases", pa.list_(_S)),
        ("tags", pa.list_(_S)),
        ("sources", _list(resource=_S, retrieved=_S)),
        ("text", _S),
        ("sha256", _S),
        ("headings", _list(id=_S, title=_S, level=pa.int32(), meta=_META)),
        ("raw_links", _list(raw=_S, meta=_META, section=_S)),
        ("elements", _list(tag=_S, id=_S, text=_S, section=_S, meta=_META)),
        ("tasks", _list(id=_S, text=_S, done=pa.bool_(), section=_S, meta=_META)),
        ("attrs", pa.map_(_S, _META)),
        ("marks", _list(id=_S, level=pa.int32(), line=pa.int32(), body=pa.int32())),
        ("extra", _S),
        ("problem", _S),
    ]
)

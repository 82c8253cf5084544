"""Links as written in notes and records, in one normal form, as Columns.

A raw link is taken apart once into the pieces that its form has; a table of rules, tried in order, then says what is
wrong with them, and only sound pieces are put together. Each step is bound by let(), so that no piece is worked out
twice. Everything is expressions, so links of any number of notes stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.functions import values as V

# Schemes of outside links, schemes that are refused, and how long a link and its query may be.
OUTSIDE, REFUSED, LONGEST, MOST_KEYS = ("https", "http", "mailto", "urn"), ("javascript", "data", "file", "vbscript", "tel"), 8192, 32
META_KEY = "^[A-Za-z_][A-Za-z0-9_.-]*$"
SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):"
SPACE = r"(?U)\s"
WEB = "(?i)^https?://"
#: The shape of a link in its normal form.
LINK = "struct<to:string,kind:string,anchor:string,meta:map<string,string>,section:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with a name for the value, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def decoded(text: Column) -> Column:
    """Percent-decoded; a stray % stays, + stays, and null comes of bytes that aren't UTF-8."""
    kept = F.regexp_replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    own = text.contains("�") | F.lower(text).contains("%ef%bf%bd")
    return let(F.try_url_decode(kept), lambda out: F.when(own | ~out.contains("�"), out))


def unclean(text: Column) -> Column:
    return text.isNull() | text.rlike(V.CONTROL) | text.rlike(V.INVISIBLE)


def whole_path(path: Column) -> Column:
    """A note's path in full: an action's folder gets its file, a project's or concept's name without a dot .md."""
    bare = path.rlike("^(projects|concepts)/") & ~F.substring_index(path, "/", -1).contains(".")
    return F.when(path.rlike("^actions/[A-Za-z0-9][A-Za-z0-9_-]*$"), F.concat(path, F.lit("/ACTION.md"))).when(bare, F.concat(path, F.lit(".md"))).otherwise(path)


def seen_from(origin: Column, path: Column) -> Column:
    """A path relative to a note's folder as one from the root; null if it leads out."""
    folder = F.split(origin, "/")
    steps = F.concat(F.slice(folder, F.lit(1), F.size(folder) - 1), F.split(path, "/"))

    def walk(at: Column, step: Column) -> Column:
        up = F.when(F.size(at) > 0, F.slice(at, F.lit(1), F.size(at) - 1))
        return F.when(step == ".", at).when(step == "..", up).otherwise(F.concat(at, F.array(step)))

    return F.array_join(F.aggregate(steps, F.array().cast("array<string>"), walk), "/")


def parameters(query: Column) -> Column:
    """Of a query: its decoded parameters in order, and whether they are sound: well-formed, distinct, not too many."""
    parts = F.when(query == "", F.array().cast("array<string>")).otherwise(F.split(query, "&"))
    pair = lambda p: F.struct(
        decoded(F.regexp_replace(F.substring_index(p, "=", 1), r"\+", "%2B")).alias("key"), decoded(F.regexp_replace(F.regexp_extract(p, "=(.*)$", 1), r"\+", " ")).alias("value")
    )
    fits = lambda p: F.coalesce(~unclean(p["key"]) & ~unclean(p["value"]) & p["key"].rlike(META_KEY) & (F.trim(p["value"]) != ""), F.lit(False))
    return let(
        F.transform(parts, pair),
        lambda found: F.struct(found.alias("pairs"), (F.forall(found, fits) & (F.size(F.array_distinct(F.transform(found, lambda p: p["key"]))) == F.size(found)) & (F.size(found) <= MOST_KEYS)).alias("sound")),
    )


def pieces(text: Column, own: str) -> Column:
    """form, head, anchor (decoded), empty_anchor, host, path (decoded), source, id and query of a link."""
    scheme = F.lower(F.regexp_extract(text, SCHEME, 1))
    form = F.when(scheme.isin(*OUTSIDE), "url").when(scheme.isin(*REFUSED), "refused").when(scheme == "bf", "bf").when(scheme != "", "record").otherwise("path")
    body = F.when(form == "record", F.regexp_replace(text, SCHEME, "")).otherwise(text)

    def cut(x: Column) -> Column:
        head = F.substring_index(x["body"], "#", 1)
        after = F.regexp_extract(x["body"], "(?s)#(.*)$", 1)
        inner = F.when(x["form"] == "bf", F.regexp_replace(head, "(?i)^bf://[^/?]*/*", "")).otherwise(head)
        return F.struct(
            x["form"].alias("form"), x["text"].alias("text"), head.alias("head"), F.regexp_extract(x["text"], SCHEME, 1).alias("scheme"), decoded(after).alias("anchor"), (x["body"].contains("#") & (after == "")).alias("empty_anchor"),
            F.when(x["form"] == "bf", F.regexp_extract(head, "(?i)^bf://([^/?]*)", 1)).otherwise("").alias("host"), F.substring_index(inner, "?", 1).alias("inner"), F.regexp_extract(inner, r"(?s)\?(.*)$", 1).alias("query"), inner.alias("whole"),
        )

    def named(x: Column) -> Column:
        named_in_path = (x["form"] == "bf") & x["inner"].rlike("^[^/:]*:")
        source = F.when(x["form"] == "record", x["scheme"]).when(named_in_path, F.substring_index(x["inner"], ":", 1)).otherwise("")
        rest = F.when(x["form"] == "record", x["whole"]).otherwise(F.regexp_replace(x["whole"], "^[^/:]*:", ""))
        web = (source != "") & rest.rlike(WEB)
        record = (x["form"] == "record") | named_in_path
        return F.struct(
            *(x[c].alias(c) for c in ("form", "text", "head", "anchor", "empty_anchor", "host")),
            record.alias("record"), source.alias("source"), F.when(web, rest).otherwise(F.substring_index(rest, "?", 1)).alias("id"), F.when(web, "").otherwise(x["query"]).alias("query"),
            decoded(x["inner"]).alias("path"), (x["host"].isin("", own)).alias("here"),
        )

    return let(F.struct(form.alias("form"), body.alias("body"), text.alias("text")), lambda x: let(cut(x), named))


def normal(origin: Column, raw: Column, own: str = "", relative: bool = True) -> Column:
    """to, kind (url, note, record or brain), anchor, meta and problem (null if sound; else the others are null).

    Paths without a scheme lead from the note's folder unless they begin with a store's folder; links to the store's
    own name are links here. A null link is a bad one.
    """
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)^\s+|\s+$", "")

    def target(p: Column) -> Column:
        rooted = (p["form"] == "bf") | F.lit(not relative) | p["path"].rlike("^(projects|concepts|actions|memories)/")
        there = F.when((p["path"] == "") & (p["form"] == "path") & F.lit(relative), origin).when(rooted, p["path"]).otherwise(seen_from(origin, p["path"]))
        return F.when(p["record"], V.record_path(p["source"], p["id"])).otherwise(whole_path(there))

    def ruled(x: Column) -> Column:
        p, to, q = x["p"], x["to"], x["q"]
        form, path = p["form"], p["path"]
        local = form.isin("path", "bf") & ~p["record"]
        dotted = F.exists(F.split(path, "/"), lambda s: s.isin(".", ".."))
        rooted = (form == "bf") | F.lit(not relative) | path.rlike("^(projects|concepts|actions|memories)/")
        taken = ~form.isin("url", "refused")
        rules = [
            ((p["text"] == "") | unclean(p["text"]) | (F.length(p["text"]) > LONGEST), "bad link target"),
            (form == "refused", "scheme is refused"),
            ((form == "bf") & ~p["text"].rlike("(?i)^bf://"), "bad bf:// link"),
            ((form == "bf") & p["text"].rlike("%(?![0-9a-fA-F]{2})"), "bad bf:// link"),
            (taken & (p["head"].rlike(SPACE) | p["empty_anchor"]), "white space or an empty anchor"),
            (taken & unclean(p["anchor"]), "bad anchor"),
            ((form == "bf") & p["host"].isin(*V.RESERVED), "a source as a store's name"),
            (p["record"] & p["source"].isin(*V.RESERVED), "reserved source"),
            (p["record"] & to.isNull(), "bad record reference"),
            (local & (unclean(path) | path.rlike(SPACE)), "bad path"),
            (local & (path == "") & ((form == "bf") | F.lit(not relative) | (p["anchor"] == "")), "no target"),
            (local & (path != "") & (path.startswith("/") | path.contains("\\") | F.array_contains(F.split(path, "/"), "")), "bad path"),
            (local & rooted & dotted, "bad path"),
            (local & to.isNull(), "leaves the store"),
            (local & V.is_private(to), "private path"),
            (taken & ~q["sound"], "bad link query"),
        ]
        problem = F.lit(None).cast("string")
        for wrong, said in reversed(rules):
            problem = F.when(wrong, said).otherwise(problem)
        kind = F.when(form == "url", "url").when(~p["here"], "brain").when(p["record"] | V.is_record_path(to), "record").otherwise("note")
        shown = F.when(form == "url", p["text"]).when(p["here"], to).otherwise(F.concat(F.lit("bf://"), p["host"], F.lit("/"), to))
        return let(
            F.struct(problem.alias("problem"), kind.alias("kind"), shown.alias("to"), F.when(form == "url", "").otherwise(p["anchor"]).alias("anchor"), F.when(taken, q["pairs"]).alias("pairs")),
            lambda r: F.struct(
                *(F.when(r["problem"].isNull(), r[c]).alias(c) for c in ("to", "kind", "anchor")),
                F.map_from_entries(F.when(r["problem"].isNull() & r["pairs"].isNotNull(), r["pairs"]).otherwise(F.array().cast("array<struct<key:string,value:string>>"))).alias("meta"),
                r["problem"].alias("problem"),
            ),
        )

    return let(pieces(text, own), lambda p: let(F.struct(p.alias("p"), target(p).alias("to"), parameters(p["query"]).alias("q")), ruled))


def with_attributes(link: Column, attributes: Column) -> Column:
    """A link in normal form with what is written beside it; a key that says something else in both is a problem."""
    wrong = F.exists(F.map_entries(attributes), lambda e: ~e["key"].rlike(META_KEY) | (F.trim(e["value"]) == "") | unclean(e["value"]))
    clash = F.exists(F.map_entries(attributes), lambda e: F.coalesce(F.try_element_at(link["meta"], e["key"]) != e["value"], F.lit(False)))
    more = F.map_filter(attributes, lambda k, v: ~F.map_contains_key(link["meta"], k))
    problem = F.when(link["problem"].isNotNull(), link["problem"]).when(wrong, "bad link attribute").when(clash, "conflicting link metadata")
    return F.struct(link["to"].alias("to"), link["kind"].alias("kind"), link["anchor"].alias("anchor"), F.map_concat(link["meta"], more).alias("meta"), problem.alias("problem"))


def normalize_links(df: DataFrame, origin: str, raw: str, own: str = "", relative: bool = True) -> DataFrame:
    """Add to, kind, anchor, meta and problem (null if sound); null links give a problem. Columns with these names go."""
    names = ("to", "kind", "anchor", "meta", "problem")
    found = df.drop(*names)
    return found.withColumn("link", normal(F.col(origin), F.col(raw), own, relative)).select(*(F.col(f"`{c}`") for c in found.columns if c != "link"), *(F.col(f"link.{n}").alias(n) for n in names))

"""Scalar functions over records as Columns: durations, times, redaction, slugs, paths, spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the record format: names, kinds, duration units in seconds, sources that records can't have.
NAME = "^[a-z][a-z0-9-]{0,63}$"
EVENT_KIND = "^[a-z][a-z0-9._-]{0,127}$"
UNITS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0, "w": 604800.0, "y": 31557600.0}
AUTHORED = ("projects", "concepts", "actions")
RESERVED = (*AUTHORED, "memories", "notes", "record", "logs", "evals", "bf", "loops")
PRIVATE = (".bf", ".git", ".venv", ".env")
#: Longest duration that counts, 100 years.
LONGEST = 100 * UNITS["y"]

# Fixed values of the redaction rule, in Java syntax: what a secret looks like.
SECRET_KEY = (
    "(?i:(?<![A-Za-z0-9])(?:password|passwd|(?:client[_-]?)?secret(?:[_-]?access[_-]?key|[_-]?key)?|private[_-]?key|api[_-]?key"
    "|(?:access|refresh|auth|api|session|id|bot|private|gh|github|oauth|bearer)[_-]?token))"
)
SECRET_VALUE = r"""(?:\\?"[^"\r\n]{1,8192}"?|\\?'[^'\r\n]{1,8192}'?|[^\s"',;}{\]]{1,8192})"""
PEM = "[A-Z0-9 ]{0,32}PRIVATE KEY-----"
SECRET = (
    r"(?i:\bbearer\s+[A-Za-z0-9._~+/=-]{8,}|\bauthorization\s*[:=]\s*basic\s+[A-Za-z0-9+/=-]{8,})"
    r"|(?<=://)[^/\s:@]{1,64}:[^/\s@]{1,128}(?=@)"
    r"|(?:gh[pousr]_|github_pat_|AKIA|ASIA|AIza|ya29\.|sk-|xox[baprs]-)[A-Za-z0-9._-]{8,}"
    rf"|-----BEGIN {PEM}(?:(?!-----(?:BEGIN|END) {PEM})[\s\S]){{0,16384}}(?:-----END {PEM})?"
    rf"""|{SECRET_KEY}(?:\\?["'])?\s*[:=]\s*{SECRET_VALUE}"""
)
REDACTED = "[REDACTED]"
CONTROL = r"[\x00-\x1f\x7f-\x9f]"
TEXT_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
FORMAT = (
    r"\u00ad\u0600-\u0605\u061c\u06dd\u070f\u0890\u0891\u08e2\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff\ufff9-\ufffb"
    r"\x{110bd}\x{110cd}\x{13430}-\x{1343f}\x{1bca0}-\x{1bca3}\x{1d173}-\x{1d17a}\x{e0001}\x{e0020}-\x{e007f}"
)
INVISIBLE = f"[{FORMAT}]"
#: What is escaped in text for a terminal: all of it, and in JSON, whose encoder has escaped the low controls.
UNPRINTABLE, TERMINAL = rf"[\x00-\x1f\x7f-\x9f\u2028\u2029{FORMAT}]", rf"[\x7f-\x9f\u2028\u2029{FORMAT}]"


def sha256_hex(value: Column) -> Column:
    return F.sha2(value.cast("string"), 256)


def record_path(source: Column, record_id: Column) -> Column:
    """Where a record is kept: its source's folder and the hash of its id; null for a name or id that can't be."""
    id_ = record_id.cast("string")
    sound = source.rlike(NAME) & ~source.isin(*RESERVED) & (id_ != "") & ~id_.rlike(r"(?U)\s") & ~id_.rlike(INVISIBLE)
    return F.when(sound, F.concat(F.lit("memories/"), source, F.lit("/"), sha256_hex(id_), F.lit(".json")))


def duration_seconds(text: Column, maximum: float = LONGEST) -> Column:
    """Seconds of a duration such as 1h30m; null if it isn't one, is zero or is over the maximum."""
    number = F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)(ms|s|m|h|d|w|y)"), F.lit(1))
    unit = F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)(ms|s|m|h|d|w|y)"), F.lit(2))
    size = F.create_map(*(F.lit(x) for u, s in UNITS.items() for x in (u, s)))
    total = F.aggregate(F.zip_with(number, unit, lambda n, u: n.cast("double") * size[u]), F.lit(0.0), lambda a, b: a + b)
    return F.when(text.rlike(r"^(?:[0-9]+(?:\.[0-9]+)?(?:ms|s|m|h|d|w|y))+$") & (total > 0) & (total <= maximum), total)


def duration_whole_seconds(text: Column, maximum: float = LONGEST) -> Column:
    """duration_seconds() where it is a whole number."""
    s = duration_seconds(text, maximum)
    return F.when(s == F.round(s), s.cast("long"))


def normalize_date(text: Column) -> Column:
    """YYYY-MM-DD if that is a day of the calendar but its first or last; else null."""
    day = F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))
    shown = F.date_format(day, "yyyy-MM-dd")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & (shown == text) & ~text.isin("0001-01-01", "9999-12-31"), shown)


#: An ISO-8601 time with a zone, in its long and its short form: date, hours, minutes, seconds, fraction, zone.
ISO = r"^(\d{4}-\d{2}-\d{2}|\d{8})[^0-9](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?)?(Z|[+-]\d{2}(?::?\d{2})?)$"


def zoned(text: Column) -> Column:
    """The instant of an ISO-8601 time with a zone; null for others. Minutes and seconds may be left out, colons and hyphens
    too, a fraction follows a point or comma and counts to the microsecond. Dates by weeks aren't taken."""
    part = lambda i: F.regexp_extract(text, ISO, i)
    or_zero = lambda c: F.when(c == "", "00").otherwise(c)
    day = F.regexp_replace(F.replace(part(1), F.lit("-"), F.lit("")), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    zone = F.regexp_replace(part(6), r"^([+-]\d{2}):?(\d{2})?$", "$1:$2")
    clock = F.concat_ws(":", part(2), or_zero(part(3)), or_zero(part(4)))
    shown = F.concat(day, F.lit("T"), clock, F.lit("."), F.rpad(part(5), 6, "0"), F.when(F.length(zone) == 4, F.concat(zone, F.lit("00"))).otherwise(zone))
    return F.when(text.rlike(ISO), F.try_to_timestamp(shown))


def normalize_time(text: Column) -> Column:
    """An ISO-8601 time with a zone in UTC whole seconds, cut not rounded, with Z; else null."""
    return F.date_format(zoned(text), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def show_time(instant: Column) -> Column:
    """A time without zone, or an instant in a UTC session, in the normal form."""
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def ts_key(text: Column) -> Column:
    """Comparable form of a date (its last microsecond) or a zoned time; anything else stays as it is."""
    shown = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
    return F.coalesce(F.concat(normalize_date(text), F.lit("T23:59:59.999999Z")), F.date_format(zoned(text), shown), text)


def redact(text: Column) -> Column:
    """Secrets replaced by a mark."""
    return F.regexp_replace(text, SECRET, r"[REDACTED]")


def secret_key(name: Column) -> Column:
    """Whether a field's name says that its value is a secret."""
    return name.rlike(f"(?:{SECRET_KEY}|(?i:(?<![A-Za-z0-9])(?:proxy[_-]?)?authorization))$")


def redact_map(values: Column) -> Column:
    """A map of strings with the values of secret keys replaced whole, if there are any, and secrets in the others."""
    return F.transform_values(values, lambda k, v: F.when(secret_key(k) & (v != ""), F.lit(REDACTED)).otherwise(redact(v)))


def redact_variant(value: object) -> object:
    """Any JSON value with secrets in its text replaced, keys included; under a secret key, text and lists of text are replaced
    whole. Empty text, numbers and null have nothing to hide; objects and mixed lists are gone into."""
    import re

    if not hasattr(redact_variant, "patterns"):
        redact_variant.patterns = re.compile(SECRET), re.compile(f"(?:{SECRET_KEY}|(?i:(?<![A-Za-z0-9])(?:proxy[_-]?)?authorization))$")
    text, key = redact_variant.patterns
    if isinstance(value, str):
        return text.sub(REDACTED, value)
    if isinstance(value, list):
        return [redact_variant(v) for v in value]
    if isinstance(value, dict):
        hidden = {str: lambda v: REDACTED if v else v, list: lambda v: [REDACTED] * len(v) if v and {type(x) for x in v} == {str} else redact_variant(v)}
        return {text.sub(REDACTED, k): hidden.get(type(v), redact_variant)(v) if key.search(k) else redact_variant(v) for k, v in value.items()}
    return value


def is_clean(text: Column) -> Column:
    return (F.length(F.trim(text)) > 0) & ~text.rlike(CONTROL)


def is_clean_text(text: Column) -> Column:
    return ~text.rlike(TEXT_CONTROL)


def has_invisible(text: Column) -> Column:
    return text.rlike(INVISIBLE)


def escape_invisible(text: Column, pattern: str = UNPRINTABLE) -> Column:
    """Control and format characters as \\uXXXX, two for those beyond the first plane, for output on terminals."""
    units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    shown = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike(pattern), units(c)).otherwise(c)), "")
    return F.when(text.rlike(pattern), shown).otherwise(text)


def collapse_space(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


#: Named characters of HTML that are common in text (fixed values); & comes last, so that nothing is replaced twice.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": "\u00a0", "&amp;": "&"}


def strip_html(text: Column) -> Column:
    """Text without tags and with the common named characters as themselves, white space collapsed."""
    out = F.regexp_replace(text, "<[^>]*>", " ")
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return collapse_space(out)


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def title_of_slug(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("-"), F.lit(" ")))


def headings(text: Column) -> Column:
    """Titles of # headings, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^ {0,3}#{1,6}[ \t]+(.+?)(?:[ \t]+\{[^}]*\})?[ \t]*$"), F.lit(1))


def query_map(uri: Column) -> Column:
    """Decoded parameters after ? and before # as a map; null without any, or if one is malformed or comes twice."""
    from recordmill.functions import links

    query = F.regexp_extract(uri, r"\?([^#]*)", 1)
    found = links.parameters(query)
    return F.when((query != "") & found["sound"], F.map_from_entries(F.when(found["sound"], found["pairs"])))


#: key=value, key="value" and key='value' of an attribute list.
PAIR = r"""([A-Za-z_][\w.-]*)=("[^"]*"|'[^']*'|[^\s"'}]+)"""


def attribute_map(text: Column) -> Column:
    """Pairs of an attribute list as a map; values may be quoted and hold spaces; of repeated keys the last counts."""
    body = F.regexp_extract(text, r"\{:?\s*([^}]*)\}", 1)
    keys, raw = (F.regexp_extract_all(body, F.lit(PAIR), F.lit(i)) for i in (1, 2))
    pairs = F.zip_with(keys, raw, lambda k, v: F.struct(k.alias("key"), F.regexp_replace(v, r"""^["']|["']$""", "").alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def tags(values: Column) -> Column:
    """Distinct sound tags in order of first appearance; tags_problem() says whether others were among them."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: v.cast("string")), _sound_tag))


def _sound_tag(tag: Column) -> Column:
    """Neither blank nor with a slash, backslash, white space or control character."""
    return F.coalesce((tag != "") & ~tag.rlike(r"(?U)[/\\\s]") & ~tag.rlike(CONTROL), F.lit(False))


def tags_problem(values: Column) -> Column:
    """What is wrong with a list of tags; null if nothing is."""
    return F.when(F.exists(values, lambda v: ~_sound_tag(v.cast("string"))), F.lit("tags must be nonempty tokens without spaces or slashes"))


def parts(path: Column) -> Column:
    return F.split(path, "/")


def is_bad_relative(path: Column) -> Column:
    """A backslash, or an empty, . or .. part."""
    return path.contains("\\") | F.exists(parts(path), lambda p: p.isin("", ".", ".."))


def is_private(path: Column) -> Column:
    found = F.filter(F.transform(parts(path), F.lower), lambda p: p != "")
    hidden = F.exists(found, lambda p: p.isin(*PRIVATE) | (p.startswith(".env.") & (p != ".env.example")))
    return (F.size(found) == 0) | (F.try_element_at(found, F.lit(1)) == "logs") | hidden


def note_role(path: Column) -> Column:
    """projects, concepts or actions for a note's path; else null."""
    p = parts(path)
    lock = F.substring_index(path, "/", -1).startswith(".#")
    return F.when(
        path.endswith(".md") & ~lock,
        F.when(p[0].isin("projects", "concepts") & (F.size(p) >= 2), p[0]).when((p[0] == "actions") & (F.size(p) == 3) & (F.substring_index(path, "/", -1) == "ACTION.md"), F.lit("actions")),
    )


def compiled_path(path: Column) -> Column:
    """Where a note's compiled form is kept."""
    role = note_role(path)
    return F.when(role == "actions", F.concat(F.lit("memories/actions/"), F.split_part(path, F.lit("/"), F.lit(2)), F.lit(".json"))).when(role.isNotNull(), F.concat(F.lit("memories/"), F.regexp_replace(path, r"\.md$", ".json")))


def is_record_path(path: Column) -> Column:
    p = parts(path)
    name = F.try_element_at(p, F.lit(3))
    sound = (F.size(p) == 3) & (p[0] == "memories") & F.try_element_at(p, F.lit(2)).rlike(NAME) & name.endswith(".json") & (F.length(name) > 5) & ~name.startswith(".")
    return F.coalesce(sound & ~F.try_element_at(p, F.lit(2)).isin(*RESERVED) & ~is_bad_relative(path) & ~path.rlike(r"[\x00-\x1f\x7f-\x9f\s]") & ~path.contains(":"), F.lit(False))


def link_problem(kind: Column, to: Column, anchor: Column) -> Column:
    """What is wrong with a stored link, as a short word; empty if nothing is.

    For each kind the shape that its target must have, as a table; a target of no kind has no shape.
    """
    inner = F.regexp_extract(to, "^bf://[^/]+/(.+)$", 1)
    safe = lambda path: ~path.contains(":") & ~is_bad_relative(path) & ~is_private(path)
    shapes = {
        "url": to.rlike("(?i)^(https|http|mailto|urn):"),
        "record": is_record_path(to),
        "note": to.rlike("^(projects|concepts|actions)/") & safe(to),
        "brain": to.rlike(r"^bf://[^/\\]+/.") & safe(inner),
    }
    plain = ~to.rlike(r"[\x00-\x1f\x7f-\x9f\s]")
    out = F.when((anchor != "") & ((kind == "record") | to.endswith(".json")), "anchor").otherwise("")
    for name, shape in shapes.items():
        out = F.when((kind == name) & ~(plain & shape), name).otherwise(out)
    return out


def format_span(seconds: Column) -> Column:
    """The two largest units of a span, such as 3h20m; under a second in ms."""
    rest, shown = F.rint(seconds).cast("long"), []
    for name in ("w", "d", "h", "m", "s"):
        size = int(UNITS[name])
        n = F.floor(rest / size)
        shown.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(name))))
        rest = rest - n * size
    return F.when(seconds < 1, F.concat(F.greatest(F.lit(0), F.rint(seconds * 1000)).cast("long").cast("string"), F.lit("ms"))).otherwise(F.array_join(F.slice(F.array_compact(F.array(*shown)), 1, 2), ""))


#: What ends a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def lines(text: Column) -> Column:
    """The lines of a text, without what ends them; nothing follows the last end."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_slice(text: Column, start: int, count: int) -> Column:
    """Lines from the start-th (1-based) on, put together by line feeds."""
    return F.array_join(F.slice(lines(text), start, count), "\n")


def tsv_cell(value: Column) -> Column:
    """A value for one cell: tabs and line ends become spaces."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\t\r\n]", " ")


def fits_bytes(text: Column, limit: int) -> Column:
    return F.octet_length(text) <= limit


def cut_to_bytes(text: Column, limit: int) -> Column:
    """The longest prefix of whole characters that fits."""
    sizes = F.transform(F.split(F.substring(text, 1, limit), ""), F.octet_length)
    fits = F.aggregate(sizes, F.struct(F.lit(0).alias("n"), F.lit(0).alias("b")), lambda a, s: F.when(a["b"] + s <= limit, F.struct((a["n"] + 1).alias("n"), (a["b"] + s).alias("b"))).otherwise(F.struct(a["n"].alias("n"), F.lit(limit + 1).alias("b"))))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.left(F.substring(text, 1, limit), fits["n"]))

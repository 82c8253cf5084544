"""jq programs that look into another part of their stream, as joins, and folds over arrays and over the stream.

`INDEX` and lists of values become relations of their own, split from the stream by their filters: looking a key up is
a left join with one row a key, `IN` a semi join, `IN | not` an anti join, `JOIN` a left join with both sides at
hand. A fold over an array keeps its states in one `aggregate`; a running sum over the stream is a sum over ranges.
Functions are put in place of their calls first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill.plans.jq import compiler as C
from recordmill.plans.jq.syntax import JqError
from recordmill.sources.records import with_running

EACH = ("each", ("dot",))


@dataclass
class Bound:
    """A relation that a variable names: one row a key with its record (an index), or distinct values (a list)."""

    rows: DataFrame
    kind: T.DataType
    index: bool


def stages(tree: tuple) -> list[tuple]:
    return [*stages(tree[1]), *stages(tree[2])] if tree[0] == "pipe" else [tree]


def dot_of(df: DataFrame) -> C.Dot:
    return C.Dot.of(df) if df.columns != ["value"] else C.Dot(df.schema["value"].dataType, F.col("value"))


def part_of(df: DataFrame, tree: tuple) -> DataFrame:
    """What the stages after `.[]` make of the stream."""
    first, *rest = stages(tree)
    if first != EACH:
        raise C.Unsupported("a part of the stream")
    for stage in rest:
        df = C.spread(df, stage)
    return df


def index_of(df: DataFrame, args: tuple, order: tuple[str, ...]) -> Bound:
    """The record of each key as text; of records with one key the last of the stream's order, or else the greatest."""
    stream, key = (EACH, args[0]) if len(args) == 1 else args
    rows = part_of(df, stream)
    record = F.struct(*rows.columns)
    one = F.max_by("v", F.struct(*order)) if order and set(order) <= set(rows.columns) else F.max("v")
    picked = rows.select(C.as_text(C.compile_(key, dot_of(rows))).alias("k"), record.alias("v"), *order)
    return Bound(picked.groupBy("k").agg(one.alias("v")), rows.schema, True)


def list_of(df: DataFrame, tree: tuple) -> Bound:
    rows = part_of(df, tree)
    if rows.columns != ["value"]:
        raise C.Unsupported("a list of records")
    return Bound(rows.distinct(), rows.schema["value"].dataType, False)


def bindings(df: DataFrame, tree: tuple, order: tuple[str, ...]) -> tuple[dict[str, Bound], tuple]:
    """The relations that a program names before it goes on, and what follows."""
    found: dict[str, Bound] = {}
    while tree[0] == "as" and tree[2][0] == "var":
        value = tree[1]
        if value[0] == "call" and value[1] == "INDEX" and len(value[2]) in (1, 2):
            found[tree[2][1]] = index_of(df, value[2], order)
        elif value[0] == "array" and value[1] is not None:
            found[tree[2][1]] = list_of(df, value[1])
        else:
            raise C.Unsupported("binding")
        tree = tree[3]
    if not found:
        raise C.Unsupported("no relation")
    return found, tree


def free(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def looked_up(df: DataFrame, bound: Bound, key: Column, name: str) -> DataFrame:
    """The rows with the record of their key beside them, null where there is none."""
    at = free(df, "_key")
    right = bound.rows.select(F.col("k").alias(at), F.col("v").alias(name))
    left = free(df, "_text")
    return df.withColumn(left, key).join(right, F.col(left) == F.col(at), "left").drop(left, at)


def replaced(tree, found: dict):
    """A tree with some of its parts replaced."""
    if not isinstance(tree, tuple):
        return tree
    return found[tree] if tree in found else tuple(replaced(t, found) for t in tree)


def lookups(tree, names: dict[str, Bound]) -> list[tuple]:
    """The places of a tree where an index is looked into, each once."""
    if not isinstance(tree, tuple):
        return []
    own = [tree] if len(tree) == 3 and tree[0] == "index" and tree[1][:1] == ("var",) and tree[1][1] in names and names[tree[1][1]].index else []
    return list(dict.fromkeys([*own, *(x for t in tree for x in lookups(t, names))]))


def conditions(tree: tuple) -> list[tuple]:
    return [*conditions(tree[2]), *conditions(tree[3])] if tree[:2] == ("binary", "and") else [tree]


def membership(tree: tuple, names: dict[str, Bound]) -> tuple[tuple, Bound, str] | None:
    """The value, the list and the kind of join of `value | IN($list[])`, with or without `not` after it."""
    parts = stages(tree)
    how = "left_semi"
    if parts[-1] == ("call", "not", ()):
        parts, how = parts[:-1], "left_anti"
    last = parts[-1]
    if last[:2] != ("call", "IN") or last[2][-1][:1] != ("each",) or last[2][-1][1][:1] != ("var",) or last[2][-1][1][1] not in names:
        return None
    if len(last[2]) == 2:
        parts = [last[2][0]] if len(parts) == 1 else [*parts[:-1], last[2][0]]
    else:
        parts = parts[:-1] or [("dot",)]
    value = parts[-1]
    for stage in reversed(parts[:-1]):
        value = ("pipe", stage, value)
    return value, names[last[2][-1][1][1]], how


def step(df: DataFrame, tree: tuple, names: dict[str, Bound]) -> DataFrame:
    """One stage after `.[]`, with what it looks up joined to it."""
    if tree[:2] == ("call", "select"):
        for one in conditions(tree[2][0]):
            if found := membership(one, names):
                value, bound, how = found
                d = C.compile_(value, dot_of(df))
                if bound.index or d.column is None or not C.comparable(d, C.Dot(bound.kind)):
                    raise C.Unsupported("IN")
                at, here = free(df, "_in"), free(df, "_value")
                df = df.withColumn(here, d.column).join(bound.rows.select(F.col("value").alias(at)), F.col(here).eqNullSafe(F.col(at)), how).drop(here)
            else:
                df = with_lookups(df, one, names, lambda d, t, n: d.where(C.truth(C.compile_(t, dot_of(df), n))))
        return df
    if not lookups(tree, names):
        return C.spread(df, tree)
    return with_lookups(df, tree, names, lambda d, t, n: C.project(d, C.compile_(t, dot_of(df), n)))


def with_lookups(df: DataFrame, tree: tuple, names: dict[str, Bound], then) -> DataFrame:
    both, vars_, places = df, {}, {}
    for i, place in enumerate(lookups(tree, names)):
        bound, name = names[place[1][1]], free(df, f"_found{i}")
        both = looked_up(both, bound, C.as_text(C.compile_(place[2], dot_of(df))), name)
        places[place], vars_[name] = ("var", name), C.Dot(bound.kind, F.col(f"`{name}`"))
    out = then(both, replaced(tree, places), vars_)
    return out.drop(*vars_) if set(vars_) & set(out.columns) else out


def joined(df: DataFrame, tree: tuple, order: tuple[str, ...]) -> DataFrame:
    """`INDEX(...) as $x | .[] | ...`, `[...] as $xs | .[] | select(... | IN($xs[]))` and `INDEX(...) as $x | JOIN($x; ...)`."""
    names, tree = bindings(df, tree, order)
    first, *rest = stages(tree)
    if first[:2] == ("call", "JOIN") and len(first[2]) == 4 and first[2][0][:1] == ("var",) and first[2][0][1] in names:
        bound = names[first[2][0][1]]
        left = part_of(df, first[2][1])
        item, found = dot_of(left), free(left, "_found")
        both = looked_up(left, bound, C.as_text(C.compile_(first[2][2], item)), found)
        pair = {("index", ("dot",), ("literal", 0)): ("var", "_item"), ("index", ("dot",), ("literal", 1)): ("var", "_found")}
        out = C.project(both, C.compile_(replaced(first[2][3], pair), C.Dot(T.NullType(), F.lit(None)), {"_item": item, "_found": C.Dot(bound.kind, F.col(f"`{found}`"))}))
    elif first == EACH:
        out = df
    else:
        raise C.Unsupported("relation")
    for stage in rest:
        out = step(out, stage, names)
    return out


# ---- folds and ranges


def expanded(df: DataFrame, tree: tuple, dot: C.Dot, names: dict[str, C.Dot]) -> DataFrame:
    """`value as $x | ...` before an expression with several outputs: a fold over an array, a range, or the first items."""
    if tree[0] == "as" and tree[2][0] == "var":
        return expanded(df, tree[3], dot, {**names, tree[2][1]: C.compile_(tree[1], dot, names)})
    if tree[0] == "foreach":
        return fold(df, tree, dot, names)
    first, *rest = stages(tree)
    if first[0] != "call" or not rest:
        raise C.Unsupported(first[0])
    _, name, args = first
    if name == "range" and 1 <= len(args) <= 2:
        lo, hi = (C.Dot(T.LongType(), F.lit(0)), C.compile_(args[0], dot, names)) if len(args) == 1 else (C.compile_(a, dot, names) for a in args)
        if not (isinstance(lo.kind, T.IntegralType) and isinstance(hi.kind, T.IntegralType)):
            raise C.Unsupported("range of fractions")
        a, b = lo.column.cast("long"), hi.column.cast("long")
        kind, items = T.LongType(), F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    elif name in ("limit", "first") and args[-1][0] == "each":
        array = C.compile_(args[-1][1], dot, names)
        if not isinstance(array.kind, T.ArrayType) or name == "limit" and (args[0][0] != "literal" or type(args[0][1]) is not int or args[0][1] < 0):
            raise C.Unsupported(name)
        kind, items = array.kind.elementType, F.slice(array.column, 1, 1 if name == "first" else args[0][1])
    else:
        raise C.Unsupported(name)
    at = free(df, "_item")
    out = df.select("*", F.explode(items).alias(at))
    item = C.Dot(kind, F.col(f"`{at}`"))
    for stage in rest[:-1]:
        if stage[:2] != ("call", "select"):
            raise C.Unsupported("stage")
        out = out.where(C.truth(C.compile_(stage[2][0], item, names)))
    return C.project(out, C.compile_(rest[-1], item, names))


def fold(df: DataFrame, tree: tuple, dot: C.Dot, names: dict[str, C.Dot]) -> DataFrame:
    """`foreach array[] as $x (start; update; result)`: an output for each state; arrays are those of one record."""
    _, source, pattern, start, update, *extract = tree
    if source[0] != "each" or pattern[0] != "var":
        raise C.Unsupported("foreach")
    items, begin = C.compile_(source[1], dot, names), C.compile_(start, dot, names)
    if not isinstance(items.kind, T.ArrayType) or begin.column is None:
        raise C.Unsupported("foreach")
    element, nothing = items.kind.elementType, F.lit(None)
    one = lambda state, x: C.compile_(update, state, {**names, pattern[1]: C.Dot(element, x)})
    kind = one(C.Dot(begin.kind, nothing.cast(begin.kind)), nothing.cast(element)).kind
    if kind is None or one(C.Dot(kind, nothing.cast(kind)), nothing.cast(element)).kind != kind:
        raise C.Unsupported("a state that changes its type")
    empty = F.array().cast(T.ArrayType(kind))

    def keep(found: Column, x: Column) -> Column:
        state = one(C.Dot(kind, found["state"]), x).column.cast(kind)
        return F.struct(state.alias("state"), F.array_append(found["all"], state).alias("all"))

    states = F.aggregate(items.column, F.struct(begin.column.cast(kind).alias("state"), empty.alias("all")), keep)["all"]
    at = free(df, "_fold")
    out = df.select("*", F.explode(F.zip_with(items.column, states, lambda x, s: F.struct(x.alias("item"), s.alias("state")))).alias(at))
    result = extract[0] if extract and extract[0] is not None else ("dot",)
    return C.project(out, C.compile_(result, C.Dot(kind, F.col(f"`{at}`.state")), {**names, pattern[1]: C.Dot(element, F.col(f"`{at}`.item"))}))


def running(df: DataFrame, tree: tuple, order: tuple[str, ...]) -> DataFrame:
    """`foreach (., inputs) as $x (start; . + value; result)`: a running sum over the stream in its order, by ranges."""
    _, source, pattern, start, update, *extract = tree
    if source != C.ALL[1] or pattern[0] != "var" or start[0] != "literal" or type(start[1]) is not int or update[:3] != ("binary", "+", ("dot",)):
        raise C.Unsupported("foreach")
    if not order:
        raise JqError("a program over all inputs needs an order")
    value = C.compile_(update[3], C.Dot(T.NullType(), F.lit(None)), {pattern[1]: C.Dot.of(df)})
    if not isinstance(value.kind, T.IntegralType):
        raise C.Unsupported("a running sum of this type")
    at = free(df, "_running")
    out = with_running(df, F.coalesce(value.column.cast("long"), F.lit(0)), *order, name=at, start=start[1])
    result = extract[0] if extract and extract[0] is not None else ("dot",)
    return C.project(out, C.compile_(result, C.Dot(T.LongType(), F.col(f"`{at}`")), {pattern[1]: C.Dot.of(df)}))

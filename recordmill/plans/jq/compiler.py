"""jq trees as DataFrame plans: filters, projections, explodes, groupings and orders that Catalyst can optimise.

A stream is a DataFrame with a dot: its columns (a record) or one of them (a value). What a Column can say is
compiled; `[., inputs] | ...` and reductions over all inputs become aggregates; the rest runs in the interpreter,
record by record, or, where a program looks past its own record, over the stream in order.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill.functions.order import key_of
from recordmill.plans.jq.interpreter import JqRuntimeError, outputs, show, uses_inputs
from recordmill.plans.jq.syntax import JqError, parse


class Unsupported(Exception):
    """Not expressible as a Column over these types."""


@dataclass
class Dot:
    """What an expression sees: a typed Column, or a record of typed Columns."""

    kind: T.DataType | None
    column: Column | None = None
    fields: dict[str, "Dot"] | None = None

    @staticmethod
    def of(df: DataFrame) -> "Dot":
        return Dot(df.schema, None, {f.name: Dot(f.dataType, F.col(f"`{f.name}`")) for f in df.schema})

    def field(self, name: str) -> "Dot":
        if self.fields is not None:
            return self.fields.get(name) or Dot(T.NullType(), F.lit(None))
        if isinstance(self.kind, T.StructType):
            if name not in self.kind.names:
                return Dot(T.NullType(), F.lit(None))
            return Dot(self.kind[name].dataType, self.column.getField(name))
        if isinstance(self.kind, T.MapType):
            return Dot(self.kind.valueType, F.try_element_at(self.column, F.lit(name)))
        if isinstance(self.kind, T.VariantType) and re.fullmatch(r"[A-Za-z_]\w*", name):
            return Dot(self.kind, F.try_variant_get(self.column, f"$.{name}", "variant"))
        raise Unsupported(f"field {name} of {self.kind}")

    def whole(self) -> Column:
        return F.struct(*(d.whole().alias(n) for n, d in self.fields.items())) if self.fields is not None else self.column


NUMBERS = (T.IntegralType, T.FractionalType)
MATH = {"floor": F.floor, "ceil": F.ceil, "sqrt": F.sqrt, "fabs": F.abs, "abs": F.abs, "log": F.ln, "log2": F.log2, "log10": F.log10, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "cbrt": F.cbrt}


def orderable(d: Dot) -> Column:
    """What a value is sorted and grouped by: a VARIANT by the key of jq's order over all types."""
    return key_of(d.column, d.kind) if isinstance(d.kind, T.VariantType) else d.whole()


def truth(d: Dot) -> Column:
    """null and false are false, all else is true."""
    if isinstance(d.kind, T.VariantType):
        return F.coalesce(key_of(d.column, d.kind)["rank"] > 1, F.lit(False))
    return F.coalesce(d.column, F.lit(False)) if isinstance(d.kind, T.BooleanType) else d.whole().isNotNull() if d.column is not None else F.lit(True)


def is_number(d: Dot) -> bool:
    return isinstance(d.kind, NUMBERS)


def comparable(a: Dot, b: Dot) -> bool:
    if isinstance(a.kind, T.NullType) or isinstance(b.kind, T.NullType):
        return True
    return (is_number(a) and is_number(b)) or (a.kind == b.kind and isinstance(a.kind, (T.StringType, T.BooleanType)))


def compile_(tree: tuple, dot: Dot, names: dict[str, Dot] | None = None) -> Dot:
    """The single output of an expression as a Column; Unsupported where it has none."""
    names = names or {}
    op = tree[0]
    again = lambda t: compile_(t, dot, names)
    if op == "dot":
        return dot
    if op == "literal":
        v = tree[1]
        kind = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), type(None): T.NullType()}[type(v)]
        return Dot(kind, F.lit(v).cast(kind) if v is not None else F.lit(None))
    if op == "var" and tree[1] in names:
        return names[tree[1]]
    if op == "index":
        base, key = again(tree[1]), tree[2]
        if key[0] == "literal" and isinstance(key[1], str):
            return base.field(key[1])
        k = again(key)
        if isinstance(base.kind, T.ArrayType) and is_number(k):
            return Dot(base.kind.elementType, F.try_element_at(base.column, F.when(k.column >= 0, k.column + 1).otherwise(k.column).cast("int")))
        raise Unsupported("index")
    if op == "slice":
        base = again(tree[1])
        lo = tree[2][1] if tree[2] and tree[2][0] == "literal" else 0 if tree[2] is None else None
        hi = tree[3][1] if tree[3] and tree[3][0] == "literal" else None
        if lo is None or lo < 0 or (tree[3] is not None and (hi is None or hi < 0)):
            raise Unsupported("slice")
        n = F.lit(max(0, hi - lo)) if hi is not None else F.lit(2**31 - 1)
        if isinstance(base.kind, T.StringType):
            return Dot(base.kind, F.substring(base.column, F.lit(lo + 1), n))
        if isinstance(base.kind, T.ArrayType):
            return Dot(base.kind, F.slice(base.column, lo + 1, n))
        raise Unsupported("slice")
    if op == "pipe" and tree[1] == ("array", ("call", "leaf_paths", ())) and tree[2] == ("call", "length", ()):
        return Dot(T.LongType(), leaf_count(dot.whole(), T.StructType([T.StructField(n, _kind(d)) for n, d in dot.fields.items()]) if dot.fields is not None else dot.kind))
    if op == "pipe":
        return compile_(tree[2], again(tree[1]), names)
    if op == "as" and tree[2][0] == "var":
        return compile_(tree[3], dot, {**names, tree[2][1]: again(tree[1])})
    if op == "object":
        fields = {}
        for key, value in tree[1]:
            if key[0] != "literal":
                raise Unsupported("computed key")
            fields[key[1]] = again(value)
        return Dot(None, None, fields)
    if op == "if":
        yes, no = again(tree[2]), again(tree[3])
        if not comparable(yes, no) or yes.column is None or no.column is None:
            raise Unsupported("branches of different types")
        return Dot(no.kind if isinstance(yes.kind, T.NullType) else yes.kind, F.when(truth(again(tree[1])), yes.column).otherwise(no.column))
    if op == "negate":
        d = again(tree[1])
        if is_number(d):
            return Dot(d.kind, -d.column)
    if op == "try" and tree[2] is None:
        return again(tree[1])
    if op == "string" and tree[2] is None:
        return Dot(T.StringType(), F.concat(*(F.lit(p) if isinstance(p, str) else as_text(again(p)) for p in tree[1])))
    if op == "binary":
        return compile_binary(tree, again)
    if op == "array" and tree[1] is not None:
        return collected(tree[1], again, names)
    if op == "call":
        return compile_call(tree, dot, names)
    raise Unsupported(op)


def collected(tree: tuple, again, names: dict[str, Dot]) -> Dot:
    """`[.items[] | select(...) | value]`: the items of an array that pass, each as its value."""
    parts = []
    while tree[0] == "pipe":
        parts.append(tree[1])
        tree = tree[2]
    parts.append(tree)
    if parts[0][0] != "each":
        raise Unsupported("array")
    out = again(parts[0][1])
    for part in parts[1:]:
        if not isinstance(out.kind, T.ArrayType):
            raise Unsupported("array")
        element = out.kind.elementType
        if part[:2] == ("call", "select"):
            out = Dot(out.kind, _filtered(out, part[2][0], names))
        else:
            sample = compile_(part, Dot(element, F.lit(None).cast(element)), names)
            if sample.kind is None:
                raise Unsupported("array of records")
            out = Dot(T.ArrayType(sample.kind), _mapped(out, part, names))
    return out


def _filtered(items: Dot, test: tuple, names: dict[str, Dot]) -> Column:
    return F.filter(items.column, lambda x: truth(compile_(test, Dot(items.kind.elementType, x), names)))


def _mapped(items: Dot, value: tuple, names: dict[str, Dot]) -> Column:
    return F.transform(items.column, lambda x: compile_(value, Dot(items.kind.elementType, x), names).column)


def _kind(d: Dot) -> T.DataType:
    return d.kind if d.fields is None else T.StructType([T.StructField(n, _kind(x)) for n, x in d.fields.items()])


def leaf_count(value: Column, kind: T.DataType) -> Column:
    """How many leaves a value of a known type has, as deep as it goes: those that are neither null nor false."""
    if isinstance(kind, T.StructType):
        total = F.lit(0).cast("long")
        for f in kind:
            total = total + leaf_count(value.getField(f.name), f.dataType)
        return F.coalesce(total, F.lit(0).cast("long"))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        items, inner = (value, kind.elementType) if isinstance(kind, T.ArrayType) else (F.map_values(value), kind.valueType)
        return F.coalesce(F.aggregate(items, F.lit(0).cast("long"), lambda n, x: n + leaf_count(x, inner)), F.lit(0).cast("long"))
    if isinstance(kind, T.VariantType):
        raise Unsupported("leaves of values of any type")
    return F.when(value if isinstance(kind, T.BooleanType) else value.isNotNull(), 1).otherwise(0).cast("long")


def as_text(d: Dot) -> Column:
    if isinstance(d.kind, T.StringType):
        return F.coalesce(d.column, F.lit("null"))
    if isinstance(d.kind, (T.IntegralType, T.BooleanType)):
        return F.coalesce(d.column.cast("string"), F.lit("null"))
    raise Unsupported("text of this type")


def compile_binary(tree: tuple, again) -> Dot:
    _, op, left, right = tree
    a, b = again(left), again(right)
    boolean = T.BooleanType()
    if op in ("and", "or"):
        x, y = truth(a), truth(b)
        return Dot(boolean, x & y if op == "and" else x | y)
    if op == "//":
        if not comparable(a, b):
            raise Unsupported("alternatives of different types")
        good = F.when(a.column, a.column) if isinstance(a.kind, boolean.__class__) else a.column
        return Dot(b.kind if isinstance(a.kind, T.NullType) else a.kind, F.coalesce(good, b.column))
    if op in ("==", "!=", "<", "<=", ">", ">="):
        if isinstance(a.kind, T.VariantType) or isinstance(b.kind, T.VariantType):
            x, y = (None if d.column is None else key_of(d.column, d.kind) for d in (a, b))
            if x is None or y is None:
                raise Unsupported("comparison with a nested type")
            return Dot(boolean, {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op])
        if not comparable(a, b) or a.column is None or b.column is None:
            raise Unsupported("comparison of different types")
        x, y = a.column, b.column
        same = x.eqNullSafe(y)
        less = F.coalesce(x < y, x.isNull() & y.isNotNull()) if not isinstance(b.kind, T.NullType) and not isinstance(a.kind, T.NullType) else x.isNull() & y.isNotNull()
        return Dot(boolean, {"==": same, "!=": ~same, "<": less, "<=": less | same, ">": ~(less | same), ">=": ~less}[op])
    if op == "+":
        if isinstance(a.kind, T.NullType) or isinstance(b.kind, T.NullType):
            return b if isinstance(a.kind, T.NullType) else a
        if a.kind == b.kind and isinstance(a.kind, (T.StringType, T.ArrayType)):
            return Dot(a.kind, F.when(a.column.isNull(), b.column).when(b.column.isNull(), a.column).otherwise(F.concat(a.column, b.column)))
        if is_number(a) and is_number(b):
            kind = T.DoubleType() if isinstance(a.kind, T.FractionalType) or isinstance(b.kind, T.FractionalType) else T.LongType()
            return Dot(kind, F.when(a.column.isNull(), b.column).when(b.column.isNull(), a.column).otherwise(a.column + b.column).cast(kind))
    if op in ("-", "*", "/", "%") and is_number(a) and is_number(b):
        kind = T.DoubleType() if op == "/" or isinstance(a.kind, T.FractionalType) or isinstance(b.kind, T.FractionalType) else T.LongType()
        return Dot(kind, {"-": lambda: a.column - b.column, "*": lambda: a.column * b.column, "/": lambda: F.try_divide(a.column, b.column), "%": lambda: F.try_mod(a.column.cast("long"), F.abs(b.column.cast("long")))}[op]().cast(kind))
    if op == "-" and isinstance(a.kind, T.ArrayType) and a.kind == b.kind:
        return Dot(a.kind, F.filter(a.column, lambda x: ~F.array_contains(b.column, x)))
    raise Unsupported(op)


def compile_call(tree: tuple, dot: Dot, names: dict[str, Dot]) -> Dot:
    _, name, args = tree
    boolean, string, long = T.BooleanType(), T.StringType(), T.LongType()
    arg = lambda i=0: compile_(args[i], dot, names)
    c, kind = dot.column, dot.kind
    if name == "not" and not args:
        return Dot(boolean, ~truth(dot))
    if name in ("any", "all") and len(args) == 2 and args[0][0] == "each":
        items = compile_(args[0][1], dot, names)
        if isinstance(items.kind, T.ArrayType):
            inner = lambda x: truth(compile_(args[1], Dot(items.kind.elementType, x), names))
            return Dot(boolean, F.coalesce((F.exists if name == "any" else F.forall)(items.column, inner), F.lit(name == "all")))
    if name == "has" and args[0][0] == "literal" and isinstance(args[0][1], str):
        if dot.fields is not None:
            return Dot(boolean, F.lit(args[0][1] in dot.fields))
        if isinstance(kind, T.MapType):
            return Dot(boolean, F.map_contains_key(c, args[0][1]))
    if name == "IN" and len(args) in (1, 2):
        value = dot if len(args) == 1 else arg(0)
        found = [compile_(t, dot, names) for t in flat(args[-1])]
        if value.column is None or any(d.column is None or not comparable(value, d) for d in found):
            raise Unsupported("IN of different types")
        return Dot(boolean, reduce_or([value.column.eqNullSafe(d.column) for d in found]))
    if name == "map" and isinstance(kind, T.ArrayType):
        sample = compile_(args[0], Dot(kind.elementType, F.lit(None).cast(kind.elementType)), names)
        return Dot(T.ArrayType(sample.kind or T.StructType()), F.transform(c, lambda x: compile_(args[0], Dot(kind.elementType, x), names).whole()))
    if isinstance(kind, T.StringType):
        plain = {"length": (long, F.length), "ascii_downcase": (string, lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), "ascii_upcase": (string, lambda x: F.translate(x, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")), "utf8bytelength": (long, F.octet_length), "tostring": (string, lambda x: x), "tonumber": (T.DoubleType(), lambda x: x.try_cast("double")), "trim": (string, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), "type": (string, lambda x: F.when(x.isNull(), "null").otherwise("string"))}
        if name in plain and not args:
            out, f = plain[name]
            value = f(c)
            return Dot(out, F.coalesce(value, F.lit(0)).cast("long") if name == "length" else value)
        if len(args) == 1 and name in ("startswith", "endswith", "contains", "test", "split", "ltrimstr", "rtrimstr", "index"):
            a = arg()
            if not isinstance(a.kind, T.StringType):
                raise Unsupported(name)
            x = a.column
            if name in ("startswith", "endswith", "contains"):
                return Dot(boolean, getattr(c, name)(x))
            if name == "test":
                return Dot(boolean, F.regexp_like(c, x))
            if name == "split":
                return Dot(T.ArrayType(string), F.split(c, F.concat(F.lit("\\Q"), x, F.lit("\\E"))))
            if name == "ltrimstr":
                return Dot(string, F.when(c.startswith(x), F.substring(c, F.length(x) + 1, F.length(c))).otherwise(c))
            if name == "rtrimstr":
                return Dot(string, F.when(c.endswith(x), F.left(c, F.length(c) - F.length(x))).otherwise(c))
            return Dot(long, F.nullif(F.locate(args[0][1], c), F.lit(0)).cast("long") - 1)
        if name == "test" and len(args) == 2 and args[1][:1] == ("literal",) and args[0][0] == "literal":
            flags = "".join(f for f in args[1][1] or "" if f in "ixs")
            return Dot(boolean, c.rlike(f"(?{flags}u){args[0][1]}" if flags else args[0][1]))
        if name == "gsub" and len(args) == 2 and all(a[0] == "literal" for a in args):
            return Dot(string, F.regexp_replace(c, args[0][1], args[1][1].replace("\\", "\\\\").replace("$", "\\$")))
    if isinstance(kind, T.ArrayType):
        if name == "length":
            return Dot(long, F.coalesce(F.size(c), F.lit(0)).cast("long"))
        if name in ("reverse", "first", "last", "unique", "sort", "flatten", "min", "max") and not args:
            done = {"reverse": lambda: F.reverse(c), "unique": lambda: F.array_sort(F.array_distinct(c)), "sort": lambda: F.array_sort(c)}
            if name in done:
                return Dot(kind, done[name]())
            if name == "flatten" and isinstance(kind.elementType, T.ArrayType):
                return Dot(kind.elementType, F.flatten(c))
            one = {"first": lambda: F.try_element_at(c, F.lit(1)), "last": lambda: F.try_element_at(c, F.lit(-1)), "min": lambda: F.array_min(c), "max": lambda: F.array_max(c)}
            if name in one:
                return Dot(kind.elementType, one[name]())
        if name == "join" and isinstance(kind.elementType, T.StringType) and args[0][0] == "literal":
            return Dot(string, F.array_join(F.transform(c, lambda x: F.coalesce(x, F.lit(""))), args[0][1]))
        if name == "add" and not args and isinstance(kind.elementType, NUMBERS):
            return Dot(kind.elementType, F.aggregate(c, F.lit(0).cast(kind.elementType), lambda a, x: a + x))
    if is_number(dot):
        if name in MATH and not args:
            return Dot(long if name in ("floor", "ceil") else kind if name in ("abs", "fabs") else T.DoubleType(), MATH[name](c))
        if name == "length":
            return Dot(kind, F.abs(c))
        if name == "tostring" and isinstance(kind, T.IntegralType):
            return Dot(string, c.cast("string"))
        if name == "type":
            return Dot(string, F.when(c.isNull(), "null").otherwise("number"))
    if name in ("type",) and isinstance(kind, T.BooleanType):
        return Dot(string, F.when(c.isNull(), "null").otherwise("boolean"))
    raise Unsupported(name)


def reduce_or(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def inlined(tree, functions: dict | None = None):
    """A tree with the bodies of its own functions in place of their calls; a function that calls itself stays unsupported."""
    functions = functions or {}
    if not isinstance(tree, tuple) or not tree:
        return tree
    if tree[0] == "def":
        _, name, params, body, rest = tree
        return inlined(rest, {**functions, (name, len(params)): (params, body, functions)})
    if tree[0] == "call" and (tree[1], len(tree[2])) in functions:
        params, body, outer = functions[(tree[1], len(tree[2]))]
        args = [inlined(a, functions) for a in tree[2]]
        if any("'var'" in repr(a) for p, a in zip(params, args) if not p.startswith("$")):
            raise Unsupported("a variable that the body could bind anew")
        out = inlined(body, {**outer, **{(p, 0): ((), a, {}) for p, a in zip(params, args) if not p.startswith("$")}})
        for p, a in reversed(list(zip(params, args))):
            if p.startswith("$"):
                out = ("as", a, ("var", p[1:]), out)
        return out
    return tuple(inlined(t, functions) for t in tree)


# ---- streams


def project(df: DataFrame, d: Dot) -> DataFrame:
    """Rows of a dot: a record's columns, or one column called value."""
    if d.fields is not None:
        return df.select(*(x.whole().alias(n) for n, x in d.fields.items()))
    return df.select(d.column.alias("value"))


def spread(df: DataFrame, tree: tuple) -> DataFrame:
    """Stage by stage: filters, explodes, fan-outs and projections."""
    dot = Dot.of(df) if df.columns != ["value"] else Dot(df.schema["value"].dataType, F.col("value"))
    op = tree[0]
    if op == "pipe":
        return spread(spread(df, tree[1]), tree[2])
    if op == "dot":
        return df
    if op == "call" and tree[1] == "select":
        return df.where(truth(compile_(tree[2][0], dot)))
    if op == "call" and tree[1] == "empty":
        return df.limit(0)
    if op == "try" and tree[1][0] == "each" and tree[2] is None or op == "each":
        items = compile_((tree[1] if op == "try" else tree)[1], dot)
        if not isinstance(items.kind, T.ArrayType):
            raise Unsupported("explode")
        out = df.select(F.explode(items.column).alias("value"))
        return out.select("value.*") if isinstance(items.kind.elementType, T.StructType) else out
    if op == "comma":
        return each_of(df, dot, flat(tree))
    if op == "as" and tree[2][0] == "var" and tree[3][0] == "pipe":
        return correlated(df, dot, tree)
    if op == "call" and tree[1] == "del":
        gone = [a[2][1] for a in flat(tree[2][0]) if a[0] == "index" and a[1] == ("dot",)]
        if len(gone) == len(flat(tree[2][0])):
            return df.drop(*gone)
    if op == "binary" and tree[1] in ("=", "|=", "+=", "-=", "*=", "/=") and tree[2][0] == "index" and tree[2][1] == ("dot",):
        name = tree[2][2][1]
        old = dot.field(name)
        new = compile_(tree[3], dot) if tree[1] == "=" else compile_(tree[3], old) if tree[1] == "|=" else compile_(("binary", tree[1][0], tree[2], tree[3]), dot)
        return df.withColumn(name, new.whole())
    return project(df, compile_(tree, dot))


def flat(tree: tuple) -> list[tuple]:
    return [*flat(tree[1]), *flat(tree[2])] if tree[0] == "comma" else [tree]


def each_of(df: DataFrame, dot: Dot, trees: list[tuple]) -> DataFrame:
    """One row for each of several outputs of one type."""
    found = [compile_(t, dot) for t in trees]
    if any(not comparable(found[0], d) for d in found) or any(d.column is None for d in found):
        raise Unsupported("outputs of different types")
    return df.select(F.explode(F.array(*(d.column for d in found))).alias("value"))


def correlated(df: DataFrame, dot: Dot, tree: tuple) -> DataFrame:
    """`. as $r | .items[] | ...`: exploded items beside the record."""
    _, bound, (_, name), (_, first, rest) = tree
    if bound != ("dot",) or first[0] != "each":
        raise Unsupported("binding")
    items = compile_(first[1], dot)
    if not isinstance(items.kind, T.ArrayType):
        raise Unsupported("explode")
    both = df.select(*df.columns, F.explode(items.column).alias("_item"))
    item = Dot(items.kind.elementType, F.col("_item"))
    while rest[0] == "pipe" and rest[1][0] == "call" and rest[1][1] == "select":
        both = both.where(truth(compile_(rest[1][2][0], item, {name: dot})))
        rest = rest[2]
    return project(both, compile_(rest, item, {name: dot}))


ALL = ("array", ("comma", ("dot",), ("call", "inputs", ())))


def gathered(df: DataFrame, tree: tuple, stream: tuple[str, ...] = ()) -> DataFrame:
    """Programs over `[., inputs]`: groupings, orders, distinct rows, slices and totals of the whole stream.

    stream: the columns of the stream's order, by which the first of equal ones counts; without it the least does.
    """
    dot = Dot.of(df)
    place = F.struct(*stream) if stream else None
    stages = []
    while tree[0] == "pipe":
        stages.append(tree[1])
        tree = tree[2]
    stages.append(tree)
    order: list[Column] = []
    grouped: list[Dot] | None = None
    for n, s in enumerate(stages):
        last = n == len(stages) - 1
        name, args = (s[1], s[2]) if s[0] == "call" else (s[0], ())
        if grouped is not None:
            if name not in ("map",) or args[0][0] != "object":
                raise Unsupported("groups")
            df = df.groupBy(*(orderable(d).alias(f"_k{i}") for i, d in enumerate(grouped))).agg(*(aggregate(v, dot, place if set(stream) <= set(df.columns) else None).alias(k[1]) for k, v in args[0][1])).drop(*(f"_k{i}" for i in range(len(grouped))))
            grouped, order = None, []
        elif name == "group_by":
            keys = args[0][1] if args[0][0] == "array" else args[0]
            grouped = [compile_(k, dot) for k in flat(keys)]
            continue
        elif name in ("sort_by", "sort"):
            order = [orderable(compile_(k, dot)) for k in flat(args[0][1] if args[0][0] == "array" else args[0])]
            df = df.orderBy(*order)
        elif name == "unique_by":
            keys = [orderable(compile_(k, dot)) for k in flat(args[0][1] if args[0][0] == "array" else args[0])]
            first = df.groupBy(*(k.alias(f"_k{i}") for i, k in enumerate(keys))).agg((F.min_by(F.struct(*df.columns), place) if stream and set(stream) <= set(df.columns) else F.min(F.struct(*df.columns))).alias("r"))
            df = first.select("r.*")
        elif name == "unique":
            df = df.distinct()
        elif name == "map":
            df = spread(df, args[0])
        elif s[0] == "slice" and order and s[1] == ("dot",):
            lo = s[2][1] if s[2] else 0
            df = df.orderBy(*order).offset(lo)
            df = df.limit(s[3][1] - lo) if s[3] else df
        elif name in ("min_by", "max_by"):
            key = compile_(args[0], dot).column
            df = df.agg((F.min_by if name == "min_by" else F.max_by)(F.struct(*df.columns), key).alias("r")).select("r.*")
        elif name == "length" and last:
            df = df.agg(F.count("*").alias("value"))
        elif name == "add" and last and df.columns == ["value"]:
            df = df.agg(F.sum("value").alias("value"))
        elif s[0] == "each":
            pass
        else:
            raise Unsupported(name)
        dot = Dot.of(df) if df.columns != ["value"] else Dot(df.schema["value"].dataType, F.col("value"))
    if grouped is not None:
        raise Unsupported("groups as they are")
    return df


def aggregate(tree: tuple, dot: Dot, place: Column | None = None) -> Column:
    """An expression over a group's array as an aggregate; place: a row's place in the stream, which says what is first."""
    if tree == ("call", "length", ()):
        return F.count("*")
    if tree[0] == "index" and tree[1] == ("index", ("dot",), ("literal", 0)):
        value = compile_(("index", ("dot",), tree[2]), dot).column
        return F.first(value) if place is None else F.min_by(F.struct(value.alias("v")), place)["v"]
    if tree[0] == "pipe" and tree[1][0] == "call" and tree[1][1] == "map":
        value, rest = compile_(tree[1][2][0], dot).column, tree[2]
        if rest == ("binary", "/", ("call", "add", ()), ("call", "length", ())):
            return F.avg(value)
        simple = {"add": F.sum, "length": lambda c: F.count("*"), "min": F.min, "max": F.max}
        if rest[0] == "call" and rest[1] in simple and not rest[2]:
            return simple[rest[1]](value)
        if rest == ("pipe", ("call", "unique", ()), ("call", "length", ())):
            return F.count_distinct(value) + F.max(F.when(value.isNull(), 1).otherwise(0))
    if tree[0] == "pipe" and tree[1][0] == "call" and tree[1][1] in ("min_by", "max_by"):
        key, value = compile_(tree[1][2][0], dot).column, compile_(tree[2], dot).column
        return (F.min_by if tree[1][1] == "min_by" else F.max_by)(value, key)
    raise Unsupported("aggregate")


def reduced(df: DataFrame, tree: tuple) -> DataFrame:
    """`reduce (., inputs) as $x (start; update)` where the update is a sum, count, min or max."""
    _, source, pattern, start, update = tree
    if source != ALL[1] or pattern[0] != "var" or start[0] != "literal" or update[0] != "binary" or update[1] != "+" or update[2] != ("dot",):
        raise Unsupported("reduce")
    dot = Dot.of(df)
    value = compile_(update[3], Dot(T.NullType(), F.lit(None)), {pattern[1]: dot})
    return df.agg((F.coalesce(F.sum(value.column), F.lit(0)) + F.lit(start[1])).alias("value"))


def interpreted(df: DataFrame, text: str, *order: str) -> DataFrame:
    """Outputs as JSON in a column called value; a program that looks past its record gets the stream in order."""
    tree = parse(text)
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"), *(F.col(o).alias(f"_o{i}") for i, o in enumerate(order)))
    if uses_inputs(tree):
        if not order:
            raise JqError("a program over all inputs needs an order")
        rows = rows.coalesce(1).sortWithinPartitions(*(f"_o{i}" for i in range(len(order))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = parse(text)
        lines = (json.loads(x) for b in batches for x in b.column("line").to_pylist())
        found: list[str] = []
        try:
            for v in outputs(program, lines):
                found.append(show(v))
                if len(found) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["value"])
                    found = []
        except JqRuntimeError as error:
            raise ValueError(f"jq: {error}") from error
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["value"])

    return rows.select("line").mapInArrow(run, "value string")


def jq(df: DataFrame, text: str, *order: str) -> DataFrame:
    """Run a program over records: as a plan where one exists, else by the interpreter (JSON in value)."""
    from recordmill.plans.jq import relations

    tree = parse(text)
    try:
        tree = inlined(tree)
        if tree[0] == "pipe" and tree[1] == ALL:
            return relations.joined(df, tree[2], order) if tree[2][0] == "as" else gathered(df, tree[2], order)
        if tree[0] == "foreach" and uses_inputs(tree):
            return relations.running(df, tree, order)
        if tree[0] == "reduce":
            return reduced(df, tree)
        if uses_inputs(tree):
            raise Unsupported("inputs")
        return relations.expanded(df, tree, Dot.of(df), {}) if several(tree) else spread(df, tree)
    except Unsupported:
        return interpreted(df, text, *order)


def several(tree: tuple) -> bool:
    """Whether a program, after bindings, starts with a fold, a range or the first items of an array."""
    while tree[0] == "as" and tree[2][0] == "var":
        tree = tree[3]
    first = tree[1] if tree[0] == "pipe" else tree
    return tree[0] == "foreach" or first[0] == "call" and first[1] in ("range", "limit", "first") and bool(first[2])


def condition(df: DataFrame, text: str) -> Column:
    """An event filter as a Column: the truth of its output, false for null and errors."""
    return truth(compile_(parse(text), Dot.of(df)))

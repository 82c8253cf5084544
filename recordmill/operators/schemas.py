"""JSON Schema keywords as predicates over records: each record's first few violations, without leaving the JVM."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST = 5
KINDS = {"string": T.StringType, "integer": T.IntegralType, "number": T.NumericType, "boolean": T.BooleanType, "array": T.ArrayType, "object": (T.StructType, T.MapType)}


# Shapes of named formats.
FORMATS = {"date": r"^\d{4}-\d{2}-\d{2}$", "date-time": r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$", "email": r"^[^@\s]+@[^@\s]+$", "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$", "uuid": r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"}


class SchemaError(ValueError):
    """A schema with a keyword that has no predicate."""


def broken(value: Column, kind: T.DataType, shape: dict, name: str) -> list[tuple[str, Column]]:
    """(message, predicate that is true for a violation) of each keyword; null values violate only required."""
    out: list[tuple[str, Column]] = []
    add = lambda word, bad: out.append((f"{name}: {word}", F.coalesce(bad, F.lit(False))))
    for word, arg in shape.items():
        if word == "type":
            names = arg if isinstance(arg, list) else [arg]
            if not any(isinstance(kind, KINDS[n]) for n in names if n != "null"):
                add("type", value.isNotNull())
        elif word == "enum":
            add(word, ~value.isin(*[x for x in arg if x is not None]))
        elif word == "const":
            add(word, value != arg)
        elif word == "pattern":
            add(word, ~value.rlike(arg))
        elif word in ("minLength", "maxLength"):
            add(word, F.length(value) < arg if word[1] == "i" else F.length(value) > arg)
        elif word in ("minItems", "maxItems"):
            add(word, F.size(value) < arg if word[1] == "i" else F.size(value) > arg)
        elif word in ("minimum", "maximum"):
            add(word, value < arg if word[1] == "i" else value > arg)
        elif word == "exclusiveMinimum":
            add(word, value <= arg)
        elif word == "uniqueItems":
            if arg:
                add(word, F.size(F.array_distinct(value)) < F.size(value))
        elif word == "items" and isinstance(kind, T.ArrayType):
            inner = lambda x: any_of([p for _, p in broken(x, kind.elementType, arg, name)])
            add(word, F.exists(value, inner))
        elif word == "propertyNames" and isinstance(kind, T.MapType):
            add(word, F.exists(F.map_keys(value), lambda k: any_of([p for _, p in broken(k, T.StringType(), arg, name)])))
        elif word in ("anyOf", "allOf"):
            parts = [any_of([p for _, p in broken(value, kind, s, name)]) for s in arg]
            bad = parts[0]
            for p in parts[1:]:
                bad = bad & p if word == "anyOf" else bad | p
            add(word, bad & value.isNotNull())
        elif word == "oneOf":
            fits = sum((F.when(any_of([p for _, p in broken(value, kind, s, name)]), 0).otherwise(1) for s in arg), F.lit(0))
            add(word, (fits != 1) & value.isNotNull())
        elif word == "if":
            met = ~any_of([p for _, p in broken(value, kind, arg, name)])
            for branch, here in (("then", met), ("else", ~met)):
                if branch in shape:
                    add(branch, here & any_of([p for _, p in broken(value, kind, shape[branch], name)]) & value.isNotNull())
        elif word == "format" and arg in FORMATS:
            add(word, ~value.rlike(FORMATS[arg]))
        elif word == "multipleOf":
            add(word, value % arg != 0)
        elif word == "additionalProperties" and arg is False and isinstance(kind, T.StructType):
            for key in kind.names:
                if key not in shape.get("properties", {}):
                    add(f"additional {key}", value.getField(key).isNotNull())
        elif word == "not":
            add(word, ~any_of([p for _, p in broken(value, kind, arg, name)]) & value.isNotNull())
        elif word == "properties" and isinstance(kind, T.StructType):
            for key, inner in arg.items():
                if key in kind.names:
                    out += broken(value.getField(key), kind[key].dataType, inner, f"{name}.{key}" if name else key)
        elif word == "required" and isinstance(kind, T.StructType):
            for key in arg:
                add(f"required {key}", value.getField(key).isNull() if key in kind.names else F.lit(True))
        elif word not in ("title", "description", "$schema", "$id", "$defs", "default", "then", "else", "examples", "$comment", "additionalProperties", "properties", "required", "items", "propertyNames"):
            raise SchemaError(f"keyword {word}")
    return out


def resolved(shape: object, whole: dict, depth: int = 0) -> object:
    """A schema with what $ref names inside it in its place; endless references are an error."""
    if depth > 32:
        raise SchemaError("$ref goes round")
    if isinstance(shape, list):
        return [resolved(s, whole, depth) for s in shape]
    if not isinstance(shape, dict):
        return shape
    if "$ref" in shape:
        at: object = whole
        for step in str(shape["$ref"]).removeprefix("#").strip("/").split("/"):
            if not isinstance(at, dict) or step not in at:
                raise SchemaError(f"$ref {shape['$ref']}")
            at = at[step]
        beside = {k: v for k, v in shape.items() if k != "$ref"}
        return resolved({**at, **beside} if isinstance(at, dict) else at, whole, depth + 1)
    return {k: v if k in ("$defs", "enum", "const", "default") else resolved(v, whole, depth) for k, v in shape.items()}


def any_of(predicates: list[Column]) -> Column:
    bad = F.lit(False)
    for p in predicates:
        bad = bad | p
    return bad


def problems(df: DataFrame, shape: dict) -> Column:
    """The messages of a record's violations, in order: the first few, and how many more there are."""
    shape = resolved(shape, shape)
    found: list[tuple[str, Column]] = []
    for key, inner in shape.get("properties", {}).items():
        if key in df.columns:
            found += broken(F.col(key), df.schema[key].dataType, inner, key)
    found += [(f"{key}: required", F.col(key).isNull() if key in df.columns else F.lit(True)) for key in shape.get("required", ())]
    if shape.get("additionalProperties") is False:
        found += [(f"{c}: additional", F.col(c).isNotNull()) for c in df.columns if c not in shape.get("properties", {})]
    every = F.array_sort(F.array_compact(F.array(*(F.when(bad, m) for m, bad in found))))
    more = F.concat(F.lit("and "), F.size(every) - MOST, F.lit(" more schema errors"))
    return F.when(F.size(every) > MOST, F.concat(F.slice(every, 1, MOST), F.array(more))).otherwise(every)


def violations(df: DataFrame, shape: dict, *key: str) -> DataFrame:
    """Keys and problems of the records that a schema doesn't take."""
    return df.select(*key, problems(df, shape).alias("_p")).where(F.size("_p") > 0).select(*key, F.array_join("_p", "; ").alias("problems"))


def fields_of(shape: dict) -> str:
    """The columns that a schema's properties ask for, and id; objects and anything of several kinds as JSON text."""
    plain = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}

    def kind(s: dict) -> str:
        if s.get("type") == "array":
            return f"array<{kind(s.get('items', {}))}>"
        return plain.get(s.get("type"), "string") if isinstance(s.get("type"), str) else "string"

    found = {"id": {"type": "string"}} | {k: s if isinstance(s, dict) else {} for k, s in shape.get("properties", {}).items()}
    return ", ".join(f"`{k}` {kind(s)}" for k, s in found.items())


def digest(shape: dict) -> str:
    """A schema's identity: the hash of its canonical form."""
    import hashlib

    return hashlib.sha256(json.dumps(shape, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

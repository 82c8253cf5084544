"""jq's total order over values of several types, as a column that sorts, groups and compares.

null < false < true < numbers < text < arrays < objects. Arrays are compared item by item, objects by their sorted names
first and then by the values in that order. A key is a struct whose fields say this one after another, so that Spark's
own order of structs is jq's order; its arrays hold keys of items, as deep as values may be nested.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arrays and objects within each other that are told apart; a value nested deeper is an error.
DEEPEST = 3


def key_type(depth: int = DEEPEST) -> T.StructType:
    fields = [T.StructField("rank", T.IntegerType()), T.StructField("number", T.DoubleType()), T.StructField("text", T.StringType())]
    if depth:
        inner = T.ArrayType(key_type(depth - 1))
        fields += [T.StructField("items", inner), T.StructField("names", T.ArrayType(T.StringType())), T.StructField("values", inner)]
    return T.StructType(fields)


def variant_key(value: Column, depth: int = DEEPEST) -> Column:
    """The key of a VARIANT; SQL's null counts as JSON's."""
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    truth = F.try_variant_get(value, "$", "boolean")
    rank = F.when(kind == "VOID", 0).when(kind == "BOOLEAN", F.when(truth, 2).otherwise(1)).when(kind == "STRING", 4).when(kind.startswith("ARRAY"), 5).when(kind.startswith("OBJECT"), 6).otherwise(3)
    number = F.when(rank == 3, F.try_variant_get(value, "$", "double"))
    text = F.when(rank == 4, F.try_variant_get(value, "$", "string"))
    if not depth:
        rank = F.when(rank > 4, F.raise_error(F.lit(f"values nested over {DEEPEST} deep have no order")).cast("int")).otherwise(rank)
        return F.struct(rank.alias("rank"), number.alias("number"), text.alias("text"))
    array, fields = value.try_cast("array<variant>"), value.try_cast("map<string,variant>")
    items = F.when(rank == 5, F.transform(array, lambda x: variant_key(x, depth - 1)))
    names = F.when(rank == 6, F.array_sort(F.map_keys(fields)))
    values = F.when(rank == 6, F.transform(F.array_sort(F.map_keys(fields)), lambda n: variant_key(F.element_at(fields, n), depth - 1)))
    return F.struct(rank.alias("rank"), number.alias("number"), text.alias("text"), items.alias("items"), names.alias("names"), values.alias("values"))


def typed_key(value: Column, kind: T.DataType) -> Column | None:
    """The key of a column of one type, to compare with that of a VARIANT; None for nested types."""
    none = F.lit(None)
    rank, number, text = none, none, none
    if isinstance(kind, T.BooleanType):
        rank = F.when(value, 2).otherwise(1)
    elif isinstance(kind, (T.IntegralType, T.FractionalType)):
        rank, number = F.lit(3), value
    elif isinstance(kind, T.StringType):
        rank, text = F.lit(4), value
    elif not isinstance(kind, T.NullType):
        return None
    rank = F.lit(0) if isinstance(kind, T.NullType) else F.when(value.isNull(), 0).otherwise(rank)
    inner, names = T.ArrayType(key_type(DEEPEST - 1)), T.ArrayType(T.StringType())
    return F.struct(rank.cast("int").alias("rank"), number.cast("double").alias("number"), text.cast("string").alias("text"), none.cast(inner).alias("items"), none.cast(names).alias("names"), none.cast(inner).alias("values"))


def key_of(value: Column, kind: T.DataType) -> Column | None:
    return variant_key(value) if isinstance(kind, T.VariantType) else typed_key(value, kind)

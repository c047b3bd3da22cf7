"""Metadata predicates, compiled to one boolean expression.

Two-valued: a missing field fails every comparison, ``ne`` too. Fields are columns or, with ``json``, members
of a JSON text column; there numbers are one domain and a value of another type than the literal's never
compares (but is unequal), and a JSON null is a present value unequal to any other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "contains")


@dataclass(frozen=True)
class Field:
    name: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class And:
    parts: tuple = ()


@dataclass(frozen=True)
class Or:
    parts: tuple = ()


def field(name: str, op: str, value: Any = None) -> Field:
    return Field(name, op, value)


def all_of(*parts) -> And:
    return And(tuple(parts))


def any_of(*parts) -> Or:
    return Or(tuple(parts))


def _kind(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "other"


def _column_kind(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.NumericType):
        return "number"
    return "string" if isinstance(t, T.StringType) else "other"


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _compare(c: Column, present: Column, same_type: Column, op: str, value: Any) -> Column:
    """c: the field as the literal's type, null where it isn't of it."""
    ordered = _kind(value) in ("number", "string")
    equal = same_type & (c == F.lit(value)) if _kind(value) != "other" else F.lit(False)
    if op == "eq":
        return _false(equal)
    if op == "ne":
        return present & ~_false(equal)
    if op == "contains":
        return _false(same_type & F.contains(c, F.lit(value))) if isinstance(value, str) else F.lit(False)
    strict = {"gt": c > F.lit(value), "gte": c > F.lit(value), "lt": c < F.lit(value), "lte": c < F.lit(value)}[op] if ordered else F.lit(False)
    return _false(same_type & strict) | (_false(equal) if op in ("gte", "lte") else F.lit(False))


def _typed(f: Field, schema: T.StructType, value: Any) -> tuple[Column, Column, Column]:
    c = F.col(f"`{f.name}`")
    same = _column_kind(schema[f.name].dataType) == _kind(value)
    return (c if same else F.lit(None).cast({"number": "double", "boolean": "boolean"}.get(_kind(value), "string"))), c.isNotNull(), F.lit(same)


def _in_json(f: Field, json: str, value: Any) -> tuple[Column, Column, Column]:
    path = "$['" + f.name.replace("'", "\\'") + "']"
    v = F.try_parse_json(F.col(json))
    at = F.try_variant_get(v, path, "variant")
    null = F.coalesce(F.is_variant_null(at), F.lit(False))
    kind = F.schema_of_variant(at)
    number = kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
    same = {"number": number, "string": kind == "STRING", "boolean": kind == "BOOLEAN"}.get(_kind(value), F.lit(False))
    target = {"number": "double", "boolean": "boolean"}.get(_kind(value), "string")
    return F.when(same, F.try_variant_get(v, path, target)), at.isNotNull() | null, F.coalesce(same & ~null, F.lit(False))


def compile_filter(condition, schema: T.StructType, json: str | None = None) -> Column:
    """One expression, false (never null) where the condition fails. json: name of a JSON text column that holds what isn't a column."""
    if condition is None:
        return F.lit(True)
    if isinstance(condition, Column):
        return _false(condition)
    if isinstance(condition, And):
        return reduce(lambda a, b: a & b, (compile_filter(p, schema, json) for p in condition.parts), F.lit(True))
    if isinstance(condition, Or):
        return reduce(lambda a, b: a | b, (compile_filter(p, schema, json) for p in condition.parts), F.lit(False))
    if isinstance(condition, Field):
        if condition.op not in OPERATORS or (condition.name not in schema.names and not json):
            return F.lit(False)
        if condition.op == "in":
            values = condition.value if isinstance(condition.value, (list, tuple)) else ()
            return compile_filter(any_of(*(Field(condition.name, "eq", v) for v in values)), schema, json)
        own = _typed(condition, schema, condition.value) if condition.name in schema.names else _in_json(condition, json, condition.value)
        return _compare(*own, condition.op, condition.value)
    if isinstance(condition, Callable):
        predicate = F.pandas_udf(lambda rows: rows.apply(lambda r: bool(condition(r.to_dict())), axis=1) if len(rows) else rows.iloc[:, 0].astype(bool), T.BooleanType())
        return _false(predicate(F.struct(*[F.col(f"`{c}`") for c in schema.names])))
    raise TypeError(f"not a condition: {condition!r}")

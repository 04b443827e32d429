"""Declarative predicates compiled to columns.

A predicate is ``{"all": [...]}``, ``{"any": [...]}`` or
``{"field": f, "op": o, "value": v}``.  Comparisons are two-valued: a missing left
side is False before the operator runs, so ``eq null`` never holds and ``ne null``
tests presence.  Types are settled at plan time from the schema: a comparison that
cannot hold becomes a constant, and ``ne`` of present values of different types holds.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = ("eq", "ne", "in", "gt", "ge", "lt", "le", "contains", "matches")


class RuleError(ValueError):
    """A predicate that cannot be compiled."""


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.NumericType):
        return "number"
    return "text" if isinstance(dtype, T.StringType) else "other"


def _value_kind(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    return "number" if isinstance(value, int | float) else "text" if isinstance(value, str) else "list" if isinstance(value, list | tuple) else "other"


def folded(text: Column) -> Column:
    """Case folding for comparison: lower case, and sharp s as two letters."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def validate(rule: Any) -> None:
    """Raises :class:`RuleError` for unknown keys or operators and for bad patterns."""
    if not isinstance(rule, Mapping):
        raise RuleError(f"not a predicate: {rule!r}")
    keys = set(rule)
    if keys in ({"all"}, {"any"}):
        for part in rule[keys.pop()]:
            validate(part)
        return
    if keys != {"field", "op", "value"}:
        raise RuleError(f"keys of a predicate: {sorted(keys)}")
    if rule["op"] not in OPERATORS:
        raise RuleError(f"unknown operator {rule['op']!r}")
    if rule["op"] == "matches":
        try:
            re.compile(rule["value"])
        except (re.error, TypeError) as error:
            raise RuleError(f"bad pattern {rule['value']!r}") from error


def compile_rule(rule: Mapping[str, Any], schema: T.StructType, alias: Mapping[str, str] | None = None) -> Column:
    """The predicate as a column that is never null."""
    validate(rule)
    return _compile(rule, {f.name: f.dataType for f in schema.fields}, alias or {})


def _compile(rule: Mapping[str, Any], types: Mapping[str, T.DataType], alias: Mapping[str, str]) -> Column:
    if "all" in rule:
        return reduce(lambda a, b: a & b, (_compile(r, types, alias) for r in rule["all"]), F.lit(True))
    if "any" in rule:
        return reduce(lambda a, b: a | b, (_compile(r, types, alias) for r in rule["any"]), F.lit(False))
    name = alias.get(rule["field"], rule["field"])
    if name not in types:
        return F.lit(False)
    column, kind = F.col(name), _kind(types[name])
    if kind == "other":
        raise RuleError(f"{name} is {types[name].simpleString()}: predicates read texts, numbers and booleans; cast it first")
    return column.isNotNull() & F.coalesce(_compare(column, kind, rule["op"], rule["value"]), F.lit(False))


def _compare(column: Column, kind: str, op: str, value: Any) -> Column:
    other = _value_kind(value)
    if op == "eq":
        return column == F.lit(value) if kind == other else F.lit(False)
    if op == "ne":
        return column != F.lit(value) if kind == other else F.lit(True)
    if op == "in":
        if other == "list":
            return reduce(lambda a, b: a | b, (_compare(column, kind, "eq", v) for v in value), F.lit(False))
        return F.contains(F.lit(value), column) if kind == other == "text" else F.lit(False)
    if op in ("gt", "ge", "lt", "le"):
        if kind != "number" or other != "number":
            return F.lit(False)
        return {"gt": column > value, "ge": column >= value, "lt": column < value, "le": column <= value}[op]
    if kind != "text" or other != "text":
        return F.lit(False)
    return F.contains(folded(column), folded(F.lit(value))) if op == "contains" else column.rlike(f"(?iu){value}")


def filter_rule(df: DataFrame, rule: Mapping[str, Any]) -> DataFrame:
    return df.where(compile_rule(rule, df.schema))

"""Paths into JSON payloads."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions.text import stripped


def scalar_text(value: Column) -> Column:
    """Text of a scalar without outer white space; blank is null."""
    return F.nullif(stripped(value.cast("string")), F.lit(""))


def json_path(payload: Column, path: str) -> Column:
    """The scalar at a dotted path of a JSON text; null if a step is missing or the value is no scalar."""
    found = F.get_json_object(payload, "$." + path)
    # A text may begin with a bracket, too; a placeholder does.
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(payload), "$." + path, "variant"))
    nested = F.when(F.coalesce(found.rlike(r"^\s*[\[{]"), F.lit(False)), F.coalesce(kind != "STRING", F.lit(True))).otherwise(F.lit(False))
    return F.when(~nested, scalar_text(found))


def map_fields(df: DataFrame, key: str, fields: Mapping[str, Column]) -> DataFrame:
    """A row (key, field, value) for each mapped field; ``value`` is null where nothing resolved."""
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), scalar_text(c).alias("value")) for name, c in fields.items()])
    return df.select(key, F.explode(pairs).alias("p")).select(key, "p.field", "p.value")


def flatten(payload: Column) -> Column:
    """Entries of a flat JSON object as map<string, string>; lists are dropped."""
    entries = F.map_filter(F.from_json(payload, "map<string,string>"), lambda k, v: ~F.coalesce(v.rlike(r"^\s*[\[{]"), F.lit(False)))
    return F.transform_values(entries, lambda k, v: scalar_text(v))

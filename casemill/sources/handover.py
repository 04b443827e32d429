"""Handover stubs as XML text, and contracts as JSON schemas."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def escaped(value: Column) -> Column:
    out = F.coalesce(value.cast("string"), F.lit(""))
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def stub_xml(root: str, fields: Mapping[str, Column]) -> Column:
    """One element with a child for each field, in the order given."""
    parts = [F.concat(F.lit(f"<{k}>"), escaped(v), F.lit(f"</{k}>")) for k, v in fields.items()]
    return F.concat(F.lit(f"<{root}>"), *parts, F.lit(f"</{root}>"))


def stub_name(case: Column, draft: Column) -> Column:
    """A file name that depends on case and draft alone, so that a repeat writes the same file."""
    return F.concat(F.substring(F.sha2(F.concat_ws("|", case.cast("string"), draft.cast("string")), 256), 1, 16), F.lit(".xml"))


def write_stubs(stubs: DataFrame, path: str) -> None:
    """name and xml as text files, one directory for each name."""
    stubs.select("name", F.col("xml").alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def export_schemas(schemas: Mapping[str, T.StructType], directory: str) -> list[str]:
    """Schemas as JSON files on the driver; returns the names that changed."""
    os.makedirs(directory, exist_ok=True)
    changed = []
    for name, schema in sorted(schemas.items()):
        path = os.path.join(directory, f"{name}.json")
        text = schema.json() + "\n"
        if not os.path.exists(path) or open(path, encoding="utf-8").read() != text:
            with open(path, "w", encoding="utf-8") as out:
                out.write(text)
            changed.append(name)
    return changed

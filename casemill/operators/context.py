"""What rules and letters read of a case: payload leaves, evaluation context, facts, item texts, display names."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemill.functions.text import PLACEHOLDER, SHAPED, is_blank, normal_text, stripped

#: How deep a payload is read.
DEPTH = 6
LEAVES = T.ArrayType(T.StructType().add("path", T.StringType()).add("value", T.StringType()).add("kind", T.StringType()).add("in_list", T.BooleanType()))


def _walk(value: object, path: str, depth: int, listed: bool) -> Iterator[tuple[str, str, str, bool]]:
    if isinstance(value, dict):
        if depth < DEPTH:
            for key, child in value.items():
                yield from _walk(child, f"{path}.{key}" if path else key, depth + 1, listed)
    elif isinstance(value, list):
        for i, child in enumerate(value):
            yield from _walk(child, f"{path}[{i}]", depth, True)
    elif value is not None:
        kind = "bool" if isinstance(value, bool) else "number" if isinstance(value, int | float) else "text"
        yield path, json.dumps(value) if kind == "bool" else str(value), kind, listed


@F.pandas_udf(LEAVES)
def leaves(payload: pd.Series) -> pd.Series:
    """Scalar leaves of a JSON text, in order: path with list indices, value as text, kind, and whether it lies in a list."""
    return payload.map(lambda x: [] if x is None else list(_walk(json.loads(x), "", 0, False)))


def flat_fields(payload: Column) -> Column:
    """array<struct<path, value>>: leaves outside lists, under ``payload.``, without outer white space; blank ones are left out."""
    kept = F.filter(leaves(payload), lambda x: ~x["in_list"] & ~is_blank(x["value"]))
    return F.transform(kept, lambda x: F.struct(F.concat(F.lit("payload."), x["path"]).alias("path"), stripped(x["value"]).alias("value")))


def string_leaves(payload: Column) -> Column:
    """array<struct<path, value>>: every text, also inside lists, as it is."""
    kept = F.filter(leaves(payload), lambda x: x["kind"] == "text")
    return F.transform(kept, lambda x: F.struct(x["path"].alias("path"), x["value"].alias("value")))


def path_steps(path: Column) -> Column:
    """Keys and indices of a path like ``a[0].b`` as an array of texts."""
    return F.regexp_extract_all(path, F.lit(r"([^.\[\]]+)"), F.lit(1))


@dataclass(frozen=True)
class IdentityField:
    path: str
    kind: str
    subtree: bool = False


def covering(path: Column, fields: Sequence[IdentityField]) -> Column:
    """The kind of the identity field that covers a path, exactly or as part of its subtree; else null."""
    out = F.lit(None).cast("string")
    for f in fields:
        hit = path == f.path
        if f.subtree:
            hit = hit | F.startswith(path, F.lit(f.path + "."))
        out = F.when(hit, f.kind).otherwise(out)
    return out


def check_identity(fields: Sequence[IdentityField]) -> None:
    """Paths must be different, and none may lie under another."""
    for f in fields:
        if sum(g.path == f.path for g in fields) > 1:
            raise ValueError(f"identity path {f.path!r} is there twice")
        if any(f.path.startswith(g.path + ".") for g in fields):
            raise ValueError(f"identity path {f.path!r} lies under another")


def evaluation_context(cases: DataFrame, parts: DataFrame, case: str, hint: str, channel: str) -> DataFrame:
    """(case, hint, channel, text_normalized, source_types): what predicates may read beside payload and extractions.

    ``parts`` has case, ordinal, text and source_type; texts are joined in order, source types are sorted and different.
    """
    told = parts.where(~is_blank(F.col("text"))).groupBy(case).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("_parts"), F.array_sort(F.collect_set("source_type")).alias("source_types")
    )
    joined = cases.select(case, F.col(hint).alias("hint"), F.col(channel).alias("channel")).join(told, case, "left")
    text = normal_text(F.concat_ws(" ", F.transform("_parts", lambda p: p["text"])))
    none = F.expr("cast(array() as array<string>)")
    return joined.select(case, "hint", "channel", F.when(F.col("_parts").isNotNull(), text).alias("text_normalized"), F.coalesce("source_types", none).alias("source_types"))


def holds_placeholder(text: Column) -> Column:
    return F.coalesce(text.rlike(PLACEHOLDER) | text.rlike(SHAPED) | F.contains(text, F.lit("[[PII")), F.lit(False))


def cut_at_space(text: Column, most: int) -> Column:
    """The text if it is short enough, else its part before the last space within ``most`` characters."""
    return F.when(F.length(text) <= most, text).otherwise(F.regexp_extract(F.substring(text, 1, most), r"^(?s)(.*) ", 1))


def item_text(prose: Column, facts: Column, most: int = 1200) -> Column:
    """Masked prose, or sorted ``key: value`` facts (a map) without those that hold a placeholder; null if there is neither."""
    pairs = F.filter(F.array_sort(F.map_entries(facts)), lambda e: ~holds_placeholder(e["value"]) & ~is_blank(e["value"]))
    listed = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " | ")
    told = F.when(~is_blank(prose), stripped(F.regexp_replace(prose, PLACEHOLDER, " "))).otherwise(listed)
    return F.nullif(cut_at_space(told, most), F.lit(""))


def facts_from(records: DataFrame, case: str, field: str, value: str, order: str) -> DataFrame:
    """(case, facts): a map of each field's last value."""
    last = records.groupBy(case, field).agg(F.max_by(value, order).alias("_value"))
    return last.groupBy(case).agg(F.map_from_entries(F.collect_list(F.struct(F.col(field), "_value"))).alias("facts"))


def ordered_facts(facts: Column, required: Sequence[str]) -> Column:
    """array<struct<field, value>>: required fields in their order, then all others sorted; absent ones are left out."""
    listed = F.array(*[F.lit(f) for f in required]).cast("array<string>")
    names = F.concat(F.filter(listed, lambda f: F.map_contains_key(facts, f)), F.array_sort(F.array_except(F.map_keys(facts), listed)))
    return F.transform(names, lambda f: F.struct(f.alias("field"), F.element_at(facts, f).alias("value")))


def field_descriptions(requirements: DataFrame, mapped: DataFrame) -> DataFrame:
    """Requirements (kind, field, description) of fields that are mapped: what an extractor is asked for."""
    return requirements.where("kind = 'field'").join(mapped.select("field").distinct(), "field").select("field", "description")


def stamped(df: DataFrame, versions: Mapping[str, str], overrides: Mapping[str, Column] | None = None, out: str = "versions") -> DataFrame:
    """Adds a struct of versions, the same for all rows but for ``overrides``."""
    stamp = F.struct(*[F.lit(v).alias(k) for k, v in sorted(versions.items())])
    for name, value in (overrides or {}).items():
        stamp = stamp.withField(name, value)
    return df.withColumn(out, stamp)


def layer_stats(parts: DataFrame, case: str, text: str) -> DataFrame:
    """Counts and lengths of a case's texts; no value of any text comes out."""
    length = F.coalesce(F.length(text), F.lit(0))
    return parts.groupBy(case).agg(
        F.count("*").alias("n_parts"), F.count_if(is_blank(F.col(text))).alias("n_blank"), F.sum(length).alias("n_chars"), F.max(length).cast("long").alias("longest"),
        F.sum(F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({PLACEHOLDER})"), F.lit(1)))).alias("n_placeholders"),
    )


def unit_texts(units: DataFrame, duties: DataFrame, unit: str, name: str, duty: str, excluded: Sequence[str] = ()) -> DataFrame:
    """(unit, text): name and sorted responsibilities joined by ". "; excluded units and those without any are left out."""
    told = duties.where(~is_blank(F.col(duty))).groupBy(unit).agg(F.array_sort(F.collect_list(duty)).alias("_duties"))
    kept = units.where(~F.col(name).isin(*excluded)) if excluded else units
    return kept.join(told, unit).select(unit, F.concat_ws(". ", F.col(name), F.col("_duties")).alias("text"))


def displayed(df: DataFrame, names: DataFrame, key: str, name: str, out: str, fallback: Column | None = None) -> DataFrame:
    """Adds the display name of a key, or else ``fallback``, or else the key itself."""
    found = names.select(F.col(key).alias("_key"), F.col(name).alias("_name"))
    joined = df.join(found, F.col(key) == F.col("_key"), "left")
    return joined.withColumn(out, F.coalesce("_name", fallback if fallback is not None else F.col(key).cast("string"))).drop("_key", "_name")


def fixture_parts(fixtures: DataFrame, parts: DataFrame, case: str) -> DataFrame:
    """(case, n, n_missed): fixtures, and those whose part_id the case does not have."""
    joined = fixtures.join(parts.select(case, "part_id").distinct().withColumn("_there", F.lit(True)), [case, "part_id"], "left")
    return joined.groupBy(case).agg(F.count("*").alias("n"), F.count_if(F.col("_there").isNull()).alias("n_missed"))


def replayed_proposals(fixtures: DataFrame, parts: DataFrame, case: str) -> DataFrame:
    """Proposals from fixtures (field, part_id, anchor, mode, value, quote) and parts (part_id, text).

    The first place of the anchor counts.  In mode "sealed" the value is the first placeholder after the anchor, and the
    quote goes from the anchor to its end; in mode "literal" value and quote are as given, quoted from the anchor's
    start.  ``start`` is null where the anchor, or the placeholder, is not there.
    """
    joined = fixtures.join(parts.select(case, "part_id", F.col("text").alias("_text")), [case, "part_id"], "left")
    at = F.instr("_text", F.col("anchor"))
    tail = F.substr("_text", at)
    token = F.nullif(F.regexp_extract(F.substr("_text", at + F.length("anchor")), f"({PLACEHOLDER})", 1), F.lit(""))
    sealed = F.col("mode") == "sealed"
    value = F.when(sealed, token).otherwise(F.col("value"))
    quote = F.when(sealed, F.substr(tail, F.lit(1), F.instr(tail, token) - 1 + F.length(token))).otherwise(F.col("quote"))
    found = (at > 0) & value.isNotNull()
    return joined.select(case, "part_id", "field", F.when(found, value).alias("value"), F.when(found, quote).alias("quote"), F.when(found, at - 1).alias("start"))


def correlated(left: DataFrame, right: DataFrame, token: str, at: str, ttl: str) -> DataFrame:
    """(token, left_at, right_at): entries of two parties with one token, at most ``ttl`` apart in either direction.

    The token makes it an equi-join; over streams with watermarks the same condition bounds the state.
    """
    a = left.select(F.col(token).alias("token"), F.col(at).alias("left_at"))
    b = right.select(F.col(token).alias("_token"), F.col(at).alias("right_at"))
    near = (F.col("right_at") <= F.col("left_at") + F.expr(f"interval {ttl}")) & (F.col("left_at") <= F.col("right_at") + F.expr(f"interval {ttl}"))
    return a.join(b, (F.col("token") == F.col("_token")) & near).drop("_token")


def answers(raw: Column, fields: str = "array<struct<field:string,part_id:string,offset:int,quote:string,value:string>>") -> Column:
    """A model's JSON answer as an array; null unless every entry has exactly the declared keys and kinds."""
    names = [f.name for f in T._parse_datatype_string(fields).elementType.fields]
    parsed = F.from_json(raw, fields, {"mode": "PERMISSIVE"})
    shapes = F.from_json(raw, "array<map<string,string>>")
    texts = F.from_json(raw, "array<struct<offset:string>>")
    keys = F.forall(shapes, lambda m: F.array_sort(F.map_keys(m)) == F.array(*[F.lit(n) for n in sorted(names)]))
    whole = F.forall(parsed, lambda e: e["field"].isNotNull() & e["part_id"].isNotNull() & e["quote"].isNotNull() & e["value"].isNotNull() & e["offset"].isNotNull())
    counted = (F.size(parsed) == F.size(shapes)) & F.forall(texts, lambda e: e["offset"].rlike("^-?[0-9]+$"))
    return F.when(F.coalesce(keys & whole & counted, F.lit(False)), parsed)


def counter(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, counts): how often each value stands, as a map in the order of the values."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    return n.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(value), "_n")))).alias("counts"))


def as_int(payload: Column, path: str) -> Column:
    """A whole number at a path of a JSON text; null for anything else, also for texts of digits and booleans."""
    found = F.try_variant_get(F.try_parse_json(payload), f"$.{path}", "variant")
    return F.when(F.schema_of_variant(found).isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.try_variant_get(F.try_parse_json(payload), f"$.{path}", "bigint"))


def as_text(payload: Column, path: str) -> Column:
    """A text at a path of a JSON text; null for anything else."""
    found = F.try_variant_get(F.try_parse_json(payload), f"$.{path}", "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(F.try_parse_json(payload), f"$.{path}", "string"))


def mapped_payload(df: DataFrame, payload: str, paths: Mapping[str, str]) -> DataFrame:
    """Adds ``records`` (field, value, origin, confidence 1) of the fields whose path holds a scalar, and ``discarded``, the others' names."""
    from casemill.functions.paths import json_path

    each = F.array(*[F.struct(F.lit(name).alias("field"), json_path(F.col(payload), path).alias("value"), F.lit(path).alias("origin"), F.lit(1.0).alias("confidence")) for name, path in paths.items()])
    df = df.withColumn("_mapped", each)
    missed = F.transform(F.filter("_mapped", lambda x: x["value"].isNull()), lambda x: x["field"])
    return df.withColumns({"records": F.filter("_mapped", lambda x: x["value"].isNotNull()), "discarded": missed}).drop("_mapped")


def panel_value(report: Column, path: str) -> Column:
    """The scalar at a key path of a JSON report, or "-"."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(report), f"$.{path}", "string"), F.lit("-"))

"""Evidence: procedure derivation, routing arbitration, completeness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions.dates import birth_block, full_years, iso_date
from casemill.functions.text import PLACEHOLDER, folded_words, is_blank, stripped
from casemill.plans.rules import compile_rule


def derive(df: DataFrame, hint: Column, signals: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Adds ``candidates``, ``derived`` and ``derivation``.

    Two or more candidates are ambiguous, even with a valid hint.  A known hint holds
    if the content agrees or is silent, and is contradicted otherwise; without one, a
    single candidate decides.
    """
    hits = F.array(*[F.when(compile_rule(r, df.schema), F.lit(name)) for name, r in signals.items()])
    df = df.withColumn("candidates", F.array_sort(F.filter(hits, lambda x: x.isNotNull())))
    n, one = F.size("candidates"), F.get("candidates", F.lit(0))
    known = F.coalesce(hint.isin(*signals), F.lit(False))
    source = (
        F.when(n >= 2, "ambiguous")
        .when(known & ((n == 0) | (one == hint)), "hint")
        .when(known, "contradicted")
        .when(n == 1, "content")
        .otherwise("none")
    )
    df = df.withColumn("derivation", source)
    derived = F.when(F.col("derivation") == "hint", hint).when(F.col("derivation") == "content", one)
    return df.withColumn("derived", derived)


@dataclass(frozen=True)
class Route:
    rule_id: str
    unit: str
    priority: int
    when: Mapping[str, Any]


def route(df: DataFrame, rules: Sequence[Route]) -> DataFrame:
    """Adds ``units`` (priority, best rule, unit; best first), ``winner``, ``unresolved``, ``confidence`` and ``conflict``.

    All rules are tested in the row; no join, no shuffle.  The winner is the unit with
    the least (priority, rule id); if the second unit has the same priority, the case
    is unresolved and the confidence 0.6 instead of 1.
    """
    hits = F.array(*[F.when(compile_rule(r.when, df.schema), F.struct(F.lit(r.priority).alias("priority"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.unit).alias("unit"))) for r in rules])
    df = df.withColumn("_hits", F.array_sort(F.filter(hits, lambda x: x.isNotNull())))
    first = F.filter("_hits", lambda x, i: ~F.exists(F.slice("_hits", 1, i), lambda y: y["unit"] == x["unit"]))
    df = df.withColumn("units", first).drop("_hits")
    best, second = F.get("units", F.lit(0)), F.get("units", F.lit(1))
    tied = F.coalesce(second["priority"] == best["priority"], F.lit(False))
    return df.withColumns(
        {
            "winner": best["unit"],
            "unresolved": tied,
            "confidence": F.when(F.size("units") == 0, F.lit(0.0)).when(tied, F.lit(0.6)).otherwise(F.lit(1.0)),
            "conflict": F.size("units") >= 2,
        }
    )


def suggestions_by_unit(df: DataFrame, rules: Sequence[Route]) -> DataFrame:
    """A row for each suggested unit: ``s`` has unit, its least priority, and its rules by priority and id."""
    hits = F.array(*[F.when(compile_rule(r.when, df.schema), F.struct(F.lit(r.priority).alias("priority"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.unit).alias("unit"))) for r in rules])
    df = df.withColumn("_hits", F.array_sort(F.filter(hits, lambda x: x.isNotNull())))
    units = F.array_distinct(F.transform("_hits", lambda x: x["unit"]))

    def one(unit: Column) -> Column:
        own = F.filter("_hits", lambda x: x["unit"] == unit)
        return F.struct(unit.alias("unit"), F.get(own, F.lit(0))["priority"].alias("priority"), F.transform(own, lambda x: x["rule_id"]).alias("rule_ids"))

    return df.withColumn("s", F.explode(F.transform(units, one))).drop("_hits")


@dataclass(frozen=True)
class Requirement:
    """A required value with its checks, tested in this order; a pattern is anchored at its start only."""

    requirement_id: str
    column: str | None = None
    document: bool = False
    pattern: str | None = None
    one_of: Sequence[str] = field(default=())
    min_length: int | None = None
    max_length: int | None = None
    is_date: bool = False
    min_date: str | None = None
    max_date: str | None = None
    not_before: str | None = None
    not_after: str | None = None
    min_years_after: tuple[str, int] | None = None
    max_years_after: tuple[str, int] | None = None
    #: Column with a date of birth that places 3 to 8 of this value must agree with.
    birth_in_number: str | None = None
    #: The value may be a placeholder; ``sealed`` says which column holds what it stands for (null: it can't be resolved).
    sealed: str | None = None


def _day(df: DataFrame, name: str) -> Column:
    """The column as a day: dates as they are, timestamps cut, texts parsed strictly."""
    kind = df.schema[name].dataType.simpleString()
    return F.col(name).cast("date") if kind in ("date", "timestamp", "timestamp_ntz") else iso_date(F.col(name).cast("string"))


def _problem(df: DataFrame, r: Requirement) -> Column:
    """Null, MISSING, or the name of the first check that fails.

    A check against another column is left out where that one is empty or no date; a number that holds a date of birth
    is checked by itself, too.
    """
    if r.document or r.column is None:
        return F.lit("MISSING")
    raw = F.col(r.column).cast("string")
    value = stripped(raw if r.sealed is None else F.when(raw.rlike(f"^{PLACEHOLDER}$"), F.col(r.sealed)).otherwise(raw))
    day = _day(df, r.column) if r.sealed is None else iso_date(value)
    checks: list[tuple[str, Column]] = []
    if r.sealed is not None:
        checks.append(("unresolved", raw.rlike(f"^{PLACEHOLDER}$") & F.col(r.sealed).isNull()))
    if r.pattern is not None:
        checks.append(("pattern", ~value.rlike(f"^(?:{r.pattern})")))
    if r.one_of:
        checks.append(("one_of", ~value.isin(*r.one_of)))
    if r.min_length is not None:
        checks.append(("min_length", F.length(value) < r.min_length))
    if r.max_length is not None:
        checks.append(("max_length", F.length(value) > r.max_length))
    if r.is_date or r.min_date or r.max_date:
        checks.append(("date", day.isNull()))
    if r.min_date:
        checks.append(("min_date", day < F.lit(r.min_date).cast("date")))
    if r.max_date:
        checks.append(("max_date", day > F.lit(r.max_date).cast("date")))
    if r.not_before:
        checks.append(("not_before", day < _day(df, r.not_before)))
    if r.not_after:
        checks.append(("not_after", day > _day(df, r.not_after)))
    if r.min_years_after:
        checks.append(("min_years_after", full_years(_day(df, r.min_years_after[0]), day) < r.min_years_after[1]))
    if r.max_years_after:
        checks.append(("max_years_after", full_years(_day(df, r.max_years_after[0]), day) > r.max_years_after[1]))
    if r.birth_in_number:
        block, born = F.substring(value, 3, 6), _day(df, r.birth_in_number)
        # the century is not in the number: beside a date of birth the block is to be its day, alone it is a day of 19YY
        checks.append(("birth_in_number", F.coalesce(block != F.date_format(born, "ddMMyy"), birth_block(block).isNull())))
    out = F.when(is_blank(raw), F.lit("MISSING"))
    for name, failed in checks:
        out = out.when(F.coalesce(failed, F.lit(False)), F.lit(name))
    return out


def completeness(df: DataFrame, requirements: Sequence[Requirement]) -> DataFrame:
    """Adds ``gaps`` (requirement_id, status, failed) and ``verdict``; no requirements: NOT_EVALUABLE.

    Each requirement is tested once, as an entry of one array of names, from which the gaps are made.
    """
    if not requirements:
        return df.withColumns({"gaps": F.expr("cast(array() as array<struct<requirement_id:string,status:string,failed:string>>)"), "verdict": F.lit("NOT_EVALUABLE")})
    ids = F.array(*[F.lit(r.requirement_id) for r in requirements])
    problems = F.array(*[_problem(df, r).alias(r.requirement_id) for r in requirements])

    def gap(problem: Column, i: Column) -> Column:
        status = F.when(problem == "MISSING", "MISSING").when(problem.isNotNull(), "INVALID")
        return F.struct(F.get(ids, i).alias("requirement_id"), status.alias("status"), F.nullif(problem, F.lit("MISSING")).alias("failed"))

    df = df.withColumn("gaps", F.filter(F.transform(problems, gap), lambda x: x["status"].isNotNull()))
    return df.withColumn("verdict", F.when(F.size("gaps") == 0, "COMPLETE").otherwise("INCOMPLETE"))


def first_accepted(proposals: DataFrame, case: str, name: str, order: str, accepted: str) -> DataFrame:
    """Adds ``outcome``: the first accepted proposal of a field is "accepted", a later one "duplicate", others "rejected"."""
    from pyspark.sql import Window as W

    before = W.partitionBy(case, name).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    taken = F.coalesce(F.max(F.col(accepted).cast("int")).over(before), F.lit(0)) == 1
    return proposals.withColumn("outcome", F.when(~F.col(accepted), "rejected").when(taken, "duplicate").otherwise("accepted"))


def quoted(text: Column, quote: Column, start: Column) -> Column:
    """Whether ``quote`` stands at offset ``start`` (code points from 0) of ``text``; false for empty or outside."""
    end = start + F.length(quote)
    inside = (F.length(quote) > 0) & (start >= 0) & (end <= F.length(text))
    return F.coalesce(inside & (F.substr(text, start + 1, F.length(quote)) == quote), F.lit(False))


#: Words of a window that is a join key, and the smaller ones for short passages.
WINDOWS = (8, 4, 2, 1)


def passages(docs: DataFrame, quotes: DataFrame, text: str, quote: str) -> DataFrame:
    """Each row of docs with each row of quotes whose whole quote stands in its text, and ``start``, the first offset.

    Words are what stands between two spaces.  All but the first and the last word of a quote are whole words of every text that
    holds it, so a hash of the first of them is the join key; the whole quote is then looked up in the whole text.
    Only quotes of one or two words are compared with every text.
    """
    hashed = lambda words, i, k: F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)])
    words = F.split(F.col(quote), " ")
    size = F.coalesce(*[F.when(F.size(words) - 2 >= k, k) for k in WINDOWS], F.lit(0))
    key = F.coalesce(*[F.when(F.col("_size") == k, hashed(words, F.lit(1), k)) for k in WINDOWS])
    asked = quotes.where(F.length(quote) > 0).withColumn("_size", size).withColumn("_key", key)
    sizes = sorted(r[0] for r in asked.select("_size").distinct().collect())
    found = docs.join(asked.where("_size = 0"), F.contains(text, quote))
    if windows := [k for k in sizes if k]:

        def of(k: int) -> Column:
            last = F.size("_words") - k
            return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: hashed(F.col("_words"), i, k))).otherwise(F.array().cast("array<bigint>"))

        keys = docs.withColumn("_words", F.split(F.col(text), " ")).withColumn("_key", F.explode(F.array_distinct(F.concat(*[of(k) for k in windows])))).drop("_words")
        met = keys.join(asked.where("_size > 0"), "_key").where(F.contains(text, quote))
        found = met.select(*found.columns) if sizes[0] else met.select(*found.columns).unionByName(found)
    return found.withColumn("start", F.instr(F.col(text), F.col(quote)) - 1).drop("_size", "_key")


#: Why a proposal is refused, in the order of the tests.
FAILURES = ("duplicate_field", "empty_value", "unknown_field", "unknown_part", "offset_out_of_range", "quote_mismatch", "value_not_in_quote")


@dataclass(frozen=True)
class MatchPolicy:
    """How a source's quotes are compared: exactly, or with a least similarity."""

    fuzzy: bool = False
    min_score: float = 1.0


def verified_spans(
    proposals: DataFrame, parts: DataFrame, case: str, order: str, known_fields: Sequence[str], policies: Mapping[str, MatchPolicy], *, exact_confidence: float = 0.95, fuzzy_floor: float = 0.8
) -> DataFrame:
    """Adds failure (null: accepted), mode, score and confidence to proposals (field, part_id, start, quote, value).

    ``parts`` has case, part_id, text and source_type.  The text at the offset must match the quote, and the value must
    stand in the quote; a fuzzy source allows the same least similarity in both.  The first accepted proposal of a field
    wins, later ones are duplicates.  Similarity is computed in Python, and only where texts differ and the source is fuzzy.
    """
    from pyspark.sql import Window as W

    from casemill.functions.text import partial_similarity, similarity

    joined = proposals.join(parts.select(case, "part_id", F.col("text").alias("_text"), "source_type"), [case, "part_id"], "left")
    least, fuzzy = F.lit(1.0), F.lit(False)
    for name, policy in policies.items():
        least = F.when(F.col("source_type") == name, policy.min_score).otherwise(least)
        fuzzy = F.when(F.col("source_type") == name, policy.fuzzy).otherwise(fuzzy)
    end = F.col("start") + F.length("quote")
    df = joined.withColumns({"_least": least, "_fuzzy": fuzzy, "_window": F.substr("_text", F.col("start") + 1, F.length("quote")), "_needle": folded_words(F.col("value")), "_stack": folded_words(F.col("quote"))})
    early = (
        F.when(is_blank(F.col("value")) | is_blank(F.col("quote")), "empty_value")
        .when(~F.coalesce(F.col("field").isin(*known_fields), F.lit(False)), "unknown_field")
        .when(F.col("_text").isNull(), "unknown_part")
        .when((F.col("start") < 0) | (end > F.length("_text")), "offset_out_of_range")
    )
    df = df.withColumn("_early", early)
    same, inside = F.col("_window") == F.col("quote"), F.contains("_stack", "_needle")
    asked = F.col("_early").isNull() & F.col("_fuzzy")
    df = df.withColumn("score", F.when(F.col("_early").isNotNull(), F.lit(None).cast("double")).when(same, 1.0).when(asked, similarity(F.when(asked & ~same, F.col("_window")), F.when(asked & ~same, F.col("quote")))).otherwise(0.0))
    partial = partial_similarity(F.when(asked & ~inside, F.col("_needle")), F.when(asked & ~inside, F.col("_stack")))
    held = inside | (asked & (F.coalesce(partial, F.lit(0.0)) >= F.col("_least")))
    late = F.when(F.col("score") < F.col("_least"), "quote_mismatch").when(~held, "value_not_in_quote")
    df = df.withColumn("_late", F.coalesce("_early", late))
    before = W.partitionBy(case, "field").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    taken = F.coalesce(F.max(F.col("_late").isNull().cast("int")).over(before), F.lit(0)) == 1
    df = df.withColumn("failure", F.when(taken, "duplicate_field").otherwise(F.col("_late")))
    accepted = F.col("failure").isNull()
    df = df.withColumn("mode", F.when(accepted, F.when(F.col("_fuzzy"), "fuzzy").otherwise("exact")))
    df = df.withColumn("confidence", F.when(accepted, F.when(F.col("_fuzzy"), F.greatest(F.lit(fuzzy_floor), F.bround("score", 4))).otherwise(F.lit(exact_confidence))))
    return df.drop("_text", "_least", "_fuzzy", "_window", "_needle", "_stack", "_early", "_late")


def extraction_summary(verified: DataFrame, mapped: DataFrame, case: str) -> DataFrame:
    """(case, n_records, min_confidence, discarded, failures) of a case.

    ``mapped`` has field and value by case, null where the deterministic mapper found nothing; those count as discarded
    unless a proposal of the same field was accepted (floor 0), and so does each refused proposal.
    """
    own = verified.select(case, "field", F.col("failure").isNull().alias("ok"), "failure", "confidence")
    missed = mapped.where("value is null").select(case, "field").distinct()
    recovered = missed.join(own.where("ok").select(case, "field").distinct(), [case, "field"], "left_semi").groupBy(case).agg(F.count("*").alias("_recovered"))
    counted = own.groupBy(case).agg(
        F.count_if("ok").alias("_ok"), F.count_if(~F.col("ok")).alias("_refused"), F.min(F.when(F.col("ok"), F.col("confidence"))).alias("_least"),
        F.array_sort(F.collect_set("failure")).alias("failures"),
    )
    of_mapper = mapped.groupBy(case).agg(F.count("value").alias("_mapped"), F.count_if(F.col("value").isNull()).alias("_missed"))
    joined = of_mapper.join(counted, case, "full").join(recovered, case, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        case,
        (zero("_mapped") + zero("_ok")).alias("n_records"),
        F.when(zero("_mapped") + zero("_ok") > 0, F.least(F.when(zero("_mapped") > 0, 1.0), "_least")).alias("min_confidence"),
        F.greatest(F.lit(0), zero("_missed") + zero("_refused") - zero("_recovered")).alias("discarded"),
        F.coalesce("failures", F.array().cast("array<string>")).alias("failures"),
    )

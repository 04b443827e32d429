"""Sealing personal data: placeholders, a vault, re-hydration, sweeps."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemill.functions import recognizers
from casemill.functions.arrays import settled
from casemill.functions.text import ALPHABET, PLACEHOLDER, TOKEN_LENGTH, placeholders

#: Plain patterns that native queries use; sealing takes all recognizers.
SWEEP: Mapping[str, str] = {
    "EMAIL": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "PHONE": r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "IP": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])",
    "NUMBER": r"(?<![0-9])[0-9]{16}(?![0-9])",
}


def token(kind: Column, case: Column, value: Column, salt: str) -> Column:
    """A placeholder for a value: a hash of case, kind and value in the alphabet, so that retries agree."""
    digest = F.sha2(F.concat_ws("|", F.lit(salt), case.cast("string"), kind, value), 256)
    base = F.lit(len(ALPHABET))
    digit = lambda i: F.pmod(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 10).cast("int"), base)
    letters = [F.substr(F.lit(ALPHABET), digit(i) + 1, F.lit(1)) for i in range(TOKEN_LENGTH)]
    return F.concat(F.lit("[[PII|"), kind, F.lit("|"), *letters, F.lit("]]"))


def with_findings(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: array<struct<kind, value>> of the different values that the recognizers find."""
    df = recognizers.with_hits(df, F.col(text), out)
    return df.withColumn(out, F.array_distinct(F.transform(out, lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value")))))


def sealed(docs: DataFrame, case: str, text: str, salt: str) -> DataFrame:
    """Adds ``entries`` (kind, value, token), ``sealed_text`` and ``refused`` (a sweep of the result still finds something).

    Raw text and entries stay in one row, so both can be dropped before anything is written.  Where nothing was sealed, the
    sweep could only find imitations of placeholders.
    """
    df = recognizers.spans(docs, text, "_spans")
    minted = F.transform("_spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["value"].alias("value"), token(x["kind"], F.col(case), x["value"], salt).alias("token")))
    df = df.withColumn("_spans", settled(minted))
    df = df.withColumn("entries", F.array_distinct(F.transform("_spans", lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), x["token"].alias("token")))))
    before = lambda i: F.when(i > 0, F.get("_spans", i - 1)["end"]).otherwise(0)
    parts = F.transform("_spans", lambda x, i: F.concat(F.substr(F.col(text), before(i) + 1, x["start"] - before(i)), x["token"]))
    rest = F.substr(F.col(text), before(F.size("_spans")) + 1)
    df = df.withColumn("sealed_text", settled(F.when(F.size("_spans") == 0, F.col(text)).otherwise(F.concat(F.array_join(parts, ""), rest))))
    return with_left_over(df.drop("_spans"), "sealed_text", "entries", "refused")


def with_left_over(df: DataFrame, text: str, entries: str, out: str) -> DataFrame:
    """Adds ``out``: whether a sweep of sealed text still finds something."""
    swept = F.when((F.size(entries) > 0) | F.contains(text, F.lit("[[")), F.col(text))
    return recognizers.with_residue(df.withColumn("_swept", F.coalesce(swept, F.lit(""))), F.col("_swept"), out).drop("_swept")


def vault(sealed_docs: DataFrame, case: str) -> DataFrame:
    """The entries as rows, to be kept apart from everything else."""
    return sealed_docs.select(case, F.explode("entries").alias("e")).select(case, "e.kind", "e.value", "e.token")


def _with_entries(texts: DataFrame, entries: DataFrame, case: str, text: str, *more: Column) -> DataFrame:
    """Adds ``_held`` (token -> value of the case) where the text has placeholders; other rows and their texts are not shuffled.

    A null case is a case like any other.
    """
    held = entries.groupBy(F.col(case).alias("_case")).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("token", "value")))).alias("_held"), *more)
    some = F.coalesce(F.col(text).rlike(PLACEHOLDER), F.lit(False))
    asked = texts.where(some).join(held, F.col(case).eqNullSafe(F.col("_case")), "left").drop("_case")
    return asked.unionByName(texts.where(~some), allowMissingColumns=True)


def rehydrated(texts: DataFrame, entries: DataFrame, case: str, text: str) -> DataFrame:
    """Adds ``plain``: placeholders replaced by the case's values; null if one is unknown ("whole or nothing")."""
    joined = _with_entries(texts, entries, case, text)
    found = placeholders(F.col(text))
    value = lambda t: F.element_at(F.coalesce("_held", F.expr("map('', '')")), t)
    unknown = F.exists(found, lambda t: value(t).isNull())
    plain = F.aggregate(F.array_distinct(found), F.col(text), lambda acc, t: F.replace(acc, t, value(t)))
    return joined.withColumn("plain", F.when(F.size(found) == 0, F.col(text)).when(~unknown, plain)).drop("_held")


imitated = recognizers.imitations


def minted(df: DataFrame, case: str, kind: Column, value: Column, salt: str, *texts: Column) -> DataFrame:
    """Adds ``token`` and ``present``: whether the token stands in one of the texts already (it must not)."""
    df = df.withColumn("token", token(kind, F.col(case), value, salt))
    there = F.lit(False)
    for t in texts:
        there = there | F.coalesce(F.contains(t, F.col("token")), F.lit(False))
    return df.withColumn("present", there)


def _scalars(value: object) -> Iterator[str]:
    """Every scalar of a JSON value as text, without white space; null and blank ones are left out."""
    if isinstance(value, dict | list):
        for child in value.values() if isinstance(value, dict) else value:
            yield from _scalars(child)
    elif value is not None and (bare := "".join((value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)).split())):
        yield bare


def tells_all(value: str, display: str) -> bool:
    """Whether a display form holds all that the sealed value holds, and nothing else; only white space may differ.

    The scalars of a subtree (a value that is a JSON object or list) are taken out of the display, longest first, each once,
    and nothing may be left: a house number 1 is not found in a postcode 10115 that another scalar has used up.
    """
    try:
        tree = json.loads(value)
    except ValueError:
        tree = None
    left = "".join(display.split())
    if not isinstance(tree, dict | list):
        return left == "".join(value.split())
    for part in sorted(_scalars(tree), key=len, reverse=True):
        before, hit, after = left.partition(part)
        if not hit:
            return False
        left = before + after
    return not left


@F.pandas_udf(T.BooleanType())
def lossless(value: pd.Series, display: pd.Series) -> pd.Series:
    return pd.Series([v is not None and d is not None and tells_all(v, d) for v, d in zip(value, display, strict=True)], dtype=bool)


def rehydrated_or_refused(texts: DataFrame, entries: DataFrame, case: str, text: str, display: str | None = None) -> DataFrame:
    """Adds ``refusal`` and ``plain``: an imitation of a placeholder, a token of another kind, an unknown token, or one whose
    display form lost something refuses the whole text; else every placeholder is replaced, and none is left.

    ``display`` names the column of ``entries`` with the form to write for a value; without one, values are written as they are.
    """
    entries = entries.withColumn("_lossy", ~lossless("value", display) if display else F.lit(False)).withColumn("value", F.col(display or "value"))
    letters_held = F.collect_set(F.regexp_extract("token", r"([^|]{12})\]\]$", 1)).alias("_letters")
    joined = _with_entries(texts, entries, case, text, letters_held, F.collect_set(F.when(F.col("_lossy"), F.col("token"))).alias("_lost"))
    found = F.array_distinct(placeholders(F.col(text)))
    value = lambda t: F.element_at(F.coalesce("_held", F.expr("map('', '')")), t)
    letters = lambda t: F.regexp_extract(t, r"([^|]{12})\]\]$", 1)
    unknown = F.filter(found, lambda t: value(t).isNull())
    other_kind = F.exists(unknown, lambda t: F.coalesce(F.array_contains("_letters", letters(t)), F.lit(False)))
    refusal = F.when(imitated(F.col(text)), "imitation").when(other_kind, "kind_mismatch").when(F.size(unknown) > 0, "unknown_token").when(F.coalesce(F.arrays_overlap(found, "_lost"), F.lit(False)), "lossy")
    plain = F.aggregate(found, F.col(text), lambda acc, t: F.replace(acc, t, value(t)))
    joined = joined.withColumn("refusal", refusal).withColumn("plain", F.when(F.col("refusal").isNull(), plain)).drop("_held", "_letters", "_lost")
    return joined.withColumn("plain", F.when(~F.coalesce(F.col("plain").rlike(PLACEHOLDER), F.lit(False)), F.col("plain")))

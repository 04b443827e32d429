"""Anomaly features of a case, reasons and degradation; scores come from a reference population (see ``reference``)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions.dates import signed_years
from casemill.functions.text import is_blank, stripped

from .context import holds_placeholder


@dataclass(frozen=True)
class Indicator:
    """A field and the (lower case) values of it that count."""

    column: str
    counts: Sequence[str]


def percent(text: Column) -> Column:
    """A percentage with a comma or a point as a share from 0 to 1; null if it is no number."""
    number = F.replace(stripped(text), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number / 100)))


def present(name: str) -> Column:
    return ~is_blank(F.col(name).cast("string"))


def filled_share(columns: Sequence[str]) -> Column:
    """Share of the columns that hold something; null for no columns."""
    if not columns:
        return F.lit(None).cast("double")
    total = sum((present(c).cast("int") for c in columns), F.lit(0))
    return F.bround(total / len(columns), 6)


def features(df: DataFrame, *, fields: Sequence[str], indicators: Sequence[Indicator], share: str, leading: str, received: str, prose: str, scanned: Column) -> DataFrame:
    """Adds ``features`` (struct of numbers, by name), ``available`` (struct of flags) and ``degraded``.

    A feature without its value is 0.0 and not available, so 0.0 is never read as a measurement.  Sealed values may be
    counted as present, but where one whose content is read holds a placeholder, the whole item is degraded and all of
    its features are null.
    """
    read = [i.column for i in indicators] + [share]
    held = F.lit(False)
    for name in read:
        held = held | holds_placeholder(F.col(name).cast("string"))
    there = sum((present(i.column).cast("int") for i in indicators), F.lit(0))
    hits = sum((F.coalesce(F.lower(stripped(F.col(i.column).cast("string"))).isin(*i.counts), F.lit(False)).cast("int") for i in indicators), F.lit(0))
    day, stated = F.col(leading).cast("date"), percent(F.col(share).cast("string"))
    values: dict[str, tuple[Column, Column]] = {
        "filled_share": (filled_share(fields), F.lit(bool(fields))),
        "indicators_present": (F.bround(there / max(len(indicators), 1), 6), F.lit(True)),
        "indicators_share": (F.bround(hits / F.nullif(there, F.lit(0)), 6), there > 0),
        "leading_date": (day.isNotNull().cast("double"), F.lit(True)),
        "leading_years": (signed_years(F.col(received).cast("date"), day), day.isNotNull()),
        "prose": ((~is_blank(F.col(prose))).cast("double"), F.lit(True)),
        "revenue_share": (F.bround(stated, 6), stated.isNotNull()),
        "scanned": (scanned.cast("double"), F.lit(True)),
    }
    numbers = F.struct(*[F.coalesce(v, F.lit(0.0)).cast("double").alias(k) for k, (v, _) in values.items()])
    flags = F.struct(*[a.alias(k) for k, (_, a) in values.items()])
    return df.withColumns({"features": F.when(~held, numbers), "available": F.when(~held, flags), "degraded": F.when(held, "a sealed value reached the features")})


def flagged(df: DataFrame, score: str, threshold: float, reasons: str) -> DataFrame:
    """Adds ``flagged`` and ``readable``: a flag needs reasons, each of some length and with feature, observation and expectation."""
    flag = F.coalesce(F.col(score) >= threshold, F.lit(False))
    whole = F.forall(reasons, lambda r: ~is_blank(r["feature"]) & (F.length(stripped(r["observed"])) >= 3) & (F.length(stripped(r["expected"])) >= 3))
    return df.withColumns({"flagged": flag, "readable": ~flag | F.coalesce((F.size(reasons) > 0) & whole, F.lit(False))})


def reason_sentence(reason: Column) -> Column:
    sign = F.when(reason["contribution"] >= 0, "+").otherwise("-")
    return F.concat(reason["feature"], F.lit(": observed "), reason["observed"], F.lit("; expected "), reason["expected"], F.lit("; contribution "), sign, F.format_number(F.abs(reason["contribution"]), 3), F.lit("."))


def evidence_or_degraded(df: DataFrame, score: str, degraded: str) -> DataFrame:
    """Adds ``anomaly``: a struct with score and status; a failure leaves the score null and keeps its reason, and stops nothing."""
    missing = F.col(score).isNull() | F.isnan(F.col(score))
    status = F.when(F.col(degraded).isNotNull(), F.col(degraded)).when(missing, "no score").otherwise("scored")
    return df.withColumn("anomaly", F.struct(F.when(status == "scored", F.col(score)).alias("score"), status.alias("status")))


def validate_reference(rows: DataFrame, names: Sequence[str], values: str, declared: Sequence[str]) -> None:
    """A reference population names the declared features, has a value for each in each row, and is not empty."""
    if list(names) != list(declared):
        raise ValueError("the reference population has other features")
    wrong = rows.where(F.size(values) != len(names)).limit(1).count()
    if wrong or rows.isEmpty():
        raise ValueError("the reference population is empty or has rows of another width")



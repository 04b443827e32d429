"""First-match decision tables, their explanation, downgrades and audit samples."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rules import RuleError, compile_rule

#: Tier that an item has if no row matches or something fails: the most oversight.
DEFAULT_TIER = 3
#: What a downgrade may test: only ways in which a rising score raises oversight.
MONOTONE = {("score", "gt"), ("score", "ge"), ("flagged", "eq")}


@dataclass(frozen=True)
class Row:
    row_id: str
    when: Mapping[str, Any]
    tier: int


def decide(df: DataFrame, table: Sequence[Row], tier: str = "tier", matched: str = "row_id", failed: str | None = None) -> DataFrame:
    """Adds the tier and id of the first row that matches, and how many rows failed before it.

    Without a match the tier is the default and the id is "default".
    """
    tests = [compile_rule(r.when, df.schema) for r in table]
    place: Column = F.lit(len(table))
    for i in reversed(range(len(table))):
        place = F.when(tests[i], F.lit(i)).otherwise(place)
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("_place"))
    out = df.withColumn("_place", place).withColumns({tier: pick([*(r.tier for r in table), DEFAULT_TIER]), matched: pick([*(r.row_id for r in table), "default"])})
    if failed:
        out = out.withColumn(failed, F.col("_place").cast("long"))
    return out.drop("_place")


@dataclass(frozen=True)
class Downgrade:
    rule_id: str
    field: str
    op: str
    value: Any
    to_tier: int = 3

    def __post_init__(self) -> None:
        if (self.field, self.op) not in MONOTONE or (self.op == "eq" and self.value is not True):
            raise RuleError(f"a downgrade must be monotone: {self.field} {self.op}")


def downgrade(df: DataFrame, rules: Sequence[Downgrade], tier: str, *, enforcing: bool) -> DataFrame:
    """Adds ``fired`` (ids) and ``final_tier``: raised by ``greatest`` if enforcing, else only recorded."""
    tests = {r.rule_id: compile_rule({"field": r.field, "op": r.op, "value": r.value}, df.schema) for r in rules}
    fired = F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())
    raised = F.greatest(F.col(tier), *[F.when(tests[r.rule_id], r.to_tier).otherwise(F.col(tier)) for r in rules], F.col(tier))
    return df.withColumns({"fired": fired, "final_tier": raised if enforcing else F.col(tier)})


def draw(key: Column, salt: str = "") -> Column:
    """A keyed draw in [0, 1): 52 bits of the MD5 of salt and key, the same wherever it is computed."""
    digest = F.md5(F.concat(F.lit(salt), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def audit_sample(df: DataFrame, key: str, rate: float, salt: str, tier: str) -> DataFrame:
    """Adds ``sampled``, and raises the tier of sampled items below 3; off without a rate or a salt."""
    hit = F.lit(False) if rate <= 0 or not salt else (draw(F.col(key), salt) < rate) & (F.col(tier) < 3)
    return df.withColumn("sampled", hit).withColumn(tier, F.when(F.col("sampled"), F.lit(3)).otherwise(F.col(tier)))


@F.pandas_udf(T.DoubleType())
def keyed_draw(key: pd.Series, salt: pd.Series) -> pd.Series:
    """A draw in [0, 1) from the first eight bytes of a keyed BLAKE2b hash, which no native function has."""
    at = lambda k, s: int.from_bytes(hashlib.blake2b(str(k).encode(), key=str(s).encode()[:64], digest_size=8).digest(), "big") / 2**64
    return pd.Series([at(k, s) for k, s in zip(key, salt, strict=True)], dtype="float64")

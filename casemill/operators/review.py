"""Review: queues, census, backlog, unit metrics with suppression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups below this size are not shown.
SMALLEST_GROUP = 5


def queue(cases: DataFrame, age: Column, *, budget: Column | None = None) -> DataFrame:
    """Adds ``position`` within ``queue``: oldest first, unknown ages last, then by case; and ``over_budget``.

    Hours of age are counted first, so a task sorts the cases of one queue and hour; an hour starts at the sum of the
    older hours, a window over a row for each hour.
    """
    from pyspark.sql import Window as W

    out = cases.withColumn("age", F.coalesce(age, F.lit(0.0)))
    if budget is not None:
        out = out.withColumn("over_budget", F.coalesce(F.col("age") > budget, F.lit(False)))
    out = out.withColumn("_hour", F.floor("age"))
    hours = out.groupBy("queue", "_hour").agg(F.count("*").alias("_n"))
    older = W.partitionBy("queue").orderBy(F.col("_hour").desc()).rowsBetween(W.unboundedPreceding, -1)
    hours = hours.select(F.col("queue").alias("_queue"), F.col("_hour").alias("_h"), F.coalesce(F.sum("_n").over(older), F.lit(0)).alias("_older"))
    inside = F.row_number().over(W.partitionBy("queue", "_hour").orderBy(F.col("age").desc(), "case_id"))
    joined = out.withColumn("_place", inside).join(hours, F.col("queue").eqNullSafe(F.col("_queue")) & (F.col("_hour") == F.col("_h")))
    return joined.withColumn("position", (F.col("_older") + F.col("_place")).cast("long")).drop("_hour", "_place", "_queue", "_h", "_older")


def census(cases: DataFrame, unit: str, tier: str, unknown: str = "clearing") -> DataFrame:
    """Counts by unit, by tier and in all, in one pass over grouping sets."""
    named = cases.withColumns({"_u": F.coalesce(F.col(unit).cast("string"), F.lit(unknown)), "_t": F.col(tier).cast("string")})
    counted = named.groupingSets([["_u"], ["_t"], []], "_u", "_t").agg(F.count("*").alias("n"), F.grouping_id("_u", "_t").alias("_g"))
    level = F.when(F.col("_g") == 1, "unit").when(F.col("_g") == 2, "tier").otherwise("all")
    return counted.select(level.alias("level"), F.coalesce("_u", "_t", F.lit("")).alias("key"), "n").where("level != 'tier' or key != ''")


def suppressed(value: Column, n: Column, least: int = SMALLEST_GROUP) -> Column:
    return F.when(n >= least, value)


def backlog(cases: DataFrame, tier: str, age: str, budgets: dict[int, float]) -> DataFrame:
    """Oldest open case of each tier, and how many are over the tier's budget; cases without a tier are left out."""
    budget = F.element_at(F.create_map(*[x for k, v in budgets.items() for x in (F.lit(k), F.lit(v))]), F.col(tier))
    over = F.coalesce(F.col(age) > budget, F.lit(False))
    return cases.where(F.col(tier).isNotNull()).groupBy(tier).agg(F.count("*").alias("n"), F.max(age).alias("oldest"), F.count_if(over).alias("n_over"))


def grouped_levels(df: DataFrame, levels: Sequence[Sequence[str]], **aggregates: Column) -> DataFrame:
    """Aggregates at several levels in one pass; columns that a level leaves out are null."""
    names = list(dict.fromkeys(c for level in levels for c in level))
    return df.groupingSets([list(level) for level in levels], *names).agg(*[c.alias(k) for k, c in aggregates.items()])


def unit_metrics(cases: DataFrame, least: int = SMALLEST_GROUP) -> DataFrame:
    """Review numbers of each effective unit from cases (unit, confirmed, overridden, seconds to the confirmation).

    A case that was overridden several times counts once.  Rates of units with fewer than ``least`` cases are not shown: of
    confirmed ones, and for overrides of confirmed and overridden ones together (a case can be in both).
    """
    done, other = F.col("confirmed"), F.col("overridden")
    g = cases.where(F.col("unit").isNotNull()).groupBy("unit").agg(
        F.count_if(done).alias("confirmed"), F.count_if(done & ~other).alias("without_edit"), F.count_if(other).alias("overridden"), F.median(F.when(done, F.col("seconds"))).alias("_median")
    )
    n, both = F.col("confirmed"), F.col("confirmed") + F.col("overridden")
    return g.select(
        "unit", "confirmed", "without_edit", "overridden",
        suppressed(F.col("without_edit") / n, n, least).alias("clean_rate"), suppressed(F.col("overridden") / both, both, least).alias("override_rate"), suppressed(F.col("_median"), n, least).alias("median_seconds"),
    )

"""Evaluation against labels: rates, precision and recall, confusion, sweeps, calibration, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import running


def ratio(top: Column, bottom: Column, empty: float) -> Column:
    """top / bottom; ``empty`` where there is nothing to divide by (conventions differ by caller)."""
    return F.when(bottom == 0, F.lit(empty)).otherwise(top / bottom)


def tier_rates(df: DataFrame, expected: str, actual: str, *by: str) -> DataFrame:
    """Accuracy; false clear: tier 1 where more was expected; false flag: more where tier 1 was expected."""
    e, a, n = F.col(expected), F.col(actual), F.count("*")
    counted = df.groupBy(*by).agg(
        n.alias("n"), F.count_if(e == a).alias("n_right"), F.count_if((e > 1) & (a == 1)).alias("n_false_clear"), F.count_if((e == 1) & (a > 1)).alias("n_false_flag")
    )
    return counted.withColumns({"accuracy": ratio(F.col("n_right"), F.col("n"), 1.0)})


def micro_counts(df: DataFrame, actual: str, expected: str) -> DataFrame:
    """Sums over rows of what two sets share and miss."""
    a, e = F.col(actual), F.col(expected)
    sums = df.agg(
        F.coalesce(F.sum(F.size(F.array_intersect(a, e))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.size(F.array_except(a, e))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.size(F.array_except(e, a))), F.lit(0)).alias("fn"),
    )
    sums = sums.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0)})
    return sums.withColumn("f1", ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"), 1.0))


def confusion(df: DataFrame, expected: str, actual: str) -> DataFrame:
    return df.groupBy(F.col(expected).alias("expected"), F.col(actual).alias("actual")).agg(F.count("*").alias("n"))


def threshold_sweep(df: DataFrame, score: str, positive: Column, thresholds: Sequence[float]) -> DataFrame:
    """For each threshold how many rows reach it and how many of these are positive: one pass, no cross join."""
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    hit = df.select(F.explode(F.transform(grid, lambda t: F.struct(t.alias("threshold"), (F.col(score) >= t).alias("over"), positive.alias("positive")))).alias("x")).select("x.*")
    return hit.groupBy("threshold").agg(F.count_if("over").alias("n_over"), F.count_if(F.col("over") & F.col("positive")).alias("n_hit"), F.count_if(~F.col("over")).alias("n_under"))


def skew(df: DataFrame, group: str, flagged: Column, least: int) -> DataFrame:
    """Highest over lowest rate among groups of at least ``least`` rows; null for fewer than two groups or a lowest rate of 0."""
    rates = df.groupBy(group).agg(F.count("*").alias("n"), F.avg(flagged.cast("double")).alias("rate")).where(F.col("n") >= least)
    top = F.max_by(F.col(group), F.struct(F.col("rate"), F.col(group)))
    low = F.min_by(F.col(group), F.struct(F.col("rate"), F.col(group)))
    out = rates.agg(F.count("*").alias("n_groups"), F.max("rate").alias("high"), F.min("rate").alias("low"), top.alias("highest"), low.alias("lowest"))
    return out.withColumn("skew", F.when((F.col("n_groups") >= 2) & (F.col("low") > 0), F.col("high") / F.col("low")))


def equal_bins(df: DataFrame, score: str, bins: int) -> DataFrame:
    """Adds ``bin``, numbered from 0: the sorted rows are cut at ``i * n // bins``, and where a cut would part equal scores,
    the bin after it goes to the one before.

    Ranks are a global order, so scores are counted first, and running counts are made range by range.
    """
    counts = df.groupBy(score).agg(F.count("*").alias("_n"))
    ranked = running(counts, score, "_n", "_upto", "_all")
    k = F.least(F.lit(bins).cast("long"), F.col("_all"))
    at = lambda place: F.floor(((place + 1) * k - 1) / F.col("_all")).cast("int")
    ranked = ranked.select(score, at(F.col("_upto") - F.col("_n")).alias("_first"), at(F.col("_upto") - 1).alias("_last"))
    # A score that lies in several bins makes them one; there are fewer such spans than bins.
    spans = ranked.where("_last > _first").select("_first", "_last").distinct().collect()
    joined = {i for s in spans for i in range(s["_first"] + 1, s["_last"] + 1)}
    number, names = -1, []
    for i in range(bins):
        number += i not in joined
        names.append(number)
    return df.join(ranked.select(score, F.get(F.array(*[F.lit(x) for x in names]), F.col("_first")).cast("long").alias("bin")), score)


def calibration_error(binned: DataFrame, confidence: str, right: Column) -> DataFrame:
    """Expected calibration error over the column ``bin``."""
    groups = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(right.cast("double")).alias("a"))
    return groups.agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))


def isotonic(means: Sequence[float], weights: Sequence[float]) -> list[float]:
    """Pool adjacent violators: the non-decreasing sequence nearest to ``means``.  For a few bins, on the driver."""
    blocks: list[list[float]] = []
    for m, w in zip(means, weights, strict=True):
        blocks.append([m, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            m2, w2, k2 = blocks.pop()
            m1, w1, k1 = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, k1 + k2])
    return [float(m) for m, _, k in blocks for _ in range(int(k))]


def calibrate(df: DataFrame, score: str, right: Column, bins: int = 10) -> list[tuple[float, float]]:
    """A step map (upper score, calibrated value): equal bins, isotonic means, last upper 1, first of equal uppers."""
    rows = equal_bins(df, score, bins).groupBy("bin").agg(F.max(score).alias("u"), F.avg(right.cast("double")).alias("m"), F.count("*").alias("n")).orderBy("bin").collect()
    values = isotonic([r["m"] for r in rows], [r["n"] for r in rows])
    uppers = [float(r["u"]) for r in rows]
    if uppers:
        uppers[-1] = max(1.0, uppers[-1])
    return list({u: (u, v) for u, v in reversed(list(zip(uppers, values, strict=True)))}.values())[::-1]


def apply_calibration(score: Column, steps: Sequence[tuple[float, float]]) -> Column:
    """The value of the smallest upper bound that reaches the score, else the last."""
    out = F.lit(steps[-1][1])
    for upper, value in reversed(steps[:-1]):
        out = F.when(score <= upper, value).otherwise(out)
    return out


def histogram(df: DataFrame, score: Column, bins: int = 10) -> DataFrame:
    """Rows in each of ``bins`` equal parts of [0, 1]; the last is closed."""
    return df.groupBy(F.least(F.floor(score * bins), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """min, the upper of the middle values, the 90th percentile by index, and max; by counts of different values."""
    upto = running(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n")), value, "_n", "_upto", "_all")
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col(value)))
    middle, ninth = F.floor(F.col("_all") / 2), F.least(F.col("_all") - 1, F.floor(9 * F.col("_all") / 10))
    return upto.agg(F.min(value).alias("low"), at(middle).alias("median"), at(ninth).alias("p90"), F.max(value).alias("high"))


def gates(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(gate, passed) of aggregate conditions over ``df``; a condition that is null fails."""
    rows = F.array(*[F.struct(F.lit(name).alias("gate"), F.coalesce(check, F.lit(False)).alias("passed")) for name, check in checks.items()])
    return df.agg(rows.alias("_g")).select(F.inline("_g"))


def span_counts(df: DataFrame, kinds: str, verified: Column) -> DataFrame:
    """(kind, n, n_verified, n_discarded); an item of several kinds counts in each."""
    each = df.select(F.explode(kinds).alias("kind"), F.coalesce(verified, F.lit(False)).alias("_ok"))
    return each.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("_ok").alias("n_verified"), F.count_if(~F.col("_ok")).alias("n_discarded"))


def invariants(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(metric, held) of aggregate conditions that must hold exactly."""
    return gates(df, checks).select(F.col("gate").alias("metric"), F.col("passed").alias("held"))


def agreement(df: DataFrame, covered: str, agrees: str, score: str) -> DataFrame:
    """How many items a classifier covers, on how many of these it agrees, and its scores where it is right and wrong."""
    c, a = F.col(covered), F.coalesce(F.col(agrees), F.lit(False))
    inside = F.when(c, F.col(score))
    return df.agg(
        F.count("*").alias("n"), F.count_if(c).alias("n_covered"), F.count_if(c & a).alias("n_agreed"), F.avg(F.when(c & a, F.col(score))).alias("mean_right"), F.avg(F.when(c & ~a, F.col(score))).alias("mean_wrong"),
        F.min(inside).alias("low"), F.max(inside).alias("high"),
    )


def register(thresholds: DataFrame, today: Column) -> DataFrame:
    """Adds calibrated (a fitted value is there), days_left until the review is due, and overdue."""
    left = F.datediff("due", today)
    return thresholds.withColumns({"calibrated": F.col("fitted").isNotNull(), "days_left": left, "overdue": F.coalesce(left < 0, F.lit(False))})


def compared(expected: DataFrame, found: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(n_expected, n_found, n_equal): a live run held against recorded results."""
    other = found.select(*keys, F.col(value).alias("_found"), F.lit(True).alias("_there"))
    joined = expected.join(other, list(keys), "left")
    return joined.agg(F.count("*").alias("n_expected"), F.count("_there").alias("n_found"), F.count_if(F.col("_there") & F.col(value).eqNullSafe(F.col("_found"))).alias("n_equal"))


def directory_diff(expected: DataFrame, actual: DataFrame, name: str, digest: str) -> DataFrame:
    """(name, state): missing, stale (not expected) or differs; equal entries are left out."""
    a = expected.select(F.col(name).alias("_a"), F.col(digest).alias("_x"))
    b = actual.select(F.col(name).alias("_b"), F.col(digest).alias("_y"))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "stale").when(~F.col("_x").eqNullSafe(F.col("_y")), "differs")
    return a.join(b, F.col("_a") == F.col("_b"), "full").select(F.coalesce("_a", "_b").alias(name), state.alias("state")).where("state is not null")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).unionAll(b.subtract(a))

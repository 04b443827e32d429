"""Mixing sources to target weights by capped water-filling (native).

Every source gets a share of a budget of words in proportion to its weight, but
never more than ``max_epochs`` times its own size; what a clamped source cannot
take is shared among the others by weight, until none is above its cap.  A
source's target is then met by whole repetitions of all its documents plus one
seeded partial repetition.

The partial repetition orders a source's rows by a seeded hash of id and text and
takes them until the target is reached.  Hashes fall into 4096 bins, in the order
of the hashes; sums per (source, bin) tell in which bin a source's target is reached,
so that only the rows of that one bin are ordered by a window.  There, rows that repeat
id, text and size count as one entry, so no task ever sees a whole source, nor all
repetitions of a row.

Cases: null text has size 0; null source is a source of its own, last in order;
null ids are told apart by their texts; rows that repeat id and text are kept, each on
its own; an empty table gives an empty result; a source of size 0 has target 0.  Only
the columns ``doc_id``, ``text`` and ``source`` are read; the operator's own columns have
a prefix that no column of the caller has, and all of the caller's stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD, free_prefix, n_words, small, written

#: Bins of the seeded hash of 60 bits are its upper bits; a source's crossing bin holds about 1/4096 of its different rows.
BIN_BITS = 12


@dataclass(frozen=True)
class MixPlan:
    """weights repeat over the sources in code point order; budget is a factor of all sizes."""

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    budget: float = 1.5
    max_epochs: float = 2.0
    seed: int = 20231


def water_fill(sources: DataFrame, plan: MixPlan) -> DataFrame:
    """Targets for a table (source, source_size), one row for each source.

    Sorted by cap over weight, the clamped sources are a prefix: a source is
    clamped if the level that fits it and all later ones is above its own cap.
    """
    everything = W.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in plan.weights])
    ranked = sources.withColumn("rank", F.row_number().over(everything)).select(
        "source",
        "source_size",
        F.element_at(weights, ((F.col("rank") - 1) % len(plan.weights) + 1).cast("int")).alias("w"),
        (F.col("source_size") * F.lit(plan.max_epochs)).alias("cap"),
        "rank",
    )
    by_level = W.orderBy(F.col("cap") / F.col("w"), "rank")
    all_rows = W.partitionBy()
    levelled = ranked.select(
        "*",
        F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("cap_before"),
        F.sum("w").over(by_level.rowsBetween(0, W.unboundedFollowing)).alias("w_from"),
        (F.sum("source_size").over(all_rows) * F.lit(plan.budget)).alias("budget"),
    ).withColumn("clamped", F.col("cap") * F.col("w_from") <= F.col("w") * (F.col("budget") - F.col("cap_before")))
    free_w = F.sum(F.when(~F.col("clamped"), F.col("w")).otherwise(0.0)).over(all_rows)
    spent = F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0.0)).over(all_rows)
    level = F.when(free_w > 0, (F.col("budget") - spent) / free_w).otherwise(F.lit(0.0))
    return levelled.select(
        "source",
        "source_size",
        F.when(F.col("clamped"), F.col("cap")).otherwise(F.least(F.col("w") * level, F.col("cap"))).alias("target"),
    )


def row_hash(plan: MixPlan) -> Column:
    """60 bits of a hash of seed, id and text (null as empty)."""
    text = F.concat(F.lit(f"{plan.seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _keyed(docs: DataFrame, plan: MixPlan, p: str) -> DataFrame:
    """Adds size, hash and bin, after a prefix."""
    return docs.withColumns({p + "size": n_words(F.col("text")), p + "hash": row_hash(plan)}).withColumn(p + "bin", F.shiftright(p + "hash", 60 - BIN_BITS).cast("int"))


def source_plan(keyed: DataFrame, plan: MixPlan, p: str) -> DataFrame:
    """A row for each source: size, target, whole repetitions, and where the partial one ends."""
    bins = written(keyed.groupBy("source", F.col(p + "bin").alias("bin")).agg(F.sum(p + "size").alias("bin_size")), "mix-bins")
    targets = water_fill(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), plan)
    targets = targets.withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    running = W.partitionBy("source").orderBy("bin")
    cut = (
        bins.withColumn("upto", F.sum("bin_size").over(running))
        .alias("b")
        .join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
        .groupBy(F.col("t.source").alias("source"))
        .agg(
            F.first("t.source_size").alias("source_size"),
            F.first("t.target").alias("target"),
            F.first("t.whole").alias("whole"),
            F.first("t.part").alias("part"),
            F.min(F.when(F.col("b.upto") > F.col("t.part"), F.col("b.bin"))).alias("cut_bin"),
            F.coalesce(F.max(F.when(F.col("b.upto") <= F.col("t.part"), F.col("b.upto"))), F.lit(0)).alias("before"),
        )
    )
    return written(cut, "mix-sources")


def _at_cut(rows: DataFrame, p: str) -> DataFrame:
    """The rows of the cut bins with extra: the words of the partial repetition that each takes.

    Equal rows (source, hash, size) are one entry of the ordered window.  Of the one entry of a source in which its
    part ends, rows are numbered within the tasks that hold them, after the rows of the tasks before.
    """
    entry = [p + "p_source", p + "hash", p + "size"]
    apart = lambda df, names: df.withColumnsRenamed({c: c + "_" for c in names})
    same = lambda names: [F.col(c).eqNullSafe(F.col(c + "_")) for c in names]
    entries = rows.groupBy(*entry).agg(F.count("*").alias(p + "n"), F.first(p + "room").alias(p + "room"))
    order = W.partitionBy(entry[0]).orderBy(*entry[1:]).rowsBetween(W.unboundedPreceding, -1)
    left = F.floor(F.col(p + "room") - F.coalesce(F.sum(F.col(p + "n") * F.col(p + "size")).over(order), F.lit(0)))
    entries = written(entries.select(*entry, p + "n", F.greatest(F.lit(0), left).cast("long").alias(p + "left")), "mix-entries")
    joined = written(rows.join(small(apart(entries.drop(p + "n"), entry)), same(entry)).drop(*[c + "_" for c in entry]).withColumn(p + "task", F.spark_partition_id()), "mix-cut")
    tasks = joined.groupBy(*entry, p + "task").agg(F.count("*").alias(p + "k"))
    earlier = W.partitionBy(*entry).orderBy(p + "task").rowsBetween(W.unboundedPreceding, -1)
    tasks = tasks.select(*entry, p + "task", F.coalesce(F.sum(p + "k").over(earlier), F.lit(0)).alias(p + "earlier"))
    named = [*entry, p + "task"]
    numbered = joined.join(apart(tasks, named), same(named)).drop(*[c + "_" for c in named])
    number = F.col(p + "earlier") + F.row_number().over(W.partitionBy(*named).orderBy(F.lit(0))) - 1
    extra = F.greatest(F.lit(0), F.least(F.col(p + "size"), F.col(p + "left") - number * F.col(p + "size"))).cast("long")
    return numbered.withColumn(p + "extra", extra).drop(p + "left", p + "task", p + "earlier")


def mixed(keyed: DataFrame, plan: MixPlan, p: str) -> DataFrame:
    """``keyed`` with source_size, target, taken and times after the prefix.

    taken is the number of words taken, with the one row at a source's cut taken in
    part; times takes that row whole if at least half of it fits.
    """
    sources = source_plan(keyed, plan, p).select(*[F.col(c).alias(f"{p}p_{c}") for c in ("source", "source_size", "target", "whole", "part", "cut_bin", "before")])
    joined = keyed.join(small(sources), F.col("source").eqNullSafe(F.col(p + "p_source")))
    of = lambda c: F.col(p + c)
    at_cut = F.coalesce(of("bin") == of("p_cut_bin"), F.lit(False))
    inside = F.coalesce(of("bin") < of("p_cut_bin"), of("p_part") > 0)
    rest = joined.where(~at_cut).withColumn(p + "extra", F.when(inside, of("size")).otherwise(F.lit(0)).cast("long")).withColumn(p + "more", F.when(inside, 1).otherwise(0))
    cut = _at_cut(joined.where(at_cut).withColumn(p + "room", of("p_part") - of("p_before")), p).drop(p + "room")
    cut = cut.withColumn(p + "more", F.when(of("extra") * 2 >= of("size"), 1).otherwise(0))
    both = rest.unionByName(cut)
    return both.withColumns({p + "taken": (of("p_whole") * of("size") + of("extra")).cast("long"), p + "times": of("p_whole") + of("more")})


def mixture(docs: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """The mixed corpus itself: each document as often as the mix takes it, with the same columns.

    A document without words has no part in the word budget; it stays once.
    """
    p = free_prefix(docs, "mix_")
    has_words = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    times = F.when(has_words, F.col(p + "times")).otherwise(F.lit(1)).cast("int")
    taken = mixed(_keyed(docs, plan, p), plan, p).where(times > 0)
    return taken.withColumn(p + "copy", F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def mix_query(docs: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """doc_id, size, source_size, target and taken for each row of ``docs``."""
    keyed = written(_keyed(docs.select("doc_id", "text", "source"), plan, "mix_").drop("text"), "mix-sizes")
    out = mixed(keyed, plan, "mix_")
    names = {"mix_size": "size", "mix_p_source_size": "source_size", "mix_p_target": "target", "mix_taken": "taken"}
    return out.select("doc_id", *[F.col(c).alias(n) for c, n in names.items()])

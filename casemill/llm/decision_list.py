"""Quality rules as a learned decision list (native).

Sequential covering: grow a conjunction of thresholds on half-open statistics for
rows of either class, prune its last conditions on rows that the growing did not
see, put the better of both rules on the list if it is precise enough, take the
rows that it covers away, and go on while a rule can be found.  A rule is as good
as the share of its class that it covers, against the share of the other class; a
rule that rejects must also be right for most of the rows that it covers.  Rules to
keep stand where they shield good rows from a wider rule to reject behind them.
The list becomes one ordered ``CASE WHEN`` column, so that applying it needs no
Python on the executors.

The list judges what the base rules leave, so it learns from labelled rows that
they leave.  Learning takes at most ``Settings.sample`` labelled rows, chosen by a
hash of their id; this bound is a parameter.  Statistics are computed for every row.

Cases: null text is empty text; an empty or unlabelled table gives an empty list,
whose verdict is ``True``; null labels and null ids are left out of learning;
repeated rows count as often as they stand; columns of the caller are kept, and
the statistics have a prefix that no column of the caller has.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_prefix
from .text_stats import COUNTS, with_counts

#: Ratios that conditions may use: name -> (count, count that it is divided by).
RATIOS = {
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "bang_share": ("n_bangs", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "line_length": ("n_words", "n_lines"),
}
FEATURES = ("n_words", *RATIOS)


@dataclass(frozen=True)
class Settings:
    sample: int = 12_000
    cuts: int = 48
    max_conditions: int = 3
    max_rules: int = 24
    #: Share of the learning rows that a rule covers at least (two rows in any case).
    min_share: float = 0.004
    #: Share of a rejecting rule's rows that are bad, at least.
    min_precision: float = 0.7
    #: Share of its class against both shares, at least.
    min_balance: float = 0.9
    seed: int = 7


@dataclass(frozen=True)
class Condition:
    """feature <= cut, or feature > cut."""

    feature: str
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        value = x[:, FEATURES.index(self.feature)]
        return value > self.cut if self.above else value <= self.cut


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    verdict: bool


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...] = ()
    default: bool = True
    trained_on: int = field(default=0, compare=False)

    def column(self, values: dict[str, Column]) -> Column:
        """The verdict as one ordered conditional expression over the named statistics."""
        verdict: Column | None = None
        for rule in self.rules:
            test = F.lit(True)
            for c in rule.conditions:
                test = test & (values[c.feature] > c.cut if c.above else values[c.feature] <= c.cut)
            verdict = F.when(test, rule.verdict) if verdict is None else verdict.when(test, rule.verdict)
        return F.lit(self.default) if verdict is None else verdict.otherwise(self.default)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.default)
        open_ = np.ones(len(x), bool)
        for rule in self.rules:
            hit = open_ & _hits(rule.conditions, x)
            out[hit] = rule.verdict
            open_ &= ~hit
        return out

    def __str__(self) -> str:
        line = lambda r: " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.cut:g}" for c in r.conditions)
        return "\n".join([f"if {line(r)}: {'keep' if r.verdict else 'reject'}" for r in self.rules] + [f"else: {'keep' if self.default else 'reject'}"])


def ratios(prefix: str) -> dict[str, Column]:
    """Feature name -> column over the counts with ``prefix``; a ratio of nothing is 0."""
    count = lambda name: F.col(prefix + name)
    found = {"n_words": count("n_words").cast("double")}
    for name, (top, bottom) in RATIOS.items():
        found[name] = F.when(count(bottom) > 0, count(top) / count(bottom)).otherwise(F.lit(0.0))
    return found


def _grow(x: np.ndarray, target: np.ndarray, cuts: list[np.ndarray], cover: int, s: Settings) -> list[Condition]:
    """Adds the condition with the largest information gain on the target class, again and again."""
    rows, conditions = np.arange(len(x)), []
    while len(conditions) < s.max_conditions:
        now, held = target[rows], x[rows]
        p0, n0 = now.sum(), len(now) - now.sum()
        if not p0 or not n0:
            break
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for f, values in enumerate(cuts):
            order = np.argsort(held[:, f], kind="stable")
            at = np.searchsorted(held[order, f], values, side="right")
            positives = np.concatenate([[0], np.cumsum(now[order])])[at]
            for above in (False, True):
                p = p0 - positives if above else positives
                n = (len(now) - at if above else at) - p
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where((p + n >= cover) & (p > 0), p * (np.log2(p / np.maximum(p + n, 1)) - base), -1)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), Condition(FEATURES[f], above, float(values[gain.argmax()])))
        if best[1] is None:
            break
        conditions.append(best[1])
        rows = rows[best[1].holds(held)]
    return conditions


def _widened(conditions: list[Condition], x: np.ndarray) -> list[Condition]:
    """Each cut moved to the middle of the gap in which it lies, among the rows that the conditions before it leave."""
    out = []
    for c in conditions:
        values = x[:, FEATURES.index(c.feature)]
        below, over = values[values <= c.cut], values[values > c.cut]
        cut = float((below.max() + over.min()) / 2) if len(below) and len(over) else c.cut
        out.append(Condition(c.feature, c.above, cut))
        x = x[c.holds(x)]
    return out


def _tightest(conditions: list[Condition]) -> tuple[Condition, ...]:
    """One condition for each feature and side: the tightest."""
    held: dict[tuple[str, bool], Condition] = {}
    for c in conditions:
        old = held.get((c.feature, c.above))
        if old is None or (c.cut > old.cut if c.above else c.cut < old.cut):
            held[c.feature, c.above] = c
    return tuple(held.values())


def _hits(conditions: Sequence[Condition], x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([np.ones(len(x), bool), *[c.holds(x) for c in conditions]])


def _pruned(conditions: list[Condition], x: np.ndarray, target: np.ndarray) -> list[Condition]:
    """The shortest prefix with the best share of its class less the share of the other, on rows kept back."""
    best: tuple[float, int] = (-np.inf, len(conditions))
    p, n = max(target.sum(), 1), max((~target).sum(), 1)
    for k in range(1, len(conditions) + 1):
        hit = _hits(conditions[:k], x)
        worth = (hit & target).sum() / p - (hit & ~target).sum() / n
        if worth > best[0] + 1e-12:
            best = (worth, k)
    return conditions[: best[1]]


def _split(target: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """True for about a third of each class."""
    back = np.zeros(len(target), bool)
    for value in (False, True):
        at = rng.permutation(np.flatnonzero(target == value))
        back[at[: len(at) // 3]] = True
    return back


def learn(x: np.ndarray, good: np.ndarray, s: Settings = Settings()) -> DecisionList:
    """A decision list that parts good rows from others; without rows of both kinds it keeps everything."""
    if not len(x) or good.all() or not good.any():
        return DecisionList(trained_on=len(x))
    rng = np.random.default_rng(s.seed)
    cover = max(2, int(np.ceil(s.min_share * len(x))))
    n_good, n_bad = good.sum(), (~good).sum()
    cuts = []
    for f in range(x.shape[1]):
        found = [np.quantile(x[side, f], np.linspace(0, 1, s.cuts + 2)[1:-1]) for side in (good, ~good)]
        cuts.append(np.unique(np.concatenate(found)))
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < s.max_rules and (~good[left]).any() and good[left].any():
        lx, lg = x[left], good[left]
        back = _split(lg, rng)
        best: tuple[tuple[float, float], Rule] | None = None
        for verdict in (False, True):
            target = lg == verdict
            grown = _grow(lx[~back], target[~back], cuts, cover, s)
            if not grown:
                continue
            # Pruning on few rows says little, so the whole rule is tried as well.
            for conditions in (_pruned(grown, lx[back], target[back]), grown):
                conditions = _tightest(_widened(conditions, lx))
                hit = _hits(conditions, lx)
                p, n = (hit & target).sum(), (hit & ~target).sum()
                mine, other = (n_good, n_bad) if verdict else (n_bad, n_good)
                balance = (p + 0.5) / mine / ((p + 0.5) / mine + (n + 0.5) / other)
                precise = verdict or (p + 0.5) / (p + n + 1) >= s.min_precision
                if p + n < cover or not precise or balance < s.min_balance:
                    continue
                worth = (p / mine - n / other, balance)
                if best is None or worth > best[0]:
                    best = (worth, Rule(conditions, verdict))
        if best is None:
            break
        rules.append(best[1])
        left[np.flatnonzero(left)[_hits(best[1].conditions, lx)]] = False
    default = bool(good[left].mean() >= 0.5) if left.any() else True
    while rules and rules[-1].verdict == default:
        rules.pop()  # it says what the default says
    return DecisionList(tuple(rules), default, len(x))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DecisionList:
    """Learns from the labelled rows of ``docs`` (doc_id, text) by ``labels`` (doc_id, quality)."""
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), F.col("quality").alias("q"))
    chosen = marked.orderBy(F.xxhash64("id", F.lit(s.seed)), "id", "q").limit(s.sample)
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t")).join(F.broadcast(chosen), "id")
    counted = with_counts(texts, "c_", "t")
    values = ratios("c_")
    rows = counted.where(~base_failed("c_")).select("id", "q", *[values[f].alias(f) for f in FEATURES]).collect()
    rows.sort()
    table = np.array([tuple(r) for r in rows], dtype=float).reshape(len(rows), len(FEATURES) + 2)
    return learn(table[:, 2:], table[:, 1] == 1, s)


def base_failed(prefix: str) -> Column:
    """Fewer than 50 words, or more than half of the words in repeated windows."""
    return (F.col(prefix + "n_words") < 50) | (100 * F.col(prefix + "n_repeat_words") > 50 * F.col(prefix + "n_words"))


def judged(docs: DataFrame, model: DecisionList) -> tuple[DataFrame, str]:
    """``docs`` with all counts, base_failed and kept, and the prefix of their names.

    kept: not base_failed, and the list's verdict.
    """
    prefix = free_prefix(docs, "dl_")
    counted = with_counts(docs, prefix)
    failed = base_failed(prefix)
    out = counted.withColumns({prefix + "base_failed": failed, prefix + "kept": ~failed & model.column(ratios(prefix))})
    return out, prefix


def quality_query(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    model = fit(docs, labels, s)
    out, p = judged(docs.select("doc_id", "text"), model)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select("doc_id", *[F.col(p + n).alias(n) for n in names])


def kept_documents(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the same columns."""
    out, p = judged(docs, fit(docs, labels, s))
    return out.where(F.col(p + "kept")).select(*docs.columns)


__all__ = ["COUNTS", "Condition", "DecisionList", "Rule", "Settings", "fit", "judged", "kept_documents", "learn", "quality_query"]

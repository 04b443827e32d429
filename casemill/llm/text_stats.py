"""Statistics of a text as native column expressions.

All counts are of code points or words of the whole text.  Null text counts as
empty; every count is then 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Names of the counts that :func:`with_counts` adds, after its prefix.
COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_bangs",
)


def _covered(places: Column) -> Column:
    """How many words the 3-word windows at the sorted ``places`` cover together."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
    return F.aggregate(places, start, step, lambda acc: acc["n"])


def with_counts(docs: DataFrame, prefix: str, text: str = "text") -> DataFrame:
    """Adds ``prefix + name`` for each name of ``COUNTS``; other columns stay.

    n_words, word_chars (code points in words), n_symbols (of ``SYMBOLS``),
    n_dup_lines (lines with a word, equal to an earlier line), n_repeat_words
    (words inside a 3-word window that occurs twice or more), n_lines (lines
    with a word), n_upper (A-Z), n_bangs (exclamation marks).

    Windows are compared as 64-bit hashes.  Each array is a column of its own, so that none is
    computed twice; nothing is shuffled.
    """
    col = lambda name: F.col(prefix + name)
    raw = F.coalesce(F.col(text), F.lit(""))
    # Spark pushes a filter on a result below projections by writing their expressions into it, over and over; it does
    # not do so with expressions that aren't deterministic, so each count has a condition that always holds but isn't.
    long = lambda c: F.when(F.monotonically_increasing_id() >= 0, c.cast("long"))
    matches = lambda pattern: long(F.regexp_count(raw, F.lit(pattern)))
    upto = lambda c, less: F.greatest(F.size(c) - less, F.lit(0))

    df = docs.withColumns(
        {
            prefix + "words": F.filter(F.split(raw, rf"[{SPACE}]+"), lambda w: w != ""),
            prefix + "lines": F.filter(F.split(raw, "\n"), lambda x: x.rlike(rf"[^{SPACE}]")),
        }
    )
    w = col("words")
    df = df.withColumns(
        {
            prefix + "next": F.slice(w, 2, upto(w, 1)),
            prefix + "third": F.slice(w, 3, upto(w, 2)),
        }
    )
    df = df.withColumn(
        prefix + "windows",
        F.zip_with(
            F.zip_with(F.slice(w, 1, upto(w, 2)), F.slice(col("next"), 1, upto(w, 2)), lambda a, b: F.xxhash64(a, b)),
            col("third"),
            lambda h, c: F.xxhash64(h, c),
        ),
    )
    # One long for each window, ordered by hash and then by place: hash modulo
    # room, times n, plus place.  Neighbours of one hash are compared in full.
    df = df.withColumn(prefix + "n", F.greatest(F.size(col("windows")), F.lit(1)).cast("long"))
    df = df.withColumn(prefix + "room", F.floor(F.lit(1 << 62) / col("n")).cast("long"))
    codes = F.transform(col("windows"), lambda h, i: F.pmod(h, col("room")) * col("n") + i)
    df = df.withColumn(prefix + "ordered", F.sort_array(codes))
    o = col("ordered")
    close = F.zip_with(
        F.slice(o, 1, upto(o, 1)),
        F.slice(o, 2, upto(o, 1)),
        lambda a, b: F.when(b - a < col("n"), F.struct((a % col("n")).cast("int").alias("a"), (b % col("n")).cast("int").alias("b"))),
    )
    same = lambda x: F.get(col("windows"), x["a"]) == F.get(col("windows"), x["b"])
    df = df.withColumn(prefix + "equal", F.filter(F.filter(close, lambda x: x.isNotNull()), same))
    places = F.sort_array(F.array_union(F.transform(col("equal"), lambda x: x["a"]), F.transform(col("equal"), lambda x: x["b"])))
    df = df.withColumns(
        {
            prefix + "n_words": long(F.size(w)),
            prefix + "word_chars": long(F.aggregate(w, F.lit(0), lambda n, x: n + F.length(x))),
            prefix + "n_symbols": matches(r"[#*$%&|<>]"),
            prefix + "n_dup_lines": long(F.size(col("lines")) - F.size(F.array_distinct(col("lines")))),
            prefix + "n_repeat_words": long(_covered(places)),
            prefix + "n_lines": long(F.size(col("lines"))),
            prefix + "n_upper": matches("[A-Z]"),
            prefix + "n_bangs": matches("!"),
        }
    )
    return df.drop(*(prefix + name for name in ("words", "lines", "next", "third", "windows", "n", "room", "ordered", "equal")))

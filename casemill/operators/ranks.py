"""Global ranks and running counts over an ordered column, without a window over everything in one task.

Rows are dealt into ranges of the ordered column, as many as the session shuffles into, and written once; each range is
summed by itself and starts at the sum of the ranges before it.  Only one sum for each range reaches the driver.  Any type
that Spark orders will do, texts too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casemill.session import stored


def _in_ranges(df: DataFrame, value: str, n: str) -> tuple[DataFrame, int]:
    """``df`` with ``_range`` and ``_start``, the sum of ``n`` of all ranges before it; and the sum of all."""
    ranged = stored(df.repartitionByRange(F.col(value)).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = sorted((r["_range"], r["n"]) for r in ranged.groupBy("_range").agg(F.sum(n).alias("n")).collect())
    starts, upto = [], 0
    for number, own in sums:
        starts.append((number, upto))
        upto += own
    return ranged.join(F.broadcast(df.sparkSession.createDataFrame(starts, "_range int, _start long")), "_range"), upto


def running(counts: DataFrame, value: str, n: str, out: str, total: str | None = None) -> DataFrame:
    """Adds ``out``, the sum of ``n`` up to and with each value, and ``total``; values are different and not null."""
    ranged, upto = _in_ranges(counts, value, n)
    ranged = ranged.withColumn(out, F.col("_start") + F.sum(n).over(W.partitionBy("_range").orderBy(value)))
    if total:
        ranged = ranged.withColumn(total, F.lit(upto).cast("long"))
    return ranged.drop("_range", "_start")


def ranked(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds ``out``, the place from 1 of each row by ``value`` (not null); equal values, which one range holds, have places in any order."""
    ranged, _ = _in_ranges(df.withColumn("_one", F.lit(1)), value, "_one")
    return ranged.withColumn(out, F.col("_start") + F.row_number().over(W.partitionBy("_range").orderBy(value))).drop("_range", "_start", "_one")

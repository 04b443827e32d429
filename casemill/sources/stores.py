"""Journal, outbox, drafts, vault: Parquet tables with idempotent appends; labelled corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemill.operators.journal import sequenced, violations


#: Directories that cases are dealt into, so that an append reads those of its own cases only.
BUCKETS = 64
BUCKET = "case_bucket"
#: Rows that are looked at first for the buckets of an append.
FEW = 10_000


def bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")


def _is_there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at ``path``, or no rows if there is no such folder; other errors are raised."""
    return spark.read.schema(like.schema).parquet(path) if _is_there(spark, path) else like.limit(0)


def _of_same_buckets(new: DataFrame, path: str, numbers: list[int] | None = None) -> DataFrame:
    """What is stored in the directories of the new rows' buckets."""
    numbers = numbers or [r[0] for r in new.select(BUCKET).distinct().collect()]
    return read_or_empty(new.sparkSession, path, new).where(F.col(BUCKET).isin(numbers))


def append_missing(new: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key is not there yet, each key once; returns their number.  Safe to repeat.

    Only directories of the new keys' buckets are read.
    """
    rows = new.dropDuplicates([key]).withColumn(BUCKET, bucket(key))
    fresh = rows.join(_of_same_buckets(rows, path).select(key), key, "left_anti").select(*rows.columns)
    n = fresh.count()
    if n:
        fresh.write.mode("append").partitionBy(BUCKET).parquet(path)
    return n


def stored_like(new: DataFrame, path: str, key: str) -> DataFrame | None:
    """What is stored in the directories of the new keys' buckets; None, without a look at the new rows, if there is no such folder.

    Many new rows are in all buckets, which some of them show already.
    """
    if not _is_there(new.sparkSession, path):
        return None
    rows = new.withColumn(BUCKET, bucket(key))
    some = [r[0] for r in rows.select(BUCKET).limit(FEW).distinct().collect()]
    return _of_same_buckets(rows, path, some if len(some) == BUCKETS else None)


def append_counted(rows: DataFrame, path: str, key: str) -> int:
    """Appends rows that are known to lack, each key once; returns their number, which is counted while they are written."""
    seen = Observation()
    rows.withColumn(BUCKET, bucket(key)).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy(BUCKET).parquet(path)
    return seen.get["n"]


def append_events(events: DataFrame, path: str, case: str = "case_id") -> None:
    """Appends to a journal; refuses a result with gaps or repeats in a case's sequence, or repeated event ids.

    Only the cases of the batch are checked, in the directories of their buckets.
    """
    rows = events.withColumn(BUCKET, bucket(case))
    stored = _of_same_buckets(rows, path).join(rows.select(case).distinct(), case, "left_semi")
    wrong = violations(stored.select(*events.columns).unionByName(events), case).limit(1).collect()
    if wrong:
        raise ValueError(f"journal of case {wrong[0][case]!r} would be broken")
    rows.write.mode("append").partitionBy(BUCKET).parquet(path)


def numbered(events: DataFrame, path: str, case: str, *order: str) -> DataFrame:
    """New events with ``sequence`` going on from the stored journal, and ``event_id`` from case and sequence."""
    rows = events.withColumn(BUCKET, bucket(case))
    like = rows.withColumn("sequence", F.lit(0).cast("long"))
    stored = _of_same_buckets(like, path).groupBy(case).agg(F.max("sequence").alias("_last"))
    joined = sequenced(events, case, *order).join(stored, case, "left")
    joined = joined.withColumn("sequence", F.col("sequence") + F.coalesce(F.col("_last") + 1, F.lit(0))).drop("_last")
    return joined.withColumn("event_id", F.substring(F.sha2(F.concat_ws("|", F.col(case).cast("string"), F.col("sequence").cast("string")), 256), 1, 32))


def store_vault(entries: DataFrame, path: str, ref: str = "token") -> None:
    """Write-once: an entry whose reference is stored already, or twice in the batch, is an error and nothing is written."""
    rows = entries.withColumn(BUCKET, bucket(ref))
    twice = rows.groupBy(ref).count().where("count > 1").select(ref)
    there = _of_same_buckets(rows, path).join(rows.select(ref), ref, "left_semi").select(ref)
    wrong = twice.unionByName(there).limit(1).collect()
    if wrong:
        raise ValueError(f"vault reference {wrong[0][ref]!r} is there already")
    rows.write.mode("append").partitionBy(BUCKET).parquet(path)


def labelled(items: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Items with their labels; an item without one, or no items, is an error."""
    joined = items.join(labels, key, "left")
    missing = items.join(labels.select(key), key, "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"no label for {missing[0][key]!r}")
    if items.isEmpty():
        raise ValueError("an empty corpus")
    return joined


def labelled_files(spark: SparkSession, folder: str, label_schema: str, *, item: str = ".txt", sidecar: str = ".labels.json") -> DataFrame:
    """(item_id, text, and the fields of ``label_schema``) of a folder of items, each with a sidecar of labels beside it.

    The id is the file's name without its ending.  Items and sidecars are read and parsed by the executors; an empty folder, an item
    without a sidecar, a sidecar without an item and one that is no JSON object are errors.  Spark does not list empty files, so an
    empty item counts as none.
    """
    name = lambda ending: F.regexp_extract("path", r"([^/]*)" + ending.replace(".", r"\.") + "$", 1)
    files = lambda ending: spark.read.format("binaryFile").option("pathGlobFilter", f"*{ending}").load(folder).select(name(ending).alias("item_id"), F.decode("content", "UTF-8").alias("text"))
    items, labels = files(item), files(sidecar)
    parsed = labels.select(F.col("item_id").alias("_id"), F.from_json("text", label_schema, {"mode": "PERMISSIVE"}).alias("l"), (F.try_parse_json("text").isNull() | ~F.trim("text").startswith("{")).alias("_bad"))
    joined = items.join(parsed, F.col("item_id") == F.col("_id"), "full")
    checks = {"no label for": F.col("_id").isNull(), "no item for": F.col("item_id").isNull(), "a broken label of": F.coalesce(F.col("_bad"), F.lit(False))}
    n, *wrong = joined.agg(F.count("item_id"), *[F.min(F.when(c, F.coalesce("item_id", "_id"))) for c in checks.values()]).first()
    for what, first in zip(checks, wrong, strict=True):
        if first is not None:
            raise ValueError(f"{what} {first!r}")
    if not n:
        raise ValueError("an empty corpus")
    return joined.select("item_id", "text", "l.*")


def _steady(value: Column, kind: T.DataType, volatile: frozenset[str]) -> Column:
    """A value without the volatile names at any depth, with names in order; maps become sorted lists of entries."""
    if isinstance(kind, T.StructType):
        kept = sorted((f for f in kind.fields if f.name not in volatile), key=lambda f: f.name)
        whole = F.struct(*[_steady(value[f.name], f.dataType, volatile).alias(f.name) for f in kept]) if kept else F.struct(F.lit(0).alias("none"))
        return F.when(value.isNotNull(), whole)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _steady(x, kind.elementType, volatile))
    if isinstance(kind, T.MapType):
        kept = F.filter(F.map_entries(value), lambda e: ~e["key"].cast("string").isin(*volatile)) if volatile else F.map_entries(value)
        return F.array_sort(F.transform(kept, lambda e: F.struct(e["key"].cast("string").alias("key"), F.to_json(F.struct(_steady(e["value"], kind.valueType, volatile).alias("v")), {"ignoreNullFields": "false"}).alias("value"))))
    return value


def digest(df: DataFrame, *volatile: str) -> str:
    """One hash of a table's rows without volatile names at any depth, whatever the order of rows and columns.

    The number of rows, and the sums of both halves of each row's 128-bit hash, modulo 2**64: rows that repeat count.
    """
    names = frozenset(volatile)
    row = F.struct(*[_steady(F.col(f"`{f.name}`"), f.dataType, names).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name) if f.name not in names])
    told = F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)
    half = lambda at: F.sum(F.conv(F.substring(told, at, 16), 16, 10).cast("decimal(20,0)"))
    n, low, high = df.agg(F.count("*"), half(1), half(17)).first()
    return f"{n}-{int(low or 0) % 2**64:016x}{int(high or 0) % 2**64:016x}"

"""What the operators share: tables in the shared folder, words, column names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.session import shared_folder

#: White space that separates words, as a character class body for Java regexes.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: Most rows of a table that may be broadcast; larger tables are shuffled.
BROADCAST_ROWS = 20_000

#: Bytes of UTF-8 that stand in words of letters (all of other alphabets among them), A-Z lowered; all others separate words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def letter_words(text: bytes, piece: int) -> Iterator[list[bytes]]:
    """Words of letters of a text in UTF-8, in pieces of some ``piece`` bytes that end between words."""
    plain = text.translate(LETTERS)
    begin = 0
    while begin < len(plain):
        end = plain.find(b" ", begin + piece)
        end = len(plain) if end < 0 else end
        yield plain[begin:end].split()
        begin = end


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/casemill/{name}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch for functions that read whole texts; a Python worker holds a batch as it comes and as strings.
TEXT_BATCH = 1_000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str, batch_rows: int | None = None, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` does, in a columnar form: a lost
    executor costs no recomputation, and later reads prune columns.
    ``batch_rows`` bounds the Arrow batches of the Python functions in this job.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(BATCH_SETTING)
    if batch_rows:
        spark.conf.set(BATCH_SETTING, str(min(batch_rows, int(before)) if int(before) > 0 else batch_rows))
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(BATCH_SETTING, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._casemill_path = path
    return back


def dropped(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that no later read needs."""
    path = getattr(df, "_casemill_path", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count proves it small, else as it is.

    ``df`` should be a written table, as it is counted.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bits of a sieve for each key, and most words of 64 bits in one; it is broadcast.
SIEVE_BITS = 16
SIEVE_WORDS = 1 << 18


def sieved(df: DataFrame, table: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose keys ``table`` may have, and the rows whose keys it has not.

    A Bloom filter of three bits a key, all in one word, so that wide rows which a join would drop or keep as they are
    need no shuffle.  Some rows of other keys are among the first, more of them beyond ``SIEVE_WORDS`` words; so an
    exact join follows.  ``table`` should be a written table, as it is counted.
    """
    n = max(1, min(SIEVE_WORDS, table.count() * SIEVE_BITS // 64))
    hashed = lambda seed: F.xxhash64(*keys, F.lit(seed))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(hashed(1), 6 * i), F.lit(64)).cast("int"))
    mask = bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2))
    word, bits = free_name(df, "sieve_word"), free_name(df, "sieve_bits")
    at = F.pmod(hashed(0), F.lit(n))
    marks = written(table.select(at.alias(word), mask.alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits)), "sieve")
    marked = df.withColumn(word, at).join(F.broadcast(marks), word, "left")
    passes = F.coalesce(F.col(bits).bitwiseAND(mask) == mask, F.lit(False))
    return marked.where(passes).drop(word, bits), marked.where(~passes).drop(word, bits)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def words(text: Column) -> Column:
    """Array of the words of ``text``; empty for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"[{SPACE}]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words; 0 for null.  Splitting is the cheapest count that the JVM offers."""
    edge = lambda c: F.when(c.rlike(rf"^[{SPACE}]"), 1).otherwise(0)
    count = F.size(F.split(text, rf"[{SPACE}]+")) - edge(F.substring(text, 1, 1)) - edge(F.substring(text, -1, 1))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(count).cast("long")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null keys count as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % modulus


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with enough underscores before it that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def free_prefix(df: DataFrame, prefix: str) -> str:
    """``prefix`` with enough underscores before it that no column of ``df`` begins with it."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return prefix

"""Submissions: JSON source, text parts, attachment references, payload digests."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemill.functions.text import is_blank

ATTACHMENT = "struct<id:string,mediaType:string,filename:string,sha256:string,text:string,sourceType:string>"
SCHEMA = (
    "submissionId string, destinationId string, channel string, submittedAt timestamp, procedureHint string, "
    f"data string, bodyText string, bodySourceType string, attachments array<{ATTACHMENT}>"
)
SOURCE_TYPES = ("typed", "email", "ocr")


def read_submissions(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """Submissions with a fixed schema; the payload stays JSON text, unknown keys are dropped."""
    return spark.read.schema(SCHEMA).option("multiLine", multi_line).json(path)


def source_type(declared: Column, channel: Column) -> Column:
    """The declared type if it is known, else "ocr" for scans and "typed" for the rest."""
    return F.coalesce(F.when(declared.isin(*SOURCE_TYPES), declared), F.when(channel == "scan", "ocr").otherwise("typed"))


def part_list() -> Column:
    """array<struct<text, source_type>> of a submission: the body, then attachments, those with text."""
    body = F.array(F.struct(F.col("bodyText").alias("text"), source_type(F.col("bodySourceType"), F.col("channel")).alias("source_type")))
    more = F.transform(F.coalesce("attachments", F.expr(f"cast(array() as array<{ATTACHMENT}>)")), lambda a: F.struct(a["text"].alias("text"), source_type(a["sourceType"], F.col("channel")).alias("source_type")))
    return F.filter(F.concat(body, more), lambda p: ~is_blank(p["text"]))


def text_parts(submissions: DataFrame) -> DataFrame:
    """(submissionId, part_id, ordinal, text, source_type): the body, then attachments with text; numbered as kept."""
    rows = submissions.select("submissionId", F.posexplode(part_list()).alias("ordinal", "p"))
    return rows.select("submissionId", F.concat(F.lit("part-text-"), F.col("ordinal") + 1).alias("part_id"), "ordinal", "p.text", "p.source_type")


def attachment_refs(submissions: DataFrame) -> DataFrame:
    refs = F.transform(
        "attachments",
        lambda a, i: F.struct(
            F.coalesce(a["id"], F.concat(F.col("submissionId"), F.lit("-att-"), i + 1)).alias("ref_id"), F.coalesce(a["mediaType"], F.lit("application/octet-stream")).alias("media_type"), a["sha256"].alias("sha256")
        ),
    )
    return submissions.select("submissionId", F.explode(refs).alias("r")).select("submissionId", "r.*")


@F.pandas_udf(T.StringType())
def canonical_json(payload: pd.Series) -> pd.Series:
    """JSON with sorted keys at every depth; no native function sorts them."""
    return payload.map(lambda x: None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def payload_digest(payload: Column) -> Column:
    return F.sha2(canonical_json(payload), 256)


def received_events(found: DataFrame, now: Column, types: tuple[str, ...] = ("RECEIVED",)) -> DataFrame:
    """A journal's first events of submissions (submissionId, submittedAt): case_id, created_at (or else ``now``), sequence, type, event_id."""
    rows = found.select("submissionId", F.concat(F.lit("case-"), F.col("submissionId")).alias("case_id"), F.coalesce("submittedAt", now).alias("created_at"), F.posexplode(F.array(*[F.lit(t) for t in types])).alias("_i", "type"))
    rows = rows.withColumn("sequence", F.col("_i").cast("long")).drop("_i")
    return rows.withColumn("event_id", F.substring(F.sha2(F.concat_ws("|", "case_id", F.col("sequence").cast("string")), 256), 1, 32))

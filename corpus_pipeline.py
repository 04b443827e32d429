"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, token ids.

Each stage takes all that the stage before kept, as a table, and returns a table;
all but the last return the columns of ``documents``, and further columns of any name
as they are.

Cases, in every stage: an empty table gives no rows; null and repeated ids, null
sources and languages are kept as they are.  Null and empty texts have no words: quality
rules reject them; near-duplicates, secrets and mixing keep each of them once as it is;
token ids gives null or an empty list.  Of rows that repeat, near-duplicates keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casemill.llm import decision_list, mixing, near_duplicates, pieces_codec, secrets
from casemill.llm.queries import model_file
from casemill.llm.shared import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go; without labels only the base rules reject."""
    return decision_list.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, 0.8): the one with the smallest id, null last."""
    return near_duplicates.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and n_chars follows; all documents stay."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it; a null source is a source of its own."""
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return pieces_codec.encoded(docs, model_file(spark))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("secret scan", secret_scan),
    ("mixing sources", mix_sources),
    ("token ids", encode),
]

#: No stage's learned or hashed decisions can be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{i}")
    return docs

"""From raw documents to encoded training texts: five stages, each one's output the next one's input."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillmark.llm import bpe, decontaminate, quality, queries, secrets, simhash
from rillmark.llm.common import MADE, remove, shared_dir, table

_left: list[str] = []  # the folders that the last stage's operator made


def _applied(spark: SparkSession, operator: Callable[..., DataFrame], *args, **more) -> DataFrame:
    """A stage's input has been written, so what the operator of the stage before it made on the way can go."""
    while _left:
        remove(spark, _left.pop())
    before = len(MADE)
    out = operator(*args, **more)
    _left.extend(MADE[before:])
    return out


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return _applied(spark, quality.keep, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with a five-word shingle similarity of about 0.8 or more, the document of the smallest id stays."""
    return _applied(spark, simhash.keep_one, docs, shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return _applied(spark, decontaminate.clean, docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; all documents stay."""
    return _applied(spark, secrets.redact, docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of tokens, and the digests of the ids and of what they decode to."""
    return _applied(spark, bpe.encode, docs, queries.rank_file(), queries.pattern(), output="digests")


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("encoding", encoding),
]

#: No SQL: fingerprints, components and byte-pair merges are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written to the shared folder and read again, and removed once the next one's is there."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove(spark, f"{folder}/{i - 1}")
    while _left:
        remove(spark, _left.pop())
    return docs

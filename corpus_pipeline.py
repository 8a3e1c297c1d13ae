"""A corpus pipeline of five operators: each stage reads what the one before it kept, as Parquet."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.llm.common import remove, table, work_dir
from siltlog.llm.decontaminate import drop_contaminated
from siltlog.llm.dedup import drop_copies
from siltlog.llm.jaccard import drop_similar
from siltlog.llm.language import drop_unidentified
from siltlog.llm.packing import pack


# Each stage takes documents with any further columns, an empty table too, and judges each row by its own text: rows with
# equal ids or null ones are told apart by their texts. Rows that are equal in full stay or go together.


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without letters (null and empty texts too) or with a doubtful language go."""
    return drop_unidentified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space; a null text equals an empty one. Rows with a null id stay."""
    return drop_copies(docs, "doc_id", "text")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies; rows with a null id, and texts without words, stay."""
    return drop_similar(docs, "doc_id", "text")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), "doc_id", "text")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, packed into sequences of 1024; one row per piece. A null or empty text has its end token only."""
    return pack(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json")).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each returns is written to the shared folder and read again, and is removed when the next is written."""
    folder = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs

"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Documents whose language cannot be told go, and where ``lang`` is null it becomes
the language that was told; of equal and of nearly equal documents one of each
group stays; documents with benchmark passages go; what is left is encoded.
Null and empty texts have no letters, so the first stage takes them out; rows
with null or repeated ids count as rows of their own; columns beside those of
``documents`` are carried along; an empty table passes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import byte_bpe, decontaminate, exact_dedup, language_id, near_dedup, shared
from quillspark.llm.queries import BPE_PATH


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.known_languages(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, shared.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_ids(docs, BPE_PATH, byte_bpe.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", encode),
]

#: The language model, stateful dedup and MinHash stages have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    folder = shared.fresh_dir(spark, "pipeline")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = shared.stored(docs, f"{folder}/{at}-{name}")
    return docs

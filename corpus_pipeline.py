"""A corpus pipeline of five stages; each one's rows are written and read again by the next.

1. language ID: documents whose language can't be told go;
2. exact dedup: one document of each group of equal texts stays;
3. near-dedup: one document of each class of texts stays that five-word shingle similarity of 0.8 or more links;
4. mixing: a document comes as often as the mix takes it, 0 to 2 times;
5. BPE encoding and decoding: one row for each document of the mix.

The first four keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellarium.llm import bpe, exact_dedup, language_id, mixing, near_copies
from cellarium.llm.common import documents, written


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.reject(docs, language_id.learn(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The stages before have filled the executors: a third of the tables is room enough.
    return bpe.encode_documents(docs, tables=1 / 3)


STAGES = [
    ("language", identify),
    ("exact", drop_copies),
    ("near", drop_near_copies),
    ("mix", mix_sources),
    ("bpe", tokenize),
]

#: SQL has no compression, no XXH64 and no BPE: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs

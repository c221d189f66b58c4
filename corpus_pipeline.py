"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

A stage takes (spark, docs, sf_dir) and works on all that the one before kept. The stages keep
the columns of documents; the last keeps what the mix takes and adds size, source_size, target,
taken and pieces. Each stage first lets the driver forget the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmesh.llm import decontaminate, jaccard, mixing, pii, toxicity
from quillmesh.llm.common import released, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents scored 0.5 or more go."""
    released(spark)
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each class of copies and near copies the document with the smallest id stays."""
    released(spark)
    return jaccard.first_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that overlap a benchmark item go."""
    released(spark)
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: personal data in the text becomes its kind in brackets."""
    released(spark)
    model = pii.fit(docs)
    released(spark)
    return pii.redact(docs, model)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the mix takes, with each piece of their text and its slot; exploded and sorted by slot, they are the mixed corpus."""
    released(spark)
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("pii", redact_personal_data),
    ("mixing_sources", mix_sources),
]

#: Trained scores decide in the first stage, so SQL can't express the rows; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

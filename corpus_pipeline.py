"""A corpus pipeline of five stages over `documents`: toxic documents go, of near copies one stays, repeated
passages stay once, sources are mixed to their target weights, and what is left is packed into token sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionrec.llm.common import Scratch, read_documents
from sessionrec.llm.jaccard import one_of_each
from sessionrec.llm.mixing import mix_documents
from sessionrec.llm.packing import pack_documents, vocabulary
from sessionrec.llm.repeats import without_repeats
from sessionrec.llm.toxicity import read_labels, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, read_labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing),
    ("packing", packing),
]

#: Fitting, hashing draws and tokenizing can't be said in SQL; tests compare the stages to plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another; the last one's rows. What a stage wrote for itself goes when its rows are written."""
    scratch = Scratch(spark, "pipeline")
    docs = read_documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        with Scratch.owned() as tables:
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        Scratch.clear(spark, tables)
        if k > 0:
            scratch.drop(STAGES[k - 1][0])
    return docs

"""Corpus pipeline: from raw documents to packed training sequences.

Every stage takes documents with null ids, sources or texts, texts without words, very long
texts, repeated rows and further columns, and gives an empty table for an empty one. All but the
last return the columns they get.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.jaccard_join import one_of_each
from verdigris.llm.mixing import mixed_documents
from verdigris.llm.packing import pack
from verdigris.llm.queries import vocabulary
from verdigris.llm.substring_dedup import without_repeats
from verdigris.llm.toxicity import without_toxic
from verdigris.session import materialize


def _measured(docs: DataFrame) -> DataFrame:
    """The length column follows a changed text."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier trained on this folder's labels does not reject.

    Null and empty texts are scored like any other; repeated rows share their fate.
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five-word shingles.

    The smallest id stays, of repeated rows the first of the stored table; texts without words
    link with nothing and all stay.
    """
    return one_of_each(docs, size=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 20-word passages that start earlier in the corpus.

    Earlier is a smaller id (null last), then the order of the stored table. A text that loses
    nothing stays as it is, null stays null, and one that loses every word becomes empty.
    """
    return _measured(without_repeats(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source near its target share: documents come twice, once, in part or not at all.

    Null sources are one source. Texts without words are never taken. Rows come in the order of
    the mix, which packing keeps.
    """
    return _measured(mixed_documents(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of at most 2048 tokens.

    A null or empty text is one closing token; repeated rows are packed each.
    """
    return pack(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeats),
    ("mixing", mix),
    ("packing", packing),
]

ORACLE_SQL = None  # a trained classifier and a tokenizer's ids have no SQL twin


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on what the one before it kept, each result stored before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

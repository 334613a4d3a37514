"""A training corpus from documents: five stages, each over all that the one before it kept.

Defined results, for every stage: an empty table gives an empty table. Ids may be of any type that has an order,
null, or repeated on rows with other texts; rows are judged one by one, and only near-duplicates go for each
other. Texts of any length are read whole. The first four stages return the columns of documents unchanged,
whatever further columns there are and whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aligned_store.llm import decontaminate, langid, packing, quality, simhash
from aligned_store.llm.common import read, scratch
from aligned_store.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts 1; a score at the threshold is one.

    Null and empty texts score as the classifier's bias says. Without labels of both kinds all documents go the
    way of the more frequent kind; without any labels all stay.
    """
    return quality.keep_quality(docs, read(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that is told: those that are null, or have no letter, go."""
    return langid.keep_languages(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies, of those with its smallest id any one.

    Texts without words are copies of each other. A row with a null id stays where its component has no other.
    """
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that occur in test items; those nearly all of such spans go.

    Null and empty texts stay as they are. Rows that are equal are cleaned alike.
    """
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, placed in sequences; a null or empty text is its separator alone.

    Pieces of equal length are interchangeable, so which of them takes which place is not fixed.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("language identification", language_stage),
    ("SimHash near-duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: The stages' classifiers, fingerprints and tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what each returns is written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, "stage-" + "".join(c if c.isalnum() else "-" for c in name.lower()))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

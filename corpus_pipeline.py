"""Corpus pipeline: quality classifier, quality rules, near duplicates, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all the rows that the one before it kept. All but the last return
the columns of documents, whatever further ones there are and whatever their names. Texts are used whole, however long,
and every stage takes an empty table.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import common, fertility, mixing, nbsvm, ngram_join, packing
from lodestack.session import ship


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier accepts; it is trained on the labelled ones among ``docs``.

    Null and empty texts score the model's bias; with labels of one class only, or none, all rows stay. A score of 0 is
    accepted. Repeated rows and rows of null id are judged each.
    """
    ship(spark)
    labels = spark.read.parquet(os.path.join(sf_dir, "labels.parquet"))
    return nbsvm.filter_quality(docs, nbsvm.train(docs, labels))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose tokeniser fertility lies within the bands of their language and length, which come from ``docs``.

    Null and empty texts, and those of fewer than 32 tokens, stay; a null language is one of its own. A measure at the
    edge of its band is within. Repeated rows and rows of null id are judged each.
    """
    ship(spark)
    return fertility.filter_fertility(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id; rows without id or words stay.

    Rows that repeat an id are one document, with the smallest of their texts, and stay or go together.
    """
    ship(spark)
    return ngram_join.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the mix of sources, a null source being one of its own.

    Equal deadlines go to the source of the smaller name. Repeated rows and rows of null id or text come out each.
    """
    ship(spark)
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows, filled in the order of the stored rows: the place in the files is the place in the mix.

    A text without tokens has one row with no window; of equally good fill levels the fullest is taken. Repeated rows and
    rows of null id are packed each.
    """
    ship(spark)
    order = (F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    try:
        docs.select(*order)
    except AnalysisException:  # rows that don't come straight from files are taken in the order of their ids
        order = ()
    return packing.pack_documents(docs, order=order)


STAGES = [("quality classifier", quality_classifier), ("quality rules", quality_rules), ("near duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

#: Trained models, tokenisers and greedy placement have no equivalent in SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next.

    When a stage is written, the tables that led to it are deleted.
    """
    docs, before = spark.read.parquet(os.path.join(sf_dir, "documents.parquet")), set(common.made())
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialize(docs)
            common.sweep(spark, [p for p in common.made()[:-1] if p not in before])
    return docs

"""From raw documents to token ids: five stages, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import langid, mixing, neardup, sentencepiece, toxicity
from tideline.llm.common import kept
from tideline.llm.queries import piece_model

#: Similarity of shingle sets, in percent, from which documents are near duplicates.
NEAR = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic, by a model of the labelled ones. Without labels all stay.

    Null and empty texts stay, repeated rows are judged alike, an empty table stays empty.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus names. Null texts and texts without a letter go.

    Repeated rows are judged alike; an empty table stays empty, and where no row names a language all rows go.
    """
    return langid.in_known_language(docs, langid.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id.

    Texts without words and rows without an id are linked with nothing and stay; of rows that repeat an id the
    least one stays. An empty table stays empty.
    """
    return neardup.one_of_each_group(docs, NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix by source weights takes them: none, once, twice or three times.

    A null source is a source of its own, the last one; null and empty texts add no words. Rows of one id and
    size are taken alike. An empty table stays empty.
    """
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` of every row that is left; a null text is an empty one, with no ids.

    Rows that repeat give rows that repeat; an empty table gives an empty one.
    """
    return sentencepiece.encoded(docs, piece_model()).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids"
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", keep_known_language),
    ("near_duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode),
]

#: SQL cannot express the classifiers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

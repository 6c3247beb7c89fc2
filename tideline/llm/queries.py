"""Registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import bytebpe, forest, langid, licenses, lm, mixing, neardup, ranked, sentencepiece, topk, toxicity, urlfilter, whitening
from tideline.llm.common import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> bytes:
    import public_tokenizers

    return sentencepiece.load(public_tokenizers.path("piece_bpe_32k.model"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.digests(_table(spark, sf_dir, "documents"), piece_model())


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted"
    )


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.grouped(_table(spark, sf_dir, "documents"), percent=85)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identified(docs, langid.fit(docs)).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score"
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(_table(spark, sf_dir, "documents"))


def op9_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urlfilter.judged(_table(spark, sf_dir, "pages"), urlfilter.RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


def byte_model() -> bytes:
    import public_tokenizers

    return bytebpe.load(public_tokenizers.path("byte_bpe_50k.json"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.digests(_table(spark, sf_dir, "documents"), byte_model())


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"), components=16)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: call for name, call in globals().items() if name.startswith("op") and callable(call)}

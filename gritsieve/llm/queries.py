"""The registered queries of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gritsieve.llm import decontam, langid, lm, media, mixing, neardup, quality, secrets, toxicity, warc
from gritsieve.llm.common import held_out, table
from gritsieve.llm.oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", held_out(5).alias("held_out"), "score", "predicted")


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.store(table(spark, sf_dir, "documents")))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.filter(~held_out(5)))
    return langid.identify(docs, model).select("doc_id", held_out(5).alias("held_out"), "lang_pred", "score")


def op7_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.report(pages, warc.worn(pages))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(docs, held_out(10))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out(5).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_mix, op2_quality, op3_decontam, op4_near_duplicates, op5_media, op6_language, op7_fixity, op8_lm, op9_secrets, op10_toxicity)}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}

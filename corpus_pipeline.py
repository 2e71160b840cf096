"""Cleaning and mixing of a corpus in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before has kept.
``run`` writes each stage's rows as Parquet into the shared folder and reads them again,
so that a lost executor costs at most the stage that runs; the folder is deleted when the
process ends.

1. language ID: texts without a letter or without a clear language go.
2. MinHash near-dedup: of each class of near copies the one with the least id stays.
3. benchmark decontamination: documents that hold a test item go.
4. secret scans: found secrets are masked; no document goes.
5. mixing to target weights: how many words the mix takes of each document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gritsieve.llm import decontam, langid, mixing, neardup, secrets
from gritsieve.llm.common import held_out, shared_dir, table
from gritsieve.plans.storage import forget


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.identified(docs, langid.learn(docs.filter(~held_out(5))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scan),
    ("mix_to_weights", mix),
]

#: SQL has no trained language model, no alignment and no keyed permutation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, top = table(spark, sf_dir, "documents"), forget(spark, f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.mode("overwrite").parquet(f"{top}/{k}-{name}")
        docs = spark.read.parquet(f"{top}/{k}-{name}")
    return docs

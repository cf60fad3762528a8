"""From raw documents to packed training sequences: five stages, each one operator of ``ledgerline.llm``.

A stage gets what its predecessor kept and returns the same columns; the last one returns the pieces of the packed sequences.
Repeated rows, NULL ids, NULL or empty texts and further columns pass through as the operators define it: a text without words is
judged by the classifiers like any other, never taken for a copy, and packed as an end token alone.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import minhash, packing, pii, quality, toxicity
from ledgerline.llm.common import prepare, stage, table

#: Key of the pseudonyms; a real run passes a secret of its own in this setting of the session.
PII_KEY_SETTING, PII_KEY = "spark.ledgerline.pii.key", "check"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxic-span field rejects go."""
    prepare(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_text(model, F.col("text")) < 0.5)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    prepare(spark)
    model = quality.fit(quality.with_statistics(docs), table(spark, sf_dir, "labels"))
    return docs.filter(quality.score_text(model, F.col("text")) >= 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    prepare(spark)
    return minhash.one_of_each_group(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data get format-preserving pseudonyms."""
    prepare(spark)
    return pii.with_pseudonyms(docs, spark.conf.get(PII_KEY_SETTING, PII_KEY))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences under the sources' mixture."""
    prepare(spark)
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_copies", drop_near_copies), ("pii", pseudonymise), ("packing", pack)]

#: Trained scores, signatures and tokenisers are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written once and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs

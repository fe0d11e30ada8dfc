"""The corpus pipeline: documents in, a mix of clean, distinct, pseudonymised documents out.

Each stage works on all that its predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlint.llm import decontaminate, mixing, near_duplicates, pii, toxicity
from ledgerlint.llm.common import stored, table

TOXIC = 0.3
PSEUDONYM_KEY = "registered pipeline"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score, learned from the labels of documents that are not held out, is below 0.3."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, name="__toxicity").where(F.col("__toxicity") < TOXIC).drop("__toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return near_duplicates.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and secrets replaced by pseudonyms of the same format."""
    return pii.pseudonymise(docs, PSEUDONYM_KEY, found=None).withColumn("n_chars", F.length("text").cast(
        docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document with the words that the mix takes of it and the output shards that hold them."""
    return mixing.report(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pseudonyms", pseudonymise),
    ("mixing", mix_sources),
]

#: Scores, sketches and keyed permutations have no form in SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all stages but the last leave of the documents, stored."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STAGES[-1][1](spark, prepared(spark, sf_dir), sf_dir)


def write_mix(docs: DataFrame, path: str) -> DataFrame:
    """The mix itself as files: a folder per shard, its pieces in shuffled order; returns what the report says of them."""
    pieces = mixing.mix(docs)
    pieces.repartition("shard").sortWithinPartitions("shard", "shuffle_key").write.partitionBy("shard").parquet(path)
    return mixing.report(docs)


def run_to_files(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """The whole pipeline: documents in, shards of mixed text below ``path`` out."""
    return write_mix(prepared(spark, sf_dir), path)

"""The corpus pipeline: five stages over ``documents``, each working on all that the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame.  All but the last return the columns of documents; the last returns
the mixture: doc_id, domain, lang, source, n_tokens, n_copies.

Rows that share a doc_id stay or go together.  Rows with null doc_id are never
near duplicates.  A document all of whose words are repeats of earlier ones has
nothing left after the third stage and is dropped there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontamination, jaccard_join, mixing, quality_classifier, substring_dedup
from graphloom.llm.components import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    name = "_quality_score"
    while name in docs.columns:
        name += "_"
    scored = quality_classifier.score(docs, quality_classifier.trained(spark, sf_dir), name)
    return scored.where(F.col(name) >= quality_classifier.THRESHOLD).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each class of near duplicates (five words, similarity 0.8)."""
    later = jaccard_join.classes(docs).where("component_id <> doc_id").select("doc_id")
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words of windows that an earlier document has; n_chars follows the text."""
    return substring_dedup.without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_inside=True)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The chosen documents and how often each is taken."""
    return mixing.mix(docs, mixing.domain_of_source(F.col("source")), mixing.WEIGHTS)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources to target weights", mixture),
]
ORACLE_SQL = None  # the trained network can't be said in SQL; tests/llm holds run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each keeps is written as Parquet in the shared folder and read again, and deleted when the next stage is written. The last stage's table stays, as the result reads it."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}.parquet")
        docs = spark.read.parquet(f"{folder}/{i}.parquet")
        if i:
            _delete(spark, f"{folder}/{i - 1}.parquet")
    return docs


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

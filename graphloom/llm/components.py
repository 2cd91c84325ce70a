"""Connected components by least label, and tables kept between steps."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SALTS = 32


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; one of our own only in a session of one machine that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or (Path(tempfile.gettempdir()) / "graphloom-checkpoints").as_uri()


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def components(links: DataFrame) -> DataFrame:
    """doc_id, component_id (the least id reachable) of every end of links (a, b).

    Each round every node takes the least label of itself and its neighbours,
    then the label of that label.  Sums by key combine before they are shuffled,
    so a node with very many links is no burden for one task.
    """
    both = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = saved(both.groupBy(F.col("a").alias("doc_id")).agg(F.min("b").alias("m")).select("doc_id", F.least("doc_id", "m").alias("component_id")))
    while True:
        near = both.join(labels.select(F.col("doc_id").alias("b"), F.col("component_id").alias("c")), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("c").alias("c"))
        step = labels.join(near, "doc_id").select("doc_id", F.col("component_id").alias("old"), F.least("component_id", "c").alias("new"))
        step = saved(step)
        # the labels of labels; a label that very many nodes have is met by their salts, in several tasks
        jump = step.where("new < doc_id").select(F.col("doc_id").alias("new"), F.col("new").alias("further")).join(step.select("new").distinct(), "new", "left_semi")
        jump = jump.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        after = saved(step.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(jump, ["new", "salt"], "left").select("doc_id", "old", F.coalesce("further", "new").alias("component_id")))
        labels = after.select("doc_id", "component_id")
        if after.where("old <> component_id").isEmpty():
            return labels

"""A change feed over files: listings arrive as a stream, the registry follows batch by batch."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.incremental import changeset

SNAPSHOT = 16
LISTING = "path string, size long, mtime long, hash string"


class Registry:
    """The registry below a folder: what each batch listed (v<n>), and the whole of it every SNAPSHOT batches (s<n>).

    A batch writes under its own number, so it can run twice.  Versions are those
    that were written to the end; errors of reading them are not taken for absence.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self, letter: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        done = lambda n: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))
        return sorted(int(n[1:]) for n in names if n[0] == letter and n[1:].isdigit() and done(n))

    def read(self, before: int) -> DataFrame:
        """The registry as the batches below ``before`` left it: of each path what was listed last."""
        whole = [v for v in self.versions("s") if v < before][-1:]
        parts = [f"{self.folder}/s{v}" for v in whole] + [f"{self.folder}/v{v}" for v in self.versions("v") if v < before and v > max(whole, default=-1)]
        if not parts:
            return self.spark.createDataFrame([], LISTING)
        rows = [self.spark.read.schema(LISTING).parquet(p).withColumn("at", F.lit(i)) for i, p in enumerate(parts)]
        return reduce(DataFrame.unionByName, rows).groupBy("path").agg(F.max_by(F.struct("size", "mtime", "hash"), "at").alias("x")).select("path", "x.*")

    def write(self, df: DataFrame, version: int) -> None:
        """Takes in what a batch listed, and drops the versions that no batch reads any more."""
        df.write.mode("overwrite").parquet(f"{self.folder}/v{version}")
        if version % SNAPSHOT == SNAPSHOT - 1:
            self.read(version + 1).write.mode("overwrite").parquet(f"{self.folder}/s{version}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path
            fs = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
            for old in [f"{x}{v}" for x in "vs" for v in self.versions(x) if v < version - SNAPSHOT]:
                fs.delete(path(f"{self.folder}/{old}"), True)


def apply_batch(registry: Registry, batch: DataFrame, number: int) -> DataFrame:
    """Changes of one batch of listed files; files that it doesn't list stay. The registry takes the batch in."""
    latest = batch.groupBy("path").agg(F.max_by(F.struct("size", "mtime", "hash"), F.struct("mtime", "size", "hash")).alias("x")).select("path", "x.*")
    known = registry.read(number)
    changes = changeset(latest, known).where("change not in ('deleted', 'unchanged')")
    registry.write(latest, number)
    return changes


def watch(spark: SparkSession, listings: str, registry: str, checkpoint: str, sink: Callable[[DataFrame, int], None], every: str = "1 second") -> StreamingQuery:
    """Runs sink(changes, batch number) on each batch of JSON listings that appears below a folder."""
    store = Registry(spark, registry)
    stream = spark.readStream.schema(LISTING).json(listings)
    return stream.writeStream.foreachBatch(lambda df, n: sink(apply_batch(store, df, n), n)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour", key: str = "event_type", value: str = "value", time: str = "ts") -> DataFrame:
    """key, start, end, n, total of events by tumbling (or, with slide, sliding) event-time windows; a stream drops what is later than ``late``. Beyond the reference."""
    kind = events.schema[time].dataType
    events = _watermarked(events, time, late)
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(key, F.col("w.start").cast(kind).alias("start"), F.col("w.end").cast(kind).alias("end"), "n", "total")


def _watermarked(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with a watermark, which takes times with a zone only."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def sessions(events: DataFrame, gap: str, late: str = "1 hour", key: str = "user_id", time: str = "ts") -> DataFrame:
    """key, start, end, n of sessions: events of a key that are less than ``gap`` apart. Beyond the reference."""
    kind = events.schema[time].dataType
    events = _watermarked(events, time, late)
    return events.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").cast(kind).alias("start"), F.col("w.end").cast(kind).alias("end"), "n")

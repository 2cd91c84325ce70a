"""Sessions and shipping of the package's code."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def local(cpus: int = 8, **conf: str) -> SparkSession:
    """A session for one machine."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("graphloom")
    base = {"spark.sql.shuffle.partitions": str(max(8, cpus)), "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this file system import the package, wherever the session was started."""
    here = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (here, env.get("PYTHONPATH", "")) if x)
    return spark

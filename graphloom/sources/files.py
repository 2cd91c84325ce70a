"""A file tree as a table."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ignored(path: Column, patterns: Iterable[str]) -> Column:
    """Whether patterns of an ignore file leave a relative path out; later patterns win, ! takes back."""
    out = F.lit(False)
    for p in patterns:
        p = p.strip()
        if not p or p.startswith("#"):
            continue
        back, p = p.startswith("!"), p.lstrip("!")
        rooted, p = "/" in p.rstrip("/"), p.strip("/")
        body = re.escape(p).replace(r"\*\*/", "(.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        hit = F.rlike(path, F.lit(("^" if rooted else "(^|/)") + body + "(/|$)"))
        out = (out & ~hit) if back else (out | hit)
    return out


def file_tree(spark: SparkSession, folder: str, ignore: Iterable[str] = ()) -> DataFrame:
    """path, name, extension, size, mtime, hash, line_count of the files below a folder that no pattern leaves out; paths are relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    base = re.escape(re.sub(r"^[a-z]+:/*|/+$", "", folder).lstrip("/"))
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", ""), f"^{base}/", "")
    kept = files.withColumn("path", path).where(~ignored(F.col("path"), ignore))
    text = F.decode("content", "ISO-8859-1")
    lines = F.when(F.col("length") == 0, 0).otherwise(F.regexp_count(text, F.lit("\n")) + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1))
    name = F.element_at(F.split("path", "/"), -1)
    return kept.select("path", name.alias("name"), F.regexp_extract(name, r"\.([^.]+)$", 1).alias("extension"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), F.sha2("content", 256).alias("hash"), lines.cast("long").alias("line_count"))

"""Change detection between a listing and a registry, and differences between symbol snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changeset(listing: DataFrame, registry: DataFrame, under: str | None = None) -> DataFrame:
    """path, change of files (path, size, mtime, hash).

    Same size and time: unchanged; other size: modified; same size, other time: the
    hash decides (touched if equal); not registered: added; not listed: deleted
    (with ``under`` only below that path).
    """
    a, b = listing.select("path", *[F.col(c).alias(f"a_{c}") for c in ("size", "mtime", "hash")]), registry.select("path", *[F.col(c).alias(f"b_{c}") for c in ("size", "mtime", "hash")])
    both = a.join(b, "path", "full")
    change = (
        F.when(F.col("b_size").isNull(), "added")
        .when(F.col("a_size").isNull(), "deleted")
        .when(F.col("a_size") != F.col("b_size"), "modified")
        .when(F.col("a_mtime") == F.col("b_mtime"), "unchanged")
        .when(F.col("a_hash") == F.col("b_hash"), "touched")
        .otherwise("modified")
    )
    out = both.select("path", change.alias("change"))
    return out if under is None else out.where((F.col("change") != "deleted") | F.startswith("path", F.lit(under)))


def semantic_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, change, calls_added, calls_removed of symbols (id, line, signature, body, calls)."""
    pick = lambda df, p: df.select("id", *[F.col(c).alias(f"{p}_{c}") for c in ("line", "signature", "body", "calls")])
    both = pick(old, "a").join(pick(new, "b"), "id", "full")
    none = F.array().cast("array<string>")
    change = (
        F.when(F.col("a_signature").isNull(), "added")
        .when(F.col("b_signature").isNull(), "removed")
        .when(F.col("a_signature") != F.col("b_signature"), "signature")
        .when(F.col("a_body") != F.col("b_body"), "logic")
        .when(F.col("a_line") != F.col("b_line"), "shifted")
        .otherwise("same")
    )
    a, b = F.coalesce("a_calls", none), F.coalesce("b_calls", none)
    return both.select("id", change.alias("change"), F.sort_array(F.array_except(b, a)).alias("calls_added"), F.sort_array(F.array_except(a, b)).alias("calls_removed"))


def diff_hunks(diff: DataFrame) -> DataFrame:
    """file, start, end of the new side of each hunk of unified diffs (diff_id, text)."""
    lines = diff.select("diff_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    from pyspark.sql import Window

    w = Window.partitionBy("diff_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    file = F.last(F.when(F.col("line").startswith("+++ b/"), F.substr("line", F.lit(7))), ignorenulls=True).over(w)
    at = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    start = F.regexp_extract("line", at, 1).try_cast("int")
    n = F.coalesce(F.nullif(F.regexp_extract("line", at, 2), F.lit("")).cast("int"), F.lit(1))
    return lines.withColumn("file", file).where(F.col("line").startswith("@@")).select("diff_id", "file", start.alias("start"), (start + F.greatest(n - 1, F.lit(0))).alias("end"))


def touched_symbols(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbols (id, file, line, end_line) that a hunk overlaps: joined by file, compared by range."""
    return symbols.join(hunks.select("file", "start", "end"), "file").where("line <= end and end_line >= start").select(*symbols.columns).distinct()


def snippets(sources: DataFrame, ranges: DataFrame) -> DataFrame:
    """path, start, end, text: 1-based lines start to end of sources (path, text)."""
    cut = F.split("text", "\n")
    return ranges.join(sources, "path").select("path", "start", "end", F.array_join(F.slice(cut, F.greatest("start", F.lit(1)), F.greatest(F.least("end", F.size(cut)) - F.greatest("start", F.lit(1)) + 1, F.lit(0))), "\n").alias("text"))


def reindexed(nodes: DataFrame, edges: DataFrame, touched: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after some files (file) were read anew: their nodes (id, file) and the edges (src, dst) that start at these give way to the new ones; edges to nodes that are gone go, too."""
    kept = nodes.join(touched.select("file").distinct(), "file", "left_anti").select(*nodes.columns)
    out = kept.unionByName(new_nodes.join(kept.select("id"), "id", "left_anti").select(*nodes.columns))
    old = edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").select(*edges.columns)
    both = old.unionByName(new_edges.select(*edges.columns)).distinct()
    ids = out.select("id").distinct()
    return out, both.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi").select(*edges.columns)

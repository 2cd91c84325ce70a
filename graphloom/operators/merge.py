"""Writing graphs: upserts, merged relationships, prefix deletes, canonical ids, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SITES = 200


def upsert_nodes(old: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """old with new (id, kind, properties, and an order column) put in its place by id; of equal ids the first of new stays."""
    first = new.groupBy("id").agg(F.min_by(F.struct("kind", "properties"), order).alias("x")).select("id", "x.kind", "x.properties")
    return old.join(first.select("id"), "id", "left_anti").select("id", "kind", "properties").unionByName(first)


def merge_edges(sightings: DataFrame, nodes: DataFrame | None = None, most: int = SITES) -> DataFrame:
    """One row for each (from_id, to_id, kind) of sightings (and file, line, col, in_loop, loop_depth, operation).

    Distinct call sites are counted, at most ``most`` of them are listed in order
    (the count stays whole), flags are ORed, depths take the largest, operations
    become a sorted list.  With nodes (id), edges without both ends are left out.
    """
    if nodes is not None:
        ids = nodes.select("id").distinct()
        sightings = sightings.join(ids.toDF("from_id"), "from_id", "left_semi").join(ids.toDF("to_id"), "to_id", "left_semi")
    keys = ["from_id", "to_id", "kind"]
    sites = sightings.groupBy(*keys, "file", "line", "col").agg(F.max("in_loop").alias("in_loop"), F.max("loop_depth").alias("loop_depth"), F.collect_set("operation").alias("ops"))
    # per site first, so that repeated sightings never gather in one row; only the first sites of a relationship are gathered
    whole = sites.groupBy(*keys).agg(F.count("*").alias("call_count"), F.max("in_loop").alias("in_loop"), F.max("loop_depth").alias("loop_depth"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ops")))), ",").alias("operation"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("file", "line", "col"))
    listed = sites.select(*keys, "file", "line", "col").withColumn("r", rank).where(F.col("r") <= most).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("file", "line", "col"))).alias("call_sites"))
    return whole.join(listed, keys).select(*keys, "call_count", "call_sites", "in_loop", "loop_depth", "operation", (F.col("call_count") > most).alias("truncated"))


def delete_below(nodes: DataFrame, edges: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without nodes whose id starts with prefix and their edges."""
    kept = nodes.where(~F.startswith("id", F.lit(prefix)))
    ids = kept.select("id")
    return kept, edges.join(ids.toDF("from_id"), "from_id", "left_semi").join(ids.toDF("to_id"), "to_id", "left_semi")


def remap(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """edges with ends replaced by mapping (id, canonical); loops that this makes and repeats go."""
    a, b = mapping.toDF("from_id", "a"), mapping.toDF("to_id", "b")
    out = edges.join(a, "from_id", "left").join(b, "to_id", "left").select(F.coalesce("a", "from_id").alias("from_id"), F.coalesce("b", "to_id").alias("to_id"), "kind")
    return out.where("from_id <> to_id").distinct()


def canonical_database(technology: Column, schema: Column, name: Column) -> Column:
    """Technology.schema: an explicit schema, else the last part of a dotted name, else the name without a database suffix."""
    tail = F.element_at(F.split(name, r"\."), -1)
    plain = F.regexp_replace(F.lower(tail), r"[-_ ]?(db|database)$", "")
    return F.concat(F.coalesce(technology, F.lit("Unknown")), F.lit("."), F.coalesce(F.nullif(F.lower(schema), F.lit("")), F.nullif(plain, F.lit("")), F.lower(tail)))


def longest_prefix(items: DataFrame, owners: DataFrame, path: str = "path", separator: str = "/") -> DataFrame:
    """items with the owner (owner, prefix) whose prefix is the longest whole-segment one of path; null if there is none.

    Paths are cut into their own prefixes and joined by equality, never item by owner.
    """
    cut = F.split(F.col(path), separator)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(cut)), lambda n: F.array_join(F.slice(cut, 1, n), separator))
    each = items.select(path).distinct().withColumn("prefix", F.explode(prefixes))
    best = each.join(owners.select("owner", "prefix"), "prefix").groupBy(path).agg(F.max_by("owner", F.struct(F.length("prefix"), "owner")).alias("owner"))
    return items.join(best, path, "left")

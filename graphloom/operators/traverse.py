"""Walking graphs: simple paths, shortest paths, reachability, components, tiers.

Edges are frames of src and dst.  Walks are loops over frontiers; the seed frame
should be filtered before, as no optimizer pushes filters into a loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.iterate import settled

SETTLE_EVERY = 4


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Edges to be followed from src to dst. direction: out, in, both (a loop once)."""
    if direction == "out":
        return edges
    others = [c for c in edges.columns if c not in ("src", "dst")]
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *others)
    return back if direction == "in" else edges.unionByName(back.where("src <> dst"))


def simple_paths(seeds: DataFrame, edges: DataFrame, lo: int, hi: int | None, direction: str = "out", shortest: bool = False, cap: int | None = None, via: str | None = None) -> DataFrame:
    """start, end, depth, path (nids) of every walk of lo to hi edges from seeds (start) that enters no node twice.

    As the start is not checked at depth 1, a loop is a path of its own.  shortest:
    only the paths of least depth between their ends, with all ties.  hi None: as
    far as there are paths.  cap: at most so many rows a level, the least by path.
    via: a column of edges, gathered along each path in an array of that name.
    """
    step = oriented(edges.select("src", "dst", *([via] if via else [])), direction)
    front = seeds.select("start", F.col("start").alias("end"), F.array("start").alias("path"))
    if via:
        front = front.withColumn(via, F.array().cast(T.ArrayType(edges.schema[via].dataType)))
    levels = [front.withColumn("depth", F.lit(0))] if lo == 0 else []
    seen = front.select("start", "end") if shortest else None
    depth = 0
    while hi is None or depth < hi:
        depth += 1
        here = front.join(step.withColumnRenamed(via, "_via") if via else step, F.col("end") == F.col("src"))
        # the seed itself only bars later steps
        free = F.lit(True) if depth == 1 else ~F.array_contains("path", F.col("dst"))
        front = here.where(free).select("start", F.col("dst").alias("end"), F.concat("path", F.array("dst")).alias("path"), *([F.concat(via, F.array("_via")).alias(via)] if via else []))
        if shortest:
            front = front.join(seen, ["start", "end"], "left_anti")
        if cap:
            front = front.orderBy("path").limit(cap)
        if hi is None or (depth % SETTLE_EVERY == 0 and depth < hi) or (shortest and depth < hi):
            front = settled(front)
            if front.isEmpty():
                break
        if shortest:
            seen = seen.unionByName(front.select("start", "end").distinct())
        if depth >= lo:
            levels.append(front.withColumn("depth", F.lit(depth)))
    if not levels:
        return front.where("false").withColumn("depth", F.lit(0))
    return reduce(DataFrame.unionByName, levels)


def reachable(seeds: DataFrame, edges: DataFrame, most: int | None = None, direction: str = "out") -> DataFrame:
    """start, node, depth: the least number of edges (1 to most) from each seed (start) to each node."""
    step = oriented(edges.select("src", "dst"), direction).distinct()
    front = seeds.select("start", F.col("start").alias("node")).distinct()
    found, depth = None, 0
    while most is None or depth < most:
        depth += 1
        nxt = front.join(step, front["node"] == step["src"]).select("start", F.col("dst").alias("node")).distinct()
        if found is not None:
            nxt = nxt.join(found, ["start", "node"], "left_anti")
        nxt = settled(nxt.withColumn("depth", F.lit(depth)))
        if nxt.isEmpty():
            break
        found = nxt if found is None else found.unionByName(nxt)
        front = nxt.select("start", "node")
    return found if found is not None else front.where("false").withColumn("depth", F.lit(0))


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node that can be reached regardless of direction."""
    both = settled(oriented(edges.select("src", "dst"), "both").distinct())
    labels = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component"))
    labels = settled(labels)
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), F.col("component").alias("c")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("c").alias("c"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("new"))
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("further"))
        after = settled(step.join(jump, "new", "left").select("node", "old", F.coalesce("further", "new").alias("component")))
        labels = after.select("node", "component")
        if after.where("old <> component").isEmpty():
            return labels


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component, size of every node on an edge; component is the least node of it.

    Forward-backward colouring: the least node that can reach a node colours it;
    nodes that reach their colour's root backwards within the colour form its
    component.  Rounds go on with the rest.
    """
    edges = settled(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    done, left = None, edges.where("src <> dst")
    while True:
        # nodes without edges in or out are components of their own
        while True:
            keep = settled(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            if keep.count() == left.count():
                break
            left = keep
        if left.isEmpty():
            break
        colour = settled(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().withColumn("colour", F.col("node")))
        while True:
            into = left.join(colour.toDF("src", "c"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("c"))
            after = settled(colour.join(into, "node", "left").select("node", F.col("colour").alias("old"), F.least("colour", "c").alias("colour")))
            colour = after.select("node", "colour")
            if after.where("old <> colour").isEmpty():
                break
        same = settled(left.join(colour.toDF("src", "a"), "src").join(colour.toDF("dst", "b"), "dst").where("a = b").select("src", "dst", F.col("a").alias("colour")))
        member = front = settled(colour.where("node = colour"))
        while not front.isEmpty():
            front = settled(same.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "colour").distinct().join(member, "node", "left_anti"))
            member = settled(member.unionByName(front))
        done = member if done is None else settled(done.unionByName(member))
        gone = member.select("node")
        left = settled(left.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti"))
    if done is None:
        return nodes.select("node", F.col("node").alias("component"), F.lit(1).cast("long").alias("size"))
    out = nodes.join(done, "node", "left").select("node", F.coalesce("colour", "node").alias("component"))
    return out.withColumn("size", F.count("*").over(Window.partitionBy("component")))


def degrees(edges: DataFrame, apart: bool = False) -> DataFrame:
    """node, n_in, n_out: distinct neighbours, loops left out.

    apart: sources and targets are nodes of two kinds, so an id on both sides is two
    nodes with a row each and there are no loops; null is a node, but no neighbour.
    """
    e = edges.select("src", "dst")
    e = (e if apart else e.where("src <> dst")).distinct()
    out = e.select(F.col("src").alias("node"), F.lit("src").alias("side"), F.col("dst").isNotNull().cast("int").alias("o"), F.lit(0).alias("i"))
    both = out.union(e.select("dst", F.lit("dst"), F.lit(0), F.col("src").isNotNull().cast("int")))
    return both.groupBy("node", *(["side"] if apart else [])).agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out")).select("node", "n_in", "n_out")


def tiers(nodes: DataFrame, edges: DataFrame, ingress: DataFrame, presets: DataFrame | None = None) -> DataFrame:
    """node, tier: 0 ingress, by steps from it 1, 2, 3 and 4 (for four or more); presets (node, tier) come first.

    Nodes that no ingress reaches are 4 without ways out, else 2.
    """
    near = reachable(ingress.select(F.col("node").alias("start")), edges).groupBy("node").agg(F.min("depth").alias("depth"))
    out = nodes.select("node").join(near, "node", "left").join(degrees(edges).select("node", "n_out"), "node", "left").join(ingress.select("node", F.lit(True).alias("root")).distinct(), "node", "left")
    tier = F.when(F.col("root"), 0).when(F.col("depth").isNotNull(), F.least("depth", F.lit(4))).when(F.coalesce("n_out", F.lit(0)) == 0, 4).otherwise(2)
    if presets is None:
        return out.select("node", tier.cast("int").alias("tier"))
    return out.join(presets.select("node", F.col("tier").alias("preset")), "node", "left").select("node", F.coalesce("preset", tier).cast("int").alias("tier"))


def lift(edges: DataFrame, owners: DataFrame, samples: int = 10) -> DataFrame:
    """src, dst, kind, weight, examples: edges (src, dst, kind) between the owners (node, owner) of their ends.

    Edges of nodes without owner and edges inside an owner are left out.
    """
    a, b = owners.select(F.col("node").alias("src"), F.col("owner").alias("a")), owners.select(F.col("node").alias("dst"), F.col("owner").alias("b"))
    up = edges.join(a, "src").join(b, "dst").where("a <> b").select("a", "b", "kind", "src", "dst")
    # least examples: bounded per group on the way
    rank = F.row_number().over(Window.partitionBy("a", "b", "kind").orderBy("src", "dst"))
    some = up.select("a", "b", "kind", "src", "dst").withColumn("r", rank).where(F.col("r") <= samples).groupBy("a", "b", "kind").agg(F.sort_array(F.collect_list(F.struct("src", "dst"))).alias("examples"))
    return up.groupBy("a", "b", "kind").agg(F.count("*").alias("weight")).join(some, ["a", "b", "kind"]).select(F.col("a").alias("src"), F.col("b").alias("dst"), "kind", "weight", "examples")

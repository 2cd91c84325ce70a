"""Operator 6, mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

Leaves are (domain, lang, source).  A token budget is given to the root and
flows down the tree: the children of a node share its budget in proportion to
their weights, but none gets more than it can supply (its tokens times
``max_epochs``); what one child cannot use goes to its siblings, and only what
all of them cannot use is missing at the node itself, whose siblings then take
it.  That is one water level per node, found with sorted running sums.

A leaf with budget b and s tokens gives b div s whole epochs and, from the next
epoch, the prefix that fits in the rest: every epoch orders the leaf's documents
by md5(seed, epoch, doc_id).  The prefix is found step by step, so no task holds
a whole leaf: token sums of 256 slices of the order, then of 256 slices of the one
where the prefix ends, then single documents of the one slice that is left.
Documents meet their leaf's row of the plan by broadcast while the plan is small
(BROADCAST_ROWS, counted), else by leaf and salt.  Texts are read once: what is
known of each document, and the plan, are kept in the shared folder.

Null labels are the label '(none)'; null texts have no tokens, very long ones are
counted like others; rows with null doc_id take part, all at one place of the order; weights that are
null or not positive shut a node out; repeated rows are separate documents of
equal place in the order; columns of other names are ignored; an empty table or
a budget of 0 gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.components import saved

LEVELS = ["domain", "lang", "source"]
SHARE = 0.6
MAX_EPOCHS = 4
SEED = 17
BROADCAST_ROWS = 50_000  # of at most a few hundred bytes each
SALTS = 64


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """budget of each row of nodes (weight, most), from budget_above of its parent."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    up = by.orderBy((F.col("most") / F.col("weight")).asc(), *LEVELS[: len(parent) + 1])
    before = F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("most")
    left = F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.least("budget_above", F.sum("most").over(by)) - before) / left
    return nodes.withColumn("level", level).withColumn("budget", F.least(F.col("most"), F.max("level").over(by) * F.col("weight"))).drop("level", "budget_above")


def budgets(leaves: DataFrame, weights: dict[str, str], total: Column, max_epochs: int) -> DataFrame:
    """domain, lang, source, supply, budget (whole tokens) of leaves (domain, lang, source, supply)."""
    x = leaves.where("supply > 0").withColumn("most", F.col("supply").cast("double") * max_epochs)
    for name in LEVELS:
        x = x.withColumn(f"{name}_weight", F.expr(weights.get(name, "1")).cast("double")).where(F.col(f"{name}_weight") > 0)
    above = x.agg(total.cast("double").alias("budget_above"), F.max("most").alias("_"))
    got = None
    for depth in range(1, len(LEVELS) + 1):
        keys, parent = LEVELS[:depth], LEVELS[: depth - 1]
        nodes = x.groupBy(*keys).agg(F.max(f"{LEVELS[depth - 1]}_weight").alias("weight"), F.sum("most").alias("most"), F.sum("supply").alias("supply"))
        # one row, or one for each node above
        nodes = nodes.join(F.broadcast(above.select("budget_above"))) if got is None else nodes.join(got.select(*parent, F.col("budget").alias("budget_above")), parent)
        got = _share(nodes, parent)
    return got.select(*LEVELS, "supply", F.floor("budget").cast("long").alias("budget"))


def mix(docs: DataFrame, domain: Column, weights: dict[str, str], *, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, n_copies of the chosen documents; the budget is ``share`` of all tokens.

    weights: SQL over domain, lang, source for each level (1 where left out).
    """
    label = lambda c: F.coalesce(c.cast("string"), F.lit("(none)"))
    rows = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), label(domain).alias("domain"), label(F.col("lang")).alias("lang"), label(F.col("source")).alias("source"), count_words(F.col("text")).alias("n_tokens")))
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply"))
    plan = budgets(leaves, weights, F.floor(F.sum("supply") * share), max_epochs).where("budget > 0")
    plan = saved(plan.select(*LEVELS, F.expr("budget div supply").alias("whole"), F.expr("budget % supply").alias("rest")))
    small = plan.count() <= BROADCAST_ROWS
    place = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # the slice of each leaf where its prefix ends: the beginning of its places, and the tokens before it
    ends = plan.withColumn("slice", F.lit("")).withColumn("before", F.lit(0).cast("long"))
    for depth in (2, 4):
        inside = _met(rows, ends, small).withColumn("place", place).where("startswith(place, slice)")
        sums = inside.groupBy(*LEVELS, "whole", "rest", "before", F.substring("place", 1, depth).alias("slice")).agg(F.sum("n_tokens").alias("n"))
        # 256 slices at most
        sums = sums.groupBy(*LEVELS, "whole", "rest", "before").agg(F.sort_array(F.collect_list(F.struct("slice", "n"))).alias("slices"))
        # slices are passed while their tokens still fit
        last = F.aggregate("slices", F.struct(F.lit("").alias("slice"), F.col("before").alias("upto"), F.lit(False).alias("done")), lambda a, x: F.when(a["done"], a).when(a["upto"] + x["n"] > F.col("rest"), F.struct(x["slice"].alias("slice"), a["upto"].alias("upto"), F.lit(True).alias("done"))).otherwise(F.struct(a["slice"].alias("slice"), (a["upto"] + x["n"]).alias("upto"), F.lit(False).alias("done"))))
        ends = saved(sums.select(*LEVELS, "whole", "rest", last.alias("x")).select(*LEVELS, "whole", "rest", F.col("x.slice").alias("slice"), F.col("x.upto").alias("before")))
    placed = _met(rows, ends, small).withColumn("place", place).withColumn("own", F.substring("place", 1, 4))
    apart = placed.where("own <> slice").withColumn("more", F.expr("if(own < slice, 1, 0)"))
    upto = Window.partitionBy(*LEVELS).orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = placed.where("own = slice").withColumn("more", F.when(F.sum("n_tokens").over(upto) + F.col("before") <= F.col("rest"), 1).otherwise(0))
    out = apart.unionByName(edge)
    return out.withColumn("n_copies", (F.col("whole") + F.col("more")).cast("long")).where("n_copies > 0").select("doc_id", *LEVELS, "n_tokens", "n_copies")


def _met(rows: DataFrame, leaves: DataFrame, small: bool) -> DataFrame:
    """rows with the row of leaves (one for each leaf) of their leaf."""
    if small:
        return rows.join(F.broadcast(leaves), LEVELS)
    salted = leaves.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(SALTS)).cast("int")).join(salted, [*LEVELS, "salt"]).drop("salt")


def domain_of_source(source: Column) -> Column:
    """The query's domains: sources by their number, modulo 4."""
    return F.concat(F.lit("d"), (F.try_to_number(F.nullif(F.regexp_extract(source, "[0-9]+$", 0), F.lit("")), F.lit("999999999")) % 4).cast("int").cast("string"))


# weights of the query, as SQL over the labels
WEIGHTS = {
    "domain": "CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END",
    "lang": "CASE WHEN lang = 'en' THEN 4 WHEN lang IN ('de', 'fr') THEN 2 ELSE 1 END",
}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, domain_of_source(F.col("source")), WEIGHTS)


def _level_sql(name: str, keys: str, parent: str, above: str, weight: str) -> str:
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""
{name}0 AS (SELECT {keys}, {weight}::DOUBLE AS weight, sum(supply) * 4.0::DOUBLE AS most, sum(supply) AS supply FROM leaves GROUP BY {keys}),
{name}1 AS (SELECT n.*, budget_above FROM {name}0 n {above}),
{name}2 AS (SELECT *, (least(budget_above, sum(most) OVER ({by})) - (sum(most) OVER ({by} ORDER BY most / weight, {keys} ROWS UNBOUNDED PRECEDING) - most)) / sum(weight) OVER ({by} ORDER BY most / weight, {keys} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM {name}1),
{name} AS (SELECT *, least(most, max(level) OVER ({by}) * weight) AS budget FROM {name}2),"""


ORACLE_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, coalesce('d' || (nullif(regexp_extract(source, '[0-9]+$'), '')::BIGINT % 4), '(none)') AS domain, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS supply FROM docs GROUP BY ALL HAVING sum(n_tokens) > 0),
root AS (SELECT floor(sum(supply) * {SHARE}::DOUBLE) AS budget_above FROM leaves),
{_level_sql("ld", "domain", "", ", root", WEIGHTS["domain"])}
{_level_sql("ll", "domain, lang", "domain", "JOIN (SELECT domain, budget AS budget_above FROM ld) USING (domain)", WEIGHTS["lang"])}
{_level_sql("ls", "domain, lang, source", "domain, lang", "JOIN (SELECT domain, lang, budget AS budget_above FROM ll) USING (domain, lang)", "1")}
plan AS (SELECT domain, lang, source, floor(budget)::BIGINT // supply::BIGINT AS whole, floor(budget)::BIGINT % supply::BIGINT AS rest FROM ls WHERE floor(budget) > 0),
dealt AS (SELECT docs.*, whole, rest, md5('{SEED}-' || whole || '-' || doc_id) AS place FROM docs JOIN plan USING (domain, lang, source)),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM dealt)
SELECT doc_id, domain, lang, source, n_tokens, (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS n_copies FROM run WHERE whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""

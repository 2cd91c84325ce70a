"""The test tables as a property graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.graph import Edges, Graph, Lazy

# fixed values: the high part of a nid by kind
_CODES = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6, "User": 7, "Document": 8, "Page": 9, "Conversation": 10}


def nid(kind: str, key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.lit(_CODES[kind] << 48) + key.cast("long")


def graph_from_tables(spark: SparkSession, sf_dir: str) -> Graph:
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")
    t = Lazy({n: lambda n=n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})

    def nodes(df: DataFrame, kind: str, key: str, *props: str) -> DataFrame:
        return df.select(nid(kind, key).alias("nid"), F.concat(F.lit(kind.lower() + ":"), F.col(key).cast("string")).alias("id"), *props)

    n = {
        "Region": lambda: nodes(t["region"], "Region", "r_regionkey", "r_regionkey", "r_name"),
        "Nation": lambda: nodes(t["nation"], "Nation", "n_nationkey", "n_nationkey", "n_name"),
        "Customer": lambda: nodes(t["customer"], "Customer", "c_custkey", "c_custkey", "c_name", "c_acctbal", "c_mktsegment"),
        "Supplier": lambda: nodes(t["supplier"], "Supplier", "s_suppkey", "s_suppkey", "s_name", "s_acctbal"),
        "Part": lambda: nodes(t["part"], "Part", "p_partkey", "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
        "Order": lambda: nodes(t["orders"], "Order", "o_orderkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
        "User": lambda: nodes(t["events"].select("user_id").where("user_id is not null").distinct(), "User", "user_id", "user_id"),
        "Document": lambda: nodes(t["documents"], "Document", "doc_id", "doc_id", "lang", "source", "n_chars", "text"),
        "Page": lambda: nodes(t["pages"], "Page", "page_id", "page_id", "url"),
        "Conversation": lambda: nodes(t["conversations"].select("conv_id").distinct(), "Conversation", "conv_id", "conv_id"),
    }

    def next_part() -> DataFrame:
        size = F.greatest(F.lit(1), F.col("n"))
        parts = t["part"].select("p_partkey").crossJoin(F.broadcast(t["part"].agg(F.count("*").alias("n"))))  # one row
        both = parts.select(nid("Part", "p_partkey").alias("src"), F.explode(F.array(F.lit(1), F.lit(7))).alias("step"), "p_partkey", "n")
        return both.select("src", nid("Part", F.pmod(F.col("p_partkey") - 1 + F.col("step"), size) + 1).alias("dst"), "step").where("src <> dst")

    def edges(df: DataFrame, a: tuple[str, str], b: tuple[str, str], *props: str) -> Edges:
        return Edges(df.select(nid(*a).alias("src"), nid(*b).alias("dst"), *props), a[0], b[0])

    def lines(*keys: str) -> GroupedData:
        return t["lineitem"].groupBy(*keys)

    e = {
        "IN_REGION": lambda: edges(t["nation"], ("Nation", "n_nationkey"), ("Region", "n_regionkey")),
        "IN_NATION": lambda: Edges(t["customer"].select(nid("Customer", "c_custkey").alias("src"), nid("Nation", "c_nationkey").alias("dst")).union(t["supplier"].select(nid("Supplier", "s_suppkey"), nid("Nation", "s_nationkey"))), None, "Nation"),
        "PLACED": lambda: edges(t["orders"], ("Customer", "o_custkey"), ("Order", "o_orderkey")),
        "CONTAINS": lambda: edges(lines("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n_lines")), ("Order", "l_orderkey"), ("Part", "l_partkey"), "quantity", "n_lines"),
        "SUPPLIED_BY": lambda: edges(lines("l_partkey", "l_suppkey").agg(F.count("*").alias("n_lines")), ("Part", "l_partkey"), ("Supplier", "l_suppkey"), "n_lines"),
        "NEXT": lambda: Edges(next_part(), "Part", "Part"),
    }
    return Graph(Lazy(n), Lazy(e), abstract={"Party": {"Customer", "Supplier"}}, aliases={"Client": "Customer", "FOLLOWED_BY": "NEXT"}, more_labels={"Customer": ["Party"], "Supplier": ["Party"]})

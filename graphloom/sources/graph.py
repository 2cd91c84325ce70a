"""Property graphs as typed tables: one frame per node kind and per relationship kind.

A label scan reads the frames of its kinds only, with the columns that the query
names, so filters and column lists reach the files.  Nodes have ``nid`` (bigint),
``id`` (string) and their properties; relationships have ``src``, ``dst`` (nids)
and their properties.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.iterate import shared_folder
from graphloom.plans.lexer import QueryError


def _plain(name: str) -> str:
    return name.replace("_", "").upper()


class Lazy(Mapping):
    """A mapping whose values are made when first asked for: a query opens only the tables that it names."""

    def __init__(self, makers: dict[str, Callable]):
        self._makers, self._made = makers, {}

    def __getitem__(self, key: str):
        if key not in self._made:
            self._made[key] = self._makers[key]()
        return self._made[key]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


@dataclass
class Edges:
    frame: DataFrame
    src_kind: str | tuple[str, ...] | None = None  # kind or kinds of all sources, where they are known
    dst_kind: str | tuple[str, ...] | None = None

    def kinds(self, first: bool) -> set[str | None]:
        """Kinds of the sources or of the targets; {None} if unknown."""
        known = self.src_kind if first else self.dst_kind
        return set(known) if isinstance(known, tuple) else {known}


@dataclass
class Graph:
    nodes: Mapping[str, DataFrame]
    edges: Mapping[str, Edges]
    abstract: dict[str, set[str]] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    more_labels: dict[str, list[str]] = field(default_factory=dict)  # labels(n) beside the kind
    ontology: tuple[frozenset[str], frozenset[str]] = (frozenset(), frozenset())  # labels and types that may be named though no table has them

    @property
    def spark(self) -> SparkSession:
        return next(iter(self.nodes.values())).sparkSession

    def kinds(self, labels: Iterable[str]) -> list[str]:
        """Node kinds of any of the labels; all kinds without labels."""
        labels = list(labels)
        if not labels:
            return list(self.nodes)
        known = {_plain(k): {k} for k in self.nodes} | {_plain(k): v for k, v in self.abstract.items()}
        known |= {_plain(a): known[_plain(k)] for a, k in self.aliases.items() if _plain(k) in known}
        known = {_plain(k): set() for k in self.ontology[0]} | known
        if missing := [x for x in labels if _plain(x) not in known]:
            raise QueryError(f"unknown label {missing[0]}")
        wanted = set().union(*(known[_plain(x)] for x in labels))
        return [k for k in self.nodes if k in wanted]

    def rel_kinds(self, types: Iterable[str]) -> list[str]:
        types = list(types)
        if not types:
            return list(self.edges)
        known = {_plain(k): k for k in self.edges}
        known |= {_plain(a): known[_plain(k)] for a, k in self.aliases.items() if _plain(k) in known}
        known = {_plain(k): None for k in self.ontology[1]} | known
        if missing := [x for x in types if _plain(x) not in known]:
            raise QueryError(f"unknown relationship type {missing[0]}")
        return list(dict.fromkeys(known[_plain(x)] for x in types if known[_plain(x)]))

    @staticmethod
    def _union(frames: list[DataFrame], props: list[str]) -> list[DataFrame]:
        """The frames with the same columns: missing properties are null, differing types become strings."""
        types: dict[str, T.DataType] = {}
        for p in props:
            kinds = {f.schema[p].dataType.simpleString(): f.schema[p].dataType for f in frames if p in f.columns}
            if len(kinds) > 1:
                numeric = all(isinstance(t, T.NumericType) for t in kinds.values())
                types[p] = T.DoubleType() if numeric and any(isinstance(t, (T.DoubleType, T.FloatType)) for t in kinds.values()) else T.LongType() if numeric else T.StringType()
            else:
                types[p] = next(iter(kinds.values()), T.StringType())
        return [f.select(*f.columns[:0], *[c for c in f.columns if c in ("nid", "id", "src", "dst", "kind")], *[(F.col(p).cast(types[p]) if p in f.columns else F.lit(None).cast(types[p])).alias(p) for p in props]) for f in frames]

    def node_props(self, kinds: list[str]) -> list[str]:
        return list(dict.fromkeys("own_kind" if c == "kind" else c for k in kinds for c in self.nodes[k].columns if c not in ("nid", "id")))

    def rel_props(self, kinds: list[str]) -> list[str]:
        return list(dict.fromkeys(c for k in kinds for c in self.edges[k].frame.columns if c not in ("src", "dst", "kind")))

    def scan(self, kinds: list[str], props: list[str]) -> DataFrame:
        """nid, id, kind and props of the nodes of some kinds."""
        props = [p for p in props if p not in ("nid", "id", "kind")]
        if not kinds:
            kinds, none = list(self.nodes)[:1], True
        else:
            none = False
        # a property named kind stands beside the label
        frames = [self.nodes[k].withColumnRenamed("kind", "own_kind").withColumn("kind", F.lit(k)) for k in kinds]
        out = reduce(DataFrame.unionByName, self._union(frames, props))
        return out.where(F.lit(False)) if none else out

    def links(self, kinds: list[str], props: list[str]) -> DataFrame:
        """src, dst, kind and props of the relationships of some kinds."""
        props = [p for p in props if p not in ("src", "dst", "kind")]
        frames = [self.edges[k].frame.withColumn("kind", F.lit(k)) for k in kinds or list(self.edges)[:1]]
        out = reduce(DataFrame.unionByName, self._union(frames, props))
        return out if kinds else out.where(F.lit(False))

    def cached(self) -> Graph:
        """The graph with its tables kept in memory, for small graphs that many queries share; plans over the same files elsewhere don't see them."""
        mark = uuid.uuid4().hex

        def kept(df: DataFrame) -> DataFrame:
            return df.withColumn("_kept", F.lit(mark)).cache().drop("_kept")

        return replace(self, nodes=Lazy({k: lambda k=k: kept(self.nodes[k]) for k in self.nodes}), edges=Lazy({k: lambda k=k: replace(self.edges[k], frame=kept(self.edges[k].frame)) for k in self.edges}))


def from_frames(nodes: DataFrame, edges: DataFrame, node_schema: dict[str, str] | None = None, edge_schema: dict[str, str] | None = None, **registry) -> Graph:
    """A graph from two tables: nodes (id, kind, properties) and edges (from_id, to_id, kind, properties).

    Both are written once, by kind, in the shared folder.  A node's nid is its id.

    properties is JSON text; a schema per kind (DDL) gives its columns, otherwise
    it is inferred.  Endpoints that no node has become stub nodes of kind Unknown.
    Of nodes with equal id the first in order of kind and properties stays; the
    relationship from one node to another of a kind is kept once.
    """
    spark = nodes.sparkSession
    nodes = nodes.groupBy("id").agg(F.min(F.struct("kind", "properties")).alias("x")).select("id", "x.kind", "x.properties")
    ends = edges.select(F.col("from_id").alias("id")).union(edges.select(F.col("to_id").alias("id"))).where("id is not null").distinct()
    stubs = ends.join(nodes, "id", "left_anti").select("id", F.lit("Unknown").alias("kind"), F.lit("{}").alias("properties"))
    nodes = nodes.unionByName(stubs).withColumn("nid", F.col("id"))
    edges = edges.groupBy("from_id", "to_id", "kind").agg(F.max("properties").alias("properties")).where("from_id is not null and to_id is not null")
    edges = edges.withColumnsRenamed({"from_id": "src", "to_id": "dst"})
    folder = f"{shared_folder(spark)}/graph-{uuid.uuid4()}"

    def by_kind(df: DataFrame, name: str, given: dict[str, str], keep: list[str]) -> dict[str, DataFrame]:
        df.repartition("kind").write.partitionBy("kind").parquet(f"{folder}/{name}")
        stored = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
        # one pass gives the kinds and what their properties hold
        held = F.schema_of_variant_agg(F.try_parse_json("properties"))
        out = {}
        for kind, found in stored.groupBy("kind").agg(held.alias("held")).collect():
            schema = T.StructType.fromDDL(given[kind]) if given.get(kind) else T.StructType() if kind in given else _struct_of(found)
            schema = T.StructType([f for f in schema if f.name not in keep])
            mine = stored.where(F.col("kind") == kind)
            out[kind] = mine.withColumn("p", F.from_json("properties", schema)).select(*keep, "p.*") if schema.fields else mine.select(*keep)
        return out

    out_nodes = by_kind(nodes, "nodes", node_schema or {}, ["nid", "id"])
    out_edges = by_kind(edges, "edges", edge_schema or {}, ["src", "dst"])
    return Graph(out_nodes, {k: Edges(f) for k, f in out_edges.items()}, **registry)


def _struct_of(variant_schema: str | None) -> T.StructType:
    """The columns for objects of a schema as schema_of_variant_agg tells it; what has no one type is text."""
    ddl = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", variant_schema or "")
    ddl = re.sub(r"\b(VOID|VARIANT)\b", "STRING", ddl.replace("OBJECT<", "STRUCT<"))
    parsed = T._parse_datatype_string(ddl) if ddl else T.StructType()
    return parsed if isinstance(parsed, T.StructType) and ddl.startswith("STRUCT<") else T.StructType()


def read_json(spark: SparkSession, nodes_path: str, edges_path: str, **more) -> Graph:
    """from_frames over JSON lines of {id, kind, properties} and {from_id, to_id, kind or type, properties}."""
    nodes = spark.read.schema("id string, kind string, properties string").json(nodes_path)
    edges = spark.read.schema("from_id string, to_id string, kind string, type string, properties string").json(edges_path)
    return from_frames(nodes, edges.withColumn("kind", F.coalesce("kind", "type")).drop("type"), **more)

"""Typed access to the nodes of one kind: conditions, order, paging and terminal calls over a lazy frame."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from graphloom.sources.graph import Graph


@dataclass(frozen=True)
class Entities:
    """Nodes of some kinds. Each call gives new ones; nothing runs before count, any, first or rows."""

    frame: DataFrame
    order: tuple[Column, ...] = ()

    def where(self, *conditions: Column, **equal) -> Entities:
        """Conditions on columns, or properties and their values; False also means null, as an unset flag is off."""
        out = self.frame
        for c in conditions:
            out = out.where(c)
        for name, value in equal.items():
            col = F.col(name)
            out = out.where(col.isNull() | ~col if value is False else col.isNull() if value is None else col.isin(list(value)) if isinstance(value, (list, tuple, set)) else col == F.lit(value))
        return replace(self, frame=out)

    def order_by(self, name: str, descending: bool = False) -> Entities:
        return replace(self, order=(F.desc(name) if descending else F.asc(name),))

    def then_by(self, name: str, descending: bool = False) -> Entities:
        return replace(self, order=(*self.order, F.desc(name) if descending else F.asc(name)))

    def rows(self) -> DataFrame:
        return self.frame.orderBy(*self.order) if self.order else self.frame

    def skip(self, n: int) -> Entities:
        return replace(self, frame=self.rows().offset(n))

    def take(self, n: int) -> Entities:
        return replace(self, frame=self.rows().limit(n))

    def count(self) -> int:
        return self.frame.count()

    def any(self) -> bool:
        return not self.frame.isEmpty()

    def first(self) -> Row | None:
        return self.rows().first()


def entities(graph: Graph, label: str) -> Entities:
    """The nodes that carry a label, with all their properties."""
    kinds = graph.kinds([label])
    return Entities(graph.scan(kinds, graph.node_props(kinds)).drop("nid"))

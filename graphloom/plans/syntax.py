"""Abstract syntax of queries."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


class Expr:
    pass


@dataclass(frozen=True)
class Lit(Expr):
    value: Any


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Var(Expr):
    name: str


@dataclass(frozen=True)
class Prop(Expr):
    of: Expr
    name: str


@dataclass(frozen=True)
class Index(Expr):
    of: Expr
    at: Expr


@dataclass(frozen=True)
class Slice(Expr):
    of: Expr
    lo: Expr | None
    hi: Expr | None


@dataclass(frozen=True)
class HasLabel(Expr):
    of: Expr
    labels: tuple[str, ...]


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    of: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    a: Expr
    b: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    of: Expr
    negated: bool


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Case(Expr):
    subject: Expr | None
    whens: tuple[tuple[Expr, Expr], ...]
    default: Expr | None


@dataclass(frozen=True)
class ListLit(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class MapLit(Expr):
    items: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Comprehension(Expr):
    var: str
    source: Expr
    where: Expr | None
    result: Expr | None


@dataclass(frozen=True)
class Quantifier(Expr):
    kind: str
    var: str
    source: Expr
    where: Expr


@dataclass(frozen=True)
class Reduce(Expr):
    acc: str
    start: Expr
    var: str
    source: Expr
    step: Expr


@dataclass(frozen=True)
class Projection(Expr):
    var: str
    items: tuple[tuple[str, Expr | None], ...]  # name, or "*"; None: the property of that name


@dataclass(frozen=True)
class PatternExpr(Expr):
    pattern: Pattern


@dataclass(frozen=True)
class PatternList(Expr):
    pattern: Pattern
    where: Expr | None
    result: Expr


@dataclass(frozen=True)
class Subquery(Expr):
    kind: str  # exists, count
    query: Query


@dataclass(frozen=True)
class NodePattern:
    var: str | None
    labels: tuple[str, ...]
    props: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class RelPattern:
    var: str | None
    types: tuple[str, ...]
    props: tuple[tuple[str, Expr], ...]
    direction: str  # out, in, both
    hops: tuple[int, int | None] | None


@dataclass(frozen=True)
class Pattern:
    nodes: tuple[NodePattern, ...]
    rels: tuple[RelPattern, ...]
    path: str | None = None
    shortest: str | None = None  # one, all


@dataclass(frozen=True)
class Match:
    patterns: tuple[Pattern, ...]
    where: Expr | None
    optional: bool


@dataclass(frozen=True)
class Unwind:
    source: Expr
    var: str


@dataclass(frozen=True)
class CallQuery:
    query: Query


@dataclass(frozen=True)
class Item:
    expr: Expr
    name: str


@dataclass(frozen=True)
class Project:
    items: tuple[Item, ...]
    star: bool
    distinct: bool
    order: tuple[tuple[Expr, bool], ...]
    skip: Expr | None
    limit: Expr | None
    where: Expr | None
    final: bool


@dataclass(frozen=True)
class Query:
    arms: tuple[tuple[Any, ...], ...]
    all: tuple[bool, ...] = field(default=())


def walk(x: Any):
    """x and all syntax below it."""
    if isinstance(x, tuple):
        for y in x:
            yield from walk(y)
    elif is_dataclass(x):
        yield x
        for f in fields(x):
            yield from walk(getattr(x, f.name))

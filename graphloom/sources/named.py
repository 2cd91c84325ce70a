"""Named queries, raw SQL over the graph's tables, and renderings of small results."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame

from graphloom.plans.parser import parse
from graphloom.plans.planner import run
from graphloom.sources.graph import Graph


class NamedQueries:
    """Queries as files of a folder; only readable ones are saved."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def _path(self, name: str) -> Path:
        if not re.fullmatch(r"\w[\w-]*", name):
            raise ValueError(f"bad name {name!r}")
        return self.folder / f"{name}.cypher"

    def save(self, name: str, text: str) -> None:
        parse(text)
        self.folder.mkdir(parents=True, exist_ok=True)
        self._path(name).write_text(text)

    def get(self, name: str) -> str:
        return self._path(name).read_text()

    def delete(self, name: str) -> None:
        self._path(name).unlink(missing_ok=True)

    def list(self) -> list[str]:
        return sorted(p.stem for p in self.folder.glob("*.cypher"))


def execute(graph: Graph, text: str, params: dict | None = None, named: NamedQueries | None = None) -> DataFrame:
    """A named query, SQL that starts with SELECT over views named by kind, or a query text."""
    text = text.strip()
    if named and re.fullmatch(r"\w[\w-]*", text) and text in named.list():
        text = named.get(text)
    if re.match(r"(?i)(select|with\s+\w+\s+as)\b", text):
        views(graph)
        return graph.spark.sql(text)
    return run(graph, text, params)


def views(graph: Graph) -> None:
    """Temporary views node_<kind>, edge_<kind>, and nodes and edges over all kinds."""
    for k, f in graph.nodes.items():
        f.createOrReplaceTempView(f"node_{k.lower()}")
    for k, e in graph.edges.items():
        e.frame.createOrReplaceTempView(f"edge_{k.lower()}")
    graph.scan(list(graph.nodes), []).createOrReplaceTempView("nodes")
    graph.links(list(graph.edges), []).createOrReplaceTempView("edges")


def _rows(df: DataFrame, most: int) -> list[dict]:
    return [json.loads(x) for x in df.limit(most).toJSON().collect()]


def render(df: DataFrame, form: str = "json", most: int = 1000) -> str:
    """The first ``most`` rows as json, yaml, table (one header, comma-separated rows), markdown or mermaid (columns src, dst)."""
    rows, cols = _rows(df, most), df.columns
    if form == "json":
        return json.dumps(rows, ensure_ascii=False)
    if form == "yaml":
        return "".join("".join(f"{'- ' if i == 0 else '  '}{c}: {json.dumps(r.get(c), ensure_ascii=False)}\n" for i, c in enumerate(cols)) for r in rows)
    if form == "table":
        return f"[{len(rows)}]{{{','.join(cols)}}}:\n" + "".join("  " + ",".join(json.dumps(r.get(c), ensure_ascii=False) if not isinstance(r.get(c), str) or re.search(r'[,"\n]', r[c]) else r[c] for c in cols) + "\n" for r in rows)
    if form == "markdown":
        cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
        return "\n".join(["| " + " | ".join(cols) + " |", "|" + "-|" * len(cols), *["| " + " | ".join(cell(r.get(c)) for c in cols) + " |" for r in rows]])
    if form == "mermaid":
        return "graph LR\n" + "".join(f'  {_id(r["src"])}["{r["src"]}"] --> {_id(r["dst"])}["{r["dst"]}"]\n' for r in rows)
    raise ValueError(f"unknown form {form!r}")


def _id(text: object) -> str:
    return "n" + re.sub(r"\W", "_", str(text))

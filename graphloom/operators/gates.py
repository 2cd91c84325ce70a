"""Semantic gates: a query whose rows are violations, fingerprints, and the ratchet against a baseline."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.planner import run
from graphloom.sources.graph import Graph


@dataclass(frozen=True)
class Gate:
    """query returns violations; file, symbol and target name its columns."""

    id: str
    name: str
    query: str
    message: str = ""
    scope: str = "project"
    dimension: str = "boundary"
    severity: str = "error"
    file: str = "file"
    symbol: str = "symbol"
    target: str = "target"
    warn_at: int | None = None
    fail_at: int = 1
    ratchet: bool = True
    parameters: dict = field(default_factory=dict)


def fingerprinted(rows: DataFrame, gate: str) -> DataFrame:
    """rows (file, symbol, target) with occurrence and fingerprint.

    SHA-256 of gate|file|symbol|target, with |#n from the second row of equal
    parts (case aside) on; independent of line numbers.
    """
    part = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("file", "symbol", "target")]
    w = Window.partitionBy(*[F.lower(p) for p in part]).orderBy(*part)
    n = F.row_number().over(w)
    text = F.concat_ws("|", F.lit(gate), *part)
    return rows.withColumn("occurrence", n).withColumn("fingerprint", F.sha2(F.when(F.col("occurrence") == 1, text).otherwise(F.concat(text, F.lit("|#"), F.col("occurrence").cast("string"))), 256))


def violations(graph: Graph, gate: Gate) -> DataFrame:
    rows = run(graph, gate.query, gate.parameters)
    pick = lambda name: (F.col(name) if name in rows.columns else F.lit(None)).cast("string")
    named = rows.select(pick(gate.file).alias("file"), pick(gate.symbol).alias("symbol"), pick(gate.target).alias("target"))
    return fingerprinted(named, gate.id).withColumn("message", interpolate(gate.message, named))


def interpolate(template: str, rows: DataFrame):
    """'{name}' and '{name|fallback}' of a template as one column."""
    import re

    out, at = [], 0
    for m in re.finditer(r"\{([\w.]+)(?:\|([^}]*))?\}", template):
        out.append(F.lit(template[at : m.start()]))
        value = F.col(m[1]).cast("string") if m[1] in rows.columns else F.lit(None).cast("string")
        out.append(F.coalesce(value, F.lit(m[2] or "")))
        at = m.end()
    return F.concat(*out, F.lit(template[at:]))


def ratchet(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """found with state: new, or tolerated if the baseline (fingerprint) has it."""
    known = baseline.select("fingerprint").distinct().withColumn("known", F.lit(True))
    return found.join(known, "fingerprint", "left").withColumn("state", F.when(F.col("known"), "tolerated").otherwise("new")).drop("known")


def updated_baseline(found: DataFrame, baseline: DataFrame, now: str) -> DataFrame:
    """fingerprint, acknowledged_at, reason of the violations found; what was acknowledged before stays so."""
    old = baseline.select("fingerprint", "acknowledged_at", "reason").dropDuplicates(["fingerprint"])
    return found.select("fingerprint").distinct().join(old, "fingerprint", "left").select("fingerprint", F.coalesce("acknowledged_at", F.lit(now)).alias("acknowledged_at"), F.coalesce("reason", F.lit("")).alias("reason"))


def status(gate: Gate, n_new: int, n_tolerated: int, has_baseline: bool) -> str:
    if has_baseline and gate.ratchet and not n_new and n_tolerated:
        return "PassedTolerated"
    if n_new >= gate.fail_at and gate.severity == "error":
        return "FailedNew"
    return "Passed" if not n_new else "Warning" if gate.warn_at is None or n_new >= gate.warn_at else "Passed"


def check(graph: Graph, gates: list[Gate], baselines: dict[str, DataFrame] | None = None, **only: str) -> list[dict]:
    """Status of every gate whose fields match ``only``; a gate that can't run is an Error."""
    out = []
    for g in gates:
        if any(getattr(g, k) != v for k, v in only.items()):
            continue
        try:
            base = (baselines or {}).get(g.id)
            found = violations(graph, g)
            counts = {r["state"]: r["count"] for r in (ratchet(found, base) if base is not None else found.withColumn("state", F.lit("new"))).groupBy("state").count().collect()}
            new, old = counts.get("new", 0), counts.get("tolerated", 0)
            out.append({"gate": g.id, "status": status(g, new, old, base is not None), "new": new, "tolerated": old})
        except Exception as e:  # noqa: BLE001  one broken gate doesn't stop the suite
            out.append({"gate": g.id, "status": "Error", "error": str(e)})
    return out


def grouped(found: DataFrame, by: str) -> DataFrame:
    return found.groupBy(F.coalesce(F.col(by), F.lit("")).alias(by)).agg(F.count("*").alias("n"))


class Repository:
    """Gates as JSON files of a folder."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def save(self, gate: Gate) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        (self.folder / f"{gate.id}.json").write_text(json.dumps(asdict(gate), indent=1))

    def load(self) -> list[Gate]:
        return [Gate(**json.loads(p.read_text())) for p in sorted(self.folder.glob("*.json"))]


# generic shapes of the usual rules
GATES = [
    Gate("G-CYCLE", "No part follows itself in two steps", "MATCH (a:Part)-[:NEXT]->(b:Part)-[:NEXT]->(a) RETURN a.id AS symbol, b.id AS target", "{symbol} and {target} form a cycle"),
    Gate("G-LARGE", "No order has very many lines", "MATCH (o:Order)-[r:CONTAINS]->(:Part) WITH o, count(r) AS n WHERE n > $most RETURN o.id AS symbol, toString(n) AS target", "{symbol} has {target} lines", parameters={"most": 5}),
    Gate("G-DEAD", "Every customer has an order", "MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->(:Order) RETURN c.id AS symbol", "{symbol} has no {target|order}", severity="warning"),
    Gate("G-DEBT", "No balance is negative", "MATCH (c:Customer) WHERE c.c_acctbal < 0 RETURN c.c_mktsegment AS file, c.id AS symbol", "{symbol} owes"),
]

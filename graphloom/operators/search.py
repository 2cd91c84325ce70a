"""Identifier search: words, trigrams, hashed vectors, hybrid ranking."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: weights and thresholds of the vectors and of the search
DIM = 128
WEIGHT_FULL, WEIGHT_ACRONYM, WEIGHT_WORD, WEIGHT_3, WEIGHT_4 = 3.5, 2.5, 2.0, 1.0, 1.2
MIN_SCORE, MIN_WITHOUT_TRIGRAM, SUBSTRING_SCORE, RESOLVE_SCORE = 0.35, 0.68, 0.85, 0.65
EXACT_LIMIT, TRIGRAM_LIMIT = 5, 100


def words(name: Column) -> Column:
    """camelCase, PascalCase and punctuation split; lower case."""
    cut = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(cut, r"[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")


def split_words(text: str) -> list[str]:
    """words() of one text."""
    cut = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text))
    return re.sub(r"[^A-Za-z0-9]+", " ", cut).lower().split()


def indexed(names: DataFrame, name: str = "name") -> DataFrame:
    """names (id, name) with words, trigrams and vector: write it once, and ``hybrid`` encodes no name again."""
    return with_vectors(names.withColumn("trigrams", trigrams(F.col(name))), name)


def trigrams(name: Column) -> Column:
    low = F.lower(name)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substring(low, i, 3)))


def _fnv(text: str) -> int:
    """FNV-1a of 32 bits over UTF-16 code units."""
    h = 0x811C9DC5
    for unit in np.frombuffer(text.encode("utf-16-le"), np.uint16).tolist():
        h = ((h ^ unit) * 0x01000193) & 0xFFFFFFFF
    return h


def encode(name: str, parts: list[str]) -> np.ndarray:
    v = np.zeros(DIM, np.float64)

    def add(text: str, weight: float) -> None:
        h = _fnv(text)
        v[h % DIM] += -weight if h >> 31 else weight

    low = name.lower()
    add(low, WEIGHT_FULL)
    if len(parts) > 1:
        add("".join(p[0] for p in parts), WEIGHT_ACRONYM)
    for p in parts:
        add(p, WEIGHT_WORD)
    for n, weight in ((3, WEIGHT_3), (4, WEIGHT_4)):
        for i in range(len(low) - n + 1):
            add(low[i : i + n], weight)
    norm = np.sqrt((v * v).sum())
    return v / norm if norm else v


def with_vectors(df: DataFrame, name: str = "name") -> DataFrame:
    """df with words and vector (array<double>) of a name column."""
    df = df.withColumn("words", words(F.col(name)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, parts = (b.column(b.schema.names.index(c)).to_pylist() for c in (name, "words"))
            vectors = [None if n is None else encode(n, p).tolist() for n, p in zip(names, parts, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float64()))], [*b.schema.names, "vector"])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", vector array<double>")


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, between 0 and 1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot))


def cosine_topk(vectors: DataFrame, query: list[float], k: int, key: str, vector: str = "embedding") -> DataFrame:
    """The k rows of vectors with the largest cosine similarity to query, and score; ties by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    sums = lambda f: F.aggregate(f, F.lit(0.0), lambda s, x: s + x)
    dot, nv, nq = sums(F.zip_with(v, q, lambda x, y: x * y)), sums(F.transform(v, lambda x: x * x)), sum(float(x) ** 2 for x in query)
    return vectors.withColumn("score", dot / F.sqrt(nv * F.lit(nq))).orderBy(F.desc("score"), key).limit(k)


def hybrid(index: DataFrame, text: str, k: int = 10, name: str = "name") -> DataFrame:
    """The k best rows of index (id, name) for a text, with score.

    Equal names (case aside) alone if there are any; else names that share a
    trigram with a word of the text, else all; ranked by cosine, raised where the
    text is a substring.
    """
    low = text.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    own = F.col("trigrams") if "trigrams" in index.columns else trigrams(F.col(name))
    shared = F.size(F.array_intersect(own, F.array(*[F.lit(g) for g in grams]) if grams else F.array().cast("array<string>")))
    # 0 equal names, 1 names with a trigram in common, 2 the others: only the first kind that occurs is looked at
    kind = F.when(F.lower(name) == low, 0).when(F.col("shared") > 0, 1).otherwise(2)
    rows = index.withColumn("shared", shared).withColumn("tier", kind)
    rows = rows.join(F.broadcast(rows.agg(F.min("tier").alias("best"))), F.col("tier") == F.col("best"))  # one row
    most = F.when(F.col("tier") == 0, EXACT_LIMIT).when(F.col("tier") == 1, TRIGRAM_LIMIT)
    few = rows.where("tier < 2").orderBy(F.desc("shared"), "id").limit(TRIGRAM_LIMIT)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("tier").orderBy(F.desc("shared"), "id"))).where(F.col("r") <= most).drop("r")
    rows = few.unionByName(rows.where("tier = 2"))
    rows = rows if "vector" in index.columns else with_vectors(rows.select("id", name, "tier"), name)
    query = encode(text, split_words(text))
    score = cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query]))
    score = F.when(F.contains(F.lower(name), F.lit(low)), F.greatest(score, F.lit(SUBSTRING_SCORE))).otherwise(score)
    score = F.when(F.col("tier") == 0, 1.0).otherwise(score)
    least = F.when(F.col("tier") == 2, MIN_WITHOUT_TRIGRAM).otherwise(MIN_SCORE)
    return rows.withColumn("score", score).where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(k).select("id", name, "score")


def resolve(index: DataFrame, text: str, name: str = "name") -> DataFrame:
    return hybrid(index, text, 1, name).where(F.col("score") >= RESOLVE_SCORE)


def diversified(scored: DataFrame, concept: str, per: int, k: int) -> DataFrame:
    """The k best rows of scored (id, score): first at most ``per`` of each concept, then the rest."""
    rank = F.row_number().over(Window.partitionBy(concept).orderBy(F.desc("score"), "id"))
    return scored.withColumn("later", rank > per).orderBy("later", F.desc("score"), "id").limit(k).drop("later")

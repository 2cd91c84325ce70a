"""Operator 3, language identification by hierarchical discrimination.

First one-versus-rest linear support vector machines choose a language family;
then one-versus-one machines vote between the languages of that family.
Features are counts of hashed byte bigrams and trigrams of the whole lower-cased
text, as square roots of their shares (so every vector has length 1).

Learning uses a bounded sample: about ``per_language`` documents of each
language (the documented bound), picked by a hash of
doc_id.  Rows with null doc_id, text or lang are not learned from.  A text that is null or has no letter is ``und`` with score
1; with nothing learned every text is ``und`` with score 0.  Repeated rows are
predicted each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import _text as tx
from graphloom.llm.quality_classifier import held_out

DIM = 1 << 13
PER_LANGUAGE = 500
UNKNOWN = "und"
# fixed values: families of common language codes; other codes form the family "other"
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "semitic": ["ar", "he", "mt"],
    "sinitic": ["yue", "zh"],
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
_CASE = np.arange(256, dtype=np.int32)
_CASE[65:91] += 32


def features(buf: np.ndarray) -> np.ndarray:
    """Feature vector of one text's bytes."""
    if len(buf) < 2:
        return np.zeros(DIM, np.float32)
    b = _CASE[buf]
    # UTF-8 capitals of Latin letters with marks: 0xC3 0x80-0x9E
    b[1:][(b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)] += 32
    two = b[:-1] * 257 + b[1:]
    three = (two[:-1] * 263 + b[2:] + 12345) * -1640531535
    counts = np.bincount((two * -1640531535) >> 19 & DIM - 1, minlength=DIM) + np.bincount(three >> 19 & DIM - 1, minlength=DIM)
    return np.sqrt(counts / counts.sum(), dtype=np.float64).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _svm(x: np.ndarray, y: np.ndarray, steps: int = 200, c: float = 30.0) -> np.ndarray:
    """Linear support vector machine (squared hinge, classes weighed evenly) by accelerated gradient descent; y: -1 or 1."""
    weight = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    ahead, t = w.copy(), 1.0
    rate = 1 / (1 / c + 8)
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1]))
        pull = -2 * weight * slack * y
        grad = np.append(x.T @ pull, pull.sum()).astype(np.float32)
        grad[:-1] += ahead[:-1] / c
        new, t_new = ahead - np.float32(rate) * grad, (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + np.float32((t - 1) / t_new) * (new - w), new, t_new
    return w


class Model:
    """All machines as columns of one matrix, so that a text costs one product."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        self.langs = sorted(set(langs.tolist()))
        family = {k: _FAMILY.get(k, "other") for k in self.langs}
        self.families = {f: [k for k in self.langs if family[k] == f] for f in sorted(set(family.values()))}
        columns, self.at = [], {}
        mine = np.array([family[k] for k in langs])
        for f, members in self.families.items():
            if len(self.families) > 1:
                self.at[f,] = len(columns)
                columns.append(_svm(x, np.where(mine == f, 1, -1).astype(np.float32)))
            for i, a in enumerate(members):
                for b in members[i + 1 :]:
                    both = (langs == a) | (langs == b)
                    self.at[a, b] = len(columns)
                    columns.append(_svm(x[both], np.where(langs[both] == a, 1, -1).astype(np.float32)))
        self.w = np.stack(columns, 1) if columns else np.zeros((DIM + 1, 0), np.float32)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        if not self.langs:
            return UNKNOWN, 0.0
        margin = x @ self.w[:-1] + self.w[-1]
        sure = 1 / (1 + np.exp(-4 * np.clip(margin.astype(np.float64), -7, 7)))
        family, score = next(iter(self.families)), 1.0
        if len(self.families) > 1:
            odds = {f: sure[self.at[f,]] for f in self.families}
            family = max(odds, key=odds.get)
            score = odds[family] / sum(odds.values())
        members = self.families[family]
        votes = dict.fromkeys(members, 0.0)
        won = dict.fromkeys(members, 0)
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                p = sure[self.at[a, b]]
                votes[a] += p
                votes[b] += 1 - p
                won[a if p >= 0.5 else b] += 1
        best = max(members, key=lambda k: (won[k], votes[k]))
        return best, float(score * (votes[best] / (len(members) - 1) if len(members) > 1 else 1.0))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learned from about per_language rows of each lang of docs (doc_id, text, lang)."""
    rows = docs.where("doc_id is not null and text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = {k: n for k, n in rows.groupBy("lang").count().collect() if n}
    scale = 1 << 24
    keep = F.lit(False)
    for k, n in counts.items():
        keep = keep | ((F.col("lang") == k) & (F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(scale * min(1.0, per_language / n))))
    got = rows.where(keep).select("text", "lang").limit(2 * per_language * len(counts)).toPandas().sort_values(["lang", "text"]) if counts else rows.limit(0).toPandas()
    x = np.stack([features(np.frombuffer(t.encode(), np.uint8)) for t in got["text"]]) if len(got) else np.zeros((0, DIM), np.float32)
    return Model(x, got["lang"].to_numpy(str))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = tx.flat(b.column(1))
            out = []
            for i, text in enumerate(b.column(1)):
                ok = has_letter(text.as_py())
                out.append(model.predict(features(buf[offsets[i] : offsets[i + 1]])) if ok else (UNKNOWN, 1.0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")

"""Operator 9, quality classifier: a byte-level convolutional network in numpy.

A document is cut into overlapping chunks of CHUNK bytes that cover it whole.
Learned filters of WIDTH bytes run over each chunk, STRIDE bytes apart; their
responses are max-pooled per chunk and go through a hidden layer.  The largest
and the mean hidden response over a document's chunks give one probability.

The network is trained on the driver from a bounded sample: about ``sample``
labelled rows (the documented bound), picked by a hash of doc_id, none of them
held out; of texts of up to LEARNED_BYTES, so that what reaches the driver has a
bound in bytes, too.  Each step learns from whole short documents and from
TRAIN_CHUNKS chunks, drawn anew, of longer ones; scores always use all chunks.
Only text and label are used.  Rows with null label or doc_id are not
learned from.  Null and empty texts are scored as one chunk of padding; repeated
rows are scored each; extra columns are ignored; with no labelled rows of one of
the classes every score is the share of label 1 (0.5 if there are none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from graphloom.llm import _text as tx

CHUNK, OVERLAP = 512, 32
STRIDE, WIDTH = 4, 8
EMBED, FILTERS, HIDDEN = 4, 24, 12
PAD = 256
SAMPLE = 3000
STEPS, BATCH, TRAIN_CHUNKS = 700, 48, 24
LEARNED_BYTES = 256 << 10
THRESHOLD = 0.3


def chunk_starts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every chunk within its document, and the number of chunks of each document."""
    step = CHUNK - OVERLAP
    n = 1 + np.maximum(0, -(-(sizes - CHUNK) // step))
    first = np.cumsum(n) - n
    start = (np.arange(n.sum()) - np.repeat(first, n)) * step
    return np.minimum(start, np.repeat(np.maximum(0, sizes - CHUNK), n)), n


def gather(buf: np.ndarray, offsets: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Bytes of the chunks as symbols, PAD beyond the end of a document."""
    at = (offsets[doc] + start)[:, None] + np.arange(CHUNK)
    out = np.full(at.shape, PAD, np.int16)
    ok = at < offsets[doc + 1][:, None]
    out[ok] = buf[at[ok]]
    return out


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f32 = np.float32
        self.w = {
            "embed": r.normal(0, 0.5, (257, EMBED)).astype(f32),
            "filters": r.normal(0, 0.25, (STRIDE * EMBED, 2 * FILTERS)).astype(f32),
            "hidden": r.normal(0, 0.3, (FILTERS, HIDDEN)).astype(f32),
            "bias": np.zeros(HIDDEN, f32),
            "most": r.normal(0, 0.3, HIDDEN).astype(f32),
            "mean": r.normal(0, 0.3, HIDDEN).astype(f32),
            "out": np.zeros(1, f32),
        }
        self.constant: float | None = None

    def pooled(self, symbols: np.ndarray, where: bool = False):
        n, w = len(symbols), self.w
        x = w["embed"][symbols].reshape(n * CHUNK // STRIDE, STRIDE * EMBED)
        y = (x @ w["filters"]).reshape(n, CHUNK // STRIDE, 2 * FILTERS)
        z = y[:, :-1, :FILTERS] + y[:, 1:, FILTERS:]
        if not where:
            return z.max(1)
        best = z.argmax(1)
        return np.take_along_axis(z, best[:, None], 1)[:, 0], best, x

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        start, n = chunk_starts(np.diff(offsets))
        doc = np.repeat(np.arange(len(n)), n)
        h = np.empty((len(start), HIDDEN), np.float32)
        for a in range(0, len(start), 64):
            p = self.pooled(gather(buf, offsets, doc[a : a + 64], start[a : a + 64]))
            h[a : a + 64] = np.maximum(p @ self.w["hidden"] + self.w["bias"], 0)
        if not len(n):
            return np.zeros(0)
        first = np.cumsum(n) - n
        z = np.maximum.reduceat(h, first) @ self.w["most"] + (np.add.reduceat(h, first) / n[:, None]) @ self.w["mean"] + self.w["out"]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def train(self, texts: list[bytes], labels: np.ndarray, seed: int = 7, steps: int = STEPS) -> Network:
        counts = np.bincount(labels, minlength=2)
        if counts.min() == 0:
            self.constant = 0.5 if not len(labels) else float(labels.mean())
            return self
        r = np.random.default_rng(seed)
        buf = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        by_label = [np.flatnonzero(labels == y) for y in (0, 1)]
        slow = {k: np.zeros_like(v) for k, v in self.w.items()}
        square = {k: np.zeros_like(v) for k, v in self.w.items()}
        for step in range(1, steps + 1):
            pick = np.concatenate([r.choice(x, BATCH // 2) for x in by_label])
            start, n = chunk_starts(np.diff(offsets)[pick])
            first = np.cumsum(n) - n
            keep = np.concatenate([f + (np.arange(k) if k <= TRAIN_CHUNKS else np.sort(r.choice(k, TRAIN_CHUNKS, replace=False))) for f, k in zip(first, n, strict=True)])
            doc = np.repeat(np.arange(len(n)), n)[keep]
            grad = self._gradient(gather(buf, offsets, pick[doc], start[keep]), doc, len(pick), labels[pick])
            rate = 0.01 * min(1.0, step / 20) * (1 - step / (steps + 1))
            for k, g in grad.items():
                slow[k] = 0.9 * slow[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                self.w[k] -= (rate * (slow[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        # the classes were drawn evenly: half way back to their shares
        self.w["out"] += np.float32(0.5 * np.log(counts[1] / counts[0]))
        return self

    def _gradient(self, symbols: np.ndarray, doc: np.ndarray, n_docs: int, labels: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        p, best, x = self.pooled(symbols, where=True)
        h = np.maximum(p @ w["hidden"] + w["bias"], 0)
        first = np.searchsorted(doc, np.arange(n_docs))
        size = np.diff([*first, len(doc)]).astype(np.float32)
        most, mean = np.maximum.reduceat(h, first), np.add.reduceat(h, first) / size[:, None]
        z = most @ w["most"] + mean @ w["mean"] + w["out"]
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / n_docs).astype(np.float32)
        top = h == most[doc]
        share = np.add.reduceat(top.astype(np.float32), first)[doc]
        dh = dz[doc, None] * (w["mean"] / size[doc, None] + w["most"] * top / share)
        dh[h <= 0] = 0
        dp = dh @ w["hidden"].T
        row = np.arange(len(doc))[:, None] * (CHUNK // STRIDE) + best
        a, b = x[row], x[row + 1]
        filters = np.concatenate([np.einsum("cfk,cf->kf", a, dp), np.einsum("cfk,cf->kf", b, dp)], 1)
        dx = np.concatenate([dp[..., None] * w["filters"][:, :FILTERS].T, dp[..., None] * w["filters"][:, FILTERS:].T], 2).reshape(len(doc), FILTERS, 2 * STRIDE, EMBED)
        at = (best * STRIDE)[..., None] + np.arange(2 * STRIDE)
        hit = np.take_along_axis(symbols[:, None, :], at.reshape(len(doc), 1, -1), 2).reshape(-1).astype(np.int64)
        flat = dx.reshape(-1, EMBED)
        embed = np.stack([np.bincount(hit, flat[:, e], 257) for e in range(EMBED)], 1).astype(np.float32)
        return {"embed": embed + 1e-4 * w["embed"], "filters": filters + 1e-4 * w["filters"], "hidden": p.T @ dh + 1e-4 * w["hidden"], "bias": dh.sum(0), "most": most.T @ dz, "mean": mean.T @ dz, "out": dz.sum(keepdims=True)}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Trained on about ``sample`` rows of labels (doc_id, quality) with their texts."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    total = rows.count()
    scale = 1 << 20
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(scale * min(1.0, sample / max(1, total)))).limit(2 * sample)
    # at most twice ``sample`` rows of two numbers: bounded, so it can be broadcast
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LEARNED_BYTES).join(F.broadcast(some), "doc_id").select("doc_id", "text", "quality").limit(4 * sample).toPandas().sort_values(["doc_id", "quality", "text"])
    return Network().train([(t or "").encode() for t in got["text"]], got["quality"].to_numpy(np.int64))


def score(docs: DataFrame, network: Network, column: str = "score") -> DataFrame:
    """The rows of docs (text and whatever else; a column of that name is replaced), with the probability of label 1."""
    docs = docs.drop(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = tx.flat(b.column(b.schema.names.index("text")))
            s = np.concatenate([network.scores(buf, offsets[a : a + 2001]) for a in range(0, max(1, b.num_rows), 2000)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, column])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def held_out(doc_id: Column, mod: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == remainder, F.lit(False))


def trained(spark: SparkSession, sf_dir: str) -> Network:
    """The network of op9 and of the pipeline: learned from the labels outside fold 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.where(~held_out(F.col("doc_id"), 5, 0)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, trained(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

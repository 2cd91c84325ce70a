"""Operator 4, benchmark decontamination: size-partitioned MinHash containment search.

A test item leaks into a document if the document holds at least ``threshold``
of the item's distinct ``k``-word shingles (words lower-cased A-Z; a text of
fewer than k words is one shingle, a text without words has none and leaks
nowhere).  With ``short_inside``, as in op4_decontamination and the pipeline, an
item of m < k words also leaks into longer documents that hold its words in a
row: documents have their m-word windows too, for each such m that occurs among
the items.  ORACLE_SQL has no such windows; both agree where no item is shorter
than k words.  Items are short and documents long, so items are partitioned by the
size of their shingle sets; all items of a partition keep bottom-m MinHash
sketches, with m from the partition's upper size bound u such that any set with
``threshold`` of an item of u shingles must hold one of its m least hashes:
m = u - ceil(threshold * u) + 1.  A document probes the sketches with all its
shingles; hits are verified by exact containment of the words themselves.  With
that m the search misses nothing.

While the items' texts have ITEM_BYTES or less, their sketches are broadcast and
documents never shuffled.  Beyond, documents and items meet by join: each item
under the hashes of its sketch, each document under its distinct hashes, both
with a hash of their text only; texts come to the pairs that met for the same
exact check.  Documents are read once for the hashes and once for the check,
however many items there are.  Null texts have no words; a very long text is one
row and must fit into a worker's memory; repeated items (same id and text) count once, repeated documents are
reported each; null ids stay null; extra columns are ignored; empty tables give
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import _text as tx
from graphloom.llm._blocks import slices

SHINGLE = 5
THRESHOLD = 0.8
ITEM_BYTES = 4 << 20
_SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def shingle_hashes(buf: np.ndarray, offsets: np.ndarray, k: int, sizes: frozenset[int] = frozenset()) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every shingle, with repeats, in document order; also of the windows of ``sizes`` (below k) words."""
    starts, ends, first = tx.word_bounds(buf, offsets)
    words = tx.word_hashes(buf, starts, ends, lower=True)
    h = tx.windows(words, k)
    at = np.flatnonzero(tx.inside(first, len(h), k)) if len(h) else np.zeros(0, np.int64)
    owner = tx.owner(first)
    doc, h = owner[at], h[at]
    n = np.diff(first)
    for size in range(1, k):
        if size in sizes:
            begin = np.flatnonzero(tx.inside(first, len(words) - size + 1, size))
        else:
            begin = first[:-1][n == size]
        if len(begin):
            salt = tx.U64(size * 0x9FB21C651E98DF25 % 2**64)
            one = np.zeros(len(begin), tx.U64)
            for j in range(size):
                one = one * tx._Q1 + words[begin + j]
            h, doc = np.concatenate([h, tx.mix(one ^ salt)]), np.concatenate([doc, owner[begin]])
    order = np.argsort(doc, kind="stable")
    return h[order], doc[order]


def shingles(text: str | None, k: int = SHINGLE, sizes: frozenset[int] = frozenset()) -> set[bytes]:
    """The words of each shingle of one text and of its windows of ``sizes`` words, exactly."""
    words = (text or "").encode().lower().split()  # bytes.lower changes A-Z only; bytes.split cuts at these blanks only
    out = {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()
    return out.union(b" ".join(words[i : i + m]) for m in sizes for i in range(len(words) - m + 1))


def sketch(hashes: np.ndarray, threshold: float) -> np.ndarray:
    """The least of an item's distinct hashes, as many as its size partition (u / 2, u] needs."""
    u = 1 << (len(hashes) - 1).bit_length()
    return hashes[: u - ceil(threshold * u) + 1]


class Index:
    """Sketches of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], k: int, threshold: float, short_inside: bool = False):
        self.k, self.threshold = k, threshold
        self.items = [(i, s, t) for i, t in items if (s := shingles(t, k))]
        self.sizes = frozenset(n for _, s, _ in self.items if (n := next(iter(s)).count(b" ") + 1) < k) if short_inside else frozenset()
        texts = [t.encode() for _, _, t in self.items]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        h, doc = shingle_hashes(np.frombuffer(b"".join(texts), np.uint8), offsets, k)
        bounds = np.searchsorted(doc, np.arange(len(self.items) + 1)).tolist()
        self.sets = [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        keys, owners = [], []
        for i, s in enumerate(self.sets):
            keys.append(sketch(s, threshold))
            owners.append(np.full(len(keys[-1]), i))
        keys, owners = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (keys, owners))
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]
        self.low = np.zeros(1 << 16, bool)
        self.low[(self.keys & tx.U64(0xFFFF)).astype(np.int64)] = True

    def search(self, column: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) of each leak into the texts of a column."""
        buf, offsets = tx.flat(column)
        h, doc = shingle_hashes(buf, offsets, self.k, self.sizes)
        maybe = np.flatnonzero(self.low[(h & tx.U64(0xFFFF)).astype(np.int64)])
        a, b = np.searchsorted(self.keys, h[maybe]), np.searchsorted(self.keys, h[maybe], "right")
        hit = np.flatnonzero(b > a)
        n = (b - a)[hit]
        item = self.owners[np.repeat(a[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        pairs = np.unique(np.repeat(doc[maybe[hit]], n) * len(self.items) + item)
        bounds = np.searchsorted(doc, np.arange(len(offsets)))
        words: dict[int, set[bytes]] = {}
        for row, item in zip(*(x.tolist() for x in np.divmod(pairs, max(1, len(self.items)))), strict=True):
            need = ceil(self.threshold * len(self.items[item][1]) - 1e-9)
            if np.isin(self.sets[item], h[bounds[row] : bounds[row + 1]]).sum() < need:
                continue
            if row not in words:
                words = {row: shingles(column[row].as_py(), self.k, self.sizes)}
            if (shared := len(self.items[item][1] & words[row])) >= need:
                yield row, item, shared


def _distinct(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()


def _index(items: DataFrame, k: int, threshold: float, item_bytes: int, short_inside: bool) -> Broadcast | None:
    """Sketches of all items, if their texts have no more than item_bytes."""
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if total > item_bytes:
        return None
    return items.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in items.collect()], k, threshold, short_inside))


def _short_sizes(items: DataFrame, k: int) -> frozenset[int]:
    n = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    return frozenset(r[0] for r in items.select(n.alias("n")).where(f"n > 0 and n < {k}").distinct().collect())  # k - 1 rows at most


def _met(docs: DataFrame, items: DataFrame, k: int, threshold: float, short_inside: bool) -> DataFrame:
    """item_id, n_shared, n_shingles, text of the leaks of many items, each distinct text of docs once."""
    sizes = _short_sizes(items, k) if short_inside else frozenset()

    def hashed(column: str, sketched: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for piece in slices(b):
                    h, doc = shingle_hashes(*tx.flat(piece.column(1)), k, frozenset() if sketched else sizes)
                    bounds = np.searchsorted(doc, np.arange(piece.num_rows + 1)).tolist()
                    sets = [np.unique(h[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                    sets = [sketch(s, threshold) if sketched and len(s) else s for s in sets]
                    own = piece.column(0).to_numpy().repeat([len(s) for s in sets])
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(np.concatenate(sets).view(np.int64), pa.int64())], [column, "key"])

        return run

    texts = docs.where("text is not null").select(F.xxhash64("text").alias("doc"), "text").dropDuplicates(["text"])
    named = items.select(F.xxhash64("item_id", "text").alias("item"), "item_id", F.col("text").alias("item_text"))
    keys = named.select("item", "item_text").mapInArrow(hashed("item", True), "item long, key long")
    pairs = texts.mapInArrow(hashed("doc", False), "doc long, key long").join(keys, "key").select("doc", "item").distinct()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, before, held = [], None, set()
            for item, item_text, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if text != before:
                    before, held = text, shingles(text, k, sizes)
                own = shingles(item_text, k)
                if (n := len(own & held)) >= ceil(threshold * len(own) - 1e-9):
                    rows.append((item, n, len(own), text))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate([pa.int64()] * 3 + [pa.string()])], ["item_id", "n_shared", "n_shingles", "text"])

    return pairs.join(named, "item").join(texts, "doc").select("item_id", "item_text", "text").mapInArrow(check, "item_id long, n_shared long, n_shingles long, text string")


def find_leaks(docs: DataFrame, items: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, item_bytes: int = ITEM_BYTES, short_inside: bool = False) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment of each leak of items (item_id, text) into docs (doc_id, text)."""
    schema = "doc_id long, item_id long, n_shared long, n_shingles long, containment double"
    cols, items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _distinct(items)
    index = _index(items, k, threshold, item_bytes, short_inside)
    if index is None:
        found = _met(cols, items, k, threshold, short_inside)
        return cols.join(found, "text").select("doc_id", "item_id", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        for b in batches:
            for piece in slices(b):
                rows = [(piece.column(0)[r].as_py(), x.items[i][0], n, len(x.items[i][1]), n / len(x.items[i][1])) for r, i, n in x.search(piece.column(1))]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate([pa.int64()] * 4 + [pa.float64()])], ["doc_id", "item_id", "n_shared", "n_shingles", "containment"])

    return cols.mapInArrow(run, schema)


def without_leaks(docs: DataFrame, items: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, item_bytes: int = ITEM_BYTES, short_inside: bool = False) -> DataFrame:
    """The rows of docs (text and whatever else) into which no item leaks."""
    items = _distinct(items)
    index = _index(items, k, threshold, item_bytes, short_inside)
    if index is None:
        leaky = _met(docs.select(F.col("text").cast("string").alias("text")), items, k, threshold, short_inside).select("text").distinct()
        return docs.join(leaky, "text", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b):
                keep = np.ones(piece.num_rows, bool)
                keep[[r for r, _, _ in index.value.search(piece.column(piece.schema.names.index("text")))]] = False
                yield piece.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_inside=True)


ORACLE_SQL = """
WITH t AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT side, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM t),
s AS (SELECT DISTINCT side, id, array_to_string(ws[i:i+4], ' ') AS sh FROM (SELECT side, id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT id, count(*) AS n FROM s WHERE side = 1 GROUP BY id),
j AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM s d JOIN s b ON d.sh = b.sh WHERE d.side = 0 AND b.side = 1 GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n AS n_shingles, n_shared / n AS containment FROM j JOIN n ON n.id = item_id WHERE n_shared >= 0.8 * n
"""

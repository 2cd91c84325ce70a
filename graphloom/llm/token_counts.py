"""Operator 1, token counts: Arrow functions that encode batches and return lengths only.

Texts are cut at blanks and line feeds.  No rule of the tokenizer reaches over
them (white space is dropped by its pre-tokenizer, no merge and no canonical
composition crosses it, its special strings contain none), so the counts of the
pieces add up to the count of the whole text.  Pieces are encoded in batches
balanced by bytes, each distinct piece of a worker once while the bounded cache
holds it.

Null and empty texts have 0 tokens; repeated rows are counted each; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 20
CACHE_ENTRIES = 400_000
CACHED_CHARS = 48
OVER_LIMIT = 2048


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Counter:
    """Token counts of pieces by one tokenizer, with a bounded cache."""

    of: dict[str, _Counter] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache: dict[str, int] = {"": 0}

    def encode(self, pieces: list[str]) -> Iterator[int]:
        """Lengths, by batches of about BATCH_BYTES."""
        at = 0
        while at < len(pieces):
            upto, size = at, 0
            while upto < len(pieces) and (upto == at or size < BATCH_BYTES):
                size += 64 + 4 * len(pieces[upto])
                upto += 1
            for x in self.tokenizer.encode_batch_fast(pieces[at:upto], add_special_tokens=False):
                yield len(x)
            at = upto

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.cache) > CACHE_ENTRIES:
            self.cache = {"": 0}
        cache = self.cache
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        fresh = list(set().union(*cut).difference(cache))
        got = dict(zip(fresh, self.encode(fresh), strict=True))
        cache.update(got)
        out = [sum(map(cache.__getitem__, x)) for x in cut]
        for k in got:
            if len(k) > CACHED_CHARS:
                del cache[k]
        return out


def _slices(texts: list[str | None], sizes: list[int]) -> Iterator[list[str]]:
    """Texts in groups of about BATCH_BYTES of UTF-8."""
    group, size = [], 0
    for t, n in zip(texts, sizes, strict=True):
        group.append(t or "")
        size += n
        if size >= BATCH_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def count_tokens(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes long, n_tokens long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary_path not in _Counter.of:
            _Counter.of[vocabulary_path] = _Counter(vocabulary_path)
        counter = _Counter.of[vocabulary_path]
        for b in batches:
            n = [c for texts in _slices(b.column(2).to_pylist(), b.column(1).to_pylist()) for c in counter.counts(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    cols = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(run, "id long, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
    return counts.withColumn("over_limit", F.col("n_tokens") > OVER_LIMIT)

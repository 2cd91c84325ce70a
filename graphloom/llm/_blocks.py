"""Blocks of documents, and packed sorted key lists that travel between them.

``blocked`` deals documents into blocks of neighbouring doc_ids with a bounded
number of bytes each.  Operators that look for repeats compute keys per block,
drop repeats inside the block, and send each distinct key once, packed by
``pack``; answers come back as one bit per key in the order sent.  A very
frequent key therefore costs one entry per block, never one per occurrence.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20
MOST_BLOCKS = 1 << 18  # from 2 TB on blocks grow instead of their number
_CELLS = 4096
_ROUNDS = 6


class Blocks(NamedTuple):
    """rows: doc_id, text, block, and rest if given; total: bytes; n_null: how many blocks, the first ones, hold the rows with null doc_id; block_of: the block column of an id column."""

    rows: DataFrame
    total: int
    n_null: int
    block_of: Callable[[str], Column]


class _Cells:
    """A partition of the ids into numbered cells of neighbouring ids, as columns: each round cuts the cells of the one before into equal widths."""

    def __init__(self, lo: int, hi: int):
        self.rounds = [([lo], [(hi - lo) // _CELLS + 1], [0])]
        self.far = hi - lo >= 2**62
        self.n = _CELLS

    def of(self, c: str) -> Column:
        cell = None
        for lo, width, base in self.rounds:
            if cell is None:
                away = f"cast({c} as decimal(20,0)) - ({lo[0]})" if self.far else f"{c} - ({lo[0]})"
                cell = F.expr(f"cast(floor(({away}) / {width[0]}) as int)" if self.far else f"cast(({away}) div {width[0]}L as int)")
            else:
                at = lambda x, cell=cell: F.element_at(_long_array(x), cell + 1)
                cell = (at(base) + F.call_function("div", F.col(c) - at(lo), at(width))).cast("int")
        return cell

    def refine(self, sizes: dict[int, tuple[int, int, int]], most: int) -> bool:
        """Cuts the cells (bytes, least and largest id) with more than ``most`` bytes; whether there were any."""
        lo, width, base, n, cut = [], [], [], 0, False
        for c in range(self.n):
            size, a, b = sizes.get(c, (0, 0, 0))
            pieces = min(_CELLS, -(-4 * size // most)) if size > most and b > a else 1
            cut |= pieces > 1
            lo.append(a)
            width.append((b - a) // pieces + 1)
            base.append(n)
            n += pieces
        if cut:
            self.rounds.append((lo, width, base))
            self.n = n
        return cut


def blocked(docs: DataFrame, block_bytes: int = BLOCK_BYTES, rest: Column | None = None) -> Blocks:
    """The documents in blocks of about block_bytes each.

    Block numbers grow with doc_id, so a smaller block holds smaller ids; rows
    with null doc_id come first, dealt by their text to as many blocks as they
    need.  Rows of equal doc_id share a block.  Blocks are cut from the bytes of
    cells of ids; cells that hold too much are cut again between their own least
    and largest ids, so that far outliers or crowded ids make no large block.
    The cells' sums, a few for each block, are all that reaches the driver.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([rest.alias("rest")] if rest is not None else []))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    lo, hi, total, nulls = src.agg(F.min("doc_id"), F.max("doc_id"), F.sum(size), F.sum(F.when(F.col("doc_id").isNull(), size))).first()
    total, nulls = total or 0, nulls or 0
    block_bytes = max(block_bytes, total // MOST_BLOCKS)
    cells = _Cells(*((0, 0) if lo is None else (lo, hi)))
    for left in range(_ROUNDS, 0, -1):
        got = src.where("doc_id is not null").groupBy(cells.of("doc_id").alias("c")).agg(F.sum(size).alias("n"), F.min("doc_id"), F.max("doc_id")).collect()
        sizes = {c: (n, a, b) for c, n, a, b in got}
        if left == 1 or not cells.refine(sizes, 2 * block_bytes):
            break
    n_bytes = np.zeros(cells.n, np.int64)
    for c, (n, _, _) in sizes.items():
        n_bytes[c] = n
    n_null = -(-nulls // block_bytes)
    number = np.unique((np.cumsum(n_bytes) - n_bytes) // block_bytes, return_inverse=True)[1] + n_null

    def block_of(c: str) -> Column:
        return F.element_at(_long_array(number.tolist()), cells.of(c) + 1).cast("int")

    block = block_of("doc_id")
    if n_null:
        block = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(n_null)).cast("int")).otherwise(block)
    return Blocks(src.withColumn("block", block), total, n_null, block_of)


def _long_array(values: list[int]) -> Column:
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<long>")


NULL_ID = -(2**63)


def in_order(table):
    """Rows of one block by (doc_id, text); the same order in every pass."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def ids_of(table) -> np.ndarray:
    """The doc_ids of one block, where either all rows have one or none."""
    return pc.fill_null(table.column("doc_id"), NULL_ID).to_numpy()


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes, whole rows each."""
    per_row = max(1, batch.nbytes // max(1, batch.num_rows))
    step = max(1, most // per_row)
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def pieces(offsets: np.ndarray, most: int = 1 << 20) -> list[tuple[int, int]]:
    """The documents of a flat column as ranges (from, to) of about ``most`` bytes, whole documents each; one range at least."""
    n = len(offsets) - 1
    cuts = np.unique(np.searchsorted(offsets[:-1], np.arange(0, int(offsets[-1]) + 1, most))).tolist()
    cuts = [c for c in cuts if 0 < c < n]
    return list(zip([0, *cuts], [*cuts, n], strict=True))


def give_back() -> None:
    """Returns freed memory of this worker to the system; else it keeps the most that any group needed for as long as it lives."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """f on a group, which leaves no freed memory with the worker."""

    def run(table: pa.Table) -> pa.Table:
        out = f(table)
        give_back()
        return out

    return run


def lean_two(f: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """As ``lean``, on cogroups."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        give_back()
        return out

    return run


def pack(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as differences of as many bytes as the largest needs."""
    if not len(keys):
        return b""
    gaps = np.diff(keys, prepend=np.uint64(0))
    first, rest = gaps[:1], gaps[1:]
    width = max(1, (int(rest.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + first.tobytes() + np.ascontiguousarray(rest.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width = data[0]
    body = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    gaps = np.zeros((len(body) + 1, 8), np.uint8)
    gaps[0] = np.frombuffer(data, np.uint8, 8, 1)
    gaps[1:, :width] = body
    return np.cumsum(gaps.reshape(-1).view(np.uint64), dtype=np.uint64)


def runs(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of each run of equal values."""
    if not len(values):
        return []
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return [(int(values[a]), a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def covered(n: int, starts: np.ndarray, length) -> np.ndarray:
    """Which of n places lie in [start, start + length) of any start."""
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + length, n), minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each (-1: none); all places jump at once along what others have found."""
    n = len(values)
    found = np.arange(-1, n - 1, dtype=np.int64)
    open_ = np.flatnonzero(found >= 0)
    while len(open_):
        open_ = open_[values[found[open_]] >= values[open_]]
        found[open_] = found[found[open_]]
        open_ = open_[found[open_] >= 0]
    return found

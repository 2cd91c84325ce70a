"""Operator 10, suffix-array dedup by longest-previous-factor arrays over bytes.

A byte goes if a string of ``length`` bytes covers it that also starts earlier
(smaller doc_id, or same document and earlier start).  ``previous_factors`` sorts
suffixes (rank doubling, ties by position), finds for each the nearest suffixes
above and below it in that order that start earlier (previous and next smaller
positions), and takes the longer of the two common prefixes: the longest previous
factor.  A string of ``length`` bytes is repeated from earlier exactly where that
is at least ``length``; longer prefixes aren't told apart.

Sorting all suffixes of a corpus together is out of reach, so they are split
into groups that still hold every earlier occurrence that matters:

1. Anchors.  Every window of ``length`` bytes picks its least-hashed GRAM-byte
   substring (all of them, on ties).  Equal windows pick equal anchors, so a
   window can be repeated only if its anchor is; anchors met once are dropped.
2. Surroundings.  A repeated anchor brings along the bytes that windows with it
   can reach; equal surroundings are kept once, the later ones being repeats.
   They are dealt by their anchor to groups, whose number follows from the most
   that a corpus of that size can send.
3. Longer anchors.  An anchor with more than OFTEN occurrences (such as a line
   that a third of all documents share) is lengthened before it is dealt: the
   windows around it are halved by where they start, and the bytes that all
   windows of a half have in common are its longer anchor (``node_range``).
   Inside a group an anchor is lengthened the same way, as often as it takes,
   until its surroundings fit into CHUNK_BYTES; at the end the anchor is the
   window, of which one surrounding is left.  Nothing is capped, and all go
   through the same arrays.

Rows of equal doc_id are parts of one document, ordered by text; null doc_id
comes first, its rows in a fixed order of their own.  Null and empty texts have no bytes; texts shorter than ``length``
lose nothing; a very long text is one row of its block and must fit into a
worker's memory; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import _text as tx
from graphloom.llm._blocks import bits, blocked, in_order, nearest_smaller, pack, runs, unbits, unpack

LENGTH = 100
GRAM = 32
OFTEN = 4096
HALVINGS = 2  # of frequent anchors, before they are dealt
GROUP_KEYS = 3_000_000
GROUP_BYTES = 20 << 20
CHUNK_BYTES = 1 << 20  # sorted at once, at about 80 bytes of arrays a byte
BLOCK_BYTES = 4 << 20
MOST_SENT = 5  # bytes of surroundings a byte of text: two anchors in 70 bytes, 168 bytes each
_PIECE = 1 << 17
_TOP = np.uint64(2**64 - 1)


def _roll(buf: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` bytes, by doubling."""
    h, p, n, out, done = tx._TABLE[buf], int(tx._P), 1, None, 0
    while True:
        if size & n:
            # the runs of n bytes that follow those done so far
            out = h if out is None else out[: len(h) - done] * np.uint64(p) + h[done:]
            done += n
        if 2 * n > size:
            return tx.mix(out)
        h = h[: len(h) - n] * np.uint64(p) + h[n:]
        p, n = p * p % 2**64, 2 * n


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x, size = op(x[: len(x) - size], x[size:]), 2 * size
    return op(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are least in some window of ``length`` bytes."""
    width, n = length - gram + 1, len(buf) - gram + 1
    places, hashes = [], []
    for a in range(0, max(0, n), _PIECE):
        b = min(n, a + _PIECE)
        lo, hi = max(0, a - width + 1), min(n, b + width - 1)
        h = _roll(buf[lo : hi + gram - 1], gram)
        ends = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, hi + gram)]
        crossing = (ends[:, None] - np.arange(1, gram) - lo).ravel()
        h[crossing[(crossing >= 0) & (crossing < len(h))]] = _TOP
        if len(h) < width:
            continue
        least = _slide(h, width, np.minimum)
        pad = np.zeros(width - 1, np.uint64)
        best = _slide(np.concatenate([pad, least, pad]), width, np.maximum)
        at = np.flatnonzero((best == h) & (h != _TOP))
        at = at[(at + lo >= a) & (at + lo < b)]
        places.append(at + lo)
        hashes.append(h[at])
    return (np.concatenate(places), np.concatenate(hashes)) if places else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


class _Prefixes:
    """Ranks of the prefixes of 8, 16, 32 ... bytes of all suffixes of a text, and common prefixes from them."""

    def __init__(self, text: np.ndarray, length: int):
        n = len(text)
        packed = np.zeros(n + length + 8, np.uint64)
        packed[:n] = text
        for size in (1, 2, 4):
            packed[: n + length] = packed[: n + length] << np.uint64(8 * size) | packed[size : n + length + size]
        self.packed, self.length = packed[: n + length], length
        self.ranks = {8: self._ranked(self.packed)}
        size = 8
        while 2 * size <= length:
            self.ranks[2 * size] = self._ranked(self.pairs(np.arange(n + length), size, size))
            size *= 2
        self.size = size

    @staticmethod
    def _ranked(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        rank = np.empty(len(keys), np.int32)
        step = np.empty(len(keys), np.int32)
        step[:1] = 0
        ordered = keys[order]
        step[1:] = ordered[1:] != ordered[:-1]
        rank[order] = np.cumsum(step, dtype=np.int32)
        return rank

    def pairs(self, at: np.ndarray, size: int, apart: int) -> np.ndarray:
        """One number for the prefix of apart + size bytes (apart <= size) of each suffix."""
        rank = self.ranks[size]
        # beyond the text there are ``length`` zeros; what lies beyond them tells no suffix of the text from another
        return rank[at].astype(np.uint64) << np.uint64(32) | rank[np.minimum(at + apart, len(rank) - 1)].astype(np.uint64)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at a and b share, at most ``length``."""
        n = np.zeros(len(a), np.int64)
        for size in sorted(self.ranks, reverse=True):
            rank = self.ranks[size]
            n += size * (rank[np.minimum(a + n, len(rank) - 1)] == rank[np.minimum(b + n, len(rank) - 1)])
        for size in (4, 2, 1):
            x, y = np.minimum(a + n, len(self.packed) - 1), np.minimum(b + n, len(self.packed) - 1)
            n += size * (((self.packed[x] ^ self.packed[y]) >> np.uint64(64 - 8 * size)) == 0)
        return np.minimum(n, self.length)


def previous_factors(text: np.ndarray, starts: np.ndarray, positions: np.ndarray, length: int) -> np.ndarray:
    """The longest previous factor, at most ``length``, of each suffix text[start:] (of ``length`` bytes or more).

    positions: where the suffix stands in the corpus; the same place may occur in text twice.
    """
    out = np.zeros(len(starts), np.int64)
    if not len(starts):
        return out
    p = _Prefixes(text, length)
    order = np.lexsort((positions, p.pairs(starts, p.size, length - p.size)))
    sa, at = starts[order], positions[order]
    before = nearest_smaller(at)
    after = len(at) - 1 - nearest_smaller(at[::-1])[::-1]
    longest = np.zeros(len(sa), np.int64)
    for other, known in ((before, before >= 0), (after, after < len(at))):
        longest[known] = np.maximum(longest[known], p.common(sa[known], sa[other[known]]))
    out[order] = longest
    return out


def node_range(node: int, reach: int) -> tuple[int, int]:
    """Least and largest start, from the anchor's own, of the windows of a node: 1 has all of -reach to 0, 2 n and 2 n + 1 its halves."""
    lo, hi = -reach, 0
    for bit in bin(node)[3:]:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if bit == "1" else (lo, mid)
    return lo, hi


class _Anchors:
    """The anchors of one block and its distinct ones by group and key."""

    def __init__(self, table: pa.Table, length: int, groups: int):
        self.buf, self.offsets = tx.flat(table.column("text"))
        self.at, h = anchors(self.buf, self.offsets, length)
        h = tx.mix(h ^ tx.U64(0x5851F42D4C957F2D))  # least hashes are small: spread them evenly over the groups
        where = ((h >> tx.U64(40)).astype(np.int64) * groups) >> 24
        order = np.argsort(h, kind="stable")  # by group, as that is the top of the hash
        h, where = h[order], where[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = h[1:] != h[:-1]
        self.key = np.empty(len(h), np.int64)
        self.key[order] = np.cumsum(fresh) - 1
        self.hash, self.where = h[fresh], where[fresh]
        self.count = np.diff(np.append(np.flatnonzero(fresh), len(h)))
        self.groups = {g: (a, b) for g, a, b in runs(self.where)}


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _send_anchors(length: int, groups: int):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        a = _Anchors(in_order(table), length, groups)
        rows = [(g, block, pack(a.hash[x:y]), np.minimum(a.count[x:y], 255).astype(np.uint8).tobytes()) for g, (x, y) in a.groups.items()]
        return _rows(rows, ["grp", "block", "keys", "n"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()])

    return run


def _repeated(most: int):
    """Per block and group: which anchors occur twice or more anywhere, and which of them more than ``most`` times."""

    def run(table: pa.Table) -> pa.Table:
        keys = [unpack(x.as_buffer().to_pybytes()) for x in table.column("keys")]
        sizes = np.cumsum([len(x) for x in keys])[:-1]
        count = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("n")])
        inverse = np.unique(np.concatenate(keys), return_inverse=True)[1]
        total = np.bincount(inverse, count)[inverse]
        flags = [[bits(x) for x in np.split(f, sizes)] for f in (total > 1, total > most)]
        return pa.table([table.column("grp").cast(pa.int64()), table.column("block").cast(pa.int32()), pa.array(flags[0], pa.binary()), pa.array(flags[1], pa.binary())], names=["grp", "block", "again", "often"])

    return run


def _spans(starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Union of intervals, as uint32 pairs."""
    if not len(starts):
        return b""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    return np.stack([s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]], 1).astype(np.uint32).tobytes()


class _Around:
    """Surroundings: bytes data[at : at + size] that stand at (block, start), with the anchor ``left`` bytes in; node: which windows they are for."""

    names = ("block", "start", "at", "size", "left", "node")

    def __init__(self, data: np.ndarray, length: int, **columns: np.ndarray):
        self.data, self.length, self.reach = data, length, length - GRAM
        self.columns = {k: columns[k].astype(np.int64) for k in self.names}

    def __getattr__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def __len__(self) -> int:
        return len(self.columns["at"])

    def take(self, i: np.ndarray) -> _Around:
        return _Around(self.data, self.length, **{k: v[i] for k, v in self.columns.items()})

    def halved(self) -> _Around:
        """Each of them as two, for the lower and the upper half of its windows, with longer anchors."""
        out = []
        for node in np.unique(self.node).tolist():
            mine = self.take(np.flatnonzero(self.node == node))
            if len(set(node_range(node, self.reach))) == 1:  # a single window
                out.append(mine)
                continue
            for child in (2 * node, 2 * node + 1):
                lo, hi = node_range(child, self.reach)
                a = np.maximum(mine.left + lo, 0)
                b = np.minimum(mine.left + hi + self.length, mine.size)
                ok = np.flatnonzero(b - a >= self.length)
                out.append(_Around(self.data, self.length, block=mine.block[ok], start=(mine.start + a)[ok], at=(mine.at + a)[ok], size=(b - a)[ok], left=(mine.left - a)[ok], node=np.full(len(ok), child)))
        return _Around(self.data, self.length, **{k: np.concatenate([x.columns[k] for x in out]) for k in self.names}) if out else self

    def keys(self) -> np.ndarray:
        """A hash of each one's anchor, as long as its node has it."""
        out = np.zeros(len(self), np.uint64)
        for node in np.unique(self.node).tolist():
            lo, hi = node_range(node, self.reach)
            mine = np.flatnonzero(self.node == node)
            mine = mine[np.argsort((self.at + self.left)[mine], kind="stable")]
            p = (self.at + self.left)[mine]
            out[mine] = tx.mix(tx.word_hashes(self.data, p + hi, p + lo + self.length) ^ np.uint64(node))
        return out

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Which have the same bytes around the same place of the anchor as one before them, in corpus order, and the others."""
        order = np.lexsort((self.start, self.block))
        raw = self.data.tobytes()
        seen: set[tuple[bytes, int, int]] = set()
        again = np.zeros(len(self), bool)
        for i, at, size, left, node in zip(order.tolist(), *(self.columns[k][order].tolist() for k in ("at", "size", "left", "node")), strict=True):
            n = len(seen)
            seen.add((raw[at : at + size], left, node))
            again[i] = len(seen) == n
        return np.flatnonzero(again), np.flatnonzero(~again)


def _send_surroundings(length: int, groups: int, parts: int):
    """Rows (grp, block, data, meta): surroundings by group, and the spans that repeat inside the block (grp < 0)."""

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        block = docs.column("block")[0].as_py()
        a = _Anchors(in_order(docs), length, groups)
        again, often = np.zeros(len(a.hash), bool), np.zeros(len(a.hash), bool)
        for g, x, y in zip(marks.column("grp").to_pylist(), marks.column("again").to_pylist(), marks.column("often").to_pylist(), strict=True):
            lo, hi = a.groups[g]
            again[lo:hi], often[lo:hi] = unbits(x, hi - lo), unbits(y, hi - lo)
        at = np.flatnonzero(again[a.key])
        key, at = a.key[at], a.at[at]
        doc = np.searchsorted(a.offsets, at, "right") - 1
        lo, hi = np.maximum(at - (length - GRAM), a.offsets[doc]), np.minimum(at + length, a.offsets[doc + 1])
        ok = hi - lo >= length
        key, at, lo, hi = key[ok], at[ok], lo[ok], hi[ok]
        around = _Around(a.buf, length, block=np.zeros(len(at)), start=lo, at=lo, size=hi - lo, left=at - lo, node=np.ones(len(at)))
        later, first = around.distinct()
        spans = [(lo[later], hi[later])]
        hot = often[key[first]]
        kept = around.take(first[~hot])
        if hot.any():
            longer = around.take(first[hot])
            for _ in range(HALVINGS):
                longer = longer.halved()
            later, first = longer.distinct()
            spans.append((longer.start[later], (longer.start + longer.size)[later]))
            kept = _Around(a.buf, length, **{k: np.concatenate([kept.columns[k], longer.columns[k][first]]) for k in _Around.names})
        rows = [(-1 - block, block, _spans(*(np.concatenate(x) for x in zip(*spans, strict=True))), b"")]
        where = ((kept.keys() >> tx.U64(40)).astype(np.int64) * parts) >> 24
        order = np.lexsort((kept.start, where))
        kept, where, raw = kept.take(order), where[order], a.buf.tobytes()
        for g, x, y in runs(where):
            mine = kept.take(np.arange(x, y))
            meta = np.stack([mine.start, mine.size, mine.left, mine.node], 1).astype(np.uint32)
            rows.append((g, block, b"".join([raw[s:e] for s, e in zip(mine.at.tolist(), (mine.at + mine.size).tolist(), strict=True)]), meta.tobytes()))
        return _rows(rows, ["grp", "block", "data", "meta"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()])

    return run


def _settle(length: int, chunk: int):
    """Spans of each block that repeat earlier ones, from one group of _send_surroundings."""
    names, types = ["block", "spans"], [pa.int32(), pa.binary()]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending")])
        if table.column("grp")[0].as_py() < 0:
            return _rows(list(zip(table.column("block").to_pylist(), table.column("data").to_pylist(), strict=True)), names, types)
        blocks = table.column("block").to_numpy()
        meta = [np.frombuffer(x.as_buffer(), np.uint32).reshape(-1, 4) for x in table.column("meta")]
        owner = np.repeat(np.arange(len(blocks)), [len(x) for x in meta])
        start, size, left, node = np.concatenate(meta).astype(np.int64).T
        data = tx.flat(table.column("data"))[0]
        around = _Around(data, length, block=owner, start=start, at=np.cumsum(size) - size, size=size, left=left, node=node)
        found = [np.zeros((0, 3), np.int64), *_settled(around, chunk)]
        found = np.concatenate(found)
        found = found[np.argsort(found[:, 0], kind="stable")]
        return _rows([(int(blocks[b]), _spans(found[x:y, 1], found[x:y, 2])) for b, x, y in runs(found[:, 0])], names, types)

    return run


def _settled(around: _Around, chunk: int) -> Iterator[np.ndarray]:
    """Rows (block, start, end) of what starts earlier, anchor by anchor in chunks of about ``chunk`` bytes."""
    todo = [around]
    while todo:
        around = todo.pop()
        later, first = around.distinct()
        yield np.stack([around.block[later], around.start[later], (around.start + around.size)[later]], 1)
        around = around.take(first)
        key = around.keys()
        order = np.argsort(key, kind="stable")
        around, key = around.take(order), key[order]
        head = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        size = np.diff(np.append(head, len(key)))
        n_bytes = np.add.reduceat(around.size, head) if len(head) else head
        large = (size > 1) & (n_bytes > chunk)
        # one surrounding alone has nothing to repeat: a window that comes twice in it has an anchor twice
        fits = (size > 1) & ~large
        if large.any():
            todo.append(around.take(np.flatnonzero(np.repeat(large, size))).halved())
        number = np.cumsum(np.where(fits, n_bytes, 0)) // chunk
        of = np.where(np.repeat(fits, size), np.repeat(number, size), -1)
        for g in np.unique(of[of >= 0]).tolist():
            yield _repeats(around.take(np.flatnonzero(of == g)))


def _repeats(around: _Around) -> np.ndarray:
    length, n = around.length, around.size
    begin = np.cumsum(n) - n
    step = np.arange(n.sum()) - np.repeat(begin, n)
    text = around.data[np.repeat(around.at, n) + step]
    ok = step <= np.repeat(n - length, n)
    starts = np.flatnonzero(ok)
    place = (np.repeat(around.block << 40 | around.start, n) + step)[ok]
    hit = place[previous_factors(text, starts, place, length) >= length]
    return np.stack([hit >> 40, hit & ((1 << 40) - 1), (hit & ((1 << 40) - 1)) + length], 1)


def _drop(docs: pa.Table, spans: pa.Table) -> pa.Table:
    docs = in_order(docs)
    buf, offsets = tx.flat(docs.column("text"))
    gone = np.zeros(len(buf), bool)
    for x in spans.column("spans").to_pylist():
        for s, e in np.frombuffer(x, np.uint32).reshape(-1, 2).tolist():
            gone[s:e] = True
    n_removed, n_spans, digests = [], [], []
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        mine = gone[s:e]
        n_removed.append(int(np.count_nonzero(mine)))
        n_spans.append(int(np.count_nonzero(mine[1:] & ~mine[:-1]) + mine[0]) if n_removed[-1] else 0)
        digests.append(hashlib.sha256(buf[s:e][~mine] if n_removed[-1] else buf[s:e]).hexdigest())
    out = [docs.column("doc_id"), np.diff(offsets), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())]
    return pa.table(out, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup_bytes(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, group_keys: int = GROUP_KEYS, group_bytes: int = GROUP_BYTES, often: int = OFTEN, chunk: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs (doc_id, text)."""
    if length < 2 * GRAM:
        raise ValueError(f"strings of {2 * GRAM} bytes or more")
    parts, total, _, _ = blocked(docs, block_bytes)
    groups = max(1, -(-total // (16 * group_keys)))
    fine = max(1, MOST_SENT * total // group_bytes)
    sent = parts.groupBy("block").applyInArrow(_send_anchors(length, groups), "grp long, block int, keys binary, n binary")
    marks = sent.groupBy("grp").applyInArrow(_repeated(often), "grp long, block int, again binary, often binary")
    around = parts.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_send_surroundings(length, groups, fine), "grp long, block int, data binary, meta binary")
    spans = around.groupBy("grp").applyInArrow(_settle(length, chunk), "block int, spans binary")
    return parts.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_drop, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Operator 2, substring dedup: prefix-partitioned suffix trees over words.

The corpus is a string of words; a suffix starts at each word.  A repeat of at
least ``k`` words is an internal node of the suffix tree at depth k or more.

* Partition.  A suffix of k words is dealt by a prefix of the suffix that starts
  at its anchor, the least-hashed run of GRAM words among its first k: equal
  suffixes have equal anchors, and neighbouring ones mostly share theirs, so they
  stay together and travel as one run of words.  The prefix is the sequence of
  the classes (CLASSES of them, by hash) of the anchor's first words.  One pass
  counts prefixes; ``prefix_groups`` lengthens just those prefixes whose suffixes
  would not fit in memory, so prefixes vary in length; where DEPTH words are
  still too few, the prefix is all k words of each suffix itself.  Whichever the
  prefix, suffixes with the same first k words meet in one group.
* Leaves of their own.  A suffix whose anchor (or, with the longest prefix, whose
  k words) no other block has hangs on no node of depth k.  Blocks send short
  codes of these, and only suffixes whose code another block has go on.
* Subtrees.  Those suffixes travel as words, down to depth k: a block sends each
  distinct one once, as places in a dictionary of the words it uses.  A group
  sorts its suffixes by their words, takes the longest common prefixes of
  neighbours and from them the internal nodes (``SubTree``).  Nodes of depth k
  are repeats; each marks its suffixes in all blocks but the first.
* Removal.  Blocks follow doc_id, so suffixes of later blocks go; inside a block
  the smallest doc_id is known.  Neighbouring marked suffixes merge into maximal
  repeats when words are dropped.

Suffixes are compared by their words, not by hashes: what removes a word is a
node of a tree, or equal words inside a block.  A passage in every document
costs one suffix a block.  Rows with equal doc_id count as one document's parts.
Null doc_id sorts first (it is a document of its own id, whose rows may fill
several blocks), null and empty texts have no words, texts of fewer than k words
lose nothing; a very long text is one row of its block and must fit into a
worker's memory; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.llm import _text as tx
from graphloom.llm._blocks import bits, blocked, covered, give_back, ids_of, in_order, lean, lean_two, nearest_smaller, pack, pieces, runs, slices, unbits, unpack

WINDOW = 13
GROUP_KEYS = 1_000_000
GRAM = 5  # words of an anchor
DEPTH = 4  # words in the longest prefix but that of all k
CLASSES = 16
CODE_BITS = 28  # of an anchor within its group


def prefix_groups(counts: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """Group of each longest prefix, and the number of groups.

    counts: suffixes by longest prefix (CLASSES ** DEPTH cells).  A prefix is
    lengthened only while it has more than ``most`` suffixes; short neighbouring
    prefixes share a group.  One of DEPTH words that has more gets several groups,
    numbered from its own on, dealt by all k words.
    """
    total = np.concatenate([[0], np.cumsum(counts)])
    group, state = np.zeros(len(counts), np.int64), [0, 0]  # next group, filled

    def walk(at: int, size: int) -> None:
        n = int(total[at + size] - total[at])
        if n > most and size > 1:
            for i in range(CLASSES):
                walk(at + i * size // CLASSES, size // CLASSES)
            return
        if state[1] and state[1] + n > most:
            state[:] = [state[0] + 1, 0]
        group[at : at + size] = state[0]
        state[1] += n
        if n > most:
            state[:] = [state[0] + -(-n // most), 0]

    walk(0, len(counts))
    return group, state[0] + 1


class SubTree:
    """The suffix tree of some suffixes, each a row of k words (numbers).

    order: the rows in suffix order; shared: how many words each of them has in
    common with the one before; depth, first, last: the internal nodes, as the
    words on their path and the leaves from first to last (in suffix order).
    """

    def __init__(self, words: np.ndarray):
        n, k = words.shape
        bits_of = max(1, int(words.max(initial=0)).bit_length())
        per = 63 // bits_of
        columns = []
        for a in range(0, k, per):
            packed = np.zeros(n, np.int64)
            for j in range(a, min(k, a + per)):
                packed = packed << bits_of | words[:, j]
            columns.append(packed)
        self.order = np.lexsort(columns[::-1])
        ordered = words[self.order]
        self.shared = np.zeros(n, np.int64)
        running = np.ones(max(0, n - 1), bool)
        for j in range(k):
            running &= ordered[1:, j] == ordered[:-1, j]
            self.shared[1:] += running
        lo = nearest_smaller(self.shared)
        hi = n - nearest_smaller(self.shared[::-1])[::-1]
        at = np.flatnonzero(self.shared > 0)
        node = np.unique(np.stack([np.maximum(lo[at], 0), hi[at] - 2, self.shared[at]], 1), axis=0) if len(at) else np.zeros((0, 3), np.int64)
        self.first, self.last, self.depth = node.T

    def later(self, blocks: np.ndarray, k: int) -> np.ndarray:
        """Rows under nodes of depth k whose block is not the first of their node."""
        out = np.zeros(len(self.order), bool)
        deep = np.flatnonzero(self.depth >= k)
        size = (self.last - self.first + 1)[deep]
        leaf = np.repeat(self.first[deep], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        row = self.order[leaf]
        if len(deep):
            least = np.minimum.reduceat(blocks[row], np.cumsum(size) - size)
            out[row] = blocks[row] > np.repeat(least, size)
        return out


class _Windows:
    """The windows (suffixes of k words or more) of one block, their anchors and their groups; made in pieces of whole documents, so that what is only needed on the way stays small."""

    def __init__(self, table: pa.Table, k: int, group: np.ndarray | None = None, share: np.ndarray | None = None, anchored: bool = True):
        self.k = k
        self.buf, self.offsets = tx.flat(table.column("text"))
        self.ids = ids_of(table)
        self.n_words, first, parts = 0, [np.zeros(1, np.int64)], []
        for a, b in pieces(self.offsets):
            buf, offsets = self.buf[self.offsets[a] : self.offsets[b]], self.offsets[a : b + 1] - self.offsets[a]
            starts, ends, first_here = tx.word_bounds(buf, offsets)
            words = tx.word_hashes(buf, starts, ends)
            high = tx.windows(words, k)
            at = np.flatnonzero(tx.inside(first_here, len(high), k)) if len(high) else np.zeros(0, np.int64)
            part = {"at": at + self.n_words, "hash": high[at]}
            if anchored:
                part |= self._anchored(words, at, part["hash"], group, share)
            parts.append(part)
            first.append(first_here[1:] + self.n_words)
            self.n_words += len(words)
        self.first = np.concatenate(first)
        for c in list(parts[0]):
            setattr(self, c, np.concatenate([x.pop(c) for x in parts]))

    def _anchored(self, words: np.ndarray, at: np.ndarray, hashes: np.ndarray, group: np.ndarray | None, share: np.ndarray | None) -> dict[str, np.ndarray]:
        """The prefix of each window (at its anchor), or where that sends it, and its code there."""
        n = max(0, len(words) - self.k + 1)
        grams = tx.windows(words, GRAM)
        anchor, least = np.zeros(n, np.int64), grams[:n].copy()
        for j in range(1, self.k - GRAM + 1):  # the first of the least
            here = grams[j : j + n]
            less = here < least
            least[less], anchor[less] = here[less], j
        anchor = (np.arange(n) + anchor)[at]
        prefix = np.zeros(len(words), np.int64)
        for j in range(min(DEPTH, len(words))):
            prefix[: len(words) - j] = prefix[: len(words) - j] * CLASSES + (words[j:] >> tx.U64(60)).astype(np.int64)
        prefix = prefix[anchor]
        if group is None:
            return {"prefix": prefix}
        shared = share[prefix]
        where = group[prefix] + (((hashes >> tx.U64(40)).astype(np.int64) * shared) >> 24)
        return {"where": where, "code": np.where(shared > 1, hashes, least[at]) & tx.U64((1 << CODE_BITS) - 1)}

    def coded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group and code of the distinct ones in order, and which of them each window has."""
        head = np.ones(len(self.at), bool)  # neighbours mostly have the same
        head[1:] = (self.where[1:] != self.where[:-1]) | (self.code[1:] != self.code[:-1])
        where, code = self.where[head], self.code[head]
        order = np.lexsort((code, where))
        where, code = where[order], code[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (where[1:] != where[:-1]) | (code[1:] != code[:-1])
        key = np.empty(len(order), np.int64)
        key[order] = np.cumsum(fresh) - 1
        return where[fresh], code[fresh], key[np.cumsum(head) - 1]

    def words_of(self, i: int) -> list[bytes]:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes().split()

    def word_numbers(self) -> np.ndarray:
        """The number of each word of the block, the same for the same bytes only."""
        self.dictionary = known = {}
        text = (w for i in range(len(self.offsets) - 1) for w in self.words_of(i))
        return np.fromiter((known.setdefault(w, len(known)) for w in text), np.int32, self.n_words)

    def same(self, numbers: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Some windows (indexes) with equal ones beside each other, in order of place, and which of them have no equal one before."""
        order = some[np.argsort(self.hash[some], kind="stable")]
        equal = self.hash[order[1:]] == self.hash[order[:-1]]
        a, b = self.at[order[1:][equal]], self.at[order[:-1][equal]]
        if not all((numbers[a + j] == numbers[b + j]).all() for j in range(self.k)):  # equal hashes of different words
            order = some[np.lexsort([numbers[self.at[some] + j] for j in range(self.k)])]
            equal = np.ones(max(0, len(order) - 1), bool)
            for j in range(self.k):
                equal &= numbers[self.at[order[1:]] + j] == numbers[self.at[order[:-1]] + j]
        return order, np.concatenate([np.ones(min(1, len(order)), bool), ~equal])


def _count(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES**DEPTH, np.int64)
        for b in batches:
            for piece in slices(b):
                counts += np.bincount(_Windows(pa.Table.from_batches([piece]), k).prefix, minlength=len(counts))
        cells = np.flatnonzero(counts)
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(counts[cells], pa.int64())], ["prefix", "n"])

    return run


def _send_codes(k: int, group: np.ndarray, share: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        where, code, _ = _Windows(in_order(table), k, group, share).coded()
        return _table([(g, block, pack(code[a:b])) for g, a, b in runs(where)], ["grp", "block", "codes"], [pa.int64(), pa.int32(), pa.binary()])

    return run


def _shared_codes(table: pa.Table) -> pa.Table:
    """For each block of a group, which of its codes another block has, too."""
    codes = [unpack(x.as_buffer().to_pybytes()) for x in table.column("codes")]
    sizes = np.cumsum([len(x) for x in codes])[:-1]
    codes = np.concatenate(codes)
    order = np.argsort(codes)
    same = codes[order[1:]] == codes[order[:-1]]
    again = np.zeros(len(codes), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    return pa.table({"grp": table.column("grp").cast(pa.int64()), "block": table.column("block").cast(pa.int32()), "again": pa.array([bits(x) for x in np.split(again, sizes)], pa.binary())})


def _send_suffixes(k: int, group: np.ndarray, share: np.ndarray):
    """Rows (grp, block, runs, dictionary, words) of the distinct suffixes whose code another block has, too: runs of neighbours by first place and number."""

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        block = docs.column("block")[0].as_py()
        w = _Windows(in_order(docs), k, group, share)
        where, _, key = w.coded()
        again = np.zeros(len(where), bool)
        bounds = {g: (a, b) for g, a, b in runs(where)}
        for g, m in zip(marks.column("grp").to_pylist(), marks.column("again").to_pylist(), strict=True):
            a, b = bounds[g]
            again[a:b] = unbits(m, b - a)
        numbers = w.word_numbers()
        known = np.array([*w.dictionary, b""], object)
        order, fresh = w.same(numbers, np.flatnonzero(again[key]))
        some = np.sort(order[fresh])
        at, grp = w.at[some], w.where[some]
        head = np.ones(len(some), bool)
        head[1:] = (at[1:] != at[:-1] + 1) | (some[1:] != some[:-1] + 1) | (grp[1:] != grp[:-1])
        head = np.flatnonzero(head)
        n = np.diff(np.append(head, len(some)))
        place, at, grp = some[head], at[head], grp[head]
        order = np.lexsort((place, grp))
        place, at, n = place[order], at[order], n[order]
        rows = []
        for g, a, b in runs(grp[order]):
            size = n[a:b] + k - 1
            spots = np.repeat(at[a:b] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            used, words = np.unique(numbers[spots], return_inverse=True)
            words = words.astype(np.uint16 if len(used) < 1 << 16 else np.uint32)
            rows.append((g, block, np.stack([place[a:b], n[a:b]], 1).astype(np.uint32).tobytes(), b" ".join(known[used]), words.tobytes()))
        return _table(rows, ["grp", "block", "runs", "dictionary", "words"], [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])

    return run


def _subtree(k: int, n_null: int):
    """The places in each block whose suffixes start in an earlier one, from one group's tree."""

    def run(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_numpy()
        known: dict[bytes, int] = {}
        rows, places = [], []
        for d, x, r in zip(table.column("dictionary"), table.column("words"), table.column("runs"), strict=True):
            mine = np.fromiter((known.setdefault(w, len(known)) for w in d.as_buffer().to_pybytes().split(b" ")), np.int32)
            text = mine[np.frombuffer(x.as_buffer(), np.uint16 if len(mine) < 1 << 16 else np.uint32)]
            first, n = np.frombuffer(r.as_buffer(), np.uint32).astype(np.int64).reshape(-1, 2).T
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            size = n + k - 1
            rows.append(text[(np.repeat(np.cumsum(size) - size, n) + step)[:, None] + np.arange(k)])
            places.append((np.repeat(first, n) + step).astype(np.uint32))
        # the first blocks hold the rows without doc_id, one document together
        order = np.maximum(blocks - (n_null - 1), 0) if n_null else blocks
        marked = SubTree(np.concatenate(rows)).later(np.repeat(order, [len(x) for x in places]), k)
        gone = [x[m].tobytes() for x, m in zip(places, np.split(marked, np.cumsum([len(x) for x in places])[:-1]), strict=True)]
        return _table([x for x in zip(blocks.tolist(), gone, strict=True) if x[1]], ["block", "places"], [pa.int32(), pa.binary()])

    return run


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _drop(k: int, with_text: bool):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        docs = in_order(docs)
        w = _Windows(docs, k, anchored=False)
        marked = np.zeros(len(w.at), bool)
        for x in marks.column("places"):
            marked[np.frombuffer(x.as_buffer(), np.uint32)] = True
        order, fresh = w.same(w.word_numbers(), np.arange(len(w.at)))
        del w.dictionary, w.hash
        head = np.flatnonzero(fresh)
        ids = w.ids[tx.owner(w.first)[w.at]]
        gone = np.zeros(len(w.at), bool)
        if len(head):
            size = np.diff(np.append(head, len(order)))
            earlier = np.repeat(np.maximum.reduceat(marked[order], head), size)
            gone[order] = earlier | (np.repeat(np.minimum.reduceat(ids[order], head), size) < ids[order])
            del earlier
        gone = covered(w.n_words, w.at[gone], k)
        del marked, order, fresh, ids, w.at
        n_removed, digests, texts = [], [], []
        for i in range(docs.num_rows):
            words = w.words_of(i)
            mine = gone[w.first[i] : w.first[i + 1]]
            n_removed.append(int(mine.sum()))
            kept = b" ".join(compress(words, (~mine).tolist()) if n_removed[-1] else words)
            digests.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                texts.append(kept.decode() if n_removed[-1] else None)
        out = {"doc_id": docs.column("doc_id"), "n_words": pa.array(np.diff(w.first), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        if with_text:
            out |= {"text": docs.column("text"), "kept": pa.array(texts, pa.string()), "rest": docs.column("rest")}
        return pa.table(out)

    return run


def dedup_substrings(docs: DataFrame, k: int = WINDOW, group_keys: int = GROUP_KEYS, block_bytes: int | None = None, rest: Column | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row.

    rest: a struct to carry along; then also text, kept (null if nothing goes) and rest.
    """
    if k < GRAM:
        raise ValueError(f"windows of {GRAM} words or more")
    parts, _, n_null, _ = blocked(docs, *([block_bytes] if block_bytes else []), rest=rest)
    counts = np.zeros(CLASSES**DEPTH, np.int64)
    for prefix, n in parts.select("doc_id", "text").mapInArrow(_count(k), "prefix long, n long").groupBy("prefix").agg(F.sum("n")).collect():
        counts[prefix] = n
    group, _ = prefix_groups(counts, group_keys)
    share = np.maximum(1, -(-counts // group_keys))
    sent = parts.groupBy("block").applyInArrow(lean(_send_codes(k, group, share)), "grp long, block int, codes binary")
    again = sent.groupBy("grp").applyInArrow(lean(_shared_codes), "grp long, block int, again binary")
    suffixes = parts.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(lean_two(_send_suffixes(k, group, share)), "grp long, block int, runs binary, dictionary binary, words binary")
    marks = suffixes.groupBy("grp").applyInArrow(lean(_subtree(k, n_null)), "block int, places binary")
    schema = StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string")
    if rest is not None:
        schema = schema.add("text", "string").add("kept", "string").add(parts.schema["rest"])
    return parts.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(lean_two(_drop(k, rest is not None)), schema)


def without_repeats(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """docs (doc_id, text and whatever else) with repeated words dropped from text; n_chars, if there, follows.

    Texts that lose nothing stay as they are; documents that lose all their words go.
    """
    others = [c for c in docs.columns if c != "text"]
    out = dedup_substrings(docs, k, rest=F.struct(*[F.col(f"`{c}`") for c in others])).where("n_removed = 0 or n_removed < n_words")
    values = {c: F.col("rest").getField(c) for c in others} | {"text": F.coalesce("kept", "text")}
    if "n_chars" in others:
        values["n_chars"] = F.when(F.col("kept").isNull(), values["n_chars"]).otherwise(F.length("kept"))
    return out.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in docs.schema])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT win, min(doc_id) AS m FROM p GROUP BY win),
g AS (SELECT DISTINCT doc_id, i + j AS spot FROM (SELECT p.doc_id, p.i, unnest(range(0, 13)) AS j FROM p JOIN f USING (win) WHERE f.m < p.doc_id)),
n AS (SELECT doc_id, list(spot) AS gone FROM g GROUP BY doc_id),
k AS (SELECT w.doc_id, ws, CASE WHEN gone IS NULL THEN ws ELSE list_filter(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN list_contains(gone, i) THEN NULL ELSE ws[i] END), lambda x: x IS NOT NULL) END AS kept FROM w LEFT JOIN n USING (doc_id))
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - len(kept))::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""

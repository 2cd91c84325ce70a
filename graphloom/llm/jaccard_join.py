"""Operator 5, n-gram Jaccard join over prefix trees, and the classes its links make.

Documents (words lower-cased A-Z) link when the Jaccard similarity of their sets
of ``k``-word shingles is ``percent`` / 100 or more.

1. Global order.  Shingles are ordered by document frequency, rare first (in
   powers of two, then by hash).  Frequencies are counted over all documents on
   codes with a few more bits than there are shingles; a shared code can only
   shift a place in the order, which any fixed order allows.
2. Candidates.  Two sets that link must share one of their first
   n - ceil(t n) + 1 shingles.  Those that occur twice or more meet by shingle;
   equal sets meet by set and are linked there, and one of them goes on.  The
   place of the first shared shingle bounds the overlap by what follows it, and so
   the size of a set that can still link (``reach``); pairs that their sizes and
   places rule out don't meet there.  Among up to SMALL sets all other pairs are
   candidates; in larger groups each set first meets the least document only.
3. Trie join.  The sets of a document's candidates go into a prefix tree
   (``Trie``).  There the shingles are ranked by how many of the tree's sets hold
   them, most first, the other way round than in step 1: sets that are nearly
   equal then share long beginnings, on which the overlap is counted once for
   all of them.  Every node knows the least and the largest set below it; its
   subtree is left as soon as what remains is too short for any of them to reach
   the overlap it needs.  The result is exact.
4. Classes.  Links make components (least doc_id reachable).
5. Large groups.  The members of a group of step 2, but for its least document,
   are joined with each other as well where that may tell anything new.  By size
   they fall into spans: where the next larger set is out of the reach of all
   smaller ones, so are all beyond.  Spans whose members are all of one component are done, and of
   spans with the same members one is enough.  The others are dealt in parts of
   about PART_DOCS sets; each two parts meet in a task of their own, one as a
   trie and the other as probes, and only members of different components are
   compared.  No link between different classes is lost, and a group of n copies
   costs n pairs, not n * n.

A text of fewer than k words is one shingle; without words the set is empty and
links with nothing.  Null texts have no words.  Rows with null doc_id link with
nothing and have a null component_id; rows of equal doc_id are each compared,
under one id.  A very long text is one row of its block and must fit into a
worker's memory.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import _text as tx
from graphloom.llm._blocks import blocked, in_order, lean, lean_two, pack, pieces, runs, slices, unpack
from graphloom.llm.components import components, saved
from graphloom.llm.decontamination import shingle_hashes

SHINGLE = 5
PERCENT = 80
SMALL = 8
GROUP_KEYS = 3_000_000
PAIRS = "kind int, a long, b long, n_a long, token long"


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (-(-percent * n // 100)) + 1


def reach(n: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """The largest set that can link with one of n shingles whose first shared one stands at ``place`` (from 0)."""
    return np.maximum(0, (100 + percent) * (n - place) // percent - n)


class _Sets:
    """The shingle sets of one block, each sorted by hash; equal sets of the block once, under the least doc_id."""

    def __init__(self, table: pa.Table, k: int, only: np.ndarray | None = None):
        table = in_order(table)
        ids = table.column("doc_id").to_numpy()
        if only is not None:
            keep = np.flatnonzero(np.isin(ids, only))
            table, ids = table.take(keep), ids[keep]
        buf, offsets = tx.flat(table.column("text"))
        sets = []
        for x, y in pieces(offsets):  # what is only needed on the way stays small
            h, doc = shingle_hashes(buf[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], k)
            bounds = np.searchsorted(doc, np.arange(y - x + 1))
            sets += [np.unique(h[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        self.sets, self.ids, self.digest, self.equal = [], [], [], []
        seen: dict[tuple[int, int], int] = {}
        for i, s in zip(ids.tolist(), sets, strict=True):
            if not len(s):
                continue
            digest = int((tx.mix(s) * tx._Q2).sum(dtype=np.uint64))
            if only is None and (first := seen.setdefault((digest, len(s)), i)) != i:
                self.equal.append((i, first))
                continue
            self.sets.append(s)
            self.ids.append(i)
            self.digest.append(digest)
        self.n = np.array([len(s) for s in self.sets], np.int64)

    def codes(self, width: int) -> np.ndarray:
        return (np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)) >> np.uint64(64 - width)


def _grouped(codes: np.ndarray, width: int, groups: int) -> list[tuple[int, int, int]]:
    # the top 24 bits or fewer choose the group, so that the product fits
    short = min(width, 24)
    return runs(((codes >> np.uint64(width - short)) * np.uint64(groups)) >> np.uint64(short))


def _send_codes(k: int, width: int, groups: int):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        codes, n = np.unique(_Sets(table, k).codes(width), return_counts=True)
        n = np.minimum(n, 255).astype(np.uint8)
        rows = [(g, block, pack(codes[a:b]), n[a:b].tobytes()) for g, a, b in _grouped(codes, width, groups)]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["grp", "block", "codes", "n"])

    return run


def _frequency(table: pa.Table) -> pa.Table:
    """For each block, the power of two of the document frequency of each of its codes."""
    codes = [unpack(x.as_buffer().to_pybytes()) for x in table.column("codes")]
    cuts = np.cumsum([len(c) for c in codes])[:-1]
    codes = np.concatenate(codes)
    n = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("n")])
    order = np.argsort(codes)
    codes = codes[order]
    head = np.flatnonzero(np.append(np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1]))
    del codes
    power = np.empty(len(order), np.uint8)
    if len(head):
        power[order] = np.repeat(np.log2(np.add.reduceat(n[order], head, dtype=np.int64)).astype(np.uint8), np.diff(np.append(head, len(order))))
    out = [x.tobytes() for x in np.split(power, cuts)]
    return pa.table([table.column("grp").cast(pa.int64()), table.column("block").cast(pa.int32()), pa.array(out, pa.binary())], names=["grp", "block", "power"])


def _send_prefixes(k: int, percent: int, width: int, groups: int, parts: int):
    def run(docs: pa.Table, powers: pa.Table) -> pa.Table:
        block = docs.column("block")[0].as_py()
        s = _Sets(docs, k)
        codes = s.codes(width)
        known = np.unique(codes)
        power = np.zeros(len(known), np.uint8)
        got = dict(zip(powers.column("grp").to_pylist(), powers.column("power").to_pylist(), strict=True))
        for g, a, b in _grouped(known, width, groups):
            power[a:b] = np.frombuffer(got[g], np.uint8)
        power = power[np.searchsorted(known, codes)]
        first = np.cumsum(s.n) - s.n
        keep = prefix_size(s.n, percent)
        tokens, docs_of, sizes = [], [], []
        for i, (tokens_of, a, n, p) in enumerate(zip(s.sets, first.tolist(), s.n.tolist(), keep.tolist(), strict=True)):
            mine = power[a : a + n]
            ahead = np.argsort(mine, kind="stable")[:p]
            place = np.flatnonzero(mine[ahead] > 0)
            tokens.append(tokens_of[ahead[place]])
            docs_of.append(np.full(len(place), i))
            sizes.append(n | reach(np.full(len(place), n), place, percent) << 32)
        rows = []
        digest, ids = np.array(s.digest, np.uint64), np.array(s.ids, np.int64)
        for base, t, d, size in ((0, tokens, docs_of, sizes), (parts, [digest], [np.arange(len(ids))], [s.n])):
            t, d, size = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (t, d, size))
            order = np.argsort(t, kind="stable")
            t, d, size = t[order], d[order].astype(np.int64), size[order].astype(np.int64)
            for g, a, b in _grouped(t >> np.uint64(24), 40, parts):
                table = np.stack([ids[d[a:b]].view(np.uint64), digest[d[a:b]], size[a:b].view(np.uint64)])
                rows.append((base + g, block, pack(t[a:b]), table.tobytes()))
        rows += [(-1, block, b"", np.array(s.equal, np.int64).tobytes())] if s.equal else []
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["grp", "block", "tokens", "docs"])

    return run


def _meet(percent: int, parts: int, small: int):
    """PAIRS of one group: kind 0 candidates, 1 equal sets, 2 members of larger groups."""

    def table(kind: int, a, b, n, token) -> pa.Table:
        return pa.table({"kind": pa.array(np.full(len(a), kind), pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n_a": pa.array(n, pa.int64()), "token": pa.array(token, pa.int64())})

    def run(rows: pa.Table) -> pa.Table:
        grp = rows.column("grp")[0].as_py()
        if grp < 0:
            both = np.concatenate([np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2) for x in rows.column("docs")])
            return table(1, both[:, 0], both[:, 1], both[:, 0] * 0, both[:, 0] * 0)
        token = np.concatenate([unpack(x.as_buffer().to_pybytes()) for x in rows.column("tokens")])
        ids, digest, n = (np.concatenate(x) for x in zip(*(np.frombuffer(x.as_buffer(), np.uint64).reshape(3, -1) for x in rows.column("docs")), strict=True))
        ids, n = ids.view(np.int64), n.view(np.int64)
        order = np.lexsort((ids, n, digest, token))
        token, ids, digest, n = token[order], ids[order], digest[order], n[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (digest[1:] != digest[:-1]) | (n[1:] != n[:-1])
        if grp >= parts:
            least = ids[new][np.cumsum(new) - 1]
            at = ids != least
            return table(1, ids[at], least[at], n[at] * 0, n[at] * 0)
        token, ids, n = token[new], ids[new], n[new]
        order = np.lexsort((ids, token))
        token, ids, n = token[order], ids[order], n[order]
        packed, far, n = n, n >> 32, n & 0xFFFFFFFF
        head = np.flatnonzero(np.diff(token, prepend=~token[:1]) != 0) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(token)))
        fits = lambda x, y: (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (n[x] <= far[y]) & (n[y] <= far[x])
        pairs = [np.zeros((0, 2), np.int64)]
        for m in range(2, small + 1):
            at = head[size == m]
            for i in range(m) if len(at) else ():
                for j in range(i + 1, m):
                    ok = fits(at + i, at + j) & (ids[at + i] != ids[at + j])
                    pairs.append(np.stack([ids[at + j], ids[at + i]], 1)[ok])
        big = [table(2, x[:0], x[:0], x[:0], x[:0]) for x in (ids,)]
        for a, m in zip(head[size > small].tolist(), size[size > small].tolist(), strict=True):
            # the least document meets all whose sizes allow a link here
            others = slice(a + 1, a + m)
            big.append(table(2, ids[others], ids[others], packed[others], np.full(m - 1, token[a]).view(np.int64)))
            left = np.arange(a, a + m)
            for c in range(a, a + min(m, small)):
                ok = fits(left, c) & (ids[left] > ids[c])
                pairs.append(np.stack([ids[left[ok]], np.full(ok.sum(), ids[c])], 1))
                left = left[~ok]
        found = np.unique(np.concatenate(pairs), axis=0)
        return pa.concat_tables([table(0, found[:, 0], found[:, 1], found[:, 0] * 0, found[:, 0] * 0), *big])

    return run


class _Node(NamedTuple):
    at: int  # a set whose path leads through here
    start: int  # the places on that path
    end: int
    least: int  # sizes of the sets below
    most: int
    ends: list[int]  # sets that end here
    below: list[_Node]
    only: int | None  # the class of all sets below, if it is one


class Trie:
    """Sets as a path-compressed prefix tree. looked, cut: edges walked and subtrees left since it was made."""

    def __init__(self, sets: list[np.ndarray], classes: list[int] | None = None):
        self.looked = self.cut = 0
        classes = classes if classes is not None else list(range(len(sets)))
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        self.tokens, place, count = np.unique(flat, return_inverse=True, return_counts=True)
        self.rank = np.empty(len(self.tokens), np.int64)
        self.rank[np.argsort(-count, kind="stable")] = np.arange(len(self.tokens))
        self.paths = [np.sort(x) for x in np.split(self.rank[place], np.cumsum([len(x) for x in sets])[:-1])] if sets else []
        order = sorted(range(len(sets)), key=lambda i: self.paths[i].astype(">i8").tobytes())
        shared = [0] * len(order)
        for k in range(1, len(order)):
            a, b = self.paths[order[k - 1]], self.paths[order[k]]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            shared[k] = int(differ[0]) if len(differ) else m
        self.roots: list[_Node] = []
        todo = [(0, len(order), 0, self.roots)]
        while todo:  # leaves first to last (in path order), which share the first ``depth`` places
            first, last, depth, siblings = todo.pop()
            cuts = [first, *(k for k in range(first + 1, last) if shared[k] <= depth), last]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x == y:
                    continue
                end = min(shared[x + 1 : y], default=len(self.paths[order[x]]))
                sizes = [len(self.paths[i]) for i in order[x:y]]
                ends = [i for i, n in zip(order[x:y], sizes, strict=True) if n == end]
                of = {classes[i] for i in order[x:y]}
                node = _Node(order[x], depth, end, min(sizes), max(sizes), ends, [], of.pop() if len(of) == 1 else None)
                siblings.append(node)
                if len(ends) < y - x:
                    todo.append((x + len(ends), y, end, node.below))

    def search(self, probe: np.ndarray, percent: int, but: int | None = None) -> list[int]:
        """Indexes of the sets that link with probe (sorted); those of the class ``but`` are of no interest."""
        stack = [(node, 0) for node in self.roots if but is None or node.only != but]
        if not stack:
            return []
        at = np.minimum(np.searchsorted(self.tokens, probe), len(self.tokens) - 1)
        held = np.zeros(len(self.tokens), np.int8)
        held[self.rank[at[self.tokens[at] == probe]]] = 1
        size, out = len(probe), []
        while stack:
            node, overlap = stack.pop()
            depth, path = node.start, self.paths[node.at]
            self.looked += 1
            while depth < node.end and self._possible(node, depth, overlap, size, percent):
                step = path[depth : min(node.end, depth + 64)]
                overlap, depth = overlap + int(held[step].sum()), depth + len(step)
            if depth < node.end or not self._possible(node, depth, overlap, size, percent):
                self.cut += 1
                continue
            if node.ends and 100 * overlap >= percent * (size + node.end - overlap):
                out += node.ends
            stack += [(x, overlap) for x in node.below if but is None or x.only != but]
        return out

    @staticmethod
    def _possible(node: _Node, depth: int, overlap: int, size: int, percent: int) -> bool:
        """Whether a set below the node may still reach the overlap that it needs: the best of them would end where both run out at once."""
        n = min(max(depth + size - overlap, node.least), node.most)
        return (100 + percent) * (overlap + min(n - depth, size - overlap)) >= percent * (size + n)


def _send_sets(k: int):
    """The set of each document asked for, to each place that asks."""

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        ids = asked.column("doc").to_numpy()
        s = _Sets(docs, k, only=ids)
        sets: dict[int, list[bytes]] = {}
        for i, x in zip(s.ids, s.sets, strict=True):
            sets.setdefault(i, []).append(pack(x))
        asks = zip(*(asked.column(c).to_pylist() for c in ("at", "salt", "side", "doc", "class")), strict=True)
        rows = [(*ask, x) for ask in asks for x in sets.get(ask[3], ())]
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["at", "salt", "side", "doc", "class", "tokens"])

    return run


def _joined(percent: int):
    """Links (a, b) between the sets of side 0, in a trie, and those of side 1; without side 1 among themselves."""

    def run(table: pa.Table) -> pa.Table:
        side, docs, classes_ = (table.column(c).to_pylist() for c in ("side", "doc", "class"))
        sets = [unpack(x.as_buffer().to_pybytes()) for x in table.column("tokens")]
        below = [i for i, x in enumerate(side) if x == 0]
        probes = [i for i, x in enumerate(side) if x == 1] or below
        trie = Trie([sets[i] for i in below], [classes_[i] for i in below])
        found = {(docs[below[j]], docs[i]) for i in probes for j in trie.search(sets[i], percent, classes_[i]) if classes_[below[j]] != classes_[i]}
        return pa.table([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


SALT_DOCS = 512
PART_DOCS = 256


def _linked(parts: DataFrame, block_of, asks: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) among the documents that meet: asks has at, salt (the place), side, doc, class."""
    sets = parts.groupBy("block").cogroup(asks.withColumn("block", block_of("doc")).groupBy("block")).applyInArrow(lean_two(_send_sets(k)), "at long, salt int, side int, doc long, class long, tokens binary")
    return sets.groupBy("at", "salt").applyInArrow(_joined(percent), "a long, b long")


def _verified(parts: DataFrame, block_of, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link; b's candidates are joined in groups of about SALT_DOCS."""
    many = pairs.groupBy("b").agg(F.count("*").alias("m"))
    salted = pairs.join(many, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.greatest(F.lit(1), F.expr(f"m div {SALT_DOCS}"))).cast("int"))
    below = salted.select(F.col("b").alias("at"), "salt", F.lit(0).alias("side"), F.col("a").alias("doc"), F.col("a").alias("class"))
    probes = salted.select(F.col("b").alias("at"), "salt", F.lit(1).alias("side"), F.col("b").alias("doc"), F.col("b").alias("class")).distinct()
    return _linked(parts, block_of, below.unionByName(probes), k, percent)


def _spans_apart(members: DataFrame, percent: int) -> DataFrame:
    """token, span, doc, class of the members (token, doc, n, far, class) of spans with several classes; of spans with the same members only one."""
    # a row for each size of a group
    sizes = members.groupBy("token", "n").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.max("far").alias("far"))
    up = Window.partitionBy("token").orderBy("n")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("far").over(before) >= F.col("n"), F.lit(False)) & F.coalesce(F.lag("n").over(up) * 100 >= F.col("n") * percent, F.lit(False))
    sizes = sizes.withColumn("new", (~reached).cast("int")).withColumn("span", F.sum("new").over(up))
    # sets of one size need to reach each other, sets of several sizes a larger one
    mixed = sizes.groupBy("token", "span").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("far").alias("far")).where("lo <> hi and (least < most or far >= least)").select("token", "span", "least")
    rest = members.join(sizes.select("token", "n", "span").join(mixed, ["token", "span"]), ["token", "n"]).where("far >= least").select("token", "span", "doc", "class")
    held = rest.groupBy("token", "span").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(7))).alias("y"))
    once = held.groupBy("m", "x", "y").agg(F.min(F.struct("token", "span")).alias("s")).select("s.token", "s.span")
    return rest.join(once, ["token", "span"])


def _linked_in_groups(parts: DataFrame, block_of, members: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between members (token, span, doc, class) of a span that are in different classes, part against part."""
    n = F.greatest(F.lit(1), F.expr(f"m div {PART_DOCS}"))
    many = members.groupBy("token", "span").agg(F.count("*").alias("m")).select("token", "span", n.alias("n"))
    dealt = members.join(many, ["token", "span"]).withColumn("part", F.pmod(F.xxhash64("doc"), F.col("n")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    # places are hashes: if two ever coincide, more sets than needed are compared
    place = F.xxhash64("token", "span", F.least("part", "other"), F.greatest("part", "other"))
    return _linked(parts, block_of, met.select(place.alias("at"), F.lit(0).alias("salt"), F.when(F.col("part") > F.col("other"), 1).otherwise(0).alias("side"), "doc", "class"), k, percent)


def count_shingles(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b):
                h, doc = shingle_hashes(*tx.flat(piece.column(1)), k)
                bounds = np.searchsorted(doc, np.arange(piece.num_rows + 1))
                n = [len(np.unique(h[x:y])) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n, pa.int64())], ["doc_id", "n_shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long")


def classes(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, block_bytes: int | None = None, small: int = SMALL) -> DataFrame:
    """doc_id, component_id of the documents that link with another."""
    docs = docs.where("doc_id is not null")
    parts, total, _, block_of = blocked(docs, *([block_bytes] if block_bytes else []))
    width = min(64, max(24, (total // 4 + 1).bit_length() + 8))
    groups = max(1, -(-total // (6 * GROUP_KEYS)))
    few = max(1, -(-total // (40 * GROUP_KEYS)))
    codes = parts.groupBy("block").applyInArrow(lean(_send_codes(k, width, groups)), "grp long, block int, codes binary, n binary")
    powers = codes.groupBy("grp").applyInArrow(lean(_frequency), "grp long, block int, power binary")
    prefixes = parts.groupBy("block").cogroup(powers.groupBy("block")).applyInArrow(lean_two(_send_prefixes(k, percent, width, groups, few)), "grp long, block int, tokens binary, docs binary")
    met = saved(prefixes.groupBy("grp").applyInArrow(_meet(percent, few, small), PAIRS))
    _release(docs.sparkSession)
    pairs = met.where("kind = 0").select("a", "b").distinct()
    links = saved(_verified(parts, block_of, pairs, k, percent).unionByName(met.where("kind = 1").select("a", "b")).distinct())
    _release(docs.sparkSession)
    labels = components(links)
    members = met.where("kind = 2").select("token", F.col("a").alias("doc"), F.expr("n_a & 4294967295").alias("n"), F.expr("shiftright(n_a, 32)").alias("far")).distinct()
    if members.isEmpty():
        return labels
    classed = saved(members.join(labels.withColumnRenamed("doc_id", "doc"), "doc", "left").select("token", "doc", "n", "far", F.coalesce("component_id", "doc").alias("class")))
    rest = saved(_spans_apart(classed, percent))
    _release(docs.sparkSession)
    if rest.isEmpty():
        return labels
    more = saved(_linked_in_groups(parts, block_of, rest, k, percent).distinct())
    return labels if more.isEmpty() else components(links.unionByName(more))


def _release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of a finished step."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def join_classes(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, **limits: int) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text)."""
    labels = classes(docs, k, percent, **limits)
    return count_shingles(docs, k).join(labels, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i+4], ' ')) AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""

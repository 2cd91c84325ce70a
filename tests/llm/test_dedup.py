import hashlib
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import _blocks, jaccard_join, substring_dedup, suffix_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def brute_words(rows, k):
    first = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone |= set(range(j, j + k))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"block_bytes": 3000, "group_keys": 500}])
def test_substring_dedup(docs, rows, limits):
    got = sorted(tuple(r) for r in substring_dedup.dedup_substrings(docs, **limits).collect())
    assert got == brute_words([(i, t) for i, t, *_ in rows], 13)
    assert sum(r[2] for r in got) > 100


def naive_nodes(words, k):
    """Paths with two leaves or more that branch or end at depth k, with their leaves."""
    out = set()
    for d in range(1, k + 1):
        for path in {tuple(w[:d]) for w in words}:
            leaves = [i for i, w in enumerate(words) if tuple(w[:d]) == path]
            if len(leaves) > 1 and (d == k or len({words[i][d] for i in leaves}) > 1):
                out.add((path, tuple(leaves)))
    return out


@pytest.mark.parametrize("letters", [1, 2, 5, 70000])
def test_subtree_has_the_nodes_of_a_naive_tree(letters):
    r = np.random.default_rng(letters)
    text = r.integers(0, letters, 200)
    text[100:160] = text[20:80]
    k = 7
    words = np.stack([text[i : i + k] for i in range(len(text) - k + 1)]).astype(np.int64)
    tree = substring_dedup.SubTree(words)
    got = {(tuple(words[tree.order[a]][:d].tolist()), tuple(sorted(tree.order[a : b + 1].tolist()))) for a, b, d in zip(tree.first, tree.last, tree.depth, strict=True)}
    assert got == naive_nodes(words.tolist(), k)
    blocks = r.integers(0, 9, len(words))
    want = [any(blocks[j] < blocks[i] and (words[j] == words[i]).all() for j in range(len(words))) for i in range(len(words))]
    assert tree.later(blocks, k).tolist() == want


def test_equal_hashes_of_different_words_stay_apart():
    text = "a b c d e x a b c d e y a b c d f"
    w = substring_dedup._Windows(pa.table({"doc_id": [1], "text": [text]}), 5, np.zeros(16**4, np.int64), np.ones(16**4, np.int64))
    w.hash = np.zeros_like(w.hash)
    order, fresh = w.same(w.word_numbers(), np.arange(len(w.at)))
    got = [set(x.tolist()) for x in np.split(order, np.flatnonzero(fresh)[1:])]
    assert sorted(map(sorted, got)) == sorted([[0, 6], *[[i] for i in range(len(w.at)) if i not in (0, 6)]])


ODD_IDS = [
    [-(2**63), -5, 0, 7, 2**62, 2**63 - 1],
    [*range(40), 2**62],
    [*range(0, 4000, 100), *range(10**12, 10**12 + 60)],
    [None] * 60,
    [None, None, 3, 3, 3, *range(10, 40)],
]


@pytest.mark.parametrize("ids", ODD_IDS)
def test_blocks_of_odd_ids(spark, ids):
    df = spark.createDataFrame([(i, f"text {j} " * 30) for j, i in enumerate(ids)], "doc_id long, text string")
    got = _blocks.blocked(df, 1500)
    rows = got.rows.collect()
    assert len(rows) == len(ids)
    sizes, first, last = {}, {}, {}
    for r in rows:
        sizes[r.block] = sizes.get(r.block, 0) + len(r.text) + 64
        assert (r.block < got.n_null) == (r.doc_id is None)
        if r.doc_id is not None:
            first[r.block], last[r.block] = min(first.get(r.block, r.doc_id), r.doc_id), max(last.get(r.block, r.doc_id), r.doc_id)
    order = sorted(first)
    assert all(last[a] < first[b] for a, b in zip(order, order[1:]))
    # no block is much larger than asked for; rows dealt by hash vary more
    assert max(sizes.values()) <= 3 * 1500 + 400 or got.n_null and max(sizes.values()) <= 6000
    again = {r.doc_id: r.b for r in df.where("doc_id is not null").select("doc_id", got.block_of("doc_id").alias("b")).collect()}
    assert all(again[r.doc_id] == r.block for r in rows if r.doc_id is not None)


@pytest.mark.parametrize("ids", ODD_IDS)
def test_dedup_of_odd_ids(spark, ids):
    t = " ".join(f"w{j}" for j in range(30))
    rows = [(i, f"{t} own{j % 7} {t}") for j, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in substring_dedup.dedup_substrings(df, block_bytes=1500, group_keys=50).collect()), key=repr)
    low = -(2**64)
    want = sorted((((None if i == low else i), *more) for i, *more in brute_words([(low if i is None else i, t) for i, t in rows], 13)), key=repr)
    assert got == want


def test_substring_dedup_of_odd_rows(odd_docs, no_docs):
    got = sorted((tuple(r)[:3] for r in substring_dedup.dedup_substrings(odd_docs).collect()), key=repr)
    # rows of one id don't remove each other; null comes first
    assert got == sorted([(None, 19, 0), (None, 19, 0), (5, 19, 19), (5, 19, 19), (6, 0, 0), (6, 0, 0)], key=repr)
    assert substring_dedup.dedup_substrings(no_docs).count() == 0


def test_without_repeats_keeps_columns_and_clean_rows(docs, rows):
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    brute = {i: (n, gone) for i, n, gone, _ in brute_words([(i, t) for i, t, *_ in rows], 13)}
    for i, t, *_ in rows:
        n, gone = brute[i]
        assert (i in got) == (gone == 0 or gone < n)
        if i in got:
            assert (got[i].text == t) == (gone == 0) and got[i].kept == "z" and got[i].block == 7


def brute_bytes(rows, n):
    seen, out = set(), []
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        mine = []
        for p in range(len(b) - n + 1):
            w = b[p : p + n]
            if w in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(w)
            mine.append(w)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("limits", [{}, {"block_bytes": 4000, "group_bytes": 20000, "group_keys": 300}, {"block_bytes": 4000, "often": 1}, {"chunk": 300}, {"block_bytes": 4000, "often": 1, "chunk": 1}])
def test_suffix_dedup(docs, rows, limits):
    got = sorted(tuple(r) for r in suffix_dedup.dedup_bytes(docs, **limits).collect())
    assert got == brute_bytes([(i, t) for i, t, *_ in rows], 100)
    assert sum(r[2] for r in got) > 1000


def test_suffix_dedup_of_odd_rows(odd_docs, no_docs):
    got = sorted((tuple(r)[:3] for r in suffix_dedup.dedup_bytes(odd_docs, 64).collect()), key=repr)
    n = 97
    assert [r[1] for r in got].count(n) == 4 and sum(r[2] for r in got) == 3 * n
    assert suffix_dedup.dedup_bytes(no_docs).count() == 0


def test_anchors_depend_on_windows_only():
    r = np.random.default_rng(0)
    shared = r.integers(97, 100, 150, dtype=np.uint8)
    both = [np.concatenate([r.integers(97, 123, k, dtype=np.uint8), shared, r.integers(97, 123, 80, dtype=np.uint8)]) for k in (37, 230)]
    found = []
    for b, k in zip(both, (37, 230), strict=True):
        at, h = suffix_dedup.anchors(b, np.array([0, len(b)]), 100)
        found.append({(int(p) - k, int(x)) for p, x in zip(at, h, strict=True) if k <= p <= k + 150 - suffix_dedup.GRAM})
    assert found[0] & found[1]


def naive_factors(text, starts, positions, n):
    out = []
    for s, p in zip(starts, positions, strict=True):
        best = 0
        for q, o in zip(starts, positions, strict=True):
            if o < p:
                k = 0
                while k < n and s + k < len(text) and q + k < len(text) and text[s + k] == text[q + k]:
                    k += 1
                best = max(best, k)
        out.append(best)
    return out


@pytest.mark.parametrize("n", [16, 20, 33, 100])
def test_previous_factors(n):
    r = np.random.default_rng(n)
    text = r.integers(97, 99, 300, dtype=np.uint8)
    text[150:270] = text[20:140]
    starts = np.arange(len(text) - n + 1)
    for positions in (starts, r.permutation(len(starts)), r.integers(0, 50, len(starts))):
        assert suffix_dedup.previous_factors(text, starts, positions, n).tolist() == naive_factors(text.tolist(), starts.tolist(), positions.tolist(), n)


def test_nearest_smaller():
    r = np.random.default_rng(3)
    for v in (r.integers(0, 20, 500), np.arange(300), np.arange(300)[::-1], np.zeros(300, int)):
        want = [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(len(v))]
        assert _blocks.nearest_smaller(v).tolist() == want


def test_halves_hold_every_window_once():
    for reach in (68, 36, 1, 0):
        ranges, nodes = [], [1]
        while nodes:
            node = nodes.pop()
            lo, hi = suffix_dedup.node_range(node, reach)
            if lo == hi:
                ranges.append(lo)
            else:
                nodes += [2 * node, 2 * node + 1]
        assert sorted(ranges) == list(range(-reach, 1))


def sets(text):
    w = [x.lower() for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows, percent=80):
    s = {i: sets(t) for i, t in rows}
    label = {i: i for i in s}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return sorted((i, len(s[i]), find(i)) for i in ids)


@pytest.mark.parametrize("limits", [{}, {"block_bytes": 3000, "small": 2}])
def test_jaccard_join(docs, rows, limits):
    got = sorted(tuple(r) for r in jaccard_join.join_classes(docs, **limits).collect())
    assert got == brute_classes([(i, t) for i, t, *_ in rows])
    assert sum(i != c for i, _, c in got) > 5


def test_jaccard_chain_in_one_group(spark):
    """Neighbours link, ends don't: the class must hold them all."""
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(12):
        t = list(base)
        for j in range(i):
            t[j] = f"v{j}"
        rows.append((i + 1, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_join.join_classes(df, small=2).collect()) == brute_classes(rows)


def test_jaccard_of_odd_rows(odd_docs, no_docs):
    got = sorted((tuple(r) for r in jaccard_join.join_classes(odd_docs).collect()), key=repr)
    assert got == sorted([(None, 15, None), (None, 15, None), (5, 15, 5), (5, 15, 5), (6, 0, 6), (6, 0, 6)], key=repr)
    assert jaccard_join.join_classes(no_docs).count() == 0


def link(a, b, percent):
    return 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))


def test_trie_finds_the_sets_that_link():
    r = np.random.default_rng(2)
    probe = np.unique(r.integers(0, 2**60, 300, dtype=np.uint64))
    groups = [np.unique(np.concatenate([probe[r.random(len(probe)) < keep], r.integers(0, 2**60, more, dtype=np.uint64)])) for keep in (1.0, 0.95, 0.9, 0.85, 0.5) for more in (0, 10, 30, 80)]
    groups += [groups[0], groups[7], groups[0][:40], probe[:1]]  # equal ones, and beginnings of others
    for percent in (50, 80, 95, 100):
        want = [i for i, s in enumerate(groups) if link(s, probe, percent)]
        assert sorted(jaccard_join.Trie(groups).search(probe, percent)) == want
    assert jaccard_join.Trie([]).search(probe, 80) == []


def test_trie_shares_beginnings_and_leaves_subtrees():
    r = np.random.default_rng(4)
    base = np.unique(r.integers(0, 2**60, 400, dtype=np.uint64))
    other = np.unique(r.integers(0, 2**60, 400, dtype=np.uint64))
    # two families of sets that are nearly equal within
    near = [np.unique(np.concatenate([b, r.integers(0, 2**60, 5, dtype=np.uint64)])) for b in (base, other) for _ in range(100)]
    trie = jaccard_join.Trie(near)
    assert len(trie.roots) == 2 and {len(n.below) for n in trie.roots} == {100} and all(n.end >= 390 for n in trie.roots)
    assert sorted(trie.search(base, 80)) == list(range(100))
    # the whole family of the other base is left on its first edge
    assert trie.cut == 1 and trie.looked == 2 + 100


def test_reach_leaves_no_link_out():
    r = np.random.default_rng(8)
    for _ in range(300):
        percent = int(r.choice([50, 80, 95]))
        a = np.sort(r.choice(60, int(r.integers(1, 30)), replace=False))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.9], r.choice(60, int(r.integers(0, 4)))]))
        both = np.intersect1d(a, b)
        if len(both) and link(a, b, percent):
            i, j = int(np.searchsorted(a, both[0])), int(np.searchsorted(b, both[0]))
            assert len(b) <= jaccard_join.reach(np.array([len(a)]), np.array([i]), percent)[0] and len(a) <= jaccard_join.reach(np.array([len(b)]), np.array([j]), percent)[0]


def test_trie_leaves_out_a_class():
    sets = [np.arange(10, dtype=np.uint64), np.arange(11, dtype=np.uint64), np.arange(1, 11, dtype=np.uint64), np.arange(50, 60, dtype=np.uint64)]
    trie = jaccard_join.Trie(sets, [5, 5, 7, 5])
    assert sorted(trie.search(sets[0], 80)) == [0, 1, 2] and 2 in trie.search(sets[0], 80, 5) and trie.search(sets[3], 80, 5) == []


def test_jaccard_of_large_groups(spark):
    """A third of the documents share their beginning without linking; copies and chains hide among them."""
    r = np.random.default_rng(6)
    head = [f"h{j}" for j in range(30)]
    rows = []
    for i in range(90):
        own = [f"x{r.integers(0, 10**6)}" for _ in range(30)]
        rows.append((i, " ".join(head + own)))
        if i % 9 == 0:
            rows.append((1000 + i, " ".join(head + own + ["end"])))
        if i % 10 == 0:
            rows.append((2000 + i, " ".join(head + own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old, jaccard_join.PART_DOCS = jaccard_join.PART_DOCS, 20
    try:
        assert sorted(tuple(x) for x in jaccard_join.join_classes(df, small=2).collect()) == brute_classes(rows)
    finally:
        jaccard_join.PART_DOCS = old


def a_block(n_docs, n_words, seed=5):
    r = np.random.default_rng(seed)
    texts = [" ".join(f"w{x:05d}" for x in r.integers(0, 3000, n_words).tolist()) for _ in range(n_docs)]
    return pa.table({"doc_id": pa.array(range(n_docs), pa.int64()), "text": texts, "block": pa.array([0] * n_docs, pa.int32())})


def test_blocks_take_a_few_times_their_bytes():
    table = a_block(600, 1000)
    size = table.column("text").nbytes
    group, share = np.zeros(16**4, np.int64), np.ones(16**4, np.int64)
    none = pa.table({"grp": pa.array([], pa.int64()), "again": pa.array([], pa.binary())})
    every = pa.table({"places": pa.array([], pa.binary())})
    codes = jaccard_join._send_codes(5, 30, 1)(table)
    work = {
        "codes of op2": (10, lambda: substring_dedup._send_codes(13, group, share)(table)),
        "suffixes of op2": (11, lambda: substring_dedup._send_suffixes(13, group, share)(table, none)),
        "removal of op2": (11, lambda: substring_dedup._drop(13, False)(table, every)),
        "sets of op5": (5, lambda: jaccard_join._Sets(table, 5)),
        "frequencies of op5": (7, lambda: jaccard_join._frequency(codes)),
    }
    took = {}
    for name, (_, f) in work.items():
        tracemalloc.start()
        f()
        took[name] = tracemalloc.get_traced_memory()[1] / size
        tracemalloc.stop()
    assert all(took[name] < most for name, (most, _) in work.items()), took


def test_windows_are_the_same_in_pieces(monkeypatch, rows):
    rows = [*rows, (111, "", None, None)]
    table = pa.table({"doc_id": [x[0] for x in rows], "text": pa.array([x[1] for x in rows], pa.string())})
    group, share = np.arange(16**4) % 7, 1 + np.arange(16**4) % 2
    made, sets = [], []
    for most in (1, 500, 1 << 30):
        for module in (substring_dedup, jaccard_join):
            monkeypatch.setattr(module, "pieces", lambda offsets, most=most: _blocks.pieces(offsets, most))
        made.append(substring_dedup._Windows(table, 13, group, share))
        sets.append(jaccard_join._Sets(table, 5))
    assert len(made[0].at) > 1000 and made[0].n_words == made[0].first[-1]
    for w, s in zip(made[1:], sets[1:], strict=True):
        assert all((getattr(w, c) == getattr(made[0], c)).all() for c in ("at", "hash", "where", "code", "first"))
        assert s.ids == sets[0].ids and s.digest == sets[0].digest and s.equal == sets[0].equal


def test_pieces_hold_every_document_once():
    for sizes, most in (([], 5), ([0, 0], 5), ([3, 0, 9, 1, 1, 0], 4), ([1] * 20, 6), ([50], 4)):
        got = _blocks.pieces(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), most)
        assert got[0][0] == 0 and got[-1][1] == len(sizes)
        assert all(a[1] == b[0] for a, b in zip(got, got[1:]))
        assert all(sum(sizes[a:b]) < most + max(sizes[a:b], default=0) + 1 for a, b in got)

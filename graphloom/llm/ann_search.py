"""Operator 7, approximate nearest neighbours by adaptive dimension scan.

Largest inner products become least distances when every vector gets one more
component, sqrt(M^2 - |x|^2) with M the largest norm (0 for queries).  Vectors
are then rotated by one random rotation and dealt into lists by their nearest
centre.  A query probes the lists with the nearest centres.  In a list the
rotated vectors are scanned in blocks of columns: after d of D columns the
partial distance times D/d estimates the whole distance, and a hypothesis test
(reject at ``1 + epsilon / sqrt(d)`` times the bound) abandons candidates early.
The bound is the k-th least distance met so far, which starts from a bounded
sample of candidates.  The nearest eighth of a query's lists is scanned first; the
k-th best of it bounds the rest.  Survivors are scored exactly: inner products of the
original vectors in double precision.

The number of lists grows with the square root of the rows (up to a 32nd of the
sample), and how many of them a query probes is fitted: the share that held
TARGET of the true neighbours of sampled rows among the sample.  True neighbours
among all rows are nearer than those and lie in fewer lists.  Where vectors have
no clusters this share is large (near half for the test tables), and the search
costs that share of queries times rows before candidates are abandoned.

Only the centres, the share and the starting sample come from bounded samples
(SAMPLE and SEEDS rows, picked by hash); every row is indexed.  Near lists are put
together in groups of about PART rows, a list that holds more is dealt to several
groups; queries meet a group in parts of about ASKS, so no task grows with the
data.

Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, nor do rows with null vec_id.  Repeated rows
are separate candidates (a query's own id is never its candidate) but one query.
Ties go to the smaller vec_id; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm._blocks import runs, slices

K = 20
LISTS_PER_ROOT = 2.0
TARGET = 0.95
SAMPLE = 16_384
SEEDS = 2_048
ASKED = 512  # sampled rows that the share of lists is fitted on
PART = 4_096
ASKS = 20_000
COLUMNS = 13
EPSILON = 2.1


def usable(v: Column) -> Column:
    x = v.cast("array<double>")
    return v.isNotNull() & F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))) & F.exists(x, lambda a: a != 0)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Index:
    """Rotation, centres, how many lists to probe, and the starting sample."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, longest: float, k: int, total: int, target: float, seed: int = 5):
        r = np.random.default_rng(seed)
        self.longest = longest
        dim = x.shape[1] + 1
        self.rotation = np.linalg.qr(r.normal(size=(dim, dim)))[0]
        y = self.rotate(x)
        self.centres = _means(y, max(1, min(int(LISTS_PER_ROOT * np.sqrt(total)), len(x) // 32)), r)
        self.seed_ids, self.seeds = ids[:SEEDS], y[:SEEDS]
        self.seed_lists = self.nearest(self.seeds, 1)[:, 0]
        self.probed = self._fitted(ids, x, y, k, target, r)

    def _fitted(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray, k: int, target: float, r: np.random.Generator) -> int:
        """How many of the nearest lists hold ``target`` of the k nearest sampled rows of some of them."""
        asked = r.choice(len(x), min(len(x), ASKED), replace=False)
        score = x[asked] @ x.T
        score[ids[asked][:, None] == ids] = -np.inf
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]
        own = self.nearest(y, 1)[:, 0][best]
        near = self.nearest(self.rotate(x[asked], queries=True), len(self.centres))
        place = np.empty_like(near)
        np.put_along_axis(place, near, np.arange(near.shape[1])[None].repeat(len(near), 0), 1)
        places = np.sort(np.take_along_axis(place, own, 1)[np.isfinite(np.take_along_axis(score, best, 1))])
        return int(places[min(len(places) - 1, int(np.ceil(target * len(places))))]) + 1 if len(places) else len(self.centres)

    def rotate(self, x: np.ndarray, queries: bool = False) -> np.ndarray:
        extra = np.zeros(len(x)) if queries else np.sqrt(np.maximum(0, self.longest**2 - (x * x).sum(1)))
        return np.concatenate([x, extra[:, None]], 1) @ self.rotation

    def nearest(self, y: np.ndarray, n: int) -> np.ndarray:
        far = (self.centres**2).sum(1) - 2 * y @ self.centres.T
        return np.argsort(far, axis=1, kind="stable")[:, :n]

    def start(self, ids: np.ndarray, y: np.ndarray, k: int, probed: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """For each query the squared distance to the k-th nearest seed of the lists it probes, and those k seeds' ids."""
        d = (y**2).sum(1)[:, None] + (self.seeds**2).sum(1) - 2 * y @ self.seeds.T
        d[ids[:, None] == self.seed_ids] = np.inf
        near = np.zeros((len(y), len(self.centres)), bool)
        np.put_along_axis(near, self.nearest(y, probed), True, 1)
        d[~near[:, self.seed_lists]] = np.inf
        if d.shape[1] < k:
            return np.full(len(y), np.inf), [self.seed_ids] * len(y)
        best = np.argpartition(d, k - 1, axis=1)[:, :k]
        return np.take_along_axis(d, best, 1).max(1), list(self.seed_ids[best])


def _means(y: np.ndarray, n: int, r: np.random.Generator) -> np.ndarray:
    """n centres of y."""
    centres = y[r.choice(len(y), n, replace=False)]
    for _ in range(12):
        at = ((centres**2).sum(1) - 2 * y @ centres.T).argmin(1)
        size = np.bincount(at, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, y)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def groups_of_lists(centres: np.ndarray, sizes: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
    """First group of each list, and its number of groups: near lists share one of about ``part`` rows, a larger list has several."""
    n = max(1, min(len(centres), int(-(-sizes.sum() // part))))
    means = _means(centres, n, np.random.default_rng(3))
    near = ((means**2).sum(1) - 2 * centres @ means.T).argmin(1)
    first, count, group, filled = np.zeros(len(centres), np.int64), np.ones(len(centres), np.int64), 0, 0
    for i in np.argsort(near, kind="stable").tolist():
        if filled and filled + sizes[i] > part:
            group, filled = group + 1, 0
        first[i], count[i] = group, max(1, -(-sizes[i] // part))
        filled += sizes[i]
        if count[i] > 1:
            group, filled = group + count[i], 0
    return first, count


def adaptive_scan(q: np.ndarray, blocks: list[np.ndarray], bound: float, epsilon: float = EPSILON, rows: np.ndarray | None = None) -> np.ndarray:
    """Rows (of some, or of all) that are not abandoned. q: a rotated query; blocks: the rotated rows' columns, in blocks; bound: a squared distance."""
    rows, d, dim = np.arange(len(blocks[0])) if rows is None else rows, 0, len(q)
    partial = np.zeros(len(rows), np.float32)
    for b in blocks:
        part = b[rows] - q[d : d + b.shape[1]]
        partial = partial + np.einsum("ij,ij->i", part, part)
        d += b.shape[1]
        slack = 1 + epsilon / np.sqrt(d) if d < dim else 1 + 1e-4
        ok = partial * (dim / d) <= bound * slack * slack + 1e-9
        rows, partial = rows[ok], partial[ok]
    return rows


def _scan(index: Index, k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        qid, q = queries.column("vec_id").to_numpy(), _matrix(queries.column("v"))
        rows = rows.sort_by([("list", "ascending")])
        ids, x, of = rows.column("vec_id").to_numpy(), _matrix(rows.column("v")), rows.column("list").to_numpy()
        out_q, out_i, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(qid) and len(ids):
            y, yq = index.rotate(x).astype(np.float32), index.rotate(q, queries=True)
            blocks = [np.ascontiguousarray(y[:, c : c + COLUMNS]) for c in range(0, y.shape[1], COLUMNS)]
            here = {n: np.arange(a, b) for n, a, b in runs(of)}
            place: dict[int, list[int]] = {}
            for i in np.flatnonzero(np.isin(ids, index.seed_ids)).tolist():
                place.setdefault(int(ids[i]), []).append(i)
            given, bounds, seeds = (queries.column(c).to_pylist() for c in ("least", "bound", "seeds"))
            for j, lists in enumerate(queries.column("lists").to_pylist()):
                some = [here[n] for n in sorted(lists) if n in here]
                if not some:
                    continue
                some, bound = np.concatenate(some), bounds[j]
                if given[j] is not None:  # the k-th best score so far
                    bound = min(bound, float(q[j] @ q[j]) + index.longest**2 - 2 * given[j])
                kept = adaptive_scan(yq[j].astype(np.float32), blocks, bound, rows=some)
                if given[j] is None:  # the k seeds that set the bound stay: there are never fewer than k found
                    kept = np.union1d(kept, np.intersect1d([i for x in seeds[j] for i in place.get(x, ())], some)).astype(np.int64)
                kept = kept[ids[kept] != qid[j]]
                s = np.array([float(np.dot(x[i], q[j])) for i in kept])
                best = np.lexsort((ids[kept], -s))[:k]
                out_q.append(np.full(len(best), qid[j]))
                out_i.append(ids[kept][best])
                out_s.append(s[best])
        return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_i), "score": np.concatenate(out_s)})

    return run


def fit(vectors: DataFrame, k: int = K, target: float = TARGET, sample: int = SAMPLE) -> Index | None:
    """An index of vectors (vec_id, v) from about ``sample`` of them."""
    total, longest = vectors.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b))).first()
    if not total:
        return None
    scale = 1 << 24
    got = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(scale)) <= int(scale * min(1.0, sample / total))).orderBy(F.xxhash64("vec_id")).limit(2 * sample).toArrow()
    if not got.num_rows:  # a few rows, none picked
        got = vectors.limit(1).toArrow()
    return Index(got.column("vec_id").to_numpy(), _matrix(got.column("v")), float(np.sqrt(longest)) * (1 + 1e-12), k, total, target)


def search(rows: DataFrame, queries: Column, k: int = K, target: float = TARGET, sample: int = SAMPLE, part: int = PART, asks: int = ASKS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of rows (vec_id, embedding) for each row where ``queries`` holds."""
    v = F.col("embedding").cast("array<double>")
    valid = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), queries.alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    usual = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if usual is None:
        return rows.sparkSession.createDataFrame([], empty)
    valid = valid.where(F.size("v") == usual["d"])
    index = fit(valid, k, target, sample)
    n_lists, probed = len(index.centres), index.probed
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = shared.value.nearest(shared.value.rotate(_matrix(b.column(1))), 1)[:, 0] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.int32())], ["vec_id", "v", "list"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each query its lists, the starting bound and the seeds that set it."""
        x = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                piece = b.slice(at, 1024)
                y = x.rotate(_matrix(piece.column(1)), queries=True)
                bound, seeds = x.start(piece.column(0).to_numpy(), y, k, probed)
                lists = [pa.array(c, pa.list_(t)) for c, t in ((x.nearest(y, probed).tolist(), pa.int32()), ([s.tolist() for s in seeds], pa.int64()))]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), lists[0], pa.array(bound, pa.float64()), lists[1]], ["vec_id", "v", "lists", "bound", "seeds"])

    dealt = valid.select("vec_id", "v").mapInArrow(assign, "vec_id long, v array<double>, list int")
    sizes = np.zeros(n_lists, np.int64)
    for n, size in dealt.groupBy("list").count().collect():  # a row for each list
        sizes[n] = size
    first, count = groups_of_lists(index.centres, sizes, part)
    asked = valid.where("asks").dropDuplicates(["vec_id"]).select("vec_id", "v").mapInArrow(route, "vec_id long, v array<double>, lists array<int>, bound double, seeds array<long>")
    n_parts = max(1, -(-valid.where("asks").count() // asks))
    lookup = lambda x: F.array(*[F.lit(int(n)) for n in x])
    group = F.element_at(lookup(first), F.col("list") + 1) + F.pmod(F.xxhash64("vec_id"), F.element_at(lookup(count), F.col("list") + 1))
    dealt = dealt.withColumn("grp", group.cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))

    def spread(lo: int, hi: int):
        """Each query once for each group with some of its lists from lo to hi."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for piece in slices(b, 1 << 20):
                    row, grp, lists = [], [], []
                    for i, mine in enumerate(piece.column(piece.schema.names.index("lists")).to_pylist()):
                        stops: dict[int, list[int]] = {}
                        for n in mine[lo:hi]:
                            for g in range(int(first[n]), int(first[n] + count[n])):
                                stops.setdefault(g, []).append(n)
                        row += [i] * len(stops)
                        grp += stops
                        lists += stops.values()
                    for a in range(0, len(row), 2048):
                        some = piece.take(pa.array(row[a : a + 2048], pa.int64()))
                        kept = [some.column(some.schema.names.index(c)) for c in ("vec_id", "v", "bound", "seeds", "least")]
                        yield pa.RecordBatch.from_arrays([*kept, pa.array(lists[a : a + 2048], pa.list_(pa.int32())), pa.array(grp[a : a + 2048], pa.int32())], ["vec_id", "v", "bound", "seeds", "least", "lists", "grp"])

        return run

    def scan(a: pa.Table, b: pa.Table) -> pa.Table:
        return _scan(shared.value, k)(a, b)

    def near(queries: DataFrame, lo: int, hi: int) -> DataFrame:
        """The k nearest within each group that holds some of the lists lo to hi of a query."""
        to = queries.mapInArrow(spread(lo, hi), "vec_id long, v array<double>, bound double, seeds array<long>, least double, lists array<int>, grp int")
        to = to.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(n_parts)).cast("int"))
        return to.groupBy("grp", "part").cogroup(dealt.groupBy("grp", "part")).applyInArrow(scan, "query_id long, vec_id long, score double")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = lambda df: df.withColumn("rank", rank).where(F.col("rank") <= k)
    ahead = max(1, probed // 8)
    first_found = best(near(asked.withColumn("least", F.lit(None).cast("double")), 0, ahead))
    least = first_found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    found = first_found.drop("rank")
    if probed > ahead:
        found = found.unionByName(near(asked.join(least, "vec_id", "left"), ahead, probed))
    return best(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)

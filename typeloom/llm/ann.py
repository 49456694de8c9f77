"""Approximate nearest neighbours by largest inner product: an inverted multi-index.

Two codebooks are fitted (k-means) to the halves of at most about FITTED vectors, with about the square root of the number
of vectors in centroids, MOST_CENTROIDS at most; every vector is put in the cell of its two nearest centroids. A query walks
the pairs of centroids in order of their summed nearness, with a heap over the rows of pairs, until the cells that it has
passed hold a share of all vectors, and ENOUGH vectors at least. Only entries of these cells are scored: by the inner product
of the original vectors in double precision. The share is measured at fitting: the least within which the walks of PROBES
sampled vectors pass TARGET of their true k nearest in the sample. It is small where the vectors have clusters and large
where they have none.

Cells are dealt into parts, a cell larger than a part over several; a query goes to the parts of its cells only, with the
summed distance at which its walk ended.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, neither as
queries nor as candidates. Equal vectors are indexed once, with their k + 1 smallest ids, so a vector that a third of all
rows share is one entry; each query's own id is left out. With fewer candidates than k all are returned. A row without
vec_id takes no part; a vec_id that repeats is one candidate, by its nearest vector, and one query, with its smallest vector.
Extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fitted_in_task, sampled, written
from .vectors import TASKS, best, distinct_values, flat, lists, named, part_rows, searched, top

MOST_CENTROIDS, FITTED, ROUNDS = 1024, 20_000, 12
#: Vectors at least whose cells a query walks through; recall that the share is measured for, and on how many probes.
ENOUGH, TARGET, PROBES = 2_000, 0.96, 128
#: Entries of a part, from and to; queries of one task; queries sent on at once.
LEAST_ROWS, PART_ROWS, QUERY_BLOCK, AT_ONCE = 8192, 1 << 16, 1 << 16, 32
#: Vectors for each task of walks.
WALKS = 2_000


def usable(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id, v (array of double) of the vectors that take part, and their length."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(fine)
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    width = width[0]["n"] if width else 0
    return rows.where(F.size("v") == width), width


def nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    own = (c * c).sum(1)[None]
    return np.concatenate([np.argmin(own - 2 * x[k : k + 4096] @ c.T, 1) for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        near = nearest_centroid(x, c)
        order = np.argsort(near, kind="stable")
        at, first = np.unique(near[order], return_index=True)
        c[at] = np.add.reduceat(x[order], first) / np.diff([*first, len(x)])[:, None]
    return c


class Index:
    """Two codebooks; the halves of a vector are its first and its remaining components."""

    def __init__(self, sample: np.ndarray, total: int, k: int):
        """sample: of `total` vectors. k: neighbours for which the share is measured."""
        self.cut = max(1, sample.shape[1] // 2)
        wide = max(1, min(1 << int(np.log2(max(1, total)) / 2), MOST_CENTROIDS, len(sample)))
        self.first, self.second = k_means(sample[:, : self.cut], wide, 1), k_means(sample[:, self.cut :], wide, 2)
        self.share = self.measured(sample, k)

    def measured(self, sample: np.ndarray, k: int) -> float:
        """The share of entries that walks pass before TARGET of the true neighbours."""
        i, j = self.halves(sample)
        places = []
        for p in range(0, len(sample), max(1, len(sample) // PROBES)):
            q = sample[p]
            score = sample @ q
            score[p] = -np.inf
            near = np.argpartition(-score, min(k, len(score) - 1))[:k]
            summed = (self.first @ q[: self.cut])[i] + (self.second @ q[self.cut :])[j]
            ranked = np.sort(summed)
            places += ((len(summed) - np.searchsorted(ranked, summed[near], side="left")) / len(summed)).tolist()
        return float(np.quantile(places, TARGET))

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest_centroid(x[:, : self.cut], self.first), nearest_centroid(x[:, self.cut :], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        i, j = self.halves(x)
        return i * len(self.second) + j

    def dealt(self, counts: np.ndarray, rows: int) -> None:
        """counts: entries of each cell. Cells stand in line and are cut into parts of `rows` entries."""
        self.counts = counts.reshape(len(self.first), len(self.second))
        end = np.cumsum(counts)
        self.low, self.high = ((end - counts) // rows).astype(np.int64), np.maximum(end - 1, 0) // rows
        self.parts = int(-(-end[-1] // rows))

    def part(self, cell: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The part of each entry: one of its cell's, by a hash of its id."""
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.low[cell] + (mixed % (self.high[cell] - self.low[cell] + 1).astype(np.uint64)).astype(np.int64)

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a query's halves to the centroids: the less, the nearer."""
        return -(self.first @ q[: self.cut]), -(self.second @ q[self.cut :])

    def walk(self, q: np.ndarray, enough: int) -> tuple[np.ndarray, float]:
        """The cells that hold something, nearest pair first, until they hold `enough`; and the summed distance of the last. The
        heap has the next pair of each row of pairs that has been entered; a row is entered when the one before it is."""
        a, b = self.distances(q)
        ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b = a[ia].tolist(), b[ib].tolist()
        held_in = self.counts[ia][:, ib].tolist()
        rows, columns, at, held, limit = [], [], [0] * len(a), 0, -np.inf
        heap, last = [(a[0] + b[0], 0)], len(b)
        while heap and held < enough:
            i = heap[0][1]
            j = at[i]
            if n := held_in[i][j]:
                rows.append(i)
                columns.append(j)
                held += n
                limit = heap[0][0]
            at[i] = j + 1
            if j + 1 < last:
                heapq.heapreplace(heap, (a[i] + b[j + 1], i))
            else:
                heapq.heappop(heap)
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1))
        return ia[rows] * last + ib[columns], limit

    def passed(self, q: np.ndarray, limit: float, cells: np.ndarray) -> np.ndarray:
        """Which of the cells a walk with this limit has passed."""
        a, b = self.distances(q)
        return a[cells // len(b)] + b[cells % len(b)] <= limit


def fitted(vectors: DataFrame, width: int, total: int, k: int) -> Index | None:
    """The codebooks, from a bounded sample, fitted in one task; and the number of vectors in each cell (at most
    MOST_CENTROIDS^2 numbers)."""
    spark = vectors.sparkSession
    sample = sampled(vectors.select("v", F.element_at("ids", 1).alias("id")), "id", FITTED)
    index = fitted_in_task(sample, "id", lambda t: Index(flat(t, "v", width, np.float64), total, k) if t is not None and t.num_rows else None)
    if index is None:
        return None
    shared = spark.sparkContext.broadcast(index)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = np.unique(shared.value.cells(flat(pa.Table.from_batches([batch]), "v", width, np.float64)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["cell", "n"])

    counts = np.zeros(len(index.first) * len(index.second), np.int64)
    found = vectors.select("v").mapInArrow(cells, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    index.dealt(counts, part_rows(total, LEAST_ROWS, PART_ROWS))
    return index


def nearest(table: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of every row for which `queries` (of vec_id) holds."""
    spark = table.sparkSession
    rows, width = usable(table)
    vectors = written(spark, distinct_values(rows, "v", "array<double>", k), "vectors")
    total = vectors.count()
    index = fitted(vectors, width, total, k) if total else None
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    enough = max(ENOUGH, int(np.ceil(index.share * total)))
    shared = spark.sparkContext.broadcast(index)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            cell, (starts, ids) = shared.value.cells(flat(t, "v", width, np.float64)), lists(t, "ids")
            part = shared.value.part(cell, ids[starts[:-1]]) if len(cell) else cell
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64()), pa.array(part, pa.int64())], names=["v", "ids", "cell", "part"])

    stored = vectors.select("v", "ids").mapInArrow(put, "v array<double>, ids array<bigint>, cell bigint, part bigint")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each part that a query's walk comes to, with the walk's limit, which says what cells it passes there."""
        own = shared.value
        for batch in batches:
            q = flat(pa.Table.from_batches([batch]), "v", width, np.float64)
            for k0 in range(0, len(q), AT_ONCE):
                whose, parts, limits = [], [], []
                for row in range(k0, min(len(q), k0 + AT_ONCE)):
                    walk, limit = own.walk(q[row], enough)
                    low, high = own.low[walk], own.high[walk]
                    # a cell's parts follow each other
                    at = np.unique(np.concatenate([low, *(np.arange(x, y + 1) for x, y in zip(low[high > low], high[high > low]))]))
                    whose += [row] * len(at)
                    parts += at.tolist()
                    limits += [limit] * len(at)
                sent = batch.take(pa.array(whose, pa.int64()))
                yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(limits, pa.float64()), pa.array(parts, pa.int64())], names=["query_id", "v", "limit", "part"])

    asked = rows.where(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    # walks are work that few bytes don't show: a number of tasks is given
    asked = asked.repartition(max(1, min(TASKS, total // WALKS)), "query_id").mapInArrow(ask, "query_id bigint, v array<double>, limit double, part bigint")

    def prepare(held: pa.Table) -> tuple:
        held = held.sort_by("cell")
        cell = held.column("cell").to_numpy()
        starts, every = lists(held, "ids")
        kinds, first = np.unique(cell, return_index=True)
        return flat(held, "v", width, np.float64), kinds, np.append(first, len(cell)), starts, every, every[starts[:-1]]

    def answer(state: tuple, asks: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, kinds, first, starts, every, least = state
        out = []
        limits, q = asks.column("limit").to_numpy(), flat(asks, "v", width, np.float64)
        for row, own in enumerate(asks.column("query_id").to_pylist()):
            place = np.flatnonzero(shared.value.passed(q[row], limits[row], kinds))
            n = first[place + 1] - first[place]
            entries = np.repeat(first[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            if not len(entries):
                continue
            score, want = np.einsum("ij,j->i", x[entries], q[row]), k + 1
            while True:
                order = top(score, least[entries], want)
                names = named(entries[order], score[order], starts, every, own)
                if len(names) >= k or want >= len(entries):
                    break
                want *= 2
            out += [(own, i, s) for s, i in sorted(names, key=lambda x: (-x[0], x[1]))[:k]]
        a, b, c = zip(*out) if out else ((), (), ())
        return np.array(a, np.int64), np.array(b, np.int64), np.array(c, float)

    return best(searched(asked, stored, prepare, answer, "score", QUERY_BLOCK), k, "score", True)

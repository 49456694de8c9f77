"""Exact top-k search of binary codes by Hamming distance: incremental multi-index hashing.

A code is cut into segments of SEGMENT bits, each with a table from its value to the codes that hold it. A query looks up
its segments' values, then values one bit away, two bits away and so on, one segment after the other. After segment s at
radius r every code within m * r + s (of m segments, s from 0) has been seen, since a code further than that from each
look-up is further in all. When the k-th verified distance is covered by that, the search ends: the result is exact,
ties to the smaller id.

Binary codes of vectors are the signs of their components (1: above 0). Vectors that are null, hold a null component or
have another length than most take no part. Equal codes are searched once, with their k + 1 smallest ids; a query's own id is
left out. With fewer candidates than k all are returned. A vec_id that repeats is one candidate, at its nearest code, and one
query, with its smallest code. Extra columns are ignored, an empty table gives no rows.

Codes are dealt into parts of an eighth of all, PART_ROWS at most; a part's tables are built once, and every query looks into
every part (its codes go out once for each part, 8 bytes and the ids of a row go out once). The search is exact in each part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import best, distinct_values, flat, lists, named, part_rows, searched

SEGMENT = 16
#: Codes of a part, from and to, and queries of one task.
LEAST_ROWS, PART_ROWS, QUERY_BLOCK = 8192, 1 << 20, 1 << 20
#: Queries searched together, and codes verified together.
AT_ONCE, PAIRS = 64, 1 << 21


def sign_codes(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, code (binary, whole segments) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    rows = table.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0").where(~F.exists("v", lambda x: x.isNull()))
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    width = width[0]["n"] if width else 0

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = flat(pa.Table.from_batches([batch]), "v", width, np.float64) > 0
            bits = np.pad(bits, ((0, 0), (0, -width % SEGMENT)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], names=["vec_id", "code"])

    return rows.where(F.size("v") == width).mapInArrow(code, "vec_id bigint, code binary")


@lru_cache(1)
def masks() -> list[np.ndarray]:
    """Of each radius the values with so many bits."""
    every = np.arange(1 << SEGMENT, dtype=np.uint32)
    n = np.bitwise_count(every)
    return [every[n == r] for r in range(SEGMENT + 1)]


class Index:
    def __init__(self, codes: np.ndarray):
        """codes: a row of uint16 segments for each code."""
        self.codes = codes
        self.order = [np.argsort(column, kind="stable") for column in codes.T]
        self.starts = [np.searchsorted(column[o], np.arange((1 << SEGMENT) + 1)) for column, o in zip(codes.T, self.order)]

    def search(self, q: np.ndarray, need: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, code, distance of the codes within the distance at which the ids of `need` (of each code) first reach `want`, of
        all rows of q at once. A code counts at the first radius and segment that find it, which its own distances tell."""
        m = q.shape[1]
        alive, reached, limit = np.arange(len(q)), np.zeros((len(q), m * SEGMENT + 1), np.int64), np.full(len(q), m * SEGMENT)
        rows, at, far = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, np.int64)]
        for r in range(SEGMENT + 1):
            for s in range(m):
                if not len(alive):
                    break
                values = masks()[r][None, :] ^ q[alive, s].astype(np.uint32)[:, None]
                low = self.starts[s][values]
                n = self.starts[s][values + 1] - low
                # rows are taken together as far as their codes are PAIRS
                cuts = np.flatnonzero(np.diff(np.cumsum(n.sum(1)) // PAIRS)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(alive)]):
                    self.looked_up(low[a:b], n[a:b], alive[a:b], q, need, r, s, reached, rows, at, far)
                done = reached[alive, : m * r + s + 1].sum(1) >= want
                limit[alive[done]] = m * r + s
                alive = alive[~done]
        row, code, d = np.concatenate(rows), np.concatenate(at), np.concatenate(far)
        near = d <= limit[row]
        return row[near], code[near], d[near]

    def looked_up(self, low, n, whose, q, need, r, s, reached, rows, at, far) -> None:
        """Verify the codes of look-ups [low, low + n) of rows `whose`, and note those that segment s at radius r finds first."""
        hit = np.flatnonzero(n)
        who, low, n = whose[hit // n.shape[1]], low.ravel()[hit], n.ravel()[hit]
        found = self.order[s][np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        who = np.repeat(who, n)
        d = np.bitwise_count(self.codes[found] ^ q[who])
        fresh = ~((d[:, :s] <= r).any(1) | (d[:, s:] < r).any(1))
        who, found, d = who[fresh], found[fresh], d[fresh].sum(1).astype(np.int64)
        np.add.at(reached, (who, d), need[found])
        rows.append(who)
        at.append(found)
        far.append(d)


def nearest(codes: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, distance of the k nearest of every row of codes(vec_id, code) for which `queries` holds."""
    spark = codes.sparkSession
    stored = written(spark, distinct_values(codes, "code", "binary", k), "codes")
    total = stored.count()
    parts = max(1, -(-total // part_rows(total, LEAST_ROWS, PART_ROWS)))
    rows = stored.withColumn("part", F.pmod(F.xxhash64("code"), F.lit(parts)).cast("long"))
    asked = codes.where(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("code").alias("code"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def segments(t: pa.Table) -> np.ndarray:
        raw = t.column("code").to_pylist()
        return np.frombuffer(b"".join(raw), np.uint16).reshape(len(raw), -1)

    def prepare(held: pa.Table) -> tuple:
        return Index(segments(held)), *lists(held, "ids")

    def answer(state: tuple, asks: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        index, starts, every = state
        need, out = np.diff(starts), []
        own, q = asks.column("query_id").to_numpy(), segments(asks)
        for k0 in range(0, len(q), AT_ONCE):
            # the query's own id may be among them, and an id may have several codes
            left, want = np.arange(k0, min(len(q), k0 + AT_ONCE)), k + 1
            while len(left):
                row, at, far = index.search(q[left], need, want)
                order = np.lexsort((far, row))
                ends = np.searchsorted(row[order], np.arange(len(left) + 1))
                again = []
                for j, x in enumerate(left.tolist()):
                    mine = order[ends[j] : ends[j + 1]]
                    names = named(at[mine], far[mine], starts, every, own[x])
                    if len(names) >= k or len(mine) == len(need):
                        out += [(own[x], i, d) for d, i in sorted(names)[:k]]
                    else:
                        again.append(x)
                left, want = np.array(again, int), want * 2
        q, v, d = zip(*out) if out else ((), (), ())
        return np.array(q, np.int64), np.array(v, np.int64), np.array(d, float)

    found = searched(asked, rows, prepare, answer, "distance", QUERY_BLOCK)
    return best(found, k, "distance", False).withColumn("distance", F.col("distance").cast("int"))

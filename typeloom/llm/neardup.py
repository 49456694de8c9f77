"""Near-duplicate documents: HyperMinHash sketches, banded, estimated, confirmed on the full sets.

1. Every whole text becomes its set of word shingles, a 128-bit signature of the set and a sketch (sketch.py).
2. Documents with equal sets are one class, known by its smallest doc_id; only these go on.
3. The sketches' bands put classes into buckets. Buckets with equal members count once.
4. In a bucket, classes are grouped by collision-corrected estimates, with a margin of SIGMAS deviations: each class is
   compared with those not yet reached, so a tight group costs about its size and never its square.
5. The suspects so grouped get their full sets, and within each group of suspects the links of at least the threshold
   are confirmed in the same way: a comparison is left out only between documents already known to be connected.
6. Components of the confirmed links give each document the smallest doc_id that it reaches.

No pair is emitted but those that first connect two classes; large buckets and groups are dealt in pairs of blocks.
Null, empty and all-white texts have no shingles and stand alone. Repeated rows (equal doc_id) get equal results, each
row its own; a row without doc_id stands alone. Extra columns are ignored. What is read again is written in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, map_arrow, written
from .components import components
from .sketch import REGISTERS, band_keys, band_length, estimates, registers, shingles, signature

SIGMAS = 6
#: Classes of a bucket that meet in one task; the same for full sets, and shingles of those.
BUCKET_BLOCK, SET_BLOCK, SET_VALUES = 8192, 2048, 3_000_000
#: Ids broadcast at most (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, sig, sketch of every document."""

    def make():
        def f(batch: pa.RecordBatch) -> list:
            sets = [shingles(t, k) for t in batch.column(1).to_pylist()]
            return [
                batch.column(0),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array([signature(x) for x in sets], pa.binary()),
                pa.array([registers(x).tobytes() if len(x) else None for x in sets], pa.binary()),
            ]

        return f

    return map_arrow(doc_columns(docs), make, "doc_id bigint, n bigint, sig binary, sketch binary")


def banded(classes: DataFrame, band: int) -> DataFrame:
    """key, rep: one row for each band of each class."""

    def make():
        def f(batch: pa.RecordBatch) -> list:
            keys = band_keys(as_sketches(batch.column(1).to_pylist()), band)
            return [pa.array(keys.ravel(), pa.int64()), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]), pa.int64())]

        return f

    return map_arrow(classes.select("rep", "sketch"), make, "key bigint, rep bigint")


def as_sketches(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint16).reshape(-1, REGISTERS)


def reached(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The first member that each of n members reaches. near(i, others): those of others that i links to. Each member
    is compared with the members not yet reached only."""
    root, left = np.arange(n), np.arange(n)
    while len(left):
        first, left = left[0], left[1:]
        todo = [first]
        while todo and len(left):
            found = near(todo.pop(), left)
            if len(found):
                root[found] = first
                left = np.setdiff1d(left, found, assume_unique=True)
                todo.extend(found.tolist())
    return root


def likely(sketches: np.ndarray, n: np.ndarray, threshold: float, i: int, others: np.ndarray) -> np.ndarray:
    """Those of others that may reach the threshold with i: by size, then by estimate and its margin."""
    others = others[np.minimum(n[i], n[others]) >= threshold * np.maximum(n[i], n[others])]
    out = []
    for k in range(0, len(others), 4096):
        part = others[k : k + 4096]
        e, used = estimates(sketches[i], sketches[part], n[i], n[part])
        out.append(part[e >= threshold - SIGMAS * np.sqrt(threshold * (1 - threshold) / used)])
    return np.concatenate(out) if out else others


def suspects(members: np.ndarray, sketches: np.ndarray, n: np.ndarray, threshold: float) -> np.ndarray:
    return reached(len(members), lambda i, others: likely(sketches, n, threshold, i, others))


def confirmed(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Exact: 100 * intersection >= percent * union. The sketch only spares comparisons that can't succeed."""
    n = np.array([len(x) for x in sets], np.int64)
    sketches = np.stack([registers(x) for x in sets])

    def near(i: int, others: np.ndarray) -> np.ndarray:
        own = sets[i]
        keep = []
        for j in likely(sketches, n, percent / 100, i, others).tolist():
            both = np.concatenate([own, sets[j]])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= percent * (len(both) - common):
                keep.append(j)
        return np.array(keep, np.int64)

    return reached(len(sets), near)


def in_blocks(rows: DataFrame, group: str, blocks: str) -> DataFrame:
    """rows with a, b: groups of several blocks are dealt to each pair of their blocks, others to (0, 0)."""
    dealt = rows.withColumn("_i", F.pmod(F.xxhash64("rep"), F.col(blocks))).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col(blocks) - 1, F.lit(0)))))
    dealt = dealt.where((F.col(blocks) <= 1) | (F.col("_i") != F.col("_j")))
    return dealt.withColumn("a", F.least("_i", "_j")).withColumn("b", F.greatest("_i", "_j")).drop("_i", "_j", blocks)


def linked(rows: DataFrame, work: Callable[[list[int], list[int], list[bytes]], np.ndarray]) -> DataFrame:
    """u, v: what work(reps, ns, payloads) connects in each group of rows(g, a, b, rep, n, payload). The groups of a
    partition are read in order, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [])

        def done() -> tuple[list[int], list[int]]:
            reps = held[0]
            if len(reps) < 2:
                return [], []
            root = work(*held)
            return [r for r, k in zip(reps, root) if reps[k] != r], [reps[k] for r, k in zip(reps, root) if reps[k] != r]

        for batch in batches:
            us: list[int] = []
            vs: list[int] = []
            for g, a, b, rep, n, payload in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if (g, a, b) != key:
                    u, v = done()
                    us += u
                    vs += v
                    key, held = (g, a, b), ([], [], [])
                held[0].append(rep)
                held[1].append(n)
                held[2].append(payload)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
        u, v = done()
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    dealt = rows.select("g", "a", "b", "rep", "n", "payload").repartition("g", "a", "b").sortWithinPartitions("g", "a", "b", "rep")
    return dealt.mapInArrow(run, "u bigint, v bigint")


def buckets(bands: DataFrame) -> DataFrame:
    """key, rep, blocks of the buckets with two members or more; of buckets with the same members, one."""
    dealt = bands.repartition("key")
    sizes = dealt.groupBy("key").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("rep")).alias("all"), F.min("rep").alias("least")).where("k > 1")
    kept = sizes.groupBy("k", "all", "least").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("k") / BUCKET_BLOCK).cast("long").alias("blocks"))
    return dealt.join(kept, "key")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of documents. words: of a shingle; percent: of the least
    similarity that links."""
    spark, threshold = docs.sparkSession, percent / 100
    band = band_length(threshold)
    all_docs = written(spark, sketched(docs, words), "sketches")
    classes = all_docs.where("n > 0 and doc_id is not null").groupBy("sig").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("one"))
    classes = written(spark, classes.selectExpr("sig", "one.doc_id rep", "one.n n", "one.sketch sketch"), "classes")

    member = buckets(banded(classes, band)).join(classes.select("rep", "n", F.col("sketch").alias("payload")), "rep")
    member = in_blocks(member.withColumnRenamed("key", "g"), "g", "blocks")
    grouped = components(spark, linked(member, lambda reps, n, raw: suspects(np.array(reps), as_sketches(raw), np.array(n), threshold)))

    grouped = written(spark, grouped.join(classes.selectExpr("rep node", "n"), "node").selectExpr("node rep", "root g", "n"), "suspects")
    sizes = grouped.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / SET_BLOCK), F.ceil(F.sum("n") / SET_VALUES)).cast("long").alias("blocks"))
    wanted = grouped.select("rep").distinct()
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)

    def make():
        def f(batch: pa.RecordBatch) -> list:
            return [batch.column(0), pa.array([shingles(t, words).tobytes() for t in batch.column(1).to_pylist()], pa.binary())]

        return f

    texts = doc_columns(docs).join(wanted, F.col("doc_id") == F.col("rep"), "left_semi")
    # equal doc_ids may repeat with unequal texts: the class's own text is the one with its number of shingles
    sets = map_arrow(texts, make, "rep bigint, payload binary")
    sets = sets.join(grouped, "rep").where(F.length("payload") == 8 * F.col("n")).dropDuplicates(["rep"]).join(sizes, "g")
    links = linked(in_blocks(sets, "g", "blocks"), lambda reps, n, raw: confirmed([np.frombuffer(x, np.uint64) for x in raw], percent))
    found = components(spark, links)

    known = classes.select("sig", "rep").join(found.selectExpr("node rep", "root"), "rep", "left").selectExpr("sig", "coalesce(root, rep) root")
    out = all_docs.selectExpr("doc_id", "n n_shingles", "case when n > 0 then sig end sig").join(known, "sig", "left")
    return out.selectExpr("doc_id", "n_shingles", "coalesce(root, doc_id) component_id").withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))

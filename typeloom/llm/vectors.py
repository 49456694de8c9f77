"""Searches of a stated query set against all rows, part by part.

Rows are dealt into parts. Each query goes to the parts that it asks for; a part is held and indexed once in a task, and its
queries stream past it. Only a part with more than a block of queries is held in several tasks, so copies of rows never
outweigh the queries that they spare moving. At most k rows of a query leave a part, and the best k of all parts are kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import with_group, written

#: Most tasks of a search.
TASKS = 10_000

Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def part_rows(total: int, least: int, most: int) -> int:
    """Rows of a part: an eighth of all, within bounds, so that small tables are dealt over tasks too."""
    return max(least, min(most, -(-total // 8)))


def searched(asked: DataFrame, rows: DataFrame, prepare: Callable[[pa.Table], object], answer: Callable[[object, pa.Table], Found], measure: str, block: int) -> DataFrame:
    """query_id, vec_id, measure: answer(prepare(the part's rows), some of its queries) over asked(part, query_id, ..) and
    rows(part, ..). block: queries of a part beyond which its rows are held by one more task. Both sides are dealt by part and
    block and read in order: of each group first the rows and then the queries."""
    spark = rows.sparkSession
    asked = written(spark, asked, "asked")
    blocks = asked.groupBy("part").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    blocks = written(spark, blocks, "blocks")
    groups = blocks.agg(F.sum("blocks")).collect()[0][0] or 0
    of_rows = with_group(rows, blocks, "part", "part").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    of_queries = with_group(asked, blocks, "part", "query_id").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")))
    dealt = of_rows.drop("blocks").withColumn("is_query", F.lit(False)).unionByName(of_queries.drop("blocks").withColumn("is_query", F.lit(True)), allowMissingColumns=True)
    dealt = dealt.select("part", "block", "is_query", *[c for c in dealt.columns if c not in ("part", "block", "is_query")])
    # a number is given, so that parts that are small in bytes but not in work stay apart
    dealt = dealt.repartition(max(1, min(TASKS, 3 * groups)), "part", "block").sortWithinPartitions("part", "block", "is_query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, state = None, [], None
        for batch in batches:
            part, block, is_query = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(block) != 0) | (np.diff(is_query.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if b <= a:
                    continue
                if (now := (part[a], block[a])) != key:
                    key, held, state = now, [], None
                piece = batch.slice(a, b - a)
                if not is_query[a]:
                    held.append(piece)
                elif held or state is not None:
                    if state is None:
                        state, held = prepare(pa.Table.from_batches(held)), []
                    q, v, s = answer(state, pa.Table.from_batches([piece]))
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", measure])

    return dealt.mapInArrow(run, f"query_id bigint, vec_id bigint, {measure} double")


def best(found: DataFrame, k: int, measure: str, largest: bool) -> DataFrame:
    """query_id, rank, vec_id, measure: each query's k best, ties to the smaller vec_id, each vec_id once. A part gives k
    rows of a query at most."""
    by = F.desc(measure) if largest else F.asc(measure)
    once = found.repartition("query_id").withColumn("_one", F.row_number().over(Window.partitionBy("query_id", "vec_id").orderBy(by))).where("_one = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(by, "vec_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", measure)


def named(order: np.ndarray, value: np.ndarray, starts: np.ndarray, ids: np.ndarray, own: int) -> list[tuple[float, int]]:
    """(value, id) of the ids of entries `order`, nearest first; not `own`, each id once, by its nearest entry."""
    out: dict[int, float] = {}
    for p, x in zip(order.tolist(), value.tolist()):
        for i in ids[starts[p] : starts[p + 1]].tolist():
            if i != own:
                out.setdefault(i, x)
    return [(x, i) for i, x in out.items()]


def distinct_values(rows: DataFrame, column: str, kind: str, k: int) -> DataFrame:
    """column, ids: each distinct value of rows(vec_id, column) with its k + 1 smallest ids. Each task keeps no more ids
    of a value before the shuffle, so a value that a third of all rows hold is a short list from each task."""

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = batch.column(0).to_numpy(), batch.column(1)
            if pa.types.is_list(values.type):
                keys = [x.tobytes() for x in flat(pa.Table.from_batches([batch]), column, len(values[0]) if len(values) else 1, np.float64)]
            else:
                keys = values.to_pylist()
            seen: dict[bytes, set[int]] = {}
            keep = []
            for i in np.argsort(ids, kind="stable").tolist():
                own = seen.setdefault(keys[i], set())
                if len(own) <= k and ids[i] not in own:
                    own.add(ids[i])
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    short = rows.select("vec_id", column).mapInArrow(few, f"vec_id bigint, {column} {kind}")
    # two steps, so that a common value's short lists from many tasks don't meet at once
    part = short.groupBy(column, F.pmod(F.spark_partition_id(), F.lit(64)).alias("salt")).agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    return part.groupBy(column).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))


def lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts of each row's list (and the end of the last), and all elements."""
    column = table.column(name).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]).astype(np.int64), column.flatten().to_numpy()


def flat(table: pa.Table, name: str, width: int, dtype) -> np.ndarray:
    column = table.column(name).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, width) if len(column) else np.zeros((0, width), dtype)


def top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest scores, ties to the smaller id."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]

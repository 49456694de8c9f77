"""Shared pieces of the training-data operators: reading tables, mapping texts in Arrow batches,
deterministic bounded samples and a place for written intermediate tables."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that the contracts' word pattern excludes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, one under /tmp if the executors are threads of
    this machine, else RuntimeError: a folder of one machine would lose tables with it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file:///tmp/checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under one of this application's own."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: cuts lineage and survives lost executors. The table stays
    until discard() or clean(), since results that are not yet computed may read it."""
    at = place(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def removed(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    own = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/"
    for at in {f.rpartition("/")[0] for t in tables for f in t.inputFiles()}:
        if own.split(":")[-1].strip("/") in at:
            removed(spark, at)


def clean(spark: SparkSession) -> None:
    """Delete all tables that this application has written; for the end of a job, when its results are stored."""
    removed(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


#: Rows of a table that may be broadcast (its rows are short: a few dozen bytes).
BROADCAST_ROWS = 200_000


def with_group(rows: DataFrame, groups: DataFrame, key: str, order: str, salts: int = 64, most: int = BROADCAST_ROWS) -> DataFrame:
    """rows joined null-safely with groups (one row for each value of the group column `key`): groups are broadcast if they are
    counted to be few; else each group goes to `salts` places, among which the rows of a hot one are dealt by `order`."""
    groups = groups.withColumnRenamed(key, "_group")
    if groups.count() <= most:
        return rows.join(F.broadcast(groups), F.col(key).eqNullSafe(F.col("_group"))).drop("_group")
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)))
    spread = groups.withColumn("_to", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(spread, F.col(key).eqNullSafe(F.col("_group")) & (F.col("_salt") == F.col("_to"))).drop("_group", "_salt", "_to")


def fold(key: str | Column, parts: int) -> Column:
    """crc32 of the key as text, modulo parts: the contracts' split into learned and held-out rows."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def sampled(df: DataFrame, key: str, most: int, per: str | None = None) -> DataFrame:
    """About `most` rows (for each value of `per`), chosen by a hash of the key; all rows if they are no more.
    The same rule at every size; reruns agree."""
    u = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    if per is None:
        n = df.agg(F.count("*").alias("n")).collect()[0]["n"]
        return df.where(u < most / max(1, n))
    counts = df.groupBy(per).agg(F.count("*").alias("_n"))
    return with_group(df, counts, per, key).where(u < most / F.col("_n")).drop("_n")


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], schema: str) -> DataFrame:
    """mapInArrow; make() runs once in each task and returns the function from a batch to the result's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch):
                cols = f(part)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).fieldNames()
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` bytes, so that long texts don't meet in memory."""
    n = batch.num_rows
    step = max(1, int(n * most / max(most, batch.nbytes)))
    for k in range(0, n, step):
        yield batch.slice(k, step)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def doc_columns(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Only the key and the text: other columns, clashing names included, don't reach the operator."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    """A column of lists as arrays, without a Python object for each number."""
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return np.split(flat.flatten().to_numpy(zero_copy_only=False), np.cumsum(flat.value_lengths().to_numpy(zero_copy_only=False))[:-1]) if len(flat) else []


def fitted_in_task(sample: DataFrame, order: str, fit: Callable[[pa.Table], object]) -> object:
    """fit(rows of a bounded sample, in order), run in one task, so that the driver gets the model only. A lost task is
    run again and gives the same model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        rows = pa.Table.from_batches(held, held[0].schema) if held else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], names=["model"])

    found = sample.repartition(1).sortWithinPartitions(order).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(found[0]["model"])) if found else fit(None)

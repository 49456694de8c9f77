"""The symbol index kept up to date as tables of entries arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import ranked
from ..operators.keys import keyed
from ..schema import DIES


def index_arrivals(spark: SparkSession, folder: str, index_at: str, checkpoint_at: str) -> StreamingQuery:
    """Each batch of new Parquet files under folder adds its own index as the folder batch=<number> below index_at; a batch
    that runs again overwrites its folder, so results are exactly once. latest() gives the best entry of each name."""

    def put(batch: DataFrame, number: int) -> None:
        ranked(batch).write.mode("overwrite").parquet(f"{index_at}/batch={number}")

    return spark.readStream.schema(DIES).parquet(folder).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint_at).trigger(availableNow=True).start()


def latest(spark: SparkSession, index_at: str) -> DataFrame:
    """symbol, die_offset, cu_offset, tag (and source_id) over all batches: the best entry of each name, a complete one before a
    declaration whichever came first; of equals, the first batch's stays (C5)."""
    rows = spark.read.parquet(index_at)
    best = rows.groupBy(*keyed(rows, "symbol")).agg(F.min(F.struct("b.partial", "batch", "b.cu_offset", "b.die_offset", "b.tag")).alias("b"))
    return best.select(*keyed(rows, "symbol"), "b.die_offset", "b.cu_offset", "b.tag")

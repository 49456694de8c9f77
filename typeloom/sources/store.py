"""Tables written in the cluster's shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir. Where that is unset, one under /tmp if the executors are threads of
    this machine, else RuntimeError: a folder of one machine would lose tables with it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file:///tmp/checkpoints"
    return f"{at.rstrip('/')}/{spark.sparkContext.applicationId}"


def store(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """rows as a Parquet table in the shared folder, reread: lineage is cut, a plan that joins its own result stays small, and a
    lost executor costs nothing. The table stays until clean(), since results that are not yet computed may read it."""
    at = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(at)
    return spark.read.schema(rows.schema).parquet(at)


def together(tables: list[DataFrame]) -> DataFrame:
    """Stored tables of one schema as one: a scan of its own for each would cost the driver a broadcast each."""
    at = dict.fromkeys(f.rpartition("/")[0] for t in tables for f in t.inputFiles())
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*at)


def clean(spark: SparkSession) -> None:
    """Delete all tables that this application has stored; for the end of a job, when its results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

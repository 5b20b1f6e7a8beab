"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset on a local master, a temporary folder is set instead."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="scanweave-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Session setting that names the folder of the run whose tables are being written.
RUN = "spark.scanweave.run"


def fresh(spark: SparkSession, name: str) -> str:
    return f"{spark.conf.get(RUN, None) or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """A folder in the shared one for all tables that operators write inside the block. What an operator returns reads them
    lazily, so the caller drops the folder after having written or used that."""
    before = spark.conf.get(RUN, None)
    folder = f"{before or shared_dir(spark)}/run-{uuid.uuid4().hex}"
    spark.conf.set(RUN, folder)
    try:
        yield folder
    finally:
        spark.conf.set(RUN, before) if before else spark.conf.unset(RUN)


def drop(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, through the file system that Spark sees."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: the lineage ends there, and a lost executor costs nothing."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What one batch between the JVM and Python holds at most, where the session allows more.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, after lowering the session's limits of an Arrow batch: texts are long, and a batch is held on both sides of the
    pipe. Limits that are lower already stay."""
    conf = df.sparkSession.conf
    rows = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows <= 0 or rows > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    size = conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if not re.fullmatch(r"\d+b?", size) or not 0 < int(size.rstrip("b")) <= BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df

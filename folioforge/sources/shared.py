"""Tables between the steps of a job, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local master (tests) gets a new one; a cluster must name its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage, survives lost executors, runs once."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What holds while ``packed`` writes: tasks of even size for few files, and no shuffle files after the table is there.
_WRITING = {"spark.sql.parquet.compression.codec": "zstd", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def packed(df: DataFrame, what: str) -> DataFrame:
    """``materialize`` for tables of large texts: written smaller, and the shuffles that made the table are removed as soon as it stands."""
    conf = df.sparkSession.conf
    files = {"spark.sql.files.minPartitionNum": str(4 * df.sparkSession.sparkContext.defaultParallelism)}
    before = {k: conf.get(k, None) for k in _WRITING | files}
    try:
        for k, v in (_WRITING | files).items():
            conf.set(k, v)
        return materialize(df, what)
    finally:
        for k, v in before.items():
            conf.set(k, v) if v is not None else conf.unset(k)


#: Rows of a task that sorts or folds what is dealt to it.
TASK_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys to tasks of about ``TASK_ROWS`` rows, to ``spark.sql.shuffle.partitions`` tasks at least.

    The number stands: adaptive execution would put partitions together by their bytes, whatever a row costs.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // TASK_ROWS)), *keys)

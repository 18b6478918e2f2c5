"""Batches that are there whole or not at all: data first, then one row of a ledger; readers join the ledger.

A batch is written to a folder of its own (an attempt). Only when all its files are in place is a row appended that names
the attempt, in one file that appears by one rename. A writer that dies before that leaves a folder that no reader looks
into; the batch is written again as another attempt. A batch that the ledger has is not written twice, so the ledger
serves ``foreachBatch``, which may run a batch again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at a path, or one without rows where nothing has been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class Ledger:
    """An append-only table of batches below ``path``."""

    ROWS = T.StructType([T.StructField("batch", T.StringType()), T.StructField("attempt", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("at", T.TimestampType())])

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def batches(self) -> DataFrame:
        """(batch, attempt, rows, at): of a batch that two writers have recorded, the attempt recorded first."""
        rows = read_or_empty(self.spark, f"{self.path}/ledger", self.ROWS)
        return rows.groupBy("batch").agg(F.min(F.struct("at", "attempt", "rows")).alias("x")).select("batch", "x.attempt", "x.rows", "x.at")

    def has(self, batch: str) -> bool:
        return not self.batches().where(F.col("batch") == batch).isEmpty()

    def append(self, batch: str, rows: DataFrame) -> bool:
        """Writes a batch, unless the ledger has it; whether it was written."""
        if self.has(batch):
            return False
        attempt = f"{batch}-{uuid.uuid4().hex}"
        folder = f"{self.path}/data/attempt={attempt}"
        rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema)).write.parquet(folder)
        self._record(batch, attempt, self.spark.read.schema(self.schema).parquet(folder).count())
        return True

    def _record(self, batch: str, attempt: str, rows: int) -> None:
        row = self.spark.createDataFrame([(batch, attempt, rows)], "batch string, attempt string, rows long").withColumn("at", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")

    def read(self) -> DataFrame:
        """The rows of all recorded batches; folders of other attempts are pruned by the join."""
        whole = T.StructType([*self.schema.fields, T.StructField("attempt", T.StringType())])
        rows = read_or_empty(self.spark, f"{self.path}/data", whole)
        return rows.join(self.batches().select("attempt"), "attempt", "left_semi").select(*self.schema.names)

    def sink(self, name: str = "") -> Callable[[DataFrame, int], None]:
        """A function for ``foreachBatch``: each batch of the stream is one of the ledger."""

        def write(rows: DataFrame, number: int) -> None:
            self.append(f"{name}{number}", rows)

        return write

    def orphans(self) -> DataFrame:
        """(attempt): folders that no row names, of writers that died or still write."""
        rows = read_or_empty(self.spark, f"{self.path}/data", T.StructType([T.StructField("attempt", T.StringType())]))
        return rows.select("attempt").distinct().join(self.batches().select("attempt"), "attempt", "left_anti")

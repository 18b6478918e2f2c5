"""Queries that write and read again: batches of a ledger, and imports as versions of working tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ledger import Ledger
from ..sources.shared import shared_dir
from ..sources.store import WORKING, BookStore, import_drafts
from .derived import divisions, table, verses
from .registry import query, with_tables


@query("SELECT event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY event_type")
def ledger_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended in four batches, two of which come twice: each is read once."""
    events = table(spark, sf_dir, "events")
    ledger = Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}", events.schema)
    for k in (0, 1, 1, 2, 3, 0):
        ledger.append(f"part-{k}", events.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == k))
    return ledger.read().groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query(
    with_tables(
        """SELECT 'b' || v.book_id AS book_id, 'o' || division_id AS division_id, 'v' || v.ordinal AS id,
      CASE WHEN v.book_id % 10 = 0 AND v.ordinal % 5 <> 4 AND v.ordinal % 2 = 0 THEN text || '!' ELSE text END AS text, v.book_id % 10 = 0 AND v.ordinal % 5 = 4 AS orphaned
    FROM verses v"""
    )
)
def imported_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verses after two imports: all books, then every tenth one anew, with changed and with missing verses."""
    store = BookStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", WORKING)
    v = verses(spark, sf_dir)
    book = F.concat(F.lit("b"), F.col("book_id").cast("string")).alias("book_id")

    def draft(rows: DataFrame, text: F.Column) -> dict[str, DataFrame]:
        own = rows.select(book, F.concat(F.lit("o"), F.col("division_id").cast("string")).alias("division_id"), F.concat(F.lit("v"), F.col("ordinal").cast("string")).alias("id"), "number", text.alias("text"), F.lit(1.0).alias("confidence"))
        d = divisions(spark, sf_dir).select(book, F.concat(F.lit("o"), F.col("id").cast("string")).alias("id"), "ordinal", "kind", F.lit(None).cast("string").alias("title"))
        none = lambda ddl: spark.createDataFrame([], ddl)
        return {"verses": own, "divisions": d, "notes": none("book_id string, page long, block_id string, text string"), "set_aside": none("book_id string, page long, block_id string, text string")}

    import_drafts(store, draft(v, F.col("text")))
    again = v.where((F.col("book_id") % 10 == 0) & (F.col("ordinal") % 5 != 4))
    import_drafts(store, draft(again, F.when(F.col("ordinal") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    return store.read("verses").select("book_id", "division_id", "id", "text", "orphaned")

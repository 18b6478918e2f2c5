"""Contiguous shards of near-equal byte size (DataFrame functions only).

Documents stand in the order of their id. Their sizes become global prefix sums in two levels: a range partitioning
deals rows out in that order, a sum per partition gives each partition's offset, and a window within a partition
does the rest. A document goes to the shard in whose equal share of all bytes its middle byte lies, so shards are
runs of documents whose sizes differ from the target by less than one document.

Only (id, size, crc) rows are shuffled, never texts. The offsets are one row for each partition and the cuts one row
for each shard: their sizes don't depend on the number of documents.

Defined results: a null text has no bytes (size 1, crc 0), an empty one likewise; a null id sorts first; repeated
rows and equal ids are all kept, in the order (id, crc, size, place in the input); an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, shuffle_partitions


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32): UTF-8 bytes of the text and one more, and the text's CRC-32."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
    )


def byte_shards(sizes: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, start, shard, slot) of all rows of ``document_sizes``; ``start`` is a global byte offset."""
    parts = shuffle_partitions(sizes.sparkSession)
    # Written once: the bounds of a range partitioning come from a sample, so its partitions must not be computed twice.
    placed = materialize(
        sizes.withColumn("_at", F.monotonically_increasing_id())
        .repartitionByRange(parts, "doc_id", "text_crc32", "size", "_at")
        .withColumn("_part", F.spark_partition_id()),
        "shards",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
        .withColumn("_bytes_before", F.coalesce(F.sum("_bytes").over(before), F.lit(0)))
        .withColumn("_rows_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_bytes").over(Window.partitionBy()))
        .drop("_bytes", "_rows")
    )
    within = Window.partitionBy("_part").orderBy("doc_id", "text_crc32", "size", "_at")
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Written once too: the rows are read for the first row of each shard and again for their slots.
    rows = materialize(
        placed.join(F.broadcast(offsets), "_part")  # one row for each partition
        .withColumn("start", F.col("_bytes_before") + F.sum("size").over(running) - F.col("size"))
        .withColumn("_row", F.col("_rows_before") + F.row_number().over(within) - 1)
        .withColumn("shard", F.expr(f"int(least({shards - 1}, ((2 * start + size) * {shards}) div (2 * _total)))"))
        .select("doc_id", "size", "text_crc32", "start", "shard", "_row"),
        "shard-rows",
    )
    firsts = rows.groupBy("shard").agg(F.min("_row").alias("_first"))
    return rows.join(F.broadcast(firsts), "shard").select(  # one row for each shard
        "doc_id", "size", "text_crc32", "start", "shard", (F.col("_row") - F.col("_first")).alias("slot")
    )


def shard_table(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The digest of the sharding: where each document goes under the law of near-equal bytes."""
    return byte_shards(document_sizes(docs), shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: CRC-32 byte by byte, from a table that the query builds by the rule of the polynomial 0xEDB88320.
ORACLE_SQL = """
WITH RECURSIVE rule(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM rule WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM rule WHERE k = 8),
d AS (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, ''))::BIGINT + 1 AS size, hex(encode(coalesce(text, ''))) AS h
  FROM documents
), c AS (
  SELECT doc_id, size,
    xor(4294967295::UBIGINT, list_reduce(
      list_prepend(4294967295::UBIGINT, list_transform(range(size - 1), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT)),
      lambda a, b: xor(a >> 8, t[((xor(a, b) & 255) + 1)::BIGINT])))::BIGINT AS text_crc32
  FROM d, crc_table
), p AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total
  FROM c
), s AS (SELECT *, least(15, ((2 * start + size) * 16) // (2 * total))::INTEGER AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM s
"""

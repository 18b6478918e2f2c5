"""The book tables as they derive from the driver's tables, in DataFrame form and in SQL.

orders are divisions (the customer is the book), line items are verses, suppliers are pages; texts with Indic letters
come from Latin ones by a fixed translation, the same on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import dealt

#: Fixed values of the queries: Latin letters and what stands for them.
LATIN = "abcdefghijklmnopqrstuvwxyz"
INDIC = "\u0abe\u0a95\u0a96\u0a97\u0abf\u0a98\u0a9a\u0acd\u0ac0\u0a9c\u0a9f\u0aa4\u0aa6\u0aa8\u0acb\u0aaa\u0ae7\u0ab0\u0ab8\u0aae\u0ac1\u0ab5\u0ab2\u0ae8\u0aaf\u0abc"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows dealt evenly to tasks: what is done to whole texts costs many times the shuffle, and a file's row groups may be few or uneven."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("id"), (F.row_number().over(w) - 1).cast("long").alias("ordinal"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("kind"))


def verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem")
    li = dealt(lines, lines.count(), "l_orderkey").withColumn("ordinal", (F.row_number().over(order) - 1).cast("long"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("book_id"))
    text = F.concat(F.lit("passage "), F.col("l_partkey").cast("string"), F.lit(" of "), F.col("l_suppkey").cast("string"))
    flags = F.filter(F.array(F.when(F.col("l_discount") > 0.05, "no-number"), F.when(F.col("l_tax") > 0.06, "orthography"), F.when(F.col("l_quantity") < 5, "very-short")), lambda x: x.isNotNull())
    return li.join(o, "l_orderkey").select(
        "book_id",
        F.col("l_orderkey").alias("division_id"),
        F.col("ordinal").alias("id"),
        "ordinal",
        F.when(F.col("l_returnflag") == "A", "raw").when(F.col("l_returnflag") == "R", "proofed").otherwise("approved").alias("status"),
        text.alias("text"),
        F.when(F.col("l_tax") > 0.05, text).otherwise(F.concat(text, F.lit("."))).alias("ocr_text"),
        F.when(F.col("l_tax") > 0, F.floor((1 - F.col("l_discount")) * 100 + 0.5) / 100).alias("confidence"),
        (F.col("l_quantity") > 45).alias("orphaned"),
        (F.col("l_quantity") > 30).alias("ocr_changed"),
        F.when(F.col("l_linestatus") == "O", "imported").otherwise("split").alias("origin"),
        flags.alias("flags"),
        F.array((F.col("l_suppkey") % 50).cast("int"), (F.col("l_suppkey") % 50 + 1).cast("int")).alias("pages"),
        F.when(F.col("l_partkey") % 7 != 0, (F.col("l_partkey") % 90).cast("long")).alias("number"),
    )


CTE = """
divisions AS (
  SELECT o_custkey AS book_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS ordinal, o_orderstatus AS status, o_orderpriority AS kind FROM orders
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS ordinal FROM lineitem
), verses AS (
  SELECT o_custkey AS book_id, l_orderkey AS division_id, ordinal AS id, ordinal,
    CASE l_returnflag WHEN 'A' THEN 'raw' WHEN 'R' THEN 'proofed' ELSE 'approved' END AS status,
    'passage ' || l_partkey || ' of ' || l_suppkey AS text,
    'passage ' || l_partkey || ' of ' || l_suppkey || CASE WHEN l_tax > 0.05 THEN '' ELSE '.' END AS ocr_text,
    CASE WHEN l_tax > 0 THEN floor((1 - l_discount) * 100 + 0.5) / 100 END AS confidence,
    l_quantity > 45 AS orphaned, l_quantity > 30 AS ocr_changed, CASE l_linestatus WHEN 'O' THEN 'imported' ELSE 'split' END AS origin,
    list_filter([CASE WHEN l_discount > 0.05 THEN 'no-number' END, CASE WHEN l_tax > 0.06 THEN 'orthography' END, CASE WHEN l_quantity < 5 THEN 'very-short' END], lambda x: x IS NOT NULL) AS flags,
    [l_suppkey % 50, l_suppkey % 50 + 1] AS pages,
    CASE WHEN l_partkey % 7 <> 0 THEN l_partkey % 90 END AS number
  FROM numbered JOIN orders ON l_orderkey = o_orderkey
)"""


def edited_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verses as they are edited: ids by place, numbers as text, white space around some texts, pages and lineage."""
    v = verses(spark, sf_dir)
    text = F.when(F.col("ordinal") % 2 == 1, F.concat(F.lit("  "), "text", F.lit(" "))).otherwise(F.col("text"))
    lineage = F.when(F.col("ordinal") % 4 == 2, F.array(F.lit("old#1"), F.lit("old#2"))).otherwise(F.array(F.lit("old#1")))
    return v.select(
        "book_id", "division_id", F.concat(F.lit("p7-"), (F.col("ordinal") + 1).cast("string")).alias("id"), "ordinal", F.col("number").cast("string").alias("number"), F.lit("prose").alias("form"), text.alias("text"), "ocr_text", "status",
        "origin", lineage.alias("lineage"), "confidence", "flags", F.array(F.lit(7), F.lit(8)).alias("pages"),
    )


#: The same verses in SQL, behind ``CTE``.
EDITED_CTE = """, e AS (
  SELECT book_id, division_id, 'p7-' || (ordinal + 1) AS id, ordinal, number::VARCHAR AS number, CASE WHEN ordinal % 2 = 1 THEN '  ' || text || ' ' ELSE text END AS text, ocr_text, status, origin,
    CASE WHEN ordinal % 4 = 2 THEN ['old#1', 'old#2'] ELSE ['old#1'] END AS lineage, confidence, flags, [7, 8] AS pages, count(*) OVER (PARTITION BY book_id, division_id) AS n
  FROM verses
)"""


def indic(col: F.Column) -> F.Column:
    return F.translate(F.lower(col), LATIN, INDIC)


INDIC_SQL = f"translate(lower(text), '{LATIN}', '{INDIC}')"

"""Page ranges, page samples, and the readers and writers of page and package files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "page int, width_px int, height_px int, blocks array<struct<id:string,text:string,tag:string,reading_order:int,bbox:array<double>>>"


def pages_of_spec(rows: DataFrame, spec: str, pages: str) -> DataFrame:
    """Rows with a page for each number of a list such as ``12, 1-40, 300-``, in the book, each once."""
    part = F.trim(F.col("_part"))
    first = F.regexp_extract(part, "^(\\d+)", 1).try_cast("int")
    open_ = F.regexp_like(part, F.lit("^\\d+\\s*-\\s*$"))
    last = F.when(open_, F.col(pages)).otherwise(F.coalesce(F.regexp_extract(part, "-\\s*(\\d+)$", 1).try_cast("int"), first))
    out = rows.withColumn("_part", F.explode(F.split(spec, ","))).withColumn("_a", F.greatest(first, F.lit(1))).withColumn("_b", F.least(last, F.col(pages)))
    out = out.where("_a <= _b").withColumn("page", F.explode(F.sequence("_a", "_b"))).drop("_part", "_a", "_b")
    return out.distinct()


def page_spec_sql() -> str:
    """The SQL of the query over ranges ``2, 5-k, 30-``."""
    return """WITH o AS (SELECT o_orderkey, o_orderkey % 40 + 1 AS pages, o_orderkey % 9 + 3 AS k FROM orders),
r AS (SELECT o_orderkey, pages, 2 AS a, 2 AS b FROM o UNION ALL SELECT o_orderkey, pages, 5, k FROM o UNION ALL SELECT o_orderkey, pages, 30, pages FROM o),
x AS (SELECT DISTINCT o_orderkey, unnest(range(a, least(b, pages) + 1)) AS page FROM r)
SELECT o_orderkey, count(*) AS n, min(page) AS first, max(page) AS last FROM x GROUP BY 1"""


def sample_places(pages: Column, most: int = 12) -> Column:
    """Places (from 0) of at most ``most`` pages: the middles of equal slices."""
    step = pages.cast("double") / most
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda s: F.least(pages - 1, F.floor(step * (s + 0.5))).cast("long")))


def read_page_blocks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Blocks of page files (JSON, one page each): a row for each block; unreadable files give a row with their path and no page."""
    schema = f"{BLOCKS}, _corrupt_record string"
    raw = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(paths).withColumn("file", F.col("_metadata.file_path"))
    rows = raw.select("file", F.col("_corrupt_record").isNotNull().alias("unreadable"), "page", "width_px", "height_px", F.posexplode_outer("blocks").alias("place", "b"))
    return rows.select("file", "unreadable", "page", "width_px", "height_px", "place", F.col("b.id").alias("block_id"), F.col("b.text").alias("text"), F.col("b.tag").alias("tag"), F.col("b.reading_order").alias("reading_order"), F.col("b.bbox").alias("bbox"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files below a folder with their digests: (file, bytes, sha256, document)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("document"))


def verify_documents(files: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded digests (file, sha256) against the files: ok, changed or missing."""
    j = recorded.select("file", F.col("sha256").alias("_want")).join(files.select("file", "sha256"), "file", "left")
    return j.select("file", F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") == F.col("_want"), "ok").otherwise("changed").alias("state"))


def serialize_package(package: dict) -> bytes:
    """The canonical bytes of one package: keys in their order, tabs, a final line feed."""
    return (json.dumps(package, ensure_ascii=False, indent="\t") + "\n").encode()


def page_markdown(blocks: DataFrame) -> DataFrame:
    """(page, markdown) of blocks (page, reading_order, text, bucket): the body in reading order, notes below a rule."""
    rows = blocks.where(F.col("bucket").isin("body", "notes"))
    texts = lambda b: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("bucket") == b, F.struct("reading_order", "text")))), lambda x: x["text"]), "\n\n")
    g = rows.groupBy("page").agg(texts("body").alias("body"), texts("notes").alias("notes"))
    return g.select("page", F.when(F.col("notes") == "", F.col("body")).otherwise(F.concat_ws("\n\n---\n\n", "body", "notes")).alias("markdown"))


def page_coverage(boxes: DataFrame) -> DataFrame:
    """(page, coverage) of image boxes (page, width, height, page_width, page_height): the covered share, at most 1."""
    share = F.sum(F.col("width") * F.col("height")) / F.first(F.col("page_width") * F.col("page_height"))
    return boxes.groupBy("page").agg(F.least(F.lit(1.0), share).alias("coverage"))

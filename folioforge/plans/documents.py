"""Queries over whole book documents: made of orders and line items, walked, checked and built again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assemble
from ..operators import documents as docs
from ..sources.shared import packed as materialize
from .derived import divisions, verses
from .registry import query, with_tables

_HEAD = {
    "formatVersion": 1, "title": {"gu": "t"}, "language": "gu", "script": "gujr", "contentVersion": "1.0.0", "contentStatus": "draft", "source": {"edition": "e"}, "license": {"id": "public-domain"},
    "layers": [{"id": "gu", "kind": "original", "language": "gu", "script": "gujr", "label": {"gu": "l"}}], "primaryLayer": "gu",
}


def _documents(spark: SparkSession, sf_dir: str, faults: bool = False) -> DataFrame:
    """(book, document): a book for each customer with orders, a section for each order with line items, a verse for each line item."""
    import json

    book = F.concat(F.lit("b"), F.col("book_id").cast("string")).alias("book_id")
    d = divisions(spark, sf_dir).select(
        book, F.concat(F.lit("o"), F.col("id").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent_id"), "ordinal", F.lit("section").alias("kind"), F.lit(None).cast("string").alias("number"),
        F.create_map(F.lit("en"), F.col("kind")).alias("title"),
    )
    ordinal = F.col("ordinal") % 3 if faults else F.col("ordinal")
    text = F.when((F.col("book_id") % 10 == 0) & (F.col("ordinal") == 0), F.concat(F.lit("\u0001"), "text")).otherwise(F.col("text")) if faults else F.col("text")
    v = verses(spark, sf_dir).select(
        book, F.concat(F.lit("o"), F.col("division_id").cast("string")).alias("division_id"), F.concat(F.lit("v"), ordinal.cast("string")).alias("id"), "ordinal",
        F.col("number").cast("string").alias("number"), F.lit("prose").alias("form"), text.alias("text"),
    )
    built = docs.build_structures(docs.working_units(d, v, "gu"))
    head = json.dumps(_HEAD)[1:-1]
    return built.select(F.col("doc").alias("book"), F.concat(F.lit('{"id":"'), "doc", F.lit(f'",{head},"structure":'), "structure", F.lit("}")).alias("document"))


_UNITS = """, u AS (
  SELECT 'b' || v.book_id AS book, 'b' || v.book_id || '/o' || v.division_id AS parent_ref, 'b' || v.book_id || '/o' || v.division_id || '#v' || v.ordinal AS ref, 2 AS depth, 'verse' AS kind, 'v' || v.ordinal AS id,
    v.number::VARCHAR AS number, v.text AS text, NULL AS title FROM verses v JOIN divisions d ON d.book_id = v.book_id AND d.id = v.division_id
  UNION ALL SELECT DISTINCT 'b' || d.book_id, 'b' || d.book_id, 'b' || d.book_id || '/o' || d.id, 1, 'section', 'o' || d.id, NULL, NULL, d.kind FROM verses v JOIN divisions d ON d.book_id = v.book_id AND d.id = v.division_id)"""


@query(with_tables(_UNITS.lstrip() + " SELECT book, parent_ref, ref, depth, kind, id, number, text, title FROM u"))
def walked_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of nested documents, walked level by level."""
    u = docs.units(docs.walk_units(_documents(spark, sf_dir), "book"))
    return u.select(F.col("doc").alias("book"), "parent_ref", "ref", "depth", "kind", "id", "number", F.col("values")["gu"].alias("text"), F.get_json_object("title", "$.en").alias("title"))


@query(with_tables(_UNITS.lstrip() + " SELECT book, true AS same, count(*) FILTER (kind = 'verse') AS verses, count(*) FILTER (kind = 'section') AS sections FROM u GROUP BY book"))
def rebuilt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walked documents built again: the same trees, with the same hashes made anew."""
    before = materialize(_documents(spark, sf_dir), "documents")
    nodes = docs.walk_units(before, "book", stored=True)
    counts = docs.units(nodes).groupBy("doc").agg(F.count_if(F.col("kind") == "verse").alias("verses"), F.count_if(F.col("kind") == "section").alias("sections"))
    # Whole texts needn't meet: digests of what they say do.
    said = lambda document: F.sha2(F.to_json(F.parse_json(document)), 256)
    after = docs.rebuild_books(nodes).select(F.col("doc").alias("book"), said("document").alias("again"))
    said_before = before.select("book", said("document").alias("said"))
    return said_before.join(after, "book").join(counts.withColumnRenamed("doc", "book"), "book").select("book", (F.col("said") == F.col("again")).alias("same"), "verses", "sections")


@query(
    with_tables(
        """, j AS (SELECT v.book_id, v.division_id, v.ordinal, d.ordinal AS place FROM verses v JOIN divisions d ON d.book_id = v.book_id AND d.id = v.division_id),
    p AS (SELECT book_id, division_id, row_number() OVER (PARTITION BY book_id ORDER BY place) - 1 AS n FROM (SELECT DISTINCT book_id, division_id, place FROM j)),
    s AS (SELECT 'b' || book_id AS book, 'schema' AS code, '/structure/' || n || '/children/0/layers/gu' AS path FROM p WHERE book_id % 10 = 0),
    t AS (SELECT 'b' || book_id AS book, 'duplicate-sibling-id' AS code, 'b' || book_id || '/o' || division_id AS path, count(*) - 1 AS n FROM j WHERE book_id % 10 <> 0 GROUP BY book_id, division_id, ordinal % 3)
    SELECT book, 'error' AS severity, code, path, 1::BIGINT AS issues FROM s UNION ALL SELECT book, 'error', code, path, sum(n)::BIGINT FROM t GROUP BY ALL HAVING sum(n) > 0""".lstrip()
    )
)
def document_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of whole documents at their places: control characters in every tenth book, ids that repeat in the others."""
    found = docs.validate_books(_documents(spark, sf_dir, faults=True), "book")
    return found.groupBy(F.col("doc").alias("book"), "severity", "code", "path").agg(F.count("*").alias("issues"))


@query(with_tables("SELECT 'b' || v.book_id AS book, count(*) AS verses, 0::BIGINT AS errors, count(DISTINCT division_id) AS sections FROM verses v JOIN divisions d ON d.book_id = v.book_id AND d.id = v.division_id GROUP BY v.book_id"))
def assembled_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draft packages of books whose orders are sections, and how many errors validation finds in them."""
    book = F.concat(F.lit("b"), F.col("book_id").cast("string")).alias("book")
    d = divisions(spark, sf_dir).select("book_id", F.col("id").alias("division_id"), (F.col("ordinal") + 1).alias("section"))
    p = materialize(verses(spark, sf_dir).join(d, ["book_id", "division_id"]).select(book, "section", F.col("ordinal").alias("pos"), "number", "text", F.lit("prose").alias("form"), "pages"), "passages")
    sections = p.groupBy("book", "section").agg(F.count("*").alias("passages")).withColumn("title", F.lit(None).cast("string"))
    books = p.select("book").distinct()
    manifests = books.select("book", F.lit("scan").alias("source"), F.lit("0").alias("sha256"), F.lit("none").alias("engine"))
    made = materialize(assemble.packages(p, sections, assemble.default_metadata(books), manifests), "assembled")
    errors = docs.validate_books(made, "book", stored=True).where("severity = 'error'").groupBy(F.col("doc").alias("book")).agg(F.count("*").alias("errors"))
    n = F.size(F.from_json(F.get_json_object("document", "$.structure"), "array<struct<id:string>>")).cast("long")
    return made.join(errors, "book", "left").select("book", "verses", F.coalesce("errors", F.lit(0).cast("long")).alias("errors"), n.alias("sections"))

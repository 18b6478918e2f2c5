"""The queries of drafts, imports and reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drafts as dr
from ..operators import studio
from ..sources import sinks
from .derived import divisions, table, verses
from .queries import _OLD_SQL, import_merge
from .registry import query, with_tables


@query(_OLD_SQL + """ SELECT book_id, division_id, id, CASE WHEN come AND NOT have THEN 'import' ELSE 'reimport' END AS action, CASE WHEN take THEN nt ELSE text END AS text, 'raw' AS status, CASE WHEN take THEN nn ELSE number END AS number,
CASE WHEN reset THEN 'The reading has changed: back to raw for a second look.' END AS note FROM k WHERE come AND NOT have OR reset""")
def import_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revision rows of a re-import."""
    return dr.import_revisions(import_merge(spark, sf_dir))


@query(_OLD_SQL + """ SELECT book_id, count(*) FILTER (come AND NOT have) AS inserted, count(*) FILTER (come AND have AND NOT reset) AS refreshed, count(*) FILTER (reset) AS reset, count(*) FILTER (gone) AS orphaned, count(*) FILTER (come AND coalesce(orphaned, false)) AS restored FROM k GROUP BY 1""")
def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an import did to each book."""
    return dr.import_summary(import_merge(spark, sf_dir))


@query(with_tables("SELECT v.book_id, v.division_id, v.id, row_number() OVER (PARTITION BY v.book_id ORDER BY d.ordinal, v.ordinal) - 1 AS place FROM verses v JOIN divisions d ON d.book_id = v.book_id AND d.id = v.division_id WHERE NOT orphaned"))
def ordered_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All live verses in book order."""
    return dr.ordered_structure(divisions(spark, sf_dir), verses(spark, sf_dir)).select("book_id", "division_id", "id", "place")


@query(with_tables("SELECT book_id, division_id, id, row_number() OVER (PARTITION BY book_id ORDER BY confidence NULLS LAST, division_id * 100 + ordinal) - 1 AS place FROM verses"))
def worst_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verses of reports by confidence."""
    v = verses(spark, sf_dir).withColumn("pos", F.col("division_id") * 100 + F.col("ordinal"))
    return dr.worst_first(v, ["book_id"], "pos").select("book_id", "division_id", "id", "place")


@query("SELECT conv_id, turn AS page, length(text) % 11 AS rate, place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) % 11 DESC, turn) AS place FROM conversations WHERE length(text) % 11 > 0) WHERE place <= 5")
def worst_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five worst pages of each run."""
    p = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page"), (F.length("text") % 11).cast("long").alias("rate"))
    return dr.worst_pages(p, ["conv_id"], "rate")


@query("SELECT conv_id, turn FROM conversations WHERE turn % 3 = 1")
def unreadable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of manifests of which no blocks could be read."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return dr.unreadable_pages(c, c.where("turn % 3 <> 1"), ["conv_id", "turn"])


@query(
    "SELECT 'books/' || p_partkey AS dir, p_brand AS book_id, CASE WHEN p_partkey % 4 = 0 THEN 'G' || p_partkey WHEN p_partkey % 4 = 1 THEN 'E' || p_partkey ELSE p_brand END AS title, p_size AS verses, sha256((p_partkey % 20)::VARCHAR) AS source_sha256, p_partkey % 20 < 9 AS has_pages "
    "FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0"
)
def drafts_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts that can be read, and whether their pages are rendered."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").withColumn("dir", F.concat(F.lit("books/"), k.cast("string")))
    sha = F.sha2((k % 20).cast("string"), 256)
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    title = F.when(k % 4 == 0, F.create_map(F.lit("en"), F.lit("no"), F.lit("gu"), F.concat(F.lit("G"), k.cast("string")))).when(k % 4 == 1, F.create_map(F.lit("en"), F.concat(F.lit("E"), k.cast("string")))).otherwise(empty)
    packages = p.select("dir", F.when(k % 7 != 0, F.col("p_brand")).alias("book_id"), title.alias("title"))
    reports = p.select("dir", F.col("p_size").alias("verses"), F.when(k % 11 != 0, sha).alias("source_sha256"))
    return dr.list_drafts(packages, reports, p.where(k % 20 < 9).select(sha.alias("source_sha256")))


@query("SELECT doc_id, substr(text, greatest(n - 8, 0) + 1, n + 8 - greatest(n - 8, 0)) AS context, 'two vowel signs in a row (' || substr(text, 1, 3) || ')' AS said, '/layers/' || doc_id AS pointer FROM (SELECT *, doc_id % 40 AS n FROM documents)")
def fault_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands around a place of a text, and a fault in words."""
    d = table(spark, sf_dir, "documents")
    at = (F.col("doc_id") % 40).cast("int")
    pointer = dr.json_pointer(F.array(F.lit("layers"), F.col("doc_id").cast("string")))
    return d.select("doc_id", dr.context_around(F.col("text"), at).alias("context"), dr.describe_violation(F.lit("adjacent-vowel-signs"), F.left("text", F.lit(3))).alias("said"), pointer.alias("pointer"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def reparsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events, half of which were encoded twice."""
    e = table(spark, sf_dir, "events")
    twice = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(F.col("props"))
    return e.select("event_id", dr.reparsed(twice, "k bigint")["k"].alias("k"))


_BLOCKS = "SELECT conv_id AS book_id, turn AS page, role AS block_id, text FROM conversations"


@query(f"SELECT book_id, page, block_id, CASE WHEN page % 3 = 0 THEN text || '!' ELSE text END AS text, CASE WHEN page % 2 = 0 THEN 'proofed' ELSE 'raw' END AS status, page % 4 = 1 OR page % 5 = 0 AND page % 4 <> 2 AS resolved FROM ({_BLOCKS})")
def patched_apparatus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes and blocks set aside after somebody has dealt with some of them."""
    b = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("page"), F.col("role").alias("block_id"), "text")
    n = F.col("page")
    notes = dr.patch_notes(b.withColumn("status", F.lit("raw")), b.where(n % 6 < 5).select("book_id", "page", "block_id", F.when(n % 3 == 0, F.concat("text", F.lit("!"))).alias("text"), F.when(n % 2 == 0, "proofed").alias("status")))
    marks = b.where(n % 4 < 3).where((n % 4 == 1) | (n % 4 == 2)).select("book_id", "page", "block_id", (n % 4 == 1).alias("resolved"))
    aside = dr.resolve_set_aside(b.withColumn("resolved", n % 5 == 0), marks).select("book_id", "page", "block_id", "resolved")
    return notes.join(aside, ["book_id", "page", "block_id"])


@query("SELECT o_custkey AS book_id, o_orderkey AS number, CASE WHEN o_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS file FROM orders")
def replaced_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages after an import of some books."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("number"))
    return dr.replace_pages(o.withColumn("file", F.lit("old")), o.where("book_id % 3 = 0").withColumn("file", F.lit("new")))


@query(
    "WITH p AS (SELECT o_custkey AS book, o_orderkey % 5 AS section, o_orderkey AS pos, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 3 END AS number, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey % 90 END AS page, o_orderpriority AS text FROM orders), "
    "s AS (SELECT *, dense_rank() OVER (PARTITION BY book ORDER BY section) AS s, row_number() OVER (PARTITION BY book, section ORDER BY pos) AS k FROM p), "
    "n AS (SELECT *, CASE WHEN number IS NOT NULL THEN 'v' || number ELSE 'p' || coalesce(page, s - 1) || '-' || k END AS nat FROM s), m AS (SELECT *, row_number() OVER (PARTITION BY book, section, nat ORDER BY pos) AS n FROM n) "
    "SELECT book, 'section-' || s AS division_id, CASE WHEN n > 1 THEN nat || '-' || n ELSE nat END AS id, k - 1 AS ordinal, number, book || '/section-' || s || '#' || CASE WHEN n > 1 THEN nat || '-' || n ELSE nat END AS ref, length(text) AS chars FROM m"
)
def assembled_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of packages from passages, with unique ids."""
    k = F.col("o_orderkey")
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), (k % 5).alias("section"), k.alias("pos"), F.when(k % 4 != 0, k % 3).alias("number"), F.col("o_orderpriority").alias("text"), F.when(k % 8 != 0, F.array(k % 90)).otherwise(F.array().cast("array<bigint>")).alias("pages"))
    return dr.assemble_units(p, "text").drop("layers", "hash")


@query("SELECT count(*) AS total, count(*) FILTER (l_quantity > 45) AS orphaned, count(DISTINCT l_orderkey) AS divisions FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def scalar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over all books."""
    return verses(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if("orphaned").alias("orphaned"), F.countDistinct("division_id").alias("divisions"))


@query(with_tables("SELECT v.book_id, v.division_id, v.id, v.status FROM verses v WHERE list_contains(pages, 7) AND book_id % 10 = 3 ORDER BY 1, 2, 3"))
def page_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verses that stand on one page of some books."""
    v = verses(spark, sf_dir).where("book_id % 10 = 3").withColumn("shelf", F.lit(1))
    own, _, _ = studio.page_context(v.withColumnRenamed("book_id", "book").withColumnRenamed("shelf", "book_id"), v.limit(0).withColumn("page", F.lit(0)), v.limit(0).withColumn("page", F.lit(0)), 1, 7)
    return own.select(F.col("book").alias("book_id"), "division_id", "id", "status")


@query(
    "SELECT conv_id AS book, turn AS page, sum(length(text))::BIGINT AS chars, sum(v)::BIGINT AS violations, sum(e)::BIGINT AS examined, CASE WHEN sum(e) = 0 THEN 0.0::DOUBLE ELSE floor(sum(v) * 1000.0::DOUBLE / sum(e) * 100 + 0.5) / 100 END AS rate, sum(v) = 0 AS ok "
    "FROM (SELECT conv_id, turn, text, length(text) % 4 AS v, length(text) AS e FROM conversations) GROUP BY ALL"
)
def page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality rows of pages."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("page"), "text")
    n = F.length("text").cast("long")
    return sinks.page_results(c, F.struct((n % 4).alias("violations"), n.alias("examined")))


@query("SELECT p_brand AS book_id, p_partkey || '.0.0' AS content_version, strlen(p_name)::BIGINT AS bytes, sha256(p_name) AS sha256 FROM part")
def release_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the catalog records of packages."""
    p = table(spark, sf_dir, "part")
    return sinks.release_rows(p.select(F.col("p_brand").alias("book_id"), F.concat(F.col("p_partkey").cast("string"), F.lit(".0.0")).alias("content_version"), F.col("p_name").alias("document")))


@query("SELECT p_partkey AS document, '| ' || p_partkey || ' | ' || p_type || ' | high | ' || CASE WHEN p_size % 5 = 0 THEN '?' ELSE p_size::VARCHAR END || ' |' AS line FROM part")
def inventory_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory as a table of lines."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("document"), F.col("p_type").alias("verdict"), F.lit("high").alias("confidence"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("pages"))
    return sinks.inventory_lines(p)


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN CASE p_partkey % 4 WHEN 0 THEN 'original' WHEN 1 THEN 'translation' ELSE 'later' END END AS kind FROM part")
def found_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declarations of layers by their ids."""
    layer = lambda i, k: F.struct(F.lit(i).alias("id"), F.lit(k).alias("kind"))
    layers = F.array(layer("l0", "original"), layer("l1", "translation"), layer("l2", "first"), layer("l2", "later"))
    wanted = F.concat(F.lit("l"), (F.col("p_partkey") % 4).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", sinks.find_layer(layers, wanted)["kind"].alias("kind"))

"""The queries of scalar functions, page operators and small merges, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import refs as r
from ..functions import text as t
from ..functions import values as v
from ..operators import packages as pk
from ..operators import restructure as rs
from ..operators import segment as seg
from ..operators import studio, triage, versions
from ..sources import pages as pg
from .derived import table
from .registry import query

# --- texts ------------------------------------------------------------------------------------------------------------


@query(
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '[\x00-\x09\x0b-\x1f\x7f-\x{9f}]', '', 'g'), '[ \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '^ | $', '', 'g') AS text,
  len(regexp_extract_all(s, '[\x00-\x09\x0b-\x1f\x7f-\x{9f}]')) AS controls_removed FROM (SELECT doc_id, replace(replace(text, '. ', '.' || chr(9) || '  '), ', ', ',' || chr(160) || ' ') AS s FROM documents)"""
)
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without control characters and with single blanks."""
    s = F.replace(F.replace("text", F.lit(". "), F.lit(".\t  ")), F.lit(", "), F.lit(",  "))
    c = table(spark, sf_dir, "documents").select("doc_id", t.clean_characters(s).alias("c"))
    return c.select("doc_id", "c.text", "c.controls_removed")


@query("SELECT doc_id, regexp_replace(text, '^[\\s]+', '') AS begin_trimmed, regexp_replace(text || '  ' || chr(10), '[\\s]+$', '') AS end_trimmed FROM (SELECT doc_id, '  ' || chr(10) || text AS text FROM documents)")
def trimmed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without white space at one end."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("  \n"), "text").alias("text"))
    return d.select("doc_id", t.trim_start(F.col("text")).alias("begin_trimmed"), t.trim_end(F.concat("text", F.lit("  \n"))).alias("end_trimmed"))


@query(
    "SELECT doc_id, CASE WHEN len(w) < 8 THEN 0.0::DOUBLE ELSE len(list_filter(w, lambda x: list_contains([{}], x)))::DOUBLE / len(w) END AS rate FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)".format(
        ", ".join(f"'{w}'" for w in t.ENGLISH_WORDS)
    )
)
def english_word_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of common English words of each text."""
    return table(spark, sf_dir, "documents").select("doc_id", t.english_word_rate(F.col("text")).alias("rate"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 100 END AS marker FROM orders")
def note_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers that begin footnotes, before a full stop or a bracket."""
    n = t.format_number(F.col("o_orderkey") % 100, "gujr")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), n, F.when(F.col("o_orderkey") % 2 == 0, ".").otherwise(" )"), F.lit(" a note"))).otherwise(F.concat(n, F.lit(" a text")))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.note_marker(text).cast("long").alias("marker"))


@query("SELECT p_partkey, 'a' || chr(160) || '॥' || chr(160) || (p_partkey % 50) || chr(160) || '॥ b।' AS text FROM part")
def protected_dandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verse endings kept together by no-break spaces."""
    return table(spark, sf_dir, "part").select("p_partkey", t.protect_danda(F.concat(F.lit("a ॥ "), (F.col("p_partkey") % 50).cast("string"), F.lit(" ॥ b।"))).alias("text"))


@query("SELECT s_suppkey, s_name, CASE s_suppkey % 4 WHEN 0 THEN 'shreelipi' WHEN 1 THEN 'krutidev' WHEN 2 THEN '' ELSE 'aps-dv' END AS families FROM supplier")
def font_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy font families by the names of fonts, without the tags of their subsets."""
    n = F.col("s_suppkey") % 4
    name = F.when(n == 0, "ABCDEF+Shree_Lipi Bold").when(n == 1, "XYZABC+Kruti Dev010").when(n == 2, "QWERTY+Noto Sans").otherwise("APS-DV.Prakash")
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.array_join(triage.legacy_families(t.strip_subset_prefix(name)), ",").alias("families"))


# --- refs and values --------------------------------------------------------------------------------------------------

_REF_SQL = "SELECT c_custkey, 'b' || (c_custkey % 5) || CASE WHEN c_custkey % 3 > 0 THEN '/s' || (c_custkey % 7) ELSE '' END || CASE WHEN c_custkey % 3 > 1 THEN '/c-' || (c_custkey % 11) ELSE '' END || CASE WHEN c_custkey % 2 = 0 THEN '#v' || c_custkey ELSE '' END || CASE WHEN c_custkey % 13 = 0 THEN '/' ELSE '' END AS ref FROM customer"


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    part = lambda cond, *c: F.when(cond, F.concat(*c)).otherwise("")
    n = lambda m: (k % m).cast("string")
    ref = F.concat(F.lit("b"), n(5), part(k % 3 > 0, F.lit("/s"), n(7)), part(k % 3 > 1, F.lit("/c-"), n(11)), part(k % 2 == 0, F.lit("#v"), k.cast("string")), part(k % 13 == 0, F.lit("/")))
    return table(spark, sf_dir, "customer").select("c_custkey", ref.alias("ref"))


@query(
    f"WITH x AS ({_REF_SQL}), y AS (SELECT *, regexp_full_match(ref, '[a-z0-9]+(-[a-z0-9]+)*(/[a-z0-9]+(-[a-z0-9]+)*)*(#[a-z0-9]+(-[a-z0-9]+)*)?') AS ok, string_split(string_split(ref, '#')[1], '/') AS s FROM x) "
    "SELECT c_custkey, ok, CASE WHEN ok THEN s[1] END AS book_id, CASE WHEN ok THEN array_to_string(s[2:], '/') END AS path, CASE WHEN ok AND contains(ref, '#') THEN string_split(ref, '#')[2] END AS leaf, CASE WHEN ok THEN ref END AS again, "
    "CASE WHEN contains(ref, '#') THEN string_split(ref, '#')[1] WHEN contains(ref, '/') THEN regexp_replace(ref, '/[^/]*$', '') END AS parent FROM y"
)
def parsed_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refs taken apart and put together again, and their containers."""
    p = _refs(spark, sf_dir).select("c_custkey", "ref", r.is_ref(F.col("ref")).alias("ok"), r.parse_ref(F.col("ref")).alias("p"))
    again = F.when(F.col("ok"), r.format_ref(F.col("p.book_id"), F.col("p.path"), F.col("p.leaf")))
    return p.select("c_custkey", "ok", "p.book_id", F.array_join("p.path", "/").alias("path"), "p.leaf", again.alias("again"), r.parent_ref(F.col("ref")).alias("parent"))


@query(f"WITH x AS ({_REF_SQL}) SELECT a.c_custkey AS a, b.c_custkey AS b FROM x a JOIN x b ON a.c_custkey + 30 = b.c_custkey OR a.c_custkey = b.c_custkey WHERE a.ref = b.ref OR NOT contains(a.ref, '#') AND (starts_with(b.ref, a.ref || '/') OR starts_with(b.ref, a.ref || '#'))")
def containing_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of refs of which one contains the other."""
    x = _refs(spark, sf_dir)
    y = x.select(F.explode(F.array(F.col("c_custkey"), F.col("c_custkey") - 30)).alias("a"), F.col("c_custkey").alias("b"), F.col("ref").alias("other"))
    return x.withColumnRenamed("c_custkey", "a").join(y, "a").where(r.ref_contains(F.col("ref"), F.col("other"))).select("a", "b")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'p' || (p_partkey % 9) || '-' || (p_size + 1) WHEN p_partkey % 4 = 1 THEN 'p0-' || (p_size + 1) ELSE 'v' || (p_partkey % 500) END AS id FROM part")
def verse_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of verses by their printed number, else by their place."""
    k = F.col("p_partkey")
    number = F.when(k % 4 > 1, t.format_number(k % 500, "gujr")).when(k % 8 == 0, "12a")
    return table(spark, sf_dir, "part").select("p_partkey", rs.verse_id_for(number, F.when(k % 4 != 1, k % 9), F.col("p_size")).alias("id"))


@query(
    "SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN round(b / 1024.0::DOUBLE)::BIGINT || ' KB' ELSE floor(b / 1048576.0::DOUBLE * 10 + 0.5) / 10 || ' MB' END AS size, (o_orderkey % 500) * 0.5::DOUBLE AS rupees, 'page-' || lpad((o_orderkey % 500)::VARCHAR, 4, '0') || '.png' AS file "
    "FROM (SELECT o_orderkey, o_orderkey % 97 * (o_orderkey % 89) * 613 AS b FROM orders)"
)
def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte sizes, prices and file names as reports show them."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", v.format_bytes(k % 97 * (k % 89) * 613).alias("size"), v.estimate_rupees(k % 500).alias("rupees"), v.page_file_name(k % 500, F.lit(999)).alias("file"))


@query("SELECT 'docs/' || CASE source WHEN '' THEN 'x' ELSE source END AS root, source, count(*) AS n FROM documents GROUP BY ALL")
def common_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest folder that all files of a group share."""
    d = table(spark, sf_dir, "documents").select("source", F.concat(F.lit("docs/"), F.when(F.col("source") == "", "x").otherwise(F.col("source")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file"))
    return v.common_root(d, ["source"], "file").select("source", "root", "n")


# --- packages ---------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'gu' WHEN 1 THEN 'en-GB' WHEN 2 THEN 'en-GB' ELSE 'gu' END AS title FROM customer")
def localized_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title for a language tag: its own, else its base language's, else the first."""
    entry = lambda tag: F.struct(F.lit(tag).alias("tag"), F.lit(tag).alias("text"))
    n = F.col("c_custkey") % 4
    tag = F.when(n == 0, "gu").when(n == 1, "en-GB").when(n == 2, "EN-us").otherwise("hi")
    return table(spark, sf_dir, "customer").select("c_custkey", pk.pick_localized(F.array(entry("gu"), entry("en-GB"), entry("en")), tag).alias("title"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'given' WHEN p_partkey % 5 = 0 THEN 'found' ELSE p_brand END AS edition, CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE 'none' END AS holder FROM part")
def merged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of three levels put over each other."""
    k = F.col("p_partkey")
    columns = pk.merge_metadata({"edition": F.col("p_brand"), "holder": F.lit("none")}, {"edition": F.when(k % 5 == 0, "found"), "holder": F.when(k % 5 == 0, F.col("p_type"))}, {"edition": F.when(k % 3 == 0, "given")})
    return table(spark, sf_dir, "part").select("p_partkey", *columns)


@query("SELECT p_partkey, 'b=' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN ',n=new' ELSE '' END || ',s=' || CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE p_size::VARCHAR END AS manifest FROM part")
def patched_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests with the fields of a patch put over their own."""
    old = F.create_map(F.lit("b"), F.col("p_brand"), F.lit("s"), F.col("p_size").cast("string"))
    patch = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("s"), F.lit("x"), F.lit("n"), F.lit("new"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    entries = F.array_sort(F.transform(F.map_entries(pk.patch_map(old, patch)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(entries, ",").alias("manifest"))


@query("SELECT event_id % 400 AS page, coalesce(min(CASE WHEN event_id % 3 = 0 AND event_id < 400 THEN user_id END), min(CASE WHEN event_id % 2 = 0 AND event_id BETWEEN 400 AND 799 THEN user_id + 1000 END), min(CASE WHEN event_id BETWEEN 800 AND 1199 THEN user_id + 5000 END)) AS printed FROM events GROUP BY 1")
def printed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed number of each page by the source that is trusted most."""
    e = table(spark, sf_dir, "events").withColumn("page", F.col("event_id") % 400)
    i = F.col("event_id")
    source = lambda keep, add: e.select("page", F.when(keep, F.col("user_id") + add).alias("printed"))
    return pk.printed_pages([source((i % 3 == 0) & (i < 400), 0), source((i % 2 == 0) & i.between(400, 799), 1000), source(i.between(800, 1199), 5000)])


@query("SELECT page_id, (row_number() OVER (PARTITION BY page_id % 3 ORDER BY page_id) - 1) // 10 AS batch FROM pages")
def page_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in jobs of ten."""
    p = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 3).alias("book"))
    return pk.batches(p, ["book"], "page_id").select("page_id", "batch")


@query("SELECT conv_id, count(*) FILTER (turn % 5 <> 4) AS pages_read, count(*) FILTER (turn % 5 = 4) AS pages_failed, sum(CASE WHEN turn % 5 <> 4 THEN length(text) ELSE 0 END)::BIGINT AS chars, arg_min(turn, (length(text) % 7, turn)) FILTER (turn % 5 <> 4) AS worst_page FROM conversations GROUP BY 1")
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run over pages has read, and its worst page."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page"), F.length("text").alias("chars"), (F.length("text") % 7).alias("score"), F.when(F.col("turn") % 5 == 4, "lost").alias("error"))
    return pk.run_summary(c, ["conv_id"])


@query(
    "WITH b AS (SELECT conv_id AS page, turn AS n, CASE role WHEN 'user' THEN 'body' WHEN 'assistant' THEN 'notes' ELSE 'set-aside' END AS bucket, text FROM conversations), g AS (SELECT page, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY n, text) FILTER (bucket = 'body'), '') AS body, "
    "coalesce(string_agg(text, chr(10) || chr(10) ORDER BY n, text) FILTER (bucket = 'notes'), '') AS notes FROM b WHERE bucket <> 'set-aside' GROUP BY 1) SELECT page, CASE WHEN notes = '' THEN body ELSE body || chr(10) || chr(10) || '---' || chr(10) || chr(10) || notes END AS markdown FROM g"
)
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as text: the body, a rule, the notes."""
    bucket = F.when(F.col("role") == "user", "body").when(F.col("role") == "assistant", "notes").otherwise("set-aside")
    return pg.page_markdown(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("reading_order"), "text", bucket.alias("bucket")))


@query("SELECT l_orderkey AS page, least(1.0, round(sum(l_quantity * l_linenumber) / 400.0::DOUBLE, 9)) AS coverage FROM lineitem GROUP BY 1")
def page_coverages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each page its images cover."""
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("width"), F.col("l_linenumber").alias("height"), F.lit(20.0).alias("page_width"), F.lit(20.0).alias("page_height"))
    return pg.page_coverage(b).select("page", F.round("coverage", 9).alias("coverage"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'dir' || (c_custkey % 9) END AS pages_dir FROM customer")
def pages_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first folder whose manifest names a book's source."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 9).cast("string").alias("source_sha256"))
    m = c.where("c_custkey < 200 AND c_custkey % 3 = 0").select(F.concat(F.lit("dir"), "source_sha256", F.when(F.col("c_custkey") >= 9, "x").otherwise("")).alias("dir"), "source_sha256", F.col("c_custkey").alias("scan_order"))
    return pk.find_pages(c, m).select("c_custkey", "pages_dir")


@query("SELECT s_suppkey, f AS name, CASE f WHEN 'a' THEN true WHEN 'b' THEN s_suppkey % 3 = 0 ELSE false END AS used FROM supplier, (SELECT unnest(['a', 'b', 'c']) AS f)")
def fonts_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared fonts with a mark whether a page draws with them."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("path"))
    declared = s.select("s_suppkey", "path", F.explode(F.array(*map(F.lit, "abc"))).alias("name"))
    drawn = s.select("path", F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("a"))).alias("font_names"))
    return pk.font_usage(declared, drawn).select("s_suppkey", "name", "used")


# --- verdicts ---------------------------------------------------------------------------------------------------------

_VERDICT_SQL = "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'unicode-text' WHEN 1 THEN 'legacy-text' WHEN 2 THEN 'broken-encoding' WHEN 3 THEN 'scanned' WHEN 4 THEN 'mixed' ELSE 'unknown' END AS verdict, 0.7 + (p_partkey % 4) * 0.1 AS consensus, p_size % 9 AS pages, p_partkey % 2 = 0 AS corroborated FROM part"
_CONFIDENCE_SQL = f"x AS ({_VERDICT_SQL}), y AS (SELECT *, CASE WHEN verdict IN ('mixed', 'unknown') OR pages < 3 THEN 'low' WHEN consensus = 1 AND (verdict <> 'legacy-text' OR corroborated) THEN 'high' WHEN consensus >= 0.8 THEN 'medium' ELSE 'low' END AS confidence FROM x)"


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    verdict = F.element_at(F.array(*map(F.lit, ("unicode-text", "legacy-text", "broken-encoding", "scanned", "mixed", "unknown"))), (k % 6 + 1).cast("int"))
    consensus = F.element_at(F.array(*map(F.lit, (0.7, 0.8, 0.9, 1.0))), (k % 4 + 1).cast("int"))
    x = table(spark, sf_dir, "part").select("p_partkey", verdict.alias("verdict"), consensus.alias("consensus"), (F.col("p_size") % 9).alias("pages"), (k % 2 == 0).alias("corroborated"))
    return x.withColumn("confidence", triage.confidence_of(F.col("verdict"), F.col("consensus"), F.col("pages"), F.col("corroborated")))


@query(f"WITH {_CONFIDENCE_SQL} SELECT p_partkey, verdict, confidence FROM y")
def verdict_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure verdicts are."""
    return _verdicts(spark, sf_dir).select("p_partkey", "verdict", "confidence")


@query(
    f"WITH {_CONFIDENCE_SQL} SELECT p_partkey, row_number() OVER (ORDER BY CASE verdict WHEN 'unicode-text' THEN 0 WHEN 'legacy-text' THEN 1 WHEN 'broken-encoding' THEN 2 WHEN 'scanned' THEN 3 ELSE 4 END, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, pages, p_partkey) AS place "
    "FROM y WHERE verdict <> 'unknown' ORDER BY place LIMIT 100"
)
def first_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred documents to begin with (a top list)."""
    from pyspark.sql.window import Window

    top = triage.rank_candidates(_verdicts(spark, sf_dir), "p_partkey").limit(100)
    place = F.row_number().over(Window.orderBy("rank", "confidence_rank", F.col("pages").asc_nulls_last(), "p_partkey"))  # a hundred rows
    return top.select("p_partkey", place.cast("long").alias("place"))


# --- merges and moves -------------------------------------------------------------------------------------------------


@query(
    "WITH o AS (SELECT o_custkey AS book_id, o_orderkey AS id, o_orderkey % 9 AS ordinal, o_orderpriority AS kind, 'old' || o_orderkey AS title FROM orders WHERE o_orderkey % 4 <> 0), n AS (SELECT o_custkey AS book_id, o_orderkey AS id, o_orderkey % 7 AS ordinal, o_orderstatus AS kind, 'new' || o_orderkey AS title FROM orders WHERE o_orderkey % 3 <> 0) "
    "SELECT coalesce(o.book_id, n.book_id) AS book_id, coalesce(o.id, n.id) AS id, coalesce(n.ordinal, o.ordinal) AS ordinal, coalesce(n.kind, o.kind) AS kind, CASE WHEN o.id IS NOT NULL THEN o.title ELSE n.title END AS title FROM o FULL JOIN n ON o.book_id = n.book_id AND o.id = n.id"
)
def merged_divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divisions after an import."""
    o = table(spark, sf_dir, "orders")
    rows = lambda cond, k, kind, word: o.where(cond).select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % k).alias("ordinal"), F.col(kind).alias("kind"), F.concat(F.lit(word), F.col("o_orderkey").cast("string")).alias("title"))
    return studio.upsert_divisions(rows("o_orderkey % 4 <> 0", 9, "o_orderpriority", "old"), rows("o_orderkey % 3 <> 0", 7, "o_orderstatus", "new"))


@query(
    "WITH live AS (SELECT DISTINCT 'b/d' || (o_orderkey % 40) AS ref FROM orders WHERE o_orderkey % 40 < 30 UNION SELECT 'b/d' || (o_orderkey % 40) || '#v' || o_orderkey FROM orders WHERE o_orderkey % 5 < 2) "
    "SELECT 'b/d' || (o_orderkey % 40) || '#v' || o_orderkey AS source, CASE WHEN o_orderkey % 5 = 2 AND o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 40 < 30 THEN 'b/d' || (o_orderkey % 40) ELSE 'b' END "
    "WHEN o_orderkey % 5 = 3 AND 'b/d' || ((o_orderkey + 2) % 40) || '#v' || (o_orderkey + 2) IN (SELECT ref FROM live) THEN 'b/d' || ((o_orderkey + 2) % 40) || '#v' || (o_orderkey + 2) WHEN o_orderkey % 40 < 30 THEN 'b/d' || (o_orderkey % 40) ELSE 'b' END AS target FROM orders WHERE o_orderkey % 5 >= 2"
)
def derived_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where refs that are gone lead: along their lineage, else to the nearest live container."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    div = lambda c: F.concat(F.lit("b/d"), (c % 40).cast("string"))
    ref = lambda c: F.concat(div(c), F.lit("#v"), c.cast("string"))
    live = o.where("o_orderkey % 40 < 30").select(div(k).alias("ref")).unionByName(o.where("o_orderkey % 5 < 2").select(ref(k).alias("ref"))).distinct()
    before = o.where("o_orderkey % 5 >= 2").select(ref(k).alias("ref"))
    lineage = o.where("o_orderkey % 5 = 3").select(ref(k).alias("source"), ref(k + 2).alias("target"))
    carried = o.limit(0).select(ref(k).alias("source"), ref(k).alias("target"))
    return versions.derive_aliases(before, live, lineage, carried)


@query("SELECT count(*) FILTER (o_orderkey % 5 = 0) AS live, count(*) FILTER (o_orderkey % 5 = 1) AS rewritten, count(*) FILTER (o_orderkey % 5 > 1) AS orphaned FROM orders")
def migration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many refs are live, rewritten and orphaned after a release."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    ref = lambda word: F.concat(F.lit(word), F.col("o_orderkey").cast("string"))
    live = o.where("o_orderkey % 5 = 0").select(ref("r").alias("ref")).unionByName(o.where("o_orderkey % 5 = 1").select(ref("t").alias("ref")))
    edges = o.where("o_orderkey % 5 = 1").select(ref("r").alias("source"), ref("t").alias("target"))
    return versions.summarize_migration(versions.migrate(o.select(ref("r").alias("ref")), live, edges))


@query("SELECT conv_id, turn, CASE WHEN role = 'system' AND turn % 2 = 0 THEN 0 WHEN role = 'user' THEN 1 ELSE 2 END AS rank, conv_id % 300 AS number FROM conversations")
def printed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page numbers that blocks carry, by how far their tag is trusted."""
    c = table(spark, sf_dir, "conversations")
    tag = F.when((F.col("role") == "system") & (F.col("turn") % 2 == 0), "page-number").when(F.col("role") == "user", "folio").otherwise("header")
    text = F.concat(F.lit("— "), t.format_number(F.col("conv_id") % 300, "gujr"), F.lit(" —"))
    p = c.select("conv_id", "turn", seg.printed_page(tag, text, "gujr").alias("p"))
    return p.select("conv_id", "turn", "p.rank", "p.number")

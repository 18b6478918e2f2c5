"""The queries of the library's own operators by name, each with the SQL that it must agree with where SQL has it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import findings
from ..functions import refs as r
from ..functions import scripts as s
from ..functions import text as t
from ..functions.normalize import nfkd, normalize
from ..operators import segment as seg
from ..operators.passage_scan import scan
from ..operators import sequence as seq
from ..operators import structure as st
from ..operators import studio, triage, versions
from ..sources.pages import page_spec_sql, sample_places
from ..sources.shared import dealt
from .derived import INDIC_SQL, divisions, indic, spread, table, verses
from .registry import ORACLES, QUERIES, query, with_tables

_with = with_tables


# --- the flagship: triage of documents -----------------------------------------------------------------------------

_N = {k: f"len(regexp_extract_all(text, '{c}'))" for k, c in s.SCRIPT_CLASS.items()}
_PROFILE_SQL = f"""
p0 AS (SELECT *, {_N['gujr']} AS gujr, {_N['deva']} AS deva, {_N['latn']} AS latn, len(regexp_extract_all(text, '{s.cls(s.NEUTRAL)}')) AS neutral FROM src),
p1 AS (SELECT *, length(text) - neutral - gujr - deva - latn AS other, length(text) - neutral AS total FROM p0),
p AS (SELECT *, CASE WHEN total = 0 THEN NULL WHEN gujr = greatest(gujr, deva, latn, other) THEN 'gujr' WHEN deva = greatest(gujr, deva, latn, other) THEN 'deva'
  WHEN other = greatest(gujr, deva, latn, other) THEN 'other' ELSE 'latn' END AS dominant,
  CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE greatest(gujr, deva, latn, other)::DOUBLE / total END AS share FROM p1)"""
_WORDS_SQL = ", ".join(f"'{w}'" for w in t.ENGLISH_WORDS)
_ENGLISH_SQL = f"""
e AS (SELECT *, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM p),
c AS (SELECT *, CASE WHEN dominant = 'latn' AND len(ws) >= 8 THEN len(list_filter(ws, lambda w: list_contains([{_WORDS_SQL}], w)))::DOUBLE / len(ws) ELSE 0.0::DOUBLE END AS english_rate FROM e),
v AS (SELECT *, CASE WHEN total < 32 THEN 'blank' WHEN dominant = 'latn' AND english_rate >= 0.12 THEN 'unicode-text' ELSE 'legacy-text' END AS strategy FROM c)"""
_TRIAGE_SQL = f"WITH src AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),{_PROFILE_SQL},{_ENGLISH_SQL}"


@query(_TRIAGE_SQL + " SELECT doc_id, total AS chars, dominant, round(share, 6) AS share, round(english_rate, 6) AS english_rate, strategy FROM v")
def triage_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One verdict for each document: script, share of common words, strategy."""
    pages = triage.classify_pages(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return pages.select("doc_id", "chars", "dominant", F.round("share", 6).alias("share"), F.round("english_rate", 6).alias("english_rate"), "strategy")


_SOURCES_SQL = _TRIAGE_SQL + """, n AS (SELECT source, strategy, count(*) AS n, min(doc_id) AS seen FROM v GROUP BY ALL),
s AS (SELECT source, sum(n)::BIGINT AS pages, coalesce(sum(n) FILTER (strategy <> 'blank'), 0)::BIGINT AS evidence FROM n GROUP BY source),
l AS (SELECT source, strategy AS lead_strategy, n AS lead_pages FROM n WHERE strategy <> 'blank' QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, seen) = 1),
w AS (SELECT source, pages, evidence, lead_strategy, lead_pages, CASE WHEN evidence = 0 THEN 'unknown' WHEN lead_pages / evidence >= 0.8 THEN lead_strategy ELSE 'mixed' END AS verdict FROM s LEFT JOIN l USING (source))"""


@query(_SOURCES_SQL + " SELECT *, verdict <> 'unicode-text' AS needs_ocr FROM w")
def triage_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of each source over its documents."""
    return triage.triage_documents(triage.classify_pages(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))), ["source"], "doc_id")


_KINDS_SQL = ", ".join(f"count_if(verdict = '{k}')::BIGINT AS n_{k.replace('-', '_')}" for k in triage.STRATEGY_RANK)


@query(_SOURCES_SQL + f" SELECT {_KINDS_SQL}, count_if(verdict <> 'unicode-text')::BIGINT AS needing_ocr, count(*) AS total FROM w")
def triage_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by verdict, and how many need recognition."""
    return triage.inventory_summary(triage_sources(spark, sf_dir))


# --- relational reads -----------------------------------------------------------------------------------------------


@query("SELECT o_custkey AS book_id, count_if(o_orderstatus = 'F')::BIGINT AS n_f, count_if(o_orderstatus = 'O')::BIGINT AS n_o, count_if(o_orderstatus = 'P')::BIGINT AS n_p, count(*) AS total FROM orders GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status counts of each book, zero-filled."""
    return studio.status_counts(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "book_id"), ["book_id"], ("F", "O", "P"), "o_orderstatus")


@query(
    "SELECT c_custkey AS book_id, c_mktsegment AS segment, count(o_orderkey) FILTER (o_orderstatus = 'F') AS n_f, count(o_orderkey) FILTER (o_orderstatus = 'O') AS n_o, "
    "count(o_orderkey) FILTER (o_orderstatus = 'P') AS n_p, count(o_orderkey) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL"
)
def books_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All books with their counts: one aggregate instead of a query for each book."""
    books = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book_id"), F.col("c_mktsegment").alias("segment"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderstatus").alias("status"))
    return studio.books_with_counts(books, rows, ("F", "O", "P"))


_QUEUE_SQL = """
SELECT v.book_id, v.division_id, v.id, v.ordinal, d.ordinal AS division_ordinal, v.status, confidence, text <> ocr_text AS edited, length(text) AS chars, left(text, 120) AS preview
FROM verses v LEFT JOIN divisions d ON v.book_id = d.book_id AND v.division_id = d.id WHERE NOT orphaned AND {where}
ORDER BY {order} division_ordinal NULLS LAST, v.ordinal, v.book_id, v.division_id LIMIT {limit} OFFSET {offset}"""


@query(_with(_QUEUE_SQL.format(where="v.status = 'raw' AND list_contains(flags, 'orthography')", order="confidence NULLS LAST,", limit=50, offset=100)))
def queue_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of the proofing queue, worst first."""
    return studio.queue(verses(spark, sf_dir), divisions(spark, sf_dir), studio.conditions(status="raw", flag="orthography"), True, 50, 100)


@query(_with(_QUEUE_SQL.format(where="ocr_changed AND list_contains(pages, 7)", order="", limit=200, offset=0)))
def queue_in_book_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue of verses on one page whose reading has changed, in book order."""
    return studio.queue(verses(spark, sf_dir), divisions(spark, sf_dir), studio.conditions(ocr_changed=True, page=7), False, 1000)


@query(_with("SELECT unnest(flags) AS flag, count(*) AS n FROM verses WHERE NOT orphaned GROUP BY 1"))
def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each flag occurs."""
    return studio.flag_counts(verses(spark, sf_dir).where(studio.conditions()))


@query(_with("SELECT v.book_id, v.division_id, v.id, lag(division_id || '#' || v.id) OVER w AS previous, lead(division_id || '#' || v.id) OVER w AS \"next\" FROM verses v JOIN divisions d ON v.book_id = d.book_id AND v.division_id = d.id WHERE NOT orphaned WINDOW w AS (PARTITION BY v.book_id ORDER BY d.ordinal, v.ordinal)"))
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verse before and after each one."""
    return studio.neighbours(verses(spark, sf_dir), divisions(spark, sf_dir))


@query(_with("SELECT d.book_id, d.id AS division_id, count(v.id) AS verses, count(v.id) FILTER (NOT orphaned) AS live FROM divisions d LEFT JOIN verses v ON v.book_id = d.book_id AND v.division_id = d.id GROUP BY ALL"))
def verses_per_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verses of each division, zero where there are none."""
    n = verses(spark, sf_dir).groupBy("book_id", "division_id").agg(F.count("*").alias("verses"), F.count_if(~F.col("orphaned")).alias("live"))
    d = divisions(spark, sf_dir).select("book_id", F.col("id").alias("division_id"))
    return d.join(n, ["book_id", "division_id"], "left").fillna(0, ["verses", "live"])


@query("SELECT p_partkey, p_name, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49) AS imported FROM part")
def drafts_imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts with a mark whether they are imported."""
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return studio.existing(table(spark, sf_dir, "part").select("p_partkey", "p_name"), done, ["p_partkey"], "imported")


@query("SELECT page_id, source FROM (SELECT page_id, sha256(html) AS source FROM pages) p WHERE NOT EXISTS (SELECT 1 FROM pages q WHERE q.page_id = p.page_id AND q.page_id % 3 <> 0 AND sha256(CASE WHEN q.page_id % 5 = 0 THEN '' ELSE q.html END) = p.source)")
def pages_to_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are still to be read: not kept, or kept from another source."""
    pages = table(spark, sf_dir, "pages")
    wanted = pages.select("page_id", F.sha2("html", 256).alias("source"))
    kept = pages.where("page_id % 3 <> 0").select("page_id", F.sha2(F.when(F.col("page_id") % 5 == 0, "").otherwise(F.col("html")), 256).alias("source"))
    return studio.remaining(wanted, kept, ["page_id"], "source")


@query("SELECT user_id, event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def manifest_last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last entry written for each key."""
    rows = table(spark, sf_dir, "events").withColumn("rank", F.struct("ts", "event_id"))
    return studio.last_writer(rows, ["user_id"], "rank").select("user_id", "event_type", "value", "event_id")


#: Each kind's requests in order, with the times that were granted and are less than a minute old.
_RATE_SQL = """WITH RECURSIVE e AS (
  SELECT event_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events
), f AS (
  SELECT event_id, event_type, n, 0::BIGINT AS in_window, [us] AS granted FROM e WHERE n = 1
  UNION ALL
  SELECT event_id, event_type, n, len(live)::BIGINT, CASE WHEN len(live) < 5 THEN list_append(live, us) ELSE live END
  FROM (SELECT e.event_id, e.event_type, e.n, e.us, list_filter(f.granted, lambda g: g > e.us - 60000000) AS live FROM f JOIN e ON e.event_type = f.event_type AND e.n = f.n + 1)
)
SELECT event_id, in_window, in_window < 5 AS allowed FROM f"""


@query(_RATE_SQL)
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that five a minute of their kind let through."""
    return seq.within_rate(table(spark, sf_dir, "events"), ["event_type"], "ts", ["event_id"], 5).select("event_id", "in_window", "allowed")


# --- numbering ------------------------------------------------------------------------------------------------------

_NUMBERED_SQL = _with("SELECT 1").rsplit("SELECT 1", 1)[0].rstrip() + """,
b AS (SELECT v.book_id AS book, v.division_id AS division, v.number, row_number() OVER (PARTITION BY v.book_id ORDER BY d.ordinal, v.ordinal) AS pos FROM verses v JOIN divisions d ON v.book_id = d.book_id AND v.division_id = d.id)"""


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = divisions(spark, sf_dir).select("book_id", F.col("id").alias("division_id"), F.col("ordinal").alias("d"))
    j = dealt(verses(spark, sf_dir).join(d, ["book_id", "division_id"]), table(spark, sf_dir, "lineitem").count(), "book_id")  # all windows over a book lie in one task
    return j.select(F.col("book_id").alias("book"), F.col("division_id").alias("division"), "number", F.row_number().over(Window.partitionBy("book_id").orderBy("d", "ordinal")).cast("long").alias("pos"))


@query(
    _NUMBERED_SQL
    + """, n AS (SELECT *, lag(number) OVER (PARTITION BY book ORDER BY pos) AS p FROM b WHERE number IS NOT NULL),
c AS (SELECT *, p IS NULL OR number <= p AS back FROM n),
o AS (SELECT *, back AND row_number() OVER (PARTITION BY book, division, back ORDER BY pos) = 1 AS opens FROM c),
g AS (SELECT *, sum(opens::INT) OVER (PARTITION BY book ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM o),
h AS (SELECT *, row_number() OVER (PARTITION BY book, run, number ORDER BY pos) AS k FROM g)
SELECT book, run, arg_min(division, pos) AS division, min(number) AS first, max(number) AS last, count(*) AS numbered, max(number) - min(number) + 1 - count(DISTINCT number) AS n_missing,
  coalesce(array_to_string(list_sort(list(DISTINCT number) FILTER (k > 1)), ','), '') AS duplicates, coalesce(array_to_string(list_sort(list(DISTINCT number) FILTER (NOT opens AND number <> p + 1)), ','), '') AS out_of_order
FROM h GROUP BY book, run"""
)
def sequence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of printed numbers and what is wrong in them."""
    out = seq.check_sequence(_numbered(spark, sf_dir))
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return out.select("book", "run", "division", "first", "last", "numbered", F.aggregate("missing", F.lit(0).cast("long"), lambda a, g: a + g["end"] - g["start"] + 1).alias("n_missing"), join("duplicates").alias("duplicates"), join("out_of_order").alias("out_of_order"))


@query(
    _NUMBERED_SQL
    + """, m AS (SELECT *, last_value(number IGNORE NULLS) OVER (PARTITION BY book ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
  number IS NOT NULL AND row_number() OVER (PARTITION BY book, division, number IS NOT NULL ORDER BY pos) = 1 AS f FROM b),
q AS (SELECT *, coalesce((f AND number <= prev)::INT, 0) AS z FROM m),
u AS (SELECT *, sum(z) OVER (PARTITION BY book ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM q)
SELECT book, pos, number, number IS NOT NULL AND row_number() OVER (PARTITION BY book, run, number ORDER BY pos) > 1 AS duplicate_number,
  coalesce(number IS NOT NULL AND NOT (z = 1 OR prev IS NULL OR number = prev + 1), false) AS out_of_sequence FROM u"""
)
def number_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that repeat or don't follow, by the rule of segmentation."""
    return seq.number_flags(_numbered(spark, sf_dir)).select("book", "pos", "number", "duplicate_number", "out_of_sequence")


#: The rows of each division in order, with the ids that are taken.
_UNIQUE_SQL = """WITH RECURSIVE w AS (
  SELECT *, 'v' || (l_partkey % 2) || CASE l_suppkey % 4 WHEN 0 THEN '-2' WHEN 1 THEN '-' || (1 + l_linenumber % 4) ELSE '' END AS id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem
), g AS (
  SELECT l_orderkey, n, id AS unique_id, [id] AS taken FROM w WHERE n = 1
  UNION ALL
  SELECT l_orderkey, n, given, list_append(taken, given) FROM (
    SELECT w.l_orderkey, w.n, g.taken, CASE WHEN list_contains(g.taken, w.id) THEN
      list_filter(list_transform(range(2, w.n + 3), lambda k: w.id || '-' || k), lambda c: NOT list_contains(g.taken, c))[1] ELSE w.id END AS given
    FROM g JOIN w ON w.l_orderkey = g.l_orderkey AND w.n = g.n + 1)
)
SELECT w.l_orderkey, w.l_linenumber, w.l_partkey, w.l_suppkey, w.l_quantity, w.l_extendedprice, w.id, unique_id FROM w JOIN g USING (l_orderkey, n)"""


@query(_UNIQUE_SQL)
def unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers made unique within their division, in order, some of them with numbers at their end already."""
    end = F.when(F.col("l_suppkey") % 4 == 0, "-2").when(F.col("l_suppkey") % 4 == 1, F.concat(F.lit("-"), (F.col("l_linenumber") % 4 + 1).cast("string"))).otherwise("")
    rows = table(spark, sf_dir, "lineitem").withColumn("id", F.concat(F.lit("v"), (F.col("l_partkey") % 2).cast("string"), end))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return seq.unique_ids(rows, ["l_orderkey"], "id", order).select("l_orderkey", *order, "id", "unique_id")


@query(
    "WITH k AS (SELECT source AS book, doc_id AS page, n_chars % 7 AS printed, doc_id - n_chars % 7 - (doc_id // 20) * 20 AS d FROM documents WHERE n_chars % 7 <> 0), "
    "y AS (SELECT book, d AS page_offset, count(*) AS n, min(page) AS seen FROM k GROUP BY ALL) "
    "SELECT book, page_offset, sum(n) OVER (PARTITION BY book)::BIGINT AS numbered, (sum(n) OVER (PARTITION BY book) - n)::BIGINT AS disagreements FROM y QUALIFY row_number() OVER (PARTITION BY book ORDER BY n DESC, seen) = 1"
)
def numbering_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest difference of page and printed number in each book."""
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), F.when(F.col("n_chars") % 7 != 0, F.col("n_chars") % 7 + F.floor(F.col("doc_id") / 20) * 20).alias("printed"))
    return seq.numbering_offset(pages)


@query(
    "WITH h AS (SELECT source, trim(regexp_replace(regexp_replace(unnest(string_split(text, chr(10))), '[0-9]+', ' ', 'g'), '\\s+', ' ', 'g')) AS head FROM documents), "
    "y AS (SELECT source, head, count(*) AS n FROM h WHERE head <> '' GROUP BY ALL), "
    "z AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, head) AS r, lead(n) OVER (PARTITION BY source ORDER BY n DESC, head) AS s FROM y) "
    "SELECT source, CASE WHEN s IS NULL OR n > s THEN head END AS winner, n AS votes FROM z WHERE r = 1"
)
def running_head_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that stands most often in each source; a tie has no winner."""
    lines = table(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    head = F.trim(F.regexp_replace(F.regexp_replace("line", "[0-9]+", " "), "\\s+", " "))
    return seq.vote(lines.select("source", head.alias("head")).where("head <> ''"), ["source"], "head")


# --- text functions -------------------------------------------------------------------------------------------------

_INDIC_SRC = f"WITH src AS (SELECT doc_id, {INDIC_SQL} AS text FROM documents)"


def _indic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", indic(F.col("text")).alias("text"))


@query(_INDIC_SRC + f",{_PROFILE_SQL} SELECT doc_id, gujr, deva, latn, other, total, dominant, round(share, 6) AS share FROM p")
def script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters by script of texts with Indic letters."""
    p = _indic(spark, sf_dir).select("doc_id", t.script_profile(F.col("text")).alias("p"))
    return p.select("doc_id", *(F.col(f"p.{c}").alias(c) for c in ("gujr", "deva", "latn", "other", "total", "dominant")), F.round("p.share", 6).alias("share"))


def _runs(pattern: str) -> str:
    return f"coalesce(list_sum(list_transform(regexp_extract_all(text, '{pattern}'), lambda x: length(x) - 1)), 0)::BIGINT"


@query(
    _INDIC_SRC
    + f" SELECT doc_id, {_runs(s.S + '+')} AS adjacent_vowel_signs, len(regexp_extract_all(text, '{s.V}{s.S}')) AS virama_before_vowel_sign, len(regexp_extract_all(text, '{s.cls(s.VOWEL_SIGNS, s.VIRAMAS, s.CONSONANTS)}')) AS examined FROM src"
)
def orthography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impossible letter sequences that SQL can count too."""
    o = _indic(spark, sf_dir).select("doc_id", t.orthography(F.col("text"), "gujr").alias("o"))
    return o.select("doc_id", *(F.col(f"o.{c}").alias(c) for c in ("adjacent_vowel_signs", "virama_before_vowel_sign", "examined")))


#: Letters as the letters of their classes, then each place by its neighbours.
_PLACES_SQL = f"""
, k AS (SELECT doc_id, text, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[a-z]', '.', 'g'), '{s.S}', 's', 'g'), '{s.V}', 'v', 'g'), '{s.C}', 'c', 'g'), '{s.N}', 'n', 'g'), '') AS l FROM src),
h AS (SELECT doc_id, text, l, range(1, len(l) + 1) AS r FROM k),
f AS (SELECT doc_id, len(list_filter(r, lambda i: l[i] = 's' AND i > 1 AND l[i - 1] = 's')) AS adjacent_vowel_signs,
  len(list_filter(r, lambda i: l[i] = 's' AND NOT (i > 1 AND l[i - 1] IN ('s', 'c', 'v')) AND NOT (i > 2 AND l[i - 1] = 'n' AND l[i - 2] IN ('c', 'v')))) AS vowel_sign_without_base,
  len(list_filter(r, lambda i: l[i] = 'v' AND i < len(l) AND l[i + 1] = 's')) AS virama_before_vowel_sign,
  len(list_filter(r, lambda i: l[i] = 'v' AND NOT (i > 1 AND l[i - 1] = 'c') AND NOT (i > 2 AND l[i - 1] = 'n' AND l[i - 2] = 'c'))) AS virama_without_base,
  len(list_filter(l, lambda x: x IN ('s', 'v', 'c'))) AS examined, contains(text, chr({s.PRE_BASE_MATRA['gujr']})) AS has_matra FROM h),
g AS (SELECT *, (examined >= 300 AND NOT has_matra)::BIGINT AS no_pre_base_matra, adjacent_vowel_signs + vowel_sign_without_base + virama_before_vowel_sign + virama_without_base + (examined >= 300 AND NOT has_matra)::BIGINT AS violations FROM f)
SELECT * EXCLUDE (has_matra), CASE WHEN examined = 0 THEN 0.0::DOUBLE ELSE violations * 1000.0::DOUBLE / examined END AS rate FROM g"""


@query(_INDIC_SRC + _PLACES_SQL)
def orthography_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of impossible sequences, and their rate."""
    o = _indic(spark, sf_dir).select("doc_id", F.explode(F.array(t.orthography(F.col("text"), "gujr"))).alias("o"))
    return o.select("doc_id", "o.*")


#: All faults by their places (from 1), and what is reported of them.
_FINDINGS_SQL = _PLACES_SQL.split("\nf AS (")[0] + f"""
x AS (SELECT doc_id, text, list_concat(list_filter(r, lambda i: l[i] = 's' AND i > 1 AND l[i - 1] = 's'),
  list_filter(r, lambda i: l[i] = 's' AND NOT (i > 1 AND l[i - 1] IN ('s', 'c', 'v')) AND NOT (i > 2 AND l[i - 1] = 'n' AND l[i - 2] IN ('c', 'v'))),
  list_filter(r, lambda i: l[i] = 'v' AND i < len(l) AND l[i + 1] = 's'), list_filter(r, lambda i: l[i] = 'v' AND NOT (i > 1 AND l[i - 1] = 'c') AND NOT (i > 2 AND l[i - 1] = 'n' AND l[i - 2] = 'c'))) AS p,
  len(list_filter(l, lambda x: x IN ('s', 'v', 'c'))) AS examined, contains(text, chr({s.PRE_BASE_MATRA['gujr']})) AS has_matra FROM h),
y AS (SELECT *, (examined >= 300 AND NOT has_matra)::BIGINT AS lost FROM x)
SELECT doc_id, len(p) + lost AS faults, examined, least(len(p), 12) + lost AS reported, list_min(p) - 1 AS first_at, substr(text, greatest(list_min(p) - 6, 1), list_min(p) + 6 - greatest(list_min(p) - 6, 1)) AS sample FROM y"""


@query(_INDIC_SRC + _FINDINGS_SQL)
def orthography_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults with their places: how many, how many are reported, and the first with the text around it."""
    o = _indic(spark, sf_dir).select("doc_id", findings.orthography_findings(F.col("text"), "gujr").alias("o"))
    first = F.get(F.filter("o.violations", lambda v: v["at"] >= 0), F.lit(0))
    return o.select("doc_id", F.col("o.count").alias("faults"), F.col("o.examined").alias("examined"), F.size("o.violations").cast("long").alias("reported"), first["at"].cast("long").alias("first_at"), first["sample"].alias("sample"))


@query()
def aksharas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syllables of texts with Indic letters, and the first of them (look-ahead and possessive repeats: no SQL; tested by fixtures)."""
    a = _indic(spark, sf_dir).select("doc_id", F.explode(F.array(t.akshara_summary(F.col("text"), 12))).alias("a"))
    return a.select("doc_id", "a.*")


@query()
def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audited normalisation of texts with Indic letters."""
    n = _indic(spark, sf_dir).select("doc_id", normalize(F.col("text"), "gujr").alias("n"))
    return n.select("doc_id", F.col("n.text").alias("text"), F.size("n.repairs").cast("long").alias("n_repairs"), F.col("n.lines_joined").cast("long").alias("lines_joined"), F.col("n.controls_removed").cast("long").alias("controls_removed"), F.col("n.changed").alias("changed"))


_MARKED = {"a": "àáâãäå", "c": "ç", "e": "èéêë", "i": "ìíîï", "n": "ñ", "o": "òóôõö", "u": "ùúûü", "y": "ýÿ"}
_APART_SQL = "lower(text)"
for _base, _letters in _MARKED.items():
    _APART_SQL = f"regexp_replace({_APART_SQL}, '[{_letters}]', '{_base}-', 'g')"


@query(f"SELECT doc_id, regexp_replace(regexp_replace({_APART_SQL}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, translate(text, '0123456789', '૦૧૨૩૪૫૬૭૮૯') AS digits FROM documents")
def slugs_and_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of whole texts (letters apart from their marks), and texts with the digits of another script."""
    return table(spark, sf_dir, "documents").select("doc_id", t.slugify(nfkd(F.col("text"))).alias("slug"), t.convert_digits(F.col("text"), "gujr").alias("digits"))


@query("SELECT p_partkey, try_cast(p_partkey * 37 AS BIGINT) AS value, 'gujr' AS script, translate((p_partkey * 37)::VARCHAR, '0123456789', '૦૧૨૩૪૫૬૭૮૯') AS printed FROM part")
def indic_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers printed in another script and read again."""
    printed = t.format_number(F.col("p_partkey") * 37, "gujr")
    return table(spark, sf_dir, "part").select("p_partkey", t.parse_number(printed)["value"].alias("value"), t.parse_number(printed)["script"].alias("script"), printed.alias("printed"))


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\n\\s*\\n\\s*', chr(1), 'g'), '[ \\t]*\\n[ \\t]*', chr(10), 'g'), '[ \\t]*\\x01', chr(1), 'g'), '-\\n', '', 'g'), '\\n', ' ', 'g') AS text FROM documents")
def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed lines as running text (paragraph marks left in place)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(t.join_lines(F.col("text")), "\n", "\u0001").alias("text"))


def _fnv_oracle() -> str:
    return """WITH RECURSIVE s AS (SELECT p_partkey, hex(encode(p_name)) AS h, 1 AS i, 14695981039346656037::HUGEINT AS v FROM part UNION ALL
SELECT p_partkey, h, i + 2, (xor(v, ('0x' || substr(h, i, 2))::HUGEINT) * 435 + (xor(v, ('0x' || substr(h, i, 2))::HUGEINT) % 16777216) * 1099511627776) % 18446744073709551616 FROM s WHERE i < length(h))
SELECT p_partkey, lower(lpad(to_hex(v), 16, '0')) AS fnv FROM s WHERE i > length(h)"""


@query(_fnv_oracle())
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a of 64 bits of names."""
    return table(spark, sf_dir, "part").select("p_partkey", r.fnv1a64(F.col("p_name")).alias("fnv"))


@query("SELECT page_id, sha256(html) AS sha, octet_length(encode(html)) AS bytes FROM pages")
def package_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and sizes of whole pages."""
    return table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha"), F.octet_length("html").cast("long").alias("bytes"))


# --- versions, refs, merges -----------------------------------------------------------------------------------------

_RELEASES = "SELECT p_brand AS book_id, (p_size % 4) || '.' || (p_partkey % 12) || '.' || (p_partkey % 5) AS version, p_partkey FROM part"


def _releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.concat_ws(".", (F.col("p_size") % 4).cast("string"), (F.col("p_partkey") % 12).cast("string"), (F.col("p_partkey") % 5).cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("book_id"), v.alias("version"), "p_partkey")


_KEY_SQL = "list_transform(string_split(version, '.'), lambda x: x::BIGINT)"


@query(f"WITH x AS ({_RELEASES}), d AS (SELECT DISTINCT book_id, version FROM x), k AS (SELECT *, {_KEY_SQL} AS k FROM d) SELECT book_id, count(*) AS n_versions, arg_max(version, k) AS latest, string_agg(version, ',' ORDER BY k DESC) AS versions FROM k GROUP BY book_id")
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions of each book, newest first by number."""
    return versions.catalog(_releases(spark, sf_dir).select("book_id", "version").distinct(), "book_id", "version")


@query(
    f"WITH x AS ({_RELEASES}), d AS (SELECT DISTINCT book_id, version FROM x), k AS (SELECT *, {_KEY_SQL} AS k, lag(version) OVER (PARTITION BY book_id ORDER BY version) AS version_before FROM d), "
    "m AS (SELECT *, list_transform(string_split(version_before, '.'), lambda x: x::BIGINT) AS b, CASE length(book_id) % 3 WHEN 0 THEN 'major' WHEN 1 THEN 'minor' ELSE 'patch' END AS required_bump FROM k WHERE version_before IS NOT NULL), "
    "n AS (SELECT *, CASE WHEN NOT k > b THEN NULL WHEN k[1] <> b[1] THEN 3 WHEN k[2] <> b[2] THEN 2 ELSE 1 END AS bump FROM m) "
    "SELECT book_id, version_before, version AS version_after, CASE WHEN k[3] = 4 THEN 'release-book-mismatch' WHEN bump IS NULL THEN 'release-version-not-newer' ELSE 'release-bump-understates-change' END AS code, CASE WHEN bump IS NULL OR k[3] = 4 THEN 'error' ELSE 'warning' END AS severity "
    "FROM n WHERE k[3] = 4 OR bump IS NULL OR bump < CASE required_bump WHEN 'major' THEN 3 WHEN 'minor' THEN 2 ELSE 1 END"
)
def release_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with version numbers, release by release."""
    d = _releases(spark, sf_dir).select("book_id", "version").distinct()
    pairs = d.withColumn("version_before", F.lag("version").over(Window.partitionBy("book_id").orderBy("version"))).where("version_before IS NOT NULL")
    n = F.length("book_id") % 3
    need = F.when(n == 0, "major").when(n == 1, "minor").otherwise("patch")
    other = F.when(F.endswith("version", F.lit(".4")), "another").otherwise(F.col("book_id"))
    return versions.audit_releases(pairs.select("book_id", "version_before", F.col("version").alias("version_after"), need.alias("required_bump"), other.alias("book_before")))


_UNITS_SQL = """
before AS (SELECT source || '#d' || doc_id AS ref, sha256(text) AS hash FROM documents WHERE doc_id % 11 <> 0),
after AS (SELECT source || '#d' || doc_id AS ref, sha256(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 7 <> 0),
changes AS (SELECT coalesce(b.ref, a.ref) AS ref, 'verse' AS kind, CASE WHEN b.ref IS NULL THEN 'added' WHEN a.ref IS NULL THEN 'retired' WHEN a.hash <> b.hash THEN 'changed' END AS change FROM before b FULL JOIN after a ON a.ref = b.ref)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("#d"), F.col("doc_id").cast("string")).alias("ref"), "text")
    before = d.where("doc_id % 11 <> 0").select("ref", F.lit("verse").alias("kind"), F.sha2("text", 256).alias("hash"))
    after = d.where("doc_id % 7 <> 0").select("ref", F.lit("verse").alias("kind"), F.sha2(F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return versions.diff_units(before, after)


@query(f"WITH {_UNITS_SQL.strip()} SELECT ref, kind, change FROM changes WHERE change IS NOT NULL")
def release_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came, went and changed between two versions."""
    return _changes(spark, sf_dir)


@query(
    f"WITH {_UNITS_SQL.strip()}, n AS (SELECT count_if(change = 'added')::BIGINT AS verses_added, count_if(change = 'retired')::BIGINT AS verses_retired, count_if(change = 'changed')::BIGINT AS verses_changed, 0::BIGINT AS divisions_added, 0::BIGINT AS divisions_retired, "
    "count_if(change = 'retired' AND substr(ref, strpos(ref, '#d') + 2)::BIGINT % 2 = 0)::BIGINT AS refs_aliased, count_if(change = 'retired' AND substr(ref, strpos(ref, '#d') + 2)::BIGINT % 2 <> 0)::BIGINT AS refs_dropped FROM changes) "
    "SELECT *, 0::BIGINT AS layers_added, 0::BIGINT AS layers_removed, CASE WHEN verses_retired > 0 THEN 'major' WHEN verses_added > 0 THEN 'minor' WHEN verses_changed > 0 THEN 'patch' END AS required_bump FROM n"
)
def release_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of a release and the bump it requires."""
    d = table(spark, sf_dir, "documents")
    aliases = d.where("doc_id % 2 = 0").select(F.concat("source", F.lit("#d"), F.col("doc_id").cast("string")).alias("source"))
    return versions.release_diff(_changes(spark, sf_dir), aliases)


_MOVES_SQL = """
WITH RECURSIVE live AS (SELECT 'b#k' || o_orderkey AS ref FROM orders WHERE o_orderkey % 5 = 0),
edges AS (SELECT 'b#k' || o_orderkey AS source, 'b#k' || (o_orderkey + CASE WHEN o_orderkey % 4 = 1 THEN 2 ELSE 1 END) AS target FROM orders WHERE o_orderkey % 3 <> 0),
w(ref, place, hop) AS (SELECT 'b#k' || o_orderkey, 'b#k' || o_orderkey, 0 FROM orders WHERE o_orderkey % 5 <> 0
  UNION ALL SELECT w.ref, e.target, hop + 1 FROM w JOIN edges e ON w.place = e.source WHERE hop < 16 AND (hop = 0 OR w.place NOT IN (SELECT ref FROM live))),
f AS (SELECT w.ref, w.place AS target FROM w WHERE hop > 0 AND w.place IN (SELECT ref FROM live) QUALIFY row_number() OVER (PARTITION BY w.ref ORDER BY hop) = 1)
SELECT 'b#k' || o_orderkey AS ref, CASE WHEN o_orderkey % 5 = 0 THEN 'b#k' || o_orderkey ELSE f.target END AS target,
  CASE WHEN o_orderkey % 5 = 0 THEN 'live' WHEN f.target IS NOT NULL THEN 'rewritten' ELSE 'orphaned' END AS status
FROM orders LEFT JOIN f ON f.ref = 'b#k' || o_orderkey"""


@query(_MOVES_SQL)
def migrated_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refs after a release: live, rewritten over aliases, or orphaned."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    ref = lambda c: F.concat(F.lit("b#k"), c.cast("string"))
    live = o.where("o_orderkey % 5 = 0").select(ref(F.col("o_orderkey")).alias("ref"))
    edges = o.where("o_orderkey % 3 <> 0").select(ref(F.col("o_orderkey")).alias("source"), ref(F.col("o_orderkey") + F.when(F.col("o_orderkey") % 4 == 1, 2).otherwise(1)).alias("target"))
    return versions.migrate(o.select(ref(F.col("o_orderkey")).alias("ref")), live, edges)


_OLD_SQL = _with("SELECT 1").rsplit("SELECT 1", 1)[0].rstrip() + """,
old AS (SELECT * FROM verses WHERE ordinal % 5 <> 0),
new AS (SELECT book_id, division_id, id, number, CASE WHEN ordinal % 3 = 0 THEN ocr_text || ' again' ELSE ocr_text END AS text, confidence FROM verses WHERE ordinal % 4 <> 1),
j AS (SELECT coalesce(o.book_id, n.book_id) AS book_id, coalesce(o.division_id, n.division_id) AS division_id, coalesce(o.id, n.id) AS id, o.number, o.text, o.ocr_text, o.status, o.ocr_changed, o.orphaned, o.origin, o.confidence,
  n.number AS nn, n.text AS nt, n.confidence AS nc, o.id IS NOT NULL AS have, n.id IS NOT NULL AS come, coalesce(o.status = 'raw' AND o.text = o.ocr_text, false) AS untouched
  FROM old o FULL JOIN new n ON o.book_id = n.book_id AND o.division_id = n.division_id AND o.id = n.id),
k AS (SELECT *, come AND (NOT have OR untouched) AS take, come AND have AND NOT untouched AND ocr_text <> nt AS reset, have AND NOT come AND origin = 'imported' AS gone FROM j)"""


@query(
    _OLD_SQL
    + """ SELECT book_id, division_id, id, CASE WHEN take THEN nn ELSE number END AS number, CASE WHEN take THEN nt ELSE text END AS text, CASE WHEN come THEN nt ELSE ocr_text END AS ocr_text,
CASE WHEN take OR reset THEN 'raw' ELSE status END AS status, CASE WHEN take THEN false WHEN come THEN ocr_text <> nt ELSE ocr_changed END AS ocr_changed, CASE WHEN come THEN false WHEN gone THEN true ELSE orphaned END AS orphaned,
coalesce(origin, 'imported') AS origin, CASE WHEN come THEN nc ELSE confidence END AS confidence,
CASE WHEN come AND NOT have THEN 'inserted' WHEN reset THEN 'reset' WHEN come THEN 'refreshed' WHEN gone THEN 'orphaned' ELSE 'kept' END AS action, come AND coalesce(orphaned, false) AS restored FROM k"""
)
def import_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verses after a re-import, by the rules of touched and untouched ones."""
    v = verses(spark, sf_dir)
    new = v.where("ordinal % 4 <> 1").select("book_id", "division_id", "id", "number", F.when(F.col("ordinal") % 3 == 0, F.concat("ocr_text", F.lit(" again"))).otherwise(F.col("ocr_text")).alias("text"), "confidence")
    return studio.import_draft(v.where("ordinal % 5 <> 0"), new)


_BLOCKS_SQL = "SELECT conv_id AS book_id, turn AS page, role AS block_id, text FROM conversations"


@query(
    f"WITH b AS ({_BLOCKS_SQL}), o AS (SELECT *, page % 2 = 0 AS resolved FROM b WHERE page % 3 <> 1), n AS (SELECT book_id, page, block_id, CASE WHEN page = 2 THEN text || '.' ELSE text END AS text FROM b WHERE page % 4 <> 0) "
    "SELECT n.book_id, n.page, n.block_id, n.text, coalesce(o.resolved AND o.text = n.text, false) AS resolved FROM n LEFT JOIN o ON o.book_id = n.book_id AND o.page = n.page AND o.block_id = n.block_id"
)
def set_aside_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks set aside after an import."""
    b = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("page"), F.col("role").alias("block_id"), "text")
    old = b.where("page % 3 <> 1").withColumn("resolved", F.col("page") % 2 == 0)
    new = b.where("page % 4 <> 0").withColumn("text", F.when(F.col("page") == 2, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return studio.upsert_set_aside(old, new)


@query(
    f"WITH b AS ({_BLOCKS_SQL}), o AS (SELECT book_id, page, block_id, text, CASE WHEN page % 2 = 0 THEN text ELSE text || '?' END AS ocr_text, CASE WHEN page = 4 THEN 'proofed' ELSE 'raw' END AS status FROM b WHERE page % 3 <> 1), "
    "n AS (SELECT book_id, page, block_id, text || '!' AS text FROM b WHERE page % 4 <> 0) SELECT coalesce(o.book_id, n.book_id) AS book_id, coalesce(o.page, n.page) AS page, coalesce(o.block_id, n.block_id) AS block_id, "
    "CASE WHEN n.text IS NOT NULL AND (o.text IS NULL OR o.status = 'raw' AND o.text = o.ocr_text) THEN n.text ELSE o.text END AS text, coalesce(n.text, o.ocr_text) AS ocr_text, coalesce(o.status, 'raw') AS status "
    "FROM o FULL JOIN n ON o.book_id = n.book_id AND o.page = n.page AND o.block_id = n.block_id"
)
def notes_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes after an import."""
    b = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("page"), F.col("role").alias("block_id"), "text")
    old = b.where("page % 3 <> 1").select("*", F.when(F.col("page") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("?"))).alias("ocr_text"), F.when(F.col("page") == 4, "proofed").otherwise("raw").alias("status"))
    return studio.upsert_notes(old, b.where("page % 4 <> 0").withColumn("text", F.concat("text", F.lit("!"))))


@query(
    _with("SELECT 1").rsplit("SELECT 1", 1)[0].rstrip()
    + """, p AS (SELECT book_id, division_id, id, CASE WHEN ordinal % 2 = 0 THEN upper(text) END AS t, CASE WHEN ordinal % 3 = 0 THEN 5::BIGINT END AS n, 'proofed' AS s FROM verses WHERE ordinal % 4 = 0)
SELECT v.book_id, v.division_id, v.id, coalesce(t, text) AS text, coalesce(n, number) AS number, coalesce(s, status) AS status, CASE WHEN t IS NOT NULL AND t <> text THEN false ELSE ocr_changed END AS ocr_changed,
CASE WHEN n IS NOT NULL AND n IS DISTINCT FROM number THEN 'renumber' WHEN t IS NOT NULL AND t <> text THEN 'edit' WHEN s IS NOT NULL AND s <> status THEN 'status' END AS action
FROM verses v LEFT JOIN p ON p.book_id = v.book_id AND p.division_id = v.division_id AND p.id = v.id"""
)
def patched_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verses after edits, with the action of each revision."""
    v = verses(spark, sf_dir)
    p = v.where("ordinal % 4 = 0").select("book_id", "division_id", "id", F.when(F.col("ordinal") % 2 == 0, F.upper("text")).alias("text"), F.when(F.col("ordinal") % 3 == 0, F.lit(5).cast("long")).alias("number"), F.lit("proofed").alias("status"))
    return studio.patch_verses(v, p).select("book_id", "division_id", "id", "text", "number", "status", "ocr_changed", "action")


# --- structure ------------------------------------------------------------------------------------------------------

_TREE_SQL = """
units AS (SELECT 'w/r' || r_regionkey AS ref, 'w' AS parent_ref, 'r' || (r_regionkey % 3) AS id, r_regionkey AS ord FROM region
UNION ALL SELECT 'w/r' || n_regionkey || '/n' || n_nationkey, 'w/r' || n_regionkey, 'n' || (n_nationkey % 4), 100 + n_nationkey FROM nation
UNION ALL SELECT 'w/r' || n_regionkey || '/n' || n_nationkey || '#c' || c_custkey, 'w/r' || n_regionkey || '/n' || n_nationkey, 'c' || (c_custkey % 1000), 1000 + c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: c.cast("string")
    rg, na, cu = (table(spark, sf_dir, n) for n in ("region", "nation", "customer"))
    top = rg.select(F.concat(F.lit("w/r"), text(F.col("r_regionkey"))).alias("ref"), F.lit("w").alias("parent_ref"), F.concat(F.lit("r"), text(F.col("r_regionkey") % 3)).alias("id"), F.col("r_regionkey").cast("long").alias("ord"))
    region = F.concat(F.lit("w/r"), text(F.col("n_regionkey")))
    nation = F.concat(region, F.lit("/n"), text(F.col("n_nationkey")))  # 25 nations, whatever the scale
    mid = na.select(nation.alias("ref"), region.alias("parent_ref"), F.concat(F.lit("n"), text(F.col("n_nationkey") % 4)).alias("id"), (F.col("n_nationkey") + 100).cast("long").alias("ord"))
    low = cu.join(F.broadcast(na), cu["c_nationkey"] == na["n_nationkey"]).select(F.concat(nation, F.lit("#c"), text(F.col("c_custkey"))).alias("ref"), nation.alias("parent_ref"), F.concat(F.lit("c"), text(F.col("c_custkey") % 1000)).alias("id"), (F.col("c_custkey") + 1000).alias("ord"))
    return top.unionByName(mid).unionByName(low)


@query(f"WITH {_TREE_SQL.strip()} SELECT 'error' AS severity, 'duplicate-sibling-id' AS code, parent_ref AS path FROM units QUALIFY row_number() OVER (PARTITION BY parent_ref, id ORDER BY ord) > 1")
def sibling_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units whose id a sibling has already."""
    return st.sibling_issues(_units(spark, sf_dir))


@query(
    f"WITH {_TREE_SQL.strip()}, live AS (SELECT ref FROM units WHERE ord % 3 <> 0), t AS (SELECT ref FROM units WHERE ord % 3 = 0), "
    "x AS (SELECT t.ref, max(length(l.ref)) AS n FROM t LEFT JOIN live l ON NOT contains(l.ref, '#') AND (starts_with(t.ref, l.ref || '/') OR starts_with(t.ref, l.ref || '#')) GROUP BY 1) "
    "SELECT ref, CASE WHEN n IS NULL THEN 'w' ELSE left(ref, n) END AS ancestor FROM x"
)
def nearest_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost live container of refs that are gone."""
    u = _units(spark, sf_dir)
    return versions.nearest_live_ancestor(u.where("ord % 3 = 0").select("ref"), u.where("ord % 3 <> 0").select("ref"))


@query(
    f"WITH {_TREE_SQL.strip()}, a AS (SELECT ref AS source, CASE WHEN ord % 4 = 0 THEN ref WHEN ord % 4 = 1 THEN 'other/x' WHEN ord % 4 = 2 THEN 'Not A Ref' ELSE 'w/gone' END AS target, ord FROM units WHERE ord % 5 = 0), live AS (SELECT ref FROM units WHERE ord % 2 = 0) "
    "SELECT 'error' AS severity, 'alias-source-live' AS code, '/aliases/' || source AS path FROM a WHERE source IN (SELECT ref FROM live) UNION ALL "
    "SELECT 'error', CASE ord % 4 WHEN 1 THEN 'alias-foreign-book' WHEN 2 THEN 'alias-unparseable' ELSE 'alias-target-missing' END, '/aliases/' || source FROM a WHERE ord % 4 <> 0 OR target NOT IN (SELECT ref FROM live)"
)
def alias_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with aliases, one issue for each side at most."""
    u = _units(spark, sf_dir)
    n = F.col("ord") % 4
    aliases = u.where("ord % 5 = 0").select(F.col("ref").alias("source"), F.when(n == 0, F.col("ref")).when(n == 1, "other/x").when(n == 2, "Not A Ref").otherwise("w/gone").alias("target"))
    return st.alias_issues(aliases, u.where("ord % 2 = 0").select("ref"), "w")


# --- blocks and pages -----------------------------------------------------------------------------------------------

@query(
    f"WITH src AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'paragraph' WHEN 'assistant' THEN 'footnote' ELSE 'header' END AS tag, text FROM conversations),{_PROFILE_SQL} "
    "SELECT conv_id, turn, tag, CASE WHEN trim(text) = '' THEN 'dropped' WHEN tag = 'header' OR total > 0 AND coalesce(dominant, '') <> 'latn' THEN 'set-aside' WHEN tag = 'footnote' THEN 'notes' ELSE 'body' END AS bucket FROM p"
)
def block_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the blocks of pages go."""
    tag = F.when(F.col("role") == "user", "paragraph").when(F.col("role") == "assistant", "footnote").otherwise("header")
    b = table(spark, sf_dir, "conversations").select("conv_id", "turn", tag.alias("tag"), "text")
    return b.select("conv_id", "turn", "tag", seg.route(F.col("tag"), F.col("text"), seg.admitted_scripts("en")).alias("bucket"))


def _indic_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(table(spark, sf_dir, "conversations"))
    number = F.concat(F.lit(" ॥"), t.format_number(F.col("turn") + 1, "gujr"), F.lit("॥ "))
    tag = F.when(F.col("role") == "system", "section-title").otherwise("paragraph")
    text = F.concat(indic(F.col("text")), number)
    return c.select(F.col("conv_id").alias("book"), F.floor(F.col("turn") / 2).cast("long").alias("page"), F.col("turn").alias("pos"), tag.alias("tag"), text.alias("text"))


@query()
def segmented_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of books in Indic letters, with flags and confidence (a scan over states: tested against one pass)."""
    out = seg.segment(_indic_blocks(spark, sf_dir), "gujr", ["gujr", "deva"])
    return out.withColumn("flags", F.array_join("flags", ",")).withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query()
def segmented_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the same books, with titles and where they come from (tested against one pass)."""
    return seg.segment_book(_indic_blocks(spark, sf_dir), "gujr", ["gujr", "deva"])[1]


@query(
    _with(
        """, b AS (SELECT v.book_id AS book, d.ordinal AS page, v.ordinal AS pos, v.ordinal = 0 AND d.kind = '1-URGENT' AS heading, v.text, v.number FROM verses v JOIN divisions d ON v.book_id = d.book_id AND v.division_id = d.id),
    s AS (SELECT *, sum(heading::INT) OVER (PARTITION BY book ORDER BY page, pos ROWS UNBOUNDED PRECEDING)::BIGINT AS section FROM b),
    p AS (SELECT *, coalesce(sum((number IS NOT NULL)::INT) OVER (PARTITION BY book, section ORDER BY page, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passage FROM s WHERE NOT heading)
    SELECT book, section, min(struct_pack(page := page, pos := pos)).page AS start_page, min(struct_pack(page := page, pos := pos)).pos AS start_pos, max(number) AS number, count(*) AS pieces,
      string_agg(CASE WHEN number IS NULL THEN text ELSE text || ' ॥' END, '|' ORDER BY page, pos) AS texts FROM p GROUP BY book, section, passage"""
    ).replace("\n, b AS", ", b AS", 1)
)
def passage_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the passages of each book begin and end; large books are read in chunks of two divisions."""
    d = divisions(spark, sf_dir).select("book_id", F.col("id").alias("division_id"), F.col("ordinal").alias("page"), "kind")
    v = verses(spark, sf_dir).select("book_id", "division_id", F.col("ordinal").alias("pos"), "text", "number").join(d, ["book_id", "division_id"])
    text = F.concat("text", F.when(F.col("number").isNull(), "").otherwise(F.concat(F.lit(" ॥"), t.format_number(F.col("number"), "gujr"), F.lit("॥"))))
    kind = F.when((F.col("pos") == 0) & (F.col("kind") == "1-URGENT"), "heading").otherwise("text")
    out = scan(v.select(F.col("book_id").alias("book"), "page", "pos", kind.alias("kind"), text.alias("text")), "gujr", 2).where("kind = 'text'")
    out = out.groupBy("book", "section", "start").agg(F.max("value").alias("number"), F.count("*").alias("pieces"), F.array_sort(F.collect_list(F.struct("page", "pos", "k", "text"))).alias("t"))
    return out.select("book", "section", F.col("start.page").alias("start_page"), F.col("start.pos").alias("start_pos"), "number", "pieces", F.array_join("t.text", "|").alias("texts"))


@query(page_spec_sql())
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of range lists, in order and each once, within the book."""
    from ..sources.pages import pages_of_spec

    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 40 + 1).cast("int").alias("pages"))
    spec = F.concat(F.lit("2, 5-"), (F.col("o_orderkey") % 9 + 3).cast("string"), F.lit(", 30-"))
    return pages_of_spec(o.withColumn("spec", spec), "spec", "pages").groupBy("o_orderkey").agg(F.count("*").alias("n"), F.min("page").cast("long").alias("first"), F.max("page").cast("long").alias("last"))


@query("SELECT DISTINCT o_orderkey, least(n - 1, floor(n / 12.0 * (s + 0.5)))::BIGINT AS place FROM (SELECT o_orderkey, o_orderkey % 60 + 1 AS n FROM orders), (SELECT unnest(range(12)) AS s)")
def sampled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that stand for a book: the middles of equal slices."""
    n = F.col("o_orderkey") % 60 + 1
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(sample_places(n, 12)).alias("place")).distinct()


# --- extension: rollups over the event stream -----------------------------------------------------------------------


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by kind and hour: the batch form of the streaming rollup."""
    from ..streaming.rollup import rollup

    out = rollup(table(spark, sf_dir, "events"), "1 hour")
    return out.select("event_type", F.col("window.start").alias("hour"), "n", F.round("total", 4).alias("total"))


from . import documents, drafts, editing, scalars, writing  # noqa: E402, F401  (they register their queries)

"""The queries of changes to verses, of releases and gates, and of book overviews, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import packages as pk
from ..operators import restructure as rs
from ..operators import sequence as seq
from ..operators import structure as st
from ..operators import studio, versions
from .derived import EDITED_CTE, divisions, edited_verses, table, verses
from .registry import query, with_tables

_KEYS = ["book_id", "division_id", "id"]
_EDITED = with_tables("").rstrip() + EDITED_CTE


def _lists(df: DataFrame, *names: str) -> DataFrame:
    """Arrays as text, so that both sides compare them alike (flags and lineages in their order)."""
    for n in names:
        df = df.withColumn(n, F.array_join(F.col(n).cast("array<string>"), ","))
    return df


# --- changes to verses ------------------------------------------------------------------------------------------------

_SPLIT_SQL = _EDITED + """, c AS (SELECT *, ordinal % 3 = 0 AS cut, 'p7-' || (ordinal + 2) || CASE WHEN ordinal + 1 < n THEN '-2' ELSE '' END AS tail FROM e),
x AS (SELECT book_id, division_id, id, ordinal AS o, 0 AS part, number, CASE WHEN cut THEN rtrim(left(text, 8)) ELSE text END AS text, ocr_text, CASE WHEN cut THEN 'raw' ELSE status END AS status, origin, lineage, flags, CASE WHEN cut THEN 'split' END AS action,
    CASE WHEN cut THEN 'Split at character 8; the rest became ' || tail || '.' END AS note FROM c
  UNION ALL SELECT book_id, division_id, tail, ordinal, 1, NULL, ltrim(substr(text, 9)), ltrim(substr(text, 9)), 'raw', 'split', [division_id || '#' || id],
    CASE WHEN list_contains(flags, 'no-number') THEN flags ELSE list_append(flags, 'no-number') END, 'split', 'Split off ' || division_id || '#' || id || '.' FROM c WHERE cut)"""


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = edited_verses(spark, sf_dir)
    # Cuts at either end of a text are refused.
    offset = F.when(F.col("ordinal") % 3 == 0, 8).when(F.col("ordinal") % 3 == 1, 0).otherwise(F.length("text"))
    return rs.split(v, v.select(*_KEYS, offset.alias("offset")))


@query(_SPLIT_SQL + """ SELECT book_id, division_id, id, row_number() OVER (PARTITION BY book_id, division_id ORDER BY o, part) - 1 AS ordinal, number, text, ocr_text, status, origin, array_to_string(lineage, ',') AS lineage, array_to_string(flags, ',') AS flags FROM x""")
def split_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verses after some were cut in two."""
    return _lists(_split(spark, sf_dir), "lineage", "flags").select("book_id", "division_id", "id", "ordinal", "number", "text", "ocr_text", "status", "origin", "lineage", "flags")


@query(_SPLIT_SQL + " SELECT book_id, division_id, id, action, text, status, number, note FROM x WHERE action IS NOT NULL")
def split_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revision rows of the cuts."""
    return rs.revisions(_split(spark, sf_dir))


@query(
    _EDITED
    + """, m AS (SELECT *, ordinal > 0 AND ((ordinal - 1) % 4 IN (0, 1) OR ordinal % 7 = 6) AS taken FROM e),
g AS (SELECT *, sum((NOT taken)::INT) OVER (PARTITION BY book_id, division_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS grp FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY book_id, division_id, grp ORDER BY ordinal) AS k, count(*) OVER (PARTITION BY book_id, division_id, grp) AS size FROM g),
r AS (SELECT book_id, division_id, grp, max(size) AS size, max(id) FILTER (k = 1) AS id, max(number) FILTER (k = 1) AS number, max(status) FILTER (k = 1) AS status, min(ordinal) AS o,
  string_agg(CASE WHEN size = 1 THEN text WHEN k = 1 THEN rtrim(text) WHEN k = size THEN ltrim(text) ELSE trim(text) END, ' ' ORDER BY ordinal) AS text, flatten(list(flags ORDER BY ordinal)) AS flags,
  flatten(list(CASE WHEN k = 1 THEN lineage ELSE list_append(lineage, division_id || '#' || id) END ORDER BY ordinal)) AS lineage FROM k GROUP BY ALL)
SELECT book_id, division_id, id, row_number() OVER (PARTITION BY book_id, division_id ORDER BY o) - 1 AS ordinal, number, text, CASE WHEN size > 1 THEN 'raw' ELSE status END AS status,
  array_to_string(list_sort(list_distinct(lineage)), ',') AS lineage, array_to_string(list_sort(list_distinct(list_filter(flags, lambda f: size = 1 OR f <> 'very-short' AND NOT (f = 'no-number' AND number IS NOT NULL)))), ',') AS flags, CASE WHEN size > 1 THEN 'merge' END AS action FROM r"""
)
def merged_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verses after merges: chains of three, and merges with the verse before."""
    v = edited_verses(spark, sf_dir)
    direction = F.when(F.col("ordinal") % 4 < 2, "next").when(F.col("ordinal") % 7 == 6, "previous")
    both = F.array(direction, F.when((F.col("ordinal") % 4 < 2) & (F.col("ordinal") % 7 == 6), "previous"))
    m = v.select(*_KEYS, F.explode(both).alias("direction")).where("direction IS NOT NULL")
    out = rs.merge(v, m).withColumn("lineage", F.array_sort("lineage")).withColumn("flags", F.array_sort("flags"))
    return _lists(out, "lineage", "flags").select("book_id", "division_id", "id", "ordinal", "number", "text", "status", "lineage", "flags", "action")


@query(
    _EDITED
    + """, a AS (SELECT book_id, division_id, ordinal + 1 AS o, 0 AS place, '12' AS number, 'typed twelve' AS text FROM e WHERE ordinal % 4 = 1 UNION ALL SELECT book_id, division_id, ordinal + 1, 1, NULL, 'typed' FROM e WHERE ordinal % 4 = 1
  UNION ALL SELECT book_id, division_id, 0, 0, NULL, 'first' FROM e WHERE ordinal = 0),
i AS (SELECT *, CASE WHEN number IS NULL THEN CASE WHEN o = 0 THEN 'p0-1' ELSE 'p8-' || (o + 1) END ELSE 'v12' || CASE WHEN row_number() OVER (PARTITION BY book_id, division_id, number ORDER BY o) > 1 THEN '-' || row_number() OVER (PARTITION BY book_id, division_id, number ORDER BY o) ELSE '' END END AS id FROM a),
x AS (SELECT book_id, division_id, id, o, 0 AS old, place, number, text, '' AS ocr_text, 'raw' AS status, 'inserted' AS origin, CASE WHEN number IS NULL THEN 'no-number' ELSE '' END AS flags, 'insert' AS action FROM i
  UNION ALL SELECT book_id, division_id, id, ordinal, 1, 0, number, text, ocr_text, status, origin, array_to_string(flags, ','), NULL FROM e)
SELECT book_id, division_id, id, row_number() OVER (PARTITION BY book_id, division_id ORDER BY o, old, place) - 1 AS ordinal, number, text, ocr_text, status, origin, flags, action FROM x"""
)
def inserted_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verses with some that were typed in: behind others, two at a time, and at the beginning."""
    v = edited_verses(spark, sf_dir)

    def typed(after: F.Column, place: int, text: str, number: str | None) -> F.Column:
        return F.struct(after.cast("string").alias("after"), F.lit(place).alias("place"), F.lit(text).alias("text"), F.lit(number).cast("string").alias("number"))

    behind = F.array(typed(F.col("id"), 0, "typed twelve", "12"), typed(F.col("id"), 1, "typed", None))
    new = v.select("book_id", "division_id", F.explode(F.when(F.col("ordinal") % 4 == 1, behind).when(F.col("ordinal") == 0, F.array(typed(F.lit(None), 0, "first", None)))).alias("n"))
    new = new.select("book_id", "division_id", "n.*")
    return _lists(rs.insert(v, new), "flags").select("book_id", "division_id", "id", "ordinal", "number", "text", "ocr_text", "status", "origin", "flags", "action")


@query(_EDITED + " SELECT book_id, division_id, id, row_number() OVER (PARTITION BY book_id, division_id ORDER BY ordinal) - 1 AS ordinal, text FROM e WHERE ordinal % 3 <> 1")
def deleted_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verses without some of them."""
    v = edited_verses(spark, sf_dir)
    return rs.delete(v, v.where("ordinal % 3 = 1").select(*_KEYS)).select("book_id", "division_id", "id", "ordinal", "text")


@query(
    _EDITED
    + """, x AS (SELECT *, row_number() OVER (PARTITION BY book_id, division_id, ordinal % 3 ORDER BY ordinal) AS k FROM e)
SELECT book_id, division_id, ordinal, CASE WHEN ordinal % 3 = 0 THEN 'v5' || CASE WHEN k > 1 THEN '-' || k ELSE '' END ELSE id END AS id, CASE ordinal % 3 WHEN 0 THEN '૫' WHEN 1 THEN NULL ELSE number END AS number,
  CASE ordinal % 3 WHEN 2 THEN array_to_string(flags, ',') WHEN 0 THEN array_to_string(list_filter(flags, lambda f: f <> 'no-number'), ',') ELSE array_to_string(list_append(list_filter(flags, lambda f: f <> 'no-number'), 'no-number'), ',') END AS flags,
  array_to_string(CASE WHEN ordinal % 3 = 2 THEN lineage ELSE list_append(lineage, division_id || '#' || id) END, ',') AS lineage, CASE WHEN ordinal % 3 <> 2 THEN 'renumber' END AS action,
  CASE WHEN ordinal % 3 = 0 THEN 'Id followed the number: ' || id || ' to v5' || CASE WHEN k > 1 THEN '-' || k ELSE '' END || '.' END AS note FROM x"""
)
def renumbered_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verses after their numbers were set or taken away; ids follow."""
    v = edited_verses(spark, sf_dir)
    changes = v.where("ordinal % 3 <> 2").select(*_KEYS, F.when(F.col("ordinal") % 3 == 0, "૫").alias("number"))
    return _lists(rs.renumber(v, changes), "flags", "lineage").select("book_id", "division_id", "ordinal", "id", "number", "flags", "lineage", "action", "note")


# --- overviews --------------------------------------------------------------------------------------------------------

_NOTES_SQL = "notes AS (SELECT o_custkey AS book_id FROM orders WHERE o_orderkey % 3 = 0), aside AS (SELECT o_custkey AS book_id, o_orderkey % 4 = 0 AS resolved FROM orders WHERE o_orderkey % 2 = 0)"


@query(
    with_tables("").rstrip()
    + f""", {_NOTES_SQL} SELECT c_custkey AS book_id, coalesce(n_raw, 0) AS n_raw, coalesce(n_proofed, 0) AS n_proofed, coalesce(n_approved, 0) AS n_approved, coalesce(total, 0) AS total, coalesce(orphaned, 0) AS orphaned, coalesce(nd, 0) AS divisions, coalesce(nn, 0) AS notes,
  coalesce(na, 0) AS set_aside, coalesce(nu, 0) AS set_aside_unresolved FROM customer
LEFT JOIN (SELECT book_id, count(*) FILTER (NOT orphaned AND status = 'raw') AS n_raw, count(*) FILTER (NOT orphaned AND status = 'proofed') AS n_proofed, count(*) FILTER (NOT orphaned AND status = 'approved') AS n_approved, count(*) FILTER (NOT orphaned) AS total FROM verses GROUP BY 1) v ON v.book_id = c_custkey
LEFT JOIN (SELECT v.book_id, count(*) FILTER (orphaned) AS orphaned FROM verses v JOIN divisions d ON d.book_id = v.book_id AND d.id = v.division_id WHERE d.ordinal % 5 <> 4 GROUP BY 1) w ON w.book_id = c_custkey
LEFT JOIN (SELECT book_id, count(*) AS nd FROM divisions WHERE ordinal % 5 <> 4 GROUP BY 1) d ON d.book_id = c_custkey LEFT JOIN (SELECT book_id, count(*) AS nn FROM notes GROUP BY 1) n ON n.book_id = c_custkey
LEFT JOIN (SELECT book_id, count(*) AS na, count(*) FILTER (NOT resolved) AS nu FROM aside GROUP BY 1) a ON a.book_id = c_custkey"""
)
def book_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of every book, with verses whose division is gone among the total only."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), "o_orderkey")
    aside = o.where("o_orderkey % 2 = 0").withColumn("resolved", F.col("o_orderkey") % 4 == 0)
    books = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book_id"))
    return studio.book_overview(books, divisions(spark, sf_dir).where("ordinal % 5 <> 4"), verses(spark, sf_dir), o.where("o_orderkey % 3 = 0"), aside)


@query(with_tables("SELECT count(*) AS total FROM verses WHERE NOT orphaned AND status = 'raw' AND list_contains(flags, 'orthography')"))
def queue_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of the queue whose pages ``queue_by_confidence`` shows."""
    return studio.queue_total(verses(spark, sf_dir), studio.conditions(status="raw", flag="orthography"))


@query(with_tables("SELECT v.book_id, v.division_id, v.id, CASE WHEN v.ordinal % 3 <> 0 THEN confidence END AS evidence FROM verses v"))
def verses_with_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verses with the evidence of their ref, null where there is none."""
    ref = F.concat_ws("#", F.concat_ws("/", F.col("book_id").cast("string"), F.col("division_id").cast("string")), F.col("id").cast("string"))
    v = verses(spark, sf_dir).withColumn("ref", ref)
    evidence = v.where("ordinal % 3 <> 0").select("ref", F.col("confidence").alias("evidence"))
    return studio.with_evidence(v.select("book_id", "division_id", "id", "ref"), evidence).drop("ref")


@query(
    "WITH h AS (SELECT conv_id % 50 AS book, conv_id AS page, role || (length(text) % 4) AS head FROM conversations), p AS (SELECT conv_id % 50 AS book, conv_id % 7 AS section, conv_id AS page FROM conversations WHERE turn = 0), "
    "y AS (SELECT book, head, count(*) AS n, min(page) AS seen FROM h GROUP BY ALL), t AS (SELECT book, head FROM y QUALIFY row_number() OVER (PARTITION BY book ORDER BY n DESC, seen, head) = 1), "
    "o AS (SELECT p.book, p.section, h.head, count(*) AS n FROM p JOIN h ON h.book = p.book AND h.page = p.page WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.book = h.book AND t.head = h.head) GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER w AS r, lead(n) OVER w AS s FROM o WINDOW w AS (PARTITION BY book, section ORDER BY n DESC, head)) SELECT book, section, head AS title FROM r WHERE r = 1 AND (s IS NULL OR n > s)"
)
def section_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of sections by the heads of their pages, without the book's own."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 50).alias("book"), (F.col("conv_id") % 7).alias("section"), F.col("conv_id").alias("page"), "turn", F.concat("role", (F.length("text") % 4).cast("string")).alias("head"))
    return seq.titles_from_heads(c.where("turn = 0").select("book", "section", F.array("page").alias("pages")), c.select("book", "page", "head"))


# --- releases ---------------------------------------------------------------------------------------------------------


@query(
    "WITH b AS (SELECT DISTINCT p_brand AS book_id, 'l' || (p_size % 6) AS layer_id FROM part WHERE p_partkey % 2 = 0), a AS (SELECT DISTINCT p_brand AS book_id, 'l' || (p_size % 9) AS layer_id FROM part WHERE p_partkey % 5 = 0) "
    "SELECT coalesce(b.book_id, a.book_id) AS book_id, coalesce(b.layer_id, a.layer_id) AS layer_id, CASE WHEN b.layer_id IS NULL THEN 'added' ELSE 'removed' END AS change FROM b FULL JOIN a ON a.book_id = b.book_id AND a.layer_id = b.layer_id WHERE b.layer_id IS NULL OR a.layer_id IS NULL"
)
def layer_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers that came and went between two releases of each book."""
    p = table(spark, sf_dir, "part")
    layer = lambda k: F.concat(F.lit("l"), (F.col("p_size") % k).cast("string")).alias("layer_id")
    return versions.diff_layers(p.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("book_id"), layer(6)), p.where("p_partkey % 5 = 0").select(F.col("p_brand").alias("book_id"), layer(9)), ["book_id"])


@query("SELECT *, CASE WHEN retired > 0 OR layers_removed > 0 THEN 'major' WHEN added > 0 THEN 'minor' WHEN changed > 0 THEN 'patch' END AS bump FROM (SELECT p_partkey, p_size % 3 // 2 AS retired, p_partkey % 4 // 3 AS layers_removed, p_partkey % 5 // 2 AS added, p_partkey % 2 AS changed FROM part)")
def required_bumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least bump by what a release changes; a removed layer is major."""
    n = lambda a, b: F.floor(a / b).cast("long")
    p = table(spark, sf_dir, "part").select("p_partkey", n(F.col("p_size") % 3, 2).cast("int").alias("retired"), n(F.col("p_partkey") % 4, 3).alias("layers_removed"), n(F.col("p_partkey") % 5, 2).alias("added"), (F.col("p_partkey") % 2).alias("changed"))
    return p.withColumn("bump", versions.required_bump(F.col("retired"), F.col("added"), F.col("changed"), F.col("layers_removed")))


@query("SELECT 'error' AS severity, 'release-ref-dropped' AS code, 's' || o_orderkey AS path FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 UNION ALL SELECT 'error', 'release-alias-forgotten', '/aliases/s' || o_orderkey FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0")
def dropped_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retired refs without an alias, and aliases that a release has forgotten."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("ref"))
    aliases = o.where("o_orderkey % 5 = 0").select(F.col("ref").alias("source"))
    changes = o.where("o_orderkey % 3 = 0").select("ref", F.lit("verse").alias("kind"), F.lit("retired").alias("change"))
    before = o.where("o_orderkey % 7 = 0").select(F.col("ref").alias("source"))
    return versions.dropped_refs(changes, aliases).unionByName(versions.forgotten_aliases(before, aliases))


_UNIT_SQL = """WITH d AS (SELECT p_brand AS book_id, 'l' || (p_partkey % 5) AS layer_id, CASE p_partkey % 5 WHEN 1 THEN 'wordMeanings' WHEN 2 THEN 'transliteration' WHEN 3 THEN 'translation' ELSE 'original' END AS kind, CASE WHEN p_size % 2 = 0 THEN 'iso' END AS scheme, p_partkey AS position FROM part WHERE p_size < 4 AND p_partkey % 5 < 4),
p AS (SELECT p_brand AS book_id, 'l' || (min(p_partkey) % 5) AS layer_id FROM part GROUP BY 1), k AS (SELECT book_id, layer_id, max(kind) AS kind FROM d GROUP BY ALL)"""


def _declared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Layers of the brands, their primary ones, and their parts as verses with two layers each."""
    part = table(spark, sf_dir, "part").withColumn("book_id", F.col("p_brand"))
    layer = lambda c: F.concat(F.lit("l"), c.cast("string"))
    n = F.col("p_partkey") % 5
    kind = F.when(n == 1, "wordMeanings").when(n == 2, "transliteration").when(n == 3, "translation").otherwise("original")
    declared = part.where((F.col("p_size") < 4) & (n < 4)).select("book_id", layer(n).alias("layer_id"), kind.alias("kind"), F.when(F.col("p_size") % 2 == 0, "iso").alias("scheme"), F.col("p_partkey").alias("position"))
    primary = part.groupBy("book_id").agg(layer(F.min("p_partkey") % 5).alias("layer_id"))
    layers = F.map_from_arrays(F.array(layer(n), layer((n + 1) % 5)), F.array("p_name", "p_type"))
    glosses = F.when(F.col("p_size") % 3 == 0, F.array(layer(n))).otherwise(F.array().cast("array<string>"))
    units = part.select("book_id", F.concat_ws("#", "book_id", F.col("p_partkey").cast("string")).alias("ref"), F.lit("verse").alias("kind"), layers.alias("layers"), glosses.alias("gloss_layers"))
    return declared, primary, units


@query(
    _UNIT_SQL
    + """, u AS (SELECT p_brand AS book_id, p_brand || '#' || p_partkey AS ref, p_partkey % 5 AS a, (p_partkey + 1) % 5 AS b, p_size FROM part),
l AS (SELECT book_id, ref, 'l' || a AS layer_id, p_size % 3 = 0 AS gloss FROM u UNION ALL SELECT book_id, ref, 'l' || b, false FROM u)
SELECT 'error' AS severity, CASE WHEN k.kind IS NULL THEN 'undeclared-layer' ELSE 'layer-kind-mismatch' END AS code, l.ref AS path FROM l LEFT JOIN k ON k.book_id = l.book_id AND k.layer_id = l.layer_id WHERE k.kind IS NULL OR (k.kind = 'wordMeanings') <> gloss
UNION ALL SELECT 'error', 'primary-layer-missing', u.ref FROM u JOIN p ON p.book_id = u.book_id JOIN k ON k.book_id = p.book_id AND k.layer_id = p.layer_id WHERE p.layer_id NOT IN ('l' || a, 'l' || b)"""
)
def unit_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of verses that are undeclared, of another kind than declared, or missing."""
    declared, primary, units = _declared(spark, sf_dir)
    return st.layer_issues(units, declared, primary)


@query(
    _UNIT_SQL
    + """ SELECT 'error' AS severity, 'duplicate-layer-id' AS code, '/layers/' || position AS path FROM d QUALIFY row_number() OVER (PARTITION BY book_id, layer_id ORDER BY position) > 1
UNION ALL SELECT 'warning', 'transliteration-scheme-missing', '/layers/' || position FROM d WHERE kind = 'transliteration' AND scheme IS NULL
UNION ALL SELECT 'error', CASE WHEN k.kind IS NULL THEN 'primary-layer-undeclared' ELSE 'primary-layer-not-original' END, '/primaryLayer' FROM p LEFT JOIN k ON k.book_id = p.book_id AND k.layer_id = p.layer_id WHERE k.kind IS NULL OR k.kind <> 'original'"""
)
def declaration_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the layers that books declare."""
    declared, primary, _ = _declared(spark, sf_dir)
    return st.declaration_issues(declared, primary)


@query(
    r"""SELECT 'error' AS severity, 'schema' AS code, doc_id || '/' || unnest(list_filter([CASE WHEN NOT regexp_full_match(source, '[a-z0-9]+(-[a-z0-9]+)*') THEN 'source' END,
CASE WHEN text = '' OR regexp_matches(text, '[\x00-\x09\x0b-\x1f\x7f-\x{9f}]') THEN 'text' END, CASE WHEN text = '' OR regexp_matches(text, '[\x00-\x1f\x7f-\x{9f}]') THEN 'title' END,
CASE WHEN NOT regexp_full_match(lang, '[a-z]{2,3}(-[A-Za-z0-9]+)*') THEN 'lang' END, CASE WHEN NOT regexp_full_match(version, '[0-9]+\.[0-9]+\.[0-9]+') THEN 'version' END], lambda x: x IS NOT NULL)) AS path
FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN '1.' || doc_id ELSE '1.0.' || doc_id END AS version FROM documents)"""
)
def schema_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose fields aren't what their kinds demand."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", F.col("text").alias("title"), F.concat(F.when(F.col("doc_id") % 3 == 0, "1.").otherwise("1.0."), F.col("doc_id").cast("string")).alias("version"))
    return st.schema_issues(d, F.col("doc_id").cast("string"), ("source",), ("text",), ("title",), ("lang",), ("version",))


# --- gates ------------------------------------------------------------------------------------------------------------

_GATES_SQL = with_tables("").rstrip() + """, b AS (SELECT c_custkey AS book_id, '1.' || (c_custkey % 4) || '.0' AS version, c_custkey % 4 AS minor,
  list_filter([CASE WHEN c_custkey % 3 = 0 THEN 'source.edition' END, CASE WHEN c_custkey % 5 = 0 THEN 'license.id' END, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 7 = 0 THEN 'title.gu' END], lambda x: x IS NOT NULL) AS unknown FROM customer),
r AS (SELECT c_custkey AS book_id, m AS minor FROM customer, (SELECT unnest(range(3)) AS m) WHERE c_custkey % 3 = 1 AND m <= c_custkey % 5), l AS (SELECT book_id, max(minor) AS last FROM r GROUP BY 1)"""


def _books(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Books with their versions and unknown fields, releases, and releases that can't be read."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book_id"))
    k = F.col("book_id")
    version = lambda m: F.concat(F.lit("1."), m.cast("string"), F.lit(".0"))
    known = lambda cond: F.when(cond, "unknown").otherwise("known")
    unknown = pk.unknown_fields(F.when(k % 6 != 0, known(k % 3 == 0)), known(k % 5 == 0), F.when(k % 2 == 0, "gujr").otherwise("deva"), F.when(k % 7 != 0, "title"))
    books = c.select("book_id", version(k % 4).alias("version"), unknown.alias("unknown"))
    releases = c.where("book_id % 3 = 1").select("book_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("m")).where("m <= book_id % 5").select("book_id", version(F.col("m")).alias("content_version"))
    return books, releases, releases.where("book_id % 11 = 0")


@query(
    _GATES_SQL
    + """, n AS (SELECT book_id, count(*) AS n, count(*) FILTER (status = 'approved') AS ok, count(*) FILTER (status = 'proofed') AS proofed, count(*) FILTER (status = 'raw') AS raw FROM verses WHERE NOT orphaned GROUP BY 1)
SELECT b.book_id, 'no-passages' AS code, '' AS detail FROM b WHERE book_id NOT IN (SELECT book_id FROM n) UNION ALL SELECT book_id, 'not-approved', 'proofed ' || proofed || ' raw ' || raw FROM n WHERE ok < n AND book_id IN (SELECT book_id FROM b)
UNION ALL SELECT book_id, 'still-unknown', unnest(unknown) FROM b UNION ALL SELECT book_id, 'package-exists', version FROM b WHERE book_id % 8 = 0
UNION ALL SELECT b.book_id, 'version-not-newer', '1.' || last || '.0' FROM b JOIN l ON l.book_id = b.book_id WHERE minor <= last UNION ALL SELECT book_id, 'release-unreadable', '1.' || last || '.0' FROM l WHERE book_id % 11 = 0"""
)
def export_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps books from being exported."""
    books, releases, unreadable = _books(spark, sf_dir)
    return pk.export_gates(books, verses(spark, sf_dir), releases, books.where("book_id % 8 = 0").select("book_id", "version"), unreadable)


@query(
    _GATES_SQL
    + """, c AS (SELECT *, CASE WHEN book_id % 10 <> 0 THEN CASE WHEN book_id % 9 = 0 THEN 'other' ELSE book_id::VARCHAR END END AS pid, CASE WHEN book_id % 4 = 3 THEN '9.9.9' ELSE version END AS pv, CASE WHEN book_id % 13 = 0 THEN 'draft' ELSE 'proofed' END AS ps FROM b)
SELECT book_id, 'package-unreadable' AS code, version AS detail FROM c WHERE pid IS NULL UNION ALL SELECT book_id, 'package-of-another-book', pid FROM c WHERE pid = 'other' UNION ALL SELECT book_id, 'package-version-differs', pv FROM c WHERE pid IS NOT NULL AND pv <> version
UNION ALL SELECT book_id, 'package-not-proofed', ps FROM c WHERE pid IS NOT NULL AND ps <> 'proofed' UNION ALL SELECT c.book_id, 'version-released', version FROM c JOIN r ON r.book_id = c.book_id AND r.minor = c.minor WHERE pid IS NOT NULL
UNION ALL SELECT c.book_id, 'release-unreadable', '1.' || last || '.0' FROM c JOIN l ON l.book_id = c.book_id WHERE pid IS NOT NULL AND c.book_id % 11 = 0 UNION ALL SELECT book_id, 'release-ref-dropped', 'r' || book_id FROM c WHERE pid IS NOT NULL AND book_id % 17 = 0"""
)
def publish_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps packages from being published."""
    books, releases, unreadable = _books(spark, sf_dir)
    k = F.col("book_id")
    pid = F.when(k % 10 != 0, F.when(k % 9 == 0, "other").otherwise(k.cast("string")))
    c = books.select("book_id", "version", pid.alias("package_id"), F.when(k % 4 == 3, "9.9.9").otherwise(F.col("version")).alias("package_version"), F.when(k % 13 == 0, "draft").otherwise("proofed").alias("package_status"))
    audits = books.where("book_id % 17 = 0").select("book_id", F.lit("error").alias("severity"), F.lit("release-ref-dropped").alias("code"), F.concat(F.lit("r"), k.cast("string")).alias("path"))
    audits = audits.unionByName(books.select("book_id", F.lit("warning").alias("severity"), F.lit("release-content-unchanged").alias("code"), F.lit("x").alias("path")))
    return pk.publish_gates(c, releases, unreadable, audits)

"""Blocks to passages: routing, splitting at printed numbers, joining fragments, flags and confidence.

A section begins at a heading or after an end marker, a passage ends at a printed number (``passage_scan``: a book is read
in chunks of pages, by as many tasks as it has chunks). A number in the script of a quotation ends a passage only where it
stands directly behind another one and goes on from the last number. A section without a heading has the title that the
running heads of its pages agree on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scripts as s
from ..functions import text as t
from ..sources.shared import materialize
from .passage_scan import scan
from .sequence import number_flags, titles_from_heads

#: Block tags by what they mean, words that close a work, and the penalty of each flag.
FURNITURE, NOTES, NO_TEXT = ("header", "page-number", "folio"), ("footer", "footnote"), ("image", "photograph", "chart", "diagram", "advertisement")
HEADINGS = ("section-title", "section-header", "chapter-title", "title", "headline", "heading", "subtitle")
COMPLETION = ("સમાપ્ત", "समाप्त", "સંપૂર્ણ", "संपूर्ण", "ઇતિ", "इति")
PENALTY = {"orthography": 0.4, "no-number": 0.35, "duplicate-number": 0.3, "out-of-sequence": 0.3, "recovered-number": 0.2, "very-short": 0.15, "spans-pages": 0.1, "hyphen-join": 0.05, "contains-quotation": 0.05}
SHORT = 40

def admitted_scripts(language: str) -> list[str]:
    primary = s.LANGUAGE_SCRIPT.get(language.split("-")[0].lower())
    if primary is None:
        return []
    return [primary] if primary in ("latn", "deva") else [primary, "deva"]


def route(tag: Column, text: Column, admitted: list[str]) -> Column:
    """Where a block goes: dropped, set-aside, notes or body; the order of the rules matters."""
    return _route(tag, text, t.script_profile(text), admitted)


def _route(tag: Column, text: Column, p: Column, admitted: list[str]) -> Column:
    foreign = F.lit(False) if not admitted else (p["total"] > 0) & ~F.coalesce(p["dominant"].isin(*admitted), F.lit(False))
    return F.when(F.trim(text) == "", "dropped").when(tag.isin(*FURNITURE, *NO_TEXT) | foreign, "set-aside").when(tag.isin(*NOTES), "notes").otherwise("body")


def is_end_marker(text: Column) -> Column:
    x = F.trim(text)
    words = F.lit(False)
    for w in COMPLETION:
        words = words | F.contains(x, F.lit(w))
    return F.startswith(x, F.lit("॥")) & F.endswith(x, F.lit("॥")) & words


def printed_page(tag: Column, text: Column, script: str) -> Column:
    """(rank, number) of a block that carries the page number in the script's digits, else null."""
    found = F.regexp_extract(text, f"{s.ANY_DIGIT}+", 0)
    number = t.parse_number(found)
    rank = F.when(tag == "page-number", 0).when(tag == "folio", 1).when(tag == "header", 2)
    return F.when(rank.isNotNull() & (number["script"] == script), F.struct(rank.alias("rank"), number["value"].alias("number")))


def body_blocks(blocks: DataFrame, script: str, admitted: list[str]) -> DataFrame:
    """(book, page, pos, kind, quotation, text) of the blocks of the body: kind is heading, end or text."""

    def placed(p: Column) -> Column:
        return F.struct(_route(F.col("tag"), F.col("text"), p, admitted).alias("bucket"), F.coalesce(p["dominant"] != script, F.lit(False)).alias("quotation"))

    # The profile of a block is taken once: what decides about the block is generated from it, not put into filters.
    places = F.transform(F.array(t.script_profile(F.col("text"))), placed)
    b = blocks.select("book", "page", "pos", "tag", "text", F.explode(F.filter(places, lambda x: x["bucket"] == "body")).alias("_place")).withColumn("quotation", F.col("_place.quotation"))
    kind = F.when(F.col("tag").isin(*HEADINGS) & ~F.col("quotation"), "heading").when(is_end_marker(F.col("text")), "end").otherwise("text")
    return b.select("book", "page", "pos", kind.alias("kind"), "quotation", "text")


def segment_book(blocks: DataFrame, script: str, admitted: list[str], form: str = "prose", short: int = SHORT) -> tuple[DataFrame, DataFrame]:
    """Passages and sections of blocks (book, page, pos, tag, text).

    Passages: (book, section, pos, number, text, form, pages, fragments, flags, confidence); prose has its printed lines
    joined. Sections, numbered from 1: (book, section, title, title_source, end_marker, passages); the source of a title is
    heading or running-head.
    """
    body = materialize(body_blocks(blocks, script, admitted), "blocks")
    pieces = materialize(scan(body, script), "pieces")
    quotes = body.where("quotation").select("book", "page", "pos", F.lit(True).alias("quotation"))
    texts = pieces.where("kind = 'text'").join(quotes, ["book", "page", "pos"], "left").withColumn("quotation", F.coalesce("quotation", F.lit(False)))
    # Pieces that stand on one page, or beside a quotation, are paragraphs; over a page's end a paragraph goes on.
    def apart(x: Column, i: Column) -> Column:
        before = F.get(F.col("f"), i - 1)
        return F.concat(F.when(i == 0, "").when(x["quotation"] | before["quotation"] | (x["page"] == before["page"]), "\n\n").otherwise("\n"), x["text"])

    grouped = texts.groupBy("book", F.col("section").alias("_section"), F.col("start").alias("at")).agg(
        F.array_sort(F.collect_list(F.struct("page", "pos", "k", "quotation", "text"))).alias("f"),
        F.max("value").alias("number"),
        F.bool_or("quotation").alias("quotation"),
        F.bool_or("recovered").alias("recovered"),
    )
    grouped = grouped.withColumn("t", F.transform("f", apart))
    found = pieces.where("kind <> 'text'").select(
        "book", F.col("section").alias("_section"), F.when(F.col("kind") == "heading", F.col("text")).alias("title"), F.when(F.col("kind") == "end", F.col("text")).alias("end_marker"), F.lit(0).alias("n")
    )
    found = found.unionByName(grouped.groupBy("book", "_section").agg(F.count("*").cast("int").alias("n")).select("book", "_section", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("end_marker"), "n"))
    found = found.groupBy("book", "_section").agg(F.max("title").alias("title"), F.max("end_marker").alias("end_marker"), F.sum("n").alias("passages"))
    found = materialize(found.withColumn("section", F.row_number().over(Window.partitionBy("book").orderBy("_section")).cast("long")), "sections")
    passages = materialize(_passages(grouped.join(found.select("book", "_section", "section"), ["book", "_section"]), script, form, short), "passages")
    heads = blocks.where(F.col("tag") == "header").select("book", "page", F.explode(t.running_head_lines(F.col("text"), script)).alias("head"))
    untitled = found.where("title IS NULL").select("book", "section")
    named = titles_from_heads(passages.join(untitled, ["book", "section"], "left_semi").select("book", "section", "pages"), heads).withColumnRenamed("title", "head")
    sections = found.join(named, ["book", "section"], "left").select(
        "book", "section", F.coalesce(_clean(F.col("title"), script, True), "head").alias("title"),
        F.when(F.col("title").isNotNull(), "heading").when(F.col("head").isNotNull(), "running-head").alias("title_source"), "end_marker", "passages",
    )
    return passages, sections


def segment(blocks: DataFrame, script: str, admitted: list[str], form: str = "prose") -> DataFrame:
    """The passages of ``segment_book``."""
    return segment_book(blocks, script, admitted, form)[0]


def _clean(raw: Column, script: str, join: bool) -> Column:
    return t.join_lines(t.clean_characters(raw)["text"], join)


def _passages(grouped: DataFrame, script: str, form: str, short: int) -> DataFrame:
    raw = F.array_join("t", "")
    out = grouped.select("book", "section", "quotation", "recovered", "at", raw.alias("raw"), "number", F.array_distinct(F.transform("f", lambda x: x["page"])).alias("pages"), F.size("f").cast("long").alias("fragments"))
    joined = _clean(F.col("raw"), script, form == "prose")
    clean = t.strip_footnotes(t.reorder_matras(joined, script), script)["text"] if script in s.PRE_BASE_MATRA else joined
    out = out.withColumn("text", clean).withColumn("hyphen", F.lit(form == "prose") & F.regexp_like("raw", F.lit("[-­‐]\\s*\n\\s*\\S"))).withColumn("faults", t.orthography(F.col("text"), script)["violations"])
    rank = F.row_number().over(Window.partitionBy("book").orderBy("at"))
    out = number_flags(out.withColumn("pos", rank).withColumn("division", F.col("section"))).drop("division")
    flags = {
        "no-number": F.col("number").isNull(), "duplicate-number": F.col("duplicate_number"), "out-of-sequence": F.col("out_of_sequence"), "orthography": F.col("faults") > 0,
        "spans-pages": F.size("pages") > 1, "hyphen-join": F.col("hyphen"), "very-short": F.length("text") < short, "contains-quotation": F.col("quotation"),
        "recovered-number": F.col("recovered"),
    }
    penalty = sum((F.when(c, F.lit(PENALTY[f])).otherwise(0.0) for f, c in flags.items()), F.lit(0.0))
    return out.select(
        "book", "section", "pos", "number", "text", F.lit(form).alias("form"), "pages", "fragments",
        F.filter(F.array(*(F.when(c, F.lit(f)) for f, c in flags.items())), lambda x: x.isNotNull()).alias("flags"),
        F.greatest(F.lit(0.0), F.floor((1 - penalty) * 100 + 0.5) / 100).alias("confidence"),
    )

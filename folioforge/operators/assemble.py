"""Packages out of segmented books: documents, the evidence of each verse, and a report for whoever proofs them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scripts as s
from ..functions import text as t
from .documents import build_structures
from .sequence import unique_ids

#: What stands where only a person knows, and the labels of the first layer.
UNKNOWN, LABELS = "unknown", {"gu": "મૂળ", "en": "Original"}
NEEDS = {"source": "source.edition — which printed edition this is", "license": "license.id — whether we have the rights to publish it", "title": "title.gu — the book's title as it is printed"}


def default_metadata(books: DataFrame, language: str = "gu") -> DataFrame:
    """(book, title, language, script, content_version, edition, license, layer, label) of books (book) of which nothing is known but their names."""
    script = "gujr" if language.startswith("gu") else "deva"
    return books.select(
        "book", F.create_map(F.lit("en"), F.replace(F.col("book"), F.lit("-"), F.lit(" "))).alias("title"), F.lit(language).alias("language"), F.lit(script).alias("script"), F.lit("0.1.0").alias("content_version"),
        F.lit(UNKNOWN).alias("edition"), F.lit(UNKNOWN).alias("license"), F.lit(language.split("-")[0]).alias("layer"), F.create_map(*(F.lit(x) for p in LABELS.items() for x in p)).alias("label"),
    )


def named_passages(passages: DataFrame) -> DataFrame:
    """Passages (book, section, pos, number, pages, …) with the ids of their division and verse and their place in the section.

    A verse is named by its number, else by its first page (or section, from 0) and its place (from 1).
    """
    place = F.row_number().over(Window.partitionBy("book", "section").orderBy("pos"))
    page = F.coalesce(F.get("pages", F.lit(0)).cast("long"), F.col("section") - 1)
    natural = F.when(F.col("number").isNotNull(), F.concat(F.lit("v"), F.col("number").cast("string"))).otherwise(F.concat(F.lit("p"), page.cast("string"), F.lit("-"), F.col("_place").cast("string")))
    rows = passages.withColumn("_place", place).withColumn("_id", natural)
    rows = unique_ids(rows, ["book", "section"], "_id", ["pos"]).withColumn("division_id", F.concat(F.lit("section-"), F.col("section").cast("string")))
    return rows.withColumn("ordinal", (F.col("_place") - 1).cast("long")).withColumn("verse_id", F.col("unique_id")).drop("_place", "_id", "unique_id")


def _units(named: DataFrame, sections: DataFrame, metadata: DataFrame) -> DataFrame:
    m = metadata.select("book", "language", "script", "layer")
    division = F.concat(F.lit("section-"), F.col("section").cast("string"))
    d = sections.join(m, "book").select(
        F.col("book").alias("doc"), F.concat_ws("/", "book", division).alias("ref"), F.col("book").alias("parent_ref"), F.col("section").cast("long").alias("place"), F.lit(1).alias("depth"), F.lit("section").alias("kind"),
        division.alias("id"), F.lit(None).cast("string").alias("number"), F.to_json(F.when(F.col("title").isNotNull(), F.create_map("language", "title"))).alias("title"), F.lit(None).cast("string").alias("form"),
        F.lit(None).cast("string").alias("layers"), F.lit(None).cast("map<string,string>").alias("values"),
    )
    layers = F.create_map("layer", "text")
    own = F.concat_ws("/", "book", "division_id")
    v = named.join(m, "book").select(
        F.col("book").alias("doc"), F.concat(own, F.lit("#"), F.col("verse_id")).alias("ref"), own.alias("parent_ref"), F.col("ordinal").alias("place"), F.lit(2).alias("depth"), F.lit("verse").alias("kind"), F.col("verse_id").alias("id"),
        _printed(F.col("number"), F.col("script")).alias("number"), F.lit(None).cast("string").alias("title"), "form", F.to_json(layers).alias("layers"), layers.alias("values"),
    )
    return d.unionByName(v)


def _printed(number: Column, script: Column) -> Column:
    """A number in the digits of a book's script."""
    out = number.cast("string")
    for k in s.DIGITS:
        out = F.when(script == k, t.format_number(number, k)).otherwise(out)
    return out


def packages(passages: DataFrame, sections: DataFrame, metadata: DataFrame, manifests: DataFrame) -> DataFrame:
    """(book, document, verses): draft packages of segmented books; sections without passages aren't in them.

    passages, sections: of ``segment_book``; metadata: as ``default_metadata`` has it; manifests: (book, source, sha256, engine).
    """
    built = build_structures(_units(named_passages(passages), sections, metadata))
    note = F.concat(F.lit("Assembled from "), "source", F.lit(" (SHA-256 "), "sha256", F.lit(") via "), "engine", F.lit(". Not yet proofed."))
    layer = F.struct(F.col("layer").alias("id"), F.lit("original").alias("kind"), "language", "script", "label")
    head = F.to_json(
        F.struct(
            F.lit(1).alias("formatVersion"), F.col("book").alias("id"), "title", "language", "script", F.col("content_version").alias("contentVersion"), F.lit("draft").alias("contentStatus"),
            F.struct(F.col("edition").alias("edition"), note.alias("notes")).alias("source"), F.struct(F.col("license").alias("id")).alias("license"), F.array(layer).alias("layers"), F.col("layer").alias("primaryLayer"),
        )
    )
    rows = metadata.join(manifests, "book").withColumn("_head", head).join(built.withColumnRenamed("doc", "book"), "book")
    return rows.select("book", F.concat(F.regexp_replace("_head", "\\}$", ""), F.lit(',"structure":'), "structure", F.lit("}")).alias("document"), "verses")


def evidence(passages: DataFrame, printed: DataFrame) -> DataFrame:
    """(book, ref, number, confidence, flags, chars, pages, printed_pages) of each verse, to be proofed from the least confidence on.

    printed: (book, page, printed) of pages that print their number.
    """
    named = named_passages(passages).withColumn("ref", F.concat(F.concat_ws("/", "book", "division_id"), F.lit("#"), F.col("verse_id")))
    pages = named.select("book", "ref", F.posexplode("pages").alias("k", "page")).join(printed, ["book", "page"], "left")
    pages = pages.groupBy("book", "ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "printed"))), lambda x: x["printed"]).alias("printed_pages"))
    return named.join(pages, ["book", "ref"], "left").select("book", "ref", "number", "confidence", "flags", F.length("text").cast("long").alias("chars"), "pages", F.coalesce("printed_pages", F.array().cast("array<bigint>")).alias("printed_pages"))


def report(passages: DataFrame, sections: DataFrame, blocks: DataFrame, metadata: DataFrame, script: str, bucket: Column) -> DataFrame:
    """(book, sections, verses, numbered, notes, set_aside, needs_human, running_heads): one row for each book of the metadata.

    blocks: (book, page, tag, text), where ``bucket`` (of ``segment.route``) tells what became of each; ``running_heads`` are
    (text, pages) of the header lines set aside, the commonest first.
    """
    full = sections.where("passages > 0").groupBy("book").agg(F.count("*").alias("sections"))
    verses = passages.groupBy("book").agg(F.count("*").alias("verses"), F.count("number").alias("numbered"))
    routed = blocks.withColumn("_bucket", bucket)
    counts = routed.groupBy("book").agg(F.count_if(F.col("_bucket") == "notes").alias("notes"), F.count_if(F.col("_bucket") == "set-aside").alias("set_aside"))
    heads = routed.where("_bucket = 'set-aside' AND tag = 'header'").select("book", F.explode(t.running_head_lines(F.col("text"), script)).alias("text"))
    heads = heads.groupBy("book", "text").agg(F.count("*").alias("pages")).groupBy("book").agg(F.array_sort(F.collect_list(F.struct((-F.col("pages")).alias("n"), "text"))).alias("h"))
    heads = heads.select("book", F.transform("h", lambda x: F.struct(x["text"].alias("text"), (-x["n"]).alias("pages"))).alias("running_heads"))
    missing = F.array(
        F.when(F.col("edition") == UNKNOWN, NEEDS["source"]), F.when(F.col("license") == UNKNOWN, NEEDS["license"]),
        F.when((F.col("script") == "gujr") & ~F.map_contains_key("title", "gu"), NEEDS["title"]),
    )
    out = metadata.select("book", F.filter(missing, lambda x: x.isNotNull()).alias("needs_human"))
    for part in (full, verses, counts, heads):
        out = out.join(part, "book", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("sections", "verses", "numbered", "notes", "set_aside")]
    return out.select("book", *zero, "needs_human", F.coalesce("running_heads", F.array().cast("array<struct<text:string,pages:bigint>>")).alias("running_heads"))


def patch_divisions(divisions: DataFrame, patches: DataFrame) -> DataFrame:
    """Divisions (book_id, id, number, title map, …) after patches (book_id, id, number, title, sets_number): a title is put in place of the old one, a number (also null) where ``sets_number`` says so."""
    p = patches.select("book_id", "id", F.col("number").alias("_n"), F.col("title").alias("_t"), F.col("sets_number").alias("_s"))
    j = divisions.join(p, ["book_id", "id"], "left")
    return j.withColumn("number", F.when(F.coalesce("_s", F.lit(False)), F.col("_n")).otherwise(F.col("number"))).withColumn("title", F.coalesce("_t", "title")).select(divisions.columns)

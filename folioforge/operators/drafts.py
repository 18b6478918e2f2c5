"""Drafts: what a reading run left, the package and its evidence as rows, import revisions, and reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from ..functions.refs import verse_hash
from .sequence import check_sequence, unique_ids


def division_key(path: Column) -> Column:
    """The key of a division by its path of ids; the top level has the empty key."""
    return F.array_join(path, "/")


def ref_of(book: Column, division: Column, verse: Column) -> Column:
    """The ref of a verse by the key of its division."""
    return F.concat(F.when(division == "", book).otherwise(F.concat_ws("/", book, division)), F.lit("#"), verse)


def unreadable_pages(manifest: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Pages of a run's manifest of which no blocks could be read."""
    return manifest.select(*keys).join(pages.select(*keys), keys, "left_anti")


def list_drafts(packages: DataFrame, reports: DataFrame, manifests: DataFrame) -> DataFrame:
    """Drafts (dir, book_id, title, verses, source_sha256, has_pages) with a readable package and report, by book id.

    packages: (dir, book_id, title map) and reports: (dir, verses, source_sha256), null book or source where a file can't
    be read; manifests: (source_sha256) of rendered pages.
    """
    rows = packages.where("book_id IS NOT NULL").join(reports.where("source_sha256 IS NOT NULL"), "dir")
    have = manifests.select("source_sha256").distinct().withColumn("_pages", F.lit(True))
    title = F.coalesce(F.try_element_at("title", F.lit("gu")), F.try_element_at("title", F.lit("en")), F.col("book_id"))
    j = rows.join(have, "source_sha256", "left")
    return j.select("dir", "book_id", title.alias("title"), "verses", "source_sha256", F.coalesce("_pages", F.lit(False)).alias("has_pages")).orderBy("book_id", "dir")


def flatten_draft(units: DataFrame, primary: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(divisions, verses) of flattened books: places in reading order, and each verse with the evidence of its ref.

    primary: (book_id, layer_id); evidence: (ref, …).
    """
    path = F.split(F.regexp_replace(F.regexp_replace("ref", "#.*$", ""), "^[^/#]*/?", ""), "/")
    key = division_key(path)
    order = Window.partitionBy("book_id").orderBy("ord")
    d = units.where("kind <> 'verse'").select("book_id", key.alias("id"), F.when(F.size(path) > 1, division_key(F.slice(path, F.lit(1), F.size(path) - 1))).alias("parent_id"), (F.row_number().over(order) - 1).cast("long").alias("ordinal"), "kind", "number", "title")
    v = units.where("kind = 'verse'").join(primary, "book_id").withColumn("division_id", key)
    own = Window.partitionBy("book_id", "division_id").orderBy("ord")
    text = F.when(~F.array_contains("gloss_layers", F.col("layer_id")), F.try_element_at("layers", F.col("layer_id")))
    v = v.select("book_id", "division_id", "id", (F.row_number().over(own) - 1).cast("long").alias("ordinal"), "number", "form", F.coalesce(text, F.lit("")).alias("text"), ref_of(F.col("book_id"), F.col("division_id"), F.col("id")).alias("ref"))
    return d, v.join(evidence, "ref", "left").drop("ref")


def import_revisions(merged: DataFrame) -> DataFrame:
    """The revision rows of an import: a new verse as it came in, a touched one whose reading changed as it stands, back to raw."""
    note = F.when(F.col("action") == "reset", "The reading has changed: back to raw for a second look.")
    rows = merged.where(F.col("action").isin("inserted", "reset"))
    return rows.select("book_id", "division_id", "id", F.when(F.col("action") == "inserted", "import").otherwise("reimport").alias("action"), "text", F.lit("raw").alias("status"), "number", note.alias("note"))


def import_summary(merged: DataFrame) -> DataFrame:
    """One row for each book: verses inserted, refreshed, reset, orphaned and restored by an import."""
    return merged.groupBy("book_id").agg(*(F.count_if(F.col("action") == a).alias(a) for a in ("inserted", "refreshed", "reset", "orphaned")), F.count_if("restored").alias("restored"))


def ordered_structure(divisions: DataFrame, verses: DataFrame) -> DataFrame:
    """The verses of known divisions that aren't orphaned, with their place in the book."""
    d = divisions.select("book_id", F.col("id").alias("division_id"), F.col("ordinal").alias("_d"))
    w = Window.partitionBy("book_id").orderBy("_d", "ordinal")
    return verses.where(~F.col("orphaned")).join(d, ["book_id", "division_id"]).withColumn("place", (F.row_number().over(w) - 1).cast("long")).drop("_d")


def printed_sequence(rows: DataFrame) -> DataFrame:
    """``check_sequence`` over numbers as they are printed, in any script (book, division, pos, printed); what is no number is left out."""
    return check_sequence(rows.select("book", "division", "pos", t.parse_number(F.col("printed"))["value"].alias("number")))


def worst_first(verses: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds place: verses of a report by confidence, equal ones in their order."""
    w = Window.partitionBy(*keys).orderBy(F.col("confidence").asc_nulls_last(), order)
    return verses.withColumn("place", (F.row_number().over(w) - 1).cast("long"))


def worst_pages(pages: DataFrame, keys: list[str], score: str, most: int = 5) -> DataFrame:
    """The pages of each run with the highest rate of faults (a top list)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), "page")
    return pages.where(F.col(score) > 0).withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most)


def describe_violation(kind: Column, sample: Column) -> Column:
    """An orthographic fault in words."""
    said = {
        "adjacent-vowel-signs": "two vowel signs in a row",
        "vowel-sign-without-base": "a vowel sign without a consonant",
        "virama-before-vowel-sign": "a virama before a vowel sign",
        "virama-without-base": "a virama without a consonant",
        "no-pre-base-matra": "no pre-base vowel sign in the whole text",
    }
    out = F.lit(None).cast("string")
    for k, words in said.items():
        out = F.when(kind == k, F.concat(F.lit(f"{words} ("), sample, F.lit(")"))).otherwise(out)
    return out


def context_around(text: Column, at: Column, width: int = 8) -> Column:
    """The characters around a place (from 0): ``width`` before it and as many from it on."""
    start = F.greatest(at - width, F.lit(0))
    return F.substr(text, start + 1, at + width - start)


def json_pointer(path: Column) -> Column:
    """A path of keys as a pointer; the empty one is ``/``."""
    return F.concat(F.lit("/"), F.array_join(path, "/"))


def reparsed(value: Column, schema: str) -> Column:
    """A JSON text of the schema, parsed; one that was encoded twice (a text that holds JSON) is parsed twice."""
    twice = F.get(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>"), F.lit(0))
    return F.from_json(F.when(F.startswith(F.ltrim(value), F.lit('"')), twice).otherwise(value), schema)


def content_hash(recorded: Column, layers: Column) -> Column:
    """The hash recorded for a verse, else that of its layers."""
    return F.coalesce(recorded, verse_hash(layers))


def replace_pages(pages: DataFrame, new: DataFrame) -> DataFrame:
    """Pages after an import: those of the books that came in are replaced whole."""
    return pages.join(new.select("book_id").distinct(), "book_id", "left_anti").unionByName(new)


def patch_notes(notes: DataFrame, patches: DataFrame) -> DataFrame:
    """Notes (book_id, page, block_id, text, status, …) after patches of text and status (null: leave)."""
    keys = ["book_id", "page", "block_id"]
    j = notes.join(patches.select(*keys, F.col("text").alias("_t"), F.col("status").alias("_s")), keys, "left")
    return j.withColumn("text", F.coalesce("_t", "text")).withColumn("status", F.coalesce("_s", "status")).select(notes.columns)


def resolve_set_aside(blocks: DataFrame, marks: DataFrame) -> DataFrame:
    """Blocks set aside after marks (book_id, page, block_id, resolved)."""
    keys = ["book_id", "page", "block_id"]
    j = blocks.join(marks.select(*keys, F.col("resolved").alias("_r")), keys, "left")
    return j.withColumn("resolved", F.coalesce("_r", "resolved")).select(blocks.columns)


def assemble_units(passages: DataFrame, layer: str) -> DataFrame:
    """Units of a package from passages (book, section, pos, number, text, pages): sections in order, verses with unique ids, layers and hashes.

    A verse is named by its number, else by its first page (or its section, where none is known) and its place.
    """
    sections = passages.select("book", "section").distinct().withColumn("_s", F.row_number().over(Window.partitionBy("book").orderBy("section")))
    own = Window.partitionBy("book", "section").orderBy("pos")
    v = passages.join(sections, ["book", "section"]).withColumn("_k", F.row_number().over(own))
    page = F.coalesce(F.get("pages", F.lit(0)).cast("long"), (F.col("_s") - 1).cast("long"))
    natural = F.when(F.col("number").isNotNull(), F.concat(F.lit("v"), F.col("number").cast("string"))).otherwise(F.concat(F.lit("p"), page.cast("string"), F.lit("-"), F.col("_k").cast("string")))
    v = unique_ids(v.withColumn("_id", natural), ["book", "section"], "_id", ["pos"])
    layers = F.create_map(F.lit(layer), F.col("text"))
    id_ = F.col("unique_id")
    division = F.concat(F.lit("section-"), F.col("_s").cast("string"))
    return v.select(
        "book", division.alias("division_id"), id_.alias("id"), (F.col("_k") - 1).cast("long").alias("ordinal"), "number", layers.alias("layers"), verse_hash(layers).alias("hash"),
        ref_of(F.col("book").cast("string"), division, id_).alias("ref"), F.length("text").cast("long").alias("chars"),
    )

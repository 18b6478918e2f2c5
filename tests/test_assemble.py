"""Packages, evidence and reports of a segmented book, and patches of divisions."""

import json

from pyspark.sql import functions as F

from folioforge.operators import assemble as a
from folioforge.operators import documents as d
from folioforge.operators import segment as seg

TEXT = "પહેલો ફકરો જે પૂરતો લાંબો છે કે ટૂંકો ન ગણાય તેવો છે"


def book(spark):
    b = [
        ("own-book", 1, 0, "header", "૧ ગ્રંથ નામ"), ("own-book", 1, 1, "paragraph", f"{TEXT} ॥૧॥"), ("own-book", 1, 2, "paragraph", f"{TEXT} ॥૧॥"), ("own-book", 1, 3, "footnote", "૧. નોંધ"),
        ("own-book", 2, 0, "section-title", "ખાલી"), ("own-book", 2, 1, "section-title", "બીજો"), ("own-book", 2, 2, "header", "ગ્રંથ નામ ૨\nભાગ"), ("own-book", 2, 3, "paragraph", TEXT), ("own-book", 3, 0, "paragraph", f"{TEXT} ॥૨॥"),
        ("own-book", 3, 1, "paragraph", TEXT), ("own-book", 3, 2, "image", "x"),
    ]
    blocks = spark.createDataFrame(b, "book string, page int, pos int, tag string, text string")
    return blocks, *seg.segment_book(blocks, "gujr", ["gujr", "deva"])


def test_a_segmented_book_becomes_a_valid_package(spark):
    blocks, passages, sections = book(spark)
    metadata = a.default_metadata(spark.createDataFrame([("own-book",)], "book string"))
    manifests = spark.createDataFrame([("own-book", "x.pdf", "aa", "engine-1")], "book string, source string, sha256 string, engine string")
    out = a.packages(passages, sections, metadata, manifests)
    row = out.first()
    package = json.loads(row["document"])
    assert d.validate_books(out, "book").count() == 0 and row["verses"] == 4
    assert [(u["id"], u.get("title"), [(v["id"], v.get("number")) for v in u["children"]]) for u in package["structure"]] == [
        ("section-1", None, [("v1", "૧"), ("v1-2", "૧")]), ("section-3", {"gu": "બીજો"}, [("v2", "૨"), ("p3-2", None)]),
    ]
    assert (package["source"]["edition"], package["source"]["notes"], package["contentStatus"], package["title"]) == ("unknown", "Assembled from x.pdf (SHA-256 aa) via engine-1. Not yet proofed.", "draft", {"en": "own book"})
    printed = spark.createDataFrame([("own-book", 2, 7)], "book string, page int, printed long")
    proofs = {r["ref"]: r for r in a.evidence(passages, printed).collect()}
    assert proofs["own-book/section-3#v2"]["pages"] == [2, 3] and proofs["own-book/section-3#v2"]["printed_pages"] == [7, None]
    assert "duplicate-number" in proofs["own-book/section-1#v1-2"]["flags"] and proofs["own-book/section-3#p3-2"]["number"] is None
    bucket = seg.route(F.col("tag"), F.col("text"), ["gujr", "deva"])
    r = a.report(passages, sections, blocks, metadata, "gujr", bucket).first()
    assert (r["sections"], r["verses"], r["numbered"], r["notes"], r["set_aside"]) == (2, 4, 3, 1, 3)
    assert [tuple(h) for h in r["running_heads"]] == [("ગ્રંથ નામ", 2), ("ભાગ", 1)] and len(r["needs_human"]) == 3
    known = metadata.withColumn("edition", F.lit("first")).withColumn("title", F.create_map(F.lit("gu"), F.lit("ક")))
    assert a.report(passages.limit(0), sections.limit(0), blocks.limit(0), known, "gujr", bucket).first()["needs_human"] == [a.NEEDS["license"]]


def test_metadata_follows_the_language(spark):
    m = a.default_metadata(spark.createDataFrame([("a-b-c",)], "book string"), "sa-IN").first()
    assert (m["title"], m["script"], m["layer"], m["content_version"]) == ({"en": "a b c"}, "deva", "sa", "0.1.0")


def test_patches_of_divisions(spark):
    divisions = spark.createDataFrame([("b", "one", "1", {"gu": "ક"}), ("b", "two", "2", None), ("c", "one", None, {"en": "x"})], "book_id string, id string, number string, title map<string,string>")
    patches = spark.createDataFrame([("b", "one", None, None, True), ("b", "two", None, {"en": "T"}, False), ("c", "gone", "9", None, True)], "book_id string, id string, number string, title map<string,string>, sets_number boolean")
    out = {(r["book_id"], r["id"]): (r["number"], r["title"]) for r in a.patch_divisions(divisions, patches).collect()}
    assert out == {("b", "one"): (None, {"gu": "ક"}), ("b", "two"): ("2", {"en": "T"}), ("c", "one"): (None, {"en": "x"})}

"""Packages and metadata on small tables."""

from pyspark.sql import functions as F

from folioforge.operators import packages as p


def test_localized_and_merged(spark):
    df = spark.createDataFrame([([("en", "E"), ("gu-IN", "G")], "gu"), ([("en", "E")], "fr"), ([("en-GB", "B"), ("en", "E")], "en")], "t array<struct<tag:string,text:string>>, tag string")
    assert [r[0] for r in df.select(p.pick_localized(F.col("t"), F.col("tag"))).collect()] == ["G", "E", "E"]
    one = spark.range(1).select(*p.merge_metadata({"a": F.lit("1"), "b": F.lit("2")}, {"b": F.lit(None).cast("string"), "a": F.lit("3")})).first()
    assert (one["a"], one["b"]) == ("3", "2")
    patched = spark.range(1).select(p.patch_map(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(9), F.lit("c"), F.lit(3))).alias("m")).first()["m"]
    assert patched == {"a": 1, "b": 9, "c": 3}
    need = lambda *c: spark.range(1).select(p.unknown_fields(*(F.lit(x).cast("string") for x in c))).first()[0]
    assert need("unknown", None, "gujr", None) == ["source.edition", "license.id", "title.gu"] and need("first", "cc0", "deva", None) == []


def test_pages_and_batches(spark):
    a = spark.createDataFrame([(1, None), (2, 7)], "page int, printed int")
    b = spark.createDataFrame([(1, 5), (2, 8), (3, None)], "page int, printed int")
    assert sorted((r["page"], r["printed"]) for r in p.printed_pages([a, b]).collect()) == [(1, 5), (2, 7), (3, None)]
    books = spark.createDataFrame([("b", "h"), ("c", "x")], "id string, source_sha256 string")
    found = p.find_pages(books, spark.createDataFrame([("d2", "h", 2), ("d1", "h", 1)], "dir string, source_sha256 string, scan_order int"))
    assert {r["id"]: r["pages_dir"] for r in found.collect()} == {"b": "d1", "c": None}
    n = p.batches(spark.range(23).select(F.lit(1).alias("b"), F.col("id").alias("page")), ["b"], "page").groupBy("batch").count()
    assert sorted(r["count"] for r in n.collect()) == [3, 10, 10]
    run = p.run_summary(spark.createDataFrame([(1, 1, 10, 0.5, None), (1, 2, 5, 0.2, None), (1, 3, None, None, "timeout")], "b int, page int, chars int, score double, error string"), ["b"]).first()
    assert (run["pages_read"], run["pages_failed"], run["chars"], run["worst_page"]) == (2, 1, 15, 2)


def gates(df):
    return sorted((r["book_id"], r["code"], r["detail"]) for r in df.collect())


def test_export_gates(spark):
    v = spark.createDataFrame([(1, "raw", False), (1, "proofed", False), (1, "approved", False), (1, "raw", True), (2, "approved", False), (3, "raw", True)], "book_id int, status string, orphaned boolean")
    books = spark.createDataFrame([(1, "1.1.0", ["license.id"]), (2, "1.10.0", []), (3, "1.0.0", [])], "book_id int, version string, unknown array<string>")
    releases = spark.createDataFrame([(1, "1.0.0"), (1, "1.1.0"), (2, "1.9.0"), (2, "1.2.0"), (3, "1.0.0")], "book_id int, content_version string")
    made = spark.createDataFrame([(1, "1.1.0")], "book_id int, version string")
    lost = spark.createDataFrame([(3, "1.0.0"), (2, "1.2.0")], "book_id int, content_version string")
    want = [(1, "not-approved", "proofed 1 raw 1"), (1, "package-exists", "1.1.0"), (1, "still-unknown", "license.id"), (1, "version-not-newer", "1.1.0"), (3, "no-passages", ""), (3, "release-unreadable", "1.0.0"), (3, "version-not-newer", "1.0.0")]
    assert gates(p.export_gates(books, v, releases, made, lost)) == want


def test_publish_gates(spark):
    c = spark.createDataFrame([("a", "1.0.0", "a", "1.0.0", "proofed"), ("b", "2.0.0", "x", "2.1.0", "draft"), ("c", "1.0.0", None, None, None)], "book_id string, version string, package_id string, package_version string, package_status string")
    releases = spark.createDataFrame([("a", "1.0.0")], "book_id string, content_version string")
    audits = spark.createDataFrame([("a", "error", "release-ref-dropped", "a#v1"), ("a", "warning", "release-content-unchanged", "/contentVersion"), ("c", "error", "x", "y")], "book_id string, severity string, code string, path string")
    want = [("a", "release-ref-dropped", "a#v1"), ("a", "release-unreadable", "1.0.0"), ("a", "version-released", "1.0.0"), ("b", "package-not-proofed", "draft"), ("b", "package-of-another-book", "x"), ("b", "package-version-differs", "2.1.0"), ("c", "package-unreadable", "1.0.0")]
    assert gates(p.publish_gates(c, releases, releases, audits)) == want


def test_fonts(spark):
    fonts = spark.createDataFrame([("f", "A"), ("f", "B")], "path string, name string")
    drawn = spark.createDataFrame([("f", ["A", "A"])], "path string, font_names array<string>")
    assert {x["name"]: x["used"] for x in p.font_usage(fonts, drawn).collect()} == {"A": True, "B": False}

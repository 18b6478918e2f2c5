"""Drafts, imports and reports on small tables."""

import json

from pyspark.sql import functions as F

from folioforge.functions.refs import verse_hash
from folioforge.operators import drafts as dr
from folioforge.operators import structure as st

from .test_operators import BOOK


def rows(df, *order):
    return [tuple(x) for x in df.orderBy(*order).collect()]


def test_a_draft_becomes_divisions_and_verses_with_evidence(spark):
    units = st.flatten_books(spark.createDataFrame([(json.dumps(BOOK),)], "document string"))
    primary = spark.createDataFrame([("b", "text")], "book_id string, layer_id string")
    evidence = spark.createDataFrame([("b#v2", 0.5)], "ref string, confidence double")
    d, v = dr.flatten_draft(units, primary, evidence)
    assert rows(d.select("id", "parent_id", "ordinal", "kind"), "ordinal") == [("s1", None, 0, "section")]
    assert rows(v.select("division_id", "id", "ordinal", "number", "text", "confidence"), "division_id", "ordinal") == [("", "v2", 0, None, "two", 0.5), ("s1", "v1", 0, "1", "one", None), ("s1", "v1", 1, None, "", None)]
    assert units.where("id = 'v2'").select(F.col("layers")["words"]).first()[0] == "w\u001dm\u001d"


def test_hashes_of_layers_and_recorded_ones(spark):
    df = spark.createDataFrame([("f1a64:1", {"a": "x"}), (None, {"b": "y", "a": "x"})], "h string, layers map<string,string>")
    a, b = (r[0] for r in df.select(dr.content_hash(F.col("h"), F.col("layers"))).collect())
    assert a == "f1a64:1" and b == df.where("h IS NULL").select(verse_hash(F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("y")))).first()[0]


def test_printed_numbers_in_any_script(spark):
    df = spark.createDataFrame([(1, "a", 1, "૧"), (1, "a", 2, "x"), (1, "a", 3, "4"), (1, "a", 4, "५")], "book int, division string, pos int, printed string")
    r = dr.printed_sequence(df).first()
    assert (r["first"], r["last"], r["numbered"], [(g["start"], g["end"]) for g in r["missing"]], r["out_of_order"]) == (1, 5, 3, [(2, 3)], [4])


def test_values_of_reports(spark):
    one = spark.createDataFrame([("abcdefghijklmnopqrstuvwxyz", 3, 20)], "x string, a int, b int")
    assert tuple(one.select(dr.context_around(F.col("x"), F.col("a")), dr.context_around(F.col("x"), F.col("b"))).first()) == ("abcdefghijk", "mnopqrstuvwxyz")
    assert tuple(one.select(dr.json_pointer(F.array().cast("array<string>")), dr.json_pointer(F.array(F.lit("a"), F.lit("0")))).first()) == ("/", "/a/0")
    assert one.select(dr.describe_violation(F.lit("virama-without-base"), F.lit("x"))).first()[0] == "a virama without a consonant (x)"
    twice = spark.createDataFrame([('{"k": 1}',), ('"{\\"k\\": 2}"',), (None,)], "x string")
    assert [r[0] for r in twice.select(dr.reparsed(F.col("x"), "k int")["k"]).collect()] == [1, 2, None]
    keys = spark.createDataFrame([("b", ["s1", "c2"], "v1"), ("b", [], "v1")], "b string, p array<string>, v string")
    assert [r[0] for r in keys.select(dr.ref_of(F.col("b"), dr.division_key(F.col("p")), F.col("v"))).collect()] == ["b/s1/c2#v1", "b#v1"]


def test_results_are_appended_once_and_packages_written_once(spark, tmp_path):
    import pytest

    from folioforge.sources import sinks
    from folioforge.sources.ledger import Ledger

    s = "page int, source_sha256 string, chars int, at int"
    first = spark.createDataFrame([(1, "h", 10, 1), (2, "h", 20, 1)], s)
    path = str(tmp_path / "results")
    assert sinks.append_results(first, path, ["page"]).count() == 2
    again = spark.createDataFrame([(1, "h", 11, 2), (2, "new", 21, 2), (3, "h", 30, 2)], s)
    assert rows(sinks.append_results(again, path, ["page"]).select("page", "chars"), "page") == [(2, 21), (3, 30)]
    now = Ledger(spark, path, first.schema).read()
    assert now.count() == 4 and rows(sinks.current_results(now, ["page"], "at").select("page", "chars"), "page") == [(1, 10), (2, 21), (3, 30)]
    packages = spark.createDataFrame([("b", "1.0.0", '{"id":"b"}')], "book_id string, content_version string, document string")
    out = sinks.write_once(packages, str(tmp_path / "books"))
    assert out.first()["bytes"] == 10 and spark.read.text(str(tmp_path / "books")).first()["value"] == '{"id":"b"}'
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_once(packages, str(tmp_path / "books"))
    struct = spark.createDataFrame([((1, 2, 3),)], "p struct<id:int,structure:int,title:int>").select(sinks.catalog_manifest(F.col("p"), ["id", "structure", "title"]).alias("m"))
    assert struct.columns == ["m"] and struct.first()["m"].asDict() == {"id": 1, "title": 3}


def test_a_cluster_must_name_its_shared_folder(spark):
    from types import SimpleNamespace

    import pytest

    from folioforge.sources.shared import shared_dir

    def session(master, settings):
        return SimpleNamespace(conf=SimpleNamespace(get=settings.get, set=settings.__setitem__), sparkContext=SimpleNamespace(master=master))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://host:7077", {}))
    assert shared_dir(session("spark://host:7077", {"spark.checkpoint.dir": "/shared"})) == "/shared"
    own = {}
    assert shared_dir(session("local[4]", own)) == own["spark.checkpoint.dir"]
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")

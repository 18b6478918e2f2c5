"""What keeps whole documents small and quick at size: tables without what lies below, units that aren't opened, one dealing, and the same results."""

import json
from pathlib import Path

from folioforge.functions import refs
from folioforge.operators import documents as d
from folioforge.sources import shared
from pyspark.sql import functions as F

from .test_documents import SCHEMA, book, fnv, verse

LAYERS = [{"id": "gu", "kind": "original", "language": "gu", "script": "gujr", "label": {"gu": "નામ"}}]


def plain(i, text="પાઠ", **more):
    return {"kind": "verse", "id": i, "form": "prose", "layers": {"gu": text}, "hash": fnv({"gu": text})} | more


def section(i, *children, **more):
    return {"kind": "section", "id": i, "children": list(children)} | more


def of(*structure, **more):
    return book(layers=LAYERS, structure=list(structure), aliases={}) | more


def table(spark, **books):
    return spark.createDataFrame([(k, json.dumps(b, ensure_ascii=False)) for k, b in books.items()], SCHEMA)


def found(spark, **books):
    out = {k: [] for k in books}
    for r in d.validate_books(table(spark, **books), "key").collect():
        out[r["doc"]].append((r["code"], r["path"]))
    return {k: sorted(v) for k, v in out.items()}


def deep(levels):
    unit = section("s", plain("v1"), plain("v2", "બીજો"))
    for k in range(levels):
        unit = section(f"d{k}", plain("v1"), unit, section(f"e{k}", plain("v1")))
    return of(unit, plain("v9"))


def test_a_node_is_kept_without_the_units_below_it(spark):
    nodes = d.walk_units(table(spark, a=book()), "key").select("shape", F.to_json("node").alias("json")).collect()
    above = [json.loads(r["json"]) for r in nodes if r["shape"] in ("book", "division")]
    assert len(above) == 4 and all(n.get("structure", n.get("children")) == [True] for n in above)
    assert sum("text v9" in r["json"] for r in nodes) == 1


def test_units_that_show_that_they_keep_the_schema_are_not_opened(spark, monkeypatch):
    opened = []
    real = d.with_fields
    monkeypatch.setattr(d, "with_fields", lambda nodes: opened.append(nodes.where("shape <> 'book'").count()) or real(nodes))
    whole = of(section("one", plain("v1", "two\nlines", number="૧"), plain("v2", title={"gu": "t", "en-x": "u"}), number="1", title={"gu": "ક"}))
    assert found(spark, whole=whole) == {"whole": []}
    assert opened[0] == 0


WRONG = [
    (plain("v1", number=5), "number"), (plain("v1", number=None), "number"), (plain("v1", number="a\nb"), "number"), (plain("v1", title={}), "title"), (plain("v1", title={"GU": "x"}), "title/GU"),
    (plain("v1", title={"gu": 1}), "title/gu"), (plain("v1", form="song"), "form"), (plain("v1", hash=""), "hash"), (plain("v1", more=1), ""), (plain("v1", children=[]), ""), (plain("v1", layers={"gu": ""}), "layers/gu"),
    (plain("v1", layers={"gu": None}), "layers/gu"), (plain("v1", layers={"gu": "x", "g_u": "x"}), "layers/g_u"), (plain("v1", layers={"a: STRING, gu": "x"}), "layers/a: STRING, gu"), (plain("v 1"), "id"), (plain("v1\n"), "id"), (plain(7), "id"),
    (plain("v1", layers=[]), "layers"), (section("s"), "children"), (section("s", plain("v1"), title=None), "title"), (section("s", plain("v1"), layers={}), ""), (section("s", None), "children/0"), (section("s", True), "children/0"),
    (plain("v1", layers={"gu": [{"word": "x", "meaning": "y"}, {"word": "z", "meaning": "y", "note": None}]}), "layers/gu/1/note"),
]


def test_the_quick_look_hides_no_fault(spark):
    out = found(spark, **{str(k): of(unit) for k, (unit, _) in enumerate(WRONG)})
    assert out == {str(k): [("schema", "/structure/0" + ("/" + path if path else ""))] for k, (_, path) in enumerate(WRONG)}


def test_divisions_of_one_ref_share_their_children(spark):
    twice = of(section("one", plain("v1"), plain("v2")), section("one", plain("v1"), plain("v3"), plain("v3")), plain("one"))
    once = of(section("one", plain("v1"), plain("v1"), plain("v1")), section("two", plain("v1")))
    assert found(spark, twice=twice, once=once) == {
        "twice": sorted([("duplicate-sibling-id", "own-book")] * 2 + [("duplicate-sibling-id", "own-book/one")] * 2),
        "once": [("duplicate-sibling-id", "own-book/one")] * 2,
    }


def test_deeper_documents_than_are_opened_at_once_come_back(spark):
    books = {"a": deep(2 * d.AT_ONCE + 1), "b": of(plain("v1")), "c": deep(d.AT_ONCE - 1)}
    nodes = d.walk_units(table(spark, **books), "key")
    assert {r["doc"]: json.loads(r["document"]) for r in d.rebuild_books(nodes).collect()} == books
    assert found(spark, **books) == {k: [] for k in books}
    stored = d.walk_units(table(spark, **books), "key", stored=True)
    assert sorted(map(str, d.units(stored).collect())) == sorted(map(str, d.units(nodes).collect()))


def test_units_are_dealt_once_and_joined_never(spark):
    nodes = d.walk_units(table(spark, a=deep(2)), "key")
    built = d.build_structures(d.units(nodes).withColumnRenamed("ord", "place"), stored=True)
    assert built.first()["verses"] == 7
    plan = built._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # Verses of each of four levels and the divisions above three of them.
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(doc") == 4 + 3


def test_packed_tables_leave_no_shuffle_files_and_the_settings_as_they_were(spark):
    before = {k: spark.conf.get(k, None) for k in (*shared._WRITING, "spark.sql.files.minPartitionNum")}
    out = shared.packed(spark.range(1000).repartition(3, "id"), "numbers")
    files = list(Path(out.inputFiles()[0].removeprefix("file://")).parent.glob("*.parquet"))
    assert out.count() == 1000 and files and all(".zstd." in f.name for f in files)
    assert {k: spark.conf.get(k, None) for k in before} == before


def test_layers_in_any_normal_form_are_hashed_alike(spark):
    maps = [{"gu": "a"}, {"gu": "é", "en": "x"}, {"é": "1", "f": "2", "é2": "z"}, {}, {"gu": ""}]
    rows = spark.createDataFrame([(m,) for m in maps] + [(None,)], "m map<string,string>").select(refs.normal_verse_hash(F.col("m"))).collect()
    nfc = lambda x: x.replace("é", "é")
    assert [r[0] for r in rows] == [fnv({nfc(k): nfc(v) for k, v in m.items()}) for m in maps] + [None]


def test_a_unit_is_found_wrong_among_right_ones(spark):
    wrong = verse("v2", layers={"gu": "x", "other": "y"}, hash="f1a64:0")
    assert found(spark, a=of(section("s", plain("v1"), plain("v3"), wrong))) == {"a": [("hash-mismatch", "own-book/s#v2"), ("undeclared-layer", "own-book/s#v2")]}

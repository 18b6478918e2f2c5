"""Documents as variants: walked, checked with the places of faults, and built again."""

import json

import pytest
from folioforge.functions.refs import FIELD, GLOSS, RECORD
from folioforge.operators import documents as d
from folioforge.operators import structure as st

SCHEMA = "key string, document string"


def fnv(layers):
    h = 0xCBF29CE484222325
    text = RECORD.join(f"{k}{FIELD}{v if isinstance(v, str) else GLOSS.join(x for g in v for x in (g['word'], g['meaning'], g.get('note', '')))}" for k, v in sorted(layers.items()))
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return f"f1a64:{h:016x}"


def verse(i, **more):
    layers = {"gu": f"પાઠ {i}", "en": f"text {i}\nof two lines", "words": [{"word": "પાઠ", "meaning": "text"}, {"word": i, "meaning": "number", "note": "n"}]}
    return {"kind": "verse", "id": i, "form": "verse", "layers": layers, "hash": fnv(layers)} | more


def book(**more):
    text = {"gu": "નામ"}
    return {
        "formatVersion": 1, "id": "own-book", "title": text, "language": "gu", "script": "gujr", "contentVersion": "1.0.0", "contentStatus": "draft",
        "source": {"edition": "first", "year": 1950, "url": "https://example.org/a"}, "license": {"id": "public-domain"},
        "layers": [
            {"id": "gu", "kind": "original", "language": "gu", "script": "gujr", "label": text}, {"id": "en", "kind": "translation", "language": "en", "script": "latn", "label": {"en": "English"}},
            {"id": "words", "kind": "wordMeanings", "language": "en", "script": "latn", "label": {"en": "Words"}},
        ],
        "primaryLayer": "gu",
        "structure": [
            {"kind": "section", "id": "one", "number": "૧", "title": text, "children": [verse("v1"), {"kind": "chapter", "id": "deep", "children": [verse("v1"), verse("v2", number="૨", form="prose")]}, verse("v3")]},
            verse("v9"), {"kind": "section", "id": "two", "children": [verse("v1", title={"en": "T"})]},
        ],
        "aliases": {"own-book/one#gone": "own-book/one", "own-book/old": "own-book", "own-book/one#x": "own-book/one/deep#v2"},
    } | more


def changed(*steps, value=None, drop=False):
    b = json.loads(json.dumps(book()))  # nothing in it is shared
    at = b
    for s in steps[:-1]:
        at = at[s]
    if drop:
        del at[steps[-1]]
    else:
        at[steps[-1]] = value
    return b


S, V = "structure", ("structure", 0, "children", 0)
FAULTS = {
    "whole": (book(), []),
    "title": (changed("title", drop=True), [("schema", "/title")]),
    "no-title": (changed("title", value={}), [("schema", "/title")]),
    "title-tag": (changed("title", value={"GU": "x"}), [("schema", "/title/GU")]),
    "title-line": (changed("title", "gu", value="a\nb"), [("schema", "/title/gu")]),
    "unknown": (changed("more", value=1), [("schema", "/")]),
    "format": (changed("formatVersion", value=2), [("schema", "/formatVersion")]),
    "format-text": (changed("formatVersion", value="1"), [("schema", "/formatVersion")]),
    "id": (changed("id", value="Own Book"), [("schema", "/id")]),
    "version": (changed("contentVersion", value="1.0"), [("schema", "/contentVersion")]),
    "version-end": (changed("contentVersion", value="1.0.0\n"), [("schema", "/contentVersion")]),
    "status": (changed("contentStatus", value="done"), [("schema", "/contentStatus")]),
    "year": (changed("source", "year", value=1950.5), [("schema", "/source/year")]),
    "late": (changed("source", "year", value=2201), [("schema", "/source/year")]),
    "url": (changed("source", "url", value="no url"), [("schema", "/source/url")]),
    "null": (changed("tradition", value=None), [("schema", "/tradition")]),
    "empty": (changed(S, value=[]), [("schema", "/structure")]),
    "empty-division": (changed(S, value=[{"kind": "section", "id": "empty", "children": []}]), [("schema", "/structure/0/children")]),
    "kind": (changed(*V, "kind", value="stanza"), [("schema", "/structure/0/children/0/kind")]),
    "not-a-unit": (changed(*V, value=5), [("schema", "/structure/0/children/0")]),
    "control": (changed(*V, "layers", "gu", value="a\u000cb"), [("schema", "/structure/0/children/0/layers/gu")]),
    "value": (changed(*V, "layers", "gu", value=7), [("schema", "/structure/0/children/0/layers/gu")]),
    "layer-key": (changed(*V, "layers", "G U", value="x"), [("schema", "/structure/0/children/0/layers/G U")]),
    "gloss": (changed(*V, "layers", "words", value=[{"word": "x"}]), [("schema", "/structure/0/children/0/layers/words/0/meaning")]),
    "no-gloss": (changed(*V, "layers", "words", value=[]), [("schema", "/structure/0/children/0/layers/words")]),
    "deep": (changed(S, 0, "children", 1, "children", 1, "id", value="v 2"), [("schema", "/structure/0/children/1/children/1/id")]),
    "layer": (changed("layers", 1, "label", drop=True), [("schema", "/layers/1/label")]),
    "script": (changed("layers", 1, "script", value="latin"), [("schema", "/layers/1/script")]),
    "list": ([], [("schema", "/")]),
    "twice": (changed("layers", 1, "id", value="gu"), [("duplicate-layer-id", "/layers/1"), ("primary-layer-not-original", "/primaryLayer")] + [("undeclared-layer", r) for r in ("own-book/one#v1", "own-book/one/deep#v1", "own-book/one/deep#v2", "own-book/one#v3", "own-book#v9", "own-book/two#v1")]),
    "undeclared-primary": (changed("primaryLayer", value="deva"), [("primary-layer-undeclared", "/primaryLayer")]),
    "not-original": (changed("primaryLayer", value="en"), [("primary-layer-not-original", "/primaryLayer")]),
    "scheme": (changed("layers", 1, "kind", value="transliteration"), [("transliteration-scheme-missing", "/layers/1")]),
    "siblings": (changed(S, 0, "children", 2, "id", value="v1"), [("duplicate-sibling-id", "own-book/one")]),
    "same-id-elsewhere": (changed(S, 0, "children", 1, "children", 1, "id", value="v9"), [("alias-target-missing", "/aliases/own-book/one#x")]),
    "stale": (changed(*V, "layers", "gu", value="બીજો"), [("hash-mismatch", "own-book/one#v1")]),
    "stale-gloss": (changed(*V, "layers", "words", 1, "note", value="m"), [("hash-mismatch", "own-book/one#v1")]),
    "no-hash": (changed(*V, "hash", drop=True), []),
    "mismatch": (changed("layers", 2, "kind", value="commentary"), [("layer-kind-mismatch", r) for r in ("own-book/one#v1", "own-book/one/deep#v1", "own-book/one/deep#v2", "own-book/one#v3", "own-book#v9", "own-book/two#v1")]),
    "lacking": (changed(S, 1, value={"kind": "verse", "id": "v9", "form": "verse", "layers": {"en": "x"}}), [("primary-layer-missing", "own-book#v9")]),
    "shadow": (changed("aliases", value={"own-book/one#v1": "own-book/one#v3"}), [("alias-source-live", "/aliases/own-book/one#v1")]),
    "nowhere": (changed("aliases", value={"own-book/x": "own-book/y"}), [("alias-target-missing", "/aliases/own-book/x")]),
    "foreign": (changed("aliases", value={"other/1#v1": "own-book"}), [("alias-foreign-book", "/aliases/other/1#v1")]),
    "no-ref": (changed("aliases", value={"Not A Ref": "own-book/one"}), [("alias-unparseable", "/aliases/Not A Ref")]),
}


@pytest.fixture(scope="module")
def issues(spark):
    rows = [(k, json.dumps(b, ensure_ascii=False)) for k, (b, _) in FAULTS.items()] + [("bad", "{no json"), ("none", None), ("again", '{"id":"a","id":"b"}')]
    out = {}
    for r in d.validate_books(spark.createDataFrame(rows, SCHEMA).repartition(5), "key").collect():
        out.setdefault(r["doc"], []).append((r["code"], r["path"]))
    return out


@pytest.mark.parametrize("key", FAULTS)
def test_each_fault_is_named_at_its_place(issues, key):
    assert sorted(issues.get(key, [])) == sorted(FAULTS[key][1])


def test_what_is_no_document_is_one_issue(issues):
    assert issues["bad"] == issues["none"] == issues["again"] == [("schema", "/")]


def test_walk_equals_the_flattener_and_the_way_back_is_the_identity(spark):
    books = {"a": book(), "b": book(id="other", aliases={}), "c": changed(S, 0, "children", 1, "children", 0, "layers", "gu", value="é")}
    for b in books.values():
        b["structure"][0]["children"][1]["children"][0].pop("hash")
    df = spark.createDataFrame([(k, json.dumps(b, ensure_ascii=False)) for k, b in books.items()], SCHEMA)
    nodes = d.walk(df, "key")
    columns = ["ref", "parent_ref", "depth", "kind", "id", "number", "form", "hash"]
    mine = sorted(map(str, d.units(nodes).select(*columns).collect()))
    assert mine == sorted(map(str, st.flatten_books(df).select(*columns).collect()))
    assert [r["id"] for r in d.units(nodes).where("doc = 'a'").orderBy("ord").collect()] == ["one", "v1", "deep", "v1", "v2", "v3", "v9", "two", "v1"]
    assert sorted(r["ref"] for r in d.live_refs(nodes).where("doc = 'a'").collect()) == sorted(["own-book", "own-book/one", "own-book/two", "own-book/one/deep", "own-book#v9", *(f"own-book/{r}" for r in ("one#v1", "one#v3", "one/deep#v1", "one/deep#v2", "two#v1"))])
    out = {r["doc"]: json.loads(r["document"]) for r in d.rebuild_books(nodes).collect()}
    for b in books.values():
        v = b["structure"][0]["children"][1]["children"][0]
        v["hash"] = fnv({k: x.replace("é", "é") if isinstance(x, str) else x for k, x in v["layers"].items()})
    assert out == books
    assert d.rebuild_books(d.walk(df.limit(0), "key")).count() == 0 and d.validate_books(df.limit(0), "key").count() == 0


def test_working_tables_become_a_tree(spark):
    divisions = spark.createDataFrame(
        [("b", "one", None, 1, "section", None, {"gu": "ક"}), ("b", "one/deep", "one", 5, "chapter", "૨", None), ("b", "zero", None, 0, "section", None, None), ("b", "one/empty", "one", 1, "chapter", None, None), ("b", "gone", None, 3, "section", None, None)],
        "book_id string, id string, parent_id string, ordinal int, kind string, number string, title map<string,string>",
    )
    verses = spark.createDataFrame(
        [("b", "one", "v2", 2, "૨", "prose", "બે"), ("b", "one", "v1", 1, None, "verse", "એક \"q\""), ("b", "one/deep", "v1", 0, None, None, "ઊંડે"), ("b", "zero", "v1", 0, None, "prose", "શૂન્ય"), ("b", "", "top", 0, None, "prose", "ઉપર")],
        "book_id string, division_id string, id string, ordinal int, number string, form string, text string",
    )
    row = d.build_structures(d.working_units(divisions, verses, "gu")).first()
    v = lambda i, text, form="prose", **more: {"kind": "verse", "id": i, **more, "form": form, "layers": {"gu": text}, "hash": fnv({"gu": text})}
    assert json.loads(row["structure"]) == [
        {"kind": "section", "id": "zero", "children": [v("v1", "શૂન્ય")]},
        {"kind": "section", "id": "one", "title": {"gu": "ક"}, "children": [{"kind": "chapter", "id": "deep", "number": "૨", "children": [v("v1", "ઊંડે")]}, v("v1", "એક \"q\"", "verse"), v("v2", "બે", number="૨")]},
        v("top", "ઉપર"),
    ]
    assert row["verses"] == 5


def test_a_walk_writes_a_table_for_each_level_of_units(spark, monkeypatch):
    written = []
    real = d.materialize
    monkeypatch.setattr(d, "materialize", lambda df, what: written.append(what) or real(df, what))
    d.walk(spark.createDataFrame([("a", json.dumps(book()))], SCHEMA), "key")
    assert written == ["nodes"] * 5  # the book, three levels of units, and the empty one below

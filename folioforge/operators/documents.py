"""Book documents as variants: walked level by level, checked by the rules of their schema and beyond it, and built again.

Each level of the units of documents is one table of nodes, and a node carries its shape (what the schema expects there), its
JSON pointer and, inside the structure, its ref. So documents of any depth and any number are walked in as many steps as the
deepest has levels of units, and an issue names the place where it is. A node is kept without the units below it, which are
read from the documents again, so that a text isn't written once for each level above it.
What a unit holds beside other units has a depth that the format fixes: it is opened in one pass over those units whose types
and values don't show at once that they keep the schema.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.refs import GLOSS, SEGMENT, is_ref, normal_verse_hash
from ..sources.shared import dealt
from ..sources.shared import packed as materialize
from .structure import CONTROL, CONTROL_OR_LINE, LANGUAGE_TAG, SEMVER

#: The format of a package. Of each object its fields, their shapes, and whether they must be there (a star).
OBJECTS = {
    "book": "formatVersion*:format id*:segment title*:localized subtitle:localized language*:tag script*:script tradition:filled contentVersion*:version contentStatus*:status source*:source license*:license layers*:layers primaryLayer*:segment structure*:units aliases:aliases",
    "source": "edition*:filled publisher:filled year:year isbn:filled url:url notes:filled",
    "license": "id*:filled holder:filled notes:filled",
    "layer": "id*:segment kind*:layerKind language*:tag script*:script label*:localized scheme:filled attribution:filled license:license",
    "gloss": "word*:line meaning*:line note:line",
    "division": "kind*:divisionKind id*:segment number:line title:localized children*:units",
    "verse": "kind*:verseKind id*:segment number:line title:localized form*:form layers*:values hash:filled",
}
#: Maps (the rule of keys, the shape of values, entries at least) and lists (the shape of items; one at least).
MAPS = {"localized": ("tag", "line", 1), "values": ("segment", "value", 0), "aliases": ("filled", "filled", 0)}
LISTS = {"layers": "layer", "units": "unit", "glosses": "gloss"}
CHOICES = {
    "script": "gujr deva latn", "status": "draft proofed published", "layerKind": "original transliteration translation wordMeanings commentary",
    "divisionKind": "volume section chapter passage", "verseKind": "verse", "form": "verse prose",
}
_FIELDS = {shape: [(f.split(":")[0].rstrip("*"), f.split(":")[1], "*" in f) for f in text.split()] for shape, text in OBJECTS.items()}


def _map(pairs: dict[str, object]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


_NEXT = {f"{s}/{name}": shape for s, fields in _FIELDS.items() for name, shape, _ in fields} | {f"{s}/*": v[1] for s, v in MAPS.items()} | {f"{s}/*": v for s, v in LISTS.items()}


def _rule(rule: str, s: Column) -> Column:
    """Whether a string keeps a rule."""
    if rule in CHOICES:
        return s.isin(*CHOICES[rule].split())
    if rule in ("text", "line"):
        return (s != "") & ~F.regexp_like(s, F.lit(CONTROL if rule == "text" else CONTROL_OR_LINE))
    patterns = {"segment": f"^{SEGMENT}\\z", "tag": LANGUAGE_TAG.replace("$", "\\z"), "version": SEMVER.replace("$", "\\z"), "url": "^[A-Za-z][A-Za-z0-9+.-]*:[^\\s]+\\z"}
    return F.regexp_like(s, F.lit(patterns[rule])) if rule in patterns else s != ""


_TEXT_RULES = ("segment", "tag", "version", "text", "line", "filled", "url", *CHOICES)


def _resolved(shape: Column, kind: Column, node: Column) -> Column:
    """The shape of a unit by its kind, and of a layer's value by its type; ``bad`` where neither fits."""
    named = F.try_variant_get(node, "$.kind", "string")
    unit = F.when(kind != "object", "bad").when(named == "verse", "verse").when(named.isin(*CHOICES["divisionKind"].split()), "division").otherwise("bad-kind")
    value = F.when(kind == "string", "text").when(kind == "list", "glosses").otherwise("bad")
    return F.when(shape == "unit", unit).when(shape == "value", value).otherwise(shape)


def _kind(node: Column) -> Column:
    # What is large is told by a cast that opens one level: the schema of a variant would be that of all that it holds.
    is_object, is_list, t = F.try_variant_get(node, "$", "struct<kind:variant>").isNotNull(), _items(node).isNotNull(), F.schema_of_variant(node)
    return F.when(is_object, "object").when(is_list, "list").when(t == "STRING", "string").when(t.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(t, F.lit("DECIMAL")), "number").otherwise("other")


# Members are asked for as lists of lists, which they aren't: they are counted, while as variants each would be built anew with all that it holds.
def _members(node: Column) -> Column:
    """A map whose keys are the fields of an object, null for anything else."""
    return F.try_variant_get(node, "$", "map<string,array<array<boolean>>>")


def _items(node: Column) -> Column:
    """An array as long as a list, null for anything else."""
    return F.try_variant_get(node, "$", "array<array<boolean>>")


_COLUMNS = ["doc", "pointer", "shape", "kind", "ref", "parent_ref", "ord", "depth", "node"]


def _opened(nodes: DataFrame, opens: Column) -> DataFrame:
    """The children that the format knows of the nodes that ``opens`` chooses (no units), and the other nodes as they are; ``fresh`` tells the children."""
    old = nodes.withColumn("fresh", opens & F.col("kind").isin("object", "list")).withColumnsRenamed({c: f"_{c}" for c in _COLUMNS if c != "doc"})
    sub = old.lateralJoin(old.sparkSession.tvf.variant_explode_outer(F.when(F.col("fresh"), F.col("_node")).outer()))
    fresh, value = F.col("fresh"), F.col("value")
    name = F.when(F.col("_shape").isin(*MAPS, *LISTS), "*").otherwise(F.coalesce("key", F.lit("")))
    sub = sub.withColumn("expected", F.when(fresh, _map(_NEXT)[F.concat("_shape", F.lit("/"), name)])).where(~fresh | (F.col("expected").isNotNull() & value.isNotNull()))
    sub = sub.withColumn("kind", F.when(fresh, _kind(value)).otherwise(F.col("_kind")))
    return sub.select(
        "doc", F.when(fresh, F.concat("_pointer", F.lit("/"), F.coalesce("key", F.col("pos").cast("string")))).otherwise(F.col("_pointer")).alias("pointer"),
        F.when(fresh, _resolved(F.col("expected"), F.col("kind"), value)).otherwise(F.col("_shape")).alias("shape"), "kind", F.col("_ref").alias("ref"), F.when(~fresh, F.col("_parent_ref")).alias("parent_ref"),
        F.col("_ord").alias("ord"), F.col("_depth").alias("depth"), F.when(fresh, value).otherwise(F.col("_node")).alias("node"), "fresh",
    )


#: Levels of units that are opened at once, before what lies below is written anew.
AT_ONCE = 4


def _held(shape: Column, kind: Column, node: Column) -> Column:
    """What should be the list of the units right below a book or division, null for other nodes."""
    is_object = kind == "object"
    return F.when(is_object & (shape == "book"), F.try_variant_get(node, "$.structure", "variant")).when(is_object & (shape == "division"), F.try_variant_get(node, "$.children", "variant"))


def _below(level: DataFrame) -> DataFrame:
    """The units right below those of a level, with all that they hold."""
    # Nothing is filtered: Spark would move the filter below, where shape and kind would be found once for it and once for the rest.
    above = level.withColumnsRenamed({c: f"_{c}" for c in _COLUMNS if c != "doc"})
    sub = above.lateralJoin(level.sparkSession.tvf.variant_explode(_held(F.col("_shape"), F.col("_kind"), F.col("_node")).outer()))
    place = F.col("pos").cast("string")
    sub = sub.withColumn("kind", _kind(F.col("value"))).withColumn("shape", _resolved(F.lit("unit"), F.col("kind"), F.col("value")))
    return sub.select(
        "doc", F.concat("_pointer", F.when(F.col("_shape") == "book", "/structure/").otherwise("/children/"), F.coalesce("key", place)).alias("pointer"), "shape", "kind",
        F.concat("_ref", F.when(F.col("shape") == "verse", "#").otherwise("/"), F.coalesce(F.try_variant_get("value", "$.id", "string"), F.lit(""))).alias("ref"), F.col("_ref").alias("parent_ref"),
        F.concat_ws(".", F.when(F.col("_ord") != "", F.col("_ord")), F.lpad(place, 9, "0")).alias("ord"), (F.col("_depth") + 1).alias("depth"), F.col("value").alias("node"),
    )


def _alone(level: DataFrame, *whole: str) -> DataFrame:
    """Nodes (and under another name, if one is given, those above others as they were) with the mark ``[true]`` for the units below them, if there are any; ``repeats`` and ``forks`` are the further children (and divisions) whose ids their siblings have."""
    shape, node = F.col("shape"), F.col("node")
    holds = shape.isin("book", "division") & (F.col("kind") == "object")
    name = F.when(shape == "book", "structure").otherwise("children")
    short = lambda k, v: F.when((k == name) & (F.size(_items(v)) > 0), F.parse_json(F.lit("[true]"))).otherwise(v)
    own = F.to_variant_object(F.transform_values(F.try_variant_get(node, "$", "map<string,variant>"), short))
    below = F.try_variant_get(_held(shape, F.col("kind"), node), "$", "array<struct<kind:string,id:string>>")
    again = lambda units: F.size(units) - F.size(F.array_distinct(F.transform(units, lambda u: u["id"])))
    marked = level.withColumn("_below", F.when(holds, below))
    forks = again(F.filter("_below", lambda u: F.coalesce(u["kind"] != "verse", F.lit(True))))
    repeats = F.when(F.col("_below").isNotNull(), again(F.col("_below"))).otherwise(0)
    return marked.select(*(F.when(holds, own).otherwise(node).alias(c) if c == "node" else c for c in _COLUMNS), repeats.alias("repeats"), F.when(F.col("_below").isNotNull(), forks).otherwise(0).alias("forks"), *(F.when(holds, node).alias(w) for w in whole))


def walk_units(books: DataFrame, key: str, document: str = "document", stored: bool = False) -> DataFrame:
    """The nodes of ``walk`` that are documents or units, a table for each level of units, each without the units below it.

    Books that are ``stored`` (a table that can be read again) are not written once more. ``repeats`` and ``forks`` are those of ``_alone``.
    """
    parsed = books.select(F.col(key).alias("doc"), F.try_parse_json(document).alias("node"))
    kind = _kind(F.col("node"))
    level = parsed.select(
        "doc", F.lit("").alias("pointer"), F.when(F.col("node").isNull(), "unreadable").otherwise("book").alias("shape"), F.when(F.col("node").isNotNull(), kind).alias("kind"),
        F.try_variant_get("node", "$.id", "string").alias("ref"), F.lit(None).cast("string").alias("parent_ref"), F.lit("").alias("ord"), F.lit(0).alias("depth"), "node",
    )
    levels, since = [], 0 if stored else AT_ONCE
    while True:
        if since == AT_ONCE:
            # What the documents hold below here is kept beside the nodes, and read from here on.
            kept = materialize(_alone(level, "whole"), "nodes")
            level, since = kept.drop("node").withColumnRenamed("whole", "node").select(_COLUMNS), 0
            kept = kept.drop("whole")
        else:
            kept = materialize(_alone(level), "nodes")
        if levels and kept.isEmpty():
            break
        levels.append(kept)
        since += 1
        # Without divisions there is nothing below, and the documents needn't be read for it.
        level = _below(level if len(levels) == 1 or not kept.where("shape = 'division'").isEmpty() else kept)
    return reduce(DataFrame.unionByName, levels)


def _height(shape: str) -> int:
    """How many levels of nodes lie below one of a shape, units not counted."""
    of = "glosses" if shape == "value" else shape
    return max((1 + _height(below) for name, below in _NEXT.items() if name.split("/")[0] == of and below != "unit"), default=0)


def with_fields(nodes: DataFrame) -> DataFrame:
    """Documents and units together with all nodes that they hold beside other units, in one pass."""
    out = nodes.select(*_COLUMNS, F.lit(True).alias("fresh"))
    for _ in range(max(map(_height, OBJECTS))):
        # A node to be opened also stays: it is there twice, and one of both is replaced by its children.
        can = F.col("fresh") & F.col("kind").isin("object", "list") & (F.col("shape") != "units")
        twice = out.withColumn("opens", F.explode(F.when(can, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
        out = _opened(twice.select(*_COLUMNS, "opens"), F.col("opens"))
    return out.select(_COLUMNS)


def walk(books: DataFrame, key: str, document: str = "document") -> DataFrame:
    """Nodes of documents: (doc, pointer, shape, kind, ref, parent_ref, ord, depth, node).

    Units of the structure have their own ref, other nodes that of the unit (or book) they belong to. A document that is no
    JSON (or names a field of an object twice) is one node of shape ``unreadable``.
    """
    return with_fields(walk_units(books, key, document))


#: What ``schema_of_variant`` tells of units that hold nothing but texts and maps of texts (an array would hide which of its items has what).
_TEXTS = "OBJECT<`?[A-Za-z0-9-]++`?: STRING(?:, `?[A-Za-z0-9-]++`?: STRING){0,99}>"
_PLAIN = {
    "verse": f"^OBJECT<form: STRING, (?:hash: STRING, )?id: STRING, kind: STRING, layers: {_TEXTS}(?:, number: STRING)?(?:, title: {_TEXTS})?>\\z",
    "division": f"^OBJECT<children: ARRAY<BOOLEAN>, id: STRING, kind: STRING(?:, number: STRING)?(?:, title: {_TEXTS})?>\\z",
}


def _keeps_schema() -> Column:
    """Whether a unit of ``walk_units`` keeps the schema by its types and values; false also where that takes a closer look (glosses, for one)."""
    get = lambda f, t="string": F.try_variant_get("node", f"$.{f}", t)
    shape, types = F.col("shape"), F.schema_of_variant("node")
    keeps = lambda f, rule: F.coalesce(_rule(rule, get(f)), F.lit(True))

    def entries(f: str, name: str) -> Column:
        m, (of_keys, of_values, _) = get(f, "map<string,string>"), MAPS[name]
        of_values = "text" if of_values == "value" else of_values
        return F.coalesce(F.forall(F.map_keys(m), lambda k: _rule(of_keys, k)) & F.forall(F.map_values(m), lambda v: _rule(of_values, v)), F.lit(True))

    both = keeps("id", "segment") & keeps("number", "line") & entries("title", "localized")
    verse = F.regexp_like(types, F.lit(_PLAIN["verse"])) & both & keeps("form", "form") & keeps("hash", "filled") & entries("layers", "values")
    division = F.regexp_like(types, F.lit(_PLAIN["division"])) & both
    return F.coalesce(F.when(shape == "verse", verse).when(shape == "division", division), F.lit(False))


def _issues(rows: DataFrame, code: str, path: Column, severity: str = "error") -> DataFrame:
    return rows.select("doc", F.lit(severity).alias("severity"), F.lit(code).alias("code"), path.cast("string").alias("path"))


def schema_issues(nodes: DataFrame) -> DataFrame:
    """(doc, severity, code, path): what breaks the format, each at its JSON pointer.

    A missing field is reported where it should be, a field too many at its object, a key that breaks its rule at the key;
    what lies inside a node of the wrong type isn't looked at.
    """
    node, kind, shape = F.col("node"), F.col("kind"), F.col("shape")
    given = F.struct(
        F.when(kind == "string", F.try_variant_get(node, "$", "string")).alias("text"), F.when(kind == "number", F.try_variant_get(node, "$", "double")).alias("number"),
        F.coalesce(F.map_keys(_members(node)), F.array().cast("array<string>")).alias("keys"), _items(node).alias("items"),
    )
    # As in ``_opened``: a function of an array of one, so that what is asked of a node is found once.
    found = nodes.select("doc", F.explode(F.flatten(F.transform(F.array(given), _places))).alias("path"))
    return _issues(found, "schema", F.when(F.col("path") == "", "/").otherwise(F.col("path")))


def _places(given: Column) -> Column:
    """The pointers of a node's faults by its text, number, keys and items."""
    kind, shape, here = F.col("kind"), F.col("shape"), F.col("pointer")
    text, number, keys = given["text"], given["number"], given["keys"]
    expected = F.when(shape.isin(*OBJECTS, *MAPS), "object").when(shape.isin(*LISTS), "list").when(shape.isin(*_TEXT_RULES), "string").when(shape.isin("year", "format"), "number")
    known, needed = _map({s: ",".join(n for n, _, _ in f) for s, f in _FIELDS.items()}), _map({s: ",".join(n for n, _, must in f if must) for s, f in _FIELDS.items()})
    at = lambda names: F.transform(names, lambda n: F.concat(here, F.lit("/"), n))
    nothing = F.array().cast("array<string>")
    one = lambda wrong: F.when(wrong, F.array(here)).otherwise(nothing)
    right = expected == kind
    fault_text = reduce(lambda acc, r: acc.when(shape == r, ~_rule(r, text)), _TEXT_RULES[1:], F.when(shape == _TEXT_RULES[0], ~_rule(_TEXT_RULES[0], text))).otherwise(F.lit(False))
    fault_number = F.when(shape == "format", number != 1).when(shape == "year", (number != F.floor(number)) | (number < 1) | (number > 2200)).otherwise(F.lit(False))
    wrong_keys = reduce(lambda acc, m: acc.when(shape == m[0], F.filter(keys, lambda k: ~_rule(m[1][0], k))), MAPS.items(), F.when(F.lit(False), nothing)).otherwise(nothing)
    few = F.when(shape.isin(*LISTS), F.size(given["items"]) < 1).when(shape.isin(*(m for m, v in MAPS.items() if v[2])), F.size(keys) < 1).otherwise(F.lit(False))
    is_object = shape.isin(*OBJECTS)
    return F.when(
        right,
        F.concat(
            F.when(is_object, at(F.array_except(F.split(needed[shape], ","), keys))).otherwise(nothing),
            one(is_object & (F.size(F.array_except(keys, F.split(known[shape], ","))) > 0)),
            at(wrong_keys), one(few | F.coalesce(fault_text, F.lit(False)) | F.coalesce(fault_number, F.lit(False))),
        ),
    ).when(shape == "bad-kind", F.array(F.concat(here, F.lit("/kind")))).otherwise(F.array(here))


def units(nodes: DataFrame) -> DataFrame:
    """(doc, ref, parent_ref, ord, depth, kind, id, number, title, form, layers, values, hash) of the units, in any order.

    ``layers`` is JSON text; ``values`` are the layers as they are hashed (glosses by their words, meanings and notes).
    """
    own = nodes.where(F.col("shape").isin("division", "verse"))
    get = lambda f, t="string": F.try_variant_get("node", f"$.{f}", t)
    gloss = lambda g: F.concat_ws(GLOSS, *(F.coalesce(F.try_variant_get(g, f"$.{f}", "string"), F.lit("")) for f in ("word", "meaning", "note")))
    values = F.transform_values(
        get("layers", "map<string,variant>"),
        lambda k, v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), gloss), GLOSS)),
    )
    glosses = F.map_keys(F.map_filter(get("layers", "map<string,variant>"), lambda k, v: F.schema_of_variant(v) != "STRING"))
    return own.select(
        "doc", "ref", "parent_ref", "ord", "depth", get("kind").alias("kind"), get("id").alias("id"), get("number").alias("number"), F.to_json(get("title", "variant")).alias("title"),
        get("form").alias("form"), F.to_json(get("layers", "variant")).alias("layers"), values.alias("values"), glosses.alias("glosses"), get("hash").alias("hash"),
    )


def live_refs(nodes: DataFrame) -> DataFrame:
    """(doc, ref): every ref that a document has, its units' and its own, once."""
    return nodes.where(F.col("shape").isin("book", "division", "verse") & F.col("ref").isNotNull()).select("doc", "ref").distinct()


def integrity_issues(nodes: DataFrame) -> DataFrame:
    """(doc, severity, code, path) of documents of ``walk_units`` that keep the schema: what it can't see. Units are named by their refs."""
    u = units(nodes)
    get = lambda f, t="string": F.try_variant_get("node", f"$.{f}", t)
    own = nodes.where("shape = 'book'")
    declared = with_fields(own).where("shape = 'layer'").select("doc", "pointer", get("id").alias("layer"), get("kind").alias("kind"), get("scheme").alias("scheme"), F.regexp_extract("pointer", "([0-9]+)$", 1).cast("long").alias("n"))
    heads = own.select("doc", get("id").alias("book"), get("primaryLayer").alias("layer"), get("aliases", "map<string,string>").alias("aliases"))
    declared, heads = materialize(declared, "layers"), materialize(heads, "heads")
    kinds = declared.groupBy("doc", "layer").agg(F.max_by("kind", "n").alias("kind"), F.array_sort(F.collect_list("n")).alias("places"))
    primary = heads.select("doc", "layer").join(kinds.select("doc", "layer", "kind"), ["doc", "layer"], "left")
    again = kinds.select("doc", F.explode(F.slice("places", F.lit(2), F.greatest(F.size("places") - 1, F.lit(0)))).alias("n"))
    verses = u.where("kind = 'verse'").withColumn("has", F.array_sort(F.map_keys("values"))).withColumn("glosses", F.array_sort("glosses"))
    # A document's verses have few sets of layers: the sets are judged, and the verses of wrong ones looked for.
    maps = kinds.where("layer IS NOT NULL").groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("layer", "kind"))).alias("_kinds"))
    known = primary.where("kind IS NOT NULL").select("doc", F.col("layer").alias("_primary"))
    met = verses.select("doc", "has", "glosses").distinct().join(maps.join(known, "doc", "left"), "doc", "left")
    of_layer = lambda layer: F.try_element_at("_kinds", layer)
    each = lambda cond, code: F.transform(F.filter("has", cond), lambda layer: F.lit(code))
    codes = F.concat(
        each(lambda layer: of_layer(layer).isNull(), "undeclared-layer"),
        each(lambda layer: (of_layer(layer) == "wordMeanings") != F.array_contains("glosses", layer), "layer-kind-mismatch"),
        F.when(~F.array_contains("has", F.col("_primary")), F.array(F.lit("primary-layer-missing"))).otherwise(F.array().cast("array<string>")),
    )
    wrong_sets = materialize(met.withColumn("codes", codes).where(F.size("codes") > 0).select("doc", "has", "glosses", "codes"), "sets")
    faults = verses.select("doc", "ref", "has", "glosses").join(wrong_sets, ["doc", "has", "glosses"]).select("doc", "ref", F.explode("codes").alias("code"))
    hashed = verses.where("hash IS NOT NULL").select("doc", "ref", "hash", "values").where(F.col("hash") != normal_verse_hash(F.col("values")))
    # Siblings were compared when their parent was opened. Divisions of one ref share their children, so documents that have them are counted by refs.
    forked = materialize(nodes.where("forks > 0").select("doc").distinct(), "forked")
    repeats = nodes.where("repeats > 0").join(forked, "doc", "left_anti").select("doc", F.col("ref").alias("parent_ref"), "repeats")
    shared = u.select("doc", "parent_ref", "id").join(forked, "doc", "left_semi").groupBy("doc", "parent_ref", "id").agg((F.count("*") - 1).cast("int").alias("repeats"))
    siblings = repeats.unionByName(shared.where("repeats > 0").drop("id")).select("doc", "parent_ref", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    found = [
        _issues(again, "duplicate-layer-id", F.concat(F.lit("/layers/"), F.col("n").cast("string"))),
        _issues(primary.where("kind IS NULL"), "primary-layer-undeclared", F.lit("/primaryLayer")),
        _issues(primary.where("kind <> 'original'"), "primary-layer-not-original", F.lit("/primaryLayer")),
        _issues(declared.where("kind = 'transliteration' AND scheme IS NULL"), "transliteration-scheme-missing", F.col("pointer"), "warning"),
        _issues(siblings, "duplicate-sibling-id", F.col("parent_ref")),
        _issues(hashed, "hash-mismatch", F.col("ref")),
        faults.select("doc", F.lit("error").alias("severity"), "code", F.col("ref").alias("path")),
    ]
    sides = F.array(*(F.struct(F.lit(side).alias("side"), F.col(side).alias("ref")) for side in ("source", "target")))
    aliases = materialize(heads.select("doc", "book", F.explode("aliases").alias("source", "target")).select("doc", "book", "source", F.inline(sides)), "aliases")
    live = nodes.where(F.col("shape").isin("book", "division", "verse")).select("doc", "ref").join(aliases.select("doc").distinct(), "doc", "left_semi").where("ref IS NOT NULL").distinct().withColumn("_live", F.lit(True))
    j = aliases.join(live, ["doc", "ref"], "left")
    wrong = F.when((F.col("side") == "source") & F.col("_live").isNotNull(), "alias-source-live").when((F.col("side") == "target") & F.col("_live").isNull(), "alias-target-missing")
    code = F.when(~is_ref(F.col("ref")), "alias-unparseable").when(F.regexp_extract("ref", "^[^/#]*", 0) != F.col("book"), "alias-foreign-book").otherwise(wrong)
    found.append(j.select("doc", F.lit("error").alias("severity"), code.alias("code"), F.concat(F.lit("/aliases/"), "source").alias("path")).where("code IS NOT NULL"))
    return reduce(DataFrame.unionByName, found)


def validate_books(books: DataFrame, key: str, document: str = "document", stored: bool = False) -> DataFrame:
    """(doc, severity, code, path) of all issues of many documents: those of the schema, and beyond it for documents without any. Books are ``stored`` as for ``walk_units``."""
    nodes = walk_units(books, key, document, stored)
    broken = materialize(schema_issues(with_fields(nodes.where(~_keeps_schema()))), "schema-issues")
    return broken.unionByName(integrity_issues(nodes).join(broken.select("doc").distinct(), "doc", "left_anti"))


def build_structures(rows: DataFrame, stored: bool = False) -> DataFrame:
    """(doc, structure, verses): units nested again as JSON text, from the deepest up; divisions that have lost all verses are gone.

    rows: (doc, ref, parent_ref, place, depth, kind, id, number, title, form, layers, values); ``place`` orders siblings, and
    a verse's hash is made anew from ``values``. Rows that are not ``stored`` (in tables that can be read again) are written first.
    """
    verse = F.col("kind") == "verse"
    rows = rows.withColumn("hash", F.when(verse, normal_verse_hash(F.col("values")))).drop("values")
    rows = rows if stored else materialize(rows, "hashed")
    size = rows.agg(F.max("depth").alias("deepest"), F.count("*").alias("n")).first()

    def node(more: Column, *fields: str) -> Column:
        plain = F.to_json(F.struct("kind", "id", "number", *fields))
        return F.concat(F.concat_ws(",", F.left(plain, F.length(plain) - 1), F.concat(F.lit('"title":'), "title"), more), F.lit("}"))

    leaf = node(F.concat(F.lit('"layers":'), "layers"), "form", "hash")
    verses = rows.where(verse).select("doc", F.col("parent_ref").alias("ref"), F.struct("place", leaf.alias("json")).alias("x"), F.lit(1).cast("long").alias("v"), "depth")
    own = F.struct("parent_ref", "place", "kind", "id", "number", "title").alias("own")
    divisions = rows.where(~verse & F.col("ref").isNotNull()).select("doc", "ref", own, "depth")
    # A document's rows are dealt once, by the document: what is found for a level lies where the next one needs it.
    deal = lambda df: dealt(df, size["n"], "doc")
    done: DataFrame | None = None
    for depth in range(size["deepest"] or 0, 0, -1):
        members = deal(verses.where(F.col("depth") == depth).drop("depth"))
        members = members if done is None else members.unionByName(done)
        if depth > 1:
            members = members.unionByName(deal(divisions.where(F.col("depth") == depth - 1).drop("depth")), allowMissingColumns=True)
        else:
            members = members.withColumn("own", F.lit(None).cast(divisions.schema["own"].dataType))
        children = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["json"]), ","), F.lit("]"))
        done = members.groupBy("doc", "ref").agg(children.alias("children"), F.sum("v").alias("verses"), F.collect_list("own").alias("own")).where("verses > 0")
        if depth > 1:
            done = done.select("doc", "children", F.col("verses").alias("v"), F.inline("own"))
            done = done.select("doc", F.col("parent_ref").alias("ref"), F.struct("place", node(F.concat(F.lit('"children":'), "children")).alias("json")).alias("x"), "v")
    if done is None:
        return rows.select("doc", F.lit("").alias("structure"), F.lit(0).cast("long").alias("verses")).limit(0)
    return done.select("doc", F.col("children").alias("structure"), "verses")


def rebuild_books(nodes: DataFrame) -> DataFrame:
    """(doc, document): documents of ``walk`` or ``walk_units`` put together again, with hashes made anew."""
    built = build_structures(units(nodes).withColumnRenamed("ord", "place"), stored=True)
    heads = nodes.where("shape = 'book'").select("doc", F.to_json(F.map_filter(F.try_variant_get("node", "$", "map<string,variant>"), lambda k, v: k != "structure")).alias("head"))
    whole = F.concat(F.regexp_replace("head", "\\}$", F.when(F.col("head") == "{}", "").otherwise(",")), F.lit('"structure":'), F.coalesce("structure", F.lit("[]")), F.lit("}"))
    return heads.join(built, "doc", "left").select("doc", whole.alias("document"))


def working_units(divisions: DataFrame, verses: DataFrame, primary: str) -> DataFrame:
    """Units of working tables for ``build_structures``: divisions (book_id, id, parent_id, ordinal, kind, number, title) stand before verses (book_id, division_id, id, ordinal, number, form, text).

    A division's id is its whole path; a verse of division '' stands in the book itself. Titles are maps by language.
    """
    own = lambda path: F.when(F.coalesce(path, F.lit("")) == "", F.col("book_id").cast("string")).otherwise(F.concat(F.col("book_id").cast("string"), F.lit("/"), path))
    path = F.col("id").cast("string")
    d = divisions.select(
        F.col("book_id").alias("doc"), own(path).alias("ref"), own(F.col("parent_id").cast("string")).alias("parent_ref"), F.struct(F.lit(False).alias("verse"), F.col("ordinal").cast("long").alias("n")).alias("place"),
        F.size(F.split(path, "/")).alias("depth"), "kind", F.element_at(F.split(path, "/"), -1).alias("id"), "number", F.to_json("title").alias("title"), F.lit(None).cast("string").alias("form"),
        F.lit(None).cast("string").alias("layers"), F.lit(None).cast("map<string,string>").alias("values"),
    )
    at = F.coalesce(F.col("division_id").cast("string"), F.lit(""))
    layers = F.create_map(F.lit(primary), F.col("text"))
    v = verses.select(
        F.col("book_id").alias("doc"), F.concat(own(at), F.lit("#"), F.col("id").cast("string")).alias("ref"), own(at).alias("parent_ref"), F.struct(F.lit(True).alias("verse"), F.col("ordinal").cast("long").alias("n")).alias("place"),
        F.when(at == "", 1).otherwise(F.size(F.split(at, "/")) + 1).alias("depth"), F.lit("verse").alias("kind"), F.col("id").cast("string").alias("id"), "number", F.lit(None).cast("string").alias("title"),
        F.when(F.col("form") == "verse", "verse").otherwise("prose").alias("form"), F.to_json(layers).alias("layers"), layers.alias("values"),
    )
    return d.unionByName(v)

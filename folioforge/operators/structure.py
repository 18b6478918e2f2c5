"""Books as rows: flattening a document tree, building it again, and checking it."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.window import Window

from ..functions.refs import GLOSS

UNITS = "book_id string, ref string, parent_ref string, depth int, ord string, kind string, id string, number string, layers map<string,string>, hash string, gloss_layers array<string>, title map<string,string>, form string"


@udtf(returnType=UNITS)
class FlattenBook:
    """Rows of a book document in reading order; a layer of glosses becomes its words, meanings and notes in the form that is hashed, and is named."""

    def eval(self, document: str) -> Iterator[tuple]:
        book = json.loads(document)
        stack = [(unit, book["id"], 1, f"{k:06d}") for k, unit in reversed(list(enumerate(book.get("structure") or [])))]
        while stack:
            unit, parent, depth, order = stack.pop()
            verse = "layers" in unit
            ref = f"{parent}#{unit['id']}" if verse else f"{parent}/{unit['id']}"
            own = unit.get("layers") or {}
            layers = {k: v if isinstance(v, str) else GLOSS.join(part for g in v for part in (g["word"], g["meaning"], g.get("note") or "")) for k, v in own.items()}
            glosses = [k for k, v in own.items() if not isinstance(v, str)]
            kind = "verse" if verse else unit["kind"]
            yield book["id"], ref, parent, depth, order, kind, unit["id"], unit.get("number"), layers if verse else None, unit.get("hash"), glosses, unit.get("title"), unit.get("form")
            stack += [(child, ref, depth + 1, f"{order}.{k:06d}") for k, child in reversed(list(enumerate(unit.get("children") or [])))]


def flatten_books(books: DataFrame, document: str = "document") -> DataFrame:
    """Units of book documents (JSON), one row each, with ref, parent, depth and a sort key."""
    return books.lateralJoin(FlattenBook(F.col(document).outer())).select(*(c.split(" ")[0] for c in UNITS.split(", ")))


def build_tree(units: DataFrame, depth: int) -> DataFrame:
    """(book_id, structure): the units nested again as JSON text, deepest first; divisions without verses go, divisions stand before verses. A row holds one book."""
    level = units.select("book_id", "ref", "parent_ref", "depth", "ord", "kind", "id", "number", "layers").withColumn("children", F.lit(None).cast("string"))
    done = None
    for d in range(depth, 0, -1):
        own = level.where(F.col("depth") == d).drop("children")
        if done is not None:
            own = own.join(done, [own["book_id"] == done["b"], own["ref"] == done["p"]], "left").drop("b", "p")
        else:
            own = own.withColumn("children", F.lit(None).cast("string"))
        verse = F.col("kind") == "verse"
        own = own.where(verse | F.col("children").isNotNull())
        fields = [F.concat(F.lit('"kind":'), F.to_json(F.array("kind"))), F.concat(F.lit('"id":'), F.to_json(F.array("id"))), F.concat(F.lit('"number":'), F.to_json(F.array("number")))]
        bare = [F.regexp_replace(f, '":\\[(.*)\\]$', '":$1') for f in fields]
        number = F.when(F.col("number").isNotNull(), bare[2])
        node = F.when(verse, F.concat(F.lit("{"), F.concat_ws(",", bare[1], number, F.concat(F.lit('"layers":'), F.to_json("layers"))), F.lit("}"))).otherwise(
            F.concat(F.lit("{"), F.concat_ws(",", bare[0], bare[1], number, F.concat(F.lit('"children":'), "children")), F.lit("}"))
        )
        rows = own.select(F.col("book_id").alias("b"), F.col("parent_ref").alias("p"), F.struct(verse.alias("v"), "ord", node.alias("n")).alias("s"))
        done = rows.groupBy("b", "p").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["n"]), ","), F.lit("]")).alias("children"))
    return done.select(F.col("b").alias("book_id"), F.col("children").alias("structure"))


def _issue(rows: DataFrame, code: str, path: F.Column, severity: str = "error") -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), path.cast("string").alias("path"))


def format_issue() -> F.Column:
    """An issue as one line."""
    return F.concat_ws("  ", F.rpad("severity", 5, " "), "path", F.concat(F.lit("["), "code", F.lit("]")))


def sibling_issues(units: DataFrame) -> DataFrame:
    """One issue, at the parent, for each further unit with an id that its parent has already."""
    n = F.row_number().over(Window.partitionBy("parent_ref", "id").orderBy("ord"))
    return _issue(units.withColumn("_n", n).where("_n > 1"), "duplicate-sibling-id", F.col("parent_ref"))


def layer_issues(units: DataFrame, declared: DataFrame, primary: DataFrame) -> DataFrame:
    """Undeclared layers of verses, layers of glosses where text is declared (or the other way round), and verses without the primary layer (unless that is undeclared itself).

    declared: (book_id, layer_id, kind); primary: (book_id, layer_id).
    """
    verses = units.where("kind = 'verse'")
    used = verses.select("book_id", "ref", F.explode(F.map_keys("layers")).alias("layer_id"), F.coalesce("gloss_layers", F.array().cast("array<string>")).alias("_g"))
    kinds = declared.groupBy("book_id", "layer_id").agg(F.max("kind").alias("_kind"))
    j = used.join(kinds, ["book_id", "layer_id"], "left")
    unknown = j.where("_kind IS NULL")
    other = j.where((F.col("_kind") == "wordMeanings") != F.array_contains("_g", F.col("layer_id")))
    known = primary.join(kinds, ["book_id", "layer_id"], "left_semi")
    missing = verses.join(known, "book_id").where(~F.array_contains(F.map_keys("layers"), F.col("layer_id")))
    return (
        _issue(unknown, "undeclared-layer", F.col("ref"))
        .unionByName(_issue(other, "layer-kind-mismatch", F.col("ref")))
        .unionByName(_issue(missing, "primary-layer-missing", F.col("ref")))
    )


def declaration_issues(declared: DataFrame, primary: DataFrame) -> DataFrame:
    """Layers (book_id, layer_id, kind, scheme, position) declared twice, transliterations without a scheme, and primary layers (book_id, layer_id) that are undeclared or no original."""
    n = F.row_number().over(Window.partitionBy("book_id", "layer_id").orderBy("position"))
    place = F.concat(F.lit("/layers/"), F.col("position").cast("string"))
    twice = declared.withColumn("_n", n).where("_n > 1")
    bare = declared.where("kind = 'transliteration' AND scheme IS NULL")
    last = declared.groupBy("book_id", "layer_id").agg(F.max_by("kind", "position").alias("_kind"))
    j = primary.join(last, ["book_id", "layer_id"], "left")
    here = F.lit("/primaryLayer")
    return (
        _issue(twice, "duplicate-layer-id", place)
        .unionByName(_issue(bare, "transliteration-scheme-missing", place, "warning"))
        .unionByName(_issue(j.where("_kind IS NULL"), "primary-layer-undeclared", here))
        .unionByName(_issue(j.where("_kind <> 'original'"), "primary-layer-not-original", here))
    )


#: What texts, tags and versions of a package must look like.
CONTROL, CONTROL_OR_LINE = "[\\x{0}-\\x{9}\\x{B}-\\x{1F}\\x{7F}-\\x{9F}]", "[\\x{0}-\\x{1F}\\x{7F}-\\x{9F}]"
LANGUAGE_TAG, SEMVER = "^[a-z]{2,3}(?:-[A-Za-z0-9]+)*$", "^[0-9]+\\.[0-9]+\\.[0-9]+$"


def schema_issues(rows: DataFrame, path: F.Column, segments: tuple[str, ...] = (), texts: tuple[str, ...] = (), lines: tuple[str, ...] = (), tags: tuple[str, ...] = (), versions: tuple[str, ...] = ()) -> DataFrame:
    """One issue for each column of a row that isn't what its kind demands: ids, texts (line feeds allowed), single lines, language tags, versions. Nulls pass."""
    from ..functions.refs import SEGMENT

    def wrong(c: str, pattern: str, wanted: bool) -> F.Column:
        return F.when(F.regexp_like(F.col(c), F.lit(pattern)) != F.lit(wanted), F.lit(c))

    marks = [
        *(wrong(c, f"^{SEGMENT}\\z", True) for c in segments),
        *(F.when((F.col(c) == "") | F.regexp_like(F.col(c), F.lit(CONTROL)), F.lit(c)) for c in texts),
        *(F.when((F.col(c) == "") | F.regexp_like(F.col(c), F.lit(CONTROL_OR_LINE)), F.lit(c)) for c in lines),
        *(wrong(c, LANGUAGE_TAG, True) for c in tags),
        *(wrong(c, SEMVER, True) for c in versions),
    ]
    found = rows.select(path.alias("_path"), F.explode(F.filter(F.array(*marks), lambda x: x.isNotNull())).alias("_c"))
    return _issue(found, "schema", F.concat_ws("/", "_path", "_c"))


def hash_issues(units: DataFrame, computed: F.Column) -> DataFrame:
    """Verses whose recorded hash isn't that of their layers."""
    return _issue(units.where("kind = 'verse' AND hash IS NOT NULL").where(F.col("hash") != computed), "hash-mismatch", F.col("ref"))


def alias_issues(aliases: DataFrame, live: DataFrame, book: str) -> DataFrame:
    """One issue at most, at the alias, for each side of it (source, target): unparseable, of another book, live source, or missing target."""
    from ..functions.refs import is_ref

    def side(name: str, last: str, wanted: bool) -> DataFrame:
        marks = live.select(F.col("ref").alias(name)).distinct().withColumn("_live", F.lit(True))
        rows = aliases.select(name, F.concat(F.lit("/aliases/"), "source").alias("path")).join(marks, name, "left")
        foreign = F.regexp_extract(F.col(name), "^[^/#]*", 0) != book
        code = F.when(~is_ref(F.col(name)), "alias-unparseable").when(foreign, "alias-foreign-book").when(F.col("_live").isNotNull() == F.lit(wanted), last)
        return rows.select(F.lit("error").alias("severity"), code.alias("code"), "path").where("code IS NOT NULL")

    return side("source", "alias-source-live", True).unionByName(side("target", "alias-target-missing", False))


def validate(units: DataFrame, declared: DataFrame, primary: DataFrame, computed: F.Column) -> DataFrame:
    """Declarations, layers, siblings and hashes of many books in one report."""
    parts = [declaration_issues(declared, primary), layer_issues(units, declared, primary), sibling_issues(units), hash_issues(units, computed)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

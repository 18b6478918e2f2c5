"""Splitting, merging, inserting, deleting and renumbering verses, as functions from tables to tables.

Verses are rows (book_id, division_id, id, ordinal, number, form, text, ocr_text, status, origin, lineage, confidence,
flags, pages) and may have further evidence (printed_pages, blocks, repairs, footnote_markers, orthography, revised
``ocr_changed``, ``orphaned`` …): columns that aren't named in a rule keep their values. Ordinals count from 0 in each
division without gaps, before and after. A batch of changes is applied from the end of each division, so every change sees
the ordinals of the input; refused changes leave the verses as they are.

Each function returns the verses with an ``action`` (null: untouched) and a ``note``, from which ``revisions`` are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t

KEYS = ["book_id", "division_id", "id"]
DIVISION = ["book_id", "division_id"]
MOST_SUFFIX = 99


def verse_id_for(number: Column, page: Column, ordinal: Column) -> Column:
    """``v<number>`` of a printed number in any script, else ``p<page>-<place>`` by where the verse stands (page 0: none is known)."""
    value = t.parse_number(number)["value"]
    place = F.concat(F.lit("p"), F.coalesce(page, F.lit(0)).cast("string"), F.lit("-"), (ordinal + 1).cast("string"))
    return F.when(value.isNotNull(), F.concat(F.lit("v"), value.cast("string"))).otherwise(place)


def _met(verses: DataFrame, changes: DataFrame, key: str = "id", **found: Column) -> DataFrame:
    """Verses and, for each, the aggregates ``found`` over the changes (book_id, division_id, key, …) to it; null where there are none.

    Changes lie beside the verses as rows, not in a join by id: this and all that follows meets within a division, so tables
    that are dealt by division already are dealt no more.
    """
    keys = [*DIVISION, key]
    types = {k: verses.schema[k].dataType for k in keys}
    named = changes.select(*(F.col(k).try_cast(types[k]).alias(k) for k in keys), *(c for c in changes.columns if c not in keys))
    named = named.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    both = verses.withColumn("_own", F.lit(True)).unionByName(named, allowMissingColumns=True)
    own = Window.partitionBy(*keys)
    return both.select(*verses.columns, "_own", *(f.over(own).alias(n) for n, f in found.items())).where("_own").drop("_own")


def free_ids(rows: DataFrame, wanted: str = "_wanted", order: str = "ordinal", most: int = MOST_SUFFIX) -> DataFrame:
    """Adds new_id to rows (book_id, division_id, id, wanted, …): the wanted id, else it with the least suffix from 2 that nobody has.

    Rows have an id (null: none yet) and may want one (null: they don't). Rows of a division that want the same id get it
    and its suffixes in their order; null where none is free up to ``most``. An id is told to those that want it, and the
    suffix it ends in to those that want what stands before, by rows of their own, so that no row is joined to others.
    """
    end = f"^(.+)-([2-9]|[1-9][0-9]{{1,{len(str(most)) - 1}}})$"
    # Only digits are cast: a cast that fails costs more than all the rest.
    wants, digits = F.col(wanted).isNotNull(), F.regexp_extract("id", end, 2)
    suffix = F.when(digits != "", digits.cast("int"))

    def told(key: Column, number: Column, own: bool) -> Column:
        return F.struct(key.alias("key"), number.alias("suffix"), F.lit(own).alias("own"))

    none = F.lit(None).cast("int")
    facts = F.array(told(F.coalesce(wanted, "id"), none, True), F.when(wants & F.col("id").isNotNull(), told(F.col("id"), none, False)), F.when(suffix <= most, told(F.regexp_extract("id", end, 1), suffix, False)))
    out = rows.withColumn("_fact", F.explode(facts)).where("_fact IS NOT NULL")
    # Rows that only tell of an id carry nothing else.
    out = out.select(*DIVISION, *(F.when(F.col("_fact.own"), F.col(c)).alias(c) for c in rows.columns if c not in DIVISION), "_fact").withColumn("_turn", F.col("_fact.own") & wants)
    before = Window.partitionBy(*DIVISION, "_fact.key").orderBy("_turn", order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.select(
        *rows.columns, "_fact", "_turn",
        F.max(F.when(~F.col("_turn") & F.col("_fact.suffix").isNull(), True)).over(before).alias("_taken"),
        F.count(F.when(F.col("_turn"), 1)).over(before).cast("int").alias("_n"),
        F.collect_set("_fact.suffix").over(before).alias("_used"),
    ).where("_fact.own")
    left = F.array_except(F.sequence(F.lit(2), F.lit(most)), F.col("_used"))
    next_one = F.concat(F.col(wanted), F.lit("-"), F.get(left, F.col("_n") - F.when(F.col("_taken"), 1).otherwise(2)).cast("string"))
    new = F.when(F.col("_turn"), F.when(F.col("_taken").isNull() & (F.col("_n") == 1), F.col(wanted)).otherwise(next_one))
    return out.select(*rows.columns, new.alias("new_id"))


def renumbered(verses: DataFrame, *order: str | Column) -> DataFrame:
    """Ordinals from 0 without gaps within each division."""
    n = F.row_number().over(Window.partitionBy(*DIVISION).orderBy(*order))
    return verses.withColumn("ordinal", (n - 1).cast("long"))


def _without(flags: Column, *names: str) -> Column:
    return F.filter(flags, lambda f: ~f.isin(*names))


def _ref(id_: str | Column) -> Column:
    return F.concat_ws("#", F.col("division_id").cast("string"), F.col(id_) if isinstance(id_, str) else id_)


def split(verses: DataFrame, cuts: DataFrame) -> DataFrame:
    """Verses after cuts (book_id, division_id, id, offset), one for a verse at most; offsets are code points.

    A cut must leave text on both sides. The head keeps its id and number and is raw again; the tail has no number, the
    evidence of the whole, an id by its place, and the head in its lineage.
    """
    head = t.trim_end(F.left("text", F.col("_offset")))
    tail = t.trim_start(F.substr("text", F.col("_offset") + 1))
    ok = F.col("_offset").between(1, F.length("text") - 1) & (head != "") & (tail != "")
    rows = _met(verses, cuts.select(*KEYS, F.col("offset").alias("_at")), _offset=F.max("_at"))
    rows = free_ids(rows.withColumn("_wanted", F.when(ok, verse_id_for(F.lit(None).cast("string"), F.get("pages", F.lit(0)), F.col("ordinal") + 1))))
    rows = rows.withColumn("_cut", F.col("new_id").isNotNull())
    rows = rows.withColumn("_part", F.explode(F.when(F.col("_cut"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    is_tail, is_head = F.col("_part") == 1, F.col("_cut") & (F.col("_part") == 0)
    note = F.when(is_tail, F.concat(F.lit("Split off "), _ref("id"), F.lit("."))).when(is_head, F.concat(F.lit("Split at character "), F.col("_offset").cast("string"), F.lit("; the rest became "), F.col("new_id"), F.lit(".")))
    changes = {
        "id": F.when(is_tail, F.col("new_id")).otherwise(F.col("id")),
        "number": F.when(~is_tail, F.col("number")),
        "text": F.when(is_tail, tail).when(is_head, head).otherwise(F.col("text")),
        "ocr_text": F.when(is_tail, tail).otherwise(F.col("ocr_text")),
        "status": F.when(is_tail | is_head, F.lit("raw")).otherwise(F.col("status")),
        "origin": F.when(is_tail, F.lit("split")).otherwise(F.col("origin")),
        "lineage": F.when(is_tail, F.array(_ref("id"))).otherwise(F.col("lineage")),
        "flags": F.when(is_tail, F.array_union("flags", F.array(F.lit("no-number")))).otherwise(F.col("flags")),
        **{c: F.when(~is_tail, F.col(c)).otherwise(F.array().cast(verses.schema[c].dataType.simpleString())) for c in ("repairs", "footnote_markers") if c in verses.columns},
        **({"orthography": F.when(~is_tail, F.col("orthography"))} if "orthography" in verses.columns else {}),
    }
    out = rows.select("_part", F.when(is_tail | is_head, F.lit("split")).alias("action"), note.alias("note"), *(changes.get(c, F.col(c)).alias(c) for c in verses.columns))
    return renumbered(out, "ordinal", "_part").drop("_part").select(*verses.columns, "action", "note")


def merge(verses: DataFrame, merges: DataFrame) -> DataFrame:
    """Verses after merges (book_id, division_id, id, direction): each named verse and the one next to it become the first of both.

    A chain of merges becomes one verse. Texts join with a space; pages, flags, lineage and evidence are united; the
    survivor is raw again. A verse without a neighbour on that side, in its division, stays as it is.
    """
    w = Window.partitionBy(*DIVISION).orderBy("ordinal")
    rows = _met(verses, merges.select(*KEYS, F.col("direction").alias("_way")), _next=F.bool_or(F.col("_way") == "next"), _prev=F.bool_or(F.col("_way") == "previous"))
    taken = F.coalesce(F.lag("_next").over(w), F.lit(False)) | (F.coalesce("_prev", F.lit(False)) & F.lag("id").over(w).isNotNull())
    rows = rows.withColumn("_taken", taken).withColumn("_group", F.sum(F.when(~F.col("_taken"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    fields = [c for c in verses.columns if c not in DIVISION]
    # A group is a chain of merges: as long as somebody asked for.
    groups = rows.groupBy(*DIVISION, "_group").agg(F.array_sort(F.collect_list(F.struct(F.col("ordinal").alias("_o"), *fields)), lambda a, b: F.when(a["_o"] < b["_o"], -1).when(a["_o"] > b["_o"], 1).otherwise(0)).alias("v"))
    first, rest, several = F.col("v")[0], F.slice("v", F.lit(2), F.greatest(F.size("v") - 1, F.lit(0))), F.size("v") > 1

    def all_of(c: str) -> Column:
        return F.flatten(F.transform("v", lambda x: F.coalesce(x[c], F.array().cast(verses.schema[c].dataType.simpleString()))))

    text = F.aggregate(rest, first["text"], lambda acc, x: F.concat(t.trim_end(acc), F.lit(" "), t.trim_start(x["text"])))
    number = first["number"]
    flags = F.filter(F.array_distinct(all_of("flags")), lambda f: (f != "very-short") & ~((f == "no-number") & number.isNotNull()))
    ids = F.transform(rest, lambda x: F.concat(F.coalesce(x["lineage"], F.array().cast("array<string>")), F.array(_ref(x["id"]))))
    changes = {
        "text": text,
        "status": F.lit("raw"),
        "pages": F.array_sort(F.array_distinct(all_of("pages"))),
        "flags": flags,
        "lineage": F.array_distinct(F.concat(F.coalesce(first["lineage"], F.array().cast("array<string>")), F.flatten(ids))),
        **{c: F.array_distinct(all_of(c)) for c in ("printed_pages", "footnote_markers") if c in verses.columns},
        **{c: all_of(c) for c in ("blocks", "repairs") if c in verses.columns},
    }
    note = F.concat(F.lit("Merged "), F.array_join(F.transform(rest, lambda x: x["id"]), ", "), F.lit(" into "), first["id"], F.lit("."))
    out = groups.select(*DIVISION, *(F.when(several, changes[c]).otherwise(first[c]).alias(c) if c in changes else first[c].alias(c) for c in fields), F.when(several, F.lit("merge")).alias("action"), F.when(several, note).alias("note"))
    return renumbered(out, "ordinal").select(*verses.columns, "action", "note")


def insert(verses: DataFrame, new: DataFrame) -> DataFrame:
    """Verses with new ones (book_id, division_id, after, place, text, number) put behind the verse ``after`` (null: first); several in the order of ``place``.

    A new verse is raw, has no reading, and takes form and pages from the verse before it; without a number it is flagged.
    New rows whose ``after`` doesn't exist are refused.
    """
    named = new.select(*(F.col(k).try_cast(verses.schema[k].dataType).alias(k) for k in DIVISION), *(F.struct(F.col("after").cast("string").alias("after"), F.col("place").cast("long").alias("place"), F.col("text").cast("string").alias("text"), F.col("number").cast("string").alias("number")).alias("_new"),))
    rows = verses.withColumn("_new", F.lit(None).cast(named.schema["_new"].dataType)).unionByName(named, allowMissingColumns=True)
    # The verse that a new one stands behind is the one with its key.
    rows = rows.withColumn("_fresh", F.col("_new").isNotNull()).withColumn("_beside", F.coalesce("id", "_new.after"))
    behind = F.max(F.when(~F.col("_fresh"), F.struct(F.col("ordinal"), F.col("form"), F.col("pages")))).over(Window.partitionBy(*DIVISION, "_beside"))
    rows = rows.withColumn("_behind", F.when(F.col("_new.after").isNotNull(), behind)).where(~F.col("_fresh") | F.col("_new.after").isNull() | F.col("_behind").isNotNull())
    no_pages = F.array().cast(verses.schema["pages"].dataType.simpleString())
    rows = rows.withColumn("ordinal", F.when(F.col("_fresh"), F.coalesce(F.col("_behind.ordinal") + 1, F.lit(0)).cast("long")).otherwise(F.col("ordinal")))
    rows = rows.withColumn("pages", F.when(F.col("_fresh"), F.coalesce("_behind.pages", no_pages)).otherwise(F.col("pages")))
    wanted = F.when(F.col("_fresh"), verse_id_for(F.col("_new.number"), F.try_element_at("pages", F.lit(-1)), F.col("ordinal")))
    # Fresh rows come before the verse whose place they take.
    rows = free_ids(rows.withColumn("_wanted", wanted).withColumn("_place", F.struct("ordinal", F.when(F.col("_fresh"), 0).otherwise(1).alias("old"), "_new.place")), order="_place")
    rows = rows.where(~F.col("_fresh") | F.col("new_id").isNotNull())
    bare = F.array().cast("array<string>")
    fresh = {
        "book_id": F.col("book_id"), "division_id": F.col("division_id"), "id": F.col("new_id"), "ordinal": F.col("ordinal"), "number": F.col("_new.number"), "form": F.coalesce("_behind.form", F.lit("prose")), "text": F.col("_new.text"),
        "ocr_text": F.lit(""), "status": F.lit("raw"), "origin": F.lit("inserted"), "lineage": bare, "flags": F.when(F.col("_new.number").isNull(), F.array(F.lit("no-number"))).otherwise(bare), "pages": F.col("pages"),
        "orphaned": F.lit(False), "ocr_changed": F.lit(False),
    }
    types = {f.name: f.dataType.simpleString() for f in verses.schema.fields}
    kept = (F.when(F.col("_fresh"), fresh.get(c, F.lit(None)).cast(types[c])).otherwise(F.col(c)).alias(c) for c in verses.columns)
    note = F.when(F.col("_fresh"), F.lit("Typed in by hand: the reading has no such passage.")).alias("note")
    return renumbered(rows.select(*kept, "_place", F.when(F.col("_fresh"), F.lit("insert")).alias("action"), note), "_place").select(*verses.columns, "action", "note")


def delete(verses: DataFrame, gone: DataFrame) -> DataFrame:
    """Verses without some of them (book_id, division_id, id); ordinals close up."""
    rows = _met(verses, gone.select(*KEYS, F.lit(True).alias("_mark")), _gone=F.max("_mark")).where("_gone IS NULL")
    return renumbered(rows, "ordinal").select(verses.columns)


def renumber(verses: DataFrame, changes: DataFrame) -> DataFrame:
    """Verses after changes (book_id, division_id, id, number; null: it has none): ids follow the numbers, the old ids join the lineage."""
    marks = changes.select(*KEYS, F.col("number").cast("string").alias("_given"), F.lit(True).alias("_mark"))
    rows = _met(verses, marks, _number=F.max("_given"), _m=F.max("_mark"))
    rows = rows.withColumn("_id", F.when(F.col("_m"), verse_id_for(F.col("_number"), F.get("pages", F.lit(0)), F.col("ordinal"))))
    rows = free_ids(rows.withColumn("_wanted", F.when(F.col("_id") != F.col("id"), F.col("_id"))))
    rows = rows.withColumn("new_id", F.when(F.col("_id") == F.col("id"), F.col("id")).otherwise(F.col("new_id")))  # one's own id is free
    rows = rows.withColumn("_m", F.col("_m") & F.col("new_id").isNotNull())
    flags = _without(F.col("flags"), "no-number")
    changed = {
        "id": F.coalesce("new_id", "id"),
        "number": F.when(F.col("_m"), F.col("_number")).otherwise(F.col("number")),
        "flags": F.when(F.col("_m"), F.when(F.col("_number").isNull(), F.concat(flags, F.array(F.lit("no-number")))).otherwise(flags)).otherwise(F.col("flags")),
        "lineage": F.when(F.col("_m"), F.array_union("lineage", F.array(_ref("id")))).otherwise(F.col("lineage")),
    }
    note = F.when(F.col("_m") & (F.col("new_id") != F.col("id")), F.concat(F.lit("Id followed the number: "), "id", F.lit(" to "), "new_id", F.lit(".")))
    return rows.select(*(changed.get(c, F.col(c)).alias(c) for c in verses.columns), F.when(F.col("_m"), F.lit("renumber")).alias("action"), note.alias("note"))


def revisions(changed: DataFrame) -> DataFrame:
    """The revision rows of changed verses: what was done to each, and how it stands after it."""
    return changed.where("action IS NOT NULL").select(*KEYS, "action", "text", "status", "number", "note")

"""The proofing database as DataFrame operators: queues, counts, neighbours, and row changes as functions of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATUSES = ("raw", "proofed", "approved")
PREVIEW, DEFAULT_LIMIT, MOST, HISTORY = 120, 50, 200, 50


def status_counts(rows: DataFrame, group: list[str], statuses: tuple[str, ...], status: str = "status") -> DataFrame:
    """One row for each group: a count for each status (zero where there is none) and the total."""
    return rows.groupBy(*group).agg(*(F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in statuses), F.count("*").alias("total"))


def flag_counts(rows: DataFrame, flags: str = "flags") -> DataFrame:
    """(flag, n) over an array column, most first (ties by flag)."""
    return rows.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "flag")


def conditions(
    book: str | int | None = None, status: str | None = None, division: str | int | None = None, ocr_changed: bool | None = None, orphaned: bool | None = False, flag: str | None = None, page: int | None = None
) -> Column:
    """The conjunction of the filters that are given."""
    out = F.lit(True)
    for name, value in (("book_id", book), ("status", status), ("division_id", division), ("ocr_changed", ocr_changed), ("orphaned", orphaned)):
        if value is not None:
            out = out & (F.col(name) == value)
    if flag is not None:
        out = out & F.array_contains("flags", flag)
    if page is not None:
        out = out & F.array_contains("pages", page)
    return out


def queue(verses: DataFrame, divisions: DataFrame, where: Column, by_confidence: bool = True, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """A page of the proofing queue: worst first (no confidence last) or in book order, with texts cut to a preview."""
    joined = verses.where(where).join(divisions.select(F.col("book_id"), F.col("id").alias("division_id"), F.col("ordinal").alias("division_ordinal")), ["book_id", "division_id"], "left")
    order = [F.col("division_ordinal").asc_nulls_last(), F.col("ordinal").asc_nulls_last(), F.col("book_id"), F.col("division_id")]
    if by_confidence:
        order = [F.col("confidence").asc_nulls_last(), *order]
    return (
        joined.orderBy(*order)
        .offset(offset)
        .limit(min(limit, MOST))
        .select("book_id", "division_id", "id", "ordinal", "division_ordinal", "status", "confidence", (F.col("text") != F.col("ocr_text")).alias("edited"), F.length("text").cast("long").alias("chars"), F.left("text", F.lit(PREVIEW)).alias("preview"))
    )


def neighbours(verses: DataFrame, divisions: DataFrame) -> DataFrame:
    """Each verse that isn't orphaned with the ids before and after it in book order."""
    rows = verses.where(~F.col("orphaned")).join(divisions.select("book_id", F.col("id").alias("division_id"), F.col("ordinal").alias("division_ordinal")), ["book_id", "division_id"])
    w = Window.partitionBy("book_id").orderBy("division_ordinal", "ordinal")
    ref = F.concat_ws("#", F.col("division_id").cast("string"), F.col("id").cast("string"))
    return rows.select("book_id", "division_id", "id", F.lag(ref).over(w).alias("previous"), F.lead(ref).over(w).alias("next"))


def books_with_counts(books: DataFrame, rows: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Every book with its status counts, zero where it has no rows."""
    counts = status_counts(rows, ["book_id"], statuses)
    names = [c for c in counts.columns if c != "book_id"]
    return books.join(counts, "book_id", "left").fillna(0, subset=names)


def book_overview(books: DataFrame, divisions: DataFrame, verses: DataFrame, notes: DataFrame, set_aside: DataFrame) -> DataFrame:
    """Books (book_id, …) with their counts: live passages by status, orphaned ones (of known divisions), divisions, notes, blocks set aside and those unresolved."""
    known = verses.join(divisions.select("book_id", F.col("id").alias("division_id")), ["book_id", "division_id"], "left_semi")
    parts = [
        status_counts(verses.where(~F.col("orphaned")), ["book_id"], STATUSES),
        known.groupBy("book_id").agg(F.count_if("orphaned").alias("orphaned")),
        divisions.groupBy("book_id").agg(F.count("*").alias("divisions")),
        notes.groupBy("book_id").agg(F.count("*").alias("notes")),
        set_aside.groupBy("book_id").agg(F.count("*").alias("set_aside"), F.count_if(~F.col("resolved")).alias("set_aside_unresolved")),
    ]
    out = books
    for p in parts:
        out = out.join(p, "book_id", "left")
    return out.fillna(0, [c for p in parts for c in p.columns if c != "book_id"])


def queue_total(verses: DataFrame, where: Column) -> DataFrame:
    """One row: how many verses the whole queue has."""
    return verses.where(where).agg(F.count("*").alias("total"))


def with_evidence(verses: DataFrame, evidence: DataFrame) -> DataFrame:
    """Verses (ref, …) with the evidence of their ref (nulls where there is none)."""
    return verses.join(evidence, "ref", "left")


def existing(rows: DataFrame, others: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds whether a row's key is among others."""
    marks = others.select(*keys).distinct().withColumn(name, F.lit(True))
    return rows.join(marks, keys, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def remaining(wanted: DataFrame, kept: DataFrame, keys: list[str], source: str) -> DataFrame:
    """What is still to do: rows of wanted without a kept row of the same key and source hash."""
    return wanted.join(kept.select(*keys, source), [*keys, source], "left_anti")


def last_writer(rows: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """One row for each key: that of the highest rank."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(rank)))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def import_draft(old: DataFrame, new: DataFrame) -> DataFrame:
    """The verses after a re-import, with what happened to each.

    old: (book_id, division_id, id, number, text, ocr_text, status, ocr_changed, orphaned, origin, confidence);
    new: (book_id, division_id, id, number, text, confidence). A verse nobody touched (raw, text as read) takes the new
    draft whole. A touched one keeps its text and number; its reading moves, and if that changed it goes back to raw.
    Imported verses that the draft no longer has are orphaned, and come back when it has them again.
    """
    keys = ["book_id", "division_id", "id"]
    n = new.select(*keys, F.col("number").alias("new_number"), F.col("text").alias("new_text"), F.col("confidence").alias("new_confidence"), F.lit(True).alias("_new"))
    j = old.withColumn("_old", F.lit(True)).join(n, keys, "full_outer")
    have, come = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    untouched = (F.col("status") == "raw") & F.col("text").eqNullSafe(F.col("ocr_text"))
    changed = ~F.col("ocr_text").eqNullSafe(F.col("new_text"))
    take = come & (~have | untouched)
    reset = come & have & ~untouched & changed
    gone = have & ~come & (F.col("origin") == "imported")
    action = F.when(come & ~have, "inserted").when(reset, "reset").when(come, "refreshed").when(gone, "orphaned").otherwise("kept")
    return j.select(
        *keys,
        F.when(take, F.col("new_number")).otherwise(F.col("number")).alias("number"),
        F.when(take, F.col("new_text")).otherwise(F.col("text")).alias("text"),
        F.when(come, F.col("new_text")).otherwise(F.col("ocr_text")).alias("ocr_text"),
        F.when(take | reset, F.lit("raw")).otherwise(F.col("status")).alias("status"),
        F.when(take, F.lit(False)).when(come, changed).otherwise(F.col("ocr_changed")).alias("ocr_changed"),
        F.when(come, F.lit(False)).when(gone, F.lit(True)).otherwise(F.col("orphaned")).alias("orphaned"),
        F.coalesce("origin", F.lit("imported")).alias("origin"),
        F.when(come, F.col("new_confidence")).otherwise(F.col("confidence")).alias("confidence"),
        action.alias("action"),
        (come & F.coalesce("orphaned", F.lit(False))).alias("restored"),
    )


def upsert_divisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Divisions (book_id, id, ordinal, kind, title) after an import: order and kind are the draft's, a known title stays."""
    n = new.select("book_id", "id", F.col("ordinal").alias("_o"), F.col("kind").alias("_k"), F.col("title").alias("_t"), F.lit(True).alias("_new"))
    j = old.withColumn("_old", F.lit(True)).join(n, ["book_id", "id"], "full_outer")
    return j.select("book_id", "id", F.coalesce("_o", "ordinal").alias("ordinal"), F.coalesce("_k", "kind").alias("kind"), F.when(F.col("_old"), F.col("title")).otherwise(F.col("_t")).alias("title"))


def upsert_notes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Notes (book_id, page, block_id, text, ocr_text, status) after an import: text follows the reading where nobody touched it; none goes."""
    keys = ["book_id", "page", "block_id"]
    j = old.withColumn("_old", F.lit(True)).join(new.select(*keys, F.col("text").alias("_t")), keys, "full_outer")
    untouched = F.col("_old").isNull() | ((F.col("status") == "raw") & F.col("text").eqNullSafe(F.col("ocr_text")))
    come = F.col("_t").isNotNull()
    return j.select(*keys, F.when(come & untouched, F.col("_t")).otherwise(F.col("text")).alias("text"), F.coalesce("_t", "ocr_text").alias("ocr_text"), F.coalesce("status", F.lit("raw")).alias("status"))


def upsert_set_aside(old: DataFrame, new: DataFrame) -> DataFrame:
    """Blocks set aside (book_id, page, block_id, text, resolved) after an import: vanished ones go, a changed text is unresolved again."""
    keys = ["book_id", "page", "block_id"]
    j = old.select(*keys, F.col("text").alias("_t"), F.col("resolved").alias("_r")).join(new.select(*keys, "text"), keys, "right_outer")
    return j.select(*keys, "text", F.coalesce(F.col("_r") & F.col("_t").eqNullSafe(F.col("text")), F.lit(False)).alias("resolved"))


def patch_verses(verses: DataFrame, patches: DataFrame) -> DataFrame:
    """Verses after patches (book_id, division_id, id, text, number, status; null: leave), with the revision's action (null: nothing changed)."""
    keys = ["book_id", "division_id", "id"]
    j = verses.join(patches.select(*keys, *(F.col(c).alias(f"_{c}") for c in ("text", "number", "status"))), keys, "left")

    def moved(c: str) -> Column:
        return F.col(f"_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}"))

    action = F.when(moved("number"), "renumber").when(moved("text"), "edit").when(moved("status"), "status")
    out = j.withColumn("action", action).withColumn("ocr_changed", F.when(moved("text"), F.lit(False)).otherwise(F.col("ocr_changed")))
    for c in ("text", "number", "status"):
        out = out.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return out


def page_context(verses: DataFrame, notes: DataFrame, set_aside: DataFrame, book: object, page: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stands on one page: its verses, notes and blocks set aside."""
    own = (F.col("book_id") == book) & (F.col("page") == page)
    return verses.where((F.col("book_id") == book) & F.array_contains("pages", page)).orderBy("division_id", "ordinal"), notes.where(own), set_aside.where(own)


def delete_books(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Working tables without some books; releases stay."""
    return {name: t if name == "releases" else t.join(gone.select("book_id"), "book_id", "left_anti") for name, t in tables.items()}

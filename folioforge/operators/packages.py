"""Packages and their metadata: localised titles, merged metadata, drafts, and the gates before export and publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.refs import bump_between
from .versions import latest


def pick_localized(entries: Column, tag: Column) -> Column:
    """The text for a language tag among ordered entries (tag, text): the tag itself, else its base language, else the first."""
    base = lambda c: F.split(F.lower(c), "-")[0]
    exact = F.filter(entries, lambda e: e["tag"] == tag)
    near = F.filter(entries, lambda e: base(e["tag"]) == base(tag))
    first = lambda a: F.get(a, F.lit(0))["text"]
    return F.coalesce(first(exact), first(near), first(entries))


def merge_metadata(*levels: dict[str, Column]) -> list[Column]:
    """Fields from several levels, later ones before earlier ones where they aren't null."""
    names = list(dict.fromkeys(n for level in levels for n in level))
    return [F.coalesce(*(level[n] for level in reversed(levels) if n in level)).alias(n) for n in names]


def patch_map(old: Column, patch: Column) -> Column:
    """A map with the entries of another one put over its own."""
    keep = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(patch), k))
    return F.map_concat(keep, patch)


def printed_pages(sources: list[DataFrame]) -> DataFrame:
    """(page, printed): the first printed number known for a page over tables (page, printed) in the order of trust."""
    rows = [t.select("page", "printed", F.lit(k).alias("rank")) for k, t in enumerate(sources)]
    all_ = rows[0]
    for t in rows[1:]:
        all_ = all_.unionByName(t)
    return all_.groupBy("page").agg(F.min_by("printed", F.when(F.col("printed").isNotNull(), F.struct("rank", "printed"))).alias("printed"))


def find_pages(books: DataFrame, manifests: DataFrame) -> DataFrame:
    """Books (source_sha256) with the folder of the first manifest (dir, source_sha256, scan_order) of the same source."""
    found = manifests.groupBy("source_sha256").agg(F.min_by("dir", "scan_order").alias("pages_dir"))
    return books.join(found, "source_sha256", "left")


def batches(pages: DataFrame, keys: list[str], order: str, size: int = 10) -> DataFrame:
    """Adds batch: pages in jobs of ``size``, in order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return pages.withColumn("batch", F.floor((n - 1) / size))


def run_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Pages read and failed, characters, and the worst page of each run (page, chars, score, error)."""
    ok = F.col("error").isNull()
    return results.groupBy(*keys).agg(
        F.count_if(ok).alias("pages_read"), F.count_if(~ok).alias("pages_failed"), F.sum(F.when(ok, F.col("chars")).otherwise(0)).alias("chars"), F.min_by("page", F.when(ok, F.struct("score", "page"))).alias("worst_page")
    )


def unknown_fields(edition: Column, license_id: Column, script: Column, title_gu: Column) -> Column:
    """What only a person can settle about a book: its edition, its licence, and in Gujarati script its title as printed."""
    marks = [
        F.when(edition.isNull() | (edition == "unknown"), F.lit("source.edition")),
        F.when(license_id.isNull() | (license_id == "unknown"), F.lit("license.id")),
        F.when((script == "gujr") & title_gu.isNull(), F.lit("title.gu")),
    ]
    return F.filter(F.array(*marks), lambda x: x.isNotNull())


def export_gates(books: DataFrame, verses: DataFrame, releases: DataFrame, existing: DataFrame, unreadable: DataFrame) -> DataFrame:
    """(book_id, code, detail): what keeps books (book_id, version, unknown) from being exported.

    A book needs passages, all of them approved (orphaned ones don't count), nothing left that only a person can settle, a
    version (book_id, version) that no package has yet and that is newer than the latest release (book_id,
    content_version), and that release must be readable.
    """
    n = verses.where("NOT orphaned").groupBy("book_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "approved").alias("ok"), F.count_if(F.col("status") == "proofed").alias("proofed"), F.count_if(F.col("status") == "raw").alias("raw"))
    last = latest(releases.select("book_id", "content_version"), ["book_id"], "content_version").withColumnRenamed("content_version", "last")
    lost = unreadable.select("book_id", F.col("content_version").alias("last")).distinct().withColumn("lost", F.lit(True))
    j = books.join(n, "book_id", "left").join(existing.select("book_id", "version").distinct().withColumn("made", F.lit(True)), ["book_id", "version"], "left")
    j = j.join(last.join(lost, ["book_id", "last"], "left"), "book_id", "left")
    waiting = F.concat_ws(" ", F.lit("proofed"), F.col("proofed").cast("string"), F.lit("raw"), F.col("raw").cast("string"))

    def gate(cond: Column, code: str, detail: Column) -> Column:
        return F.when(cond, F.array(F.struct(F.lit(code).alias("code"), detail.cast("string").alias("detail")))).otherwise(F.array().cast("array<struct<code:string,detail:string>>"))

    gates = F.concat(
        gate(F.col("n").isNull(), "no-passages", F.lit("")),
        gate(F.col("ok") < F.col("n"), "not-approved", waiting),
        F.transform("unknown", lambda u: F.struct(F.lit("still-unknown").alias("code"), u.alias("detail"))),
        gate(F.coalesce("made", F.lit(False)), "package-exists", F.col("version")),
        gate(F.coalesce(bump_between(F.col("last"), F.col("version")).isNull() & F.col("last").isNotNull(), F.lit(False)), "version-not-newer", F.col("last")),
        gate(F.coalesce("lost", F.lit(False)), "release-unreadable", F.col("last")),
    )
    return j.select("book_id", F.inline(gates))


def publish_gates(candidates: DataFrame, releases: DataFrame, unreadable: DataFrame, audits: DataFrame) -> DataFrame:
    """(book_id, code, detail): what keeps packages from being published.

    candidates: (book_id, version, package_id, package_version, package_status), null where the package can't be read;
    audits: (book_id, severity, code, path) against the latest release, of which the errors count.
    """
    released = releases.select("book_id", F.col("content_version").alias("version")).distinct().withColumn("released", F.lit(True))
    last = latest(releases.select("book_id", "content_version"), ["book_id"], "content_version").withColumnRenamed("content_version", "last")
    lost = unreadable.select("book_id", F.col("content_version").alias("last")).distinct().withColumn("lost", F.lit(True))
    j = candidates.join(released, ["book_id", "version"], "left").join(last.join(lost, ["book_id", "last"], "left"), "book_id", "left")
    readable = F.col("package_id").isNotNull()
    marks = [
        (~readable, "package-unreadable", F.col("version")),
        (readable & (F.col("package_id") != F.col("book_id").cast("string")), "package-of-another-book", F.col("package_id")),
        (readable & (F.col("package_version") != F.col("version")), "package-version-differs", F.col("package_version")),
        (readable & (F.col("package_status") != "proofed"), "package-not-proofed", F.col("package_status")),
        (readable & F.col("released"), "version-released", F.col("version")),
        (readable & F.col("lost"), "release-unreadable", F.col("last")),
    ]
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), d.cast("string").alias("detail"))) for c, code, d in marks)), lambda x: x.isNotNull())
    own = j.select("book_id", F.inline(found))
    errors = audits.where("severity = 'error'").join(candidates.where(readable).select("book_id"), "book_id", "left_semi")
    return own.unionByName(errors.select("book_id", "code", F.col("path").alias("detail")))


def verse_history(revisions: DataFrame, verse: str, most: int = 50) -> DataFrame:
    """The newest revisions of a verse."""
    return revisions.where(F.col("verse_key") == verse).orderBy(F.desc("at"), "id").limit(most)


def font_usage(declared: DataFrame, drawn: DataFrame) -> DataFrame:
    """Declared fonts (path, name) with a mark whether a page draws with them (path, font_names)."""
    used = drawn.select("path", F.explode("font_names").alias("name")).distinct().withColumn("used", F.lit(True))
    return declared.join(used, ["path", "name"], "left").withColumn("used", F.coalesce("used", F.lit(False)))

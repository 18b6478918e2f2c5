"""Working tables of books as versions: an import rewrites the books it touches, in all tables at once, or nothing.

A version is one row that names an attempt and its tables. The attempt holds the list of the touched books and their rows
in those tables from then on; both are written first, by many tasks, the version's row last, in one file. So a failed import
leaves the version before it as it was, other books' files are never rewritten, and older versions can still be read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import studio
from .ledger import read_or_empty
from .shared import dealt, materialize


class Conflict(RuntimeError):
    """Another writer has made a version since this one read its own."""


class BookStore:
    """Tables (name: schema as DDL, with a ``book_id string``) below ``path``."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]):
        self.spark, self.path = spark, path.rstrip("/")
        self.schemas = {name: T.StructType.fromDDL(ddl) for name, ddl in schemas.items()}
        self.manifest = T.StructType.fromDDL("version long, attempt string, names array<string>, at timestamp")

    def _versions(self) -> DataFrame:
        """(version, attempt, names): of two writers of one version the first to record it counts."""
        rows = read_or_empty(self.spark, f"{self.path}/versions", self.manifest)
        return rows.groupBy("version").agg(F.min(F.struct("at", "attempt", "names")).alias("x")).select("version", "x.attempt", "x.names")

    def _manifest(self, name: str) -> DataFrame:
        """(book_id, version, attempt): the books that each version replaced in a table. Versions are sent to all tasks, a row for each commit."""
        touched = read_or_empty(self.spark, f"{self.path}/books", T.StructType.fromDDL("book_id string, attempt string"))
        return touched.join(F.broadcast(self._versions().where(F.array_contains("names", name))), "attempt").select("book_id", "version", "attempt")

    def version(self) -> int:
        """The current version; 0 before anything was written."""
        return self._versions().agg(F.max("version")).first()[0] or 0

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version (None: the current one)."""
        m = self._manifest(name)
        if version is not None:
            m = m.where(F.col("version") <= version)
        current = m.groupBy("book_id").agg(F.max_by("attempt", "version").alias("attempt"))
        schema = T.StructType([*self.schemas[name].fields, T.StructField("attempt", T.StringType())])
        rows = read_or_empty(self.spark, f"{self.path}/data/{name}", schema)
        return rows.join(current, ["book_id", "attempt"], "left_semi").select(*self.schemas[name].names)

    def commit(self, changes: dict[str, DataFrame], books: DataFrame, expected: int) -> int:
        """Replaces all rows of ``books`` (book_id) in the tables of ``changes`` by theirs; returns the new version.

        Rows of other books in ``changes`` are left out. A table without rows for a book has none of it from then on.
        ``expected`` is the version that the changes were made from: if there is another one by now, nothing changes.
        """
        if self.version() != expected:
            raise Conflict(f"version {expected} is no longer the current one")
        attempt = uuid.uuid4().hex
        named = f"{self.path}/books/attempt={attempt}"
        books.select(F.col("book_id").cast("string").alias("book_id")).where("book_id IS NOT NULL").distinct().write.parquet(named)
        touched = self.spark.read.schema("book_id string").parquet(named)
        for name, rows in changes.items():
            own = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schemas[name])).join(touched, "book_id", "left_semi")
            own.sortWithinPartitions("book_id").write.parquet(f"{self.path}/data/{name}/attempt={attempt}")
        self._record(list(changes), expected + 1, attempt)
        if self._versions().where((F.col("version") == expected + 1) & (F.col("attempt") == attempt)).isEmpty():
            raise Conflict(f"version {expected + 1} was made by another writer")
        return expected + 1

    def _record(self, names: list[str], version: int, attempt: str) -> None:
        row = self.spark.createDataFrame([(version, attempt, names)], "version long, attempt string, names array<string>").withColumn("at", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def delete_books(self, books: DataFrame) -> int:
        """A version without some books, in all tables."""
        none = {name: self.spark.createDataFrame([], schema) for name, schema in self.schemas.items()}
        return self.commit(none, books, self.version())


#: The working tables that an import changes.
WORKING = {
    "verses": "book_id string, division_id string, id string, number long, text string, ocr_text string, status string, ocr_changed boolean, orphaned boolean, origin string, confidence double",
    "divisions": "book_id string, id string, ordinal long, kind string, title string",
    "notes": "book_id string, page long, block_id string, text string, ocr_text string, status string",
    "set_aside": "book_id string, page long, block_id string, text string, resolved boolean",
    "revisions": "book_id string, division_id string, id string, action string, restored boolean, version long",
}


def import_drafts(store: BookStore, drafts: dict[str, DataFrame]) -> int:
    """Imports the drafts' verses, divisions, notes and blocks set aside (as ``studio`` merges them) and adds revisions: one version.

    The books of the drafts' verses are touched, no other.
    """
    version = store.version()
    drafts = drafts | {"verses": materialize(drafts["verses"].withColumn("book_id", F.col("book_id").cast("string")), "draft")}
    books = materialize(drafts["verses"].select("book_id").distinct(), "books")
    old = {name: store.read(name, version).join(books, "book_id", "left_semi") for name in WORKING}
    new = {name: rows.withColumn("book_id", F.col("book_id").cast("string")).join(books, "book_id", "left_semi") for name, rows in drafts.items()}
    own = dealt(new["verses"], drafts["verses"].count(), "book_id", "division_id", "id")
    verses = materialize(studio.import_draft(old["verses"], own), "imported")  # read for the verses and their revisions
    done = verses.where("action <> 'kept' OR restored").select("book_id", "division_id", "id", "action", "restored", F.lit(version + 1).cast("long").alias("version"))
    changes = {
        "verses": verses, "divisions": studio.upsert_divisions(old["divisions"], new["divisions"]), "notes": studio.upsert_notes(old["notes"], new["notes"]),
        "set_aside": studio.upsert_set_aside(old["set_aside"], new["set_aside"]), "revisions": old["revisions"].unionByName(done),
    }
    return store.commit(changes, books, version)

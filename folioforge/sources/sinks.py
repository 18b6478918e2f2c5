"""Writers: results of a run appended page by page, packages written once, and what the catalog records of them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.studio import last_writer, remaining
from .ledger import Ledger
from .shared import materialize

#: What the catalog keeps of a package: its manifest without the tree and what belongs to it.
DROPPED = ("structure", "aliases")


def append_results(results: DataFrame, path: str, keys: list[str], source: str = "source_sha256") -> DataFrame:
    """Adds the results that the ledger at ``path`` has not kept yet (same keys and source hash), as one batch; returns them.

    Running it again adds nothing, so a run that stopped goes on where it was; one that died while it wrote has added nothing.
    """
    ledger = Ledger(results.sparkSession, path, results.schema)
    todo = materialize(remaining(results, ledger.read(), keys, source), "results")  # what was missing before, not after, they are written
    if not todo.isEmpty():
        ledger.append(uuid.uuid4().hex, todo)
    return todo


def current_results(table: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """The manifest of a run: for each page the result that was written last."""
    return last_writer(table, keys, rank)


def page_results(blocks: DataFrame, faults: Column) -> DataFrame:
    """One row for each page (book, page) of its body blocks (book, page, text): characters, faults, letters examined, rate with two places.

    faults: the struct of ``functions.text.orthography`` over ``text``.
    """
    g = blocks.select("book", "page", F.length("text").alias("n"), faults.alias("o")).groupBy("book", "page")
    sums = g.agg(F.sum("n").alias("chars"), F.sum("o.violations").alias("violations"), F.sum("o.examined").alias("examined"))
    rate = F.when(F.col("examined") == 0, F.lit(0.0)).otherwise(F.floor(F.col("violations") * 1000.0 / F.col("examined") * 100 + 0.5) / 100)
    return sums.withColumn("rate", rate).withColumn("ok", F.col("violations") == 0)


def write_once(packages: DataFrame, path: str) -> DataFrame:
    """Writes packages (book_id, content_version, document) to a folder for each book and version that must not exist; returns the release rows."""
    packages.select("book_id", "content_version", F.col("document").alias("value")).write.partitionBy("book_id", "content_version").mode("errorifexists").text(path)
    return release_rows(packages)


def release_rows(packages: DataFrame) -> DataFrame:
    """(book_id, content_version, bytes, sha256) of packages by the bytes of their documents."""
    return packages.select("book_id", "content_version", F.octet_length("document").cast("long").alias("bytes"), F.sha2("document", 256).alias("sha256"))


def catalog_manifest(package: Column, fields: list[str]) -> Column:
    """The fields of a package's struct that the catalog keeps."""
    return F.struct(*(package[f].alias(f) for f in fields if f not in DROPPED))


def find_layer(layers: Column, layer: Column) -> Column:
    """The declaration (id, …) of a layer, null where there is none; of several the last."""
    return F.try_element_at(F.filter(layers, lambda x: x["id"] == layer), F.lit(-1))


def inventory_lines(verdicts: DataFrame) -> DataFrame:
    """The inventory as lines of a table, one for each document (document, verdict, confidence, pages), in the order of its name."""
    cells = F.concat_ws(" | ", F.col("document").cast("string"), "verdict", "confidence", F.coalesce(F.col("pages").cast("string"), F.lit("?")))
    return verdicts.select("document", F.concat(F.lit("| "), cells, F.lit(" |")).alias("line")).orderBy("document")

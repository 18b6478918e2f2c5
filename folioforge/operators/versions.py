"""Releases: differences between two versions, audits, the catalog, and refs that have moved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.refs import bump_between, bump_rank, version_key
from ..sources.shared import materialize

HOPS = 16


def diff_units(before: DataFrame, after: DataFrame) -> DataFrame:
    """(ref, kind, change) of units (ref, kind, hash) that came, went or changed: one full outer join.

    A ref that lives on as another kind is neither added nor retired.
    """
    b = before.select("ref", F.col("kind").alias("kind_before"), F.col("hash").alias("hash_before"), F.lit(True).alias("_b"))
    a = after.select("ref", F.col("kind").alias("kind_after"), F.col("hash").alias("hash_after"), F.lit(True).alias("_a"))
    j = b.join(a, "ref", "full_outer")
    verse = (F.col("kind_before") == "verse") & (F.col("kind_after") == "verse")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "retired").when(verse & ~F.col("hash_before").eqNullSafe(F.col("hash_after")), "changed")
    return j.withColumn("change", change).where("change IS NOT NULL").select("ref", F.coalesce("kind_before", "kind_after").alias("kind"), "change")


def diff_layers(before: DataFrame, after: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(…, layer_id, change) of declared layers (…, layer_id) that were added or removed, by the keys of a release if there are any."""
    on = [*(keys or []), "layer_id"]
    j = before.select(*on).distinct().withColumn("_b", F.lit(True)).join(after.select(*on).distinct().withColumn("_a", F.lit(True)), on, "full_outer")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed")
    return j.withColumn("change", change).where("change IS NOT NULL").select(*on, "change")


def release_diff(changes: DataFrame, aliases: DataFrame, layers: DataFrame | None = None) -> DataFrame:
    """Counts over ``diff_units`` and ``diff_layers`` rows: added, retired and changed verses, divisions and layers, retired refs with and without an alias, the bump required."""
    j = changes.join(aliases.select(F.col("source").alias("ref"), F.lit(True).alias("aliased")).distinct(), "ref", "left")

    def n(change: str, kind: str | None = None) -> F.Column:
        cond = F.col("change") == change
        if kind:
            cond = cond & ((F.col("kind") == "verse") == F.lit(kind == "verse"))
        return F.count_if(cond)

    counts = j.agg(
        n("added", "verse").alias("verses_added"),
        n("retired", "verse").alias("verses_retired"),
        n("changed").alias("verses_changed"),
        n("added", "division").alias("divisions_added"),
        n("retired", "division").alias("divisions_retired"),
        F.count_if((F.col("change") == "retired") & F.col("aliased")).alias("refs_aliased"),
        F.count_if((F.col("change") == "retired") & F.col("aliased").isNull()).alias("refs_dropped"),
    )
    none = F.lit(0).cast("long")
    if layers is None:
        counts = counts.withColumn("layers_added", none).withColumn("layers_removed", none)
    else:
        counts = counts.crossJoin(layers.agg(n("added").alias("layers_added"), n("removed").alias("layers_removed")))  # one row each
    added = F.col("verses_added") + F.col("divisions_added") + F.col("layers_added")
    return counts.withColumn("required_bump", required_bump(F.col("verses_retired") + F.col("divisions_retired"), added, F.col("verses_changed"), F.col("layers_removed")))


def required_bump(retired: F.Column, added: F.Column, changed: F.Column, layers_removed: F.Column) -> F.Column:
    """The least part of a version that must rise: a ref or a layer less is major, more of either minor, other texts patch; null: nothing changed."""
    return F.when((retired > 0) | (layers_removed > 0), "major").when(added > 0, "minor").when(changed > 0, "patch")


def describe_change() -> F.Column:
    """What a row of ``release_diff`` counts, in words."""
    parts = [("verses_retired", "retired verse refs"), ("divisions_retired", "retired divisions"), ("layers_removed", "removed layers"), ("verses_added", "new verses"), ("divisions_added", "new divisions"), ("layers_added", "new layers"), ("verses_changed", "corrected verses")]
    said = F.concat_ws(", ", *(F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {words}"))) for c, words in parts))
    return F.when(said == "", "nothing").otherwise(said)


def audit_releases(pairs: DataFrame) -> DataFrame:
    """(book_id, versions, code, severity) of pairs (book_id, version_before, version_after, required_bump[, book_before]): what is wrong with the new release.

    A package of another book is that and nothing else.
    """
    bump = bump_between(F.col("version_before"), F.col("version_after"))
    other = F.col("book_before") != F.col("book_id") if "book_before" in pairs.columns else F.lit(False)
    code = (
        F.when(other, "release-book-mismatch")
        .when(bump.isNull(), "release-version-not-newer")
        .when(F.col("required_bump").isNull(), "release-content-unchanged")
        .when(bump_rank(bump) < bump_rank(F.col("required_bump")), "release-bump-understates-change")
    )
    out = pairs.select("book_id", "version_before", "version_after", code.alias("code")).where("code IS NOT NULL")
    return out.withColumn("severity", F.when(F.col("code").isin("release-version-not-newer", "release-book-mismatch"), "error").otherwise("warning"))


def dropped_refs(changes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Retired refs that no alias keeps: each an error."""
    gone = changes.where("change = 'retired'").join(aliases.select(F.col("source").alias("ref")), "ref", "left_anti")
    return gone.select(F.lit("error").alias("severity"), F.lit("release-ref-dropped").alias("code"), F.col("ref").alias("path"))


def forgotten_aliases(before: DataFrame, after: DataFrame) -> DataFrame:
    """Aliases of the version before that the new one lacks: each an error."""
    gone = before.select("source").join(after.select("source"), "source", "left_anti")
    return gone.select(F.lit("error").alias("severity"), F.lit("release-alias-forgotten").alias("code"), F.concat(F.lit("/aliases/"), "source").alias("path"))


def latest(releases: DataFrame, group: list[str], version: str) -> DataFrame:
    """The newest release of each group by version number (what is no version comes last)."""
    w = Window.partitionBy(*group).orderBy(version_key(F.col(version)).desc_nulls_last(), F.col(version).desc())
    return releases.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def catalog(releases: DataFrame, group: str, version: str) -> DataFrame:
    """For each group its versions, newest first, their number and the latest; a row holds all versions of one book."""
    rows = F.array_sort(F.collect_list(F.struct(version_key(F.col(version)).alias("k"), F.col(version).alias("v"))))
    versions = F.transform(F.reverse(rows), lambda r: r["v"])
    return releases.groupBy(group).agg(versions.alias("versions")).select(group, F.size("versions").cast("long").alias("n_versions"), F.col("versions")[0].alias("latest"), F.array_join("versions", ",").alias("versions"))


def follow(starts: DataFrame, edges: DataFrame, live: DataFrame, hops: int = HOPS) -> DataFrame:
    """(source, target) of starts (ref) that reach a live ref over edges (source, target) in at most ``hops`` steps.

    Each start's chain ends at the first live ref. A round joins the refs still under way with the edges and is written
    down; rounds end when nothing is under way. A cycle never reaches a live ref and runs out of hops.
    """
    step = edges.groupBy(F.col("source").alias("at")).agg(F.min("target").alias("next"))
    alive = live.select(F.col("ref").alias("at")).distinct().withColumn("alive", F.lit(True))
    going = starts.select(F.col("ref").alias("source"), F.col("ref").alias("at")).distinct()
    found = None
    for _ in range(hops):
        moved = going.join(step, "at").select("source", F.col("next").alias("at")).join(alive, "at", "left")
        moved = materialize(moved.select("source", "at", F.coalesce("alive", F.lit(False)).alias("alive")), "hop")
        here = moved.where("alive").select("source", F.col("at").alias("target"))
        found = here if found is None else found.unionByName(here)
        going = moved.where("NOT alive").select("source", "at")
        if going.isEmpty():
            break
    return found


def migrate(refs: DataFrame, live: DataFrame, aliases: DataFrame) -> DataFrame:
    """(ref, target, status) of refs: live as they are, rewritten over aliases, or orphaned."""
    alive = live.select("ref").distinct().withColumn("alive", F.lit(True))
    lost = refs.join(alive, "ref", "left_anti").select("ref").distinct()
    moved = follow(lost, aliases, live).select(F.col("source").alias("ref"), "target")
    j = refs.join(alive, "ref", "left").join(moved, "ref", "left")
    status = F.when(F.col("alive"), "live").when(F.col("target").isNotNull(), "rewritten").otherwise("orphaned")
    return j.select("ref", F.when(F.col("alive"), F.col("ref")).otherwise(F.col("target")).alias("target"), status.alias("status"))


def summarize_migration(migrations: DataFrame) -> DataFrame:
    """One row: how many refs of ``migrate`` are live, rewritten and orphaned."""
    return migrations.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("live", "rewritten", "orphaned")))


def nearest_live_ancestor(refs: DataFrame, live: DataFrame) -> DataFrame:
    """(ref, ancestor): the innermost container of each ref that is live, else its book."""
    book = F.regexp_extract("ref", "^[^/#]+", 0)
    parts = F.split(F.regexp_replace("ref", "#.*$", ""), "/")
    deepest = F.when(F.contains("ref", F.lit("#")), F.size(parts)).otherwise(F.size(parts) - 1)
    prefixes = F.when(deepest >= 1, F.transform(F.sequence(F.lit(1), F.greatest(deepest, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))
    tries = refs.select("ref", book.alias("book"), F.posexplode_outer(prefixes).alias("depth", "prefix"))
    # Many refs share a container: only the live refs that are containers are joined, which are few enough to be sent or dealt.
    containers = live.select(F.col("ref").alias("prefix")).join(tries.select("prefix").distinct(), "prefix", "left_semi").distinct()
    hits = tries.join(containers.withColumn("alive", F.lit(True)), "prefix", "left")
    return hits.groupBy("ref", "book").agg(F.max_by(F.when(F.col("alive"), F.col("prefix")), F.when(F.col("alive"), F.col("depth"))).alias("a")).select("ref", F.coalesce("a", "book").alias("ancestor"))


def derive_aliases(before: DataFrame, live: DataFrame, lineage: DataFrame, carried: DataFrame) -> DataFrame:
    """(source, target) for every ref of the version before, and every carried alias, that no longer lives.

    A ref goes where its lineage (source, target) leads, else to its nearest live ancestor; carried aliases are pointed anew.
    """
    wanted = before.select(F.col("ref").alias("source"), "ref").unionByName(carried.select("source", F.col("target").alias("ref")))
    wanted = wanted.join(live.select(F.col("ref").alias("source")), "source", "left_anti")
    wanted = wanted.groupBy("source").agg(F.max_by("ref", (F.col("ref") != F.col("source")).cast("int")).alias("ref"))
    targets = wanted.select("ref").distinct()
    alive = live.select("ref").distinct().withColumn("alive", F.lit(True))
    moved = follow(targets, lineage, live).select(F.col("source").alias("ref"), F.col("target").alias("moved"))
    above = nearest_live_ancestor(targets, live)
    j = wanted.join(alive, "ref", "left").join(moved, "ref", "left").join(above, "ref", "left")
    return j.select("source", F.when(F.col("alive"), F.col("ref")).otherwise(F.coalesce("moved", "ancestor")).alias("target"))

"""Numbering: the checksum over printed numbers, flags of passages, and identifiers that repeat."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.shared import materialize


def check_sequence(rows: DataFrame) -> DataFrame:
    """Runs of printed numbers in rows (book, division, pos, number).

    A run ends where the numbers step back for the first time in a division that isn't the one it began in. For each
    run: its first division, first and last number, count, numbers missing between, repeated ones, and ones that don't
    follow their predecessor. What is missing stands as gaps (start, end), inclusive, so that one misread number makes one gap.
    """
    book = Window.partitionBy("book").orderBy("pos")
    n = rows.where("number IS NOT NULL").withColumn("p", F.lag("number").over(book))
    n = n.withColumn("back", F.col("p").isNull() | (F.col("number") <= F.col("p")))
    first = F.row_number().over(Window.partitionBy("book", "division", "back").orderBy("pos")) == 1
    n = n.withColumn("opens", F.col("back") & first)
    n = n.withColumn("run", F.sum(F.col("opens").cast("int")).over(book.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    n = n.withColumn("k", F.row_number().over(Window.partitionBy("book", "run", "number").orderBy("pos")))
    n = n.withColumn("below", F.lag("number").over(Window.partitionBy("book", "run").orderBy("number", "pos")))
    gap = F.when(F.col("number") > F.col("below") + 1, F.struct((F.col("below") + 1).alias("start"), (F.col("number") - 1).alias("end")))
    lo, hi = F.min("number"), F.max("number")
    return n.groupBy("book", "run").agg(
        F.min_by("division", "pos").alias("division"),
        lo.alias("first"),
        hi.alias("last"),
        F.count("*").alias("numbered"),
        F.array_sort(F.collect_list(gap)).alias("missing"),
        F.array_sort(F.collect_set(F.when(F.col("k") > 1, F.col("number")))).alias("duplicates"),
        F.array_sort(F.collect_set(F.when(~F.col("opens") & (F.col("number") != F.col("p") + 1), F.col("number")))).alias("out_of_order"),
    )


def number_flags(rows: DataFrame) -> DataFrame:
    """Adds duplicate_number and out_of_sequence to rows (book, division, pos, number).

    The numbering may begin anew with the first numbered row of a division; inside a division a step back is a fault.
    """
    book = Window.partitionBy("book").orderBy("pos")
    some = F.col("number").isNotNull()
    before = F.last("number", ignorenulls=True).over(book.rowsBetween(Window.unboundedPreceding, -1))
    first = F.when(some, F.row_number().over(Window.partitionBy("book", "division", some).orderBy("pos")) == 1).otherwise(False)
    out = rows.withColumn("_before", before).withColumn("_reset", (first & (F.col("number") <= F.col("_before"))).cast("int"))
    out = out.withColumn("_run", F.sum(F.coalesce("_reset", F.lit(0))).over(book.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    again = F.row_number().over(Window.partitionBy("book", "_run", "number").orderBy("pos")) > 1
    follows = (F.coalesce("_reset", F.lit(0)) == 1) | F.col("_before").isNull() | (F.col("number") == F.col("_before") + 1)
    return out.withColumn("duplicate_number", some & again).withColumn("out_of_sequence", F.coalesce(some & ~follows, F.lit(False))).drop("_before", "_reset", "_run")


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the place of each row within its keys, from 1, without bringing a key's rows into one task.

    Rows are dealt by ranges of keys and order, so that a large key lies in several parts; what a key has in earlier parts
    is added to a row's place in its own. Only keys that several parts hold are sent to all tasks: fewer than there are parts.
    """
    part, before = f"{name}_part", f"{name}_before"
    dealt = materialize(rows.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()), "ranked")
    counts = dealt.groupBy(*keys, part).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*(F.col(k).alias(f"{name}_{i}") for i, k in enumerate(keys)), F.col(part).alias(f"{part}s"), F.sum("n").over(earlier).alias(before)).where(F.col(before).isNotNull())
    same = F.col(part) == F.col(f"{part}s")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"{name}_{i}"))
    place = F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order))
    return dealt.withColumn(name, place.cast("long")).join(F.broadcast(counts), same, "left").withColumn(name, F.col(name) + F.coalesce(before, F.lit(0))).select(*rows.columns, name)


#: An id's end that looks like what was added to make it unique.
_SUFFIXES = "(-([2-9]|[1-9][0-9]+))+$"


def _give_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gives each row, in order, its own id or the first free one behind it; the last columns are the id it wants and its family."""
    family, seen, upto = None, set(), {}
    for batch in batches:
        out = []
        for wanted, of in zip(*(c.to_pylist() for c in batch.columns[-2:])):
            if of != family:
                family, seen, upto = of, set(), {}
            base, _, last = wanted.rpartition("-")
            # A suffix below its base's next one was given out, or passed over because it was taken.
            taken = wanted in seen or (last.isascii() and last.isdigit() and last[0] != "0" and 2 <= int(last) < upto.get(base, 2))
            if taken:
                k = upto.get(wanted, 2)
                while f"{wanted}-{k}" in seen:
                    k += 1
                upto[wanted] = k + 1
                out.append(f"{wanted}-{k}")
            else:
                seen.add(wanted)
                out.append(wanted)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.string())], [*batch.schema.names[:-2], "unique_id"])


def unique_ids(rows: DataFrame, keys: list[str], id_col: str, order: list[str]) -> DataFrame:
    """Adds unique_id: in the given order each row of a division (keys) takes its id, or the first of id-2, id-3, … that none has taken.

    Ids can meet only within a family: those that are equal without their numbered ends. Where all ids of a family are the
    same, the place of a row says its suffix, however many rows there are; other families are folded in order, each as a
    stream through one task that keeps its distinct ids. A null id stays null. Equal rows must be told apart by ``order``.
    """
    names = rows.columns
    wanted, root, several, place, family = (_free(names, n) for n in ("wanted", "root", "several", "place", "family"))
    own = rows.where(F.col(id_col).isNotNull()).withColumn(wanted, F.col(id_col).cast("string")).withColumn(root, F.regexp_replace(wanted, _SUFFIXES, ""))
    mixed = own.groupBy(*keys, root).agg((F.min(wanted) != F.max(wanted)).alias(several))
    same = F.lit(True)
    for k in [*keys, root]:
        same &= F.col(f"o.{k}").eqNullSafe(F.col(f"s.{k}"))
    # Both ways read it, one of them twice: to find its ranges and to deal by them.
    own = materialize(own.alias("o").join(mixed.alias("s"), same).select("o.*", f"s.{several}"), "families")
    alone = ranked(own.where(~F.col(several)), [*keys, wanted], order, place)
    alone = alone.select(*names, F.when(F.col(place) > 1, F.concat_ws("-", wanted, F.col(place).cast("string"))).otherwise(F.col(wanted)).alias("unique_id"))
    folded = own.where(several).withColumn(family, F.to_json(F.struct(*keys, root), {"ignoreNullFields": "false"})).select(*names, wanted, family)
    folded = folded.repartition(family).sortWithinPartitions(family, *order)
    schema = T.StructType([*rows.schema.fields, T.StructField("unique_id", T.StringType())])
    folded = folded.mapInArrow(_give_ids, schema)
    return alone.unionByName(folded).unionByName(rows.where(F.col(id_col).isNull()).withColumn("unique_id", F.lit(None).cast("string")))


def _free(columns: list[str], name: str) -> str:
    """The name between underscores, with more of them until no column has it."""
    name = f"_{name}_"
    while name in columns:
        name += "_"
    return name


def ordinals(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Adds ordinal: the place of each row within keys, from 0."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)


def numbering_offset(pages: DataFrame) -> DataFrame:
    """(book, page_offset, numbered, disagreements) of pages (book, page, printed): the commonest difference, the first seen of ties."""
    known = pages.where("printed IS NOT NULL").withColumn("page_offset", F.col("page") - F.col("printed"))
    tally = known.groupBy("book", "page_offset").agg(F.count("*").alias("n"), F.min("page").alias("seen"))
    best = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("n"), "seen")) == 1
    chosen = tally.withColumn("numbered", F.sum("n").over(Window.partitionBy("book"))).withColumn("best", best).where("best")
    return chosen.select("book", "page_offset", "numbered", (F.col("numbered") - F.col("n")).alias("disagreements"))


def vote(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """The commonest value of each group, null where two are equally common."""
    tally = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*group).orderBy(F.desc("n"), value)
    ranked = tally.withColumn("r", F.row_number().over(w)).withColumn("second", F.lead("n").over(w)).where("r = 1")
    return ranked.select(*group, F.when(F.col("second").isNull() | (F.col("n") > F.col("second")), F.col(value)).alias("winner"), F.col("n").alias("votes"))


def titles_from_heads(passages: DataFrame, heads: DataFrame) -> DataFrame:
    """(book, section, title) of sections that the running heads of their pages name.

    passages: (book, section, pages); heads: (book, page, head), a row for each line. The commonest head of a book (of
    ties the first seen) names the book, not a section; of the others the commonest on a section's pages (counted for each
    passage on a page) is its title, unless two are equally common.
    """
    wide = heads.groupBy("book", "head").agg(F.count("*").alias("n"), F.min("page").alias("seen"))
    top = wide.withColumn("r", F.row_number().over(Window.partitionBy("book").orderBy(F.desc("n"), "seen", "head"))).where("r = 1").select("book", "head")
    own = heads.join(top, ["book", "head"], "left_anti")
    on = passages.select("book", "section", F.explode("pages").alias("page")).join(own, ["book", "page"])
    return vote(on, ["book", "section"], "head").where("winner IS NOT NULL").select("book", "section", F.col("winner").alias("title"))


def within_rate(events: DataFrame, key: list[str], ts: str, order: list[str], capacity: int, seconds: int = 60) -> DataFrame:
    """Adds in_window and allowed: how many requests of a key were granted in the last seconds, and whether this one is.

    Only granted requests fill the window, and one that is exactly ``seconds`` old has left it; a capacity of 0 or less
    grants all. What is granted depends on what was granted before, so each key is a fold in order of ``ts`` and ``order``.
    A pause of ``seconds`` empties the window: it cuts a key into islands, which are folded each for itself, in streams.
    Pauses are found by stretches of ``seconds`` (each event also stands in the stretch after its own), so no window
    holds a whole key; a stretch's last beginning of an island is handed to later ones, a row for each stretch. Requests
    without a time are not granted and count nothing.
    """
    span = seconds * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    own = F.floor(micros / span)
    timed = events.where(F.col(ts).isNotNull()).withColumn("_at", micros)
    if capacity <= 0:
        return events.withColumn("in_window", F.lit(None).cast("long")).withColumn("allowed", F.col(ts).isNotNull())
    rows = timed.withColumn("_stretch", F.explode(F.array(own, own + 1))).withColumn("_own", F.col("_stretch") == own)
    w = Window.partitionBy(*key, "_stretch").orderBy("_at", *order)
    before = F.lag("_at").over(w)
    rows = rows.withColumn("_begins", before.isNull() | (F.col("_at") - before >= span)).where("_own")
    rows = rows.withColumn("_island", F.max(F.when(F.col("_begins"), F.col("_at"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    handed = rows.groupBy(*key, "_stretch").agg(F.max(F.when(F.col("_begins"), F.col("_at"))).alias("_last"))
    earlier = Window.partitionBy(*key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    handed = handed.select(*key, "_stretch", F.max("_last").over(earlier).alias("_last"))
    same = F.col("r._stretch") == F.col("h._stretch")
    for k in key:
        same &= F.col(f"r.{k}").eqNullSafe(F.col(f"h.{k}"))
    rows = rows.alias("r").join(handed.alias("h"), same).select(*(f"r.{c}" for c in events.columns), "_at", "_begins", F.coalesce("_island", "_last").alias("_island"))
    rows = rows.repartition(*key, "_island").sortWithinPartitions(*key, "_island", "_at", *order)

    def grant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        granted: deque[int] = deque()
        for batch in batches:
            counts = []
            for at, begins in zip(batch.column(batch.num_columns - 3).to_pylist(), batch.column(batch.num_columns - 2).to_pylist()):
                if begins:
                    granted.clear()
                while granted and granted[0] <= at - span:
                    granted.popleft()
                counts.append(len(granted))
                if len(granted) < capacity:
                    granted.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(counts, pa.int64())], [*batch.schema.names[:-3], "in_window"])

    schema = T.StructType([*events.schema.fields, T.StructField("in_window", T.LongType())])
    out = rows.mapInArrow(grant, schema).withColumn("allowed", F.col("in_window") < capacity)
    return out.unionByName(events.where(F.col(ts).isNull()).withColumn("in_window", F.lit(None).cast("long")).withColumn("allowed", F.lit(False)))

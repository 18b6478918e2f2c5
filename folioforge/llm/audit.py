"""What quality filters do to each other, for every order in which they may run.

A document's failures are five bits (A to E). All that an order of filters removes follows from how many documents of a
part fail each set of filters, so one pass counts those 32 cells for each part, and an order's figures are contractions of
the part's 2x2x2x2x2 tensor: along each axis a step takes those that pass, those that fail, or all of them.

Filters: A fewer than 50 words, B fewer than 65 distinct words in 100, C more than 5 capitals (A-Z) in 100 code points,
D one of ``#$%&*|``, E the text of a document with a smaller id. Equal texts are found by their SHA-256. They share all
other failures, so E needs no text and no row of its own: of each group of copies in a part it is enough to know how many
rows there are and how many of them have the least id.

Shuffled are an id, a part, a digest and four bits for each row, summed before they cross wherever a group repeats.
Nothing is broadcast or collected. Defined results: a null text is empty (no words, fails A only, and E where another
document with a smaller id is empty too); a null source is the part ''; a null id is larger than any other, and null ids
don't repeat each other; rows of one id don't repeat each other, however often they stand; a document with several labels
has a quality or is toxic if one label says so; documents without a label are neither; an empty table gives no rows; very
long texts are read whole; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
#: What is counted in each cell: documents, those of quality 1, toxic ones.
KINDS = ("n", "good", "toxic")
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def words_of(text: F.Column) -> F.Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def failures(text: F.Column, words: F.Column) -> F.Column:
    """Bits 0 to 3 of the filters A to D."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    bits = [n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(b, F.lit(1 << k)).otherwise(0) for k, b in enumerate(bits)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cell, n, good, toxic): documents of each part by their set of failures (bits A to E from the lowest)."""
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id"))
    known = known.agg(*(F.coalesce(F.max(F.when(F.col(c) == 1, 1).otherwise(0)), F.lit(0)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_or_empty().alias("text"))
    rows = rows.withColumn("words", words_of(F.col("text")))  # split once: it stays a column, as it is read more than once
    rows = rows.select("_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), failures(F.col("text"), F.col("words")).cast("byte").alias("bits"))
    # Repeated rows first: what is joined has one row for each id and text in a part.
    rows = rows.groupBy("_id", "part", "digest", "bits").agg(F.count("*").alias("n")).join(known, "_id", "left")
    counts = [F.col("n"), F.col("n") * F.coalesce("good", F.lit(0)), F.col("n") * F.coalesce("toxic", F.lit(0))]
    rows = rows.select("_id", "part", "digest", "bits", *(c.alias(k) for c, k in zip(counts, KINDS)))
    groups = rows.groupBy("digest", "part", "bits").agg(
        F.min("_id").alias("least"), *(F.sum(k).alias(k) for k in KINDS), *(F.min_by(k, "_id").alias(f"first_{k}") for k in KINDS)
    )
    groups = materialize(groups, "copies")  # read twice, and the texts behind it once
    of_all = groups.groupBy("digest").agg(F.min("least").alias("least_of_all"))
    groups = groups.join(of_all, "digest")
    first = [
        F.when(F.col("least_of_all").isNull(), F.col(k)).when(F.col("least") == F.col("least_of_all"), F.col(f"first_{k}")).otherwise(0) for k in KINDS
    ]
    both = F.explode(
        F.array(
            F.struct(F.col("bits").cast("int").alias("cell"), *(f.alias(k) for f, k in zip(first, KINDS))),
            F.struct((F.col("bits") + 16).cast("int").alias("cell"), *((F.col(k) - f).alias(k) for f, k in zip(first, KINDS))),
        )
    )
    return groups.select("part", both.alias("c")).groupBy("part", "c.cell").agg(*(F.sum(f"c.{k}").alias(k) for k in KINDS))


def _selectors(own: tuple[int, int], before: tuple[int, int], after: tuple[int, int]) -> list[np.ndarray]:
    """For each axis the vectors (pass, fail) of all orders and steps: the step's own filter, those before it, those after it."""
    out = np.empty((len(FILTERS), len(ORDERS), len(FILTERS), 2), dtype=np.int64)
    for o, order in enumerate(ORDERS):
        for step in range(len(FILTERS)):
            for axis, name in enumerate(FILTERS):
                at = order.index(name)
                out[axis, o, step] = own if at == step else before if at < step else after
    return list(out.reshape(len(FILTERS), -1, 2))


def contract(tensors: np.ndarray) -> dict[str, np.ndarray]:
    """Figures of parts x (orders, steps) from tensors of parts x kinds x A x B x C x D x E."""

    def taken(own: tuple[int, int], before: tuple[int, int], after: tuple[int, int]) -> np.ndarray:
        return np.einsum("pkabcde,sa,sb,sc,sd,se->pks", tensors, *_selectors(own, before, after), optimize="greedy")

    removed, failing = taken(FAIL, PASS, ALL), taken(FAIL, ALL, ALL)[:, 0]
    own = np.array([FILTERS.index(order[step]) for order in ORDERS for step in range(len(FILTERS))])
    total = np.stack([removed[:, 0, own == k].sum(axis=1) for k in range(len(FILTERS))], axis=1)
    return {
        "kept": taken(PASS, PASS, ALL)[:, 0],
        "removed": removed[:, 0],
        "redundant": failing - removed[:, 0],
        "unique_fails": taken(FAIL, PASS, PASS)[:, 0],
        "good_lost": removed[:, 1],
        "toxic_lost": removed[:, 2],
        "shapley": total[:, own],
    }


FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in FIGURES)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    filled = [F.coalesce(F.max(F.when(F.col("cell") == c, F.col(k))), F.lit(0)) for k in KINDS for c in range(CELLS)]
    parts = cells(docs, labels).groupBy("part").agg(F.array(*filled).alias("counts"))
    orders = pa.array(np.repeat(ORDERS, len(FILTERS)).tolist())
    steps = np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                flat = part.column(1).flatten().to_numpy().reshape(part.num_rows, len(KINDS), *(2,) * len(FILTERS))
                found = contract(flat.transpose(0, 1, 6, 5, 4, 3, 2))  # a cell's lowest bit, its last axis, is A
                rows = pa.array(np.repeat(np.arange(part.num_rows), len(steps)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), pa.concat_arrays([orders] * part.num_rows), pa.array(np.tile(steps, part.num_rows)), *(pa.array(found[f].reshape(-1)) for f in FIGURES)],
                    ["part", "filter_order", "step", *FIGURES],
                )

    return parts.mapInArrow(run, SCHEMA)


ORACLE_SQL = r"""
WITH known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
      len(words) < 50,
      100 * len(list_distinct(words)) < 65 * len(words),
      100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
      regexp_matches(t, '[#$%&*|]'),
      coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), min(doc_id) OVER (PARTITION BY t) IS NOT NULL)] AS f
  FROM texts LEFT JOIN known USING (doc_id)
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT filter_order, step, list_transform(string_split(filter_order, ''), lambda x: ascii(x) - 64) AS axes FROM orders, range(1, 6) AS r(step)
), combined AS (
  SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, f
), figures AS (
  SELECT part, filter_order, step::INTEGER AS step, axes[step] AS own,
    coalesce(sum(n) FILTER (NOT list_contains(list_transform(axes[:step], lambda a: f[a]), true)), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (f[axes[step]] AND NOT list_contains(list_transform(axes[:step - 1], lambda a: f[a]), true)), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (f[axes[step]] AND list_contains(list_transform(axes[:step - 1], lambda a: f[a]), true)), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (f[axes[step]] AND len(list_filter(f, lambda x: x)) = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (f[axes[step]] AND NOT list_contains(list_transform(axes[:step - 1], lambda a: f[a]), true)), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (f[axes[step]] AND NOT list_contains(list_transform(axes[:step - 1], lambda a: f[a]), true)), 0)::BIGINT AS toxic_lost
  FROM combined, steps GROUP BY part, filter_order, step, axes
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM figures
"""

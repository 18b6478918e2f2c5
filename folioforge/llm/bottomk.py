"""Document fingerprints: bottom-k sketches of word shingles.

A sketch is the sorted array of the k least distinct 64-bit hashes of a text's shingles; a set of fewer hashes is kept
whole, and then estimates are exact. The sketch of a union is the k least hashes of both sketches, so sketches of parts
merge into the sketch of the whole in any order. From two sketches follow the resemblance of the texts, the containment
of one in the other and the number of distinct shingles.

``edited_digest`` lays documents out by descending id to give each its successor: ids are cut into ranges at quantiles,
each range is sorted by itself, and the first document of a range is also sent to the range before it. Texts are shuffled
once; only one id for each range reaches the driver.

Defined results: null and empty texts (and texts without words) have the empty sketch, which resembles the empty sketch
by 1 and any other by 0; a text with fewer words than a shingle has one shingle of all; equal texts have equal sketches;
very long texts are read whole; an empty table gives no rows; repeated rows are kept; rows with equal ids follow each other
in the order of their texts' hashes; a null id comes last; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Texts, gram_hashes, shuffle_partitions, slices

K, SHINGLE = 128, 5


def least_distinct(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k least distinct hashes, sorted."""
    if len(hashes) > 8 * k:
        some = np.unique(np.partition(hashes, 4 * k)[: 4 * k])
        if len(some) >= k:
            return some[:k]
    return np.unique(hashes)[:k]


def sketches(texts: Texts, k: int = K, size: int = SHINGLE) -> list[np.ndarray]:
    """The sketch of each document of a slice."""
    starts, ends, first = texts.words()
    words = texts.word_hashes(starts, ends)
    grams = gram_hashes(words, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(least_distinct(grams[a : b - size + 1], k))
        else:
            out.append(gram_hashes(words[a:b], b - a) if b > a else words[:0])
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles among all of both."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    again = both[1:] == both[:-1]  # hashes of one sketch are distinct
    union = both[np.append(True, ~again)][:k]
    return float(np.count_nonzero(both[1:][again] <= union[-1])) / len(union)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of a that b has too."""
    if not len(a):
        return 1.0
    common = distinct(merge(a, b, k), k) * resemblance(a, b, k)
    return min(1.0, common / distinct(a, k))


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype="<u8")


def _texts_of(bodies: list[bytes]) -> Texts:
    return Texts(np.frombuffer(b"".join(bodies), dtype=np.uint8), np.cumsum([0, *map(len, bodies)]))


def group_sketches(docs: DataFrame, by: str, k: int = K, size: int = SHINGLE, text_col: str = "text") -> DataFrame:
    """(group, sketch, n_distinct) for each value of a column: sketches of parts, merged task by task, then by group."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, np.ndarray] = {}
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                for g, s in zip(rows.column(0).to_pylist(), sketches(texts, k, size)):
                    held[g] = merge(held[g], s, k) if g in held else s
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(map(encode, held.values()), pa.string())], ["grp", "sketch"])

    def whole(table: pa.Table) -> pa.Table:  # one row for each task at most
        out = np.zeros(0, dtype=np.uint64)
        for s in table.column("sketch").to_pylist():
            out = merge(out, decode(s), k)
        return pa.table({"grp": table.column("grp").slice(0, 1), "sketch": [encode(out)], "n_distinct": pa.array([distinct(out, k)], pa.float64())})

    rows = docs.select(F.col(by).cast("string").alias("grp"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(parts, "grp string, sketch string").groupBy("grp").applyInArrow(whole, "grp string, sketch string, n_distinct double")


#: What stands for a null id: no id is less.
LEAST_ID = -(1 << 63)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, look, doc_id, text, tie) so dealt and sorted that in a bucket each row's successor by descending id follows it.

    A row with ``look`` is the copy of the successor of the bucket's last row.
    """
    parts = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    points = [i / parts for i in range(1, parts)] or [0.5]
    cuts = rows.agg(F.percentile_approx("doc_id", points, 10_000)).first()[0] or []
    cuts = np.unique(np.array(cuts, dtype=np.int64))  # fewer than there are tasks
    rows = rows.withColumn("tie", F.xxhash64("text"))

    def places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (a null: the least), ties and buckets of rows; greater ids have lesser buckets."""
        ids = batch.column(0).fill_null(LEAST_ID).to_numpy()
        return ids, batch.column(batch.num_columns - 1).to_numpy(), len(cuts) - np.searchsorted(cuts, ids)

    def greatest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, tuple[int, int]] = {}
        for batch in batches:
            ids, ties, buckets = places(batch)
            order = np.lexsort((ties, ids, buckets))
            last = order[np.append(np.flatnonzero(np.diff(buckets[order])), len(order) - 1)] if len(order) else order
            for b, i, t in zip(buckets[last].tolist(), ids[last].tolist(), ties[last].tolist()):
                most[b] = max(most.get(b, (i, t)), (i, t))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(most), [m[0] for m in most.values()], [m[1] for m in most.values()])], ["bucket", "id", "tie"])

    # The first row of each bucket: one for each range.
    order = F.struct("id", "tie")
    found = rows.select("doc_id", "tie").mapInArrow(greatest, "bucket long, id long, tie long").groupBy("bucket").agg(F.max(order).alias("m")).orderBy("bucket").collect()
    firsts = [(r["bucket"], r["m"]["id"], r["m"]["tie"]) for r in found]
    target = {(i, t): firsts[k - 1][0] for k, (_, i, t) in enumerate(firsts)}  # the last bucket goes before the first
    first_ids = np.array([i for _, i, _ in firsts], dtype=np.int64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties, buckets = places(batch)
            copied = [k for k in np.flatnonzero(np.isin(ids, first_ids)).tolist() if (int(ids[k]), int(ties[k])) in target]
            for rows, to, look in ((batch, buckets, False), (batch.take(pa.array(copied, pa.int64())), [target[int(ids[k]), int(ties[k])] for k in copied], True)):
                if rows.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([look] * rows.num_rows), *rows.columns], ["bucket", "look", "doc_id", "text", "tie"])

    out = rows.mapInArrow(dealt, "bucket int, look boolean, doc_id long, text string, tie long")
    return out.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "look", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())


def edited_digest(docs: DataFrame, k: int = K, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """rows: (bucket, look, doc_id, text), the last one only as the successor of the one before."""
        edited = []
        for (_, _, _, text), (_, _, _, after) in zip(rows, rows[1:]):
            half = len(text) // 2
            edited.append((text[: len(text) - half] + after[:half]).encode())
        own = sketches(_texts_of([r[3].encode() for r in rows]), k, size)
        new = sketches(_texts_of(edited), k, size)
        out: list[list] = [[] for _ in names]
        for j, e in enumerate(edited):
            if rows[j][1] or rows[j][0] != rows[j + 1][0]:  # a copy, not a row of its own
                continue
            values = (rows[j][2], len(rows[j][3]), hashlib.sha256(e).hexdigest(), encode(own[j]), encode(new[j]), resemblance(own[j], new[j], k), resemblance(own[j], own[j + 1], k))
            for v, x in zip(out, values):
                v.append(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size_held = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(4))):
                held.append(row)
                size_held += len(row[3])
                if size_held >= SLICE_BYTES and len(held) > 1:
                    yield from emit(held)
                    held, size_held = held[-1:], 0
        if len(held) > 1:
            yield from emit(held)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(run, schema)

"""Removal of word windows that stand in an earlier document, by sharded FM-indexes.

A window is ``WINDOW`` consecutive words. Which windows can repeat at all is found by anchors: the least hash of the word
grams in a window. Equal windows have equal anchors, neighbouring windows mostly share theirs, and an anchor that stands
in one text only needs no search. What is left are segments: runs of windows with one repeated anchor.

Segments are dealt to shards by their anchor, so all windows that may be equal meet in one shard. A shard holds each
segment once, with the least id of the documents that have it, in a compressed FM-index (wavelet matrix and owners; neither
text nor suffix array stay). The segments are streamed through the index by backward search of ``WINDOW`` steps: where a
matching statistic reaches that threshold, the interval gives the least id of all documents with the window. Longer
matches are runs of such windows. Anchors of very many segments would make one shard too large: their windows
are segments of their own and are dealt by their own hash. Copies of a whole text are one class, and only its first
document is searched: in the others every window starts in an earlier document.

Segments hold the words themselves, which a shard numbers, so its search is exact; hashes only bring together what may be
equal. Texts cross the network once, compressed, and their segments twice; all else is narrow. Nothing is collected to the
driver but two counts.

Defined results: null and empty texts have no words; documents shorter than a window keep all words; an empty table gives
no rows; very long texts are read whole; rows with equal ids are one document, whose windows don't repeat each other;
repeated rows are kept; a null id counts as larger than any; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, gram_hashes, materialize, mix, run_hashes, shuffle_partitions, slices
from .fm_index import FmIndex

WINDOW, GRAM = 13, 4
#: Windows of a segment (bits of a mask), texts with an anchor from which its windows are dealt by themselves, words of a shard.
SEGMENT_WINDOWS, HOT, SHARD_WORDS = 32, 4000, 250_000
#: Segments and their bytes that a task holds before it hands them on.
HELD_SEGMENTS, HELD_BYTES = 40_000, 16 << 20
LAST_ID = (1 << 63) - 1


def anchors(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """For each window (by its first word) the least hash of the grams in it."""
    low, width, need = gram_hashes(words, gram), 1, window - gram + 1
    while width * 2 <= need:
        low = np.minimum(low[:-width], low[width:]) if len(low) > width else low[:0]
        width *= 2
    more = need - width
    if more:
        low = np.minimum(low[:-more], low[more:]) if len(low) > more else low[:0]
    return low


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, doc_id, id, text): k is the same for rows that are equal in id and text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("k"), "doc_id", F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "text")


def _anchor_rows(rows: DataFrame, window: int) -> DataFrame:
    """(anchor, k): each anchor of each row once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                starts, ends, first = texts.words()
                low = anchors(texts.word_hashes(starts, ends), window)
                owner = np.repeat(np.arange(texts.n), np.diff(first))
                inside = owner[: len(low)] == owner[window - 1 :][: len(low)]
                fresh = inside.copy()
                fresh[1:] &= (low[1:] != low[:-1]) | ~inside[:-1]
                at = np.flatnonzero(fresh)
                key = low[at] ^ mix(owner[at].astype(np.uint64))
                at = at[np.unique(key, return_index=True)[1]]
                k = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(low[at].view(np.int64)), pa.array(k[owner[at]])], ["anchor", "k"])

    return rows.select("k", "text").mapInArrow(run, "anchor long, k long")


def _small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, as Python objects of a piece take several times its memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _copies(rows: DataFrame) -> DataFrame:
    """(k, id) of the rows whose whole text stands in a document with a smaller id."""
    narrow = rows.select("k", "id", F.unhex(F.sha2("text", 256)).alias("digest"))
    least = narrow.groupBy("digest").agg(F.min("id").alias("least"))
    return narrow.join(least, "digest").where("least < id").select("k", "id")


_PARTS = ["kind", "k", "doc_id", "id", "n_words", "sha", "body", "places", "shard_key", "h", "words", "least"]
_PART_TYPES = [
    pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(),
    pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int64())])), pa.int64(), pa.int64(), pa.binary(), pa.int64(),
]
_PART_SCHEMA = "kind int, k long, doc_id long, id long, n_words long, sha string, body binary, places array<struct<h:long,pos:long>>, shard_key long, h long, words binary, least long"


def _segments(docs: DataFrame, window: int) -> DataFrame:
    """Rows of two kinds: documents (kind 0; done if sha is set, else with their text and segments) and segments (kind 1)."""
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        held: dict[int, list] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            n = len(held)
            if n:
                keys, words, least = zip(*held.values())
                columns = [[1] * n, *[[None] * n] * 7, list(keys), list(held), list(words), list(least)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PART_TYPES)], _PARTS)
                held.clear()

        for batch in _small(batches):
            out: list[list] = [[] for _ in range(8)]
            ks, doc_ids, ids, bodies, copies, lists, hots = (batch.column(c).to_pylist() for c in range(7))
            for k, doc_id, own, body, copy, some, hot in zip(ks, doc_ids, ids, bodies, copies, lists, hots):
                text = unpack(body)
                words = text.split()
                n = len(words)
                places: list[dict] = []
                if n < window or not (some or hot or copy):
                    sha = hashlib.sha256(b" ".join(words)).hexdigest()
                elif copy:
                    sha = empty
                else:
                    places = _places(text, own, some or [], hot or [], window, held)
                    sha = None if places else hashlib.sha256(b" ".join(words)).hexdigest()
                for v, x in zip(out, (0, k, doc_id, own, n, sha, None if sha else body, places)):
                    v.append(x)
            n = len(out[0])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*out, *[[None] * n] * 4], _PART_TYPES)], _PARTS)
            if len(held) > HELD_SEGMENTS or sum(len(x[1]) for x in held.values()) > HELD_BYTES:
                yield from handed()
        yield from handed()

    return docs.mapInArrow(run, _PART_SCHEMA)


def _places(text: bytes, own: int, some: list[int], hot: list[int], window: int, held: dict[int, list]) -> list[dict]:
    """The segments of a document: adds them to ``held`` and returns their hashes and places."""
    view = Texts(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
    from_byte, to_byte, _ = view.words()
    words = view.word_hashes(from_byte, to_byte)
    low = anchors(words, window).view(np.int64)
    is_hot = np.isin(low, np.array(hot, dtype=np.int64))
    at = np.flatnonzero(np.isin(low, np.array(some, dtype=np.int64)) & ~is_hot)
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (np.diff(at) > 1) | (low[at[1:]] != low[at[:-1]])
    every = np.arange(len(at))
    within = every - np.maximum.accumulate(np.where(fresh, every, 0))
    first = np.flatnonzero(within % SEGMENT_WINDOWS == 0)
    alone = np.flatnonzero(is_hot)
    starts = np.concatenate([at[first], alone])
    counts = np.concatenate([np.diff(np.append(first, len(at))), np.ones(len(alone), dtype=np.int64)])
    ends = starts + counts + window - 1
    hashes = mix(run_hashes(words, starts, ends) + (ends - starts).astype(np.uint64)).view(np.int64)
    keys = np.concatenate([low[at[first]], hashes[len(first) :]])
    out = []
    for key, h, s, e in zip(keys.tolist(), hashes.tolist(), starts.tolist(), ends.tolist()):
        if h in held:
            held[h][2] = min(held[h][2], own)
        else:
            held[h] = [key, text[from_byte[s] : to_byte[e - 1]], own]
        out.append({"h": h, "pos": s})
    return out


def _search_shard(table: pa.Table, window: int) -> pa.Table:
    """(h, least): for each segment of a shard the least document id of each of its windows."""
    h = table.column("h").to_numpy()
    least = table.column("least").to_numpy()
    order = np.lexsort((least, h))
    first = order[np.append(True, h[order][1:] != h[order][:-1])]  # a segment once, with its least id
    bodies = [b.split() for b in table.column("words").take(pa.array(first)).to_pylist()]
    h, least = h[first], least[first]
    lens = np.array([len(b) for b in bodies])
    words = list(chain.from_iterable(bodies))
    known = {w: k for k, w in enumerate(dict.fromkeys(words))}
    symbols = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    del bodies, words
    at = np.arange(len(symbols)) + np.repeat(np.arange(len(lens)), lens)  # a 0 after each segment
    text = np.zeros(len(symbols) + len(lens), dtype=np.int64)
    text[at] = symbols + 1
    index = FmIndex(text, len(known) + 1, window, np.repeat(least, lens + 1))
    begin = np.cumsum(lens + 1) - lens - 1
    counts = lens - window + 1
    windows = np.repeat(begin, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    # The segments are streamed through the index, equal windows once.
    _, once, where = np.unique(gram_hashes(text.astype(np.uint64), window)[windows], return_index=True, return_inverse=True)
    if any((text[windows + i] != text[windows[once][where] + i]).any() for i in range(window)):
        once = where = np.arange(len(windows))  # hashes of different windows agree: each is searched for itself
    found = index.least(*index.search(text.astype(np.int32), windows[once] + window, window))[where] if len(windows) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(found, pa.int64()))
    return pa.table({"h": pa.array(h), "least": lists})


def _finish(pending: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in _small(batches):
            removed, shas = [], []
            for body, hits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = unpack(body).split()
                cover = np.zeros(len(words) + 1, dtype=np.int64)
                for hit in hits or []:
                    for i in range(SEGMENT_WINDOWS):
                        if hit["mask"] >> i & 1:
                            cover[hit["pos"] + i] += 1
                            cover[hit["pos"] + i + window] -= 1
                gone = np.cumsum(cover)[:-1] > 0
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist()) if not g)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(removed, pa.int64()), pa.array(shas)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return pending.select("doc_id", "body", "hits", "n_words").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col)
    found = _anchor_rows(rows, window)
    repeated = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    mine = found.join(repeated, "anchor").select("k", "anchor", (F.col("n") > HOT).alias("hot"), F.lit(None).cast("long").alias("copy"))
    copies = _copies(rows).select("k", F.lit(None).cast("long").alias("anchor"), F.lit(False).alias("hot"), F.col("id").alias("copy"))
    notes = mine.unionByName(copies).groupBy("k").agg(
        F.collect_set("copy").alias("copies"), F.collect_set(F.when(~F.col("hot"), F.col("anchor"))).alias("some"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot")
    )

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([pack(t.encode()) for t in batch.column(3).to_pylist()], pa.binary())], ["k", "doc_id", "id", "body"])

    packed = rows.mapInArrow(shrink, "k long, doc_id long, id long, body binary")
    parts = materialize(_segments(packed.join(notes, "k", "left").select("k", "doc_id", "id", "body", F.coalesce(F.array_contains("copies", F.col("id")), F.lit(False)).alias("copy"), "some", "hot"), window), "segments")
    documents, segments = parts.where("kind = 0"), parts.where("kind = 1")
    words = segments.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = max(shuffle_partitions(spark), words // (8 * SHARD_WORDS))
    least = (
        segments.select(F.pmod(F.xxhash64("shard_key"), F.lit(shards)).alias("shard"), "h", "words", "least")
        .groupBy("shard")
        .applyInArrow(lambda t: _search_shard(t, window), "h long, least array<long>")
    )
    hits = (
        documents.where("sha IS NULL")
        .select("k", "id", F.explode("places").alias("p"))
        .select("k", "id", F.col("p.h").alias("h"), F.col("p.pos").alias("pos"))
        .distinct()
        .join(least, "h")
        .select("k", "id", "pos", F.expr("aggregate(transform(least, (m, i) -> IF(m < id, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)").alias("mask"))
        .where("mask <> 0")
        .groupBy("k", "id")
        .agg(F.collect_list(F.struct("pos", "mask")).alias("hits"))
    )
    pending = _finish(documents.where("sha IS NULL").select("k", "id", "doc_id", "n_words", "body").join(hits, ["k", "id"], "left"), window)
    gone = F.when(F.col("sha") == F.sha2(F.lit(""), 256), F.col("n_words")).otherwise(F.lit(0)).cast("long")
    done = documents.where("sha IS NOT NULL").select("doc_id", "n_words", gone.alias("n_removed"), F.col("sha").alias("kept_sha256"))
    return done.unionByName(pending)


#: Windows as joined words, the least document of each, and the words that no repeated window covers.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), i AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13
), k AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 12), ' ') AS s FROM i
), f AS (SELECT s, min(doc_id) AS m FROM k GROUP BY s
), r AS (SELECT doc_id, p FROM k JOIN f USING (s) WHERE m < doc_id
), g AS (SELECT DISTINCT doc_id, p + o AS q FROM r, (SELECT unnest(range(13)) AS o)
), u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d
), v AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY u.q) AS kept, count(*) AS n FROM u ANTI JOIN g ON u.doc_id = g.doc_id AND u.q = g.q GROUP BY u.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN v USING (doc_id)
"""

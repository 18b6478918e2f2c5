"""Benchmark decontamination by greedy string tiling.

Texts are compared as runs of lower-case words. Documents whose word grams share a seed with a test item are tiled
against it: the longest common runs of words that no tile covers yet are marked, again and again, down to ``least``
words. Whether there is a run of some length, and the first one, running Karp-Rabin tells: rolling hashes of the unmarked
windows of both sides meet, and hits are compared word by word. Words themselves are 64-bit hashes. An item leaks into a document when tiles cover at least
``threshold`` of its words, in whatever order they stand there.

Documents are read once and nothing is shuffled. The items are broadcast while their text is at most ``bound`` bytes; a
larger benchmark is dealt into parts of that size, and the documents are read once for each part.

Defined results: null and empty texts leak nothing; an item with fewer than ``least`` words is too short to be tested; of
equally long matches the first in the document, then in the item, is marked; very long texts are read whole; repeated
documents and items and rows of one id are reported each for itself; a null id stays null; empty tables give no rows; extra
columns are ignored by ``leaks`` and kept by ``drop_leaking``, whatever their names; words are runs of ASCII letters and
digits and of all other non-ASCII characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, gram_hashes, slices

#: Bytes of benchmark text that are broadcast at once.
BROADCAST_BYTES = 16 << 20
LEAST, THRESHOLD = 4, 0.5

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes outside words become spaces, capitals small letters.
_FOLD = np.where(_WORD, np.arange(256), 0x20).astype(np.uint8)
_FOLD[0x41:0x5B] += 0x20
_FILTER_BITS = 22


def _word_hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the folded words of all documents, and the index of each document's first word."""
    folded = Texts(_FOLD[texts.data], texts.offsets)
    starts, ends, first = folded.words()
    return folded.word_hashes(starts, ends), first


class Items:
    """The test items as word hashes, with a table of their seeds: runs of ``least`` words, and which items have each how often."""

    def __init__(self, items: list[tuple[int, str | None]], least: int, threshold: float):
        self.least, self.threshold = least, threshold
        bodies = [(t or "").lower().encode() for _, t in items]
        data = np.frombuffer(b"".join(bodies), dtype=np.uint8)
        hashes, first = _word_hashes(Texts(data, np.cumsum([0, *map(len, bodies)])))
        self.ids = [i for i, _ in items]
        self.words = [hashes[first[k] : first[k + 1]] for k in range(len(items))]
        self.sizes = np.diff(first)
        grams, owner = gram_hashes(hashes, least), np.repeat(np.arange(len(items)), self.sizes)
        inside = np.flatnonzero(owner[: len(grams)] == owner[least - 1 :][: len(grams)])
        self.seeds, seed = np.unique(grams[inside], return_inverse=True)
        #: Where each seed stands among the words of all items, and the item of each word.
        self.spots, self.owner = inside[np.argsort(seed, kind="stable")], owner
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(seed, minlength=len(self.seeds)))]).astype(np.int64)
        by_item = np.unique((owner[inside] << 32) | seed)
        self.seeds_of, self.begin_of = by_item & 0xFFFFFFFF, np.searchsorted(by_item >> 32, np.arange(len(items) + 1))
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[self.seeds >> np.uint64(64 - _FILTER_BITS)] = True

    def candidates(self, texts: Texts) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(document, item, the document's words, its words that a shared seed covers) where shared seeds cover the threshold on both sides."""
        hashes, first = _word_hashes(texts)
        grams = gram_hashes(hashes, self.least)
        at = np.flatnonzero(self.filter[grams >> np.uint64(64 - _FILTER_BITS)])
        if not len(at) or not len(self.seeds):
            return
        seed = np.minimum(np.searchsorted(self.seeds, grams[at]), len(self.seeds) - 1)
        doc = np.searchsorted(first, at, side="right") - 1
        real = (self.seeds[seed] == grams[at]) & (at + self.least <= first[doc + 1])
        at, seed, doc = at[real], seed[real], doc[real]
        bounds = np.searchsorted(doc, np.arange(texts.n + 1))
        for d in np.unique(doc).tolist():
            places, own = at[bounds[d] : bounds[d + 1]] - first[d], seed[bounds[d] : bounds[d + 1]]
            # A tile's words lie in runs of seeds, so no item can leak of which shared seeds cover too little, in it or in the document.
            shared = np.unique(own)
            lens = self.begin[shared + 1] - self.begin[shared]
            spots = self.spots[np.repeat(self.begin[shared] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())]
            items, covers = np.unique(self.owner[np.unique(spots[:, None] + np.arange(self.least))], return_counts=True)
            words = hashes[first[d] : first[d + 1]]
            for k in items[covers >= self.threshold * self.sizes[items]].tolist():
                mine = np.zeros(len(words) + 1, dtype=np.int64)
                hit = places[np.isin(own, self.seeds_of[self.begin_of[k] : self.begin_of[k + 1]])]
                np.add.at(mine, hit, 1)
                np.add.at(mine, hit + self.least, -1)
                covered = np.cumsum(mine)[:-1] > 0
                if covered.sum() >= self.threshold * self.sizes[k]:
                    yield d, k, words, covered


def tiles(doc: np.ndarray, item: np.ndarray, open_doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of an item by the open words of a document: (place in document, place in item, words), words marked at most once.

    The greatest length of a common run of free words is found by halving; its matches are marked in order; then the next
    greatest length follows. A search costs one pass of rolling hashes over both sides, however often words repeat.
    """
    kept = np.flatnonzero(open_doc)  # stretches of open words, a closed place between them
    gaps = np.concatenate([[0], np.cumsum(np.diff(kept) > 1)]) if len(kept) else kept
    place = np.zeros(int(gaps[-1]) + len(kept) if len(kept) else 0, dtype=np.int64)
    free_doc, words = np.zeros(len(place), dtype=bool), np.zeros(len(place), dtype=np.uint64)
    at = np.arange(len(kept)) + gaps
    place[at], words[at], free_doc[at] = kept, doc[kept], True
    free_item = np.ones(len(item), dtype=bool)
    out: list[tuple[int, int, int]] = []
    most = min(len(item), len(words))
    while True:
        low, high = least - 1, most
        while low < high:
            size = (low + high + 1) // 2
            if _common(words, item, free_doc, free_item, size):
                low = size
            else:
                high = size - 1
        if low < least:
            return sorted(((int(place[p]), q, n) for p, q, n in out), key=lambda t: (-t[2], t[0], t[1]))
        while match := _common(words, item, free_doc, free_item, low):
            p, q = match
            free_doc[p : p + low] = free_item[q : q + low] = False
            out.append((p, q, low))
        most = low - 1


def _common(doc: np.ndarray, item: np.ndarray, free_doc: np.ndarray, free_item: np.ndarray, size: int) -> tuple[int, int] | None:
    """The first common run of ``size`` free words: the least place in the document, then in the item."""

    def windows(words: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(words) < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        sums = np.concatenate([[0], np.cumsum(free)])
        at = np.flatnonzero(sums[size:] - sums[:-size] == size)
        return at, gram_hashes(words, size)[at]

    at_item, rolled_item = windows(item, free_item)
    at_doc, rolled_doc = windows(doc, free_doc)
    for k in np.flatnonzero(np.isin(rolled_doc, rolled_item)).tolist():
        p = int(at_doc[k])
        for q in at_item[rolled_item == rolled_doc[k]].tolist():
            if (doc[p : p + size] == item[q : q + size]).all():  # nearly always: hashes of different runs hardly agree
                return p, q
    return None


def _parts(benchmark: DataFrame, least: int, threshold: float, bound: int, id_col: str, text_col: str) -> Iterator[Items]:
    """The benchmark in parts of about ``bound`` bytes of text."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // bound)
    for k in range(n):
        mine = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Items([(r["item_id"], r["text"]) for r in mine.collect()], least, threshold)  # at most about bound bytes


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, bound: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, n_item_words, n_covered, n_tiles, coverage) of all pairs whose coverage reaches the threshold."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text")).alias("text"))
    names = ["doc_id", "item_id", "n_item_words", "n_covered", "n_tiles", "coverage"]
    schema = "doc_id long, item_id long, n_item_words long, n_covered long, n_tiles long, coverage double"
    out = spark.createDataFrame([], schema)
    for items in _parts(benchmark, least, threshold, bound, "item_id", "text"):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                for part, texts in slices(batch, "text"):
                    ids = part.column(0).to_pylist()
                    found = []
                    for d, k, words, covered in items.candidates(texts):
                        item = items.words[k]
                        got = tiles(words, item, covered, items.least)
                        n = sum(t[2] for t in got)
                        if n >= threshold * len(item):
                            found.append((ids[d], items.ids[k], len(item), n, len(got), n / len(item)))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if j < 5 else pa.float64()) for j, c in enumerate(map(list, zip(*found)))], names)

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, bound: int = BROADCAST_BYTES) -> DataFrame:
    """The rows and columns of docs without the documents into which an item leaks; one pass for each part of the benchmark."""
    spark, schema = docs.sparkSession, docs.schema
    folded = "_folded"
    while folded in docs.columns:
        folded += "_"
    out = docs
    for items in _parts(benchmark, least, threshold, bound, "item_id", "text"):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                for part, texts in slices(batch, folded):
                    keep = np.ones(texts.n, dtype=bool)
                    for d, k, words, covered in items.candidates(texts):
                        if keep[d] and sum(t[2] for t in tiles(words, items.words[k], covered, items.least)) >= threshold * len(items.words[k]):
                            keep[d] = False
                    yield part.select(schema.names).filter(pa.array(keep))

        out = out.withColumn(folded, F.lower(F.col("text"))).mapInArrow(run, schema)
    return out

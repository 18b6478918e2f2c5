"""Lexical retrieval packing: sequences whose documents share rare words.

Documents are routed by a lexical key of the whole text: the least hash of its word pairs, so texts with much in common
tend to share it at every size of the corpus. The keys are cut at their quantiles into one range for each task, and rows
with the same key (copies, a frequent pair) are told apart by further bits, so no key makes a task large. In the order of
their keys they are gathered into index shards of about ``shard_bytes`` of text. A shard holds a BM25 inverted index:
postings (document, weight) by word, cut out of one sort of the shard's word hashes; the few words of over an eighth of the
shard's documents stand in a matrix instead. The first unused document seeds a window of ``length`` tokens; all its words
are looked up, and its unused neighbours, best first (ties: in the shard's order), fill the window greedily. The document
at the window's end is cut there; what is left of it opens the next window as its seed. When a seed has no unused
neighbour, the next unused document follows. A task's last window stays open; one more pass puts the open windows of all
tasks together (``GATHERED`` to a task), so only the last sequence of each task of that pass is padded. Every id lies in
exactly one piece. Texts are shuffled once; memory is bounded by a shard, or by one longer text. Neighbours are looked for in the seed's
shard: those whose keys lie elsewhere aren't found (the README states how many are).

Ids come from the tokenizer, word by word: its patterns match no white space and its normaliser doesn't look across it,
so the ids of a text are those of its white-space-separated words. Each distinct word of a shard is encoded once, and known
ones not at all: their ids lie in one pool, in a table of bounded size by 64-bit hashes of the words.

Defined results: a null or empty text is the end id alone; repeated rows and equal ids are packed each for itself; a null
id is kept as it is; very long texts are packed whole, over several sequences; extra columns are ignored, whatever their
names; an empty table gives no rows. A lost task is run again on the same rows: the cuts between tasks are fixed before.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, gram_hashes, materialize, mix, shuffle_partitions, slices, string_views

SHARD_BYTES = 4 << 20
#: Entries of the tables of pieces and of words; a full one starts anew (with the words of the shard), which changes no id.
CACHE_ENTRIES, WORD_ENTRIES = 150_000, 600_000
#: Longer words have cryptographic hashes, and longer pieces aren't kept.
CACHE_CHARS = 64
#: BM25's saturation and length parameters, and the share of documents from which a word stands in the matrix.
K1, B, FREQUENT = 1.2, 0.75, 1 / 8
#: Bits of a key that tell rows of the same word pair apart.
TIE_BITS = np.uint64(24)

_ENCODERS: dict[str, WordEncoder] = {}


#: Plain texts have Latin letters, ASCII digits, signs and blanks only; runs of letters, each digit and runs of signs are tokenized apart.
_PLAIN = re.compile("[a-zß-öø-ɏ!-~ \t\n\r\x0b\f]*")
_PIECES = re.compile("[a-zß-öø-ɏ]+|[0-9]|[!-/:-@[-`{-~]+")


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit values, by tables of words and of the pieces that the tokenizer encodes apart.

    A plain word is lower-cased and cut as the tokenizer would cut it. Any other one (with an apostrophe, a special token's
    sign, other letters) goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, n in vocabulary.items():
            self.ends[n] = token.endswith("</w>")
        self.ids: dict[str, bytes] = {}
        #: The table of words: sorted hashes, and where in the pool the ids of each begin and how many there are.
        self.known = np.zeros(0, dtype=np.uint64)
        self.begin = self.size = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype="<u4")

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """The encoder of this Python worker: later tasks find the dictionary filled."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    @staticmethod
    def cut(word: str) -> list[str]:
        """The pieces of a word that the tokenizer encodes apart (or the word itself, where it isn't plain)."""
        low = word.lower()
        if "'" in low or "<" in low or not _PLAIN.fullmatch(low):
            return [word]
        return _PIECES.findall(low)

    def _learn(self, new: list[str]) -> None:
        plain = [p for p in new if _PIECES.fullmatch(p) and "'" not in p and "<" not in p]
        whole = set(new).difference(plain)
        for at in range(0, len(plain), 4000):
            some = plain[at : at + 4000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(cuts) != len(some):  # the vocabulary doesn't mark where a piece ends
                whole.update(some)
                continue
            body = ids.tobytes()
            self.ids.update(zip(some, (body[a:b] for a, b in zip([0, *cuts], cuts))))
        if whole:
            some = list(whole)
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.ids[p] = np.array(e.ids, dtype="<u4").tobytes()

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word."""
        cuts = [self.cut(w.decode()) for w in words]
        if len(self.ids) > CACHE_ENTRIES:
            self.ids.clear()
        new = list(set().union(*cuts).difference(self.ids))
        self._learn(new)
        get = self.ids.__getitem__
        out = [b"".join(map(get, c)) for c in cuts]
        for p in new:
            if len(p) > CACHE_CHARS:
                del self.ids[p]
        return out

    def encode(self, words: Words, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a slice, each with the end id behind them, and where each text's begin (n + 1)."""
        distinct, index, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        hit = self.known[at] == distinct if len(self.known) else np.zeros(len(distinct), dtype=bool)
        begin, size = np.zeros(len(distinct), dtype=np.int64), np.zeros(len(distinct), dtype=np.int64)
        begin[hit], size[hit] = self.begin[at[hit]], self.size[at[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            data, starts, ends = words.texts.data, words.starts[index[new]].tolist(), words.ends[index[new]].tolist()
            ids = self._encoded([data[s:e].tobytes() for s, e in zip(starts, ends)])
            size[new] = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            begin[new] = len(self.pool) + np.cumsum(size[new]) - size[new]
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), dtype="<u4")])
        size_of, begin_of = size[inverse], begin[inverse]
        stops = np.cumsum(size_of)
        tokens = self.pool[np.arange(stops[-1] if len(stops) else 0) + np.repeat(begin_of - stops + size_of, size_of)]
        before = np.append(0, stops)[words.first]  # ids before each text
        out = np.insert(tokens, before[1:], np.uint32(end))
        if len(new):
            self._keep(distinct, begin, size, new)
        return out, before + np.arange(len(before))

    def _keep(self, distinct: np.ndarray, begin: np.ndarray, size: np.ndarray, new: np.ndarray) -> None:
        """Adds the new words to the table; a full table starts anew with the words of this slice."""
        if len(self.known) + len(new) > WORD_ENTRIES:
            stops = np.cumsum(size)
            self.pool = self.pool[np.arange(stops[-1]) + np.repeat(begin - stops + size, size)]
            self.known, self.begin, self.size = distinct, stops - size, size
            return
        known = np.concatenate([self.known, distinct[new]])
        order = np.argsort(known, kind="stable")  # two sorted runs
        self.known, self.begin, self.size = known[order], np.concatenate([self.begin, begin[new]])[order], np.concatenate([self.size, size[new]])[order]


class Words:
    """The words of a slice of texts: where they stand, and their hashes."""

    def __init__(self, texts: Texts):
        self.texts = texts
        self.starts, self.ends, self.first = texts.words()
        self.hashes = texts.word_hashes(self.starts, self.ends)
        for k in np.flatnonzero(self.ends - self.starts > CACHE_CHARS).tolist():
            word = texts.data[self.starts[k] : self.ends[k]].tobytes()
            self.hashes[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def _changes(values: np.ndarray) -> np.ndarray:
    """Where a sorted array has a new value."""
    out = np.ones(len(values), dtype=bool)
    out[1:] = values[1:] != values[:-1]
    return out


class Bm25:
    """The inverted index of a shard: postings by word, a matrix of the frequent words, and the words of each document."""

    def __init__(self, words: Words):
        texts, counts = words.texts, np.diff(words.first)
        # One sort of (word hash, document) keys: the hash keeps the bits that the documents' numbers leave.
        bits = np.uint64(max(texts.n - 1, 1).bit_length())
        keys = words.hashes >> bits << bits | np.repeat(np.arange(texts.n, dtype=np.uint64), counts)
        keys.sort()
        at = np.flatnonzero(_changes(keys))
        tf = np.diff(np.append(at, len(keys))).astype(np.float32)
        keys = keys[at]
        doc = (keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        fresh = _changes(keys >> bits)
        term = np.cumsum(fresh) - 1
        df = np.bincount(term)
        shared = df[term] > 1  # a word of one document has no neighbours
        doc, tf, term = doc[shared], tf[shared], term[shared]
        idf = np.log(1 + (texts.n - df + 0.5) / (df + 0.5)).astype(np.float32)
        norm = (K1 * (1 - B + B * counts / max(counts.mean(), 1e-9))).astype(np.float32) if texts.n else np.zeros(0, np.float32)
        weight = (idf[term] * tf * np.float32(K1 + 1) / (tf + norm[doc])).astype(np.float32)
        often = df[term] > max(texts.n * FREQUENT, 2)
        self.n = texts.n
        self.rows, row = np.unique(term[often], return_inverse=True)
        self.matrix = np.zeros((len(self.rows), texts.n), dtype=np.float32)
        self.matrix[row, doc[often]] = weight[often]
        self.weight, self.doc, term = weight[~often], doc[~often], term[~often]
        fresh = _changes(term)
        self.begin = np.append(np.flatnonzero(fresh), len(term))
        # The words of each document, by their place in the postings.
        by_doc = np.argsort(self.doc, kind="stable")
        self.place = (np.cumsum(fresh) - 1)[by_doc]
        self.of_doc = np.searchsorted(self.doc[by_doc], np.arange(texts.n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all documents for the words of the seed, each word once."""
        out = np.add.reduce(self.matrix[self.matrix[:, seed] > 0], axis=0)
        words = self.place[self.of_doc[seed] : self.of_doc[seed + 1]]
        if len(words):
            begin, sizes = self.begin[words], self.begin[words + 1] - self.begin[words]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1]) + np.repeat(begin - ends + sizes, sizes)  # all postings of the words
            out = out + np.bincount(self.doc[at], self.weight[at], self.n)
        return out

    def neighbours(self, seed: int, used: np.ndarray, most: int = 64) -> np.ndarray:
        """The ``most`` best unused documents that share a word with the seed (more where the last are equally good), best first (ties: in order)."""
        scores = self.scores(seed)
        scores[used] = 0
        some = np.flatnonzero(scores)
        if len(some) > most:
            some = some[scores[some] >= np.partition(scores[some], -most)[-most]]
        return some[np.argsort(-scores[some], kind="stable")]


def reading_order(index: Bm25, sizes: np.ndarray, length: int, fill: int) -> Iterator[int]:
    """The documents of a shard, each once: each window's seed, then its neighbours until the window is full."""
    used = np.zeros(len(sizes), dtype=bool)
    nxt, seed, queue = 0, -1, []
    for _ in range(len(sizes)):
        if seed >= 0 and not queue:  # a new seed, or one that has more neighbours than were asked for
            queue = index.neighbours(seed, used)[::-1].tolist()
        fresh = not queue
        if queue:
            take = queue.pop()
        else:
            while used[nxt]:
                nxt += 1
            take = nxt
        used[take] = True
        yield take
        full = fill + int(sizes[take])
        fill = full % length
        if fresh or full >= length:  # a new seed, or the document that opens the next window
            seed, queue = take, []


def lexical_keys(texts: Texts, ties: np.ndarray) -> np.ndarray:
    """A key for each text of a slice: the least hash of its word pairs (a text of one word: of it; of none: 0), then bits of the tie."""
    starts, ends, first = texts.words()
    words = texts.word_hashes(starts, ends)
    key = np.zeros(texts.n, dtype=np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        pairs = mix(np.append(gram_hashes(words, 2), np.uint64(0)))
        last = first[some + 1] - 1
        pairs[last] = np.uint64(0xFFFFFFFFFFFFFFFF)  # the last word of a text starts no pair
        alone = last == first[some]
        pairs[last[alone]] = mix(words[last[alone]])
        key[some] = mix(np.minimum.reduceat(pairs, first[some]))
    low = (np.uint64(1) << TIE_BITS) - np.uint64(1)
    # Keys are Spark longs: one bit less keeps their order.
    return (key & ~low | mix(ties) & low) >> np.uint64(1)


def routed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of every row, dealt to tasks by ranges of the lexical key and sorted by it.

    The cuts are quantiles of the keys of all rows: one number for each task reaches the driver. Rows must come in the same
    order when a task is run again, as those of a table do.
    """
    parts = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        at = 0
        for batch in batches:
            for part, texts in slices(batch, "text"):
                ids = part.column(0).fill_null(-1).to_numpy().astype(np.uint64)
                yield part, lexical_keys(texts, mix(ids) + np.arange(at, at + texts.n, dtype=np.uint64))
                at += texts.n

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key in keyed(batches):
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])

    points = [i / parts for i in range(1, parts)] or [0.5]
    cuts = rows.mapInArrow(keys, "key long").agg(F.percentile_approx("key", points, 20 * parts)).first()[0] or []
    cuts = np.unique(np.array(cuts, dtype=np.int64))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, key in keyed(batches):
            key = key.view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(key), pa.array(np.searchsorted(cuts, key), pa.int32())], ["doc_id", "text", "key", "task"])

    out = rows.mapInArrow(dealt, "doc_id long, text string, key long, task int")
    return out.repartitionById(parts, F.col("task")).sortWithinPartitions("key", "doc_id").select("doc_id", "text")


_NAMES = ["doc_id", "start", "length", "ids_crc32", "ids", "doc_tokens", "sequence_id", "offset", "open"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, ids binary, doc_tokens long, sequence_id long, offset long, open boolean"
#: Open windows that a task of the last pass gathers.
GATHERED = 2048


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)


def _pieces(docs: DataFrame, path: str, length: int, end: int, shard_bytes: int, with_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """All pieces; those of a task's last window are marked open and have their ids, the others only if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(path)
        number, fill = TaskContext.get().partitionId() << 40, 0
        current: list[tuple] = []  # pieces of the open window

        def shard(ids: list[int | None], body: list[np.ndarray], lengths: list[int]) -> Iterator[pa.RecordBatch]:
            nonlocal number, fill, current
            texts = Texts(np.concatenate(body) if body else np.zeros(0, np.uint8), np.cumsum([0, *lengths]))
            words = Words(texts)
            tokens, begin = encoder.encode(words, end)
            sizes = np.diff(begin)
            done: list[tuple] = []
            for d in reading_order(Bm25(words), sizes, length, fill):
                at, n = 0, int(sizes[d])
                while at < n:
                    took = min(length - fill, n - at)
                    piece = tokens[begin[d] + at : begin[d] + at + took].tobytes()
                    current.append((ids[d], at, took, crc32(piece), piece, n, number, fill, False))
                    at, fill = at + took, fill + took
                    if fill == length:
                        done += current if with_ids else [(*p[:4], None, *p[5:]) for p in current]
                        number, fill, current = number + 1, 0, []
                if len(done) >= 2000:
                    yield _rows(done)
                    done = []
            if done:
                yield _rows(done)

        ids: list[int | None] = []
        body: list[np.ndarray] = []
        lengths: list[int] = []
        held = 0
        for batch in batches:
            data, offsets = string_views(batch.column(1))
            for k, d in enumerate(batch.column(0).to_pylist()):
                text = data[offsets[k] : offsets[k + 1]]
                ids.append(d)
                body.append(text.copy())
                lengths.append(len(text))
                held += len(text)
                if held >= shard_bytes:
                    yield from shard(ids, body, lengths)
                    ids, body, lengths, held = [], [], [], 0
        if ids:
            yield from shard(ids, body, lengths)
        if current:
            yield _rows([(*p[:-1], True) for p in current])

    return routed(docs, id_col, text_col).mapInArrow(run, _SCHEMA)


def _gathered(opened: DataFrame, parts: int, length: int, with_ids: bool) -> DataFrame:
    """The pieces of open windows (one of each task at most), one after the other in windows of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, fill = (parts + TaskContext.get().partitionId()) << 40, 0
        for batch in batches:
            out = []
            for doc, start, _, _, ids, n, *_ in zip(*(c.to_pylist() for c in batch.columns)):
                at = 0
                while at < len(ids):
                    piece = ids[at : at + 4 * (length - fill)]
                    out.append((doc, start + at // 4, len(piece) // 4, crc32(piece), piece if with_ids else None, n, number, fill, False))
                    at, fill = at + len(piece), fill + len(piece) // 4
                    if fill == length:
                        number, fill = number + 1, 0
            if out:
                yield _rows(out)

    tasks = -(-parts // GATHERED)
    # Windows stay whole and in order, so that neighbours in a window stay neighbours.
    return opened.repartition(tasks, "sequence_id").sortWithinPartitions("sequence_id", "offset").mapInArrow(run, _SCHEMA)


def _packed(docs: DataFrame, path: str, length: int, end: int, shard_bytes: int, with_ids: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = materialize(_pieces(docs, path, length, end, shard_bytes, with_ids, id_col, text_col), "pieces")
    return found.where("NOT open").unionByName(_gathered(found.where("open"), shuffle_partitions(docs.sparkSession), length, with_ids))


def pack(docs: DataFrame, path: str, length: int = 2048, end: int = 1, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, ids, doc_tokens, sequence_id, offset); ids are little-endian unsigned 32-bit values."""
    return _packed(docs, path, length, end, shard_bytes, True, id_col, text_col).select("doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset")


def packing_digest(docs: DataFrame, path: str, length: int = 2048) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    return _packed(docs, path, length, 1, SHARD_BYTES, False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

"""Which tokens of two vocabularies stand for the same bytes, counted over the whole corpus.

A (byte-level BPE) encodes a blank and the text, B (pieces with a mark for blanks, which it adds in front) the text. Both
cut at a blank or line feed behind other characters: A's pre-tokens have no white space behind other characters, B's pieces
no mark behind other characters and no line feed (checked when it is loaded). So a text is a row of chunks that are aligned
each for itself, and equal chunks are aligned once: the offsets where both have a token's end cut a chunk into groups.

Identity map: ``ident[a]`` is the B id with the bytes of A id ``a``. A group of one A and one B token that are each
other's identity is exact and gives its pair at once; only other groups are multiplied out, by distinct ids with how often
they stand. In how many documents an exact pair is linked is counted in a vector as long as A's vocabulary; all other pairs
are summed by block (``BLOCK_BYTES`` of texts, a longer one alone) and go through the shuffle as (pair, documents).

A document's ``n_best`` and ``count_sum`` are sums over its chunks, and a chunk's are sums over its pairs. So a block keeps
for each document which of the block's chunks it has, writes that, and meets the counts of its own pairs again in a join on
the pair and one cogroup by block. Pairs of one block only have the count the block knows. Texts cross no network.

Broadcast and collected are two vectors of A's length. Defined results: null and empty texts, and texts whose tokens of A
or B don't spell the blank and the text, have no tokens: zeros and an empty digest; an empty table gives no rows; very long
texts are read whole and very long groups are multiplied out in parts; of B ids with equal bytes the least that isn't a
byte piece is the identity; pairs of equal count are all the best; repeated rows and rows of one id are documents each for
itself; ids are taken as long; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

BLOCK_BYTES = 4 << 20
#: Chunks and their characters that a worker keeps aligned (beyond that it forgets rare ones, which changes no result), and
#: chunks that are aligned at once.
CACHE_CHUNKS, CACHE_CHARS, CHUNKS_AT_ONCE = 400_000, 16 << 20, 20_000
#: Chunks that are encoded as one text.
UNIT = 200
#: Pairs that are multiplied out at once.
PAIRS_AT_ONCE = 4 << 20
ID_BITS = 20
_ID = (1 << ID_BITS) - 1
MARK = "▁"

#: What some library may take for white space: no chunk is cut behind one.
_WS = r"\s\u180e\u200b\u2060\ufeff"
_SPACES = frozenset(c for c in map(chr, range(0x110000)) if c.isspace() or c in "\u180e\u200b\u2060\ufeff")
_CHUNK = re.compile(rf"[ \n][{_WS}]*[^{_WS}]*(?:(?![ \n])[{_WS}]+[^{_WS}]*)*")

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])


def _ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of runs of an array, one after the other."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


def _run_sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of values[ptr[i]:ptr[i + 1]]."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[ptr[1:]] - sums[ptr[:-1]]


def _ptr(lens: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of their weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weights, first)


class Vocabularies:
    """Both tokenizers, the bytes of their ids, and the identity map."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        alphabet = _byte_alphabet()
        words = self.a.get_vocab(with_added_tokens=True)
        bytes_a = [b""] * (max(words.values()) + 1)
        for token, i in words.items():
            bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        bytes_b, spelled, byte_pieces = [], {}, {}
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i):
                bytes_b.append(piece.encode())
            elif self.b.is_byte(i):
                bytes_b.append(bytes([int(piece[3:5], 16)]))
                byte_pieces.setdefault(bytes_b[-1], i)
            else:
                if MARK in piece.lstrip(MARK) or "\n" in piece:
                    raise ValueError(f"piece {piece!r} has a mark or line feed inside: texts can't be cut there")
                bytes_b.append(piece.replace(MARK, " ").encode())
                spelled.setdefault(bytes_b[-1], i)
        if max(len(bytes_a), len(bytes_b)) > _ID:
            raise ValueError(f"ids take more than {ID_BITS} bits")
        same = byte_pieces | spelled
        self.ident = np.array([same.get(b, -1) for b in bytes_a], dtype=np.int64)
        (self.data_a, self.at_a), (self.data_b, self.at_b) = _joined(bytes_a), _joined(bytes_b)
        self.of_a, self.of_b = np.diff(self.at_a), np.diff(self.at_b)
        self.mark = self.b.piece_to_id(MARK)
        #: An exact group as text, by its A id.
        self.exact_text = np.array([f"{a}|{b}" for a, b in enumerate(self.ident.tolist())], dtype=object)

    def encode_a(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]

    def encode_b(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks: B's own blank in front is the chunk's first character, or (before a line feed) no part of it."""
        found = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return [[self.mark] if c == " " else ids if c[0] == " " else ids[1:] for c, ids in zip(chunks, found)]

    def is_exact(self, keys: np.ndarray) -> np.ndarray:
        return self.ident[keys >> ID_BITS] == (keys & _ID)


class _Side:
    """Tokens of a row of chunks: ids, and how many each chunk has."""

    def __init__(self, ids: list[list[int]]):
        self.lens = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids = np.fromiter(chain.from_iterable(ids), np.int64, int(self.lens.sum()))

    def keep(self, good: np.ndarray) -> None:
        self.ids, self.lens = self.ids[np.repeat(good, self.lens)], self.lens[good]

    def spelled(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return data[_ragged(at[self.ids], at[self.ids + 1] - at[self.ids])]


def _encoded(voc: Vocabularies, texts: list[str]) -> tuple[np.ndarray, _Side, _Side]:
    """Which texts both sides spell, and their tokens."""
    a, b = _Side(voc.encode_a(texts)), _Side(voc.encode_b(texts))
    raw = [t.encode() for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    good = (_run_sums(voc.of_a[a.ids], _ptr(a.lens)) == sizes) & (_run_sums(voc.of_b[b.ids], _ptr(b.lens)) == sizes)
    a.keep(good)
    b.keep(good)
    data = np.frombuffer(b"".join(r for r, g in zip(raw, good) if g), dtype=np.uint8)
    wrong = (a.spelled(voc.data_a, voc.at_a) != data) | (b.spelled(voc.data_b, voc.at_b) != data)
    if wrong.any():
        right = _run_sums(wrong, _ptr(sizes[good])) == 0
        a.keep(right)
        b.keep(right)
        good[good] = right
    return good, a, b


class Aligned:
    """What alignment says of chunks: counts of tokens, groups and links, groups as text, and distinct pairs with how often they link."""

    def __init__(self, voc: Vocabularies, chunks: list[str]):
        n = len(chunks)
        raw = [c.encode() for c in chunks]
        sizes = np.fromiter(map(len, raw), np.int64, n)
        # Chunks are encoded many at a time, one after the other as they could stand in a text; those that end in white space go alone.
        ends_in_space = np.array([c[-1] in _SPACES for c in chunks], dtype=bool)
        closed, alone = np.flatnonzero(~ends_in_space), np.flatnonzero(ends_in_space)
        rows = [closed[k : k + UNIT] for k in range(0, len(closed), UNIT)]
        good, a, b = _encoded(voc, ["".join(chunks[c] for c in row.tolist()) for row in rows])
        told = np.concatenate([r for r, g in zip(rows, good) if g] or [closed[:0]])
        alone = np.sort(np.concatenate([alone, *(r for r, g in zip(rows, good) if not g)]))
        for side, lens in ((a, voc.of_a), (b, voc.of_b)):  # tokens of each chunk, from those of the row
            side.lens = np.bincount(np.searchsorted(np.cumsum(sizes[told]), np.cumsum(lens[side.ids])), minlength=len(told))
        good, more_a, more_b = _encoded(voc, [chunks[c] for c in alone.tolist()])
        for side, more in ((a, more_a), (b, more_b)):
            side.ids, side.lens = np.concatenate([side.ids, more.ids]), np.concatenate([side.lens, more.lens])
        chunk_of = np.concatenate([told, alone[good]])
        self.good = np.zeros(n, dtype=bool)
        self.good[chunk_of] = True
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(n, np.int64) for _ in range(4))
        self.n_a[chunk_of], self.n_b[chunk_of] = a.lens, b.lens
        self._group(voc, a, b, chunk_of, sizes[chunk_of])

    def _group(self, voc: Vocabularies, a: _Side, b: _Side, chunk_of: np.ndarray, sizes: np.ndarray) -> None:
        ends_a, ends_b = np.cumsum(voc.of_a[a.ids]), np.cumsum(voc.of_b[b.ids])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        at_a, at_b = _ptr(in_a), _ptr(in_b)
        at = np.searchsorted(np.cumsum(sizes), cuts)  # the chunk of each group, among the good ones
        groups = np.bincount(at, minlength=len(chunk_of))
        group_at = _ptr(groups)
        self.n_groups[chunk_of], self.n_links[chunk_of] = groups, _run_sums(in_a * in_b, group_at)

        exact = (in_a == 1) & (in_b == 1)
        exact[exact] = voc.ident[a.ids[at_a[:-1][exact]]] == b.ids[at_b[:-1][exact]]
        first = a.ids[at_a[:-1][exact]]
        written = np.empty(len(cuts), dtype=object)
        written[exact] = voc.exact_text[first]
        text_of = lambda ids, at: [",".join(map(str, ids[i:j])) for i, j in zip(at[:-1][~exact].tolist(), at[1:][~exact].tolist())]
        written[~exact] = [f"{x}|{y}" for x, y in zip(text_of(a.ids.tolist(), at_a), text_of(b.ids.tolist(), at_b))]
        written, bounds = written.tolist(), group_at.tolist()
        self.text = [""] * len(self.good)
        for k, c in enumerate(chunk_of.tolist()):
            self.text[c] = ";".join(written[bounds[k] : bounds[k + 1]])

        chunk_bits = 2 * ID_BITS
        chunks = chunk_of[at]
        keys = [(chunks[exact] << chunk_bits) | (first << ID_BITS) | voc.ident[first]]
        weights = [np.ones(len(first), dtype=np.int64)]
        # All other groups: distinct ids of each side, with how often they stand, multiplied out.
        rest_a, rest_b = ~exact[group_a], ~exact[group_b]
        key_a, times_a = np.unique((group_a[rest_a] << ID_BITS) | a.ids[rest_a], return_counts=True)
        key_b, times_b = np.unique((group_b[rest_b] << ID_BITS) | b.ids[rest_b], return_counts=True)
        partners = np.bincount(key_b >> ID_BITS, minlength=len(cuts))
        start_b, reps = _ptr(partners)[key_a >> ID_BITS], partners[key_a >> ID_BITS]
        upto = np.cumsum(reps)
        at_once = 0
        while at_once < len(key_a):
            to = max(int(np.searchsorted(upto, (upto[at_once - 1] if at_once else 0) + PAIRS_AT_ONCE, side="right")), at_once + 1)
            part = slice(at_once, to)
            left, right = np.repeat(np.arange(at_once, to), reps[part]), _ragged(start_b[part], reps[part])
            pair = (chunks[key_a[left] >> ID_BITS] << chunk_bits) | ((key_a[left] & _ID) << ID_BITS) | (key_b[right] & _ID)
            k, w = _summed(pair, times_a[left] * times_b[right])
            keys.append(k)
            weights.append(w)
            at_once = to
        key, self.times = _summed(np.concatenate(keys), np.concatenate(weights))
        self.pairs = key & ((1 << chunk_bits) - 1)
        self.n_pairs = np.bincount(key >> chunk_bits, minlength=len(self.good))


class Aligner(dict):
    """Numbers of chunks, and what alignment says of each, kept between the blocks that a worker reads."""

    def __init__(self, voc: Vocabularies):
        super().__init__()
        self.voc = voc
        self.new: list[str] = []
        self.chars = 0
        none = np.zeros(0, np.int64)
        self.figures, self.good, self.texts = np.zeros((4, 0), np.int32), np.zeros(0, bool), []
        self.n_pairs, self.pairs, self.times, self.uses = none, none, none, none

    def __missing__(self, chunk: str) -> int:
        at = self[chunk] = len(self)
        self.new.append(chunk)
        self.chars += len(chunk)
        return at

    def _forget(self) -> None:
        """Keeps the chunks that were met more than once since the last time, half of the bound at most."""
        known = list(self)
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > CACHE_CHUNKS // 2:
            keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[: CACHE_CHUNKS // 2]])
        kept = [known[k] for k in keep.tolist()]
        if sum(map(len, kept)) > CACHE_CHARS // 2:
            keep, kept = keep[:0], []
        where = _ragged(_ptr(self.n_pairs)[keep], self.n_pairs[keep])
        self.pairs, self.times, self.n_pairs = self.pairs[where], self.times[where], self.n_pairs[keep]
        self.figures, self.good, self.texts = self.figures[:, keep], self.good[keep], [self.texts[k] for k in keep.tolist()]
        self.uses = np.zeros(len(keep), np.int64)
        self.clear()
        self.update(zip(kept, range(len(kept))))
        self.chars = sum(map(len, kept))

    def _learn(self) -> None:
        made = [Aligned(self.voc, self.new[k : k + CHUNKS_AT_ONCE]) for k in range(0, len(self.new), CHUNKS_AT_ONCE)]
        self.new = []
        together = lambda have, name: np.concatenate([have, *(getattr(m, name) for m in made)])
        self.figures = np.concatenate([self.figures, *(np.stack([m.n_a, m.n_b, m.n_groups, m.n_links]) for m in made)], axis=1)
        self.good, self.n_pairs, self.pairs, self.times = together(self.good, "good"), together(self.n_pairs, "n_pairs"), together(self.pairs, "pairs"), together(self.times, "times")
        self.texts += chain.from_iterable(m.text for m in made)
        self.uses = np.concatenate([self.uses, np.zeros(len(self) - len(self.uses), np.int64)])

    def chunks(self, texts: list[str | None]) -> list[np.ndarray]:
        """Numbers of each text's chunks, all of them aligned."""
        if len(self) > CACHE_CHUNKS or self.chars > CACHE_CHARS:
            self._forget()
        out = []
        for t in texts:
            found = _CHUNK.findall(" " + t) if t else []
            out.append(np.fromiter(map(self.__getitem__, found), np.int64, len(found)))
        if self.new:
            self._learn()
        return out


def packed(values: np.ndarray) -> bytes:
    """Whole numbers of no sign, compressed: the width in bytes, then the low bytes of all, the next bytes, and so on."""
    import zstandard

    most = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
    planes = np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(body: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[1:]), np.uint8).reshape(body[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{body[0]}").reshape(-1).astype(np.int64)


#: A row for each block: its documents (ids, sums, digests; chunks of each with how often they stand), its pairs with their
#: documents, and which pairs each chunk links how often. A row without a block: a task's vector of exact pairs.
_FIELDS = pa.schema(
    [("block", pa.int64()), ("keys", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64()))]
    + [(c, pa.binary()) for c in ("sums", "digests", "entries", "chunks", "times", "chunk_pairs", "pair", "links")]
)
_TABLE = "block long, keys array<long>, docs array<long>, ids array<long>, sums binary, digests binary, entries binary, chunks binary, times binary, chunk_pairs binary, pair binary, links binary"


def _row(**columns: object) -> pa.RecordBatch:
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) if isinstance(x, np.ndarray | pa.Array) else pa.array([x])
    return pa.RecordBatch.from_arrays([one(columns[f.name]).cast(f.type) if f.name in columns else pa.nulls(1, f.type) for f in _FIELDS], schema=_FIELDS)


def _read_block(aligner: Aligner, block: int, ids: pa.Array, texts: list[str | None], vector: np.ndarray) -> pa.RecordBatch:
    """The row of a block; adds its exact pairs to the vector."""
    n = len(texts)
    found = aligner.chunks(texts)
    lens = np.fromiter(map(len, found), np.int64, n)
    flat = np.concatenate(found)
    bad = _run_sums(~aligner.good[flat], _ptr(lens)) > 0
    flat, lens = flat[np.repeat(~bad, lens)], np.where(bad, 0, lens)
    ptr = _ptr(lens)
    sums = np.stack([_run_sums(row[flat], ptr) for row in aligner.figures])
    written = aligner.texts.__getitem__
    digests = [hashlib.sha256(";".join(map(written, flat[i:j].tolist())).encode()).digest() for i, j in zip(ptr[:-1].tolist(), ptr[1:].tolist())]
    stands = np.bincount(flat, minlength=len(aligner))
    aligner.uses += stands
    used = np.flatnonzero(stands)
    number = np.zeros(len(aligner), dtype=np.int64)
    number[used] = np.arange(len(used))
    # Distinct chunks of each document, with how often they stand.
    entry, first, times = _runs(np.sort((np.repeat(np.arange(n), lens) << 32) | number[flat]))
    doc, chunk = entry >> 32, entry & 0xFFFFFFFF
    # The pairs of the block's chunks, and in how many of its documents each is linked.
    size = aligner.n_pairs[used]
    where = _ragged(_ptr(aligner.n_pairs)[used], size)
    keys, pair = np.unique(aligner.pairs[where], return_inverse=True)
    pair_at = _ptr(size)
    in_doc, _, _ = _runs(np.sort((np.repeat(doc, size[chunk]) << 32) | pair[_ragged(pair_at[:-1][chunk], size[chunk])]))
    docs = np.bincount(in_doc & 0xFFFFFFFF, minlength=len(keys)).astype(np.int64)
    exact = aligner.voc.is_exact(keys)
    np.add.at(vector, keys[exact] >> ID_BITS, docs[exact])
    return _row(
        block=block, keys=keys, docs=docs, ids=ids, sums=packed(sums.reshape(-1)), digests=b"".join(digests), entries=packed(np.bincount(doc, minlength=n)), chunks=packed(chunk),
        times=packed(times), chunk_pairs=packed(size), pair=packed(pair), links=packed(aligner.times[where]),
    )


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, where each begins and how often it stands."""
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[first], first, np.diff(np.append(first, len(values)))


#: The aligner of this Python worker, kept for its later tasks.
_KEPT: dict[tuple[str, str], Aligner] = {}


def blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each block, and one for each task's vector of exact pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _KEPT.get((path_a, path_b)) or _KEPT.setdefault((path_a, path_b), Aligner(Vocabularies(path_a, path_b)))
        vector = np.zeros(len(aligner.voc.ident), dtype=np.int64)
        task, made, held = TaskContext.get().partitionId() << 32, 0, 0
        ids: list[pa.Array] = []
        texts: list[str | None] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = batch.slice(at, 200)
                more = rows.column(1).to_pylist()
                size = sum(len(t) for t in more if t)
                if texts and held + size > BLOCK_BYTES:
                    yield _read_block(aligner, task + made, pa.concat_arrays(ids), texts, vector)
                    ids, texts, held, made = [], [], 0, made + 1
                ids.append(rows.column(0))
                texts += more
                held += size
        if texts:
            yield _read_block(aligner, task + made, pa.concat_arrays(ids), texts, vector)
        seen = np.flatnonzero(vector)
        yield _row(keys=seen, docs=vector[seen])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _TABLE)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    spark = docs.sparkSession
    ident = Vocabularies(path_a, path_b).ident
    table = materialize(blocks(docs, path_a, path_b, id_col, text_col), "aligned")
    exact_sums = table.where("block IS NULL").select(F.explode(F.arrays_zip("keys", "docs")).alias("p")).groupBy("p.keys").agg(F.sum("p.docs").alias("n"))
    exact, best = np.zeros(len(ident), np.int64), np.zeros(len(ident), np.int64)
    rows = exact_sums.toPandas()  # at most A's vocabulary
    exact[rows["keys"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)

    pairs = table.where("block IS NOT NULL").select("block", F.explode(F.arrays_zip("keys", "docs")).alias("p")).select("block", F.col("p.keys").alias("pair"), F.col("p.docs").alias("n"))
    same = spark.createDataFrame([(int(a), int(b)) for a, b in enumerate(ident) if b >= 0], "a long, b long")
    same = same.select(((F.col("a") * (1 << ID_BITS)) + F.col("b")).alias("pair"))
    pairs = pairs.join(F.broadcast(same), "pair", "left_anti")  # at most A's vocabulary
    counts = materialize(pairs.groupBy("pair").agg(F.sum("n").alias("count"), F.count("*").alias("blocks")), "pair-counts")
    rows = counts.groupBy(F.shiftright("pair", ID_BITS).alias("a")).agg(F.max("count").alias("n")).toPandas()  # at most A's vocabulary
    best[rows["a"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    best = np.maximum(best, exact)
    sent = spark.sparkContext.broadcast((ident, exact, best))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ident, exact, best = sent.value
        block = {name: left[name][0].as_py() for name in left.column_names if pa.types.is_binary(left.schema.field(name).type)}
        keys, count, ids = (left[name].combine_chunks().flatten() for name in ("keys", "docs", "ids"))
        keys, count = keys.to_numpy(), count.to_numpy().copy()
        a = keys >> ID_BITS
        own = ident[a] == (keys & _ID)
        count[own] = exact[a[own]]
        count[np.searchsorted(keys, right["pair"].to_numpy())] = right["count"].to_numpy()
        pair, links, at = unpacked(block["pair"]), unpacked(block["links"]), _ptr(unpacked(block["chunk_pairs"]))
        chunk_sum, chunk_best = _run_sums(count[pair] * links, at), _run_sums((count == best[a])[pair] * links, at)
        chunks, times, ptr = unpacked(block["chunks"]), unpacked(block["times"]), _ptr(unpacked(block["entries"]))
        sums = unpacked(block["sums"]).reshape(4, len(ids))
        digests = [block["digests"][k : k + 32].hex() if n else "" for k, n in zip(range(0, 32 * len(ids), 32), sums[0].tolist())]
        columns = [ids, *map(pa.array, sums), pa.array(_run_sums(chunk_best[chunks] * times, ptr)), pa.array(_run_sums(chunk_sum[chunks] * times, ptr)), pa.array(digests)]
        return pa.table(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    shared = pairs.join(counts.where(F.col("blocks") > 1).drop("blocks"), "pair").select(F.col("block").alias("of_block"), "pair", "count")
    return table.where("block IS NOT NULL").groupBy("block").cogroup(shared.groupBy("of_block")).applyInArrow(run, SCHEMA)

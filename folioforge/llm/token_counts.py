"""Token counts of a piece vocabulary by rank-synchronous merging of arrays.

A text is escaped as the vocabulary wants it (each space becomes the mark U+2581, and one mark goes in front) and cut
into pre-tokens: a run of marks with what follows it, up to the next mark. No piece of the vocabulary has a mark after
another character and none has a line feed (checked when it is loaded), so no merge crosses a cut before either. The distinct pre-tokens of a slice of
documents are held as ragged arrays of symbols. In every round each sequence finds its lowest-rank adjacent pair, and
all occurrences of it, leftmost first and without overlap, are replaced at once; the round ends when no sequence has a
pair left. What survives is counted: one for each piece, and the UTF-8 length for each character without a piece.

A merged symbol can offer a pair of lower rank than the one just applied. Then occurrences further right must wait, so
such a sequence gets only its leftmost occurrence in that round, which is what one merge at a time would do.

Counts of pre-tokens are kept between slices in a dictionary of bounded size. Defined results: null and empty texts
have no tokens; an empty table gives no rows; of pairs of equal rank the leftmost is merged first; very long texts are
counted whole; repeated rows and rows of one id are counted each for itself; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
NO_RANK = np.int64(1) << 40
#: Entries of a task's dictionary of pre-tokens; when it is full it starts anew, which changes no count.
CACHE_ENTRIES = 400_000
#: Longer pre-tokens aren't kept in the dictionary.
CACHE_CHARS = 64


class PieceVocabulary:
    """Pieces with their ranks, and the pairs that merge into them as a sorted array of (left, right) keys."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, int] = {}
        self.rank: list[float] = []
        for i in range(model.get_piece_size()):
            if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            piece = model.id_to_piece(i)
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {piece!r} has a mark inside: pre-tokens can't be cut at marks")
            self.pieces[piece] = len(self.pieces)
            self.rank.append(-model.get_score(i))
        #: Equal scores get equal ranks.
        self.ranks = np.unique(np.array(self.rank), return_inverse=True)[1].astype(np.int64)
        pairs = [
            (self.pieces[p[:k]], self.pieces[p[k:]], n)
            for p, n in self.pieces.items()
            for k in range(1, len(p))
            if p[:k] in self.pieces and p[k:] in self.pieces
        ]
        base = len(self.pieces) + 1
        keys = np.array([a * base + b for a, b, _ in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.base, self.keys = base, np.append(keys[order], np.iinfo(np.int64).max)
        merged = np.array([n for _, _, n in pairs], dtype=np.int64)[order]
        self.merged = np.append(merged, 0)
        self.pair_rank = np.append(self.ranks[merged], NO_RANK)
        #: The symbol of each code point: its piece, or minus its UTF-8 length where it has none.
        self.of_char = -np.ones(0x110000, dtype=np.int64)
        for least, size in ((0x80, 2), (0x800, 3), (0x10000, 4)):
            self.of_char[least:] = -size
        for p, n in self.pieces.items():
            if len(p) == 1:
                self.of_char[ord(p)] = n
        if any("\n" in p for p in self.pieces):
            raise ValueError("a piece holds a line feed: pre-tokens can't be cut there")

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs (NO_RANK: none); negative symbols merge with nothing."""
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_rank[at], NO_RANK), self.merged[at]

    def count(self, pretokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token (none may be empty)."""
        points = np.frombuffer("".join(pretokens).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        symbols = self.of_char[points]
        lens = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        ids = np.arange(len(lens))
        done = np.zeros(len(lens), dtype=np.int64)
        rank = np.full(len(symbols), NO_RANK)
        into = np.zeros(len(symbols), dtype=np.int64)
        rank[:-1], into[:-1] = self.find(symbols[:-1], symbols[1:])
        rank[np.cumsum(lens) - 1] = NO_RANK  # the last symbol of a sequence starts no pair
        while len(lens):
            starts = np.cumsum(lens) - lens
            best = np.minimum.reduceat(rank, starts)
            over = best == NO_RANK
            if over.any():
                done[ids[over]] = np.add.reduceat(np.where(symbols < 0, -symbols, 1), starts)[over]
                stay = np.repeat(~over, lens)
                symbols, rank, into = symbols[stay], rank[stay], into[stay]
                ids, lens, best = ids[~over], lens[~over], best[~over]
                if not len(lens):
                    break
                starts = np.cumsum(lens) - lens
            low = self._apart(np.flatnonzero(rank == np.repeat(best, lens)))
            owner = np.searchsorted(starts, low, side="right") - 1
            if (owner[1:] == owner[:-1]).any():
                keep = self._in_turn(low, owner, symbols, into, best, starts, starts + lens)
                low, owner = low[keep], owner[keep]
            symbols[low] = into[low]
            stay = np.ones(len(symbols), dtype=bool)
            stay[low + 1] = False
            symbols, rank, into = symbols[stay], rank[stay], into[stay]
            lens = lens - np.bincount(owner, minlength=len(lens))
            last = np.cumsum(lens) - 1
            at = low - np.arange(len(low))
            at = np.concatenate([at, at - 1])
            at = at[at >= 0]
            at = at[at < len(symbols) - 1]
            rank[at], into[at] = self.find(symbols[at], symbols[at + 1])
            rank[last] = NO_RANK
        return done

    @staticmethod
    def _apart(low: np.ndarray) -> np.ndarray:
        """Of runs of neighbouring pairs every second, from the left: those that don't share a symbol."""
        if len(low) < 2:
            return low
        fresh = np.append(True, np.diff(low) > 1)
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(low)), 0))
        return low[(np.arange(len(low)) - run) % 2 == 0]

    def _in_turn(self, low: np.ndarray, owner: np.ndarray, symbols: np.ndarray, into: np.ndarray, best: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Marks what is merged now: only the leftmost occurrence in sequences where a merge offers a pair that goes before the rest."""
        again = np.append(False, owner[1:] == owner[:-1])
        new, n = into[low], len(symbols)
        urgent = np.zeros(len(low), dtype=bool)
        has_left, has_right = low > starts[owner], low + 2 < ends[owner]
        rank, _ = self.find(symbols[np.maximum(low - 1, 0)], new)
        urgent |= (rank <= best[owner]) & has_left
        rank, _ = self.find(new, symbols[np.minimum(low + 2, n - 1)])
        urgent |= (rank <= best[owner]) & has_right
        joined = np.flatnonzero(again[1:] & (np.diff(low) == 2))  # the neighbour is merged in this round too
        rank, _ = self.find(new[joined], new[joined + 1])
        urgent[joined] |= rank <= best[owner[joined]]
        slow = np.zeros(len(best), dtype=bool)
        slow[owner[urgent]] = True
        return ~(slow[owner] & again)


def pretokens(text: str) -> list[str]:
    """The pre-tokens of an escaped text: one for each run of marks with the characters after it."""
    parts = text.split(MARK)[1:]
    if "" not in parts:
        return parts
    out, marks = [], 0
    for i, p in enumerate(parts):
        if p or i == len(parts) - 1:
            out.append(MARK * marks + p)
            marks = 0
        else:
            marks += 1
    return out


class Counts(dict):
    """Token counts by pre-token (without its first mark)."""

    def __init__(self, vocabulary: PieceVocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    @staticmethod
    def escape(text: str) -> str:
        """With marks for spaces, one in front, and one more before each line feed, which only cuts (see sequence)."""
        return MARK + text.replace(" ", MARK).replace("\n", MARK + "\n")

    @staticmethod
    def sequence(pretoken: str) -> str:
        """What a pre-token (cut off behind a mark) stands for: the mark before a line feed is no part of it."""
        return pretoken if pretoken.lstrip(MARK)[:1] == "\n" else MARK + pretoken

    def of(self, texts: list[str | None]) -> list[int]:
        split = [pretokens(self.escape(t)) if t else [] for t in texts]
        wanted = set().union(*map(set, split)) if split else set()
        if len(self) > CACHE_ENTRIES:
            self.clear()
        new = [w for w in wanted if w not in self]
        long = [w for w in new if len(w) > CACHE_CHARS]
        if new:
            self.update(zip(new, self.vocabulary.count(list(map(self.sequence, new))).tolist()))
        out = [sum(map(self.__getitem__, s)) for s in split]
        for w in long:
            del self[w]
        return out


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(PieceVocabulary(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                texts = rows.column(1).to_pylist()
                n = counts.of(texts)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

"""Toxicity scores of deobfuscated texts.

The writer is a noisy channel: letters are replaced by look-alike digits and signs, repeated, or set apart by spaces and
marks. A token that shows such signs becomes a lattice of characters (each sign may be itself or a letter, a run may be
one or two letters, a mark between letters may be nothing), and the Viterbi path under a character trigram model is the
restored text, whatever the length of a token or a spaced run. The trigram counts are those of all documents, added up in Spark.

Restored words are looked up in a lexicon of words and word beginnings that labelled toxic documents have far more often
than clean ones, and a logistic model of how many of a text's words are listed, and how strongly, gives the score. Both are
fitted on a sample of at most ``max_labelled`` labelled rows (those with the least hashes of their ids); equal texts of the
sample count once. Nothing but the text enters a score.

Broadcast are the trigram table (64**3 values), the sample's ids (``max_labelled``), and the lexicon (entries
that ``LEAST_TEXTS`` toxic texts of the sample share): none grows with the documents. Defined results: null and empty texts score as a text without listed words; an empty
table gives no rows; without labelled rows of both classes all scores are the share of toxic ones (0 if there are none);
very long texts, tokens and spaced runs are read to their end, in time linear in their length; of equally likely
restorations the least text is taken; repeated rows and rows of one id are scored each for itself; a document with several labels counts as toxic
if one of them is 1; extra columns are ignored by ``scores`` and kept by ``drop_toxic``, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, materialize, string_views

MAX_LABELLED = 8192
THRESHOLD = 0.7
#: The least toxic texts of the sample and the least log-ratio of an entry of the lexicon.
LEAST_TEXTS, LEAST_RATIO = 4, math.log(6)
CACHE_ENTRIES, CACHE_CHARS = 300_000, 256

#: Letters that a sign may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c"}
SEPARATORS = ".-_*~ "
ACCENTED = "àáâäãåæçèéêëìíîïñòóôöõøœùúûüýÿß"
#: Costs (nats) of the channel: a look-alike, a run read as fewer letters, a dropped separator, a sign left as it is.
SWAP, SHRINK, DROP, KEEP = 0.7, 0.7, 0.3, 3.0

SYMBOLS = 64
_OTHER_LETTER, _SIGN = 62, 63


def _symbols() -> np.ndarray:
    """The symbol of each code point: 0 for what stands between words, letters, other letters, signs and digits."""
    out = np.full(0x110000, _OTHER_LETTER, dtype=np.uint8)
    for c in range(0x250):
        ch = chr(c)
        low = ch.lower()
        if len(low) == 1 and "a" <= low <= "z":
            out[c] = ord(low) - 96
        elif len(low) == 1 and low in ACCENTED:
            out[c] = 27 + ACCENTED.index(low)
        elif not ch.isalpha():
            out[c] = _SIGN if ch.isdigit() or ch in LOOKALIKES else 0
    return out


SYMBOL_OF = _symbols()


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of symbol trigrams over all texts (each text between two blanks): summed by task, then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            data, offsets = string_views(batch.column(0))
            at = 0
            while at < batch.num_rows:
                to = max(int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1, at + 1)
                to = min(to, batch.num_rows)
                texts = batch.column(0).slice(at, to - at).to_pylist()
                points = np.frombuffer("  ".join(["", *(t or "" for t in texts), ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
                s = SYMBOL_OF[points].astype(np.int32)
                total += np.bincount((s[:-2] << 12) | (s[1:-1] << 6) | s[2:], minlength=SYMBOLS**3)
                at = to
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["trigram", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "trigram long, n long")
    sums = rows.groupBy("trigram").agg(F.sum("n").alias("n")).toPandas()  # at most 64**3 rows
    out = np.zeros(SYMBOLS**3)
    out[sums["trigram"].to_numpy(dtype=np.int64)] = sums["n"].to_numpy(dtype=np.float64)
    return out


class CharacterModel:
    """Interpolated trigram log-probabilities, and the Viterbi decoding of character lattices under them."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
        p1 = (c1 + 1) / (c1.sum() + SYMBOLS)
        p2 = (c2 + 20 * p1[None, :]) / (c2.sum(axis=1, keepdims=True) + 20)
        p3 = (c3 + 20 * p2[None, :, :]) / (c3.sum(axis=2, keepdims=True) + 20)
        self.logp: list[float] = np.log(p3).reshape(-1).tolist()

    def restore(self, token: str) -> str:
        """The likeliest text behind a token of lower-case characters."""
        n = len(token)
        runs = [1] * n
        for i in range(n - 2, -1, -1):
            if token[i] == token[i + 1]:
                runs[i] = runs[i + 1] + 1
        # best[i]: for the last two symbols, the cost so far and the way there (what was written last, the way before it)
        best: list[dict[tuple[int, int], tuple[float, tuple | None]]] = [{} for _ in range(n + 1)]
        best[0][0, 0] = (0.0, None)
        for i in range(n):
            if not best[i]:
                continue
            edges = self._edges(token[i], runs[i])
            for (a, b), (cost, way) in best[i].items():
                for step, out, extra in edges:
                    x, y, total = a, b, cost + extra
                    for ch in out:
                        s = int(SYMBOL_OF[ord(ch)])
                        total -= self.logp[(x << 12) | (y << 6) | s]
                        x, y = y, s
                    have = best[i + step].get((x, y))
                    if have is None or total < have[0]:
                        best[i + step][x, y] = (total, (out, way))
            best[i] = {}
        ends = [(cost - self.logp[(a << 12) | (b << 6)], way) for (a, b), (cost, way) in best[n].items()]
        least = min((cost for cost, _ in ends), default=0.0)
        return min((self._written(way) for cost, way in ends if cost == least), default=token)

    @staticmethod
    def _written(way: tuple | None) -> str:
        out = []
        while way:
            out.append(way[0])
            way = way[1]
        return "".join(reversed(out))

    @staticmethod
    def _edges(c: str, run: int) -> list[tuple[int, str, float]]:
        """(characters read, text written, cost) of the ways on from a character that is repeated ``run`` times."""
        letters = [(x, SWAP) for x in LOOKALIKES.get(c, "")]
        if c.isalpha():
            letters.append((c, 0.0))
        out = []
        for x, cost in letters:
            out.append((1, x, cost))
            if run >= 2:
                out.append((run, x, cost + SHRINK))
            if run >= 3:
                out.append((run, x + x, cost + SHRINK))
        if c in SEPARATORS:
            out += [(run, "", DROP), (run, " ", 0.0)]
        elif not c.isalpha():
            out.append((run, c, KEEP))
            if c not in LOOKALIKES:
                out.append((run, " ", 0.0))
        return out


_WORDS = re.compile(r"[^\W\d_]+")
_SUSPECT = re.compile(r"[^\W\d_][0-9@$!|+€(*._~-]+[^\W\d_]|^[0-9@$!|+€(]+[^\W\d_]{2}|[^\W\d_]{2}[0-9]+$|([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<!\S)[^\W_](?:[ .*_~-]{1,3}[^\W_]){3,}(?!\S)")
_EDGES = "\"'“”«»,;:.?!#%&*~^=<>[]{}()/\\-_…|+"


def entries(word: str) -> list[str]:
    """A word, and its beginnings of three to seven letters (with an asterisk)."""
    return [word, *(word[:k] + "*" for k in range(3, min(8, len(word))))]


@dataclass
class Reader:
    """Turns texts into restored words, by a character model."""

    model: CharacterModel

    def words(self, token: str) -> list[str]:
        """Restored words of a white-space-separated token."""
        low = token.lower()
        if low.isalpha() and not _SUSPECT.search(low):
            return [low]
        low = low.strip(_EDGES).rstrip("$@")
        if _SUSPECT.search(low):
            # Words as they stand count beside the restored ones.
            return [*_WORDS.findall(low), *_WORDS.findall(self.model.restore(low))]
        return _WORDS.findall(low)

    def spaced(self, text: str, tokens: set[str]) -> list[str]:
        """Restored words of letters that stand apart."""
        if sum(len(t) == 1 for t in tokens) < 3 and not any(1 < len(t) < 4 and not t.isalnum() for t in tokens):
            return []
        out: list[str] = []
        for m in _SPACED.finditer(text):
            out += _WORDS.findall(self.model.restore(m[0].lower()))
        return [w for w in out if len(w) > 2]


@dataclass
class Scorer:
    """The fitted model: lexicon weights by entry, and the logistic model over a text's summary."""

    reader: Reader
    lexicon: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    base: float

    def __post_init__(self) -> None:
        self.seen: dict[str, float] = {}

    def weight(self, token: str) -> float:
        """The largest lexicon weight of a token's restored words (0: none is listed)."""
        return max((self.lexicon.get(b, 0.0) for w in self.reader.words(token) for b in entries(w)), default=0.0)

    def summary(self, text: str) -> list[float]:
        tokens = set(text.split())
        if len(self.seen) > CACHE_ENTRIES:
            self.seen.clear()
        seen, hits = self.seen, []
        for t in tokens:
            w = seen.get(t)
            if w is None:
                w = self.weight(t)
                if len(t) <= CACHE_CHARS:
                    seen[t] = w
            if w:
                hits.append(w)
        hits += [w for w in (max((self.lexicon.get(b, 0.0) for b in entries(x)), default=0.0) for x in self.reader.spaced(text, tokens)) if w]
        n, h = max(len(tokens), 1), len(hits)
        return [1.0, math.log1p(h), h / n, sum(hits) / n, math.log(n), max(hits, default=0.0), h / math.sqrt(n)]

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.beta):
            return np.full(len(texts), self.base)
        x = np.array([self.summary(t or "") for t in texts]).reshape(len(texts), -1)
        return 1 / (1 + np.exp(-np.clip(((x - self.mean) / self.scale) @ self.beta, -30, 30)))


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that no label may be learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _listed(sample: DataFrame, reader: Reader) -> dict[str, float]:
    """The lexicon: log-ratios of the shares of toxic and of clean texts that have a word or beginning."""
    classes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The sample has ``max_labelled`` texts at most; a text's entries are handed on before the next slice is read.
        known: dict[str, list[str]] = {}
        counts: dict[str, list[int]] = {}

        def handed() -> pa.RecordBatch:
            clean, toxic = zip(*counts.values()) if counts else ((), ())
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())], ["entry", "toxic", "clean"])
            counts.clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens, found = set((text or "").split()), set()
                for t in tokens:
                    e = known.get(t)
                    if e is None:
                        e = [b for w in reader.words(t) for b in entries(w)]
                        if len(known) < CACHE_ENTRIES // 3 and len(t) <= CACHE_CHARS:
                            known[t] = e
                    found.update(e)
                for w in reader.spaced(text or "", tokens):
                    found.update(entries(w))
                for e in found:
                    counts.setdefault(e, [0, 0])[int(toxic)] += 1
                if len(counts) > CACHE_ENTRIES // 3:
                    yield handed()
        yield handed()

    sums = sample.select("text", "toxic").mapInArrow(run, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    half = 0.5
    ratio = F.log((F.col("t") + half) / (classes.get(1, 0) + 2 * half)) - F.log((F.col("c") + half) / (classes.get(0, 0) + 2 * half))
    top = sums.where(F.col("t") >= LEAST_TEXTS).select("entry", ratio.alias("w"), "t").where(F.col("w") > LEAST_RATIO)
    return {r["entry"]: r["w"] for r in top.collect()}


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Scorer:
    """The scorer learnt from the labelled rows that aren't held out and from the characters of all documents."""
    spark = docs.sparkSession
    reader = Reader(CharacterModel(trigram_counts(docs)))
    known = labels.where(~held_out()).where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select(F.col("doc_id").alias("_id"), F.least(F.greatest("toxic", F.lit(0)), F.lit(1)).alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(known), "_id").select("text", "toxic", F.xxhash64("text").alias("h")).dropDuplicates(["h", "toxic"])  # at most max_labelled ids
    sample = materialize(sample, "labelled")
    lexicon = _listed(sample, reader)
    scorer = Scorer(reader, lexicon, np.zeros(0), np.ones(0), np.zeros(0), 0.0)
    sent = spark.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([pa.array([sent.value.summary(t or "") for t in part.column(0).to_pylist()], pa.list_(pa.float64())), part.column(1)], ["x", "y"])

    rows = sample.select("text", F.col("toxic").cast("double").alias("toxic")).mapInArrow(run, "x array<double>, y double").toPandas()  # at most max_labelled rows
    y = rows["y"].to_numpy(dtype=float)
    base = float(y.mean()) if len(y) else 0.0
    if not 0 < base < 1:
        return Scorer(reader, {}, np.zeros(0), np.ones(0), np.zeros(0), base)
    x = np.array(rows["x"].tolist())
    order = np.lexsort(np.column_stack([x, y]).T)  # one order, whatever the tasks' order was
    x, y = x[order], y[order]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    mean[0], scale[0] = 0, 1
    z, beta = (x - mean) / scale, np.zeros(x.shape[1])
    for _ in range(40):  # Newton steps of ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(len(beta)), z.T @ (y - p) - beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return Scorer(reader, lexicon, mean, scale, beta, base)


def scores(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sent.value.score(part.column(2).to_pylist()))], ["doc_id", "held_out", "score"])
        sent.value.seen.clear()  # the worker keeps the model for later tasks

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """The rows and columns of docs whose score stays below the threshold."""
    sent, schema = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_labelled)), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                yield part.filter(pa.array(sent.value.score(texts) < threshold))
        sent.value.seen.clear()

    return docs.mapInArrow(run, schema)

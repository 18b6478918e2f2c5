"""Quality scores: a Gaussian kernel over statistics of a text, by random Fourier features, ridge regression and isotonic calibration.

Each whole text becomes ``STATISTICS`` (how its bytes, words and lines are made and how much of them repeats), kept as whole
multiples of ``1 / UNIT``. Cosines of random projections of the standardised statistics stand for a Gaussian kernel. Their
products are summed by partition into normal equations, for each of ``FOLDS`` folds of the labelled rows. The ridge weight
is the one of ``RIDGES`` with the least squared error on rows of other folds, a figure that the normal equations hold
already. The calibration is the isotonic regression of labels on out-of-fold values, from counts in ``BINS`` bins; between
the middles of its steps scores run straight, and a hundredth of a score is the value itself, so that ties of a step keep
their order. All labelled rows outside the held-out quarter are used; nothing but the text enters a score.

Statistics and features are whole numbers, so sums are exact (up to 10**9 labelled rows) and don't depend on how tasks
were cut or repeated. Collected and broadcast are the sums of the statistics, normal equations of ``FEATURES`` squared and
the counts of bins: none grows with the documents. Defined results: null and empty texts have statistics of zero and a
score like any other; an empty table gives no rows; without labelled rows of both classes all scores are the share of good
ones (0 if there are none); very long texts are read whole; a document with several labels is good if one of them is 1;
labels other than 0 and 1 don't count; rows of one id are scored each for itself; rows with a null id are scored and never
learnt from; extra columns are ignored by ``scores`` and kept by ``keep_good``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, gram_hashes, materialize, mix, slices, span_hashes

THRESHOLD = 0.7
FEATURES, FOLDS, BINS, SEED = 256, 4, 4096, 11
RIDGES = (1e-4, 1e-3, 1e-2, 1e-1)
#: Statistics are whole multiples of 1 / UNIT, features of 1 / STEP.
UNIT, STEP = 1024, 2048
#: Standardised statistics end here, so that one outlier doesn't leave the kernel's reach.
REACH = 4.0

#: Classes of bytes whose shares count.
_CLASSES = {"upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A), "blank": [0x20], "space": [9, 11, 12, 13], "line": [10], "stop": b".,;:", "loud": b"!?", "bar": b"|", "sign": b"#$%&*", "quote": b"\"'()-", "other": b"+/<=>@[\\]^_`{}~", "high": range(0x80, 0x100)}
STATISTICS = [
    "log_bytes", "log_words", *_CLASSES, "entropy", "word_length", "word_spread", "long_words", "capitalised", "no_letters", "distinct_words", "top_word", "same_again", "distinct_pairs",
    "distinct_triples", "distinct_lines", "line_length", "stopped_lines",
]
_TABLE = np.zeros(256, dtype=np.int64)
for _k, _bytes in enumerate(_CLASSES.values()):
    _TABLE[list(_bytes)] = _k + 1
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*_CLASSES["upper"], *_CLASSES["lower"], *_CLASSES["high"]]] = True


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each owner, how many distinct hashes it has and how often the commonest stands."""
    keys, first, times = np.unique(mix(hashes + mix(owner.astype(np.uint64))), return_index=True, return_counts=True)
    whose = owner[first]
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, whose, times)
    return np.bincount(whose, minlength=n), most


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (total[at[1:]] - total[at[:-1]]).astype(float)


def statistics(texts: Texts) -> np.ndarray:
    """STATISTICS of each text of a slice, as whole multiples of 1 / UNIT."""
    n, at = texts.n, texts.offsets
    size = np.diff(at).astype(float)
    owner = np.repeat(np.arange(n), np.diff(at))
    with np.errstate(divide="ignore", invalid="ignore"):
        share = lambda x, of: np.nan_to_num(x / of, nan=0.0, posinf=0.0)
        histogram = np.zeros((n, 256))
        for i in range(0, n, 512):  # a bounded part of the byte histogram at a time
            j = min(i + 512, n)
            part = slice(int(at[i]), int(at[j]))
            histogram[i:j] = np.bincount((owner[part] - i) * 256 + texts.data[part], minlength=(j - i) * 256).reshape(j - i, 256)
        p = share(histogram, size[:, None])
        entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
        classes = np.stack([p[:, _TABLE == k + 1].sum(axis=1) for k in range(len(_CLASSES))], axis=1)

        starts, ends, first = texts.words()
        words, of_word = np.diff(first).astype(float), np.repeat(np.arange(n), np.diff(first))
        hashes, length = texts.word_hashes(starts, ends), ends - starts
        letters = np.concatenate([[0], np.cumsum(_LETTER[texts.data])])
        distinct, most = _distinct(of_word, hashes, n)
        same = np.zeros(len(hashes), dtype=bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
        grams = []
        for k in (2, 3):
            inside = of_word[: max(len(of_word) - k + 1, 0)] == of_word[k - 1 :]
            grams.append(share(_distinct(of_word[: len(inside)][inside], gram_hashes(hashes, k)[inside], n)[0], np.maximum(words - k + 1, 0)))
        upper = (texts.data[starts] >= 0x41) & (texts.data[starts] < 0x5B) if len(starts) else np.zeros(0, bool)
        mean = share(_sums(length, first), words)
        spread = np.sqrt(np.maximum(share(_sums(length * length, first), words) - mean**2, 0))

        # A line ends before each line feed and at the text's end; empty ones don't count.
        edge = np.unique(np.concatenate([np.flatnonzero(texts.data == 10), at[:-1] - 1, at[1:] - 1]))
        low, high = edge[:-1] + 1, edge[1:] + 1
        high = np.where((texts.data[high - 1] == 10) if len(high) else np.zeros(0, bool), high - 1, high)
        low, high = low[high > low], high[high > low]
        of_line = owner[low] if len(low) else np.zeros(0, np.int64)
        lines = np.bincount(of_line, minlength=n).astype(float)
        stopped = np.isin(texts.data[high - 1], np.frombuffer(b".!?:;\"'|", np.uint8)) if len(high) else np.zeros(0, bool)
        different, _ = _distinct(of_line, span_hashes(texts.data, low, high), n)

        rows = [np.log1p(size), np.log1p(words), *classes.T, entropy, mean, spread, share(_sums(length > 15, first), words), share(_sums(upper, first), words)]
        rows += [share(_sums(letters[ends] == letters[starts], first), words), share(distinct, words), share(most, words), share(_sums(same, first), words), *grams]
        rows += [share(different, lines), np.log1p(share(size, lines)), share(np.bincount(of_line, weights=stopped, minlength=n), lines)]
    return np.rint(np.stack(rows, axis=1) * UNIT).astype(np.int32)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that no label may be learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def with_statistics(rows: DataFrame) -> DataFrame:
    """(doc_id, held_out, x) of rows of (doc_id, held_out, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                x = statistics(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["doc_id", "held_out", "x"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, x array<int>")


@dataclass
class Kernel:
    """Random Fourier features of standardised statistics."""

    mean: np.ndarray
    scale: np.ndarray

    def __post_init__(self) -> None:
        rng = np.random.default_rng(SEED)
        d = len(self.mean)
        self.directions = rng.standard_normal((d, FEATURES)) / np.sqrt(d)
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)

    def features(self, x: np.ndarray) -> np.ndarray:
        """Cosines as whole multiples of 1 / STEP, and a last constant feature."""
        z = np.clip((x - self.mean) / self.scale, -REACH, REACH)
        out = np.full((len(x), FEATURES + 1), float(STEP))
        out[:, :-1] = np.rint(np.sqrt(2) * np.cos(z @ self.directions + self.phases) * STEP)
        return out


@dataclass
class Scorer:
    """The fitted model: kernel, one set of ridge weights for all and one for each fold, and the calibration's knots."""

    kernel: Kernel
    betas: np.ndarray
    knots: np.ndarray
    heights: np.ndarray
    base: float

    def values(self, x: np.ndarray) -> np.ndarray:
        """Ridge values by all weights: a column for the whole, one for each fold."""
        return self.kernel.features(x) / STEP @ self.betas

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), self.base)
        value = self.values(x)[:, 0]
        return 0.99 * np.interp(value, self.knots, self.heights) + 0.01 * np.clip(value, 0, 1)


def _arrays(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)


def _normal_equations(rows: DataFrame, kernel: Kernel) -> np.ndarray:
    """Products of features and labels (last row and column), summed by fold: exact whole numbers."""
    size = FEATURES + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FOLDS, size, size))
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                z = np.column_stack([kernel.features(_arrays(part, 0)), part.column(1).to_numpy().astype(float) * STEP])
                fold = part.column(2).to_numpy()
                for k in range(FOLDS):
                    own = z[fold == k]
                    sums[k] += own.T @ own
        flat = sums.reshape(-1).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, size), pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FOLDS * size)), lists], ["row", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = table["sums"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(axis=0)
        return pa.table({"row": table["row"].slice(0, 1), "sums": pa.array([total], pa.list_(pa.int64()))})

    found = rows.select("x", "y", "fold").mapInArrow(run, "row long, sums array<long>").groupBy("row").applyInArrow(add, "row long, sums array<long>").toPandas()
    out = np.zeros((FOLDS * size, size))
    for row, sums in zip(found["row"], found["sums"]):
        out[row] = sums
    return out.reshape(FOLDS, size, size) / STEP**2


def _ridge(equations: np.ndarray, weight: float) -> np.ndarray:
    """Weights of the last column by all others; the constant isn't held down."""
    z, n = equations[:-1, :-1], max(equations[-2, -2], 1.0)
    hold = np.full(len(z), weight * n)
    hold[-1] = 1e-9 * n
    return np.linalg.solve(z + np.diag(hold), equations[:-1, -1])


def _squared_error(equations: np.ndarray, beta: np.ndarray) -> float:
    w = np.append(beta, -1.0)
    return float(w @ equations @ w)


def isotonic(values: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middles and heights of the steps of the rising function nearest to the shares good / n, values in order."""
    steps: list[list[float]] = []
    for v, g, w in zip(values, good, n):
        steps.append([v * w, g, w])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            last = steps.pop()
            steps[-1] = [a + b for a, b in zip(steps[-1], last)]
    return np.array([v / w for v, _, w in steps]), np.array([g / w for _, g, w in steps])


def fit(rows: DataFrame, labels: DataFrame) -> Scorer:
    """The scorer learnt from rows of (doc_id, held_out, x) and labels."""
    spark = rows.sparkSession
    d = len(STATISTICS)
    x = [F.col("x")[k].cast("long") for k in range(d)]
    sums = rows.agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{k}") for k, c in enumerate(x)), *(F.sum(c * c).alias(f"q{k}") for k, c in enumerate(x))).first()
    n = max(sums["n"], 1)
    mean, square = (np.array([float(sums[f"{c}{k}"] or 0) for k in range(d)]) / n for c in "sq")
    kernel = Kernel(mean, np.sqrt(np.maximum(square - mean**2, 0)) + 1)

    known = labels.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("q")).where("q IN (0, 1)").groupBy("_id").agg(F.max("q").alias("y"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    learnt = materialize(rows.where(~F.col("held_out")).join(known, F.col("doc_id") == F.col("_id")).select("x", F.col("y").cast("int").alias("y"), fold), "quality-labelled")
    equations = _normal_equations(learnt, kernel)
    total = equations.sum(axis=0)
    count, good = total[-2, -2], total[-2, -1]
    none = np.zeros(0)
    if not 0 < good < count:
        return Scorer(kernel, none, none, none, float(good / count) if count else 0.0)
    error = {r: sum(_squared_error(e, _ridge(total - e, r)) for e in equations) for r in RIDGES}
    ridge = min(RIDGES, key=lambda r: (error[r], -r))
    betas = np.stack([_ridge(total, ridge), *(_ridge(total - e, ridge) for e in equations)], axis=1)
    scorer = Scorer(kernel, betas, none, none, float(good / count))
    sent = spark.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BINS), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                value = sent.value.values(_arrays(part, 0))[np.arange(part.num_rows), 1 + part.column(2).to_numpy()]
                where = np.clip(np.floor((value + 0.5) * (BINS / 2)), 0, BINS - 1).astype(np.int64)  # values from -0.5 to 1.5
                np.add.at(counts, (part.column(1).to_numpy(), where), 1)
        seen = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[1, seen]), pa.array(counts[:, seen].sum(axis=0))], ["bin", "good", "n"])

    bins = learnt.select("x", "y", "fold").mapInArrow(run, "bin long, good long, n long").groupBy("bin").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).toPandas().sort_values("bin")  # at most BINS rows
    scorer.knots, scorer.heights = isotonic((bins["bin"].to_numpy() + 0.5) * (2 / BINS) - 0.5, bins["good"].to_numpy(float), bins["n"].to_numpy(float))
    return scorer


def scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(with_statistics(texts), "statistics")
    sent = docs.sparkSession.sparkContext.broadcast(fit(rows, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sent.value.score(_arrays(part, 2)))], ["doc_id", "held_out", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows and columns of docs whose score reaches the threshold."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    sent, schema = docs.sparkSession.sparkContext.broadcast(fit(materialize(with_statistics(texts), "statistics"), labels)), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                yield part.filter(pa.array(sent.value.score(statistics(texts).astype(float)) >= threshold))

    return docs.mapInArrow(run, schema)

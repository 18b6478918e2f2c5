"""Quality scores: statistics, exact sums, calibration, and labels that were held out."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import quality
from folioforge.llm.common import Texts

from .fixtures import SCHEMA, make, texts, words

LABELS = "doc_id long, quality int, toxic int"


def _statistics(rows):
    parts = [(t or "").encode() for t in rows]
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return quality.statistics(Texts(np.frombuffer(b"".join(parts), np.uint8), at))


def _corpus(seed=2, n=700):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["ka", "lo", "mi", "ten", "ur"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows, labels = [], []
    for k in range(n):
        picked = [rng.choice(vocabulary) for _ in range(rng.randint(20, 150))]
        kind = k % 8
        text = " ".join(w.capitalize() + "." if i % 9 == 8 else w for i, w in enumerate(picked))
        if kind == 0:
            text = " ".join(picked[:3] * 30)
        elif kind == 1:
            text = " | ".join(picked)
        elif kind == 2:
            text = text.upper().replace(" ", "!! ")
        rows.append((k, text))
        labels.append((k, int(kind > 2), 0))
    return rows, labels


def test_statistics_count_what_they_say():
    rows = texts() + ["one\ntwo\n\none\n", "\n\n", "a b a b a b", "ABC | abc!", "é" * 10, None, "x" * 3000 + " y", "7 8 9"]
    out = _statistics(rows) / quality.UNIT
    col = {s: out[:, k] for k, s in enumerate(quality.STATISTICS)}
    near = lambda name, value: np.testing.assert_allclose(col[name], value, atol=1e-3)
    size = lambda t: len((t or "").encode())
    near("log_bytes", [np.log1p(size(t)) for t in rows])
    near("log_words", [np.log1p(len(words(t))) for t in rows])
    share = lambda x, n: x / n if n else 0
    near("distinct_words", [share(len(set(words(t))), len(words(t))) for t in rows])
    near("top_word", [share(max(Counter(words(t)).values(), default=0), len(words(t))) for t in rows])
    near("same_again", [share(sum(a == b for a, b in zip(words(t), words(t)[1:])), len(words(t))) for t in rows])
    near("distinct_pairs", [share(len(set(zip(words(t), words(t)[1:]))), max(len(words(t)) - 1, 0)) for t in rows])
    near("word_length", [np.mean([size(w) for w in words(t)] or [0]) for t in rows])
    near("upper", [share(sum("A" <= c <= "Z" for c in t or ""), size(t)) for t in rows])
    lines = [[x for x in (t or "").split("\n") if x] for t in rows]
    near("distinct_lines", [share(len(set(x)), len(x)) for x in lines])
    near("stopped_lines", [share(sum(x[-1] in ".!?:;\"'|" for x in y), len(y)) for y in lines])


def test_statistics_do_not_depend_on_neighbours():
    rows = texts() + ["", None, "one\ntwo", "\nx\n"]
    alone = np.concatenate([_statistics([t]) for t in rows])
    np.testing.assert_array_equal(_statistics(rows), alone)


def test_isotonic_steps_equal_the_definition():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = rng.integers(1, 5, 12).astype(float)
        good = np.floor(rng.random(12) * (n + 1))
        at, height = quality.isotonic(np.arange(12.0), good, n)
        share = good / n
        # Minimax: the greatest, over all starts, of the least mean up to some end.
        want = [max(min((share[i : j + 1] * n[i : j + 1]).sum() / n[i : j + 1].sum() for j in range(k, 12)) for i in range(k + 1)) for k in range(12)]
        steps = np.unique(np.round(want, 9))
        np.testing.assert_allclose(np.round(height, 9), steps)
        assert (np.diff(at) > 0).all()


def test_sums_equal_one_matrix_product(spark):
    rows, labels = _corpus(n=120)
    x = _statistics([t for _, t in rows])
    kernel = quality.Kernel(x.mean(axis=0), x.std(axis=0) + 1)
    data = [(v.tolist(), y, k % quality.FOLDS) for k, (v, (_, y, _)) in enumerate(zip(x, labels))]
    table = spark.createDataFrame(data, "x array<int>, y int, fold int")
    first, again = (quality._normal_equations(table.repartition(n), kernel) for n in (1, 7))
    np.testing.assert_array_equal(first, again)
    z = np.column_stack([kernel.features(x.astype(float)) / quality.STEP, [y for _, y, _ in labels]])
    for k in range(quality.FOLDS):
        own = z[np.arange(len(z)) % quality.FOLDS == k]
        np.testing.assert_allclose(first[k], own.T @ own, atol=1e-9)
    beta = quality._ridge(first.sum(axis=0), 1e-2)
    design, hold = z[:, :-1], np.full(z.shape[1] - 1, 1e-2 * len(z))
    hold[-1] = 1e-9 * len(z)
    np.testing.assert_allclose(beta, np.linalg.solve(design.T @ design + np.diag(hold), design.T @ z[:, -1]), atol=1e-8)
    assert quality._squared_error(first.sum(axis=0), beta) == pytest.approx(((design @ beta - z[:, -1]) ** 2).sum())


def test_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((40, len(quality.STATISTICS))) * quality.UNIT
    kernel = quality.Kernel(np.zeros(x.shape[1]), np.full(x.shape[1], quality.UNIT))
    z = kernel.features(x)[:, :-1] / quality.STEP
    u = np.clip(x / quality.UNIT, -quality.REACH, quality.REACH)
    exact = np.exp(-((u[:, None] - u[None]) ** 2).sum(axis=2) / (2 * x.shape[1]))
    assert np.abs(z @ z.T / quality.FEATURES - exact).mean() < 0.06


def test_held_out_labels_are_met(spark):
    rows, labels = _corpus()
    odd = [(9001, None), (9002, ""), (None, rows[5][1]), (5, rows[6][1]), (9003, "word " * 20_000), (9004, "é\x00퟿")]
    more = [(None, 1, 0), (7, None, 0), (11, 7, 0), (labels[3][0], labels[3][1], 0)]
    docs, table = make(spark, rows + odd).repartition(5), spark.createDataFrame(labels + more, LABELS)
    out = quality.scores(docs, table).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in out)
    known = {d: q for d, q, _ in labels}
    held = [(r["predicted"], known[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in known]
    assert len(held) > 120 and np.mean([p == q for p, q in held]) >= 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out if r["doc_id"] is not None)
    assert {r["held_out"] for r in out if r["doc_id"] is None} == {False}
    # What was held out is never learnt from, and how rows are dealt changes nothing.
    turned = spark.createDataFrame([(d, 1 - q if zlib.crc32(str(d).encode()) % 4 == 2 else q, 0) for d, q, _ in labels], LABELS)
    key = lambda rows: sorted((r["doc_id"] or -1, r["score"]) for r in rows)
    assert key(quality.scores(docs.repartition(3), turned).collect()) == key(out)
    kept = quality.keep_good(docs, table)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(r["doc_id"] or -1 for r in out if r["predicted"])


def test_no_rows_and_one_class(spark):
    none, labels = make(spark, []), spark.createDataFrame([], LABELS)
    assert quality.scores(none, labels).count() == 0
    docs = make(spark, [(1, "a"), (3, "b"), (4, None)])
    assert {r["score"] for r in quality.scores(docs, labels).collect()} == {0.0}
    ones = spark.createDataFrame([(k, 1, 0) for k in range(10)], LABELS)
    assert quality.scores(docs, ones).where(F.col("score") != 1.0).count() == 0
    assert SCHEMA.startswith("doc_id")

"""Filters in every order, against documents removed one by one."""

from collections import Counter
from itertools import permutations

import duckdb
import numpy as np

from folioforge.llm import audit

from .fixtures import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, cell int, n long, bits string, digest string, words string"
LABELS = "doc_id long, quality int, toxic int"


def _rows():
    plain = " ".join(f"w{k}" for k in range(60))
    texts = [
        plain, "few words", plain + " $", "SHOUT " * 60, " ".join(["same"] * 80), plain.upper(), "", None, "a|b", plain + " " + plain + " " + plain,
        " \t\x0b" + plain.replace(" ", "\r\n") + "\x0c", "É" * 19 + "A", "É" * 18 + "AA", " ".join(f"v{k}" for k in range(49)), " ".join(f"v{k}" for k in range(50)),
        "x " * 40_000 + "end",
    ]
    rows = [(k, t, f"src{k % 3}") for k, t in enumerate(texts)]
    rows += [(100 + k, plain, "hot") for k in range(40)] + [(200, plain, None), (201, "", ""), (202, plain + " %", None)]
    rows += [(3, texts[3], "src0"), (3, texts[4], "src1"), (0, plain, "src0"), (None, plain, "src1"), (None, "lonely", "src1"), (None, "lonely", "src2"), (-5, plain + " &", "src1"), (300, plain + " &", "src1")]
    labels = [(0, 1, 0), (1, 0, 1), (2, 1, 1), (3, 1, 0), (3, 0, 1), (4, None, 1), (100, 1, 0), (101, 1, 1), (None, 1, 1), (202, 1, None), (999, 1, 1), (300, 1, 0)]
    return rows, labels


def _expected(rows, labels):
    good, toxic = ({d for d, *x in labels if d is not None and x[at] == 1} for at in (0, 1))
    first = {}
    for d, t, _ in rows:
        t = t or ""
        first[t] = min(first.get(t, float("inf")), float("inf") if d is None else d)
    docs = []
    for d, t, source in rows:
        t = t or ""
        w = words(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t)}
        fails["E"] = first[t] < (float("inf") if d is None else d)
        docs.append((source or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            kept = [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [d for d in kept if f in d[1]]
                kept = [d for d in kept if f not in d[1]]
                everyone = [d for d in docs if d[0] == part and f in d[1]]
                out[part, "".join(order), step] = [
                    len(kept), len(removed), sum(f in d[1] for d in gone), sum(d[1] == {f} for d in everyone), sum(d[2] for d in removed), sum(d[3] for d in removed)
                ]
                gone += removed
                shapley[f] += len(removed)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return out


def _got(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[f] for f in audit.FIGURES] for r in df.collect()}


def test_every_order_equals_removal_one_by_one(spark):
    rows, labels = _rows()
    docs = spark.createDataFrame([(d, t, None, s, *[None] * 7) for d, t, s in rows], SCHEMA)
    out = _got(audit.filter_audit(docs.repartition(5), spark.createDataFrame(labels, LABELS)))
    expected = _expected(rows, labels)
    assert out == expected
    assert len(out) == 600 * 5


def test_sql_agrees_on_nulls_and_copies(spark):
    rows, labels = _rows()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.execute("CREATE TABLE labels(doc_id BIGINT, quality INTEGER, toxic INTEGER)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    found = con.execute(f"SELECT part, filter_order, step, {', '.join(audit.FIGURES)} FROM ({audit.ORACLE_SQL})").fetchall()
    assert {r[:3]: list(r[3:]) for r in found} == _expected(rows, labels)


def test_contractions_equal_sums_over_cells():
    rng = np.random.default_rng(3)
    tensor = rng.integers(0, 9, (2, 3, 2, 2, 2, 2, 2))
    out = audit.contract(tensor)
    for s in range(0, 600, 7):
        order, step = audit.ORDERS[s // 5], s % 5
        own, before = "ABCDE".index(order[step]), ["ABCDE".index(f) for f in order[:step]]
        cells = [c for c in np.ndindex(2, 2, 2, 2, 2) if c[own] == 1 and not any(c[b] for b in before)]
        assert out["removed"][1, s] == sum(tensor[1, 0][c] for c in cells) and out["good_lost"][0, s] == sum(tensor[0, 1][c] for c in cells)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert audit.filter_audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a", None, "s", *[None] * 7)], SCHEMA)
    out = _got(audit.filter_audit(one, labels))
    assert out["s", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]

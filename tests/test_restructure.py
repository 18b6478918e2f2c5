"""Changes to verses against a fold that makes them one at a time, from the end of each division."""

import random

import pytest

from folioforge.operators import restructure as rs

SCHEMA = (
    "book_id int, division_id string, id string, ordinal long, number string, form string, text string, ocr_text string, status string, origin string, lineage array<string>, "
    "confidence double, flags array<string>, pages array<int>, blocks array<string>, repairs array<string>, printed_pages array<int>, footnote_markers array<int>, orthography string, orphaned boolean"
)
NAMES = [c.split(" ")[0] for c in SCHEMA.split(", ")]


def book(seed):
    rng, out = random.Random(seed), []
    for d in range(6):
        for k in range(rng.randint(1, 7)):
            page = rng.randint(1, 3)
            number = rng.choice([None, str(k), "૧૨", "x"])
            text = rng.choice(["  ", ""]) + " ".join(rng.choice(["ab", "cd", "é𝒳"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", " \n"])
            flags = sorted(rng.sample(["no-number", "very-short", "orthography"], rng.randint(0, 2)))
            ids = f"p{page}-{k + 1}" if rng.random() < 0.7 else f"v{k}"
            out.append(
                dict(book_id=1, division_id=f"d{d}", id=ids, ordinal=k, number=number, form="verse", text=text, ocr_text=text + "?", status=rng.choice(["raw", "proofed", "approved"]), origin="imported", lineage=[f"o#{k}"], confidence=0.5, flags=flags,
                     pages=[page, page + 1], blocks=[f"b{k}"], repairs=[f"r{k}"], printed_pages=[k, 5], footnote_markers=[k % 2], orthography="ok", orphaned=False)
            )
    return out


def free(rows, division, wanted, own=None):
    taken = {r["id"] for r in rows if r["division_id"] == division} - {own}
    return next(x for x in [wanted, *(f"{wanted}-{n}" for n in range(2, 100))] if x not in taken)


def value(number):
    digits = {c: str(k) for k, c in enumerate("૦૧૨૩૪૫૬૭૮૯")}
    plain = "".join(digits.get(c, c) for c in number or "")
    return f"v{int(plain)}" if plain.isascii() and plain.isdigit() else None


def ordered(rows):
    return sorted(rows, key=lambda r: (r["division_id"], r["ordinal"]))


def run(spark, rows, f, changes, schema):
    out = f(spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], SCHEMA), spark.createDataFrame(changes, schema))
    return sorted(({c: r[c] for c in NAMES} for r in out.collect()), key=lambda r: (r["division_id"], r["ordinal"])), out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_splits(spark, seed):
    rows, rng = book(seed), random.Random(seed)
    cuts = [(1, r["division_id"], r["id"], rng.randint(0, len(r["text"]) + 1)) for r in rows if rng.random() < 0.6]
    want = [dict(r) for r in rows]
    for r in sorted(rows, key=lambda r: -r["ordinal"]):
        for _, d, i, at in cuts:
            head, tail = r["text"][:at].rstrip(), r["text"][at:].lstrip()
            if (d, i) != (r["division_id"], r["id"]) or not 0 < at < len(r["text"]) or not head or not tail:
                continue
            own = next(w for w in want if w["division_id"] == d and w["id"] == i)
            new = free(want, d, f"p{r['pages'][0]}-{r['ordinal'] + 2}")
            for w in want:
                w["ordinal"] += w["division_id"] == d and w["ordinal"] > own["ordinal"]
            own.update(text=head, status="raw")
            flags = r["flags"] + ["no-number"] * ("no-number" not in r["flags"])
            want.append({**own, "id": new, "ordinal": own["ordinal"] + 1, "number": None, "text": tail, "ocr_text": tail, "origin": "split", "lineage": [f"{d}#{i}"], "flags": flags, "repairs": [], "footnote_markers": [], "orthography": None})
    got, out = run(spark, rows, rs.split, cuts, "book_id int, division_id string, id string, offset int")
    assert got == ordered(want)
    tails = [r for r in rs.revisions(out).collect() if r["note"].startswith("Split off")]
    assert len(tails) == len(want) - len(rows) and all(r["action"] == "split" and r["status"] == "raw" for r in tails)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merges(spark, seed):
    rows, rng = book(seed), random.Random(seed)
    rows[1]["text"] = " \n "
    merges = [(1, r["division_id"], r["id"], rng.choice(["next", "previous"])) for r in rows if rng.random() < 0.5]
    want = [dict(r) for r in rows]
    pairs = set()
    for _, d, i, way in merges:
        at = next(r["ordinal"] for r in rows if (r["division_id"], r["id"]) == (d, i))
        pairs.add((d, at if way == "next" else at - 1))
    last = {d: max(r["ordinal"] for r in rows if r["division_id"] == d) for d in {r["division_id"] for r in rows}}
    unite = lambda a, b: list(dict.fromkeys([*a, *b]))
    for d in sorted(last):
        first = None
        for k in range(last[d] + 1):
            row = next(w for w in want if w["division_id"] == d and w["ordinal"] == k)
            if first is None or (d, k - 1) not in pairs:
                first = row
                continue
            number = first["number"]
            first.update(
                text=first["text"].rstrip() + " " + row["text"].lstrip(), status="raw", pages=sorted(set(first["pages"]) | set(row["pages"])), printed_pages=unite(first["printed_pages"], row["printed_pages"]), footnote_markers=unite(first["footnote_markers"], row["footnote_markers"]),
                blocks=first["blocks"] + row["blocks"], repairs=first["repairs"] + row["repairs"], lineage=unite(first["lineage"], [*row["lineage"], f"{d}#{row['id']}"]),
                flags=[f for f in unite(first["flags"], row["flags"]) if f != "very-short" and not (f == "no-number" and number is not None)],
            )
            want.remove(row)
    for d in last:
        for k, w in enumerate(ordered([w for w in want if w["division_id"] == d])):
            w["ordinal"] = k
    got, out = run(spark, rows, rs.merge, merges, "book_id int, division_id string, id string, direction string")
    assert got == ordered(want)
    assert rs.revisions(out).count() == sum(len(w["blocks"]) > 1 for w in want)


def test_a_chain_of_merges_loses_no_text(spark):
    rows = [{**book(1)[0], "id": i, "ordinal": k, "text": t} for k, (i, t) in enumerate([("a", "A"), ("b", "B"), ("c", "C")])]
    got, out = run(spark, rows, rs.merge, [(1, "d0", "a", "next"), (1, "d0", "b", "next")], "book_id int, division_id string, id string, direction string")
    assert [(r["id"], r["text"]) for r in got] == [("a", "A B C")] and out.first()["note"] == "Merged b, c into a."


@pytest.mark.parametrize("seed", [1, 2])
def test_inserts_and_deletions(spark, seed):
    rows, rng = book(seed), random.Random(seed)
    new = []
    for r in rows:
        if rng.random() < 0.5:
            new += [(1, r["division_id"], r["id"], k, f"t{k}", rng.choice([None, "12", "૩"])) for k in range(rng.randint(1, 2))]
    new += [(1, "d0", None, 0, "first", None), (1, "fresh", None, 0, "alone", "7"), (1, "d0", "nobody", 0, "lost", None)]
    want = [dict(r) for r in rows]
    at = {(r["division_id"], r["id"]): r for r in rows}
    # Ids are given in reading order; rows are placed from the end.
    todo = [(n, at.get((n[1], n[2]))) for n in new if n[2] is None or (n[1], n[2]) in at]
    todo = sorted(((n, r, r["ordinal"] + 1 if r else 0) for n, r in todo), key=lambda x: (x[0][1], x[2], x[0][3]))
    have, named = [dict(r) for r in rows], []
    for n, r, o in todo:
        pages = r["pages"] if r else []
        i = free(have, n[1], value(n[5]) or f"p{pages[-1] if pages else 0}-{o + 1}")
        row = {**{c: None for c in NAMES}, "book_id": 1, "division_id": n[1], "id": i, "ordinal": o, "number": n[5], "form": r["form"] if r else "prose", "text": n[4], "ocr_text": "", "status": "raw", "origin": "inserted", "lineage": [], "flags": [] if n[5] else ["no-number"], "pages": pages, "orphaned": False}
        have.append(row)
        named.append(row)
    for row in reversed(named):
        for w in want:
            w["ordinal"] += w["division_id"] == row["division_id"] and w["ordinal"] >= row["ordinal"]
        want.append(row)
    got, _ = run(spark, rows, rs.insert, new, "book_id int, division_id string, after string, place int, text string, number string")
    assert got == ordered(want)
    gone = [(1, r["division_id"], r["id"]) for r in rows if r["ordinal"] % 2]
    kept, _ = run(spark, rows, rs.delete, gone, "book_id int, division_id string, id string")
    assert [(r["id"], r["ordinal"]) for r in kept] == [(r["id"], r["ordinal"] // 2) for r in rows if r["ordinal"] % 2 == 0]


def test_renumbering(spark):
    rows = [{**book(1)[0], "id": i, "ordinal": k, "flags": f, "pages": [4]} for k, (i, f) in enumerate([("v1", ["no-number", "x"]), ("v2", []), ("v3", []), ("p4-4", ["no-number"])])]
    changes = [(1, "d0", "v1", "૨"), (1, "d0", "v3", None), (1, "d0", "p4-4", "2")]
    got, out = run(spark, rows, rs.renumber, changes, "book_id int, division_id string, id string, number string")
    assert [(r["id"], r["number"], r["flags"], r["lineage"]) for r in got] == [
        ("v2-2", "૨", ["x"], ["o#0", "d0#v1"]), ("v2", rows[1]["number"], [], ["o#0"]), ("p4-3", None, ["no-number"], ["o#0", "d0#v3"]), ("v2-3", "2", [], ["o#0", "d0#p4-4"])
    ]
    assert sorted(r["id"] for r in rs.revisions(out).collect()) == ["p4-3", "v2-2", "v2-3"]


def test_ids_that_end_in_numbers_lend_their_suffixes(spark):
    ids = ["p4-2", "p4-2-2", "p4-2-3", "p4-2-100", "p4-2-05", "p4-2-99999999999"]
    rows = [{**book(1)[0], "id": i, "ordinal": k, "text": "ab cd", "pages": [4]} for k, i in enumerate(ids)]
    got, _ = run(spark, rows, rs.split, [(1, "d0", "p4-2", 2)], "book_id int, division_id string, id string, offset int")
    assert [r["id"] for r in got] == ["p4-2", "p4-2-4", *ids[1:]]


@pytest.mark.parametrize("change", ["split", "merge", "insert", "delete", "renumber"])
def test_verses_dealt_by_division_are_dealt_no_more(spark, change):
    schema = {"split": "id string, offset int", "merge": "id string, direction string", "insert": "after string, place int, text string, number string", "delete": "id string", "renumber": "id string, number string"}[change]
    verses = spark.createDataFrame([tuple(r[c] for c in NAMES) for r in book(1)], SCHEMA).repartition(3, "book_id", "division_id")
    changes = spark.createDataFrame([], f"book_id int, division_id string, {schema}").repartition(3, "book_id", "division_id")
    out = getattr(rs, change)(verses, changes)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange ") == 2
    assert out.count() == len(book(1))

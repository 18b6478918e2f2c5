"""SimHash, substring removal, decontamination: against brute force."""

import hashlib
import random
import time

import numpy as np
import xxhash

from folioforge.llm import bottomk, decontaminate, simhash, substring
from folioforge.llm.common import Texts, span_hashes
from folioforge.llm.fm_index import FmIndex, suffix_order

from .fixtures import documents, make, words


def brute_fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, radius):
    """The component of each fingerprint: rows are linked by near fingerprints and by a common id."""
    nodes = list(dict.fromkeys(prints))
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, f) in enumerate(nodes):
        for j, (e, g) in enumerate(nodes):
            if f == g or (d is not None and d == e) or (d is not None and e is not None and (f ^ g).bit_count() <= radius):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(nodes):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return {f: least.get(find(i)) for i, (_, f) in enumerate(nodes)}


def test_simhash_components_agree_with_brute_force(spark):
    df, rows = documents(spark)
    prints = [(d, brute_fingerprint(t)) for d, t in rows]
    named = brute_components(prints, 3)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicate_digest(df).collect())
    assert got == sorted((d if d is not None else -1, f"{f:016x}", named[f]) for d, f in prints)
    assert simhash.near_duplicate_digest(df.limit(0)).count() == 0


def test_rows_of_one_id_link_their_texts(spark):
    a, b = "alpha beta gamma delta", "one two three four five"
    rows = [(3, a), (7, a), (5, b), (7, b), (9, "something else entirely here"), (None, b), (None, "x")]
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["component_id"]) for r in simhash.near_duplicate_digest(make(spark, rows)).collect() if r["component_id"] is not None)
    assert got == [(-1, 3), (3, 3), (5, 3), (7, 3), (7, 3), (9, 9)]


def test_tiles_lose_no_link(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (1 << 64) - 1 for b in base for _ in range(6)})
    classes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), k) for k, f in enumerate(prints)], "fp long, rep long")
    from folioforge.llm.components import components

    found = {r["node"]: r["component"] for r in components(simhash.links(classes, 3, tile=8)).collect()}
    want = brute_components(list(enumerate(prints)), 3)
    assert {k: found.get(k, k) for k in range(len(prints))} == {k: want[f] for k, f in enumerate(prints)}


def test_forest_connects_what_the_links_do():
    rng = np.random.default_rng(2)
    i, j = rng.integers(0, 80, 300), rng.integers(0, 80, 300)
    keep = simhash.forest(i, j, 80)

    def classes(i, j):
        label = list(range(80))
        for a, b in zip(i.tolist(), j.tolist()):
            x, y = label[a], label[b]
            label = [min(x, y) if v in (x, y) else v for v in label]
        return label

    assert classes(i, j) == classes(i[keep], j[keep]) and len(keep) < 80


def test_keep_one_keeps_clean_documents_and_one_of_each_group(spark):
    rng = random.Random(8)
    vocabulary = [f"v{k}" for k in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    one, rows = text(300), []
    near = list(one)
    near[40] = near[200] = "changed"
    rows += [(5, " ".join(one)), (9, " ".join(near)), (2, " ".join(one)), (2, " ".join(one)), (7, ""), (8, None), (None, "kept")]
    rows += [(20 + k, " ".join(text(rng.randint(5, 200)))) for k in range(30)]
    out = simhash.keep_one(make(spark, rows))
    assert out.columns == make(spark, []).columns
    ids = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in out.collect())
    assert ids == [-1, 2, 7, *range(20, 50)]
    assert simhash.keep_one(make(spark, [])).count() == 0


def test_near_copies_are_decided_by_their_shingles(spark, monkeypatch):
    rows, want = [], []
    for k in range(120):
        # 100 common shingles of 5 words, then 13 (0.794) or 12 (0.806) of each text's own
        common, own = [f"c{k}_{x}" for x in range(104)], 13 if k % 2 else 12
        rows += [(2 * k, " ".join([*common, *(f"a{k}_{x}" for x in range(own))])), (2 * k + 1, " ".join([*common, *(f"b{k}_{x}" for x in range(own))]))]
        want += [2 * k, 2 * k + 1] if k % 2 else [2 * k]
    short = "one two three four five six seven eight nine".split()  # 5 shingles; 4 of 5 are common
    rows += [(1000, " ".join(short)), (1001, " ".join(short[:8]))]
    got = lambda: sorted(r["doc_id"] for r in simhash.keep_one(make(spark, rows)).collect())
    assert got() == [*want, 1000]
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 60)  # each set is a block of its own
    assert got() == [*want, 1000]


def test_near_copies_agree_with_brute_force(spark, monkeypatch):
    rng = random.Random(21)
    vocabulary, rows = [f"n{k}" for k in range(4000)], []
    for k in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 150))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randint(0, 3)):
            near = list(base)
            for _ in range(rng.randint(0, 4)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(near[: len(near) - rng.randint(0, 2)])))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words(t.lower()) for _, t in rows)]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    want = sorted(set(label))
    assert len(want) < len(rows) - 20
    got = lambda: sorted(r["doc_id"] for r in simhash.keep_one(make(spark, rows)).collect())
    assert got() == want
    monkeypatch.setattr(simhash.similar_links, "__defaults__", (3,))  # many tiles and stripes
    assert got() == want


def test_two_texts_of_one_id_are_kept(spark):
    rows = [(1, "one two three four five six"), (1, "other words that stand for themselves here"), (2, "one two three four five six")]
    assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(make(spark, rows)).collect()) == rows[:2]


def brute_removed(rows, window=13):
    big = 1 << 62
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, big), big if d is None else d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (big if d is None else d):
                gone[i : i + window] = [True] * window
        out.append((-1 if d is None else d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


def test_repeated_windows_agree_with_brute_force(spark, monkeypatch):
    df, rows = documents(spark, 2)
    want = brute_removed(rows)
    assert any(w[2] for w in want)
    assert result(substring.remove_repeats(df)) == want
    monkeypatch.setattr(substring, "HOT", 2)  # most anchors count as hot: their windows are dealt one by one
    assert result(substring.remove_repeats(df)) == want
    assert substring.remove_repeats(df.limit(0)).count() == 0


def test_fm_index_finds_every_window():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 5, 400), 0)
    owner = rng.integers(0, 1000, len(text))
    index = FmIndex(text, 5, 6, owner)
    ends = np.arange(6, 400)
    begin, end = index.search(text.astype(np.int32), ends, 6)
    least = index.least(begin, end)
    for k, e in enumerate(ends):
        at = [p for p in range(len(text) - 6) if (text[p : p + 6] == text[e - 6 : e]).all()]
        assert end[k] - begin[k] == len(at) and least[k] == min(owner[at])


def test_suffix_order_with_many_symbols():
    rng = np.random.default_rng(6)
    for symbols, order in ((3, 13), (70_000, 13), (1 << 21, 5), (9, 1)):
        text = np.append(np.tile(rng.integers(1, symbols, 150), 3), 0)
        padded = [*(text + 1).tolist(), *[0] * order]
        want = sorted(range(len(text)), key=lambda p: (padded[p : p + order], p))
        assert suffix_order(text, symbols, order).tolist() == want


def test_tiling_covers_reordered_passages(spark):
    rng = random.Random(6)
    vocabulary = [f"b{k}" for k in range(2000)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, some(30)) for k in range(8)] + [(90, "too short"), (91, None), (92, "")]
    turned = items[1][1].split()
    turned = " ".join([*turned[20:], *turned[:10], *turned[10:20]]).title()
    part = " ".join(items[2][1].split()[:10])
    rows = [(1, f"{some(50)} {items[0][1]}, {some(20)}"), (2, f"{some(9)} {turned}!"), (3, f"{some(40)} {part} {some(30)}"), (4, some(200)), (5, None), (6, ""), (None, items[3][1])]
    docs, benchmark = make(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = lambda df: sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["item_id"], r["n_covered"]) for r in df.collect())
    want = [(-1, 3, 30), (1, 0, 30), (2, 1, 30)]
    assert got(decontaminate.leaks(docs, benchmark)) == want
    assert got(decontaminate.leaks(docs, benchmark, bound=200)) == want  # a benchmark beyond the bound goes in parts
    for bound in (1 << 20, 200):
        kept = decontaminate.drop_leaking(docs, benchmark, bound=bound)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6]
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), benchmark).count() == 0


def brute_tiling(doc, item, least):
    """Greedy string tiling by definition: all maximal matches of unmarked words of the greatest length, in order, again and again."""
    free_doc, free_item, out = [True] * len(doc), [True] * len(item), []
    while True:
        most, found = least, []
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and free_doc[p + n] and free_item[q + n]:
                    n += 1
                if n > most:
                    most, found = n, [(p, q)]
                elif n == most:
                    found.append((p, q))
        if not found:
            return out
        for p, q in found:
            if all(free_doc[p : p + most]) and all(free_item[q : q + most]):
                free_doc[p : p + most] = free_item[q : q + most] = [False] * most
                out.append((p, q, most))


def test_tiling_agrees_with_its_definition():
    rng = np.random.default_rng(8)
    for words in (3, 4, 30):
        for _ in range(150):
            item = rng.integers(0, words, rng.integers(1, 50)).astype(np.uint64)
            parts = [item[a : a + rng.integers(2, 20)] for a in rng.integers(0, len(item), 4)]
            doc = np.concatenate([rng.integers(0, words, 5).astype(np.uint64), *parts, rng.integers(0, words, 12).astype(np.uint64)])
            want = brute_tiling(doc.tolist(), item.tolist(), 3)
            got = decontaminate.tiles(doc, item, np.ones(len(doc), dtype=bool), 3)
            assert sum(n for _, _, n in got) == sum(n for _, _, n in want) and sorted(got) == sorted(want)


def test_long_texts_and_rows_of_one_id_leak_each(spark):
    rng = random.Random(4)
    some = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    item = some(40)
    df = spark.createDataFrame([(1, f"{some(60_000)} {item}", 1, "x"), (1, some(50), 2, "x"), (1, item, 3, "x"), (1, item, 3, "x")], "doc_id long, text string, item_id long, coverage string")
    benchmark = spark.createDataFrame([(5, item, 0), (5, item, 0)], "item_id long, text string, doc_id long")
    assert decontaminate.leaks(df, benchmark).count() == 6
    kept = decontaminate.drop_leaking(df, benchmark)
    assert kept.columns == df.columns and [r["item_id"] for r in kept.collect()] == [2]


def test_tiles_mark_no_word_twice():
    rng = np.random.default_rng(5)
    for _ in range(200):
        doc, item = rng.integers(0, 4, 40).astype(np.uint64), rng.integers(0, 4, 15).astype(np.uint64)
        found = decontaminate.tiles(doc, item, np.ones(40, dtype=bool), 3)
        for side, length in ((0, 40), (1, 15)):
            marked = [x for t in found for x in range(t[side], t[side] + t[2])]
            assert len(marked) == len(set(marked)) and all(0 <= x < length for x in marked)
        assert all((doc[p : p + n] == item[q : q + n]).all() for p, q, n in found)
        free_doc, free_item = np.ones(40, bool), np.ones(15, bool)
        for p, q, n in found:
            free_doc[p : p + n] = free_item[q : q + n] = False
        assert not any((doc[p : p + 3] == item[q : q + 3]).all() and free_doc[p : p + 3].all() and free_item[q : q + 3].all() for p in range(38) for q in range(13))


def test_words_that_differ_in_one_number_are_not_repeats(spark):
    tail = " ".join(f"t{k}" for k in range(12))
    rows = [(1, f"order-61820 {tail}"), (2, f"order-143925 {tail}")]
    rows += [(10 + k, f"order-{k} {tail} x{k}") for k in range(3000)]
    rows += [(5000, f"a order-7 {tail} b")]
    df = make(spark, rows)
    assert result(substring.remove_repeats(df)) == brute_removed(rows)


def twins(n=10):
    """Two different words of 2**n letters whose polynomial hashes modulo 2**64 agree for every base."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_long_words_are_told_apart(spark):
    a, b = twins()
    tail = " ".join(f"t{k}" for k in range(40))
    rows = [(1, f"{tail[:50]} {a} {tail}"), (2, f"{tail[:50]} {b} {tail}"), (3, f"{a} " * 20), (4, f"{b} " * 20), (5, a), (6, b)]
    df = make(spark, rows)
    assert result(substring.remove_repeats(df)) == brute_removed(rows)
    assert {3, 4, 5, 6} <= {r["doc_id"] for r in simhash.keep_one(df).collect()}
    prints = {r["doc_id"]: r["fingerprint"] for r in bottomk.edited_digest(df).collect()}
    assert prints[5] != prints[6] and prints[3] != prints[4]


def test_hashes_of_spans_differ_at_every_length():
    rng = np.random.default_rng(2)
    for n in [*range(0, 70), 100, 1000]:
        spans = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for _ in range(20)]
        spans += [s[:-1] for s in spans if s] + [s + b"\0" for s in spans]
        data = np.frombuffer(b"".join(spans), np.uint8)
        ends = np.cumsum([len(s) for s in spans])
        starts = ends - [len(s) for s in spans]
        h = span_hashes(data, starts, ends)
        assert len({(s, int(x)) for s, x in zip(spans, h)}) == len(set(spans)) == len(set(h.tolist()))
        again = span_hashes(np.concatenate([np.zeros(3, np.uint8), data]), starts + 3, ends + 3)
        assert (again == h).all()


def test_one_row_stays_of_each_group_and_no_other_is_lost(spark):
    schema = "doc_id long, text string, lang string, _row string, tags map<string,string>, s struct<a:string,b:string>"
    t = "a text of a few words that stands here once more for the test"
    rows = [
        (1, t, None, "keep", {"x": "y"}, (None, "p")), (1, None, t, "keep", {"x": "y"}, ("p", None)),  # one id, null in other columns
        (2, t + " again", "en", "mine", None, None), (3, "quite another text that nobody else has in this table at all", "en", None, {}, ("q", "q")),
        (3, "quite another text that nobody else has in this table at all", "en", None, {}, ("q", "q")), (None, t, "en", "z", None, None), (4, t, "en", "w", {"k": None}, None),
    ]
    df = spark.createDataFrame(rows, schema)
    outs = [sorted(map(str, simhash.keep_one(df.repartition(n)).collect())) for n in (1, 3, 7)]
    assert outs[0] == outs[1] == outs[2]
    out = simhash.keep_one(df)
    assert out.columns == df.columns and out.schema == df.schema
    kept = sorted((str(r["doc_id"]), str(r["text"]), str(r["_row"])) for r in out.collect())
    # 10 of the 11 shingles of the second text are those of the first: one of the two stays.
    assert kept == sorted([("1", t, "keep"), ("1", "None", "keep"), ("3", rows[3][1], "None"), ("None", t, "z")])


def test_items_of_one_template_and_repeated_words_are_tiled_fast():
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(10_000)) for _ in range(n))
    items = decontaminate.Items([(k, f"which of the following is true about {some(14)}") for k in range(4000)] + [(9999, "a " * 200)], 4, 0.5)
    leaked = " ".join(["which of the following is true about", some(30)])
    parts = [f"{some(300)} which of the following is true about {some(300)}".encode(), leaked.encode(), ("a " * 500_000).encode(), b"which of the following is true about " * 2000]
    data, at = np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    begin = time.perf_counter()
    found = list(items.candidates(Texts(data, at)))
    assert time.perf_counter() - begin < 3
    assert [(d, items.ids[k]) for d, k, _, _ in found] == [(2, 9999)]
    _, k, words, covered = found[0]
    begin = time.perf_counter()
    assert decontaminate.tiles(words, items.words[k], covered, 4) == [(0, 0, 200)]
    assert time.perf_counter() - begin < 10


def test_seeds_bound_what_tiles_can_cover():
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    tests = [(k, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 25)))) for k in range(40)]
    for threshold in (0.1, 0.5, 0.9, 1.0):
        items = decontaminate.Items(tests, 3, threshold)
        bodies = [t.encode() for t in texts]
        view = Texts(np.frombuffer(b"".join(bodies), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in bodies])]))
        got = {(d, k): sum(t[2] for t in decontaminate.tiles(w, items.words[k], c, 3)) for d, k, w, c in items.candidates(view)}
        want = {}
        for d, t in enumerate(texts):
            for k, (_, item) in enumerate(tests):
                n = sum(x[2] for x in brute_tiling(t.split(), item.split(), 3))
                if n and n >= threshold * len(item.split()):
                    want[d, k] = n
        assert {p: n for p, n in got.items() if n >= threshold * items.sizes[p[1]]} == want

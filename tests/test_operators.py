"""Operators on small tables written by hand, and against folds."""

import json
import random

from pyspark.sql import functions as F

from folioforge.operators import segment as seg
from folioforge.operators import sequence as seq
from folioforge.operators import structure as st
from folioforge.operators import studio, triage, versions
from folioforge.sources import pages, shared


def rows(df, *order):
    return [tuple(x) for x in df.orderBy(*order).collect()]


def fold_runs(numbers):
    """numbers: (division, number) in order; the runs as (division, first, last, missing, duplicates, out of order)."""
    runs, before = [], None
    for division, n in numbers:
        if n is None:
            continue
        if not runs or (n != before + 1 and n <= before and runs[-1]["d"] != division):
            runs.append({"d": division, "n": [n], "o": set()})
        else:
            if n != before + 1:
                runs[-1]["o"].add(n)
            runs[-1]["n"].append(n)
        before = n
    return [(x["d"], min(x["n"]), max(x["n"]), sorted(set(range(min(x["n"]), max(x["n"]) + 1)) - set(x["n"])), sorted({n for n in x["n"] if x["n"].count(n) > 1}), sorted(x["o"])) for x in runs]


def test_sequence_runs_agree_with_a_fold(spark):
    rng, data, want = random.Random(3), [], {}
    for book in range(60):
        numbers, n = [], 0
        for d in range(rng.randint(1, 4)):
            if rng.random() < 0.6:
                n = 0
            for _ in range(rng.randint(0, 7)):
                n = rng.choice([n + 1, n + 1, n + 1, n + 3, n, max(1, n - 2)])
                numbers.append((f"d{d}", None if rng.random() < 0.1 else n))
        data += [(book, d, k, x) for k, (d, x) in enumerate(numbers)]
        want[book] = fold_runs(numbers)
    df = spark.createDataFrame(data, "book int, division string, pos int, number int")
    got = {}
    for r in seq.check_sequence(df).orderBy("book", "run").collect():
        got.setdefault(r["book"], []).append((r["division"], r["first"], r["last"], [n for g in r["missing"] for n in range(g["start"], g["end"] + 1)], r["duplicates"], r["out_of_order"]))
    assert got == {b: w for b, w in want.items() if w}


def test_one_misread_number_is_one_gap(spark):
    df = spark.createDataFrame([(1, "a", 1, 5), (1, "a", 2, 900_000_000_000), (1, "a", 3, 6)], "book int, division string, pos int, number long")
    r = seq.check_sequence(df).first()
    assert [(g["start"], g["end"]) for g in r["missing"]] == [(7, 899_999_999_999)] and r["out_of_order"] == [6, 900_000_000_000]


def simulated(requests, capacity, seconds=60):
    """A queue of granted stamps for each key: those of the last seconds count, one that is just as old has left."""
    stamps, out = {}, {}
    for at, k, key in sorted((at, k, key) for k, key, at in requests):
        live = [s for s in stamps.get(key, []) if s > at - seconds]
        out[k] = (len(live), len(live) < capacity)
        stamps[key] = live + [at] if len(live) < capacity else live
    return out


def test_only_granted_requests_fill_the_window(spark):
    df = spark.createDataFrame([(k, "a", 10 * k) for k in range(30)], "id int, key string, s int").withColumn("ts", F.timestamp_seconds("s"))
    out = seq.within_rate(df, ["key"], "ts", ["id"], 3)
    assert [r["s"] for r in out.where("allowed").orderBy("s").collect()] == [0, 10, 20, 60, 70, 80, 120, 130, 140, 180, 190, 200, 240, 250, 260]


def test_rates_equal_a_queue_of_granted_stamps(spark):
    rng = random.Random(7)
    for capacity, most in ((1, 4000), (3, 900), (20, 500)):
        data = [(k, rng.choice(["a", "b", None]), rng.choice([rng.randrange(0, most), 60 * rng.randrange(0, most // 60)])) for k in range(300)]
        df = spark.createDataFrame([*data, (900, "a", None)], "id int, key string, s int").withColumn("ts", F.timestamp_seconds("s")).repartition(3)
        got = {r["id"]: (r["in_window"], r["allowed"]) for r in seq.within_rate(df, ["key"], "ts", ["id"], capacity).collect()}
        assert got.pop(900) == (None, False)
        assert got == simulated([(k, str(key), at) for k, key, at in data], capacity)
    assert seq.within_rate(df, ["key"], "ts", ["id"], 0).where("allowed").count() == 300


def given(rows):
    """Ids in order: each row's own, or the first of id-2, id-3, … that none has."""
    taken, out = {}, {}
    for division, k, wanted in sorted(rows, key=lambda r: r[1]):
        have = taken.setdefault(division, set())
        pick = wanted if wanted not in have else next(c for c in (f"{wanted}-{n}" for n in range(2, len(have) + 3)) if c not in have)
        have.add(pick)
        out[k] = pick
    return out


def test_ids_are_unique_among_those_that_stand_and_those_given(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(["v1", "v1", "v1-2", "v1", "v1-2", "v1-3", "v1-2-2", "v2", None])], "division int, k int, id string")
    out = {r["k"]: r["unique_id"] for r in seq.unique_ids(df, ["division"], "id", ["k"]).collect()}
    assert [out[k] for k in range(9)] == ["v1", "v1-2", "v1-2-2", "v1-3", "v1-2-3", "v1-3-2", "v1-2-2-2", "v2", None]


def test_unique_ids_read_their_rows_a_few_times(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(k % 5, k, ["a", "a-2", "b", None][k % 4]) for k in range(400)], "division int, k int, id string")
    assert seq.unique_ids(df.mapInArrow(counted, df.schema), ["division"], "id", ["k"]).count() == 400
    assert seen.value <= 3 * 400


def test_unique_ids_equal_one_pass_in_order(spark):
    rng = random.Random(9)
    some = lambda: rng.choice(["v1", "v1", "v2", ""]) + rng.choice(["", "", "-2", "-3", "-2-2", "-02", "-1", "-10", "-x", "-"])
    rows = [(rng.choice([1, 2, None]), k, some()) for k in range(600)] + [(3, 1000 + k, "hot") for k in range(500)]
    df = spark.createDataFrame(rows, "division int, k int, id string").repartition(5)
    clash = df.withColumn("_place_", F.lit(7)).withColumn("_wanted_", F.lit("w")).withColumn("_place", F.col("k"))
    out = seq.unique_ids(clash, ["division"], "id", ["k"])
    assert out.columns == [*clash.columns, "unique_id"] and out.where("_place_ <> 7 OR _wanted_ <> 'w' OR _place <> k").count() == 0
    got = {r["k"]: r["unique_id"] for r in seq.unique_ids(df, ["division"], "id", ["k"]).collect()}
    assert got == given(rows)
    assert seq.unique_ids(df.limit(0), ["division"], "id", ["k"]).count() == 0


def test_places_within_keys_that_several_parts_hold(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), k) for k in range(2000)]
    got = {r["k"]: r["place"] for r in seq.ranked(spark.createDataFrame(rows, "key string, k int").repartition(6), ["key"], ["k"], "place").collect()}
    seen = {}
    for key, k in rows:
        seen[key] = seen.get(key, 0) + 1
        assert got[k] == seen[key]


def test_titles_from_running_heads(spark):
    heads = spark.createDataFrame([(1, p, "BOOK") for p in range(6)] + [(1, 0, "A"), (1, 1, "A"), (1, 1, "B"), (1, 3, "C"), (1, 4, "D")], "book int, page int, head string")
    passages = spark.createDataFrame([(1, 0, [0, 1]), (1, 1, [3, 4]), (1, 2, [5]), (1, 0, [1])], "book int, section int, pages array<int>")
    assert rows(seq.titles_from_heads(passages, heads), "section") == [(1, 0, "A")]


def test_flags_reset_at_a_division_only(spark):
    df = spark.createDataFrame([(1, "a", 1, 1), (1, "a", 2, 2), (1, "b", 3, 1), (1, "b", 4, 2), (1, "b", 5, 1), (1, "b", 6, None)], "book int, division string, pos int, number int")
    out = rows(seq.number_flags(df).select("pos", "duplicate_number", "out_of_sequence"), "pos")
    assert out == [(1, False, False), (2, False, False), (3, False, False), (4, False, False), (5, True, True), (6, False, False)]


def test_vote_tie(spark):
    df = spark.createDataFrame([("s", "x"), ("s", "x"), ("s", "y"), ("t", "x"), ("t", "y"), ("u", None)], "g string, v string")
    assert rows(seq.vote(df, ["g"], "v"), "g") == [("s", "x", 2), ("t", None, 1)]


def test_import_rules(spark):
    s = "book_id int, division_id string, id string, number int, text string, ocr_text string, status string, ocr_changed boolean, orphaned boolean, origin string, confidence double"
    old = spark.createDataFrame(
        [
            (1, "d", "raw", 1, "a", "a", "raw", False, False, "imported", 0.5),
            (1, "d", "edited", 2, "mine", "b", "proofed", False, False, "imported", 0.5),
            (1, "d", "same", 3, "mine", "c", "proofed", False, True, "imported", 0.5),
            (1, "d", "gone", 4, "d", "d", "raw", False, False, "imported", 0.5),
            (1, "d", "own", 5, "e", "e", "raw", False, False, "split", 0.5),
        ],
        s,
    )
    new = spark.createDataFrame([(1, "d", "raw", 9, "A", 0.9), (1, "d", "edited", 8, "B", 0.9), (1, "d", "same", 7, "c", 0.9), (1, "d", "new", 6, "n", 0.9)], "book_id int, division_id string, id string, number int, text string, confidence double")
    out = {r["id"]: r for r in studio.import_draft(old, new).collect()}
    assert (out["raw"]["text"], out["raw"]["number"], out["raw"]["action"]) == ("A", 9, "refreshed")
    assert (out["edited"]["text"], out["edited"]["ocr_text"], out["edited"]["status"], out["edited"]["ocr_changed"], out["edited"]["action"]) == ("mine", "B", "raw", True, "reset")
    assert (out["same"]["status"], out["same"]["ocr_changed"], out["same"]["orphaned"], out["same"]["restored"]) == ("proofed", False, False, True)
    assert out["gone"]["orphaned"] and out["gone"]["action"] == "orphaned"
    assert not out["own"]["orphaned"] and out["own"]["action"] == "kept"
    assert out["new"]["action"] == "inserted" and out["new"]["status"] == "raw"


def test_aliases_follow_chains_cycles_and_ancestors(spark):
    ref = lambda *xs: spark.createDataFrame([(x,) for x in xs], "ref string")
    edges = lambda *xs: spark.createDataFrame(xs, "source string, target string")
    live = ref("b", "b/c", "b/c#v9")
    aliases = edges(("b/c#v1", "b/c#v2"), ("b/c#v2", "b/c#v3"), ("b/c#v3", "b/c#v9"), ("b#x", "b#y"), ("b#y", "b#x"))
    out = {r["ref"]: (r["target"], r["status"]) for r in versions.migrate(ref("b/c#v1", "b#x", "b/c", "b#z"), live, aliases).collect()}
    assert out == {"b/c#v1": ("b/c#v9", "rewritten"), "b#x": (None, "orphaned"), "b/c": ("b/c", "live"), "b#z": (None, "orphaned")}
    chain = edges(*((f"b#n{k}", f"b#n{k + 1}") for k in range(20)))
    far = versions.follow(ref("b#n3", "b#n4"), chain, ref("b#n20"))
    assert rows(far, "source") == [("b#n4", "b#n20")]
    above = {r["ref"]: r["ancestor"] for r in versions.nearest_live_ancestor(ref("b/c#v1", "b/q/r#v1", "b/c/d"), live).collect()}
    assert above == {"b/c#v1": "b/c", "b/q/r#v1": "b", "b/c/d": "b/c"}
    derived = versions.derive_aliases(ref("b/c#v1", "b/c#v5", "b/c"), live, edges(("b/c#v1", "b/c#v9")), edges(("b#old", "b/c#v1")))
    assert {r["source"]: r["target"] for r in derived.collect()} == {"b/c#v1": "b/c#v9", "b/c#v5": "b/c", "b#old": "b/c#v9"}


def test_diff_keeps_a_ref_that_changes_kind(spark):
    s = "ref string, kind string, hash string"
    before = spark.createDataFrame([("b#v1", "verse", "1"), ("b#v2", "verse", "2"), ("b/x", "verse", "3")], s)
    after = spark.createDataFrame([("b#v1", "verse", "9"), ("b/x", "division", None), ("b#v3", "verse", "4")], s)
    assert rows(versions.diff_units(before, after), "ref") == [("b#v1", "verse", "changed"), ("b#v2", "verse", "retired"), ("b#v3", "verse", "added")]


def test_releases(spark):
    layers = lambda *xs: spark.createDataFrame([(x,) for x in xs], "layer_id string")
    changed = versions.diff_layers(layers("a", "b", "b"), layers("b", "c"))
    assert rows(changed, "layer_id") == [("a", "removed"), ("c", "added")]
    none = spark.createDataFrame([], "ref string, kind string, change string")
    aliases = spark.createDataFrame([], "source string, target string")
    diff = versions.release_diff(none, aliases, changed).withColumn("said", versions.describe_change()).first()
    assert (diff["required_bump"], diff["said"]) == ("major", "1 removed layers, 1 new layers")
    assert versions.release_diff(none, aliases).withColumn("said", versions.describe_change()).first()["said"] == "nothing"
    pairs = spark.createDataFrame([("a", "1.0.0", "1.0.1", "major", "a"), ("a", "1.0.0", "2.0.0", "major", "z"), ("a", "1.0.0", "1.1.0", None, "a"), ("a", "1.0.0", "0.9.0", "patch", "a"), ("a", "1.0.0", "2.0.0", "major", "a")], "book_id string, version_before string, version_after string, required_bump string, book_before string")
    assert sorted((r["code"], r["severity"]) for r in versions.audit_releases(pairs).collect()) == [("release-book-mismatch", "error"), ("release-bump-understates-change", "warning"), ("release-content-unchanged", "warning"), ("release-version-not-newer", "error")]


BOOK = {
    "id": "b",
    "structure": [
        {"kind": "section", "id": "s1", "children": [{"id": "v1", "number": "1", "layers": {"text": "one"}, "hash": "f1a64:0"}, {"id": "v1", "layers": {"other": "x"}}]},
        {"id": "v2", "layers": {"text": "two", "words": [{"word": "w", "meaning": "m"}]}},
    ],
}


def test_books_flatten_and_nest_again(spark):
    units = st.flatten_books(spark.createDataFrame([(json.dumps(BOOK),)], "document string"))
    assert rows(units.select("ref", "parent_ref", "depth"), "ord") == [("b/s1", "b", 1), ("b/s1#v1", "b/s1", 2), ("b/s1#v1", "b/s1", 2), ("b#v2", "b", 1)]
    assert [r[2] for r in rows(st.sibling_issues(units), "path")] == ["b/s1"]
    layer = "book_id string, layer_id string"
    primary = spark.createDataFrame([("b", "text")], layer)
    declared = spark.createDataFrame([("b", "text", "original", None, 0), ("b", "words", "wordMeanings", None, 1), ("b", "words", "wordMeanings", None, 2), ("b", "roman", "transliteration", None, 3)], f"{layer}, kind string, scheme string, position int")
    codes = lambda df: sorted((r["code"], r["path"]) for r in df.collect())
    assert codes(st.layer_issues(units, declared, primary)) == [("primary-layer-missing", "b/s1#v1"), ("undeclared-layer", "b/s1#v1")]
    assert codes(st.layer_issues(units, declared.withColumn("kind", F.lit("original")), primary))[0] == ("layer-kind-mismatch", "b#v2")
    assert codes(st.declaration_issues(declared, primary)) == [("duplicate-layer-id", "/layers/2"), ("transliteration-scheme-missing", "/layers/3")]
    assert codes(st.declaration_issues(declared, spark.createDataFrame([("b", "words")], layer)))[1:2] == [("primary-layer-not-original", "/primaryLayer")]
    assert codes(st.declaration_issues(declared, spark.createDataFrame([("b", "none")], layer)))[1:2] == [("primary-layer-undeclared", "/primaryLayer")]
    from folioforge.functions.refs import verse_hash

    report = st.validate(units, declared, primary, verse_hash(F.col("layers")))
    assert {"hash-mismatch", "duplicate-sibling-id", "undeclared-layer"} <= {r["code"] for r in report.collect()}
    assert report.where("code = 'hash-mismatch'").select(st.format_issue()).first()[0] == "error  b/s1#v1  [hash-mismatch]"
    tree = json.loads(st.build_tree(units, 2).first()["structure"])
    assert [x["id"] for x in tree] == ["s1", "v2"] and [x["id"] for x in tree[0]["children"]] == ["v1", "v1"]
    assert tree[1]["layers"]["text"] == "two"


def test_triage_rules(spark):
    df = spark.createDataFrame([(1, 1, "the cat and the dog in the house of the old man", 0.0), (1, 2, "x", 0.0), (1, 3, "ab" * 40, 0.9), (2, 1, "", 0.0)], "d int, n int, text string, image double")
    pages_ = triage.classify_pages(df, image_share="image")
    assert [r[0] for r in rows(pages_.select("strategy", "d", "n"), "d", "n")] == ["unicode-text", "blank", "scanned", "blank"]
    assert [(r["verdict"], r["needs_ocr"]) for r in triage.triage_documents(pages_, ["d"], "n").orderBy("d").collect()] == [("mixed", True), ("unknown", True)]


def test_segmentation(spark):
    b = [
        (1, 1, 0, "heading", "પ્રથમ"),
        (1, 1, 1, "paragraph", "આ એક લાંબો ફકરો છે જે પૂરતો લાંબો છે કે ટૂંકો ન ગણાય ॥૧॥ બીજો"),
        (1, 2, 0, "paragraph", "ચાલુ રહે છે ॥ ૨ ॥ ॥૩॥"),
        (1, 2, 1, "header", "૨ શીર્ષક"),
        (1, 2, 2, "paragraph", "॥ ઇતિ સમાપ્ત ॥"),
        (1, 3, 0, "paragraph", "નવો ભાગ ॥૧॥"),
        (1, 3, 1, "paragraph", "પૂંછડી"),
    ]
    df = spark.createDataFrame(b, "book int, page int, pos int, tag string, text string")
    out = seg.segment(df, "gujr", ["gujr", "deva"]).orderBy("pos").collect()
    assert [r["number"] for r in out] == [1, 2, 1, None]
    assert [r["pages"] for r in out] == [[1], [1, 2], [3], [3]]
    assert out[1]["text"] == "બીજો ચાલુ રહે છે ॥" and "spans-pages" in out[1]["flags"]
    assert out[2]["flags"] == ["very-short"] and "no-number" in out[3]["flags"]
    assert out[0]["confidence"] == 1.0 and out[3]["confidence"] == 0.5


def test_a_flattened_pair_is_recovered(spark):
    shloka = "कर्मण्येवाधिकारस्ते मा फलेषु कदाचन"
    b = [
        (1, 1, 0, "paragraph", "પહેલો ફકરો જે પૂરતો લાંબો છે કે ટૂંકો ન ગણાય તેવો છે ॥૧૫૭॥"),
        (1, 1, 1, "paragraph", f"{shloka} ॥२॥१५८॥"),
        (1, 1, 2, "paragraph", f"{shloka} ॥१॥ {shloka} ॥३॥ ॥९॥"),
        (1, 1, 3, "paragraph", "બીજો ॥૧૫૯॥"),
    ]
    df = spark.createDataFrame(b, "book int, page int, pos int, tag string, text string")
    out = seg.segment(df, "gujr", ["gujr", "deva"]).orderBy("pos").collect()
    assert [r["number"] for r in out] == [157, 158, 159]
    assert out[1]["text"] == f"{shloka} ॥२॥" and {"recovered-number", "contains-quotation"} <= set(out[1]["flags"])
    assert out[2]["text"] == f"{shloka} ॥१॥ {shloka} ॥३॥ ॥९॥\nબીજો ॥" and "recovered-number" not in out[2]["flags"]


def test_page_specs_and_files(spark, tmp_path):
    df = spark.createDataFrame([("3, 1-2, 5-", 6), ("9-", 6), ("2-1", 6)], "spec string, n int")
    assert sorted(r["page"] for r in pages.pages_of_spec(df, "spec", "n").collect()) == [1, 2, 3, 5, 6]
    (tmp_path / "p1.json").write_text(json.dumps({"page": 1, "width_px": 2, "height_px": 3, "blocks": [{"id": "a", "text": "x", "tag": "t", "reading_order": 1, "bbox": [0, 0, 1, 1]}]}))
    (tmp_path / "p2.json").write_text("{broken")
    out = pages.read_page_blocks(spark, str(tmp_path))
    assert sorted((r["unreadable"], r["page"], r["block_id"]) for r in out.collect() if r["page"]) == [(False, 1, "a")]
    assert out.where("unreadable").count() == 1
    files = pages.read_documents(spark, str(tmp_path))
    recorded = files.select("file", F.when(F.col("file").endswith("p1.json"), F.col("sha256")).otherwise("x").alias("sha256"))
    assert sorted(r["state"] for r in pages.verify_documents(files, recorded).collect()) == ["changed", "ok"]
    assert pages.serialize_package({"b": 1, "a": "é"}) == '{\n\t"b": 1,\n\t"a": "é"\n}\n'.encode()


def test_streaming_rollup_equals_batch(spark, tmp_path):
    from folioforge.streaming.rollup import rollup

    e = spark.createDataFrame([("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:50:00", 2.0), ("b", "2024-01-01 01:10:00", 3.0)], "event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    e.write.parquet(str(tmp_path / "in"))
    q = rollup(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "1 hour").writeStream.outputMode("complete").format("memory").queryName("rolled").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r["event_type"], r["n"], r["total"]) for r in df.collect())
    assert key(spark.table("rolled")) == key(rollup(e, "1 hour"))


def test_refs_of_one_container_are_not_sorted_in_one_task(spark):
    refs = spark.range(0, 20000, 1, 4).select(F.concat(F.lit("b/d"), (F.col("id") % 3).cast("string"), F.lit("#v"), F.col("id").cast("string")).alias("ref"))
    live = refs.where("ref LIKE '%7'").unionByName(spark.createDataFrame([("b/d0",), ("b/d1",)], "ref string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        out = versions.nearest_live_ancestor(refs, live)
        got = out.groupBy("ancestor").count().collect()
        out.write.format("noop").mode("overwrite").save()
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r["ancestor"], r["count"]) for r in got} == {("b/d0", 6667), ("b/d1", 6667), ("b", 6666)}
    assert "SortMergeJoin [prefix" not in plan


def test_rows_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 50)
    df = spark.range(1000)
    assert shared.dealt(df, 1000, "id").rdd.getNumPartitions() == 20 and shared.dealt(df, 60, "id").rdd.getNumPartitions() == 4

"""Text functions against slow folds and hand-written cases."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from folioforge.functions import refs as r
from folioforge.functions import scripts as s
from folioforge.functions import text as t
from folioforge.functions.normalize import normalize, normalize_one


def inside(c, *tables):
    return any(a <= ord(c) <= b for table in tables for a, b in table)


def random_texts(n, seed=5):
    rng = random.Random(seed)
    alphabet = [*"કખગરનકષ", "क", "र", "્", "्", "ા", "િ", "ુ", "઼", "ં", "‍", "‌", "અ", "૧", "।", " ", "\n", "a"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def column(spark, texts):
    return spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")


def values(df, col):
    return [row[0] for row in df.orderBy("i").select(col).collect()]


def slow_orthography(text):
    counts = [0, 0, 0, 0]
    for i, c in enumerate(text):
        before = text[i - 1] if i else ""
        base = text[i - 2] if i > 1 and inside(before, s.NUKTAS) else ("" if before and inside(before, s.NUKTAS) else before)
        if inside(c, s.VOWEL_SIGNS):
            if before and inside(before, s.VOWEL_SIGNS):
                counts[0] += 1
            elif not base or not (inside(base, s.CONSONANTS) or inside(base, s.VIRAMAS)):
                counts[1] += 1
        if inside(c, s.VIRAMAS):
            if i + 1 < len(text) and inside(text[i + 1], s.VOWEL_SIGNS):
                counts[2] += 1
            if not base or not inside(base, s.CONSONANTS):
                counts[3] += 1
    return counts


def test_orthography_agrees_with_a_fold(spark):
    texts = random_texts(600)
    o = t.orthography(F.col("x"), "gujr")
    got = values(column(spark, texts), F.array(o["adjacent_vowel_signs"], o["vowel_sign_without_base"], o["virama_before_vowel_sign"], o["virama_without_base"]))
    assert [list(g) for g in got] == [slow_orthography(x) for x in texts]
    assert any(sum(g) for g in got)


def test_orthography_of_latin_and_of_a_long_text_without_the_early_sign(spark):
    df = column(spark, ["કા" * 200])
    assert values(df, t.orthography(F.col("x"), "latn")["violations"]) == [0]
    assert values(df, t.orthography(F.col("x"), "gujr")["no_pre_base_matra"]) == [1]


def test_aksharas_cover_the_text(spark):
    texts = random_texts(400)
    got = values(column(spark, texts), t.aksharas(F.col("x")))
    assert ["".join(g) for g in got] == texts
    assert all(u for g in got for u in g)
    assert values(column(spark, ["ક્ષત્રિય", "નમસ્તે", ""]), t.aksharas(F.col("x"))) == [["ક્ષ", "ત્રિ", "ય"], ["ન", "મ", "સ્તે"], []]


def test_aksharas_cut_and_slice(spark):
    df = column(spark, ["નમસ્તે જગત"])
    assert values(df, t.truncate_aksharas(F.col("x"), 3)) == ["નમસ્તે…"]
    assert values(df, t.truncate_aksharas(F.col("x"), 4)) == ["નમસ્તે…"]
    assert values(df, t.slice_aksharas(F.col("x"), -2)) == ["ગત"]
    assert values(df, t.first_akshara(F.col("x"))) == ["ન"]
    assert values(df, t.is_akshara_boundary(F.col("x"), F.lit(2))) == [True]
    assert values(df, t.is_akshara_boundary(F.col("x"), F.lit(3))) == [False]
    assert values(df, F.size(t.akshara_spans(F.col("x")))) == [7]


def test_numbers(spark):
    df = column(spark, ["૧૨", "१२", "12", "૧2", "", "99999999999999999999", "9007199254740991", "9007199254740992"])
    assert values(df, t.parse_number(F.col("x"))["value"]) == [12, 12, 12, None, None, None, 9007199254740991, None]
    assert values(column(spark, ["402"]), t.format_number(F.col("x").cast("int"), "deva")) == ["४०२"]


def test_lines_and_characters(spark):
    df = column(spark, ["a-\nb c\nd\n\n e", " x  \ty \u0007z"])
    assert values(df, t.join_lines(F.col("x"))) == ["ab c d\ne", "x  \ty \u0007z"]
    assert values(df, t.clean_characters(F.col("x"))["text"])[1] == "x y z"


def test_danda_and_words(spark):
    assert values(column(spark, ["ક ॥ ૧ ॥ ૨ a b"]), t.protect_danda(F.col("x"))) == ["ક\u00a0॥\u00a0૧\u00a0॥ ૨ a b"]
    texts = ["the cat and the dog in the old house", "xq zv wk pl mn bv cx zz", "the and"]
    assert values(column(spark, texts), t.english_word_rate(F.col("x"))) == [5 / 9, 0.0, 0.0]
    assert values(column(spark, ["ABCDEF+Shree", "Shree"]), t.strip_subset_prefix(F.col("x"))) == ["Shree", "Shree"]
    assert values(column(spark, ["૧૨. note", "note", "3) x"]), t.note_marker(F.col("x"))) == [12, None, 3]


def test_trims_and_summaries(spark):
    df = column(spark, [" \u00a0\n a b \u2003\n", "", "\n ", "x"])
    assert values(df, t.trim_start(F.col("x"))) == ["a b \u2003\n", "", "", "x"]
    assert values(df, t.trim_end(F.col("x"))) == [" \u00a0\n a b", "", "", "x"]
    texts = ["કર્મ યોગ", "abc", ""]
    df = column(spark, texts)
    assert values(df, t.akshara_summary(F.col("x"), 3)["aksharas"]) == values(df, t.count_aksharas(F.col("x")))
    assert values(df, t.akshara_summary(F.col("x"), 3)["preview"]) == values(df, t.truncate_aksharas(F.col("x"), 3))


def test_values(spark):
    from folioforge.functions import values as v

    n = spark.createDataFrame([(0, 500), (1, 1536), (2, 5_400_000)], "i int, n long")
    assert values(n, v.format_bytes(F.col("n"))) == ["500 B", "2 KB", "5.1 MB"]
    assert values(n.limit(1), v.page_file_name(F.lit(7), F.lit(442))) == ["page-0007.png"] and values(n.limit(1), v.page_file_name(F.lit(12345), F.lit(99))) == ["page-12345.png"]
    hashes = column(spark, ["cbf29ce484222325", "ffffffffffffffff", "0000000000000007"])
    assert values(hashes, v.colourway(F.col("x"), 11)) == [int(x, 16) % 11 for x in ("cbf29ce484222325", "ffffffffffffffff", "7")]
    files = spark.createDataFrame([(1, "a/b/c.pdf"), (1, "a/b/d/e.pdf"), (2, "x.pdf"), (3, "q/r.pdf"), (4, "a/x/1"), (4, "b/x/1")], "g int, f string")
    assert {r["g"]: r["root"] for r in v.common_root(files, ["g"], "f").collect()} == {1: "a/b", 2: "", 3: "q", 4: ""}


def test_normalize_reports_repairs(spark):
    out = normalize_one("આવરણ૧ છે.૨ ॥૬૧॥ વર્-\nતે", "gujr")
    assert out["text"] == "આવરણ છે. ॥૬૧॥ વર્તે"
    assert [x["kind"] for x in out["repairs"]] == ["footnote-marker", "footnote-marker", "hyphen-join"]
    assert out["footnote_markers"] == [1, 2]
    assert normalize_one("િક", "gujr")["text"] == "કિ"
    df = column(spark, ["િક", None])
    assert values(df, normalize(F.col("x"), "gujr")["text"]) == ["કિ", None]


def test_reorder_agrees_with_normalize(spark):
    texts = [unicodedata.normalize("NFC", x.replace("૧", "").replace("\n", "").replace(" ", "")) for x in random_texts(300)]
    assert values(column(spark, texts), t.reorder_matras(F.col("x"), "gujr")) == [normalize_one(x, "gujr", footnotes=False)["text"] for x in texts]


def test_fnv_known_answers(spark):
    assert values(column(spark, ["", "a", "foobar"]), r.fnv1a64(F.col("x"))) == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]


def test_refs_and_versions(spark):
    df = column(spark, ["b/c#v1", "b", "B", "b##", "b/c/d"])
    assert values(df, r.is_ref(F.col("x"))) == [True, True, False, False, True]
    assert values(df, r.parent_ref(F.col("x")))[0] == "b/c" and values(df, r.parent_ref(F.col("x")))[4] == "b/c"
    assert values(df, r.ref_contains(F.lit("b/c"), F.col("x"))) == [True, False, False, False, True]
    bumps = spark.createDataFrame([(0, "1.9.0", "1.10.0"), (1, "1.0.0", "2.0.0"), (2, "1.0.0", "1.0.0"), (3, "x", "1.0.0"), (4, "1.0.0", "1.0.1")], "i int, a string, b string")
    assert values(bumps, r.bump_between(F.col("a"), F.col("b"))) == ["minor", "major", None, None, "patch"]


def test_hashes_of_many_and_of_long_texts(spark):
    def fnv(text):
        h = r.FNV_OFFSET
        for b in text.encode():
            h = (h ^ b) * r.FNV_PRIME % 2**64
        return f"{h:016x}"

    texts = ["પાઠ" * k for k in range(40)] + ["x" * 2_000_000, "", None] + [f"passage {k}" for k in range(500)]
    out = column(spark, texts).select("x", r.fnv1a64(F.col("x")).alias("h"))
    assert all(row["h"] == (None if row["x"] is None else fnv(row["x"])) for row in out.collect())
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()  # no fold by an expression, byte by byte


def test_letters_of_classes_stand_for_their_characters(spark):
    rng = random.Random(7)
    few = "કખ\u0abc\u0acd\u0abe\u0abf\u0ac0\u093e\u094dकa.svcnmjz\u200c\u200d\n 𝒳"
    texts = ["", *("".join(rng.choice(few) for _ in range(rng.randint(1, 60))) for _ in range(300)), *("".join(rng.choice(few[:8] + "\u200c\u200d") for _ in range(rng.randint(1, 40))) for _ in range(300)), None]
    df = column(spark, texts)
    assert values(df, t.akshara_summary(F.col("x"), 5)["aksharas"]) == values(df, t.count_aksharas(F.col("x")))
    assert values(df, t.akshara_summary(F.col("x"), 5)["preview"]) == values(df, t.truncate_aksharas(F.col("x"), 5))
    o = t.orthography(F.col("x"), "gujr")
    got = values(df, F.struct(o["adjacent_vowel_signs"], o["vowel_sign_without_base"], o["virama_before_vowel_sign"], o["virama_without_base"], o["examined"]))
    assert [list(g) for g in got[:-1]] == [by_classes(x) for x in texts[:-1]] and list(got[-1]) == [None] * 5


def by_classes(text):
    S, V, C, N = (f"[{''.join(f'{chr(a)}-{chr(b)}' for a, b in table)}]" for table in (s.VOWEL_SIGNS, s.VIRAMAS, s.CONSONANTS, s.NUKTAS))
    patterns = (f"(?<={S}){S}", f"(?<!{S})(?<!{C})(?<!{C}{N})(?<!{V})(?<!{V}{N}){S}", f"{V}(?={S})", f"(?<!{C})(?<!{C}{N}){V}", f"{S}|{V}|{C}")
    return [len(re.findall(p, text)) for p in patterns]


def test_patterns_of_many_ranges_are_not_searched(spark):
    df = column(spark, ["x"])
    for c in (t.orthography(F.col("x"), "gujr"), t.akshara_summary(F.col("x"), 3)):
        assert "x{93E}" not in df.select(c)._jdf.queryExecution().executedPlan().toString()

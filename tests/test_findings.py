"""Findings of orthography with their places, and repairs with what stands around them: against one look at each character."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from folioforge.functions import findings
from folioforge.functions import normalize as nm
from folioforge.functions import scripts as s
from folioforge.functions import text as t
from folioforge.functions.normalize import normalize_one


def one_by_one(text, script):
    inside = lambda c, table: any(a <= ord(c) <= b for a, b in table)
    out, examined = [], 0
    for i, c in enumerate(text):
        sign, virama = inside(c, s.VOWEL_SIGNS), inside(c, s.VIRAMAS)
        examined += sign or virama or inside(c, s.CONSONANTS)
        j = i - 1
        if j >= 0 and inside(text[j], s.NUKTAS):
            j -= 1
        base = text[j] if j >= 0 else None
        bare = base is None or not inside(base, s.CONSONANTS)
        if sign and i and inside(text[i - 1], s.VOWEL_SIGNS):
            out.append(("adjacent-vowel-signs", i))
        elif sign and bare and (base is None or not inside(base, s.VIRAMAS)):
            out.append(("vowel-sign-without-base", i))
        if virama and bare:
            out.append(("virama-without-base", i))
        if virama and i + 1 < len(text) and inside(text[i + 1], s.VOWEL_SIGNS):
            out.append(("virama-before-vowel-sign", i))
    count = len(out)
    shown = [(k, at, text[max(0, at - 6) : at + 6]) for k, at in out[:12]]
    if examined >= 300 and chr(s.PRE_BASE_MATRA[script]) not in text:
        count += 1
        shown.insert(0, ("no-pre-base-matra", -1, f"{examined} letters without a single {chr(s.PRE_BASE_MATRA[script])}"))
    return count == 0, shown, count, examined


LETTERS = "કખગનમાિીુૂેો઼્ंािी़्कखन aA1.\n🙂"


def some(rng, n, letters=LETTERS):
    return "".join(rng.choice(letters) for _ in range(n))


def test_findings_equal_a_look_at_each_character(spark, monkeypatch):
    rng = random.Random(3)
    texts = ["", None, "ક", "ા", "્", "ક્", "ક઼ા", "઼ા", "નનરાુંતે", "નિરાંતે", some(rng, 900, "કખગનમા્ "), "plain latin", *(some(rng, rng.randint(1, 40)) for _ in range(300)), some(rng, 3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, x string").repartition(3)
    for script in ("gujr", "deva"):
        out = {r["k"]: r for r in df.select("k", findings.orthography_findings(F.col("x"), script).alias("o"), t.orthography(F.col("x"), script).alias("c")).collect()}
        assert out[1]["o"] is None or out[1]["o"]["ok"] is None
        for k, text in enumerate(texts):
            if text is not None:
                o = out[k]["o"]
                assert (o["ok"], [tuple(v) for v in o["violations"]], o["count"], o["examined"]) == one_by_one(text, script), text
                assert (o["count"], o["examined"]) == (out[k]["c"]["violations"], out[k]["c"]["examined"])
                assert abs(o["rate"] - out[k]["c"]["rate"]) < 1e-9
    assert findings.find(["કાિ"], "latn")[0]["ok"]
    whole = findings.find([x or "" for x in texts], "gujr")
    assert [findings.find([x or ""], "gujr")[0] for x in texts] == whole


def test_findings_are_told_in_a_line(spark):
    df = spark.createDataFrame([("કાિ",), ("ા",), ("્",), ("ક્ા",)], "x string").select("x", F.explode(findings.orthography_findings(F.col("x"), "gujr")["violations"]).alias("v"))
    lines = {r["x"]: r["l"] for r in df.select("x", findings.describe(F.col("v.kind"), F.col("v.sample")).alias("l")).collect()}
    assert lines == {
        "કાિ": "two vowel signs in a row (…કાિ…)", "ા": "a vowel sign with no consonant to attach to (…ા…)", "્": "a virama with no consonant before it (…્…)", "ક્ા": "a virama followed by a vowel instead of a consonant (…ક્ા…)",
    }


def test_repairs_say_what_stands_around_them():
    out = normalize_one("એક લાંબો શબ્દ આવરણ૧ પછી બીજું\nિક અને શબ્-\nદ", "gujr")
    assert [(r["kind"], r["before"], r["context"]) for r in out["repairs"]] == [("footnote-marker", "૧", "બ્દ આવરણ૧ પછી બી"[-16:]), ("pre-base-matra-order", "િક", "છી બીજું િક અને શ"[-16:]), ("hyphen-join", "-", "")]
    assert out["text"] == "એક લાંબો શબ્દ આવરણ પછી બીજું કિ અને શબ્દ"
    for r in out["repairs"]:
        if r["after"]:
            assert out["text"][r["at"] : r["at"] + len(r["after"])] == r["after"]
    # Hyphens that follow each other, and lines of nothing else.
    for text in ("a-\n-\nb", "-\n-\n-", "x\n-\ny", "a--\nb", "­\na"):
        joined = normalize_one(text, "gujr")
        assert joined["text"] == reference_join(text)


def test_repairs_are_held_in_pieces(spark, monkeypatch):
    texts = [None, "", *("િક શબ્-\nદ આવરણ૧ " * n for n in (1, 9, 50, 3)), None]
    monkeypatch.setattr(nm, "AT_ONCE", 100)
    pieces = list(nm._pieces(pa.array(texts, pa.string()), "gujr", True, True))
    assert [len(x) for x in pieces] == [4, 1, 2]
    want = [nm.normalize_one(x, "gujr") if x is not None else dict.fromkeys(nm._ARROW.names) for x in texts]
    assert [x for p in pieces for x in p.to_pylist()] == want
    out = spark.createDataFrame(list(enumerate(texts)), "k int, x string").select("k", nm.normalize(F.col("x"), "gujr").alias("n")).orderBy("k").collect()
    assert [r["n"].asDict(True) for r in out] == want


def reference_join(text):
    """Lines put together character by character."""
    out = ""
    for i, line in enumerate(x.strip() for x in text.split("\n")):
        if not i:
            out = line
        elif out and out[-1] in "-­‐":
            out = out[:-1] + line
        else:
            out += " " + line
    return out.rstrip()

"""Text functions as Column expressions: scripts, syllables, orthography, cleaning, digits, words.

All run inside the JVM. Offsets and lengths are code points. A null text gives null unless said otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scripts as s

#: Fixed value: common English words.
ENGLISH_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "it", "that", "was", "for", "on", "are", "with", "as", "at", "be", "this", "have", "from", "or", "by",
    "one", "had", "not", "but", "what", "all", "were", "we", "when", "your", "can", "said", "there", "use", "an", "each", "which", "she", "do", "how",
    "their", "if", "will", "up", "other", "about", "out", "many", "then", "them", "these", "so", "some", "her", "would", "make", "like", "him",
    "into", "time", "has", "look", "two", "more", "write", "see", "no", "way", "could", "people", "my", "than", "been", "who", "its", "now", "did",
    "get", "come", "made", "may", "part", "over", "new", "also",
)


def count(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern)).cast("long")


def count_class(col: Column, char_class: str, runs: bool = True) -> Column:
    """Characters of a class: what is missing when their runs (or each, for a pattern of one character) are taken out, which makes no array of matches."""
    return (F.length(col) - F.length(F.regexp_replace(col, f"{char_class}+" if runs else char_class, ""))).cast("long")


def lettered(col: Column, classes: dict[str, tuple[tuple[int, int], ...]]) -> Column:
    """The text with each character of a class as the class's letter; such letters in the text become full stops.

    Expressions over single letters cost a fraction of those over classes of many ranges.
    """
    points = {c: "." for c in classes} | {chr(p): c for c, table in classes.items() for a, b in table for p in range(a, b + 1)}
    return F.translate(col, "".join(points), "".join(points.values()))


def script_profile(col: Column) -> Column:
    """Letters by script (gujr, deva, latn, other), their total, the dominant script and its share of the total."""
    # Latin letters go first, then what is neutral: the other classes are counted in the little that is left of most texts.
    without = lambda x, c: F.regexp_replace(x, f"{c}+", "")
    first = F.array(F.struct(F.length(col).cast("long").alias("n"), without(col, s.SCRIPT_CLASS["latn"]).alias("a")))
    second = F.transform(first, lambda x: F.struct((x["n"] - F.length(x["a"])).alias("latn"), without(x["a"], s.cls(s.NEUTRAL)).alias("b")))
    others = [k for k in s.SCRIPT_CLASS if k != "latn"]
    counts = F.transform(second, lambda x: F.struct(x["latn"].alias("latn"), (x["latn"] + F.length(x["b"])).alias("total"), *(count_class(x["b"], s.SCRIPT_CLASS[k]).alias(k) for k in others)))

    def profile(c: Column) -> Column:
        n = {k: c[k] for k in s.SCRIPT_CLASS}
        n["other"] = c["total"] - c["gujr"] - c["deva"] - c["latn"]
        most = F.greatest(*n.values())
        dominant = F.when(c["total"] == 0, F.lit(None).cast("string"))
        for k in s.PREFERENCE:
            dominant = dominant.when(n[k] == most, F.lit(k))
        share = F.when(c["total"] == 0, F.lit(0.0)).otherwise(most.cast("double") / c["total"])
        return F.struct(*(n[k].alias(k) for k in ("gujr", "deva", "latn", "other")), c["total"].alias("total"), dominant.alias("dominant"), share.alias("share"))

    return F.transform(counts, profile)[0]  # each class is counted once


def script_share(col: Column, script: str) -> Column:
    """The share of a text's letters that are of one script."""
    p = script_profile(col)
    return F.when(p["total"] == 0, F.lit(0.0)).otherwise(p[script].cast("double") / p["total"])


#: Marks, viramas, consonants, joiners and non-joiners as letters, and ``scripts.AKSHARA`` over these.
AKSHARA_CLASSES = {"m": s.MARKS, "v": s.VIRAMAS, "c": s.CONSONANTS, "j": ((0x200D, 0x200D),), "z": ((0x200C, 0x200C),)}
LETTERED_AKSHARA = "(?s)(?:[mjz]++|[^mvjz]|(?=v))[mj]*+(?:vj*+c[mj]*+)*+(?:z|vj*+z?)?+"


def aksharas(col: Column) -> Column:
    """The orthographic syllables of a text, in order; together they are the text."""
    return F.filter(F.regexp_extract_all(col, F.lit(s.AKSHARA), F.lit(0)), lambda x: x != "")


def count_aksharas(col: Column) -> Column:
    return F.size(aksharas(col)).cast("long")


def first_akshara(col: Column) -> Column:
    """The first syllable (null for an empty text)."""
    return F.try_element_at(aksharas(col), F.lit(1))


def akshara_spans(col: Column) -> Column:
    """(start, end) of each syllable in code points."""
    lengths = F.transform(aksharas(col), lambda x: F.length(x))
    ends = F.aggregate(
        lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
    )
    return F.transform(F.sequence(F.lit(1), F.size(ends) - 1), lambda i: F.struct(ends[i - 1].alias("start"), ends[i].alias("end")))


def akshara_summary(col: Column, limit: int, ellipsis: str = "…") -> Column:
    """(aksharas, preview): the number of syllables and the text cut to ``limit`` of them; they are found once."""

    def both(c: Column) -> Column:
        # Syllables stand side by side, so the first ones are a prefix.
        n = F.length(F.regexp_replace(c["letters"], LETTERED_AKSHARA, "."))
        first = F.length(F.regexp_extract(c["letters"], f"^(?:{LETTERED_AKSHARA}){{0,{limit}}}+", 0))
        cut = F.concat(F.rtrim(F.left(c["text"], first)), F.lit(ellipsis))
        return F.struct(n.cast("long").alias("aksharas"), F.when(n <= limit, c["text"]).otherwise(cut).alias("preview"))

    return F.transform(F.array(F.struct(col.alias("text"), lettered(col, AKSHARA_CLASSES).alias("letters"))), both)[0]


def is_akshara_boundary(col: Column, offset: Column) -> Column:
    """Whether a text may be cut at an offset without cutting a syllable."""
    lengths = F.transform(aksharas(col), lambda x: F.length(x))
    ends = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    return F.array_contains(ends, offset.cast("int"))


def slice_aksharas(col: Column, start: int, end: int | None = None) -> Column:
    """Syllables start to end (exclusive), counted from the end where negative, joined."""
    units = aksharas(col)
    n = F.size(units)

    def place(k: int) -> Column:
        return F.greatest(F.lit(0), n + k) if k < 0 else F.least(n, F.lit(k))

    a, b = place(start), n if end is None else place(end)
    return F.array_join(F.slice(units, a + 1, F.greatest(F.lit(0), b - a)), "")


def truncate_aksharas(col: Column, limit: int, ellipsis: str = "…") -> Column:
    """At most ``limit`` syllables; a cut text loses its trailing space and gets the ellipsis."""
    units = aksharas(col)
    return F.when(F.size(units) <= limit, col).otherwise(F.concat(F.rtrim(F.array_join(F.slice(units, 1, limit), "")), F.lit(ellipsis)))


def orthography(col: Column, script: str) -> Column:
    """Impossible letter sequences of an Indic text by kind, their count, the letters examined and the rate in a thousand.

    A text in Latin script has none by definition.
    """
    if script == "latn":
        zero = F.lit(0).cast("long")
        names = ("adjacent_vowel_signs", "vowel_sign_without_base", "virama_before_vowel_sign", "virama_without_base", "no_pre_base_matra", "violations", "examined")
        return F.struct(*(zero.alias(n) for n in names), F.lit(0.0).alias("rate"))
    letters = lettered(col, {"s": s.VOWEL_SIGNS, "v": s.VIRAMAS, "c": s.CONSONANTS, "n": s.NUKTAS})
    single = F.struct(letters.alias("all"), F.regexp_replace(letters, "s+", "s").alias("single"), F.contains(col, F.lit(chr(s.PRE_BASE_MATRA[script]))).alias("has_matra"))
    kinds = ("adjacent_vowel_signs", "vowel_sign_without_base", "virama_before_vowel_sign", "virama_without_base")

    def count_of(c: Column) -> Column:
        def n(of: str) -> Column:
            return ((F.octet_length(c["single"]) - F.octet_length(F.replace(c["single"], F.lit(of), F.lit("")))) / len(of)).cast("long")

        more = (F.octet_length(c["all"]) - F.octet_length(c["single"])).cast("long")
        found = F.struct(more.alias("more"), *(n(of).alias(of) for of in ("s", "v", "c", "cs", "vs", "cns", "vns", "cv", "cnv")), c["has_matra"].alias("has_matra"))
        # Every sign that opens a run, and every virama, has its base or has none.
        return F.transform(F.array(found), lambda k: F.struct(
            k["more"].alias(kinds[0]), (k["s"] - k["cs"] - k["vs"] - k["cns"] - k["vns"]).alias(kinds[1]), k["vs"].alias(kinds[2]), (k["v"] - k["cv"] - k["cnv"]).alias(kinds[3]),
            (k["s"] + k["more"] + k["v"] + k["c"]).alias("examined"), k["has_matra"].alias("has_matra"),
        ))[0]

    def report(c: Column) -> Column:
        lost = ((c["examined"] >= 300) & ~c["has_matra"]).cast("long")
        total = reduce(lambda a, b: a + b, (c[k] for k in kinds)) + lost
        rate = F.when(c["examined"] == 0, F.lit(0.0)).otherwise(total * F.lit(1000.0) / c["examined"])
        return F.struct(*(c[k].alias(k) for k in kinds), lost.alias("no_pre_base_matra"), total.alias("violations"), c["examined"].alias("examined"), rate.alias("rate"))

    return F.transform(F.transform(F.array(single), count_of), report)[0]  # each pattern is counted once


def reorder_matras(col: Column, script: str) -> Column:
    """Puts a pre-base vowel sign that was stored before its syllable behind it."""
    C, N, V = s.C, s.N, s.V
    m = f"\\x{{{s.PRE_BASE_MATRA[script]:X}}}"
    return F.regexp_replace(col, f"(?<!{C})(?<!{C}{N}){m}({C}{N}?(?:{V}{C}{N}?)*)", f"$1{chr(s.PRE_BASE_MATRA[script])}")


def footnote_pattern(script: str) -> str:
    """One or two digits of the script welded to a letter of it, or to a full stop after one."""
    zero = s.DIGIT_ZERO[script]
    digit = f"[\\x{{{zero:X}}}-\\x{{{zero + 9:X}}}]"
    letter = f"(?:(?!{s.ANY_DIGIT}){s.SCRIPT_CLASS[script]})"
    return f"(?:(?<={letter})|(?<={s.SCRIPT_CLASS[script]}\\.))(?<!{s.ANY_DIGIT}){digit}{s.ANY_DIGIT}?(?!{s.ANY_DIGIT})"


def strip_footnotes(col: Column, script: str) -> Column:
    """The text without footnote digits, and the digits."""
    pattern = footnote_pattern(script)
    return F.struct(F.regexp_replace(col, pattern, "").alias("text"), F.regexp_extract_all(col, F.lit(pattern), F.lit(0)).alias("markers"))


CONTROLS = "[\\x{0}-\\x{9}\\x{B}-\\x{1F}\\x{7F}-\\x{9F}]"
BLANKS = "[ \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"


def clean_characters(col: Column) -> Column:
    """The text without control characters (line feeds stay), runs of blanks made one space and none at a line's ends; and how many went."""
    kept = F.regexp_replace(col, CONTROLS, "")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, f"{BLANKS}+", " "), " ?\n ?", "\n"), "^ | $", "")
    return F.struct(text.alias("text"), count(col, CONTROLS).alias("controls_removed"))


#: White space of any kind, line ends among it.
WHITE = f"[\\s{BLANKS[1:]}"


def trim_start(col: Column) -> Column:
    """The text without white space of any kind at its beginning."""
    return F.regexp_replace(col, f"^{WHITE}+", "")


def trim_end(col: Column) -> Column:
    """The text without white space of any kind at its end."""
    return F.regexp_replace(col, f"(?<!{WHITE}){WHITE}+\\z", "")


def join_lines(col: Column, join: bool = True) -> Column:
    """Printed lines as running text: paragraphs stay apart by a line feed, a hyphen at a line's end joins its word."""
    text = F.regexp_replace(F.regexp_replace(col, "^\\s+|\\s+$", ""), "\n\\s*\n\\s*", "\u0001")
    text = F.regexp_replace(F.regexp_replace(text, "[ \t]*\n[ \t]*", "\n"), "[ \t]*\u0001", "\u0001")
    if join:
        text = F.regexp_replace(F.regexp_replace(text, "[-­‐]\n", ""), "\n", " ")
    return F.regexp_replace(text, "\u0001", "\n")


def protect_danda(col: Column) -> Column:
    """No-break spaces inside each verse ending (danda, number, danda), so that no line begins with a part of it."""
    pattern = f" ?[।॥](?: ?{s.ANY_DIGIT}+)?(?: ?[।॥])?|[^ ।॥]+| "
    parts = F.regexp_extract_all(col, F.lit(pattern), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(F.regexp_like(x, F.lit("[।॥]")), F.replace(x, F.lit(" "), F.lit("\u00a0"))).otherwise(x)), "")


def convert_digits(col: Column, script: str) -> Column:
    """All digits of the known scripts as digits of one."""
    others = [k for k in s.DIGITS if k != script]
    return F.translate(col, "".join(s.DIGITS[k] for k in others), s.DIGITS[script] * len(others))


def parse_number(col: Column) -> Column:
    """A whole number in the digits of one script: its value and script; null for anything else or beyond 2**53 - 1."""
    value, script = F.lit(None).cast("long"), F.lit(None).cast("string")
    ascii_ = convert_digits(col, "latn")
    for k, digits in s.DIGITS.items():
        mine = F.regexp_like(col, F.lit(f"^[{digits[0]}-{digits[9]}]+$"))
        value = F.when(mine, ascii_.try_cast("long")).otherwise(value)
        script = F.when(mine, F.lit(k)).otherwise(script)
    ok = value.isNotNull() & (value <= (1 << 53) - 1)
    return F.when(ok, F.struct(value.alias("value"), script.alias("script")))


def format_number(col: Column, script: str) -> Column:
    """A whole number in the digits of a script."""
    return F.translate(col.cast("string"), s.DIGITS["latn"], s.DIGITS[script])


def english_word_rate(col: Column) -> Column:
    """The share of common English words among a text's words of a to z; 0 below eight words."""
    words = F.regexp_extract_all(F.lower(col), F.lit("[a-z]+"), F.lit(0))

    def rate(w: Column) -> Column:
        hits = F.size(F.filter(w, lambda x: x.isin(*ENGLISH_WORDS)))  # a hash set
        return F.when(F.size(w) < 8, F.lit(0.0)).otherwise(hits.cast("double") / F.size(w))

    return F.transform(F.array(words), rate)[0]  # the words are found once


def slugify(col: Column) -> Column:
    """Lower-case words of a to z and digits, joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def running_head_lines(col: Column, script: str) -> Column:
    """The lines of a header block without page numbers, as far as they are in the script."""
    lines = F.transform(F.split(col, "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, f"{s.ANY_DIGIT}+", " "), "\\s+", " ")))
    return F.filter(lines, lambda x: (x != "") & (script_profile(x)["dominant"] == script))


def strip_subset_prefix(col: Column) -> Column:
    """A font's name without the tag of its subset."""
    return F.regexp_replace(col, "^[A-Z]{6}\\+", "")


def note_marker(col: Column) -> Column:
    """The number that begins a footnote, before a full stop or a bracket."""
    digits = F.regexp_extract(col, f"^\\s*({s.ANY_DIGIT}{{1,9}})\\s*[.)]", 1)
    return F.when(digits != "", convert_digits(digits, "latn").cast("int"))

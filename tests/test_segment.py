"""Segmentation: the scan over chunks of pages against one pass over each book."""

import random
import re
from collections import Counter

import pytest

from folioforge.functions import scripts as s
from folioforge.operators import passage_scan as ps
from folioforge.operators import segment as seg

SHLOKA = "कर्मण्येवाधिकारस्ते मा फलेषु"
MARK = re.compile("(॥|।।)\\s*([0-9०-९૦-૯]+)\\s*(?:॥|।।)")


def own(n, script):
    return "".join(s.DIGITS[script][int(c)] for c in str(n))


def one_pass(blocks):
    """Passages as (section, pieces, number, recovered), and sections as (title, end), of one book's blocks in order."""
    passages, sections = [], []
    last, title, count = None, None, 0
    pieces = []

    def close(number=None, recovered=False):
        nonlocal pieces, last, count
        if pieces:
            passages.append((len(sections) + 1, pieces, number, recovered))
            pieces, count = [], count + 1
            last = last if number is None else number

    def end_section(marker):
        nonlocal title, count
        close()
        if count or title is not None or marker is not None:
            sections.append((title, marker))
        title, count = None, 0

    for page, pos, kind, text in blocks:
        if kind == "heading":
            end_section(None)
            title = text.strip()
        elif kind == "end":
            end_section(text.strip())
        else:
            begin, look, refused = 0, 0, -1
            while m := MARK.search(text, look):
                scripts = {k for k, d in s.DIGITS.items() if set(m[2]) & set(d)}
                value = int(m[2]) if len(scripts) == 1 and int(m[2]) < 2**53 else None
                good = scripts == {"gujr"} and value is not None
                again = not good and value is not None and refused >= 0 and text[refused : m.start()].strip() == "" and last is not None and value == last + 1
                if good or again:
                    if text[begin : m.start()].strip() or pieces:
                        pieces.append((page, pos, (text[begin : m.start()] + m[1]).strip()))
                    close(value, again)
                    refused, begin, look = -1, m.end(), m.end()
                else:
                    refused, look = m.end(), m.start() + 1
            if text[begin:].strip():
                pieces.append((page, pos, text[begin:].strip()))
    end_section(None)
    return passages, sections


def some_blocks(rng, pages):
    out = []
    for page in range(1, pages + 1):
        for pos in range(rng.randint(0, 3)):
            kind = rng.choices(["text", "heading", "end"], [12, 1, 1])[0]
            parts = []
            for _ in range(rng.randint(0, 5)):
                n, m = rng.randint(1, 5), rng.randint(1, 5)
                parts.append(
                    rng.choice([
                        "શબ્દ બીજો", SHLOKA, f"॥{own(n, 'gujr')}॥", f"॥{own(n, 'deva')}॥", f"॥{own(n, 'deva')}॥{own(m, 'deva')}॥", f"॥ {own(n, 'deva')} ॥ ॥{own(m, 'deva')}॥", f"।।{own(n, 'deva')}।।{own(m, 'latn')}॥{own(n, 'deva')}॥",
                        f"॥{own(n, 'gujr')}{own(m, 'deva')}॥{own(n, 'deva')}॥", "॥", " ", "\n", f"॥{'૯' * 20}॥{own(n, 'deva')}॥",
                    ])
                )
            out.append((page, pos, kind, "".join(parts)))
    return out


def test_functions_of_runs_compose():
    rng = random.Random(5)
    for _ in range(400):
        blocks = some_blocks(rng, 12)
        cut = rng.randint(0, len(blocks))
        first, second = ps.Function("gujr"), ps.Function("gujr")
        for block in blocks[:cut]:
            first.read(*block)
        for block in blocks[cut:]:
            second.read(*block)
        for start in (None, (0, 0, 0)):
            for number in (None, 1, 2, 3, 4, 77):
                state = ps.State(start, number)
                for page, pos, kind, text in blocks:
                    _, state = ps.read_block(page, pos, kind, text, state, "gujr", set())
                assert ps._from_rows(ps._to_rows(second))(first(ps.State(start, number))) == state


@pytest.mark.parametrize("pages", [1, 3, 64])
def test_chunks_equal_one_pass(spark, pages):
    rng = random.Random(8)
    books = {b: some_blocks(rng, 40) for b in ("a", "b", "c", "d")}
    books["e"] = [(1, 0, "text", f"આરંભ ॥{own(1, 'gujr')}॥"), *((p, 0, "text", SHLOKA) for p in range(2, 9)), (9, 0, "text", f"॥{own(1, 'deva')}॥{own(2, 'deva')}॥")]
    rows = [(b, *x) for b, blocks in books.items() for x in blocks]
    out = ps.scan(spark.createDataFrame(rows, "book string, page int, pos int, kind string, text string").repartition(5), "gujr", pages).collect()
    for b, blocks in books.items():
        passages, sections = one_pass(blocks)
        mine = sorted((r for r in out if r["book"] == b), key=lambda r: (r["page"], r["pos"], r["k"]))
        got = {}
        for r in mine:
            if r["kind"] == "text":
                got.setdefault((r["section"], tuple(r["start"])), []).append(r)
        got = [v for _, v in sorted(got.items(), key=lambda x: x[0][1])]
        assert [[(r["page"], r["pos"], r["text"]) for r in v] for v in got] == [p[1] for p in passages]
        assert [v[-1]["value"] for v in got] == [p[2] for p in passages] and [v[-1]["recovered"] for v in got] == [p[3] for p in passages]
        kept = {r["section"] for r in mine}
        assert [sorted(kept).index(v[0]["section"]) + 1 for v in got] == [p[0] for p in passages]
        assert len(kept) == len(sections)


def test_books_of_bounded_size_are_read_once_and_large_ones_in_chunks(spark, monkeypatch):
    rng = random.Random(21)
    rows = [(b, *x) for b in range(12) for x in some_blocks(rng, 30)]
    df = spark.createDataFrame(rows, "book int, page int, pos int, kind string, text string").repartition(3)
    once = sorted(map(str, ps.scan(df, "gujr", 2).collect()))
    assert len(once) > 100
    sizes = sorted(sum(len(x[4]) + ps.BLOCK for x in rows if x[0] == b) for b in range(12))
    for whole in (0, sizes[5]):  # all books in chunks; half of them
        assert sorted(map(str, ps.scan(df, "gujr", 2, whole).collect())) == once


def test_sections_have_titles_ends_and_forms(spark):
    text = "પહેલો ફકરો જે પૂરતો લાંબો છે કે ટૂંકો ન ગણાય તેવો છે"
    b = [
        (1, 1, 0, "header", "૧ ગ્રંથ નામ"), (1, 1, 1, "header", "આરંભ"), (1, 1, 2, "paragraph", f"{text}-\nઅંત ॥૧॥"),
        (1, 2, 0, "header", "ગ્રંથ નામ ૨"), (1, 2, 1, "section-title", "પ્રથમ\nભાગ"), (1, 2, 2, "paragraph", f"{text} ॥૧॥"), (1, 2, 3, "section-title", SHLOKA), (1, 2, 4, "paragraph", "॥૨॥"),
        (1, 3, 0, "paragraph", "॥ પ્રથમ ભાગ સમાપ્ત ॥"), (1, 3, 1, "header", "ગ્રંથ નામ"), (1, 3, 2, "section-title", "ખાલી"), (1, 3, 3, "section-title", "બીજો ભાગ"), (1, 3, 4, "footnote", "૧. નોંધ"), (1, 3, 5, "paragraph", text),
        (2, 1, 0, "image", "x"), (3, 1, 0, "paragraph", "॥ ઇતિ ॥"),
    ]
    df = spark.createDataFrame(b, "book int, page int, pos int, tag string, text string")
    passages, sections = seg.segment_book(df, "gujr", ["gujr", "deva"])
    got = [(r["book"], r["section"], r["title"], r["title_source"], r["end_marker"], r["passages"]) for r in sections.orderBy("book", "section").collect()]
    assert got == [
        (1, 1, "આરંભ", "running-head", None, 1), (1, 2, "પ્રથમ ભાગ", "heading", "॥ પ્રથમ ભાગ સમાપ્ત ॥", 2), (1, 3, "ખાલી", "heading", None, 0), (1, 4, "બીજો ભાગ", "heading", None, 1),
        (3, 1, None, None, "॥ ઇતિ ॥", 0),
    ]
    out = passages.orderBy("pos").collect()
    assert [(r["section"], r["number"], r["form"]) for r in out] == [(1, 1, "prose"), (2, 1, "prose"), (2, 2, "prose"), (4, None, "prose")]
    assert "hyphen-join" in out[0]["flags"] and "-" not in out[0]["text"] and "\n" not in out[0]["text"]
    assert out[2]["text"] == f"{SHLOKA}\n॥" and "contains-quotation" in out[2]["flags"]
    verse = seg.segment(df, "gujr", ["gujr", "deva"], "verse").orderBy("pos").first()
    assert verse["form"] == "verse" and "\n" in verse["text"] and "hyphen-join" not in verse["flags"]
    none, empty = seg.segment_book(df.limit(0), "gujr", ["gujr", "deva"])
    assert none.count() == empty.count() == 0


def test_numbers_begin_anew_with_a_division(spark):
    text = "એક ફકરો જે પૂરતો લાંબો છે કે ટૂંકો ન ગણાય તેવો જ છે"
    b = [(1, p, 0, "paragraph", f"{text} ॥{own(n, 'gujr')}॥") for p, n in ((1, 1), (2, 2), (4, 1), (5, 2), (6, 2), (7, 9))] + [(1, 3, 0, "section-title", "ભાગ")]
    out = seg.segment(spark.createDataFrame(b, "book int, page int, pos int, tag string, text string"), "gujr", ["gujr"]).orderBy("pos").collect()
    flagged = Counter(f for r in out for f in r["flags"] if "number" in f or "sequence" in f)
    assert flagged == {"duplicate-number": 1, "out-of-sequence": 2} and [len(r["flags"]) for r in out[:4]] == [0, 0, 0, 0]

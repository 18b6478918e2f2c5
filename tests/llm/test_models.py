"""Toxicity, page extraction and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import extraction, toxicity
from folioforge.llm.html_blocks import blocks

from .fixtures import make


def corpus(seed=5, n=400):
    rng = random.Random(seed)
    syllables = ["ther", "an", "ing", "ou", "he", "st", "er", "ti", "on", "re"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    bad = ["grumbok", "wozzle", "fleeb"]
    rows, labels = [], []
    for k in range(n):
        text = [word() for _ in range(rng.randint(20, 80))]
        toxic = int(k % 5 == 0)
        if toxic:
            for _ in range(4):
                text[rng.randrange(len(text))] = rng.choice(bad)
        rows.append((k, " ".join(text)))
        labels.append((k, 1, toxic))
    return rows, labels


def test_toxicity_is_learnt_and_restored(spark):
    rows, labels = corpus()
    plain = " ".join(w for _, t in rows[1:5] for w in t.split())
    tricks = [(1001, "gr0mb0k " + plain), (1002, "g r u m b o k and w0zzl3 and fleeeeb and gruuumbok " + plain), (1003, plain), (1004, None), (1005, ""), (None, plain)]
    docs = make(spark, rows + tricks)
    out = {r["doc_id"]: r for r in toxicity.scores(docs, spark.createDataFrame(labels + labels[:3] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")).collect()}
    held = [(out[d]["predicted"], y) for d, _, y in labels if out[d]["held_out"]]
    assert len(held) > 80 and np.mean([p == y for p, y in held]) >= 0.97
    assert out[1002]["predicted"] == 1 and out[1003]["predicted"] == out[1004]["predicted"] == out[1005]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_restoration():
    counts = np.zeros(64**3)
    text = "  " + "  ".join(["idiot", "stupid", "the", "loser", "and", "only", "from"] * 50) + "  "
    s = toxicity.SYMBOL_OF[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")].astype(int)
    np.add.at(counts, (s[:-2] << 12) | (s[1:-1] << 6) | s[2:], 1)
    model = toxicity.CharacterModel(counts)
    assert [model.restore(x) for x in ("1d10t", "$tup1d", "st.u.p.i.d", "idiiiooot", "i d i o t", "the", "l0ser")] == ["idiot", "stupid", "stupid", "idiot", "idiot", "the", "loser"]


def test_long_runs_and_tokens_are_read_to_their_end():
    counts = np.zeros(64**3)
    text = "  " + "  ".join(["idiot", "stupid", "the", "loser", "and", "only", "from"] * 50) + "  "
    s = toxicity.SYMBOL_OF[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")].astype(int)
    np.add.at(counts, (s[:-2] << 12) | (s[1:-1] << 6) | s[2:], 1)
    reader = toxicity.Reader(toxicity.CharacterModel(counts))
    words = ["the", "only", "from"] * 20 + ["stupid"]
    spaced = "  ".join(" ".join(w) for w in words)
    assert "stupid" in reader.spaced(spaced, set(spaced.split()))
    for mark in ".-_":
        assert "stupid" in "".join(reader.words((mark * 2).join(mark.join(w) for w in words)))
    scorer = toxicity.Scorer(reader, {"stupid": 2.0}, np.zeros(7), np.ones(7), np.zeros(7), 0.0)
    assert scorer.summary("only," * 60 + "stupid")[5] == 2.0
    letters = "l.o.s.e.r." * 2000
    assert "".join(reader.model.restore(letters).split()) == "loser" * 2000


def brute_restore(model, token):
    """The likeliest readings of a token by enumeration of all ways through its lattice."""
    best = {}

    def walk(i, text, cost):
        if i == len(token):
            a = b = 0
            total = cost
            for ch in [*text, None]:
                s = 0 if ch is None else int(toxicity.SYMBOL_OF[ord(ch)])
                total -= model.logp[(a << 12) | (b << 6) | s]
                a, b = b, s
            best[text] = min(total, best.get(text, total))
            return
        run = 1
        while i + run < len(token) and token[i + run] == token[i]:
            run += 1
        for step, out, extra in model._edges(token[i], run):
            walk(i + step, text + out, cost + extra)

    walk(0, "", 0.0)
    return best


def test_restoration_is_the_best_path_of_the_lattice():
    rng = random.Random(3)
    counts = np.zeros(64**3)
    text = "  " + "  ".join(["idiot", "stupid", "the", "loser", "toil"] * 30) + "  "
    s = toxicity.SYMBOL_OF[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")].astype(int)
    np.add.at(counts, (s[:-2] << 12) | (s[1:-1] << 6) | s[2:], 1)
    model = toxicity.CharacterModel(counts)
    for _ in range(300):
        token = "".join(rng.choice("ia1!dosst$.- 0t") for _ in range(rng.randint(1, 7)))
        best = brute_restore(model, token)
        least = min(best.values())
        got = model.restore(token)
        assert best[got] == pytest.approx(least, abs=1e-9), token


def test_rows_of_one_id_and_clashing_columns_are_scored_each(spark):
    rows, labels = corpus(n=200)
    docs = make(spark, [*rows, (1, rows[1][1]), (1, f"grumbok wozzle fleeb {rows[1][1]}"), (None, None)]).withColumn("score", F.lit(3)).withColumn("toxic", F.lit("x"))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.scores(docs, known).where("doc_id = 1").collect()
    assert len(out) == 3 and len({r["score"] for r in out}) == 2
    kept = toxicity.drop_toxic(docs, known)
    assert kept.columns == docs.columns and sorted(r["text"] == rows[1][1] for r in kept.where("doc_id = 1").collect()) == [True, True]


def test_toxicity_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.scores(make(spark, [(1, "x")]), none).collect()] == [0.0]
    assert toxicity.scores(make(spark, []), none).count() == 0
    kept = toxicity.drop_toxic(make(spark, [(1, "x"), (2, None)]), none)
    assert kept.count() == 2 and kept.columns == make(spark, []).columns


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script><style>p{}</style></head><body>
<div class="cookie-notice"><p>We use cookies on this page.</p></div><nav><ul><li><a href="/">Home</a></li><li><a href="/b">About us</a></li></ul></nav>
<header class="site-header"><p>The site of everything</p></header>
<article><h1>A title &amp; more</h1><p><b>First words.<br><p>Second   paragraph with <a href="x">a link</a>
and more text in it.</p><div class="ad"><p>Buy this now, it is very cheap today.</p></div><ul><li>One thing to know</li><li>Another thing to know</li></ul>
<form action="/"><label>Your mail</label><button>Send</button></form><p>The last &lt;paragraph&gt; of the text.</p></article>
<section class="comments"><div class="comment"><p>I liked this article very much, thank you.</p></div></section>
<aside><p>Related: another article that you may like.</p></aside><footer>&copy; 2024 Somebody</footer>"""


def test_main_text(spark):
    want = "A title & more\n\nFirst words.\n\nSecond paragraph with a link and more text in it.\n\nOne thing to know\n\nAnother thing to know\n\nThe last <paragraph> of the text."
    plain = PAGE.replace("<article>", '<div class="post-content">').replace("</article>", "</div>")
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", plain, "x"), (5, "u", "<p>broken < a <b", "x"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    out = [(r["page_id"], r["text"], r["n_chars"]) for r in extraction.extract(df).orderBy("page_id").collect()]
    assert [o for o in out if o[0] in (1, 4)] == [(1, want, len(want))] * 2 + [(4, want, len(want))]
    assert [o[1] for o in out if o[0] in (2, 3)] == ["", ""]
    assert extraction.extract(df.limit(0)).count() == 0


def leaf(page):
    return [(b.text, [e.tag for e in (b.inside.path() if b.inside else [])]) for b in blocks(page)]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p title=it's>Hello world</p>x", [("Hello world", ["p"]), ("x", [])]),
        ('<a b="c>d">e</a> <i x=a"b>f</i>', [("e f", [])]),
        ("x<math><mi>y</mi></math>z", [("xyz", [])]),
        ("<p>a<svg><title>t</title><text>in</text></svg> b<noscript>n</noscript>", [("ain b", ["p"])]),
        ("<p>k<select><option>o</select>l<textarea>m</textarea></p>", [("kl", ["p"])]),
        ("<select><p>never closed", [("never closed", ["p"])]),
        ("a < b <3 &amp; c</>d</ e>f<!-->g<!-- h --!>i-->j<?k>l<!m>n", [("a < b <3 & cdfgjln", [])]),
        ("<script>x<p>y", []),
        ("<style>a</style >b<script>c</SCRIPT\n>d", [("bd", [])]),
        ("<p>broken < a <b", [("broken < a", ["p"])]),
        ("<ul><li>a<li>b<ul><li>c</ul>d<li>e</ul>", [("a", ["ul", "li"]), ("b", ["ul", "li"]), ("c", ["ul", "li", "ul", "li"]), ("d", ["ul", "li"]), ("e", ["ul", "li"])]),
        ("<table><tr><td>1<td>2<tr><th>3</table>4", [("1", ["table", "tr", "td"]), ("2", ["table", "tr", "td"]), ("3", ["table", "tr", "th"]), ("4", [])]),
        ("<div><b>x</div>y</b>z", [("x", ["div"]), ("yz", [])]),
    ],
)
def test_markup_is_read_as_html_reads_it(page, want):
    assert leaf(page) == want


@pytest.mark.parametrize("piece", ['<a b="', "<a b='", "<", "<b>", "<div>x", "<select>", "</script", "<!--", "</i>", "<li>x", "<td>", "<p>", "<b><div>", "<a =", "&amp", "<b></i><div></p>"])
def test_long_pages_take_linear_time(piece):
    import time

    start = time.process_time()
    found = blocks(piece * 60_000)
    extraction.Field().unary(found)
    assert time.process_time() - start < 15


def test_long_pages_rows_of_one_id_and_clashing_columns(spark):
    body = "".join(f"<p>Sentence number {k} of the long article stands here, with words.</p>" for k in range(30_000))
    page = f"<nav><a href=x>Home</a></nav><article><h1>Title of it</h1>{body}</article><footer>&copy; x</footer>"
    df = spark.createDataFrame([(1, "u", page, "x", 1), (1, "v", PAGE, "x", 2), (1, "v", PAGE, "x", 2), (None, "w", "<article><p>One sentence of an article, with some words in it.</p></article>", None, None)], "page_id long, url string, html string, text string, n_chars int")
    out = sorted((r["url"], r["n_chars"]) for r in extraction.extract(df).collect())
    assert [u for u, _ in out] == ["u", "v", "v", "w"] and out[0][1] == len("Title of it") + sum(2 + len(f"Sentence number {k} of the long article stands here, with words.") for k in range(30_000))
    assert out[1] == out[2]


def test_field_on_pages_it_has_not_seen():
    field = extraction.Field()
    field.train([(blocks(h), [y for _, y in ls]) for h, ls in extraction.written_pages(150, seed=1)])
    right = total = 0
    for html, labels in extraction.written_pages(60, seed=2):
        page = blocks(html)
        assert [b.text for b in page] == [x for x, _ in labels]
        got = field.decode(page)
        right += sum(a == y for a, (_, y) in zip(got, labels))
        total += len(labels)
    assert right / total > 0.98


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(4)
    for n in (1, 2, 6):
        field = extraction.Field()
        field.step, field.first = rng.normal(size=(2, 2)), rng.normal(size=2)
        scores = rng.normal(size=n).tolist()
        field.unary = lambda page, scores=scores: scores
        labels = field.decode([None] * n)

        def value(ys):
            return field.first[ys[0]] + sum(s for s, y in zip(scores, ys) if y) + sum(field.step[a, b] for a, b in zip(ys, ys[1:]))

        assert value(labels) == pytest.approx(max(value([k >> i & 1 for i in range(n)]) for k in range(1 << n)))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline

    rows, labels = corpus()
    secret = "ordinary words then password: abcdefgh12345 and so on"
    rows += [(2000, rows[1][1]), (2001, "one two three four five six seven eight nine ten eleven twelve"), (2002, secret), (2003, None)]
    make(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "three four five six seven eight nine ten")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    toxic = {d for d, _, y in labels if y}
    assert len(seen[0] & toxic) <= 3 and len(seen[0] - toxic) >= len(rows) - len(toxic) - 3
    assert 2000 in seen[0] and 2000 not in seen[1]
    assert 2001 in seen[1] and 2001 not in seen[2]
    assert docs.where("doc_id = 2002").first()["text"] == "ordinary words then [SECRET] and so on"
    pieces = pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == seen[3]


def test_pages_without_containers_and_what_is_not_shown(spark):
    sentence = "This is a whole sentence of a page that has no container at all, and it says quite a lot."
    rows = [
        (1, f"<p>{sentence}</p>"),
        (2, f"<html><body><h1>A title of it</h1><p>{sentence}</p><p>{sentence} Again.</p></body></html>"),
        (3, f"<p>{sentence[:-1]} here.<noscript>Please enable JavaScript to view.</noscript></p>"),
        (4, f"<article><p>{sentence}</p><div hidden><p>Not shown, as it is hidden from all.</p></div><p style='color:red; display : none'>Nor this.</p><p>{sentence} End.<span hidden>x</span></p></article>"),
        (5, f"<body><nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li></ul></nav><p>{sentence}</p><p>{sentence} More.</p><footer>© somebody</footer></body>"),
        (6, f"<article><p>{sentence}</p><noscript><p>never closed</p></article>"),
        (7, f"<article hidden><p>{sentence}</p></article>"),
    ]
    df = spark.createDataFrame([(k, "u", h) for k, h in rows], "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in extraction.extract(df).collect()}
    assert out[1] == sentence
    assert out[2] in (f"A title of it\n\n{sentence}\n\n{sentence} Again.", f"{sentence}\n\n{sentence} Again.")
    assert out[3] == f"{sentence[:-1]} here."
    assert out[4] == f"{sentence}\n\n{sentence} End."
    assert out[5] == f"{sentence}\n\n{sentence} More."
    assert out[6].startswith(sentence) and out[7] == ""

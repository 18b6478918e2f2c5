"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is its sequence of leaf blocks; each is main text or not. The field scores a block by the tags and class words of
its ancestors and by its text (length, link share, punctuation, signs), and neighbours by a table of transitions; the
Viterbi sequence is the labelling. It is trained by the gradient of the conditional likelihood (forward-backward) on
labelled pages of two sorts: a sample of at most ``max_pages`` of the given pages with one article element, whose blocks
are labelled by that element, and pages written here from layouts with known labels, which also show other containers
and the boxes that may stand inside an article (adverts, forms, comments, notices).

Of the given pages only those of less than ``MAX_BYTES`` are drawn into the sample, so that the sample is bounded in bytes
too; all pages are read, whatever their size.

Defined results: null and empty pages have an empty text; a page without a main block too; an empty table gives no rows;
very long pages are read whole, in time linear in their length; of two label sequences of equal score that with no main
text at the first difference from the end is taken; repeated rows are read each for itself, whatever their ids; extra
columns are ignored, whatever their names; text in broken markup goes to the block that is open there. Content of scripts,
styles, templates, titles and of the controls ``select`` and ``textarea`` is no text; formulas, drawings and the fallback
texts of media are.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Block, Element, blocks

#: Pages of the sample and the bytes that each has fewer of, pages written from layouts, and rounds over all of them.
MAX_PAGES, MAX_BYTES, WRITTEN_PAGES, EPOCHS = 200, 1 << 18, 300, 6

#: Class words that stand for a kind of box (fixed values).
KINDS = {
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner dfp adsense",
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc tabs skip",
    "head": "header masthead topbar branding logo",
    "foot": "footer foot colophon copyright legal",
    "side": "sidebar side aside rail widget widgets related recommended trending popular more",
    "note": "cookie cookies consent gdpr notice notices alert popup modal overlay paywall disclaimer",
    "talk": "comment comments reply replies respond discussion disqus thread reader readers",
    "form": "form search login signup subscribe newsletter register contact",
    "share": "share sharing social tools toolbar buttons",
    "main": "content article post entry story main text body page primary",
}
KIND_OF = {w: k for k, words in KINDS.items() for w in words.split()}
_TAGS = set("article main section nav header footer aside form div p li ul ol table td th tr h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption button fieldset legend dl dt dd address body details summary dialog".split())


#: What boxes of some tags are.
TAG_KINDS = {"nav": "menu", "header": "head", "footer": "foot", "aside": "side", "form": "form", "article": "main", "main": "main", "button": "form", "dialog": "note"}


@dataclass(frozen=True)
class PathState:
    """What the ancestors of a block come to: their features, and the nearest box that says what it is."""

    features: frozenset[str] = frozenset({"bias"})
    nearest: str = ""
    leaf: str = ""

    def inside(self, element: Element) -> PathState:
        """The state one element further in."""
        kinds = {KIND_OF[w] for w in element.words if w in KIND_OF}
        if element.tag in TAG_KINDS:
            kinds.add(TAG_KINDS[element.tag])
        more = {f"kind:{k}" for k in kinds}
        if element.tag in _TAGS:
            more.add(f"in:{element.tag}")
        bad = kinds - {"main"}
        nearest = min(bad) if bad else "main" if "main" in kinds and element.tag != "body" else self.nearest
        return PathState(self.features if more <= self.features else self.features | more, nearest, element.tag)

    def all(self) -> list[str]:
        return sorted([*self.features, f"nearest:{self.nearest or 'none'}", *([f"leaf:{self.leaf}"] if self.leaf else [])])


def path_state(inside: Element | None) -> PathState:
    """The state of the elements around a block; each element's is made from that of the one around it, once."""
    todo = []
    while inside is not None and "state" not in inside.notes:
        todo.append(inside)
        inside = inside.above
    state = inside.notes["state"] if inside is not None else PathState()
    for element in reversed(todo):
        state = element.notes["state"] = state.inside(element)
    return state


def text_features(block: Block) -> tuple[str, ...]:
    """Features of the text."""
    text = block.text
    n, words = len(text), text.count(" ") + 1
    out = [f"words:{min(int(math.log2(words)), 7)}", f"links:{min(4, int(4 * block.linked / n))}"]
    if text[-1] in ".!?…\"'”»":
        out.append("ends")
    if "©" in text[:80] or "copyright" in text[:80].lower():
        out.append("copyright")
    if words < 6 and text[-1] not in ".!?":
        out.append("short")
    return tuple(out)


class Field:
    """The trained field: weights of features for main text, and transitions between the two labels."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.step = np.zeros((2, 2))
        self.first = np.zeros(2)
        self._paths: dict[PathState, float] = {}

    def unary(self, page: list[Block]) -> list[float]:
        get, paths, out = self.weights.get, self._paths, []
        for b in page:
            state = path_state(b.inside)
            s = paths.get(state)
            if s is None:
                if len(paths) > 50_000:
                    paths.clear()
                s = paths[state] = sum(get(f, 0.0) for f in state.all())
            out.append(s + sum(get(f, 0.0) for f in text_features(b)))
        return out

    def decode(self, page: list[Block]) -> list[int]:
        """The Viterbi labels of a page's blocks."""
        if not page:
            return []
        scores = self.unary(page)
        (s00, s01), (s10, s11) = self.step.tolist()
        no, yes = self.first[0], self.first[1] + scores[0]
        back = []
        for s in scores[1:]:
            a, b = (no + s00, yes + s10), (no + s01, yes + s11)
            back.append((a[1] > a[0], b[1] > b[0]))
            no, yes = max(a), max(b) + s
        label = int(yes > no)
        out = [label]
        for choice in reversed(back):
            label = int(choice[label])
            out.append(label)
        return out[::-1]

    def train(self, pages: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS, rate: float = 0.3, seed: int = 7) -> None:
        """Adaptive gradient ascent on the conditional log-likelihood, a page at a time, with a small ridge."""
        rng = random.Random(seed)
        ready = [([(*path_state(b.inside).all(), *text_features(b)) for b in page], labels) for page, labels in pages if page]
        size: dict[str, float] = {}
        step_size, first_size = np.full((2, 2), 1e-6), np.full(2, 1e-6)
        for _ in range(epochs):
            rng.shuffle(ready)
            for features, labels in ready:
                n = len(labels)
                unary = np.zeros((n, 2))
                for i, fs in enumerate(features):
                    unary[i, 1] = sum(self.weights.get(f, 0.0) for f in fs)
                forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
                forward[0] = self.first + unary[0]
                for i in range(1, n):
                    forward[i] = np.logaddexp.reduce(forward[i - 1][:, None] + self.step, axis=0) + unary[i]
                for i in range(n - 2, -1, -1):
                    backward[i] = np.logaddexp.reduce(self.step + (unary[i + 1] + backward[i + 1])[None, :], axis=1)
                total = np.logaddexp.reduce(forward[-1])
                node = np.exp(forward + backward - total)
                for i, fs in enumerate(features):
                    g = labels[i] - float(node[i, 1])
                    if abs(g) < 1e-4:
                        continue
                    for f in fs:
                        w = self.weights.get(f, 0.0)
                        d = g - 1e-3 * w
                        size[f] = size.get(f, 1e-6) + d * d
                        self.weights[f] = w + rate * d / math.sqrt(size[f])
                grad = np.zeros((2, 2))
                for i in range(1, n):
                    grad[labels[i - 1], labels[i]] += 1
                    grad -= np.exp(forward[i - 1][:, None] + self.step + (unary[i] + backward[i])[None, :] - total)
                step_size += grad**2
                self.step += rate * grad / np.sqrt(step_size)
                start = -node[0]
                start[labels[0]] += 1
                first_size += start**2
                self.first += rate * start / np.sqrt(first_size)
        self._paths.clear()


def written_pages(n: int, seed: int = 11) -> list[tuple[str, list[tuple[str, int]]]]:
    """Labelled pages from layouts: (html, (text, label) of each block in its order)."""
    rng = random.Random(seed)
    syllables = [c + v for c in "bcdfghjklmnprstvwz" for v in "aeiou"]

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.randint(a, b)))

    def sentences(a: int, b: int) -> str:
        return " ".join(words(4, 18).capitalize() + "." for _ in range(rng.randint(a, b)))

    out = []
    for _ in range(n):
        html: list[str] = []
        labels: list[tuple[str, int]] = []

        def text(tag: str, body: str, label: int, attributes: str = "") -> None:
            html.append(f"<{tag}{attributes}>{body}</{tag}>")
            labels.append((body, label))

        def links(opening: str, closing: str, a: int = 3, b: int = 8) -> None:
            html.append(opening)
            for _ in range(rng.randint(a, b)):
                body = words(1, 3)
                html.append(f'<li><a href="/{word()}">{body}</a></li>')
                labels.append((body, 0))
            html.append(closing)

        def boxed(opening: str, closing: str, a: int = 1, b: int = 3, long: bool = True) -> None:
            html.append(opening)
            for _ in range(rng.randint(a, b)):
                text(rng.choice(["p", "div", "p"]), sentences(1, 3) if long and rng.random() < 0.6 else words(2, 9), 0)
            html.append(closing)

        def box(kinds: list[str]) -> None:
            kind = rng.choice(kinds)
            name = rng.choice(KINDS[kind].split())
            if kind == "form":
                html.append(rng.choice(['<form action="/">', f'<form class="{name}">', f'<div class="{name}"><form>']))
                text(rng.choice(["p", "label", "div", "button"]), words(2, 8), 0) if rng.random() < 0.5 else text("p", sentences(1, 1), 0)
                text("button", words(1, 2), 0)
                html.append("</form>" if not html[-3].startswith("<div") else "</form></div>")
            elif kind == "talk":
                html.append(f'<{(t := rng.choice(["section", "div", "ol"]))} {rng.choice(["id", "class"])}="{name}">')
                if rng.random() < 0.5:
                    text("h3", words(1, 3), 0)
                for _ in range(rng.randint(1, 5)):
                    tag = rng.choice(["div", "div", "li", "article"])
                    html.append(f'<{tag} class="comment">' if rng.random() < 0.6 else f"<{tag}>")
                    text("p", sentences(1, 4), 0)
                    html.append(f"</{tag}>")
                html.append(f"</{t}>")
            elif kind in ("menu", "share"):
                tag = rng.choice(["nav", "div", "ul"]) if kind == "menu" else "div"
                links(f'<{tag} class="{name}">' if tag != "nav" or rng.random() < 0.5 else "<nav>", f"</{tag}>")
            else:
                own = {"head": "header", "foot": "footer", "side": "aside"}.get(kind)
                tag = own if own and rng.random() < 0.6 else rng.choice(["div", "div", "section", "aside"])
                boxed(f'<{tag} class="{name}">' if not own or tag != own or rng.random() < 0.5 else f"<{tag}>", f"</{tag}>")

        def outside(kinds: list[str], most: int) -> None:
            for _ in range(rng.randint(0, most)):
                box(kinds)

        html.append("<body>")
        outside(["head", "menu", "note", "ad", "form"], 4)
        kind = rng.choice(["article", "article", "article", "main", "main article", "div", "div", "section", "", ""])  # the last: no container
        mark = f' {rng.choice(["class", "id"])}="{rng.choice(["content", "post", "entry-content", "article-body", "story", "main", "post-content", "text"])}"'
        tags = kind.split()
        for t in tags:
            html.append(f"<{t}{mark if t in ('div', 'section') or rng.random() < 0.2 else ''}>")
        if rng.random() < 0.8:
            text("h1", words(2, 12).capitalize() + rng.choice(["", "."]), 1)
        for _ in range(rng.randint(1, 14)):
            r = rng.random()
            if r < 0.68:
                text("p", sentences(1, 6), 1)
            elif r < 0.76:
                text("p", words(1, 4).capitalize() + rng.choice([".", ""]), 1)
            elif r < 0.84:
                text(rng.choice(["h2", "h3"]), words(1, 8).capitalize(), 1)
            elif r < 0.90:
                listed = rng.choice(["ul", "ol"])
                html.append(f"<{listed}>")
                for _ in range(rng.randint(2, 5)):
                    text("li", words(2, 14), 1)
                html.append(f"</{listed}>")
            elif r < 0.93:
                text("blockquote", sentences(1, 2), 1)
            else:
                box(["ad", "share", "form", "note", "side", "talk"])
        for t in reversed(tags):
            html.append(f"</{t}>")
        outside(["talk", "side", "ad", "form", "menu"], 4)
        if rng.random() < 0.8:
            text("footer", "© " + words(2, 8), 0) if rng.random() < 0.5 else box(["foot"])
        html.append("</body>")
        out.append(("".join(html), labels))
    return out


def label_by_article(page: list[Block]) -> list[int] | None:
    """Labels of a page with an article: its blocks, but for those in boxes of another kind; None: there is no article."""
    paths = [b.inside.path() if b.inside else [] for b in page]
    if not any(e.tag == "article" for path in paths for e in path):
        return None
    out = []
    for path in paths:
        inside = [k for k, e in enumerate(path) if e.tag == "article"]
        rest = path[inside[0] + 1 :] if inside else []
        own = {KIND_OF.get(w, "main") for e in rest for w in e.words} | {e.tag for e in rest} & {"nav", "aside", "footer", "form"}
        out.append(int(bool(inside) and not own - {"main"}))
    return out


def train(pages: DataFrame, max_pages: int = MAX_PAGES, html_col: str = "html") -> Field:
    """The field trained on a sample of the pages (those with the least hashes) and on the written ones."""
    some = pages.where(F.col(html_col).isNotNull() & (F.octet_length(html_col) < MAX_BYTES)).select(html_col, F.xxhash64(html_col).alias("h"))
    # The least hashes are found without their pages, so that a task sends the driver only numbers; equal pages count once.
    least = [r["h"] for r in some.groupBy("h").agg(F.count("*")).orderBy("h").limit(max_pages).select("h").collect()]
    sample = some.where(F.col("h").isin(least)).dropDuplicates(["h"]).orderBy("h")
    data = []
    for row in sample.collect():  # at most max_pages pages of less than MAX_BYTES
        page = blocks(row[html_col])
        labels = label_by_article(page)
        if labels:
            data.append((page, labels))
    for source, labels in written_pages(WRITTEN_PAGES):
        page = blocks(source)
        if [b.text for b in page] == [t for t, _ in labels]:
            data.append((page, [y for _, y in labels]))
    field = Field()
    field.train(data)
    return field


def main_text(page: str | None, field: Field) -> str:
    """The main text of a page: its main blocks, joined by a blank line."""
    found = blocks(page)
    return "\n\n".join(b.text for b, y in zip(found, field.decode(found)) if y)


def extract(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(train(pages, max_pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [main_text(h, sent.value) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

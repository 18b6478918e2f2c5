"""Audited normalisation of scripture text, and normal forms: the text functions that Spark has no expression for, hence Python."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scripts as s

REPAIR = T.StructType([T.StructField("kind", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("before", T.StringType()), T.StructField("after", T.StringType()), T.StructField("context", T.StringType()), T.StructField("marker", T.IntegerType())])
NORMALIZED = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("repairs", T.ArrayType(REPAIR)), T.StructField("lines_joined", T.IntegerType()), T.StructField("controls_removed", T.IntegerType()), T.StructField("footnote_markers", T.ArrayType(T.IntegerType())), T.StructField("changed", T.BooleanType())]
)

_ARROW = pa.struct([
    ("text", pa.string()), ("repairs", pa.list_(pa.struct([("kind", pa.string()), ("at", pa.int32()), ("before", pa.string()), ("after", pa.string()), ("context", pa.string()), ("marker", pa.int32())]))),
    ("lines_joined", pa.int32()), ("controls_removed", pa.int32()), ("footnote_markers", pa.list_(pa.int32())), ("changed", pa.bool_()),
])
#: Characters of texts whose repairs are held as Python objects at once.
AT_ONCE = 1 << 18


def _python(pattern: str) -> str:
    """A pattern of ``scripts`` as Python writes it."""
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern)


_CONTROL = re.compile("[\x00-\x09\x0b-\x1f\x7f-\x9f]")
_HYPHENS = "-\u00ad\u2010"
#: Characters that a repair's context shows on either side.
AROUND = 8


def _repair_pattern(script: str, footnotes: bool) -> re.Pattern[str]:
    C, N, V, D = (_python(x) for x in (s.C, s.N, s.V, s.ANY_DIGIT))
    parts = []
    if script in s.PRE_BASE_MATRA:
        m = chr(s.PRE_BASE_MATRA[script])
        parts.append(f"(?<!{C})(?<!{C}{N})(?P<matra>{m})(?P<cluster>{C}{N}?(?:{V}{C}{N}?)*)")
    if footnotes and script in s.SCRIPT_CLASS:
        zero = s.DIGIT_ZERO[script]
        own = f"[{chr(zero)}-{chr(zero + 9)}]"
        letters = _python(s.SCRIPT_CLASS[script])
        parts.append(f"(?:(?<={letters})|(?<={letters}\\.))(?<!{D})(?P<digits>{own}{D}?)(?!{D})")
    return re.compile("|".join(parts) or "(?!)")


_PATTERNS: dict[tuple[str, bool], re.Pattern[str]] = {}


def normalize_one(text: str, script: str, join: bool = True, footnotes: bool = True) -> dict:
    """The clean text and what was done to it; places are code points of the result."""
    source = unicodedata.normalize("NFC", text)
    clean, controls = _CONTROL.subn("", source)
    paragraphs = [[line for line in (" ".join(x.split()) for x in p.split("\n")) if line] for p in re.split(r"\n\s*\n", clean)]
    # Pieces of the body, joined once; ``size`` is what they come to.
    parts, hyphens, joined, size = [], [], 0, 0

    def add(piece: str) -> None:
        nonlocal size
        parts.append(piece)
        size += len(piece)

    for k, lines in enumerate(p for p in paragraphs if p):
        add("\n" if k else "")
        for i, line in enumerate(lines):
            if i:
                joined += 1
                end = parts[-1]
                if join and end[-1] in _HYPHENS:
                    parts[-1], size = end[:-1], size - 1
                    hyphens.append((size, end[-1]))
                    # A line that was nothing but its hyphen leaves an empty piece, and what stood before it ends the body.
                    while len(parts) > 1 and not parts[-1]:
                        parts.pop()
                else:
                    add(" " if join else "\n")
            add(line)
    body = "".join(parts)
    key = (script, footnotes)
    pattern = _PATTERNS.setdefault(key, _repair_pattern(*key))
    events = [(m.start(), 1, m) for m in pattern.finditer(body)] + [(at, 0, mark) for at, mark in hyphens]
    written, size, done, repairs, markers = [], 0, 0, [], []

    def repaired(kind: str, at: int, before: str, after: str, context: str, marker: int | None = None) -> None:
        repairs.append({"kind": kind, "at": at, "before": before, "after": after, "context": context, "marker": marker})

    for at, kind, found in sorted(events, key=lambda e: e[:2]):
        if at > done:
            written.append(body[done:at])
            size, done = size + at - done, at
        around = body[max(0, at - AROUND) : at + AROUND]
        if not kind:
            repaired("hyphen-join", size, found, "", "")
        elif found.groupdict().get("matra"):
            after = found["cluster"] + found["matra"]
            repaired("pre-base-matra-order", size, found[0], after, around)
            written.append(after)
            size, done = size + len(after), found.end()
        else:
            value = int("".join(str(unicodedata.digit(c)) for c in found["digits"]))
            repaired("footnote-marker", size, found["digits"], "", around, value)
            markers.append(value)
            done = found.end()
    written.append(body[done:])
    out = "".join(written).rstrip()
    return {"text": out, "repairs": repairs, "lines_joined": joined, "controls_removed": controls, "footnote_markers": markers, "changed": out != text}


def _pieces(texts: pa.Array, script: str, join: bool, footnotes: bool) -> Iterator[pa.Array]:
    """What ``normalize_one`` makes of a batch of texts, in pieces of about ``AT_ONCE`` characters."""
    out: list[dict] = []
    size = 0
    for value in texts:
        text = value.as_py()
        out.append(normalize_one(text, script, join, footnotes) if text is not None else dict.fromkeys(_ARROW.names))
        size += len(text or "")
        if size >= AT_ONCE:
            yield pa.array(out, _ARROW)
            out, size = [], 0
    if out:
        yield pa.array(out, _ARROW)


def normalize(col: Column, script: str, join: bool = True, footnotes: bool = True) -> Column:
    """(text, repairs, lines_joined, controls_removed, footnote_markers, changed); null for a null text."""

    @F.arrow_udf(NORMALIZED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield from _pieces(texts, script, join, footnotes)

    return run(col)


@F.pandas_udf(T.StringType())
def _nfkd(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


def nfkd(col: Column) -> Column:
    """Unicode normal form KD: letters apart from their marks."""
    return _nfkd(col)


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(col: Column) -> Column:
    """Unicode normal form C."""
    return _nfc(col)

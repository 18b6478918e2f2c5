"""Impossible letter sequences of Indic texts with their places: one pass over the code points of a batch of texts.

Each code point gets a class (vowel sign, virama, consonant, nukta); a fault is a condition on a few neighbouring classes,
so all faults of a batch fall out of comparisons of shifted arrays, in the order of their places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scripts as s

#: Findings that are reported at most, what is shown on either side of one, and letters from which a missing pre-base matra means something.
REPORTED, AROUND, ENOUGH = 12, 6, 300
KINDS = ("adjacent-vowel-signs", "vowel-sign-without-base", "virama-without-base", "virama-before-vowel-sign", "no-pre-base-matra")
SCHEMA = "ok boolean, violations array<struct<kind:string,at:int,sample:string>>, count long, examined long, rate double"
_SIGN, _VIRAMA, _CONSONANT, _NUKTA = 1, 2, 3, 4
#: Characters that are looked at at once.
AT_ONCE = 1 << 20


def _classes() -> np.ndarray:
    out = np.zeros(0x110000, dtype=np.uint8)
    for code, table in ((_CONSONANT, s.CONSONANTS), (_SIGN, s.VOWEL_SIGNS), (_VIRAMA, s.VIRAMAS), (_NUKTA, s.NUKTAS)):
        for first, last in table:
            out[first : last + 1] = code
    return out


CLASS_OF = _classes()


def find(texts: list[str], script: str) -> list[dict]:
    """The findings of each text."""
    if script not in s.PRE_BASE_MATRA:
        return [{"ok": True, "violations": [], "count": 0, "examined": 0, "rate": 0.0} for _ in texts]
    # Two characters of no class stand between texts, so no condition reaches over.
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join("\0\0" + t for t in texts).encode("utf-32-le", "surrogatepass") + b"\0" * 4, dtype="<u4")
    begin = np.cumsum(lens + 2) - lens
    kind = CLASS_OF[points]
    sign, virama = kind == _SIGN, kind == _VIRAMA
    before = np.concatenate([[0], kind[:-1]])
    base = np.where(before == _NUKTA, np.concatenate([[0, 0], kind[:-2]]), before)
    double = sign & (before == _SIGN)
    faults = np.stack([double, sign & ~double & (base != _CONSONANT) & (base != _VIRAMA), virama & (base != _CONSONANT), virama & np.append(sign[1:], False)], axis=1)
    where, which = np.nonzero(faults)
    first = np.searchsorted(where, begin)
    last = np.searchsorted(where, begin + lens)
    examined = np.concatenate([[0], np.cumsum((kind > 0) & (kind != _NUKTA))])
    matra = chr(s.PRE_BASE_MATRA[script])
    out = []
    for k, text in enumerate(texts):
        n = int(examined[begin[k] + lens[k]] - examined[begin[k]])
        count = int(last[k] - first[k])
        some = range(first[k], min(last[k], first[k] + REPORTED))
        found = [{"kind": KINDS[which[i]], "at": (at := int(where[i] - begin[k])), "sample": text[max(0, at - AROUND) : at + AROUND]} for i in some]
        if n >= ENOUGH and matra not in text:
            count += 1
            found.insert(0, {"kind": KINDS[4], "at": -1, "sample": f"{n} letters without a single {matra}"})
        out.append({"ok": count == 0, "violations": found, "count": count, "examined": n, "rate": count / n * 1000 if n else 0.0})
    return out


def orthography_findings(col: Column, script: str) -> Column:
    """(ok, violations, count, examined, rate) of a text; null for a null text.

    ``violations`` are the first ``REPORTED`` faults (kind, place in code points, the text around it) in the order of their
    places, behind the one that concerns the whole text; ``count`` is how many there are. Latin texts have none.
    """

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["ok", "violations", "count", "examined", "rate"]
        for texts in batches:
            out: list[dict] = []
            held: list[str] = []
            size = 0
            for text in texts:
                held.append(text if text is not None else "")
                size += len(held[-1])
                if size > AT_ONCE:
                    out += find(held, script)
                    held, size = [], 0
            out += find(held, script) if held else []
            yield pd.DataFrame([x if t is not None else dict.fromkeys(names) for x, t in zip(out, texts)], columns=names)

    return run(col)


def describe(kind: Column, sample: Column) -> Column:
    """A finding as a line."""
    shown = F.concat(F.lit(" (…"), sample, F.lit("…)"))
    return (
        F.when(kind == KINDS[0], F.concat(F.lit("two vowel signs in a row"), shown))
        .when(kind == KINDS[1], F.concat(F.lit("a vowel sign with no consonant to attach to"), shown))
        .when(kind == KINDS[3], F.concat(F.lit("a virama followed by a vowel instead of a consonant"), shown))
        .when(kind == KINDS[2], F.concat(F.lit("a virama with no consonant before it"), shown))
        .otherwise(F.concat(F.lit("not one pre-base matra in the whole text — "), sample))
    )

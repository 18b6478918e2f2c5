"""Character classes of the scripts that books are set in, as regular-expression classes.

The patterns are written with ``\\x{...}`` escapes, which Java's and RE2's expressions read alike.
"""

from __future__ import annotations

#: Code-point ranges (first, last), in natural order.
LATIN = ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF))
DEVANAGARI = ((0x900, 0x963), (0x966, 0x97F), (0x1CD0, 0x1CFF), (0xA8E0, 0xA8FF))
GUJARATI = ((0xA80, 0xAFF),)
NEUTRAL = ((0x0, 0x40), (0x5B, 0x60), (0x7B, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x300, 0x36F), (0x964, 0x965), (0x2000, 0x206F), (0x20A0, 0x20CF), (0x2190, 0x2BFF))
CONSONANTS = ((0x915, 0x939), (0x958, 0x95F), (0x978, 0x97F), (0xA95, 0xAB9), (0xAF9, 0xAF9))
MARKS = (
    (0x300, 0x36F), (0x900, 0x903), (0x93A, 0x93C), (0x93E, 0x94C), (0x94E, 0x94F), (0x951, 0x957), (0x962, 0x963), (0xA81, 0xA83), (0xABC, 0xABC),
    (0xABE, 0xAC5), (0xAC7, 0xAC9), (0xACB, 0xACC), (0xAE2, 0xAE3), (0xAFA, 0xAFF), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20F0), (0xFE00, 0xFE0F),
)
VOWEL_SIGNS = ((0x93A, 0x93B), (0x93E, 0x94C), (0x94E, 0x94F), (0x955, 0x957), (0x962, 0x963), (0xABE, 0xAC5), (0xAC7, 0xAC9), (0xACB, 0xACC), (0xAE2, 0xAE3))
NUKTAS = ((0x93C, 0x93C), (0xABC, 0xABC))
VIRAMAS = ((0x94D, 0x94D), (0xACD, 0xACD))
PRE_BASE_MATRA = {"gujr": 0xABF, "deva": 0x93F}
DIGIT_ZERO = {"gujr": 0xAE6, "deva": 0x966, "latn": 0x30}
LANGUAGE_SCRIPT = {"gu": "gujr", "sa": "deva", "hi": "deva", "mr": "deva", "en": "latn"}
#: Dominance ties break in this order.
PREFERENCE = ("gujr", "deva", "other", "latn")


def ranges(*tables: tuple[tuple[int, int], ...]) -> str:
    """The inside of a character class."""
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for table in tables for a, b in table)


def cls(*tables: tuple[tuple[int, int], ...]) -> str:
    return f"[{ranges(*tables)}]"


SCRIPT_CLASS = {"gujr": cls(GUJARATI), "deva": cls(DEVANAGARI), "latn": cls(LATIN)}
DIGITS = {s: "".join(chr(z + d) for d in range(10)) for s, z in DIGIT_ZERO.items()}
ANY_DIGIT = f"[{''.join(f'\\x{{{z:X}}}-\\x{{{z + 9:X}}}' for z in DIGIT_ZERO.values())}]"
C, M, S, N, V = cls(CONSONANTS), cls(MARKS), cls(VOWEL_SIGNS), cls(NUKTAS), cls(VIRAMAS)
J, Z = "\\x{200D}", "\\x{200C}"
#: One orthographic syllable: a base (or a run of stray marks) with its marks and conjuncts, and how it may end.
AKSHARA = f"(?s)(?:[{ranges(MARKS)}{J}{Z}]+|[^{ranges(MARKS, VIRAMAS)}{J}{Z}]|(?={V}))(?:{M}|{J}|{V}{J}*+{C})*(?:{Z}|{V}{J}*+{Z}?)?"

"""Text column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters whose ASCII form is not a base letter plus an accent.
LIGATURES = {
    "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Ĳ": "IJ", "ĳ": "ij",
    "ß": "ss", "Þ": "TH", "þ": "th",
}
STROKES = {
    "Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d",
    "Ħ": "H", "ħ": "h", "ı": "i", "Ł": "L", "ł": "l", "Ŧ": "T", "ŧ": "t",
}
# White space as Unicode defines it, and the shorter set trimmed from legacy text.
WHITE_SPACE = (
    "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LEGACY_WHITE_SPACE = " \t\r\n"
# End of fixed values.

_LATIN_LETTERS = range(0xC0, 0x180)


def _accent_table() -> dict[str, str]:
    table = dict(STROKES)
    for point in _LATIN_LETTERS:
        base = unicodedata.normalize("NFKD", chr(point))[0]
        if base.isascii() and base.isalpha():
            table[chr(point)] = base
    return {k: v for k, v in table.items() if k not in LIGATURES}


_ACCENTS = _accent_table()


def strip(col: Column, space: str = WHITE_SPACE) -> Column:
    """Trim any white space, tabs and line ends included."""
    return F.btrim(col, F.lit(space))


def blank_to_null(col: Column) -> Column:
    """Trim; text with nothing left becomes NULL."""
    return F.nullif(strip(col), F.lit(""))


def ascii_fold(col: Column) -> Column:
    """Latin letters with accents, strokes or ligatures to plain ASCII."""
    folded = F.translate(col, "".join(_ACCENTS), "".join(_ACCENTS.values()))
    for letter, plain in LIGATURES.items():
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    return folded


def yes_no(flag: Column) -> Column:
    """TRUE/FALSE to ``yes``/``no``; NULL stays NULL."""
    return F.when(flag, "yes").when(~flag, "no")

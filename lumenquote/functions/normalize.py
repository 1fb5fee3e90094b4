"""Normal form for matching, with a map from its positions to those of the raw text."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

# Characters that count as the same.
SINGLE_QUOTES, DOUBLE_QUOTES = "\u2018\u2019\u201a\u201b\u2032", "\u201c\u201d\u201e\u201f\u2033\u00ab\u00bb"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"


@lru_cache(maxsize=65_536)
def normal_char(c: str) -> str:
    """What one code point becomes: nothing, or its compatibility form in lower case with plain quotes and dashes."""
    if c in INVISIBLE:
        return ""
    if c in SINGLE_QUOTES:
        return "'"
    if c in DOUBLE_QUOTES:
        return '"'
    if c in DASHES:
        return "-"
    return unicodedata.normalize("NFKC", c).lower()


def normalize_for_match(text: str) -> tuple[str, np.ndarray]:
    """(normalized text, raw position of the code point each of its characters comes from). Runs of white space are one blank, ends are trimmed."""
    out: list[str] = []
    at: list[int] = []
    blank = True
    for i, c in enumerate(text):
        for x in normal_char(c):
            if x.isspace():
                if not blank:
                    out.append(" ")
                    at.append(i)
                blank = True
            else:
                out.append(x)
                at.append(i)
                blank = False
    if out and out[-1] == " ":
        out.pop()
        at.pop()
    return "".join(out), np.array(at, np.int32)


def normal_text(text: str) -> str:
    """The normalized text alone, quicker."""
    if text.isascii():
        return " ".join(text.lower().split())
    return " ".join("".join(map(normal_char, text)).split())

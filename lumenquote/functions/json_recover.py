"""Reading of JSON that a language model wrote: wrapped in prose, cut off, or with broken items."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Whole strings, the last one perhaps cut off, and brackets.
MARK = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?$)|[{}\[\]]', re.DOTALL)
CLOSING = {"{": "}", "[": "]"}


def balanced(text: str, opening: str, at: int = 0) -> Iterator[str]:
    """Bracketed values one after the other from `at` on, up to one that is not closed. Brackets of the other kind or in strings do not count."""
    while (at := text.find(opening, at)) >= 0:
        depth, end = 0, -1
        for m in MARK.finditer(text, at):
            depth += (m.group() == opening) - (m.group() == CLOSING[opening])
            if not depth:
                end = m.end()
                break
        if end < 0:
            return
        yield text[at:end]
        at = end


def all_objects(text: str) -> list[str]:
    """Every balanced {...} in sequence."""
    return list(balanced(text, "{"))


def first_object(text: str) -> str | None:
    """The first balanced {...}, None if the first brace is never closed."""
    return next(balanced(text, "{"), None)


def array_by_key(text: str, key: str) -> str | None:
    """The [...] after the first "key", or all that follows its bracket if it is not closed."""
    named = text.find(f'"{key}"')
    at = text.find("[", named) if named >= 0 else -1
    return next(balanced(text, "[", at), text[at:]) if at >= 0 else None


def items_of(content: str | None, key: str = "items") -> list:
    """The items of an answer: by a strict reading, else one by one, leaving out what is broken. A bare array has no key and gives none."""
    text = content or ""
    whole = first_object(text)
    if whole is not None:
        try:
            items = json.loads(whole).get(key)
            if isinstance(items, list):
                return items
        except (ValueError, AttributeError, RecursionError):
            pass
    part = array_by_key(text, key)
    out = []
    for piece in all_objects(part) if part else []:
        try:
            out.append(json.loads(piece))
        except (ValueError, RecursionError):
            continue
    return out


def recover_items(key: str = "items") -> Callable[[Column], Column]:
    """A column function: text to the array of its items, each as JSON. Null and empty texts give an empty array."""

    @F.pandas_udf("array<string>")
    def run(contents: pd.Series) -> pd.Series:
        return contents.map(lambda x: [json.dumps(i, ensure_ascii=False) for i in items_of(x, key)])

    return run

"""Locating quotes in source texts: exact, in normal form, or the best window by character trigrams.

What the JVM can settle (a literal hit in the main text) goes to Python without its texts; for the rest an Arrow
function reads the fields of a source in order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenquote.functions.normalize import normal_text, normalize_for_match
from lumenquote.functions.text import trim_blank
from lumenquote.session import map_batches

# Fixed values of the matching rule.
LEAST_WINDOW, LEAST_STEP, MOST_STEP, GOOD_ENOUGH, BEST_FUZZY = 40, 10, 80, 0.995, 0.99
BLANKS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
CHUNK = 16_384


@dataclass(frozen=True)
class MatchOptions:
    min_source_length: int = 40
    short_quote_length: int = 90
    fuzzy_threshold: float = 0.4
    window_scales: tuple[float, ...] = (0.85, 1.0, 1.15)


@dataclass(frozen=True)
class QuoteMatch:
    method: str = "not_found"
    score: float = 0.0
    start: int | None = None
    end: int | None = None
    field: str = "text"


def trigram_counts(text: str) -> Counter:
    return Counter(text[i : i + 3] for i in range(len(text) - 2))


def dice_similarity(a: Counter, b: Counter) -> float:
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if a and b else 0.0


def _grams(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:] if len(c) > 2 else np.zeros(0, np.int64)


# Quotes of one source follow each other, so what depends on its text alone is made once.
_normal_once, _placed_once, _grams_once = (lru_cache(maxsize=16)(f) for f in (normal_text, normalize_for_match, _grams))


class _Scan:
    """Trigrams of one quote against one text; windows are differences of running counts."""

    def __init__(self, quote: str, text: str):
        self.kinds, self.want = np.unique(_grams(quote), return_counts=True)
        self.quote_total, self.length = len(quote) - 2, len(text)
        grams = _grams_once(text)
        at = np.searchsorted(self.kinds, grams)
        at[at == len(self.kinds)] = 0
        self.kind = np.where(self.kinds[at] == grams, at, -1) if len(self.kinds) and len(grams) else np.full(len(grams), -1)
        self.all = self._running(self.kind) if len(grams) <= CHUNK else None  # for long texts counts are made by stretches

    def _running(self, kind: np.ndarray) -> np.ndarray:
        counts = np.zeros((len(kind) + 1, len(self.kinds)), np.int16 if len(kind) < 32_000 else np.int32)
        seen = np.flatnonzero(kind >= 0)
        counts[seen + 1, kind[seen]] = 1
        return np.cumsum(counts, axis=0, dtype=counts.dtype, out=counts)

    def whole(self) -> float:
        if self.length < 3:
            return 0.0
        have = np.bincount(self.kind[self.kind >= 0], minlength=len(self.kinds))
        return 2.0 * int(np.minimum(have, self.want).sum()) / (self.quote_total + self.length - 2)

    def windows(self, width: int, positions: np.ndarray) -> tuple[float, int]:
        """(score, position) of the first window that is good enough, else of the first best; (0, -1) if none has a trigram in common."""
        best, where = 0.0, -1
        k = 0
        while k < len(positions):
            low = int(positions[k])
            stop = int(np.searchsorted(positions, low + CHUNK, "right"))
            own = positions[k:stop]
            if self.all is not None:
                counts, rows = self.all, own
            else:
                counts, rows = self._running(self.kind[low : int(own[-1]) + width - 2]), own - low
            common = np.minimum(counts[rows + width - 2] - counts[rows], self.want).sum(axis=1)
            score = 2.0 * common / (self.quote_total + width - 2)
            enough = np.flatnonzero(score >= GOOD_ENOUGH)
            i = int(enough[0]) if len(enough) else int(np.argmax(score))
            if score[i] > best:
                best, where = float(score[i]), int(own[i])
            if len(enough):
                break
            k = stop
        return best, where


def best_window(quote: str, text: str, scales: tuple[float, ...] = MatchOptions.window_scales) -> tuple[float, int, int]:
    """(score, offset, width): a coarse scan per scale, then every position around the winner. (0, -1, 0) for quotes under three characters."""
    if len(quote) < 3:
        return 0.0, -1, 0
    scan = _Scan(quote, text)
    step = min(MOST_STEP, max(LEAST_STEP, floor(len(quote) / 8 + 0.5)))
    score, offset, width = 0.0, -1, 0
    for scale in scales:
        w = max(LEAST_WINDOW, floor(len(quote) * scale + 0.5))
        if w > len(text):
            own = (scan.whole(), 0, len(text))
        else:
            own = (*scan.windows(w, np.arange(0, len(text) - w + 1, step)), w)
        if own[0] > score:
            score, offset, width = own
    if offset >= 0 and width <= len(text):
        near, at = scan.windows(width, np.arange(max(0, offset - step), min(offset + step, len(text) - width) + 1)) if width > 2 else (0.0, -1)
        if near > score:
            score, offset = near, at
    return score, offset, width


def match_quote_against_text(quote: str, text: str, options: MatchOptions = MatchOptions(), field: str = "text") -> QuoteMatch:
    """Literal, then normalized, then fuzzy; positions are code points of the raw text, the end exclusive."""
    q = quote.strip(BLANKS)
    if not q or not text.strip(BLANKS):
        return QuoteMatch()
    at = text.find(q)
    if at >= 0:
        return QuoteMatch("exact", 1.0, at, at + len(q), field)
    nq, nt = normal_text(q), _normal_once(text)
    if not nq or not nt:
        return QuoteMatch()
    at, score, width, method = nt.find(nq), 1.0, len(nq), "normalized"
    if at < 0:
        dice, at, width = best_window(nq, nt, options.window_scales)
        score, method = max(0.0, min(BEST_FUZZY, dice * min(1.0, len(nq) / options.short_quote_length))), "fuzzy"
        if at < 0 or score < options.fuzzy_threshold:
            return QuoteMatch("not_found", score, None, None, field)
    _, origin = _placed_once(text)
    return QuoteMatch(method, score, int(origin[at]), int(origin[min(at + width - 1, len(origin) - 1)]) + 1, field)


def match_quote_against_source(quote: str | None, fields: list[str | None], options: MatchOptions = MatchOptions()) -> QuoteMatch:
    """Best match over the fields (text first, then the extra texts); fields that are too short are passed over."""
    best = QuoteMatch()
    for i, text in enumerate(fields):
        if text is None or len(text.strip(BLANKS)) < options.min_source_length:
            continue
        found = match_quote_against_text(quote or "", text, options, "text" if i == 0 else f"extraTexts[{i - 1}]")
        if found.score > best.score:
            best = found
        if best.score >= 1.0:
            break
    return best


def exact_position(quote: Column, text: Column) -> Column:
    """0-based position of the trimmed quote in the text, null if it is not there."""
    q = trim_blank(quote)
    return F.when((q != "") & (F.instr(text, q) > 0), F.instr(text, q) - 1)


MATCH_FIELDS = "method string, score double, start int, end int, field string"


def match_quotes(pairs: DataFrame, quote: str = "quote", text: str = "text", extra_texts: str = "extra_texts", options: MatchOptions = MatchOptions()) -> DataFrame:
    """pairs without its texts, with method, score, start, end and field of each quote's best match in its source.

    Null quotes, texts and extra texts count as empty and give not_found with score 0.
    """
    keys = [c for c in pairs.columns if c not in (text, extra_texts)]
    n = len(keys)
    long_enough = F.length(trim_blank(F.col(text))) >= options.min_source_length
    hit = F.when(long_enough, exact_position(F.col(quote), F.col(text))).cast("int")
    fields = F.concat(F.array(F.col(text)), F.coalesce(F.col(extra_texts), F.array().cast("array<string>")))
    # One pass over the pairs: what is settled goes through without its texts.
    staged = pairs.withColumn("_at", hit).select(*keys, F.col("_at"), F.when(F.col("_at").isNotNull(), F.col("_at") + F.length(trim_blank(F.col(quote)))).alias("_to"), F.when(F.col("_at").isNull(), fields).alias("_fields"))
    at = keys.index(quote)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in staged.schema[:n]) + ", " + MATCH_FIELDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                b = whole.slice(k, 1000)
                found = [
                    QuoteMatch("exact", 1.0, start, end) if start is not None else match_quote_against_source(q, own, options)
                    for q, start, end, own in zip(*(b.column(i).to_pylist() for i in (at, n, n + 1, n + 2)))
                ]
                new = [pa.array([getattr(m, name) for m in found], kind) for name, kind in (("method", pa.string()), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32()), ("field", pa.string()))]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *new], names=[*keys, "method", "score", "start", "end", "field"])

    return map_batches(staged, run, schema)


def trigrams(c: Column) -> Column:
    """Array of the trigrams of a text, empty below three characters."""
    return F.when(F.length(c) >= 3, F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def gram_table(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, gram, n: trigram multisets as rows."""
    return texts.select(*keys, F.explode(trigrams(F.col(text))).alias("gram")).groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("n"))


def dice_pairs(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, dice of two text columns of each row, within the row: no grams are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            dice = [dice_similarity(trigram_counts(p or ""), trigram_counts(q or "")) for p, q in zip(x.column(len(keys)).to_pylist(), x.column(len(keys) + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*x.columns[: len(keys)], pa.array(dice, pa.float64())], names=[*keys, "dice"])

    named = pairs.select(*keys, F.col(a).alias("_a"), F.col(b).alias("_b"))
    return map_batches(named, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema[: len(keys)]) + ", dice double")

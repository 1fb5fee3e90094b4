"""Text decoded with the wrong character encoding: finding the records and restoring what can be restored.

A first pass counts adjacent characters over the whole corpus, apart from sequences that are UTF-8 read byte by byte
and have a reading in characters which the corpus knows elsewhere, so the statistics are the same however common misread
text is. Each pair's part of the mutual information,
p(ab) log(p(ab) / (p(a) p(b))), says how usual the pair is. In the second pass the pairs of a text are scored by
how far they fall below what is usual, maximum-scoring segments isolate the improbable runs, and only inside those
the inverse mappings are tried: a run is given back to bytes by the encoding that may have misread them and
decoded by the one that may have been meant. A mapping holds if the corpus knows the outcome much better, or if it is
strict UTF-8 for known characters and the sequence does not stand among its neighbours as the corpus knows it.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenquote.session import map_batches

SYMBOLS = 2048
BATCH_CHARS = 2_000_000

# Fixed values: (encoding that misread the bytes, encoding that was meant).
THROUGH_UTF8 = ("cp1252", "latin-1", "cp1251", "cp437", "cp850", "mac_roman", "cp866", "koi8-r", "cp1250", "cp1253", "iso8859-15")
SINGLE_BYTE = (("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1252", "koi8-r"), ("cp1252", "cp866"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"))
#: Many-byte encodings of East Asia: as what was meant, read by a single-byte one, and as what UTF-8 was read by.
EAST_ASIAN = ("euc_jp", "gb18030", "big5", "euc_kr", "shift_jis")
WESTERN = ("latin-1", "cp1252")
EAST_ASIAN_LETTERS = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]{2}")
#: What no encoding means: C1 controls and what stands for bytes that could not be read.
REPLACED_RUN = re.compile(r"[\x80-\x9f\ufffd]+")
IGNORABLE = re.compile(r"[\u00ad\u200b-\u200f\u2060\ufeff]")
UNIT = re.compile(r"[^\x00-\x7f]+")
LONG_UNIT = re.compile(r"[^\x00-\x7f]{2,}")
MOST_LAYERS = 3
LEAST_KNOWN_CHARS = 3  # occurrences apart from sequences that may be misread, from which a character is known
#: Code points that stand for themselves; the others share the last symbols by block.
RANGES = ((0x0, 0x250), (0x370, 0x530), (0x2000, 0x2070), (0x20A0, 0x20C0), (0x2100, 0x2150), (0x2200, 0x2300), (0x2500, 0x25C0), (0xFFFD, 0xFFFE))


@dataclass(frozen=True)
class GarbleRule:
    usual: float = 6e-4  # nats of mutual information from which a pair is usual
    most: float = 3.0  # highest score of an improbable pair
    calm: float = 0.5  # what a usual pair takes off a segment
    segment: float = 1.5  # least score of a segment that is looked into
    gain: float = 1.5  # least gain in mean log frequency of pairs by a mapping
    over_case: float = 0.7  # gain that a reading byte for byte needs over the unit in lower case
    least_known: float = -11.0  # mean log frequency of pairs from which such a reading counts as evidence
    least_letters: int = 5  # characters of such evidence that a text needs
    lost: float = 1.0  # least score of a pair with a character that no encoding means, however common it is
    layers: int = MOST_LAYERS  # decodings one over the other


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Symbol of every code point; 0 is kept for the ends of texts."""
    table = np.zeros(0x110000, np.uint16)
    at = 1
    for a, b in RANGES:
        table[a:b] = np.arange(at, at + b - a)
        at += b - a
    rest = table == 0
    table[rest] = at + (np.flatnonzero(rest) >> 8) % (SYMBOLS - at)
    return table


@lru_cache(maxsize=1)
def own_symbols() -> int:
    """Symbols below stand for one code point each."""
    return 1 + sum(b - a for a, b in RANGES)


@lru_cache(maxsize=1)
def _sequences() -> list[tuple[str, re.Pattern]]:
    """Per encoding, what one character of UTF-8 looks like in it: a character of a lead byte, then those of continuation bytes."""
    out = []
    for encoding in THROUGH_UTF8:
        shown = {}
        for byte in range(0x80, 0x100):
            try:
                shown[byte] = bytes([byte]).decode(encoding)
            except UnicodeDecodeError:
                shown[byte] = chr(byte)
        of = lambda a, b: "[" + "".join(re.escape(shown[x]) for x in range(a, b)) + "]"  # noqa: B023, E731
        rest = of(0x80, 0xC0)
        out.append((encoding, re.compile(f"{of(0xC2, 0xE0)}{rest}|{of(0xE0, 0xF0)}{rest}{{2}}|{of(0xF0, 0xF5)}{rest}{{3}}")))
    return out


def strict_readings(unit: str) -> list[list[tuple[int, int, str]]]:
    """Per encoding that gives any: (start, end, character) of the unit's sequences that are strict UTF-8, read down to the last layer."""
    out = []
    for encoding, sequence in _sequences():
        tokens = [(i, i + 1, c) for i, c in enumerate(unit)]
        for _ in range(MOST_LAYERS):
            now, at = [], 0
            for m in sequence.finditer("".join(c for _, _, c in tokens)):
                data = _to_bytes(m.group(), encoding)
                try:
                    read = data.decode("utf-8") if data else ""
                except UnicodeDecodeError:
                    continue
                if len(read) == 1:
                    now += tokens[at : m.start()] + [(tokens[m.start()][0], tokens[m.end() - 1][1], read)]
                    at = m.end()
            if not at:
                break
            tokens = now + tokens[at:]
        # Controls and invisible characters prove nothing: they may have come in between later.
        found = [x for x in tokens if x[1] - x[0] > 1 and not "\x80" <= x[2] <= "\x9f" and not IGNORABLE.match(x[2])]
        if found and found not in out:
            out.append(found)
    return out


class Suspects:
    """Sequences of a unit that may be misread, with the symbol of what they may have been; unassigned and combining ones have none."""

    def __init__(self):
        self.cache: dict[str, list[tuple[int, int, int]]] = {}

    def of(self, unit: str) -> list[tuple[int, int, int]]:
        found = self.cache.get(unit)
        if found is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            read = max(strict_readings(unit), key=lambda r: sum(b - a for a, b, _ in r), default=[])
            symbols = [(a, b, int(symbol_table()[ord(c)]), c) for a, b, c in read]
            found = self.cache[unit] = [(a, b, s) for a, b, s, c in symbols if s < own_symbols() or unicodedata.category(c) == "Lo"]
        return found


def symbols_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols with a 0 around each text, code points, where each text begins)."""
    joined = "\x00" + "\x00".join(texts) + "\x00"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    base = 1 + np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    symbols = symbol_table()[points]
    symbols[base - 1] = 0
    return symbols, points, base


def portions(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) in portions of about BATCH_CHARS characters."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= BATCH_CHARS):
            size += len(texts[stop])
            stop += 1
        yield at, texts[at:stop]
        at = stop


def pair_counts(texts: DataFrame) -> DataFrame:
    """pair (first * SYMBOLS + second), reading, n over all rows of the one text column; each task adds up its own before the shuffle.

    reading is the symbol of what a sequence that is strict UTF-8 may have been, for the pairs within and beside it, else 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, suspects, misread = None, Suspects(), {}
        for b in batches:
            for _, own in portions([x for x in b.column(0).to_pylist() if x]):
                symbols, _, base = symbols_of(own)
                pairs = symbols[:-1].astype(np.int64) * SYMBOLS + symbols[1:]
                counts = np.bincount(pairs, minlength=SYMBOLS * SYMBOLS)
                reading = np.zeros(len(symbols) + 1, np.int64)
                for text, start in zip(own, base.tolist()):
                    if not text.isascii():
                        for m in LONG_UNIT.finditer(text):
                            for a, z, s in suspects.of(m.group()):
                                reading[start + m.start() + a : start + m.start() + z] = s
                beside = np.where(reading[:-2] > 0, reading[:-2], reading[1:-1])  # of the pair that begins at each symbol
                at = np.flatnonzero(beside)
                if len(at):
                    np.subtract.at(counts, pairs[at], 1)
                    for k, n in zip(*(x.tolist() for x in np.unique(pairs[at] * SYMBOLS + beside[at], return_counts=True))):
                        misread[k] = misread.get(k, 0) + n
                total = counts if total is None else total + counts
        if total is not None:
            pair = np.flatnonzero(total)
            keys = np.concatenate([pair * SYMBOLS, np.fromiter(misread.keys(), np.int64, len(misread))])
            n = np.concatenate([total[pair], np.fromiter(misread.values(), np.int64, len(misread))])
            for at in range(0, len(keys), 50_000):
                k = keys[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(k // SYMBOLS), pa.array(k % SYMBOLS), pa.array(n[at : at + 50_000])], names=["pair", "reading", "n"])

    return map_batches(texts, run, "pair bigint, reading bigint, n bigint").groupBy("pair", "reading").agg(F.sum("n").alias("n"))


def without_misread(pair: np.ndarray, reading: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, n) without the pairs of sequences whose reading is a character known elsewhere; the others are no misreadings."""
    sure = np.bincount(pair[reading == 0] % SYMBOLS, n[reading == 0], SYMBOLS)
    keep = (reading == 0) | (sure[reading] < LEAST_KNOWN_CHARS)
    kept, of = np.unique(pair[keep], return_inverse=True)
    return kept, np.bincount(of, n[keep], len(kept))


class PairModel:
    """Frequencies of adjacent symbols. At most SYMBOLS ** 2 pairs can occur, whatever the corpus; it is kept sparse."""

    def __init__(self, pair: np.ndarray, n: np.ndarray):
        order = np.argsort(pair)
        self.pair, self.n = np.asarray(pair, np.int64)[order], np.asarray(n, np.float64)[order]
        self.total = max(self.n.sum(), 1.0)

    def prepare(self, rule: GarbleRule) -> PairModel:
        """Adds the tables that a worker needs."""
        first, second = np.zeros(SYMBOLS), np.zeros(SYMBOLS)
        np.add.at(first, self.pair // SYMBOLS, self.n)
        np.add.at(second, self.pair % SYMBOLS, self.n)
        p = self.n / self.total
        usual = p * np.log(self.n * self.total / (first[self.pair // SYMBOLS] * second[self.pair % SYMBOLS]))
        score = np.full(SYMBOLS * SYMBOLS, rule.most, np.float32)
        score[self.pair] = np.where(usual >= rule.usual, -rule.calm, np.clip(np.log(rule.usual / np.maximum(usual, 1e-12)), 0, rule.most))
        # Plain characters are what no misreading gives, so pairs of two of them never count as improbable.
        plain = np.zeros(SYMBOLS, bool)
        plain[: 1 + 0x80] = True
        grid = score.reshape(SYMBOLS, SYMBOLS)
        grid[np.ix_(plain, plain)] = -rule.calm
        lost = [int(symbol_table()[c]) for c in (*range(0x80, 0xA0), 0xFFFD)]
        grid[lost, :] = np.maximum(grid[lost, :], rule.lost)
        grid[:, lost] = np.maximum(grid[:, lost], rule.lost)
        self.score = score
        self.floor = math.log(0.3 / self.total)
        log = np.full(SYMBOLS * SYMBOLS, self.floor, np.float32)
        log[self.pair] = np.log(p)
        self.log = memoryview(log)  # quicker to read one by one than an array, and no larger, however many pairs occur
        self.known = second >= LEAST_KNOWN_CHARS
        self.known[own_symbols() :] = False  # a block known says little of one character
        return self

    def has_pair(self, a: str, b: str) -> bool:
        """Whether the corpus has the pair; the end of a text is an empty string."""
        s = [int(symbol_table()[ord(c)]) if c else 0 for c in (a, b)]
        return self.log[s[0] * SYMBOLS + s[1]] > self.floor + 0.5

    def mean_log(self, text: str) -> float:
        s = symbol_table()[[ord(c) for c in text]].tolist()
        log = self.log
        return sum(log[a * SYMBOLS + b] for a, b in zip(s, s[1:])) / max(1, len(s) - 1)


def segments(scores: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Disjoint maximum-scoring segments [start, end) of at least the least score, in one pass over the positive stretches."""
    found: list[list[float]] = []  # start, end, sum up to the start, sum up to the end
    positive = scores > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], positive, [False]]).astype(np.int8)))
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        now = [a, b, sums[a], sums[b]]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= now[2]:
                j -= 1
            if j < 0 or found[j][3] >= now[3]:
                break
            now = [found[j][0], now[1], found[j][2], now[3]]
            del found[j:]
        found.append(now)
    return [(int(a), int(b)) for a, b, l, r in found if r - l >= least]


def _to_bytes(text: str, encoding: str) -> bytes | None:
    """Bytes that the encoding shows as the text; where a byte has no character, the control of its number stands."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        pass
    out = bytearray()
    for c in text:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if not 0x80 <= ord(c) <= 0x9F:
                return None
            out.append(ord(c))
    return bytes(out)


def inverse_readings(unit: str) -> list[str]:
    """What the unit may have been, one layer down."""
    out = []
    for encoding in THROUGH_UTF8:
        data = _to_bytes(unit, encoding)
        if data is not None:
            try:
                out.append(data.decode("utf-8"))
            except UnicodeDecodeError as e:
                # A unit may begin or end with characters that are right.
                if e.start and len(data) == len(unit):
                    try:
                        out.append(data[: e.start].decode("utf-8") + unit[e.start :])
                    except UnicodeDecodeError:
                        pass
                elif len(data) == len(unit) and len(unit) > 2:
                    try:
                        out.append(unit[0] + data[1:].decode("utf-8"))
                    except UnicodeDecodeError:
                        pass
    for misread, meant in SINGLE_BYTE:
        data = _to_bytes(unit, misread)
        if data is not None:
            try:
                out.append(data.decode(meant))
            except UnicodeDecodeError:
                pass
    if len(unit) >= 4:  # two characters of two bytes at least
        for east in EAST_ASIAN:
            for misread, meant in [*((w, east) for w in WESTERN), (east, "utf-8")]:
                try:
                    read = unit.encode(misread).decode(meant)
                except UnicodeError:
                    continue
                if misread == east or EAST_ASIAN_LETTERS.search(read):
                    out.append(read)
    return [x for x in dict.fromkeys(out) if x != unit]


class Restorer:
    def __init__(self, model: PairModel, rule: GarbleRule):
        self.model, self.rule, self.cache = model, rule, {}

    def unit(self, before: str, unit: str, after: str) -> tuple[str, bool] | None:
        """(restored unit, whether it is evidence that the text was misread), None if it stays. before and after are the neighbouring characters."""
        key = (before, unit, after)
        if key not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            # A soft hyphen may be half a letter, or have come in between later.
            bare = IGNORABLE.sub("", unit)
            found = self._unit(before, unit, after) or (self._unit(before, bare, after) if bare != unit else None)
            if found is None or len(found[0]) >= len(bare):
                found = self._strict(before, unit, after) or (self._strict(before, bare, after) if bare != unit else None) or found
            self.cache[key] = found
        return self.cache[key]

    def _strict(self, before: str, unit: str, after: str) -> tuple[str, bool] | None:
        """The unit with its sequences of strict UTF-8 read, where each gives a known character and the corpus does not know the sequence among its neighbours."""
        if len(unit) < 2:
            return None
        best = None
        for read in strict_readings(unit):
            parts, at, length = [], 0, 0
            for a, b, c in read:
                left, right = unit[a - 1] if a else before, unit[b] if b < len(unit) else after
                if not self.model.known[symbol_table()[ord(c)]]:
                    continue
                usual = self.model.has_pair(left, unit[a]) and self.model.has_pair(unit[b - 1], right)
                if usual and self.model.mean_log(left + c + right) <= self.model.mean_log(left + unit[a:b] + right):
                    continue
                parts += [unit[at:a], c]
                at, length = b, length + b - a
            if at and (best is None or length > best[0]):
                best = length, "".join(parts) + unit[at:]
        return (best[1], True) if best else None

    def _unit(self, before: str, unit: str, after: str) -> tuple[str, bool] | None:
        now, layers = unit, 0
        while layers < self.rule.layers and now and not now.isascii():
            here = self.model.mean_log(before + now + after)
            best = max(((self.model.mean_log(before + x + after), x) for x in inverse_readings(now)), default=None)
            deeper = None
            if best is None or best[0] < here + self.rule.gain:
                # One layer down may look no better than the text if two layers lie on it.
                two = [(self.model.mean_log(before + y + after), y) for x in inverse_readings(now) if not x.isascii() for y in inverse_readings(x)] if len(now) >= 4 else []
                deeper = max(two, default=None)
                if deeper is None or deeper[0] < here + 1.5 * self.rule.gain:
                    break
            now = (deeper or best)[1]
            layers += 1
        if not layers:
            return None
        if len(now) < len(unit):
            return now, True
        # Byte for byte, chance readings exist: capitals must not explain the unit as well, and one letter proves nothing.
        known = self.model.mean_log(before + now + after)
        if known < max(self.model.mean_log(before + unit.lower() + after), self.model.mean_log(before + unit.capitalize() + after)) + self.rule.over_case:
            return None
        # A short word may be rare; it is evidence if nothing in the corpus is like the unit.
        far = len(now) >= self.rule.least_letters and known >= self.model.mean_log(before + unit + after) + 2 * self.rule.gain
        return now, len(now) >= 3 and (far or self.model.mean_log(now) > self.rule.least_known)

    def text(self, text: str, scores: np.ndarray) -> tuple[bool, str, int]:
        """(affected, text as far as restored, runs that stay garbled). scores: of the pairs that end in each character and after the last."""
        runs = segments(scores, self.rule.segment)
        lost = lost_runs(text, runs)
        changes, r, sure, letters = [], 0, False, 0
        for m in UNIT.finditer(text) if runs else ():
            while r < len(runs) and runs[r][1] < m.start():
                r += 1
            if r == len(runs):
                break
            if runs[r][0] <= m.end():
                new = self.unit(text[m.start() - 1 : m.start()] if m.start() else "", m.group(), text[m.end() : m.end() + 1])
                if new is not None:
                    changes.append((m.start(), m.end(), *new))
                    if new[1] and len(new[0]) < m.end() - m.start():
                        sure = True
                    elif new[1]:
                        letters += len(new[0])
        sure_bytes = letters >= self.rule.least_letters
        if not (sure or sure_bytes):
            return lost > 0, text, lost
        parts, at = [], 0
        for a, b, new, strong in changes:
            if sure_bytes or (strong and len(new) < b - a):  # what proves nothing by itself is restored beside what does
                parts += [text[at:a], new]
                at = b
        whole = "".join(parts) + text[at:]
        return True, whole, len(REPLACED_RUN.findall(whole))


def lost_runs(text: str, runs: list[tuple[int, int]]) -> int:
    """Runs of characters that no encoding means inside the improbable segments."""
    n = r = 0
    for m in REPLACED_RUN.finditer(text) if runs else ():
        while r < len(runs) and runs[r][1] < m.start():
            r += 1
        n += r < len(runs) and runs[r][0] <= m.end()
    return n


_RESTORERS: dict[str, Restorer] = {}


def _restorer(key: str, pair: np.ndarray, n: np.ndarray, rule: GarbleRule) -> Restorer:
    """One per model and worker process, whatever the number of tasks."""
    if key not in _RESTORERS:
        _RESTORERS.clear()
        _RESTORERS[key] = Restorer(PairModel(pair, n).prepare(rule), rule)
    return _RESTORERS[key]


def find_garbled(records: DataFrame, id_col: str, text_col: str, corpus: DataFrame | None = None, model: PairModel | None = None, rule: GarbleRule = GarbleRule()) -> DataFrame:
    """id_col, restored (the text as far as it can be restored), n_lost (runs that stay garbled) of each affected row.

    Statistics come from all rows of corpus (one text column), by default the records' own. Null and empty texts are
    never affected. Repeated rows are judged each. Other columns are ignored.
    """
    spark = records.sparkSession
    if model is None:
        model = fit_pairs(corpus if corpus is not None else records.select(F.col(text_col).cast("string")))
    shared, key = spark.sparkContext.broadcast((model.pair, model.n)), uuid.uuid4().hex
    narrow = records.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # A text of plain characters alone cannot have been misread.
    narrow = narrow.filter(F.col("_text").rlike(r"[^\x{0}-\x{7F}]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = _restorer(key, *shared.value, rule)
        score = restorer.model.score
        for whole in batches:
            for k, texts in portions(whole.column(1).to_pylist()):
                b = whole.slice(k, len(texts))
                symbols, _, base = symbols_of(texts)
                scores = score[symbols[:-1].astype(np.int64) * SYMBOLS + symbols[1:]]
                ids, restored, lost = [], [], []
                for i, text in enumerate(texts):
                    hit, new, left = restorer.text(text, scores[base[i] - 1 : base[i] + len(text)])
                    if hit:
                        ids.append(i)
                        restored.append(new)
                        lost.append(left)
                if ids:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids)), pa.array(restored, pa.string()), pa.array(lost, pa.int32())], names=["_id", "restored", "n_lost"])

    return map_batches(narrow, run, f"_id {narrow.schema['_id'].dataType.simpleString()}, restored string, n_lost int").withColumnRenamed("_id", id_col)


def fit_pairs(texts: DataFrame) -> PairModel:
    """Counts over all rows; what is gathered is bounded by the number of symbols and of sequences, not by the corpus."""
    table = pair_counts(texts).toArrow()
    return PairModel(*without_misread(*(table[c].to_numpy() for c in ("pair", "reading", "n"))))

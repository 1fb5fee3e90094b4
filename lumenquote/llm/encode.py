"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Pre-tokenisation uses no regular expression. Every code point gets a class; a small machine reads the
classes and says where a token starts. A code point acts on the machine's state as a function, and functions
compose associatively, so all texts of a batch are scanned at once: the batch is cut into equal stretches,
each stretch is folded to one function for every possible entry state, the functions of the stretches are
chained, and a second sweep from the now known entry states marks the starts. The slices are then merged pair
by pair from a cache; offsets are kept for decoding.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenquote.session import map_batches

# Classes of code points. An apostrophe that may open a contraction has one letter (A1) or two (A2) after it.
# BLANK is U+0020, WHITE any other white space; *_LAST is the last of its run with something after it in the same text.
LETTER, NUMBER, OTHER, A1, A2, BLANK, BLANK_LAST, WHITE, WHITE_LAST, BEGIN = range(10)
# States: what the token under way is. IN_BLANK waits for a token that takes the blank along; C2, C1: letters of a contraction to come; C0: contraction over.
IN_LETTER, IN_NUMBER, IN_OTHER, IN_BLANK, IN_WHITE, C2, C1, C0, AT_BEGIN = range(9)
N_STATES, N_CLASSES = 9, 10

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE_PIECES = 400_000
BATCH_CHARS = 4_000_000

# The letters of the contractions of the pattern.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a token) by class and state."""
    to = np.zeros((N_CLASSES, N_STATES), np.uint8)
    starts = np.ones((N_CLASSES, N_STATES), bool)
    to[BEGIN], starts[BEGIN] = AT_BEGIN, False
    for c, own in ((LETTER, IN_LETTER), (NUMBER, IN_NUMBER), (OTHER, IN_OTHER), (A1, IN_OTHER), (A2, IN_OTHER)):
        to[c] = own
        starts[c, [own, IN_BLANK]] = False
    for c, left in ((A1, C1), (A2, C2)):  # an apostrophe that itself starts a token opens the contraction
        to[c, [IN_LETTER, IN_NUMBER, IN_WHITE, C0, AT_BEGIN]] = left
    to[:, C2], starts[:, C2] = C1, False
    to[:, C1], starts[:, C1] = C0, False
    to[BEGIN, [C2, C1]] = AT_BEGIN
    # In a run of white space only the last starts anew, and a last plain blank joins what comes next.
    for c, goes in ((BLANK, IN_WHITE), (WHITE, IN_WHITE), (BLANK_LAST, IN_BLANK), (WHITE_LAST, IN_WHITE)):
        to[c] = goes
    for c in (BLANK, WHITE):
        starts[c, IN_WHITE] = False
    return to, starts


TO, STARTS = _machine()


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    points = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, sys.maxunicode + 1)))
    for c, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, points):
            a, b = (x if x < 0xD800 else x + 0x800 for x in (m.start(), m.end() - 1))
            table[a : b + 1] = c
    table[0x20] = BLANK
    return table


def classify(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Classes of the code points of several texts; begins marks a filler before each text."""
    cls = class_table()[points]
    cls[begins] = BEGIN
    after = np.append(cls[1:], BEGIN)
    solid = (after <= A2).astype(bool)
    white = (cls == BLANK) | (cls == WHITE)
    cls = np.where(white & solid, cls + 1, cls).astype(np.uint8)
    quotes = np.flatnonzero((points == 0x27) & (cls == OTHER))
    if len(quotes):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        cls[quotes[np.isin(one, [ord(x) for x in ONE_LETTER])]] = A1
        for x in TWO_LETTERS:
            cls[quotes[(one == ord(x[0])) & (two == ord(x[1]))]] = A2
    return cls


def scan_starts(cls: np.ndarray, stretch: int = 2048) -> np.ndarray:
    """True where a token starts: fold stretches to functions, chain them, sweep again from the entry states."""
    n = len(cls)
    rows = -(-n // stretch)
    grid = np.full((rows * stretch), BEGIN, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(rows, stretch).T)
    flat = TO.ravel()
    fold = np.tile(np.arange(N_STATES, dtype=np.uint8), (rows, 1))
    settled = np.zeros(rows, bool)
    for column in grid:  # once two entry states have met they stay together, so most stretches settle within a few steps
        live = np.flatnonzero(~settled)
        if not len(live):
            break
        fold[live] = flat[column[live, None].astype(np.intp) * N_STATES + fold[live]]
        settled[live] = (fold[live] == fold[live, :1]).all(axis=1)
    constant = np.where(settled)[0]
    state = np.full(rows, AT_BEGIN, np.uint8)
    out = np.empty((stretch, rows), bool)
    # A settled stretch ends in one state whatever its entry: its last state is found by the sweep itself.
    ends = _sweep(grid, np.full(rows, AT_BEGIN, np.uint8), None)
    now = AT_BEGIN
    is_constant = np.zeros(rows, bool)
    is_constant[constant] = True
    for r in range(rows):
        state[r] = now
        now = ends[r] if is_constant[r] else fold[r, now]
    _sweep(grid, state, out)
    return out.T.ravel()[:n]


def _sweep(grid: np.ndarray, state: np.ndarray, out: np.ndarray | None) -> np.ndarray:
    to, starts = TO.ravel(), STARTS.ravel()
    for k, column in enumerate(grid):
        at = column.astype(np.intp) * N_STATES + state
        if out is not None:
            out[k] = starts[at]
        state = to[at]
    return state


def pretokenize(texts: list[str]) -> tuple[np.ndarray, np.ndarray, str]:
    """(token starts, owner of each start, joined text); texts are joined with one filler before each."""
    joined = "\x00" + "\x00".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    fillers = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    begins = np.zeros(len(points), bool)
    begins[fillers] = True
    starts = np.flatnonzero(scan_starts(classify(points, begins)))
    return starts, np.searchsorted(fillers, starts, "right") - 1, joined


class PairMerger:
    """Byte-level BPE of one slice by ranks of merged byte strings, with a bounded cache."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        ranks, whole = self.ranks, self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 256:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            joined = [ranks.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
            best = min(joined)
            if best == _NEVER:
                break
            i = joined.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[x] for x in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges through a heap and linked parts, for slices of thousands of bytes."""
        import heapq

        ranks, n = self.ranks, len(piece)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def ids(self, piece: str) -> tuple[int, ...]:
        found = self.cache.get(piece)
        if found is None:
            found = tuple(self.merge(piece.encode("utf-8", "replace")))
            if len(piece) <= 64:
                if len(self.cache) >= CACHE_PIECES:
                    self.cache.clear()
                self.cache[piece] = found
        return found


_NEVER = sys.maxsize
_MERGERS: dict[str, PairMerger] = {}


def merger(path: str) -> PairMerger:
    """One per Python worker and vocabulary file."""
    if path not in _MERGERS:
        _MERGERS[path] = PairMerger(path)
    return _MERGERS[path]


def encode_texts(texts: list[str | None], path: str) -> tuple[list[list[int]], list[list[int]]]:
    """(ids, code point offset of the slice each id belongs to) of each text; null and empty texts give empty lists."""
    ids: list[list[int]] = [[] for _ in texts]
    offsets: list[list[int]] = [[] for _ in texts]
    known, cached = merger(path).ids, merger(path).cache
    at = 0
    while at < len(texts):
        size, stop = 0, at
        while stop < len(texts) and (stop == at or size + len(texts[stop] or "") <= BATCH_CHARS):
            size += len(texts[stop] or "")
            stop += 1
        part = [x or "" for x in texts[at:stop]]
        starts, owner, joined = pretokenize(part)
        if not len(starts):
            at = stop
            continue
        base = np.concatenate([[1], 1 + np.cumsum([len(x) + 1 for x in part])])
        ends = np.append(starts[1:], len(joined))
        last = np.append(owner[1:] != owner[:-1], True)
        ends[last] = base[owner[last] + 1] - 1
        begin = np.searchsorted(owner, np.arange(len(part)))
        stops = np.append(begin[1:], len(owner))
        s, e = starts.tolist(), ends.tolist()
        for k in range(len(part)):
            own, where, zero = ids[at + k], offsets[at + k], int(base[k])
            for i in range(begin[k], stops[k]):
                piece = joined[s[i] : e[i]]
                x = cached.get(piece) or known(piece)
                own.extend(x)
                where.extend((s[i] - zero,) * len(x))
        at = stop
    return ids, offsets


def decode_ids(ids: list[int], path: str) -> str:
    """The text of a list of ids; the inverse of encode_texts for valid Unicode."""
    inverse = getattr(merger(path), "inverse", None)
    if inverse is None:
        inverse = merger(path).inverse = {v: k for k, v in merger(path).ranks.items()}
    return b"".join(inverse[i] for i in ids).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, offsets: bool = False, count_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col and the ids of each text, as a narrow projection without a shuffle.

    Null and empty texts give an empty list (count 0). Strings that look like special tokens are ordinary text;
    special tokens are never added. Repeated rows are encoded each. With offsets, `starts` gives for each id the
    code point at which its slice begins. With count_only, `n_tokens` takes the place of the list. keep names
    further columns that pass through; all others are dropped, so clashing names cannot arise.
    """
    carried = [F.col(id_col).alias("_c0"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep, 1)]]
    narrow = docs.select(*carried, F.col(text_col).cast("string").alias("_text"))
    n_carried = len(carried)
    schema = ", ".join(f"_c{i} {narrow.schema[f'_c{i}'].dataType.simpleString()}" for i in range(len(carried)))
    schema += ", n_tokens int" if count_only else ", ids array<int>" + (", starts array<int>" if offsets else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                ids, where = encode_texts(b.column(n_carried).to_pylist(), vocabulary)
                columns = [b.column(i) for i in range(n_carried)]
                names = [f"_c{i}" for i in range(n_carried)]
                if count_only:
                    columns.append(pa.array([len(x) for x in ids], pa.int32()))
                    names.append("n_tokens")
                else:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                    if offsets:
                        columns.append(pa.array(where, pa.list_(pa.int32())))
                        names.append("starts")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = map_batches(narrow, run, schema)
    for i, c in enumerate((id_col, *keep)):
        out = out.withColumnRenamed(f"_c{i}", c)
    return out

"""Long exact spans shared between records, by recompression.

Every text is cut into tokens, and rounds of renaming turn runs of one symbol and pairs of two into single
symbols. A name is a hash of what it stands for, and which pairs are joined depends on the names alone, so all
tasks of a cluster name equal text equally without talking to each other: a span that occurs twice has the same
symbols inside, save near its ends. For each symbol the stretch of text that decides it is carried along (its
reach). A window of the least length that contains the reach of a symbol contains that symbol wherever the
window occurs. So each text puts out, for every window in it, a symbol of the highest level whose reach lies
inside; where no level has one, the window itself. Two records with a common window put out a common name: no
pair can be lost. Shared names are then verified on the text around them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lumenquote.session import map_batches, written

LEAST = 160
ROUNDS = 4
BATCH_POINTS = 1_000_000
#: Symbols longer than this take no part in a round, so that reaches stay short against the window.
CAPS = (16, 24, 36, 52)
#: A name in more occurrences than this is resolved by exact windows instead of by pairs.
HOT = 64
#: Parts that the occurrences of a name are split into.
SALTS = 16
#: Characters of a text that are moved for an occurrence in it.
PIECE = 4096

_P, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _ONE = np.uint64(30), np.uint64(27), np.uint64(31), np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit scrambling."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(_P)
    up = np.full(n + 1, np.uint64(base))
    down = np.full(n + 1, np.uint64(pow(base, -1, 2**64)))
    up[0] = down[0] = _ONE
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """By code point: 0 separates, 1 is part of a word, 2 is a word by itself (scripts written without blanks)."""
    t = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(0x3000):
        t[c] = chr(c).isalnum()
    t[0x3000:] = 2
    t[0xA640:0xABC0] = 1
    t[0xFF00:0x10000] = 0
    return t


class Names:
    """Content hashes of any stretch of a batch, from prefix sums."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        size = max(BATCH_POINTS, n)
        self.up, self.down = _powers(1 << (size - 1).bit_length())
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + _ONE) * self.up[:n], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo] + (hi - lo).astype(np.uint64) * _M2)


def _reduce(sym, lo, hi, dl, dr, frozen, points, cap, salt):
    """One round: runs of equal symbols, then pairs of a left and a right symbol, become one symbol each."""
    active = (hi - lo <= cap) & ~frozen
    same = (sym[1:] == sym[:-1]) & active[1:] & active[:-1]
    # That a neighbour differs is mostly settled by its nearest character; else by all that decides the neighbour.
    last = len(points) - 1
    near_l = points[np.maximum(lo - 1, 0)] != points[hi - 1]
    near_r = points[np.minimum(hi, last)] != points[lo]
    dl_before, dr_after = np.concatenate([dl[:1], dl[:-1]]), np.concatenate([dr[1:], dr[-1:]])
    new_dl = np.where(active, np.minimum(dl, np.where(near_l, lo - 1, dl_before)), dl)
    new_dr = np.where(active, np.maximum(dr, np.where(near_r, hi + 1, dr_after)), dr)
    dl, dr = new_dl, new_dr
    if same.any():
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        stop = np.append(first[1:], len(sym)) - 1
        count = (stop - first + 1).astype(np.uint64)
        many = count > 1
        sym = np.where(many, mix(sym[first] + count * _M1 + salt), sym[first])
        lo, hi, dl, dr = lo[first], hi[stop], np.minimum.reduceat(dl, first), np.maximum.reduceat(dr, first)
        active = active[first] & ~many
        frozen = frozen[first]
    right = (mix(sym ^ salt) & _ONE).astype(bool)
    left_active, right_active = active & ~right, active & right
    joins = left_active[:-1] & right_active[1:]
    # A left symbol that stays alone depends on what follows it, a right one on what precedes it.
    lone_left = left_active.copy()
    lone_left[:-1] &= ~joins
    lone_right = right_active.copy()
    lone_right[1:] &= ~joins
    dl_before, dr_after = np.concatenate([dl[:1], dl[:-1]]), np.concatenate([dr[1:], dr[-1:]])
    dr = np.where(lone_left, np.maximum(dr, dr_after), dr)
    dl = np.where(lone_right, np.minimum(dl, dl_before), dl)
    at = np.flatnonzero(joins)
    keep = np.ones(len(sym), bool)
    keep[at + 1] = False
    sym, hi, dl, dr = sym.copy(), hi.copy(), dl.copy(), dr.copy()
    sym[at] = mix(sym[at] * _M1 + mix(sym[at + 1]) + salt)
    hi[at] = hi[at + 1]
    dl[at], dr[at] = np.minimum(dl[at], dl[at + 1]), np.maximum(dr[at], dr[at + 1])
    return sym[keep], lo[keep], hi[keep], dl[keep], dr[keep], frozen[keep]


def recompress(points: np.ndarray, gap: np.ndarray, names: Names, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbol, start and end of its reach) by level; gap marks the fillers between texts, which no reach of use crosses."""
    cls = _classes()[points]
    cls[gap] = 0
    starts = np.concatenate([[True], (cls[1:] == 2) | ((cls[1:] == 1) & (cls[:-1] != 1))])
    starts |= gap
    starts[1:] |= gap[:-1]
    lo = np.flatnonzero(starts)
    hi = np.append(lo[1:], len(points))
    sym, frozen = names.of(lo, hi), gap[lo]
    dl, dr = np.where(frozen, lo, lo - 1), np.where(frozen, hi, hi + 1)
    levels = [(sym, dl, dr)]
    for r in range(rounds):
        sym, lo, hi, dl, dr, frozen = _reduce(sym, lo, hi, dl, dr, frozen, points, CAPS[min(r, len(CAPS) - 1)], mix(np.uint64([r + 1]))[0])
        levels.append((sym, dl, dr))
    return levels


def _smallest(key: np.ndarray, low: np.ndarray, high: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Of the symbols inside each open window (starts low to high), the one with the smallest name; before counts the open windows."""
    start = np.unique(np.concatenate([low, high + 1]))  # between two of these, all windows hold the same symbols
    stop = np.append(start[1:], len(before) - 1)
    start = start[before[stop] - before[np.minimum(start, len(before) - 1)] > 0]
    first = np.searchsorted(np.maximum.accumulate(high), start, "left")
    last = np.searchsorted(np.minimum.accumulate(low[::-1])[::-1], start, "right") - 1
    best = np.full(len(start), -1)
    least = np.full(len(start), np.iinfo(np.uint64).max, np.uint64)
    for j in range(int((last - first).max(initial=-1)) + 1):
        i = np.minimum(first + j, len(key) - 1)
        better = (first + j <= last) & (low[i] <= start) & (high[i] >= start) & (key[i] <= least)
        best, least = np.where(better, i, best), np.where(better, key[i], least)
    return np.unique(best[best >= 0])


def choose_names(texts: list[str], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, index of the text, start and end of the named stretch): for every window of the least length, a name decided by it alone."""
    joined = "\x00" + "\x00".join(texts) + "\x00"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.concatenate([[1], 1 + np.cumsum(lengths + 1)])  # where each text begins
    gap = np.zeros(n, bool)
    gap[base - 1] = True
    # Windows that lie within one text, as ones still to be served.
    edge = np.zeros(n + 1, np.int32)
    fits = lengths >= least
    np.add.at(edge, base[:-1][fits], 1)
    np.add.at(edge, (base[:-1] + lengths - least + 1)[fits], -1)
    todo = np.cumsum(edge[:-1]).astype(bool)
    names = Names(points)
    out = []
    for sym, dl, dr in reversed(recompress(points, gap, names)):
        if not todo.any():
            break
        inside = (dr - dl <= least) & (dl >= 0) & (dr <= n)
        sym, dl, dr = sym[inside], dl[inside], dr[inside]
        before = np.concatenate([[0], np.cumsum(todo)])
        low = np.maximum(dr - least, 0)
        used = before[dl + 1] - before[low] > 0
        sym, dl, dr, low = sym[used], dl[used], dr[used], low[used]
        if not len(sym):
            continue
        key = mix(sym ^ names.of(dl, dr))
        best = _smallest(key, low, dl, before)
        out.append((key[best], dl[best], dr[best]))
        edge = np.bincount(low, minlength=n + 1) - np.bincount(dl + 1, minlength=n + 1)
        todo &= np.cumsum(edge[:n]) == 0
    rest = np.flatnonzero(todo)
    if len(rest):
        out.append((names.of(rest, rest + least), rest, rest + least))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    key, dl, dr = (np.concatenate(x) for x in zip(*out))
    owner = np.searchsorted(base, dl, "right") - 1
    return key.view(np.int64), owner, dl - base[owner], dr - base[owner]


def window_names(texts: list[str], lo: list[int], hi: list[int], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first name, second name, row, start) of every window of the least length that contains [lo, hi) in its row's text."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    first = base + np.maximum(np.asarray(hi, np.int64) - least, 0)
    stop = base + np.minimum(np.asarray(lo, np.int64), lengths - least)
    count = np.maximum(stop - first + 1, 0)
    row = np.repeat(np.arange(len(texts)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[row]
    one, two = Names(points).of(at, at + least), Names(points ^ np.uint32(0x155555)).of(at, at + least)
    return one.view(np.int64), two.view(np.int64), row, at - base[row]


def long_fields(records: DataFrame, id_col: str, group_col: str, text_cols: tuple[str, ...] = (), array_cols: tuple[str, ...] = (), least: int = LEAST) -> DataFrame:
    """rec, grp, texts (array of struct<field int, text string>): the fields of at least the least length, of records that have any.

    Null fields and elements count as empty. A record with a null id or group has no partners.
    """
    parts = [F.array(F.struct(F.lit(i).alias("field"), F.col(c).cast("string").alias("text"))) for i, c in enumerate(text_cols)]
    for c in array_cols:
        parts.append(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x, i: F.struct((i + len(text_cols)).alias("field"), x.alias("text"))))
    texts = F.filter(F.concat(*parts), lambda x: F.length(x["text"]) >= least)
    return records.select(F.col(id_col).cast("bigint").alias("rec"), F.col(group_col).cast("bigint").alias("grp"), texts.alias("texts")).filter((F.size("texts") > 0) & F.col("rec").isNotNull() & F.col("grp").isNotNull())


def name_records(records: DataFrame, least: int = LEAST) -> DataFrame:
    """name, rec, grp, field, lo, hi: the names each record of long_fields puts out; a narrow step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat, parent = lists.flatten(), pc.list_parent_indices(lists)
            for texts, field_of, offset in _portions(flat.field(1), least):
                name, owner, lo, hi = choose_names(texts, least)
                if not len(name):
                    continue
                at = offset[owner]
                owner = pa.array(field_of[owner])
                row = parent.take(owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name), b.column(0).take(row), b.column(1).take(row), flat.field(0).take(owner), pa.array((lo + at).astype(np.int32)), pa.array((hi + at).astype(np.int32))],
                    names=["name", "rec", "grp", "field", "lo", "hi"],
                )

    return map_batches(records, run, "name bigint, rec bigint, grp bigint, field int, lo int, hi int")


def _portions(texts: pa.Array, least: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(texts, which text each is, where it begins there) in portions of about BATCH_POINTS code points.

    Longer texts are cut into pieces that overlap by one less than the least length, so every window lies whole in
    one piece; what a window puts out depends on nothing outside it.
    """
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    at, n = 0, len(sizes)
    while at < n:
        if sizes[at] > BATCH_POINTS:
            text = texts[at].as_py()
            for k in range(0, len(text) - least + 1, BATCH_POINTS - least + 1):
                yield [text[k : k + BATCH_POINTS]], np.array([at]), np.array([k])
            at += 1
            continue
        stop, total = at, 0
        while stop < n and sizes[stop] <= BATCH_POINTS and (stop == at or total + sizes[stop] <= BATCH_POINTS):
            total += sizes[stop]
            stop += 1
        yield texts[at:stop].to_pylist(), np.arange(at, stop), np.zeros(stop - at, np.int64)
        at = stop


def text_pieces(records: DataFrame, least: int = LEAST, step: int = PIECE) -> DataFrame:
    """rec, field, piece, text: the fields cut into pieces that begin every `step` characters and overlap, so that what lies
    within twice the least length from a begin in a piece lies in that piece."""
    texts = records.select("rec", F.explode("texts").alias("_x")).select("rec", F.col("_x.field").alias("field"), F.col("_x.text").alias("_text"))
    last = F.floor((F.length("_text") - 1) / step)
    return texts.select("rec", "field", "_text", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece")).select(
        "rec", "field", F.col("piece").cast("int").alias("piece"), F.substring(F.col("_text"), (F.col("piece") * step + 1).cast("int"), F.lit(step + 2 * least)).alias("text")
    )


def shared_occurrences(records: DataFrame, least: int = LEAST, step: int = PIECE) -> DataFrame:
    """name, n, rec, grp, field, lo, hi and the slice of text around it that any common window lies in (at: where it begins).

    Names are written once to the shared folder: counting them (with partial aggregation) and fetching the
    occurrences of those that more than one group has are two reads of it. A hot name is split by a salt, which the few
    names that are shared are repeated for. Slices come from overlapping pieces of the texts, so what an occurrence costs does not depend on the length of its text.
    """
    names = written(name_records(records, least), "names")
    counts = names.groupBy("name").agg(F.min("grp").alias("_g0"), F.max("grp").alias("_g1"), F.count(F.lit(1)).alias("n")).filter("_g0 < _g1").select("name", "n")
    salted = names.withColumn("salt", F.pmod(F.xxhash64("rec"), F.lit(SALTS)))
    counts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    occurrences = salted.join(counts, ["name", "salt"]).dropDuplicates(["name", "salt", "rec", "field", "lo"])
    begin = F.greatest(F.col("hi") - least, F.lit(0))
    occurrences = occurrences.withColumn("at", begin).withColumn("piece", F.floor(F.col("at") / step).cast("int"))
    held = occurrences.join(text_pieces(records, least, step), ["rec", "field", "piece"])
    inside = F.col("at") - F.col("piece") * step
    slice_ = F.substring(F.col("text"), inside + 1, F.col("lo") + least - F.col("at"))
    held = held.select("name", "n", "rec", "grp", "field", "piece", (F.col("lo") - F.col("at")).alias("lo"), (F.col("hi") - F.col("at")).alias("hi"), "at", slice_.alias("slice"))
    return held.dropDuplicates(["rec", "field", "piece", "name", "at", "lo"]).drop("piece")  # resent records; keeps to the join's partitions


def common_length(a: str, a_lo: int, a_hi: int, b: str, b_lo: int, b_hi: int) -> int:
    """Length of the longest common stretch of a and b around their named parts; 0 if these differ."""
    left, right = common_sides(a, a_lo, a_hi, b, b_lo, b_hi)
    return left + (a_hi - a_lo) + right if left >= 0 else 0


def common_sides(a: str, a_lo: int, a_hi: int, b: str, b_lo: int, b_hi: int) -> tuple[int, int]:
    """How far a and b agree before and after their named parts; (-1, -1) if these differ."""
    if a[a_lo:a_hi] != b[b_lo:b_hi]:
        return -1, -1
    left, right = min(a_lo, b_lo), min(len(a) - a_hi, len(b) - b_hi)
    x, y = a[a_lo - left : a_lo][::-1], b[b_lo - left : b_lo][::-1]
    return _prefix(x, y), _prefix(a[a_hi : a_hi + right], b[b_hi : b_hi + right])


def _prefix(x: str, y: str) -> int:
    lo, hi = 0, min(len(x), len(y))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if x[:mid] == y[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _windows(occurrences: DataFrame, least: int, with_text: bool = False) -> DataFrame:
    """one, two (names of a window), offset (of the name in it), rec, grp, field, start; with_text: also name, text and after, the character behind it if the next window is one around the name too."""
    columns = "one bigint, two bigint, offset int, rec bigint, grp bigint, field int, start int" + (", name bigint, text string, after string" if with_text else "")
    names = [c.split(" ")[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                b = whole.slice(k, 2000)
                name, rec, grp, field, lo, hi, at, text = (b.column(i) for i in range(8))
                texts = text.to_pylist()
                one, two, row, start = window_names(texts, lo.to_pylist(), hi.to_pylist(), least)
                if not len(one):
                    continue
                rows = pa.array(row)
                out = [pa.array(one), pa.array(two), pa.array((np.asarray(lo)[row] - start).astype(np.int32)), rec.take(rows), grp.take(rows), field.take(rows), pa.array((np.asarray(at)[row] + start).astype(np.int32))]
                if with_text:
                    same = np.append(row[1:] == row[:-1], False).tolist()
                    places = list(zip(row.tolist(), start.tolist()))
                    out += [name.take(rows), pa.array([texts[i][x : x + least] for i, x in places], pa.string()), pa.array([texts[i][x + least] if s else None for (i, x), s in zip(places, same)], pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return map_batches(occurrences.select("name", "rec", "grp", "field", "lo", "hi", "at", "slice"), run, columns)


def _verified(few: DataFrame, least: int) -> DataFrame:
    """rec_a < rec_b of different groups whose texts around a common name agree over the least length; repeated."""
    columns = ("rec", "grp", "lo", "hi", "slice")
    a, b = (few.select("name", *[F.col(c).alias(f"{c}_{x}") for c in columns]) for x in "ab")
    tried = a.join(b, "name").filter("rec_a < rec_b AND grp_a <> grp_b").select("rec_a", "rec_b", "slice_a", "lo_a", "hi_a", "slice_b", "lo_b", "hi_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = [common_length(*x) >= least for x in zip(*(c.to_pylist() for c in batch.columns[2:]))]
            yield batch.select(["rec_a", "rec_b"]).filter(pa.array(right, pa.bool_()))

    return map_batches(tried, verify, "rec_a bigint, rec_b bigint")


def shared_pairs(records: DataFrame, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """rec_a < rec_b of different groups that have an identical span of at least the least length within one field of each.

    records comes from long_fields. Resent records (same rec and grp) count once. Pairs of a name with up to `hot`
    occurrences are verified on the text around it; a name with more goes through its windows of the least
    length, joined by equality of their text, so that only true pairs are formed. Nothing is capped.
    """
    occurrences = written(shared_occurrences(records, least), "occurrences")
    found = _verified(occurrences.filter(F.col("n") <= hot), least)
    many = _windows(occurrences.filter(F.col("n") > hot), least, with_text=True).dropDuplicates(["name", "one", "two", "offset", "rec", "grp"])
    key = ["name", "offset", "text"]
    x, y = (many.select(*key, *[F.col(c).alias(f"{c}_{side}") for c in ("after", "rec", "grp")]) for side in "ab")
    # Of the windows that two records have in common around a name only the last makes the pair.
    last = "rec_a < rec_b AND grp_a <> grp_b AND NOT coalesce(after_a = after_b, false)"
    return found.unionByName(x.join(y, key).filter(last).select("rec_a", "rec_b")).distinct()


def shared_links(records: DataFrame, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """rec, rep, n_records: the pairs of shared_pairs in a form that grows with the records, not with the square of a passage's.

    A pair of a name with up to `hot` occurrences is a link from its larger to its smaller record (n_records 2). Of
    a name with more, every record that has a window is linked to the least record that has it (rep may be rec itself, or one of its
    own group), with the number of records of the largest such class; any two of a class are a pair if of different groups.
    """
    occurrences = written(shared_occurrences(records, least), "occurrences")
    few = _verified(occurrences.filter(F.col("n") <= hot), least).select(F.col("rec_b").alias("rec"), F.col("rec_a").alias("rep"), F.lit(2).cast("bigint").alias("n_records"))
    windows = _windows(occurrences.filter(F.col("n") > hot), least).select("one", "two", "rec", "grp").distinct()
    classes = windows.groupBy("one", "two").agg(F.min("grp").alias("_g0"), F.max("grp").alias("_g1"), F.min("rec").alias("rep"), F.count(F.lit(1)).alias("n_records")).filter("_g0 < _g1")
    many = windows.join(classes.select("one", "two", "rep", "n_records"), ["one", "two"]).select("rec", "rep", "n_records")
    return few.unionByName(many).groupBy("rec", "rep").agg(F.max("n_records").alias("n_records"))


def shared_stretches(records: DataFrame, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """rec, field, start, stop: stretches of at least the least length that a record of another group has too; together they hold every shared window.

    A name with up to `hot` occurrences is settled by the texts around them, one with more by exact windows whose
    groups' least and greatest differ, without forming pairs.
    """
    occurrences = written(shared_occurrences(records, least), "occurrences")
    few = occurrences.filter(F.col("n") <= hot)
    columns = ("rec", "grp", "field", "at", "lo", "hi", "slice")
    a, b = (few.select("name", *[F.col(c).alias(f"{c}_{x}") for c in columns]) for x in "ab")
    tried = a.join(b, "name").filter("rec_a < rec_b AND grp_a <> grp_b").select(*[f"{c}_{x}" for x in "ab" for c in columns if c != "grp"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rec_a, field_a, at_a, lo_a, hi_a, a, rec_b, field_b, at_b, lo_b, hi_b, b in zip(*(c.to_pylist() for c in batch.columns)):
                left, right = common_sides(a, lo_a, hi_a, b, lo_b, hi_b)
                if left >= 0 and left + hi_a - lo_a + right >= least:
                    out += [(rec_a, field_a, at_a + lo_a - left, at_a + hi_a + right), (rec_b, field_b, at_b + lo_b - left, at_b + hi_b + right)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["rec", "field", "start", "stop"])

    found = map_batches(tried, measure, "rec bigint, field int, start int, stop int")
    windows = _windows(occurrences.filter(F.col("n") > hot), least).select("one", "two", "rec", "grp", "field", "start")
    both = windows.groupBy("one", "two").agg(F.min("grp").alias("_g0"), F.max("grp").alias("_g1")).filter("_g0 < _g1").select("one", "two")
    exact = windows.join(both, ["one", "two"]).select("rec", "field", "start", (F.col("start") + least).alias("stop"))
    return found.unionByName(exact).distinct()


def shared_share(records: DataFrame, totals: DataFrame, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """rec, n_chars, shared_chars, shared_share: how much of each record lies in spans that another group has too.

    totals has rec and n_chars of every record, those without long fields included; their share is 0, and null for
    records without any text.
    """
    stretches = shared_stretches(records, least, hot)
    earlier = Window.partitionBy("rec", "field").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("stop").over(earlier), F.lit(0))
    # Each stretch adds what those that begin before it in the same field did not reach.
    added = stretches.withColumn("_new", F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), reached))).groupBy("rec").agg(F.sum("_new").alias("shared_chars"))
    out = totals.dropDuplicates(["rec"]).join(added, "rec", "left")
    shared = F.coalesce("shared_chars", F.lit(0))
    return out.select("rec", "n_chars", shared.alias("shared_chars"), (shared / F.when(F.col("n_chars") > 0, F.col("n_chars"))).alias("shared_share"))

"""One consistent form for text that looks the same but differs in its characters.

The spellings of all words of the corpus are counted by their look. Where a look is spelled in more than one way, its
commonest clean spelling goes into a vocabulary trie, whose edges are looks. A weighted edit automaton reads each token
through the trie: a character takes the edges of its look at no cost, whatever letter it is, and characters that cannot
be seen take none; characters that look nearly alike cost a half, other edits one. Of the words reached at the least cost
within the bound (0 by default) the commonest is the token's canonical spelling. Tokens that reach no word are normalised
by a table, which keeps each token in its own script.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenquote.session import map_batches, written

# Letters of other scripts and the Latin letter they look like.
CYRILLIC_ALIKE = "АВЕЅІЈКМНОРСТУХԌԚԜаеорсухіјѕһԁԛԝӀ"
CYRILLIC_LATIN = "ABESIJKMHOPCTYXGQWaeopcyxijshdqwI"
GREEK_ALIKE = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορχϳ"
GREEK_LATIN = "ABEZHIKMNOPTYXavopxj"
ARMENIAN_ALIKE = "ՍՏՕսհցօ"
ARMENIAN_LATIN = "USOuhgo"
CHEROKEE_ALIKE = "ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ"
CHEROKEE_LATIN = "ABCDEHJKLMPRSTVWZ"
#: Letters that are written in place of one of their own script or of Greek mu.
OTHER_ALIKE = "µɑɡℎ"
OTHER_LATIN = "μagh"
#: Characters that look nearly alike, at half the cost of another edit.
NEARLY = ("0O", "0o", "1I", "1l", "Il", "5S", "8B", "uv")
UNSEEN = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"

NEAR_COST, EDIT_COST = 0.5, 1.0
VOCABULARY_PART = 50_000
CACHE_TOKENS = 300_000
COUNTED_TOKENS = 300_000
TOKEN = re.compile(r"[^\W_]+(?:[^\W_]|[\u00ad\u0300-\u036f\u200b-\u200f\u2060-\u2064\ufeff])*")

_OTHER = dict(zip(OTHER_ALIKE, OTHER_LATIN))
_LATIN = {a: b for x, y in ((CYRILLIC_ALIKE, CYRILLIC_LATIN), (GREEK_ALIKE, GREEK_LATIN), (ARMENIAN_ALIKE, ARMENIAN_LATIN), (CHEROKEE_ALIKE, CHEROKEE_LATIN)) for a, b in zip(x, y)}
_NEAR = {(a, b) for p in NEARLY for a, b in (p, p[::-1])}


@lru_cache(maxsize=65_536)
def plain_of(c: str) -> str:
    """What one character is written as in any script, from rules; marks come decomposed.

    Wide, narrow and mathematical forms, Roman numerals and ligatures of letters become plain letters, every kind of blank
    U+0020, format characters and invisible fillers nothing. Superscripts, quotation marks, dashes and case look different and stay.
    """
    kind = unicodedata.category(c)
    if kind == "Zs":
        return " "
    if kind == "Cf" or c in UNSEEN or "\ufe00" <= c <= "\ufe0f":
        return ""
    d = unicodedata.decomposition(c)
    tag, _, parts = d.partition(" ") if d.startswith("<") else ("", "", d)
    text = "".join(chr(int(x, 16)) for x in parts.split())
    ligature = tag == "<compat>" and text.isalpha() and (kind == "Nl" or (kind in ("Ll", "Lu", "Lt") and len(text) > 1))
    if tag in ("<wide>", "<narrow>") or ligature or (tag == "<font>" and "\U0001d400" <= c <= "\U0001d7ff") or (d and not tag):
        return "".join(map(plain_of, text))
    return _OTHER.get(c, c)


@lru_cache(maxsize=65_536)
def look_of(c: str) -> str:
    """The look of one character: its plain form with letters of other scripts as the Latin ones they look like."""
    return "".join(_LATIN.get(x, x) for x in plain_of(c))


def look(text: str) -> str:
    """Equal for texts that look the same; marks are decomposed and in canonical order."""
    return text if text.isascii() else unicodedata.normalize("NFD", "".join(map(look_of, text)))


@lru_cache(maxsize=65_536)
def _script(c: str) -> str:
    """Script of a letter, empty for digits and marks."""
    return unicodedata.name(c, "OTHER").split(" ")[0] if c.isalpha() else ""


_OWN = {(_script(a), b): a for a, b in _LATIN.items()}
_SHARED = set(_LATIN) | set(_LATIN.values())


def by_table(text: str) -> str:
    """Plain forms, composed, with each token's look-alike letters brought into the token's own script."""
    if text.isascii():
        return text
    plain = unicodedata.normalize("NFC", "".join(map(plain_of, text)))
    return TOKEN.sub(lambda m: _in_one_script(m.group()), plain)


def _in_one_script(token: str) -> str:
    """The token in the script of the letters that no other script has, else of most of its letters; Latin if in doubt."""
    if token.isascii():
        return token
    parts = unicodedata.normalize("NFD", token)
    scripts = Counter(_script(c) for c in parts if c.isalpha())
    if len(scripts) < 2:
        return token
    sure = Counter(_script(c) for c in parts if c.isalpha() and c not in _SHARED)
    main = max(sure or scripts, key=lambda s: ((sure or scripts)[s], s == "LATIN", s))
    out = []
    for c in parts:
        if c in _SHARED and _script(c) != main:
            seen = _LATIN.get(c, c)
            c = seen if main == "LATIN" else _OWN.get((main, seen), c)
        out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


def clean_word(word: str) -> bool:
    """A word that may be a canonical spelling: the table leaves it as it is and its letters are of one script."""
    return word.isascii() or (by_table(word) == word and len({_script(c) for c in unicodedata.normalize("NFD", word) if c.isalpha()}) < 2)


class Trie:
    """Words by their look; `word` and `weight` stand at the nodes where a word ends, the commonest of those with one look."""

    def __init__(self, words: dict[str, int]):
        self.next: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.weight: list[int] = [0]
        for w, n in words.items():
            at = 0
            for c in look(w):
                to = self.next[at].get(c)
                if to is None:
                    to = len(self.next)
                    self.next[at][c] = to
                    self.next.append({})
                    self.word.append(None)
                    self.weight.append(0)
                at = to
            if self.word[at] is None or (-n, w) < (-self.weight[at], self.word[at]):
                self.word[at], self.weight[at] = w, n

    def closest(self, token: str, most: float = 0) -> tuple[str, float] | None:
        """(commonest word at the least cost, that cost), None beyond `most`. Ties go to the first word in order."""
        states: dict[int, float] = {0: 0.0}
        if most:
            self._skip(states, most)
        for seen in look(token):  # characters that cannot be seen move nothing and cost nothing
            after: dict[int, float] = {}
            for node, cost in states.items():
                to = self.next[node].get(seen)
                if to is not None and after.get(to, most + 1) > cost:  # the same look: free
                    after[to] = cost
                if most:
                    if cost + EDIT_COST <= most and after.get(node, most + 1) > cost + EDIT_COST:  # a character too many
                        after[node] = cost + EDIT_COST
                    for other, to in self.next[node].items():  # another character
                        dear = cost + (NEAR_COST if (seen, other) in _NEAR else EDIT_COST)
                        if other != seen and dear <= most and after.get(to, most + 1) > dear:
                            after[to] = dear
            if most:
                self._skip(after, most)
            if not after:
                return None
            states = after
        ends = [(cost, -self.weight[node], self.word[node]) for node, cost in states.items() if self.word[node] is not None]
        if not ends:
            return None
        cost, _, word = min(ends)
        return word, cost

    def _skip(self, states: dict[int, float], most: float) -> None:
        """A character missing from the token."""
        todo = list(states)
        while todo:
            node = todo.pop()
            cost = states[node] + EDIT_COST
            if cost <= most:
                for to in self.next[node].values():
                    if states.get(to, most + 1) > cost:
                        states[to] = cost
                        todo.append(to)


class Canonizer:
    def __init__(self, words: dict[str, int], most: float = 0):
        self.trie, self.most, self.cache = Trie(words), most, {}

    def token(self, token: str) -> str:
        found = self.cache.get(token)
        if found is None:
            hit = self.trie.closest(token, self.most)
            found = hit[0] if hit else by_table(token)
            if len(self.cache) >= CACHE_TOKENS:
                self.cache.clear()
            self.cache[token] = found
        return found

    def text(self, text: str) -> str:
        """Canonical tokens, and what lies between them by the table."""
        if text.isascii():
            return TOKEN.sub(lambda m: self.token(m.group()), text)
        out, at = [], 0
        for m in TOKEN.finditer(text):
            if m.start() > at:
                out.append(by_table(text[at : m.start()]))
            out.append(self.token(m.group()))
            at = m.end()
        out.append(by_table(text[at:]))
        return "".join(out)

    def cut(self, quote: str) -> tuple[str, str, str]:
        """(look of a token that the quote's beginning may have cut, canonical middle, look of one that its end may have cut)."""
        tokens = list(TOKEN.finditer(quote))
        lo, hi, left, right = 0, len(quote), "", ""
        if tokens and not by_table(quote[: tokens[0].start()]):
            left, lo = look(tokens[0].group()), tokens[0].end()
        if tokens and tokens[-1].start() >= lo and not by_table(quote[tokens[-1].end() :]):
            right, hi = look(tokens[-1].group()), tokens[-1].start()
        return left, self.text(quote[lo:hi]), right


def holds_alike(canonical_text: str, left: str, middle: str, right: str) -> bool:
    """Whether the text holds the canonical middle between a token that ends as left looks and one that begins as right looks."""
    if not middle and not right:  # a single token, cut at both ends perhaps
        return _ends_whole(look(canonical_text), left)
    at = canonical_text.find(middle)
    while at >= 0:
        after = at + len(middle)
        before = look(canonical_text[max(0, at - 2 * len(left) - 8) : at])
        behind = look(canonical_text[after : after + 2 * len(right) + 8])
        if before.endswith(left) and behind.startswith(right) and not (right and unicodedata.combining(behind[len(right) : len(right) + 1] or " ")):
            return True
        at = canonical_text.find(middle, at + 1)
    return False


def _ends_whole(seen: str, part: str) -> bool:
    at = seen.find(part)
    while at >= 0:
        if not unicodedata.combining(seen[at + len(part) : at + len(part) + 1] or " "):
            return True
        at = seen.find(part, at + 1)
    return False


def count_spellings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """look, word, clean, n of the words of one text column; each task adds up its own before the shuffle."""

    def rows(counts: Counter) -> pa.RecordBatch:
        words = list(counts)
        looks, clean = [look(w) for w in words], [clean_word(w) for w in words]
        return pa.RecordBatch.from_arrays([pa.array(looks, pa.string()), pa.array(words, pa.string()), pa.array(clean, pa.bool_()), pa.array(counts.values(), pa.int64())], names=["look", "word", "clean", "n"])

    counts: Counter = Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            if text:
                counts.update(TOKEN.findall(text))
        if len(counts) > COUNTED_TOKENS:
            yield rows(counts)
            counts.clear()
    yield rows(counts)


def fit_vocabulary(texts: DataFrame, every: bool = False) -> DataFrame:
    """look, word, n: of each look that the one text column spells in more than one way, the commonest clean spelling (ties: the first).

    Counted over all rows, whatever their number and length. Looks that all rows spell alike need no entry, as nothing
    is to be chosen; `every` keeps them too, for bounds above 0. The table is written once to the shared folder.
    """
    counts = map_batches(texts, count_spellings, "look string, word string, clean boolean, n bigint").groupBy("look", "word", "clean").agg(F.sum("n").alias("n"))
    best = F.min(F.when(F.col("clean"), F.struct((-F.col("n")).alias("less"), "word")))
    looks = counts.groupBy("look").agg(best.alias("best"), F.count(F.lit(1)).alias("spellings")).filter("best IS NOT NULL")
    looks = looks if every else looks.filter("spellings > 1")
    return written(looks.select("look", "best.word", (-F.col("best.less")).alias("n")), "vocabulary")


_CANONIZERS: dict[str, Canonizer] = {}


def _canonizer(key: str, words: dict[str, int], most: float) -> Canonizer:
    """One per vocabulary and worker process, whatever the number of tasks."""
    if key not in _CANONIZERS:
        while len(_CANONIZERS) > 1:
            _CANONIZERS.pop(next(iter(_CANONIZERS)))
        _CANONIZERS[key] = Canonizer(words, most)
    return _CANONIZERS[key]


def vocabulary_parts(vocabulary: DataFrame, size: int = VOCABULARY_PART) -> Iterator[tuple[str, object]]:
    """(key, broadcast words) of each part of about `size` looks; what is gathered and broadcast at a time is no larger, however many there are."""
    n = -(-vocabulary.count() // size)
    for i in range(max(1, n)):
        own = vocabulary if n <= 1 else vocabulary.filter(F.pmod(F.xxhash64("look"), F.lit(n)) == i)
        table = own.select("word", "n").toArrow()
        yield uuid.uuid4().hex, vocabulary.sparkSession.sparkContext.broadcast(dict(zip(table["word"].to_pylist(), table["n"].to_pylist())))


def canonical_columns(df: DataFrame, columns: dict[str, str], vocabulary: DataFrame, most: float = 0, size: int = VOCABULARY_PART) -> DataFrame:
    """df with, for each text column, a new column of its canonical form; null stays null. A narrow step per part of the vocabulary.

    A look is in one part only, and neither the table nor a canonical spelling changes a look, so the parts can be applied in turn.
    """
    named = df.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(df.columns)], *[F.col(c).cast("string").alias(f"_n{k}") for k, c in enumerate(columns)])
    width, names = len(df.columns), named.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema)

    def step(key: str, shared) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            canon = _canonizer(key, shared.value, most)
            for whole in batches:
                for k in range(0, whole.num_rows, 2000):
                    b = whole.slice(k, 2000)
                    new = [pa.array([None if x is None else canon.text(x) for x in c.to_pylist()], pa.string()) for c in b.columns[width:]]
                    yield pa.RecordBatch.from_arrays([*b.columns[:width], *new], names=names)

        return run

    for key, shared in vocabulary_parts(vocabulary, size):
        named = map_batches(named, step(key, shared), schema)
    return named.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(df.columns)], *[F.col(f"_n{k}").alias(n) for k, n in enumerate(columns.values())])


def quotes_that_only_look_alike(evidence: DataFrame, sources: DataFrame, vocabulary: DataFrame, size: int = VOCABULARY_PART) -> DataFrame:
    """answer_id, line_no of quotes that are no exact passage of the cited source's text but look exactly like one.

    Decided on canonical forms alone: the quote's canonical middle must stand in the canonical text, between tokens
    that end and begin with the looks of the tokens its ends may have cut. Null or empty quotes, null texts and
    citations without a source give no row; resent rows count once. Texts of plain characters alone look alike only
    if they are equal, so such pairs go no further; nothing is sampled.
    """
    e = evidence.select("answer_id", "line_no", "source_index", "quote").filter(F.length("quote") > 0)
    s = sources.select("answer_id", "source_index", "text").filter(F.length("text") > 0)
    other = r"[^\x{0}-\x{7F}]"
    pairs = e.join(s, ["answer_id", "source_index"]).filter(~F.contains("text", F.col("quote")) & (F.col("quote").rlike(other) | F.col("text").rlike(other))).select("answer_id", "line_no", "quote", "text")
    types = {f.name: f.dataType.simpleString() for f in pairs.schema}
    if vocabulary.count() > size:
        formed = canonical_columns(pairs, {"quote": "_q", "text": "_t"}, vocabulary, size=size)
        pairs = formed.select("answer_id", "line_no", F.col("_q").alias("quote"), F.col("_t").alias("text"))
        key, shared = "", pairs.sparkSession.sparkContext.broadcast({})  # nothing is left to be chosen
    else:
        key, shared = next(vocabulary_parts(vocabulary, size))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = _canonizer(key, shared.value, 0)
        last, form = None, ""
        for b in batches:
            keep = []
            for quote, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if text != last:  # quotes of one source follow each other
                    last, form = text, canon.text(text)
                keep.append(holds_alike(form, *canon.cut(quote)))
            yield b.select(["answer_id", "line_no"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(pairs, same, f"answer_id {types['answer_id']}, line_no {types['line_no']}").distinct()

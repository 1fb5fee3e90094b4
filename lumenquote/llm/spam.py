"""Keyword-stuffed pages, link lists and product tag lists among posts.

A first pass counts, per language, in how many documents each word occurs; words in a tenth of a language's
documents or more are its function words (with a floor on the number of documents). It also counts how repetitive, varied and separated a language's documents
are; where a language usually lies near a limit, its limit is set off by the quartiles. The second pass reads each
document whole, sorts its lines into sentences of its language, code or logs, and the rest, and tests the rest by the
share of the top words and of repeated word pairs, duplicate items, link text, separators and missing function words.
Sentences and the rest together are tested for being mostly repetition, as stuffed keywords may hold function words.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenquote.session import map_batches, written

WORD = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uac00-\ud7af]|[^\W\d_]+")
LINK = re.compile(r"(?:https?://|www\.)[^\s<>\"'\])]+", re.I)
MARKUP = re.compile(r"</?[a-z][^>]*>|\[/?url[^\]]*\]", re.I)
HASHTAG = re.compile(r"#\w{3,}")
SEPARATOR = re.compile(r"[;,|#•·]|\s[-–—/~*+>]+\s")
ITEM_END = re.compile(r"[;,|\n.!?]| - ")
#: A line of a log, code or a measured part, by its beginning or all of it; and code by what stands anywhere.
LOG = r"\W*(?:\d{4}-\d\d-\d\d[ T]\d\d:\d\d|\[?\d\d:\d\d:\d\d)"
PART = r"\s*(?:[-*+]\s*)?\d+\s*(?i:x|×|Stk\.?|pcs\.?)\s+\S.*\d\s*(?i:mm|cm|m|kg|g|V|A|W|Ω)\b"
CODE_LINE = r"\s{4,}|\t|\s*(?:\$ |>>> |[{}\[\]();]+\s*$|</?(?:pre|code|div|span)\b)|[^;]*;\s*$|\s*(?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE|GROUP BY|ORDER BY|HAVING|JOIN|LIMIT)\b"
NO_PROSE, CODE_LINE = re.compile(f"{LOG}|{PART}"), re.compile(CODE_LINE)
CODE_PART = re.compile(r"[{}]\s*$|\w\(.*\)|==|&&|::|->|=>|\\[a-zA-Z]+[ {_^(]")
ASCII_WORD = re.compile("[a-z]+")


@dataclass(frozen=True)
class SpamLimits:
    """Thresholds; shares are of words unless said otherwise. Those of MEASURES are the strictest, each language's are fitted."""

    function_df: float = 0.10  # a word in so many of a language's documents is a function word
    least_docs: int = 30  # a language with fewer documents uses the words of all others
    sentence_part: float = 0.6  # a line with less than this part of its language's usual function share is no sentence
    least_words: int = 8
    top_words: float = 0.30  # share of the five commonest words
    repeated_pairs: float = 0.35  # share of word pairs that occur before in the block
    duplicate_items: float = 0.30
    variety: float = 0.55  # distinct words by words, beside separators
    plain_variety: float = 0.55  # the same without separators
    link_text: float = 0.30  # characters in links and link markup
    least_links: int = 3
    separators: float = 0.15  # separators by words
    least_hashtags: int = 5
    code_part: float = 0.3  # a paragraph with so many lines of code, logs or parts is none of ours
    spam_share: float = 0.5  # of the document's characters
    whole_repeated: float = 0.5  # share of repeated word pairs, or of duplicate items, in the text of all lines
    least_fitted: int = 100  # documents that a language's limits are fitted on; with fewer, those of all documents hold
    most_raised: float = 1.5  # limits rise to so many times the general ones at most, however much spam a language has
    spread: float = 2.0  # a language's limit lies at least so many times (upper quartile - median) above its median
    least_in_sentence: int = 3  # different function words of a full sentence
    least_distinct: int = 5  # different function words that show a language other than the declared one
    most_languages: int = 4  # a text is scored by so many languages at most: those it has most function words of


#: Thresholds that are fitted per language; BINS steps of the share are counted.
#: top_words is not: the commonest words of ordinary text are function words, which the tested lines lack.
MEASURES = ("repeated_pairs", "duplicate_items", "plain_variety", "link_text", "separators")
BINS = 50
#: Declared languages that name none.
POOLS = ("", "und", "mul", "mis", "zxx")
LANGUAGE = re.compile("[a-z]{2,3}")
COUNTED_WORDS = 300_000


def language_key(lang: str | None) -> str:
    """Declared language in lower case without region; empty where unknown. No more than 26 ** 2 + 26 ** 3 + 1 keys exist."""
    key = re.split(r"[-_]", (lang or "").strip().lower())[0]
    return key if LANGUAGE.fullmatch(key) else ""


def words_of(text: str) -> list[str]:
    low = text.lower()
    if "://" in low or "www." in low:
        low = LINK.sub(" ", low)
    return (ASCII_WORD if low.isascii() else WORD).findall(low)


def measures_of(text: str, words: list[str]) -> tuple[float, ...]:
    """The MEASURES of a text, a higher one being more like spam (variety is taken from 1)."""
    n = max(1, len(words))
    pairs = list(zip(words, words[1:]))
    items = [x for x in map(str.strip, ITEM_END.split(text.lower())) if x]
    links = LINK.findall(text) if "://" in text or "www." in text.lower() else []
    in_links = sum(map(len, links)) + (sum(map(len, MARKUP.findall(text))) if "<" in text or "[" in text else 0)
    return (
        1 - len(set(pairs)) / max(1, len(pairs)), 1 - len(set(items)) / max(1, len(items)),
        1 - len(set(words)) / n, in_links / len(text), len(SEPARATOR.findall(text)) / n,
    )


def count_document_words(batches: Iterator[pa.RecordBatch], least_words: int = SpamLimits.least_words) -> Iterator[pa.RecordBatch]:
    """Language, word, documents with the word; the empty word counts the documents, those with # the steps of each measure.

    Each task adds up its own before the shuffle.
    """
    seen: dict[str, Counter] = defaultdict(Counter)

    def rows() -> pa.RecordBatch:
        found = [(lang, w, n) for lang, own in seen.items() for w, n in own.items()]
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.string()), pa.array([r[1] for r in found], pa.string()), pa.array([r[2] for r in found], pa.int64())], names=["lang", "word", "n"])

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if text and not text.isspace():
                own = seen[language_key(lang)]
                words = words_of(text)
                own.update(set(words))
                own[""] += 1
                if len(words) >= least_words:
                    own.update(f"#{i}:{min(BINS, int(x * BINS))}" for i, x in enumerate(measures_of(text, words)))
        if sum(map(len, seen.values())) > COUNTED_WORDS:
            yield rows()
    yield rows()


def fit_limits(rows: list, limits: SpamLimits) -> dict[str, SpamLimits]:
    """Limits of each language from (lang, step, n); under "*" those of all documents, for languages not among them.

    Median and quartile are not moved much by the spam itself while it is less than a quarter of a language's documents;
    beyond that, most_raised bounds them.
    """
    steps: dict[tuple[str, int], Counter] = defaultdict(Counter)
    for lang, step, n in rows:
        i, at = (int(x) for x in step[1:].split(":"))
        for k in {lang, "*"}:
            steps[k, i][at] += n
    out = {}
    for lang in {k for k, _ in steps} | {"*"}:
        fitted = {}
        for i, name in enumerate(MEASURES):
            counted, whole = sorted(steps[lang, i].items()), sum(steps[lang, i].values())
            if whole < limits.least_fitted:
                break
            half, upper = (next(at for k, (at, _) in enumerate(counted) if sum(n for _, n in counted[: k + 1]) >= q * whole) / BINS for q in (0.5, 0.75))
            usual = half + limits.spread * (upper - half) + 1 / BINS
            least = 1 - limits.plain_variety if name == "plain_variety" else getattr(limits, name)
            limit = max(least, min(usual, limits.most_raised * least))
            fitted[name] = 1 - limit if name == "plain_variety" else limit
        whole = max(limits.whole_repeated, fitted.get("repeated_pairs", 0), fitted.get("duplicate_items", 0))
        if fitted or lang == "*":
            out[lang] = replace(limits, **fitted, whole_repeated=whole)
    return out


class Functions(dict):
    """(function words, their usual share of a document's distinct words) by language; `languages` by function word."""

    def __init__(self, words: dict[str, tuple[frozenset[str], float]]):
        super().__init__(words)
        self.languages: dict[str, list[str]] = defaultdict(list)
        for lang, (own, _) in words.items():
            for w in own:
                self.languages[w].append(lang)

    def __reduce__(self):
        return Functions, (dict(self),)

    def closest(self, words: set[str], most: int, least: int = 1) -> list[tuple[frozenset[str], float]]:
        """Those of the languages that the text has most different function words of, at least `least`; ties by name.

        What this costs goes by the words that languages share, not by the number of languages.
        """
        hits = Counter(lang for w in words for lang in self.languages.get(w, ()))
        return [self[k] for k, n in sorted(hits.items(), key=lambda x: (-x[1], x[0]))[:most] if n >= least]


def function_words(docs: DataFrame, text_col: str, lang_col: str, limits: SpamLimits) -> tuple[Functions, dict[str, SpamLimits]]:
    """(function words and their usual share by language, the limits of each language), from all documents.

    The result is small whatever the input: there are at most 26 ** 2 + 26 ** 3 + 1 language keys, and a language has at
    most (mean distinct words of a document) / function_df function words and BINS + 1 steps of each measure.
    """
    counts = map_batches(docs.select(F.col(lang_col).cast("string"), F.col(text_col).cast("string")), lambda batches: count_document_words(batches, limits.least_words), "lang string, word string, n bigint")
    counts = written(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    step = F.col("word").startswith("#")
    by_lang = counts.groupBy("lang").agg(F.max(F.when(F.col("word") == "", F.col("n"))).alias("docs"), F.sum(F.when(~step & (F.col("word") != ""), F.col("n"))).alias("all_words"))
    by_lang = F.broadcast(by_lang.filter(F.col("docs") >= limits.least_docs))  # one row a language key
    often = counts.filter("word <> '' AND n >= 3").filter(~step).join(by_lang, "lang").filter(F.col("n") >= limits.function_df * F.col("docs"))
    steps = counts.filter(step)
    rare = steps.join(by_lang, "lang", "left_anti").groupBy("word").agg(F.sum("n").alias("n")).select(F.lit("*").alias("lang"), "word", "n")
    rows = steps.join(by_lang, "lang").select("lang", "word", "n").unionByName(rare).collect()
    return pick_languages(often.select("lang", "word", "n", "docs", "all_words").collect()), fit_limits(rows, limits)


def pick_languages(rows: list) -> Functions:
    words, mass, whole = defaultdict(set), Counter(), {}
    for lang, word, n, _, all_words in rows:
        words[lang].add(word)
        mass[lang] += n
        whole[lang] = all_words
    return Functions({k: (frozenset(words[k]), mass[k] / whole[k]) for k in sorted(words)})


def split_lines(text: str) -> list[tuple[str, bool, int]]:
    """(line, inside a code block, paragraph) of each line that is not blank."""
    out, fence, pre, paragraph = [], False, False, 0
    for line in text.split("\n"):
        s = line.strip()
        if s.startswith("```") or s.startswith("~~~"):
            fence = not fence
            out.append((line, True, paragraph))
            continue
        opened = pre or "<pre" in line
        pre = opened and "</pre>" not in line
        if s:
            out.append((line, fence or opened, paragraph))
        else:
            paragraph += 1
    return out


Lists = list[tuple[frozenset[str], float]]


def sentence_score(words: list[str], lists: Lists) -> float:
    """Share of function words against what is usual, in the language that fits best."""
    return max((sum(map(f.__contains__, words)) / len(words) / usual for f, usual in lists if usual), default=0.0) if words else 0.0


def language_lists(words: list[str], lang: str | None, functions: Functions, limits: SpamLimits) -> Lists:
    """The function words to score the lines by: those of the declared language; where none is declared or known, of the languages closest to the text.

    If the text as a whole is not in the declared language, another one counts that it has several function words of.
    """
    key = language_key(lang)
    if key in POOLS or key not in functions:
        return functions.closest(set(words), limits.most_languages)
    own = [functions[key]]
    if sentence_score(words, own) >= limits.sentence_part:
        return own
    others = [f for f in functions.closest(set(words), limits.most_languages, limits.least_distinct) if f is not own[0] and not any(f is functions.get(k) for k in POOLS)]
    return own + [f for f in others if sentence_score(words, [f]) >= limits.sentence_part]


def block_is_spam(lines: list[str], limits: SpamLimits) -> str | None:
    """The kind of spam a block of lines without sentences is, if any."""
    text = "\n".join(lines)
    links = LINK.findall(text)
    in_links = sum(map(len, links)) + sum(map(len, MARKUP.findall(text)))
    if len(links) >= limits.least_links and in_links >= limits.link_text * len(text):
        return "links"
    tags = HASHTAG.findall(text)
    if len(tags) >= limits.least_hashtags and sum(map(len, tags)) >= 0.5 * len(text):
        return "tags"
    words = words_of(text)
    n = len(words)
    if n < limits.least_words:
        return None
    separators = len(SEPARATOR.findall(text)) / n
    top = sum(c for _, c in Counter(words).most_common(5)) / n
    pairs = list(zip(words, words[1:]))
    repeated = 1 - len(set(pairs)) / max(1, len(pairs))
    items = [x.strip().lower() for x in re.split(r"[;,|\n.!?]| - ", text) if x.strip()]
    duplicate = 1 - len(set(items)) / max(1, len(items))
    variety = len(set(words)) / n
    if repeated >= limits.repeated_pairs or top >= limits.top_words or duplicate >= limits.duplicate_items:
        return "attributes" if separators >= limits.separators else "keywords"
    if variety <= limits.variety and separators >= limits.separators:
        return "attributes"
    if variety <= limits.plain_variety and n >= 4 * limits.least_words:
        return "keywords"
    return None


def mostly_repeated(text: str, words: list[str], limits: SpamLimits, more: int = 0, more_items: int = 0) -> str | None:
    """The kind of spam that the text is if it is mostly repetition; more: words and items besides it that are none."""
    n = len(words) + more
    if n < limits.least_words or len(words) < 2:
        return None
    pairs = list(zip(words, words[1:]))
    repeated = (len(pairs) - len(set(pairs))) / (n - 1)
    varied = n < 4 * limits.least_words or (len(set(words)) + more) / n > limits.variety
    separated = lambda: len(SEPARATOR.findall(text)) >= limits.separators * n
    if repeated < limits.whole_repeated and (varied or not separated()):
        items = [x.strip() for x in ITEM_END.split(text.lower()) if WORD.search(x)]
        if (len(items) - len(set(items))) / max(1, len(items) + more_items) < limits.whole_repeated:
            return None
    return "attributes" if separated() else "keywords"


def whole_is_spam(lines: list[str], words: list[str], lists: Lists, limits: SpamLimits) -> str | None:
    """The kind of spam that all lines besides code are, sentences or not, if they are mostly repetition.

    Links are left out, and full sentences that come again count as ordinary text.
    """
    text = LINK.sub(" ", "\n".join(lines))
    if mostly_repeated(text, words, limits) is None:
        return None
    seen, once, more, more_items = set(), [], 0, 0
    for part in re.split(r"(?<=[.!?。！？])|\n", text):
        words = words_of(part)
        if len(words) >= limits.least_words and any(len(f.intersection(words)) >= limits.least_in_sentence for f, _ in lists):
            if tuple(words) in seen:
                more, more_items = more + len(words), more_items + sum(bool(WORD.search(x)) for x in ITEM_END.split(part))
                continue
            seen.add(tuple(words))
        once.append(part)
    text = "\n".join(once)
    return mostly_repeated(text, words_of(text), limits, more, more_items)


def is_technical(line: str) -> bool:
    if NO_PROSE.match(line):
        return True
    return bool((CODE_LINE.match(line) or CODE_PART.search(line)) and not LINK.search(line) and not HASHTAG.search(line))


def judge_document(text: str | None, lang: str | None, functions: Functions, limits: SpamLimits) -> tuple[float, str | None]:
    """(share of the characters that is spam, kind). Null, empty and blank texts have share 0."""
    if not text or text.isspace():
        return 0.0, None
    every, total = [], 0
    lines = split_lines(text)
    at = 0
    while at < len(lines):  # by paragraph
        end = at + 1
        while end < len(lines) and lines[end][2] == lines[at][2]:
            end += 1
        own = lines[at:end]
        total += sum(len(x) for x, _, _ in own)
        plain = [x for x, code, _ in own if not code and not is_technical(x)]
        if plain and len(own) - len(plain) < limits.code_part * len(own):
            every += plain
        at = end
    words = [words_of(x) for x in every]
    joined = [w for x in words for w in x]
    lists = language_lists(joined, lang, functions, limits)
    rest = [x for x, own in zip(every, words) if len(own) < 3 or sentence_score(own, lists) < limits.sentence_part]
    kind = block_is_spam(rest, limits) if rest else None
    share = sum(map(len, rest)) / total if kind else 0.0
    if share <= limits.spam_share:
        whole = whole_is_spam(every, joined, lists, limits)
        if whole:
            return sum(map(len, every)) / total, whole
    return share, kind


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limits: SpamLimits = SpamLimits()) -> DataFrame:
    """id_col, spam_share, spam_kind (keywords, attributes, tags, links or null), is_spam.

    Null, empty and blank texts and an empty table give no spam. A null or odd language is judged by the
    function words of all languages, any other by its own. Repeated rows are judged each. Other columns of docs are ignored.
    """
    functions, fitted = function_words(docs, text_col, lang_col, limits)
    shared = docs.sparkSession.sparkContext.broadcast((functions, fitted))
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions, fitted = shared.value
        for b in batches:
            found = [judge_document(t, lang, functions, fitted.get(language_key(lang), fitted["*"])) for t, lang in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.float64()), pa.array([k for _, k in found], pa.string())], names=["_id", "spam_share", "spam_kind"])

    out = map_batches(narrow, run, f"_id {narrow.schema['_id'].dataType.simpleString()}, spam_share double, spam_kind string")
    return out.withColumn("is_spam", F.col("spam_share") > limits.spam_share).withColumnRenamed("_id", id_col)

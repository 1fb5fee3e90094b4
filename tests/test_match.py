import random
import re
from collections import Counter
from math import floor

import pytest
from pyspark.sql import functions as F

from lumenquote.functions.normalize import normal_text, normalize_for_match
from lumenquote.operators import match as M

ABSTRACT = (
    "In this trial of 412 adults (mean age 54-61), daily walking of 30 minutes lowered systolic pressure by 6 mmHg over twelve weeks. "
    "Participants who also cut salt saw a further fall of 3 mmHg, while those in the control arm showed no change. Adverse events were rare and mild."
)


@pytest.mark.parametrize("raw, want", [("“Ice” — it’s", '"ice" - it\'s'), ("  a\t b\n", "a b"), ("so­ft​ly", "softly"), ("ＦＵＬＬ ﬁt", "full fit"), ("", ""), ("​  ", "")])
def test_normal_form(raw, want):
    assert normalize_for_match(raw)[0] == want == normal_text(raw)


def test_offsets_point_to_raw_characters():
    text, at = normalize_for_match("  A­  ﬁne ½ x")
    assert text == "a fine 1⁄2 x"
    assert [("  A­  ﬁne ½ x")[i] for i in at][:4] == ["A", " ", "ﬁ", "ﬁ"]


def test_dice():
    t = M.trigram_counts
    assert M.dice_similarity(t("abcdef"), t("abcdef")) == 1 and M.dice_similarity(t("abc"), t("xyz")) == 0 and M.dice_similarity(Counter(), t("abc")) == 0


def test_cascade():
    q = "daily walking of 30 minutes lowered systolic pressure"
    m = M.match_quote_against_text(q, ABSTRACT)
    assert (m.method, m.score) == ("exact", 1.0) and ABSTRACT[m.start : m.end] == q
    m = M.match_quote_against_text("Mean  Age 54–61), DAILY walking", ABSTRACT)
    assert (m.method, m.score) == ("normalized", 1.0) and ABSTRACT[m.start : m.end] == "mean age 54-61), daily walking"
    m = M.match_quote_against_text("Participants who also reduced salt saw another fall of 3 mmHg, while people in the control arm", ABSTRACT)
    assert m.method == "fuzzy" and 0.7 < m.score < 1
    m = M.match_quote_against_text("quartz jigsaw puzzles vexed my lazy fox while kayaking past zephyr bluffs in july heat again", ABSTRACT)
    assert m.method == "not_found" and m.score < 0.4 and m.start is None
    assert M.match_quote_against_text("dialy walkin of", ABSTRACT).score < 0.5
    assert M.match_quote_against_text("  ", ABSTRACT) == M.QuoteMatch() and M.match_quote_against_text("x", "") == M.QuoteMatch()


def test_fields():
    assert M.match_quote_against_source("further fall", ["too short", ABSTRACT]) == M.QuoteMatch("exact", 1.0, ABSTRACT.find("further fall"), ABSTRACT.find("further fall") + 12, "extraTexts[0]")
    assert M.match_quote_against_source("tiny", ["tiny"]) == M.QuoteMatch()
    assert M.match_quote_against_source(None, [None, ABSTRACT]).method == "not_found"


def slow_window(q, t, scales=(0.85, 1.0, 1.15)):
    """The scan as the rules say it, one window after the other."""
    if len(q) < 3:
        return 0.0, -1, 0
    want = M.trigram_counts(q)

    def scan(w, positions):
        best = (0.0, -1)
        for p in positions:
            d = 2 * sum((want & M.trigram_counts(t[p : p + w])).values()) / (len(q) - 2 + w - 2)
            if d > best[0]:
                best = (d, p)
            if best[0] >= 0.995:
                break
        return best

    step, found = min(80, max(10, floor(len(q) / 8 + 0.5))), (0.0, -1, 0)
    for s in scales:
        w = max(40, floor(len(q) * s + 0.5))
        own = (M.dice_similarity(want, M.trigram_counts(t)), 0, len(t)) if w > len(t) else (*scan(w, range(0, len(t) - w + 1, step)), w)
        if own[0] > found[0]:
            found = own
    if found[1] >= 0:
        near = scan(found[2], range(max(0, found[1] - step), min(found[1] + step, len(t) - found[2]) + 1))
        if near[0] > found[0]:
            found = (*near, found[2])
    return found


def test_window_scan_equals_the_slow_one(monkeypatch):
    rnd = random.Random(5)
    for chunk in (M.CHUNK, 64):
        monkeypatch.setattr(M, "CHUNK", chunk)
        for _ in range(150):
            t = "".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 400)))
            at = rnd.randint(0, max(0, len(t) - 1))
            q = "".join(c if rnd.random() > 0.1 else "x" for c in t[at : at + rnd.randint(0, 120)])
            a, b = M.best_window(q, t), slow_window(q, t)
            assert a[1:] == b[1:] and a[0] == pytest.approx(b[0])


def test_staged_matching_with_odd_rows(spark):
    rows = [(1, "further fall", ABSTRACT, None), (2, None, ABSTRACT, None), (3, "further fall", None, [None, ABSTRACT]), (4, "FURTHER  fall", ABSTRACT, []), (5, "", "", None)]
    df = spark.createDataFrame(rows, "k int, quote string, text string, extra_texts array<string>")
    got = {r.k: (r.method, r.field) for r in M.match_quotes(df).collect()}
    assert got == {1: ("exact", "text"), 2: ("not_found", "text"), 3: ("exact", "extraTexts[1]"), 4: ("normalized", "text"), 5: ("not_found", "text")}
    assert M.match_quotes(df.limit(0)).count() == 0


def test_gram_table(spark):
    df = spark.createDataFrame([(1, "abcab"), (1, "ab"), (2, None), (2, "aaaa")], "k int, t string")
    assert {tuple(r) for r in M.gram_table(df, ["k"], "t").collect()} == {(1, "abc", 1), (1, "bca", 1), (1, "cab", 1), (2, "aaa", 2)}


def test_tags_become_blanks(spark):
    from lumenquote.functions.text import strip_html_tags

    texts = ["a<b>c</b>d", "1 < 2 > 0 <x", ">a>", "no tags > here", "<<a>>", "", None, "<" * 200_000, "<a\nb>z<"]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(strip_html_tags(F.col("t")).alias("x")).collect()]
    assert got == [None if t is None else re.sub(r"<[^>]*>", " ", t) if len(t) < 1000 else t for t in texts]

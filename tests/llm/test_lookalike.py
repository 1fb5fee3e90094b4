import random

import pytest

from lumenquote.llm import lookalike as L


@pytest.mark.parametrize("raw, want", [
    ("Ｗａｔｅｒ １２", "Water 12"), ("wаtеr", "water"), ("cafe\u0301", "café"), ("\ufb01ne \ufb02ow", "fine flow"), ("so\u00adft\u200bly\u200d", "softly"), ("a\u00a0b\u2009c\u3000d", "a b c d"), ("x\u037e", "x;"), ("\u212a", "K"),
    ("m² № “q” – A a", "m² № “q” – A a"), ("", ""), ("ё", "ё"), ("cтoк", "сток"), ("\u2163 \U0001d400b", "IV Ab"), ("сор", "сор"), ("Ꮤater", "Ꮤater"),
])
def test_table_form(raw, want):
    assert L.by_table(raw) == want
    assert L.by_table(want) == want and L.look(raw) == L.look(want)


def test_trie():
    trie = L.Trie({"насос": 9, "water": 5, "Hacoc": 1, "été": 3})
    assert trie.closest("нacoс") == ("насос", 0) and trie.closest("wаt\u00ader") == ("water", 0) and trie.closest("e\u0301te\u0301") == ("été", 0)
    assert trie.closest("wafer") is None and trie.closest("wafer", 1) == ("water", 1) and trie.closest("waer", 1) == ("water", 1) and trie.closest("waters", 1) == ("water", 1)
    assert trie.closest("Water") is None and trie.closest("") is None


def test_weights():
    trie = L.Trie({"Oslo": 2, "Osla": 50})
    assert trie.closest("0slo") is None and trie.closest("0slo", 0.5) == ("Oslo", 0.5) and trie.closest("0s1o", 1) == ("Oslo", 1.0) and trie.closest("Оslа", 0.5) == ("Osla", 0)


def test_ties_go_to_the_commoner_then_to_the_first():
    assert L.Trie({"cop": 3, "сор": 8}).closest("соp") == ("сор", 0)
    assert L.Trie({"cop": 3, "сор": 3}).closest("соp")[0] == L.Trie({"сор": 3, "cop": 3}).closest("соp")[0] == min("cop", "сор")


def test_canonical_text_is_one_form():
    canon = L.Canonizer({"насос": 9, "water": 5})
    assert canon.text("нacос и ｗａｔｅr, x\u200by") == "насос и water, xy"
    assert canon.text(canon.text("нacос и ｗａｔｅr")) == canon.text("нacос и ｗａｔｅr")


def test_no_token_becomes_mixed():
    canon = L.Canonizer({"cop": 9, "the": 3})
    for token in ("сток", "Вода", "καλός", "water", "ток", "Ёлка"):
        assert canon.text(token) == token
    assert canon.text("сор") == "cop"  # a whole word that looks the same is spelled as the commonest


def test_clean_words():
    assert L.clean_word("water") and L.clean_word("насос") and L.clean_word("a1") and not L.clean_word("wаter") and not L.clean_word("ｗａ") and not L.clean_word("cafe\u0301")


def vocabulary(spark, *texts):
    return L.fit_vocabulary(spark.createDataFrame([(t,) for t in texts], "t string"))


def test_vocabulary_holds_what_is_spelled_in_several_ways(spark):
    v = vocabulary(spark, "aa bb aa", None, "", "cop сор cop", "wаter water", "wаtеr wаtеr wаtеr", "Ａ1 xу")
    assert {tuple(r) for r in v.collect()} == {("cop", "cop", 2), ("water", "water", 1)}
    assert {r.word for r in L.fit_vocabulary(spark.createDataFrame([("aa cop сор",)], "t string"), every=True).collect()} == {"aa", "cop"}


def test_quotes(spark):
    text = "The cold water pump of Brücke 7 fell to 20 m² – “now”. Насос стоит. It is a café, a cop."
    s = spark.createDataFrame([(1, 1, text, "x"), (1, 1, text, "x"), (2, 1, None, "x"), (3, 1, text * 3000, "x")], "answer_id bigint, source_index int, text string, quote string")
    quotes = ["cold water pump", "сold wаter pump", "Ｃold water", "ｃｏｌｄ water", "Bru\u0308cke 7 fell", "20 m2", '"now"', "Cold water", "Hаcoс стoит", "old wаt", "", None, "water\u200b pump of Br", "а café", "café, а сор.", "caf\uff45", "оld wa", "Насос\u00a0стоит. It", "аter"]
    e = spark.createDataFrame([(1, i, 1, q, "t") for i, q in enumerate(quotes)] + [(2, 1, 1, "x", "t"), (3, 1, 1, "wаter", "t"), (3, 1, 1, "wаter", "t"), (9, 1, 1, "x", "t")], "answer_id bigint, line_no int, source_index int, quote string, text string")
    v = vocabulary(spark, *[text] * 3, *quotes)
    want = {(1, i) for i in (1, 3, 4, 8, 9, 12, 13, 14, 16, 17, 18)} | {(3, 1)}
    for size in (L.VOCABULARY_PART, 2):
        assert {tuple(r) for r in L.quotes_that_only_look_alike(e, s, v, size).collect()} == want
    # A word of look-alikes alone is found by the vocabulary only.
    assert {tuple(r) for r in L.quotes_that_only_look_alike(e, s, v.limit(0)).collect()} == want - {(1, 14)}
    assert L.quotes_that_only_look_alike(e.limit(0), s, v.limit(0)).count() == 0


def test_planted_quotes_are_all_found(spark):
    """Each passage with some letters replaced, and passages with another word, against what was planted."""
    rnd = random.Random(5)
    words = "the pump of a cold site ran to every old cop in Rome насос на реке стоит с весны das Öl der Brücke".split()
    alike = {b: a for a, b in L._LATIN.items()} | {a: b for a, b in L._LATIN.items() if a in L.CYRILLIC_ALIKE}
    sources, evidence, planted = [], [], set()
    for i in range(200):
        text = " ".join(rnd.choice(words) for _ in range(40)) + "."
        begin = rnd.randrange(60)
        quote = text[begin : begin + rnd.randint(20, 60)]
        new = "".join(alike.get(c, c) if rnd.random() < 0.5 else c for c in quote)
        if i % 4 == 3:
            new += " zebra"
        sources.append((i, 1, text))
        evidence.append((i, 1, 1, new))
        if new not in text and i % 4 != 3:
            planted.add((i, 1))
    s = spark.createDataFrame(sources, "answer_id bigint, source_index int, text string")
    e = spark.createDataFrame(evidence, "answer_id bigint, line_no int, source_index int, quote string")
    v = L.fit_vocabulary(s.select("text").union(e.select("quote")))
    got = {tuple(r) for r in L.quotes_that_only_look_alike(e, s, v).collect()}
    assert got <= planted and len(got) >= 0.98 * len(planted) and len(planted) > 120


def test_nulls_clashing_names_and_parts(spark):
    df = spark.createDataFrame([(1, None, "_n0"), (2, "ａ", "x"), (3, "сор", "")], "k int, text string, _c0 string")
    v = vocabulary(spark, "cop cop сор", "wаter water")
    for size in (50, 1):
        out = L.canonical_columns(df, {"text": "form"}, v, size=size)
        assert {(r.k, r.form) for r in out.collect()} == {(1, None), (2, "a"), (3, "cop")} and out.columns == ["k", "text", "_c0", "form"]
    assert vocabulary(spark).count() == 0

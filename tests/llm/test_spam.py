import random

import pytest

from lumenquote.llm import spam as S

PROSE = "The pump in the cellar is old and it does not run when the valve is shut, so we have to open it before the test."
KEYS = ["cheap shoes", "buy tea", "best loan", "free case", "top sale", "order now"]


def documents():
    rnd = random.Random(2)
    words = PROSE.split()
    docs = []
    for i in range(400):
        rnd.shuffle(words)
        docs.append((i, " ".join(words).capitalize() + ". " + " ".join(rnd.sample(words, 20)) + ".", "en"))
    return docs


SPAM = {
    "list": "; ".join(random.Random(1).choice(KEYS) + f" {i}" for i in range(40)),
    "salad": " ".join(random.Random(2).choice(KEYS) for _ in range(60)),
    "tags": " ".join("#" + random.Random(i).choice(KEYS).replace(" ", "") + "x" * (i % 3) for i in range(30)),
    "links": "\n".join(f"http://x{i}.example/{i}" for i in range(8)),
    "anchors": "\n".join(f'<a href="https://x{i}.example/go">cheap shoes</a><br>' for i in range(9)),
    "mostly": PROSE + "\n" + ", ".join(random.Random(4).choice(KEYS) for _ in range(60)),
}
FAIR = {
    "prose": PROSE, "short": "Same here.", "one link": "See https://docs.example/1",
    "references": "\n".join(f"- https://docs.example/{i} {PROSE}" for i in range(5)),
    "log": PROSE + "\n\n" + "\n".join(f"2024-05-1{i % 9} 10:00:0{i % 9} [worker-{i}] WARN queue full retry={i}" for i in range(30)),
    "code": PROSE + "\n\n```\n" + "\n".join(f"x{i} = run({i}); y{i} = run({i})" for i in range(30)) + "\n```",
    "parts": PROSE + "\n" + "\n".join(f"- {i} x M{i} bolt, {i * 7} mm" for i in range(3, 12)),
    "tail": PROSE * 4 + "\n" + "; ".join(KEYS * 3), "blank": " \n ", "empty": "", "null": None,
}


def test_kinds(spark):
    rows = documents() + [(1000 + i, t, lang) for i, (t, lang) in enumerate(zip([*SPAM.values(), *FAIR.values()], ["en", None, "xx", "EN", "en-US", "en"] * 5))]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id bigint, text string, lang string, spam_share double")
    got = {r.doc_id: r for r in S.score_documents(df).collect()}
    names = dict(enumerate([*SPAM, *FAIR], 1000))
    assert {n for i, n in names.items() if got[i].is_spam} == set(SPAM)
    assert not any(got[i].is_spam for i in range(400))
    assert got[1003].spam_kind == got[1004].spam_kind == "links" and got[1002].spam_kind == "tags"


def test_long_and_repeated_rows_and_empty_table(spark):
    long = (PROSE + " ") * 5000
    df = spark.createDataFrame([*documents(), (1, long, "en"), (1, long, "en"), (2, SPAM["salad"] * 500, "en")], "doc_id bigint, text string, lang string")
    got = [(r.doc_id, r.is_spam) for r in S.score_documents(df).collect()]
    assert len(got) == 403 and (2, True) in got
    assert S.score_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("lang, want", [("EN", "en"), ("en-US", "en"), (" de_AT ", "de"), (None, ""), ("", "")])
def test_language_key(lang, want):
    assert S.language_key(lang) == want


FRENCH = "La pompe de la cave est vieille et elle ne tourne pas quand la vanne est fermée, donc il faut que nous ouvrions la vanne avant de faire un essai dans le champ."
STUFFED = " | ".join(f"en chaussures {x}".strip() for x in ["prix", "gratuite", "promo", *[""] * 20, "livraison", *[""] * 10, "soldes"])
OWN = ", ".join(f"{x} de la pompe" for x in ["prix", "promo", "vente", "achat"] * 10)


def french_documents():
    rnd = random.Random(3)
    out = []
    for i in range(400):
        words = FRENCH.split()
        rnd.shuffle(words)
        out.append((2000 + i, " ".join(words), "fr"))
    return out


def test_function_words_of_other_languages_make_no_sentences(spark):
    pool = [(3000 + i, f"en {w} on {v}", None) for i, (w, v) in enumerate(zip(FRENCH.split() * 3, PROSE.split() * 3))]
    rows = [(1, STUFFED, "fr"), (2, STUFFED, "fr-FR"), (3, OWN, "fr"), (4, STUFFED, None), (5, FRENCH, "fr"), (6, FRENCH * 3, "en"), (7, PROSE * 2, "fr"), (8, FRENCH, None)]
    df = spark.createDataFrame(documents() + french_documents() + pool + rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.is_spam for r in S.score_documents(df).collect()}
    assert [got[i] for i in range(1, 6)] == [True] * 4 + [False] and not got[8]
    assert not any(x for i, x in got.items() if i >= 2000)


def test_wrongly_declared_language_is_no_spam():
    words = lambda text: frozenset(S.words_of(text))
    functions = S.Functions({"en": (words("the in is and it does not run when so we have to"), 0.5), "fr": (words("la de est et elle ne pas quand donc il faut que nous avant"), 0.5)})
    for text, lang in ((FRENCH, "en"), (PROSE, "fr")):
        assert S.judge_document(text, lang, functions, S.SpamLimits()) == (0.0, None)


def test_limits_are_fitted_per_language(spark):
    rnd = random.Random(5)

    def post():  # each character is a word, and none is in many documents
        pool = [chr(0x4E00 + 2 * x) + chr(0x4E01 + 2 * x) for x in rnd.sample(range(2000), 35)]
        return "".join(rnd.choice(pool) for _ in range(90))

    posts = [(4000 + i, post(), "ja") for i in range(300)]
    # Pairs repeated as in the posts of one language, and much more than these.
    rows = [(1, posts[0][1], "en"), (2, "犬走" * 40, "ja"), (3, PROSE, "en")]
    df = spark.createDataFrame(documents() + posts + rows, "doc_id bigint, text string, lang string")
    _, fitted = S.function_words(df, "text", "lang", S.SpamLimits())
    assert fitted["en"].repeated_pairs < fitted["ja"].repeated_pairs and fitted["en"].plain_variety > fitted["ja"].plain_variety
    got = {r.doc_id: r.is_spam for r in S.score_documents(df).collect()}
    assert got[1] and got[2] and not got[3]
    assert sum(got[i] for i, _, _ in posts) < 0.2 * len(posts)


def test_languages_without_a_code_are_one():
    assert [S.language_key(x) for x in ("en", "EN-us", " pt_BR ", "und", "english", "x", "", None, "de1")] == ["en", "en", "pt", "und", "", "", "", "", ""]


def test_undeclared_texts_are_scored_by_the_closest_languages():
    """The work goes by the words shared, not by the number of languages."""
    many = {f"{a}{b}": (frozenset(f"{a}{b}{i}" for i in range(20)), 0.5) for a in "abcdefghij" for b in "abcdefghij"}
    own = frozenset("the in is and it does not run when so we have to".split())
    functions = S.Functions(many | {"en": (own, 0.5)})
    text = set("the pump in the cellar is old and it does not run aa1 ab1".split())
    assert functions.closest(text, 2)[0] == (own, 0.5) and len(functions.closest(text, 2)) == 2 and functions.closest(text, 9, 5) == [(own, 0.5)]
    assert S.language_lists(sorted(text), None, functions, S.SpamLimits())[0] == (own, 0.5) and functions.closest({"zzz"}, 3) == []


def test_long_function_words_and_small_languages(spark):
    rows = [(f"verhältnismäßigkeit {i} jedoch", "de-AT") for i in range(40)] + [("few words", "fr")] * 5
    functions, limits = S.function_words(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", S.SpamLimits())
    assert set(functions) == {"de"} and functions["de"][0] == {"verhältnismäßigkeit", "jedoch"} and set(limits) == {"*"}

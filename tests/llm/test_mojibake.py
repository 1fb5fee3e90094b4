import random

import numpy as np
import pytest

from lumenquote.llm import mojibake as M

SENTENCES = [
    "La chaudière légère a dépassé la clôture près de l’église en été.", "Die Mühle überholte die schöne Brücke für rund 20 Meter.",
    "La compuerta próxima cayó según la medición del año, señora.", "Каждый новый насос заменил старый кабель линии номер семь.", "The café at gate ESTAÇÃO measured 20 °C – ‘fine’.",
]


def damage(text, how):
    if how == "double":
        return text.encode().decode("cp1252", "replace").encode().decode("cp1252", "replace")
    misread, meant = how
    return text.encode(meant, "ignore").decode(misread, "replace")


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(4)
    out = []
    for _ in range(3000):
        words = [w for s in rnd.sample(SENTENCES, 2) for w in s.split()]
        k = rnd.randrange(len(words))
        out.append(" ".join(words[k:] + words[:k]))
    return out


@pytest.fixture(scope="module")
def restorer(corpus):
    symbols, _, _ = M.symbols_of(corpus)
    pair, n = np.unique(symbols[:-1].astype(np.int64) * M.SYMBOLS + symbols[1:], return_counts=True)
    rule = M.GarbleRule()
    return M.Restorer(M.PairModel(pair, n).prepare(rule), rule)


def read(restorer, text):
    symbols, _, base = M.symbols_of([text])
    return restorer.text(text, restorer.model.score[symbols[:-1].astype(np.int64) * M.SYMBOLS + symbols[1:]][base[0] - 1 : base[0] + len(text)])


@pytest.mark.parametrize("how", [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp437", "utf-8"), ("mac_roman", "utf-8"), ("cp1251", "utf-8")])
@pytest.mark.parametrize("text", SENTENCES[:3])
def test_restored(restorer, how, text):
    hit, new, lost = read(restorer, damage(text, how))
    assert hit and (new == text or lost)


def test_cyrillic(restorer):
    for how in (("cp1252", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "utf-8")):
        hit, new, _ = read(restorer, damage(SENTENCES[3], how))
        assert hit and sum(a == b for a, b in zip(new, SENTENCES[3])) > 0.9 * len(SENTENCES[3])


def test_partly_garbled_and_lost(restorer):
    text = SENTENCES[0] + " " + damage("La clôture légère", ("cp1252", "utf-8"))
    assert read(restorer, text)[1] == SENTENCES[0] + " La clôture légère"
    assert read(restorer, "caf� noir") == (True, "caf� noir", 1)


def test_clean_text_stays(restorer, corpus):
    assert [x for x in corpus if read(restorer, x)[0]] == []
    assert not read(restorer, SENTENCES[3].upper())[0] and not read(restorer, "")[0]


def test_segments_are_maximal():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        s = rnd.normal(-0.3, 1, 40)
        got = M.segments(s, 0.0)
        assert all(a < b for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
        best = max(s[a:b].sum() for a in range(40) for b in range(a + 1, 41))
        if best > 0:
            assert max(s[a:b].sum() for a, b in got) == pytest.approx(best)


def test_table(spark, corpus):
    rows = [(i, t, "x") for i, t in enumerate(corpus)] + [(5000, None, "x"), (5001, "", "x"), (5002, damage(SENTENCES[1], ("cp1252", "utf-8")), "x"), (5002, damage(SENTENCES[1], ("cp1252", "utf-8")), "x"), (5003, "�" * 50_000, "x")]
    df = spark.createDataFrame(rows, "k bigint, text string, restored string")
    got = [(r.k, r.restored) for r in M.find_garbled(df, "k", "text").collect()]
    assert sorted(got) == [(5002, SENTENCES[1]), (5002, SENTENCES[1]), (5003, "�" * 50_000)]
    assert M.find_garbled(df.limit(0), "k", "text").count() == 0


@pytest.mark.parametrize("times", [0, 300, 6000])
def test_found_however_common(spark, corpus, times):
    clean = corpus + [f"At {i % 90} °C the depth is {i} µm." for i in range(300)]
    bad = [(9000, "At 24 Â°C, each pump", "At 24 °C, each pump"), (9001, "a depth of 3266 Âµm.", "a depth of 3266 µm."), (9002, "Die MÃ¼hle am KelÃ¼ster", "Die Mühle am Kelüster")]
    rows = [(i, t) for i, t in enumerate(clean)] + [(i, b) for i, b, _ in bad]
    more = [(20_000 + i, damage(clean[i % len(clean)], ("cp1252", "utf-8"))) for i in range(times)]
    got = {r.k: r.restored for r in M.find_garbled(spark.createDataFrame(rows + more, "k bigint, text string"), "k", "text").collect()}
    assert [(i, got.get(i)) for i, _, _ in bad] == [(i, good) for i, _, good in bad]
    assert not [t for i, t in enumerate(clean) if i in got]


def test_sequences_that_only_could_be_read_stay(restorer):
    for unit in ("м²", "тии", "рил", "ﬁé", "\xa0é", "е’ѕ", "Â\xad"):
        assert restorer._strict("1", unit, " ") is None


def test_lost_characters_count_inside_segments(restorer):
    assert M.lost_runs("a\x92b \ufffd\ufffd", [(0, 3), (4, 7)]) == 2 and M.lost_runs("a\x92b \ufffd", [(4, 6)]) == 1 and M.lost_runs("a\x92b", []) == 0
    hit, new, lost = read(restorer, "La cl\ufffdture l\ufffdg\ufffdre")
    assert hit and lost == 3 and new == "La cl\ufffdture l\ufffdg\ufffdre"


def test_lost_characters_count_however_common(corpus):
    many = [x.replace("é", "\ufffd") for x in corpus]
    symbols, _, _ = M.symbols_of(many)
    pair, n = np.unique(symbols[:-1].astype(np.int64) * M.SYMBOLS + symbols[1:], return_counts=True)
    own = M.Restorer(M.PairModel(pair, n).prepare(M.GarbleRule()), M.GarbleRule())
    for text in many[:200]:
        assert read(own, text)[0] == ("\ufffd" in text)


@pytest.mark.parametrize("text, misread, meant", [("測量記録の数値", "latin-1", "euc_jp"), ("东侧水泵的记录", "latin-1", "gb18030"), ("남쪽 수문의 기록", "latin-1", "euc_kr"), ("東側水泵的記錄", "latin-1", "big5"), ("Прежде старый насос", "gb18030", "utf-8")])
def test_east_asian_readings(text, misread, meant):
    for unit in M.UNIT.findall(text):
        if len(unit) >= 2:
            try:
                shown = unit.encode(meant).decode(misread)
            except UnicodeError:
                continue
            assert len(shown) < 4 or unit in M.inverse_readings(shown)


def test_planted_misreadings_are_found(spark, corpus):
    """A tenth of the texts is misread in whole or in part; what comes out is held against that."""
    rnd = random.Random(8)
    ways = [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp437", "utf-8"), ("mac_roman", "utf-8")]
    rows, planted = [], set()
    for i, text in enumerate(corpus):
        if i % 10 == 0:
            half = text.find(" ", rnd.randrange(len(text) // 2))
            bad = text[:half] + damage(text[half:], rnd.choice(ways))
            if bad != text:
                planted.add(i)
            text = bad
        rows.append((i, text))
    found = M.find_garbled(spark.createDataFrame(rows, "id int, text string"), "id", "text")
    got = {r.id for r in found.select("id").collect()}
    assert len(got & planted) >= 0.97 * len(planted) and len(got - planted) <= 0.01 * len(got) and len(planted) > 250

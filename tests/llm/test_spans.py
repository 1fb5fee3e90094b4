import random

import numpy as np
import pytest

from lumenquote.llm import spans as S

LEAST = 160


def brute(records, least=LEAST):
    at = {}
    for rec, grp, texts in records:
        for t in texts:
            for i in range(len(t or "") - least + 1):
                at.setdefault(t[i : i + least], set()).add((rec, grp))
    return {(min(a, b)[0], max(a, b)[0]) for g in at.values() for a in g for b in g if a[0] < b[0] and a[1] != b[1]}


def corpus(seed, n=120):
    """Texts of several kinds that share spans of about the least length, with runs, periods and scripts without blanks."""
    rnd = random.Random(seed)
    words = ["water", "ice", "a", "of", "pump", "n° 3", "été", "line-up", "—", "(x)", "日本語", "vanne"]
    base = [" ".join(rnd.choice(words) for _ in range(150)) for _ in range(6)]
    base += ["".join(rnd.choice("日月火水木金土本語学") for _ in range(500)), "-" * 700, "ab" * 300, "".join(rnd.choice("acgt") for _ in range(700)), "=- " * 200, "x" * 165 + " tail " + "y" * 400]
    out = []
    for i in range(n):
        texts = []
        for _ in range(rnd.randint(1, 2)):
            t = "".join(rnd.choice("qwertz uiop") for _ in range(rnd.randint(0, 90)))
            b = rnd.choice(base)
            at = rnd.randrange(len(b))
            t += b[at : at + rnd.choice([100, 158, 159, 160, 161, 170, 250])]
            texts.append(t + "".join(rnd.choice("qwertz uiop") for _ in range(rnd.randint(0, 90))))
        out.append((i, rnd.randint(0, n), texts))
    return out


def table(spark, records):
    df = spark.createDataFrame([(r, g, t[0] if t else None, t[1:], "x") for r, g, t in records], "rec_id bigint, answer_id bigint, text string, extra array<string>, name string")
    return S.long_fields(df, "rec_id", "answer_id", text_cols=("text",), array_cols=("extra",))


@pytest.mark.parametrize("seed", range(4))
def test_every_common_window_has_a_common_name(seed):
    records = corpus(seed)
    flat = [(r, g, t) for r, g, texts in records for t in texts]
    name, owner, lo, hi = S.choose_names([t for _, _, t in flat])
    held = {}
    for k, o, a, b in zip(name.tolist(), owner.tolist(), lo.tolist(), hi.tolist()):
        assert 0 <= a < b <= len(flat[o][2]) and b - a <= LEAST
        held.setdefault(k, set()).add((flat[o][0], flat[o][1]))
    pairs = {(min(a, b)[0], max(a, b)[0]) for g in held.values() for a in g for b in g if a[0] < b[0] and a[1] != b[1]}
    assert brute(records) <= pairs


def test_names_do_not_depend_on_the_batch():
    texts = [t for _, _, own in corpus(7) for t in own]
    name, owner, lo, hi = S.choose_names(texts)
    whole = sorted(zip(owner.tolist(), lo.tolist(), hi.tolist(), name.tolist()))
    alone = []
    for i, t in enumerate(texts):
        n, _, a, b = S.choose_names([t])
        alone += [(i, x, y, z) for x, y, z in zip(a.tolist(), b.tolist(), n.tolist())]
    assert whole == sorted(alone)


@pytest.mark.parametrize("hot", [64, 1])
def test_pairs_equal_brute_force(spark, hot):
    records = corpus(11) + [(500, 900, []), (501, 901, ["short"]), (502, 902, [None, "z" * 160]), (503, 903, ["z" * 2000])]
    df = table(spark, records)
    got = {tuple(r) for r in S.shared_pairs(df.unionByName(df.limit(5)), hot=hot).collect()}
    want = brute(records)
    assert got == want and (502, 503) in want


@pytest.mark.parametrize("hot", [64, 1])
def test_shares_equal_brute_force(spark, hot):
    records = corpus(13, 60)
    seen = {}
    for rec, grp, texts in records:
        for f, t in enumerate(texts):
            for i in range(len(t) - LEAST + 1):
                seen.setdefault(t[i : i + LEAST], set()).add(grp)
    want = {}
    for rec, grp, texts in records:
        covered = set()
        for f, t in enumerate(texts):
            for i in range(len(t) - LEAST + 1):
                if len(seen[t[i : i + LEAST]]) > 1:
                    covered |= {(f, j) for j in range(i, i + LEAST)}
        want[rec] = len(covered)
    totals = spark.createDataFrame([(r, sum(map(len, t))) for r, _, t in records] + [(999, 0)], "rec bigint, n_chars int")
    got = {r.rec: (r.shared_chars, r.shared_share) for r in S.shared_share(table(spark, records), totals, hot=hot).collect()}
    assert {k: v[0] for k, v in got.items()} == want | {999: 0} and got[999][1] is None


def test_hot_span_and_empty_table(spark):
    span = "the same long passage of boilerplate " * 6
    df = table(spark, [(i, i % 90, [f"{i} {span} {i}"]) for i in range(100)])
    assert S.shared_pairs(df).count() == sum(1 for i in range(100) for j in range(i) if i % 90 != j % 90)
    assert S.shared_pairs(df.limit(0)).count() == 0


def test_common_length():
    assert S.common_length("xxabcyy", 2, 5, "zxabcyq", 2, 5) == 5 and S.common_length("abc", 0, 3, "abd", 0, 3) == 0
    assert len(S.window_names(["a" * 165], [3], [100], 160)[0]) == 4
    assert np.unique(S.window_names(["a" * 165], [3], [100], 160)[0]).size == 1


def test_texts_beyond_a_portion(spark, monkeypatch):
    monkeypatch.setattr(S, "BATCH_POINTS", 400)
    import pyarrow as pa

    text = "".join(random.Random(8).choice("abcdefgh ") for _ in range(5000))
    whole = S.choose_names([text])
    got = set()
    for texts, which, offset in S._portions(pa.array(["short text " * 20, text]), LEAST):
        name, owner, lo, hi = S.choose_names(texts)
        got |= {(n, a + offset[o], b + offset[o]) for n, o, a, b in zip(name.tolist(), owner.tolist(), lo.tolist(), hi.tolist()) if which[o] == 1}
    assert got == set(zip(whole[0].tolist(), whole[2].tolist(), whole[3].tolist()))


def test_null_keys_have_no_partners(spark):
    df = table(spark, [(1, 1, ["z" * 200]), (2, 2, ["z" * 200]), (None, 3, ["z" * 200]), (4, None, ["z" * 200])])
    assert [tuple(r) for r in S.shared_pairs(df).collect()] == [(1, 2)]


def test_slices_do_not_depend_on_the_pieces(spark):
    df = table(spark, corpus(17) + [(700, 950, ["".join(random.Random(3).choice("abc ") for _ in range(3000)) * 2])] + [(701, 951, ["".join(random.Random(3).choice("abc ") for _ in range(3000))])])
    got = [sorted(map(tuple, S.shared_occurrences(df, step=step).select("name", "rec", "field", "lo", "hi", "at", "slice").collect())) for step in (170, 4096, 10**6)]
    assert got[0] == got[1] == got[2] and len(got[0]) > 50 and all(len(x[6]) >= LEAST or x[5] == 0 for x in got[0])


def test_a_long_record_is_cut_before_the_join(spark):
    """A record of two million characters that shares thousands of passages: each occurrence moves one piece of it."""
    rnd = random.Random(2)
    passages = [" ".join(str(rnd.randrange(10**6)) for _ in range(40)) for _ in range(3000)]
    long = " | ".join(p + " " + str(rnd.randrange(10**9)) * 50 for p in passages)
    records = [(0, 0, [long])] + [(1 + i, 1 + i, [p]) for i, p in enumerate(passages)]
    assert S.shared_pairs(table(spark, records)).count() == 3000


@pytest.mark.parametrize("hot", [64, 1])
def test_links_stand_for_all_pairs(spark, hot):
    records = corpus(19)
    links = {(r.rec, r.rep) for r in S.shared_links(table(spark, records), hot=hot).collect()}
    pairs = brute(records)

    def classes(edges):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        return {x: find(x) for x in list(root)}

    # The same records are linked, and what a pair joins lies in one class.
    assert {x for p in pairs for x in p} == {x for p in links for x in p}
    of = classes(links)
    assert all(of[a] == of[b] for a, b in pairs) and len(links) <= 2 * len(pairs) + len(of)


def test_links_grow_with_the_records(spark):
    """Six thousand records with one passage, some with a digit more in common: eighteen million pairs, a few links a record."""
    span = "the same long passage of boilerplate " * 6
    df = table(spark, [(i, i, [f"{i} {span} {i}"]) for i in range(6000)])
    got = S.shared_links(df).collect()
    assert len(got) < 10 * 6000 and {r.rec for r in got if r.rep == 0 and r.n_records == 6000} == set(range(6000))


def test_windows_of_hot_names_are_joined_on_their_text(spark, monkeypatch):
    """Were all windows named alike, no false pair would be formed."""
    rows = [(1, 1, 5, 10, "ab", "x" * 170), (1, 2, 5, 10, "cd", "y" * 170)]
    df = spark.createDataFrame([(n, rec, rec, 0, lo, hi, 0, t) for n, rec, lo, hi, _, t in rows], "name bigint, rec bigint, grp bigint, field int, lo int, hi int, at int, slice string")
    w = S._windows(df, LEAST, with_text=True).collect()
    assert {(r.rec, r.text) for r in w} == {(1, "x" * 160), (2, "y" * 160)} and {r.after for r in w if r.rec == 1} == {"x", None}

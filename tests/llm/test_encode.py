import base64
import random
from pathlib import Path

import pytest

from lumenquote.llm import encode as E

pytestmark = pytest.mark.skipif(not Path(E.DEFAULT_VOCABULARY).exists(), reason="no vocabulary")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(E.DEFAULT_VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def texts(n, seed):
    rnd = random.Random(seed)
    letters = "ab'sre velltmd\n\t 12 é²Ⅷ　\xa0'’.,!?<|endoftext|>日本😀́​\x00\x1c\x1f\r"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_equals_the_reference(reference):
    own = texts(8000, 1) + ["", "x" * 5000 + "é" * 900, " " * 9000, "'s" * 900, "<|endoftext|>", "it's he'll we've"]
    assert E.encode_texts(own, E.DEFAULT_VOCABULARY)[0] == [reference(x) for x in own]


def test_stretches_do_not_matter():
    points_of = E.pretokenize
    own = texts(300, 2)
    want = points_of(own)[0].tolist()
    scan = E.scan_starts
    for stretch in (1, 3, 17, 100_000):
        E.scan_starts = lambda cls, s=stretch: scan(cls, s)
        try:
            assert points_of(own)[0].tolist() == want
        finally:
            E.scan_starts = scan


def test_decoding_gives_the_text_back_and_offsets_point_to_it():
    own = texts(500, 3)
    ids, starts = E.encode_texts(own, E.DEFAULT_VOCABULARY)
    assert [E.decode_ids(x, E.DEFAULT_VOCABULARY) for x in ids] == own
    for text, i, s in zip(own, ids, starts):
        cuts = sorted(set(s))
        assert (not text and not s) or cuts[0] == 0
        for a, b in zip(cuts, [*cuts[1:], len(text)]):
            assert E.decode_ids([x for x, p in zip(i, s) if p == a], E.DEFAULT_VOCABULARY) == text[a:b]


def test_long_slices_merge_as_short_ones():
    m = E.PairMerger(E.DEFAULT_VOCABULARY)
    for piece in (b"internationalisation" * 5, b"aaaaaaaaaabbbbbcccab" * 9, "日本語テキスト".encode() * 6):
        assert m._merge_long(piece) == m.merge(piece[:256]) if len(piece) <= 256 else True
        assert b"".join({v: k for k, v in m.ranks.items()}[i] for i in m._merge_long(piece)) == piece


def test_table(spark, reference):
    rows = [(1, "a b", "x"), (2, None, "y"), (3, "", None), (1, "a b", "x"), (4, "n_tokens ids" * 3000, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = E.encode_documents(df).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in got) == sorted((i, reference(t) if t else []) for i, t, _ in rows)
    counted = E.encode_documents(df, count_only=True, keep=("ids",))
    assert {(r.doc_id, r.ids, r.n_tokens) for r in counted.collect()} == {(i, k, len(reference(t)) if t else 0) for i, t, k in rows}
    assert E.encode_documents(df.limit(0)).count() == 0
    assert E.encode_documents(df, offsets=True).columns == ["doc_id", "ids", "starts"]

import random

import pytest

from lumenquote.functions.prompt import citation_instructions
from lumenquote.operators import protocol as P

BODY = 'Ice floats on water.[1][2]{c1} Steam rises.[2]{c2}\n\nEVI1\nc1|1|"Ice is \\"light\\",\\nso it floats."\nc1|2|"Ice floats."\nc2|2|"Steam goes up."\nEND_EVI1'


def answers(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "answer_id bigint, answer string")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_well_formed_answer(spark):
    p = P.parse_answers(answers(spark, BODY)).first()
    assert [(c.claim_id, c.claim_text, c.source_indexes) for c in p.claims] == [("c1", "Ice floats on water.", [1, 2]), ("c2", "Steam rises.", [2])]
    assert [(e.claim_id, e.source_index, e.quote) for e in p.evidence] == [("c1", 1, 'Ice is "light",\nso it floats.'), ("c1", 2, "Ice floats."), ("c2", 2, "Steam goes up.")]
    assert p.warnings == [] and p.clean_text == "Ice floats on water.[1][2] Steam rises.[2]"


@pytest.mark.parametrize("text", ["no appendix", 'x\nEVI1\nc1|1|"never closed"', "x\nEND_EVI1\nEVI1", ""])
def test_no_appendix_leaves_the_answer_alone(spark, text):
    a = answers(spark, text)
    assert P.appendix_lines(a).count() == 0
    assert P.strip_appendix(a).first().body == text


def test_null_answer_is_empty(spark):
    assert P.strip_appendix(answers(spark, None)).first().body == ""
    assert P.parse_answers(answers(spark, None)).first().claims == []


def test_malformed_and_invalid_lines(spark):
    a = answers(spark, 'x\nEVI1\nnonsense ' + "y" * 100 + '\nc1|0|"zero"\n  \nc1|1|"a "quoted" word"\r\nc2|99999999999999999999|"far"\nEND_EVI1')
    assert rows(P.parse_evidence(a), "line_no") == [(0, 4, "c1", 1, 'a "quoted" word'), (0, 5, "c2", 2**63 - 1, "far")]
    bad = P.malformed_lines(a).first()
    assert bad.line_no == 1 and len(bad.detail) == 80 and bad.detail.endswith("…")
    assert rows(P.invalid_indexes(a), "line_no") == [(0, 2, 'c1|0|"zero"')]


def test_the_last_appendix_counts_and_words_in_the_body_do_not(spark):
    a = answers(spark, 'EVI1 is a word.\nEVI1\nold\nEVI1\nc1|1|"q"\n END_EVI1 \nafter')
    assert [r.quote for r in P.parse_evidence(a).collect()] == ["q"]
    assert P.strip_appendix(a).first().body == "EVI1 is a word.\nEVI1\nold\nafter"


def test_claims_duplicates_and_adjacency(spark):
    a = answers(spark, "One[2][5][2]{c1} two[1] {c2}\nthree[1]{c1} and {c01}")
    assert rows(P.extract_claims(a), "line_no", "seg_no") == [(0, 0, 0, "c1", "One", [2, 5]), (0, 0, 1, "c2", "two", []), (0, 1, 1, "c01", "and", [])]
    assert rows(P.duplicate_claims(a), "line_no") == [(0, 1, 0, "c1")]
    assert rows(P.nonadjacent_markers(a), "line_no", "seg_no") == [(0, 0, 1, "c2"), (0, 1, 1, "c01")]


def test_missing_orphan_and_duplicate_evidence(spark):
    a = answers(spark, 'x[1]{c1}\nEVI1\nc9|4|"stray"\nc9|4|"again"\nEND_EVI1')
    e, c = P.parse_evidence(a), P.extract_claims(a)
    assert [(r.claim_id, r.source_index) for r in P.missing_evidence(e, c).collect()] == [("c1", 1)]
    assert [r.quote for r in P.orphan_evidence(e, c).collect()] == ["stray"]
    assert [r.quote for r in P.duplicate_evidence(e).collect()] == ["again"]
    w = P.parse_answers(a).first().warnings
    assert len(w) == 3 and "cited nowhere" in w[0] and "Second quote" in w[1] and "without a quote" in w[2]


def test_serialized_quotes_come_back(spark):
    rnd = random.Random(3)
    quotes = ["".join(rnd.choice('ab"\\\n n|’é\x01') for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    e = spark.createDataFrame([(i // 7, i % 7 + 1, f"c{i}", 1, q) for i, q in enumerate(quotes)], "answer_id bigint, line_no int, claim_id string, source_index bigint, quote string")
    again = P.parse_evidence(P.serialize_appendix(e).withColumnRenamed("appendix", "answer"))
    assert {(r.claim_id, r.quote) for r in again.collect()} == {(f"c{i}", q) for i, q in enumerate(quotes)}


def test_markers_go_without_repair_of_blanks(spark):
    assert P.clean_text(answers(spark, "drop {c1} and")).first().clean_text == "drop  and"


def test_resent_answers_once(spark):
    a = spark.createDataFrame([(1, "first", 1), (1, "second", 2), (2, None, 1)], "answer_id bigint, answer string, received_at int")
    assert rows(P.unique_answers(a), "answer_id") == [(1, "first"), (2, None)]


def test_empty_table(spark):
    a = spark.createDataFrame([], "answer_id bigint, answer string")
    assert P.parse_answers(a).count() == 0 and P.parser_warnings(a).count() == 0


def test_instructions_name_their_limits():
    text = citation_instructions(7, 3, (50, 90), 33)
    assert all(x in text for x in ("7 claims", "3 sources", "50 to 90", "under 33", "EVI1", "END_EVI1"))


def test_all_rules_are_told():
    text = citation_instructions()
    assert all(x in text for x in ("exactly one", "no appendix", "Nothing follows END_EVI1", "code fence", "never invent", "number"))


def test_places_of_many_markers_keep_their_order(spark):
    line = " ".join(f"x {{c{i}}}" for i in range(1, 100_003))
    a = answers(spark, line + "\nlast {c1}")
    w = P.parser_warnings(a).orderBy("phase", "ord").collect()
    assert [x.claim_id for x in w] == [f"c{i}" for i in range(1, 100_003)] + ["c1", "c1"] and w[-1].kind == "duplicate_claim"


def test_claims_and_evidence_from_events(spark):
    a = answers(spark, BODY, None, "x[1]{c1} {cat} y[1]{c1}\nEVI1\nc1|1|\"q\"\nc1|1|\"r\"\nEND_EVI1")
    events = P.answer_events(a)
    assert rows(P.event_claims(events), "answer_id", "seg_no") == rows(P.extract_claims(a), "answer_id", "seg_no")
    assert rows(P.event_evidence(events).drop("claim_text"), "answer_id", "line_no") == rows(P.first_evidence(P.parse_evidence(a)), "answer_id", "line_no")
    assert [r.claim_text for r in P.event_evidence(events).orderBy("answer_id", "line_no").collect()] == ["Ice floats on water."] * 2 + ["Steam rises.", "x"]
    assert [r.clean_text for r in P.parse_answers(a).orderBy("answer_id").collect()] == [r.clean_text for r in P.clean_text(a).orderBy("answer_id").collect()]

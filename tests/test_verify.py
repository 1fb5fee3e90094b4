import json
import re
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenquote.functions.json_recover import items_of
from lumenquote.operators import gate as G
from lumenquote.operators import judge as J
from lumenquote.operators import verify as V
from lumenquote.plans import registry
from lumenquote.sources.jobs import job_verdicts, read_jobs, write_verdicts

ICE = "Water ice has a lower density than liquid water, so it floats on lakes in winter."
STEAM = "Steam is the gas phase of water and it rises through colder air above a kettle."
ANSWER = 'Ice floats.[1]{c1} Steam always rises.[2]{c2}\nEVI1\nc1|1|"it floats on lakes"\nc2|2|"it rises through colder air"\nEND_EVI1'
UNCITED = "This long sentence says a great deal and cites nothing at all"


def tables(spark, *texts):
    a = spark.createDataFrame(list(enumerate(texts)), "answer_id bigint, answer string")
    s = spark.createDataFrame([(i, n + 1, t, None) for i in range(len(texts)) for n, t in enumerate((ICE, STEAM))], "answer_id bigint, source_index int, text string, extra_texts array<string>")
    return a, s


def results(spark, *rows):
    return J.LookupJudge(spark.createDataFrame(list(rows), "answer_id bigint, id string, class string, confidence double, reasons array<string>"))


def summary(report, answer=0):
    return [round(x, 6) if isinstance(x, float) else x for x in report["summary"].filter(f"answer_id = {answer}").first()[1:]]


def test_without_judge(spark):
    assert summary(V.verify_answers(*tables(spark, ANSWER))) == [2, 1.0, None, 1.0, 1.0]


def test_with_judge(spark):
    judge = results(spark, (0, "c1|1", "entailed", 0.95, []), (0, "c2|2", "overstated", 0.4, ["too", "many", "reasons"]), (0, "c7|7", "entailed", 1.0, []))
    report = V.verify_answers(*tables(spark, ANSWER), judge)
    assert summary(report) == [2, 1.0, 0.5, 0.675, 0.4]
    assert {(r["class"], r.score, len(r.reasons)) for r in report["citations"].collect()} == {("entailed", 0.95, 0), ("overstated", 0.4, 2)}


def test_judge_errors_and_gaps_give_no_score(spark):
    judge = results(spark, (0, "c1|1", "who knows", 0.9, None))
    report = V.verify_answers(*tables(spark, ANSWER), judge)
    assert summary(report) == [2, 1.0, 0.0, None, None]
    assert "judge_count_mismatch" in {r.kind for r in report["warnings"].collect()}


def test_missing_source_and_no_citations(spark):
    report = V.verify_answers(*tables(spark, 'x[7]{c1}\nEVI1\nc1|7|"y"\nEND_EVI1', "nothing cited", None))
    assert [summary(report, i)[0] for i in range(3)] == [0, 0, 0]
    assert {(r.answer_id, r.kind) for r in report["warnings"].collect()} == {(0, "source_not_provided")}


def test_context_is_cut_around_the_match(spark):
    a, s = tables(spark, ANSWER)
    a = a.selectExpr("*", "5 AS context_window_chars")
    got = {r.id: r.context for r in V.judge_inputs(V.citations(a, s), a, s).collect()}
    assert got == {"c1|1": ICE[ICE.find("it floats") - 5 : ICE.find("it floats on lakes") + 23], "c2|2": STEAM[STEAM.find("it rises") - 5 : STEAM.find("colder air") + 15]}


def test_validation(spark):
    df = spark.createDataFrame([(1, "a", "entailed", 1.7, ["x" * 300]), (1, "b", "Entailed", -2.0, None), (1, "c", None, None, []), (1, "", "entailed", 1.0, []), (1, "d", "entailed", float("nan"), [])], "answer_id bigint, id string, class string, confidence double, reasons array<string>")
    got = {r.id: (r["class"], r.confidence, [len(x) for x in r.reasons]) for r in J.validate_results(df).collect()}
    assert got == {"a": ("entailed", 1.0, [200]), "b": ("error", 0.0, []), "c": ("error", None, []), "d": ("entailed", None, [])}


def test_callable_judge(spark):
    def call(items):
        assert len(items) <= 2 and all(len(x["context"]) <= 1200 and "<b>" not in x["context"] for x in items)
        return [{"id": x["id"], "class": "entailed", "confidence": 0.5, "reasons": ["r"]} for x in items if x["claim"] != "skip"]

    items = spark.createDataFrame([(i, "c1|1", "skip" if i == 3 else "claim", "q", "<b>" + "x" * 2000) for i in range(5)], "answer_id bigint, id string, claim string, quote string, context string")
    got = {r.answer_id: (r["class"], r.confidence) for r in J.CallableJudge(call, 2).judge(items.coalesce(1)).collect()}
    assert got == {i: ("error", None) if i == 3 else ("entailed", 0.5) for i in range(5)}


def test_failed_batch_gives_errors():
    part = pd.DataFrame({"answer_id": [1], "id": ["c1|1"], "claim": ["c"], "quote": ["q"], "context": [""]})
    out = J.judge_batch(lambda items: 1 / 0, part)
    assert out["class"].tolist() == ["error"] and "division" in out["reasons"][0][0]


@pytest.mark.parametrize("statuses, tries, good", [([None, 503], 3, True), ([429, 500, 503], 3, False), ([400], 1, False)])
def test_chat_judge_tries_again_where_it_helps(statuses, tries, good):
    seen, waits = [], []

    def transport(url, headers, body, timeout):
        seen.append((url, headers, body))
        if len(seen) <= len(statuses):
            raise J.TransportError(statuses[len(seen) - 1], "no")
        return {"choices": [{"message": {"content": '{"items": [{"id": "a", "class": "entailed"}]}'}}]}

    judge = J.ChatJudge("m", "http://x/v1", "key", transport=transport, sleep=waits.append, seed=4)
    if good:
        assert judge.ask([{"id": "a"}]) == [{"id": "a", "class": "entailed"}]
    else:
        with pytest.raises(J.TransportError):
            judge.ask([{"id": "a"}])
    assert len(seen) == tries and waits == [0.5, 1.0][: tries - 1]
    assert seen[0][0] == "http://x/v1/chat/completions" and seen[0][1] == {"Authorization": "Bearer key"} and seen[0][2]["seed"] == 4 and seen[0][2]["temperature"] == 0


@pytest.mark.parametrize("text, want", [
    ('{"items": [{"a": 1}]}', [{"a": 1}]),
    ('Sure! {"items": [{"a": "}"}, {"b": 2}]} bye', [{"a": "}"}, {"b": 2}]),
    ('{"items": [{"a": 1}, {"b": 2}, {"c', [{"a": 1}, {"b": 2}]),
    ('{"items": [{"a": 1}, {"b": oops}, {"c": 3}]}', [{"a": 1}, {"c": 3}]),
    ('[{"a": 1}]', []), ("", []), (None, []), ("{", []), ('{"items": 3}', []),
])
def test_json_recovery(text, want):
    assert items_of(text) == want


def test_environment():
    assert J.judge_from_environment({}) is None and J.judge_from_environment({"LUMENQUOTE_JUDGE_MODEL": "m"}) is None
    judge = J.judge_from_environment({"LUMENQUOTE_API_KEY": "k"})
    assert (judge.api_key, judge.model, judge.base_url) == ("k", J.DEFAULT_MODEL, J.DEFAULT_URL)
    judge = J.judge_from_environment({"LUMENQUOTE_JUDGE_KEY": "a", "LUMENQUOTE_API_KEY": "b", "LUMENQUOTE_JUDGE_MODEL": "m", "LUMENQUOTE_JUDGE_URL": "http://x/v1/"})
    assert (judge.api_key, judge.model, judge.base_url) == ("a", "m", "http://x/v1")


def verdicts(spark, texts, judge=None):
    a, s = tables(spark, *texts)
    report = V.verify_answers(a, s, judge)
    return {r.answer_id: r for r in G.gate_verdicts(a, G.gate_problems(report["citations"])).collect()}


def test_gate(spark):
    fabricated = ANSWER.replace("it floats on lakes", "ice melts at once in the hot summer sun of the south, always and everywhere on the earth")
    got = verdicts(spark, [ANSWER, fabricated, ANSWER.replace("Ice", UNCITED + ". Ice"), "  ", None])
    assert [(got[i].verdict, got[i].exit_code, got[i].n_problems, got[i].n_uncited) for i in range(5)] == [("pass", 0, 0, 0), ("revise", 2, 1, 0), ("revise", 2, 0, 1), ("error", 1, 0, 0), ("error", 1, 0, 0)]
    assert got[0].instructions is None and "c1" in got[1].instructions and UNCITED[:40] in got[2].instructions


def test_gate_with_judge(spark):
    judge = results(spark, *[(i, "c1|1", c, f, []) for i, (c, f) in enumerate([("contradicted", 0.9), ("overstated", 0.9), ("entailed", 0.3), ("error", None)])], *[(i, "c2|2", "entailed", 0.9, []) for i in range(4)])
    a, s = tables(spark, *[ANSWER] * 4)
    problems = {r.answer_id: r.type for r in G.gate_problems(V.verify_answers(a, s, judge)["citations"]).collect()}
    assert problems == {0: "contradicted_by_source", 1: "overstated", 2: "weakly_supported"}


def test_uncited_sentences_and_what_is_passed_over(spark):
    text = f"# {UNCITED}\n{UNCITED}?\nShort one.\n{UNCITED} [3]. Next one is again long enough to be reported as uncited.\n1234567890 1234567890 1234567890 1234567890 12\n" + "Long " * 60
    a = spark.createDataFrame([(1, text)], "answer_id bigint, answer string")
    got = [r.sentence for r in G.uncited_sentences(a).orderBy("line_no", "sentence_no").collect()]
    assert got[0] == "Next one is again long enough to be reported as uncited." and len(got) == 2 and len(got[1]) == 238 and got[1].endswith("…")


def test_jobs_as_json(spark, tmp_path):
    jobs = [
        {"answer": ANSWER, "sources": [{"text": ICE}, {"text": STEAM, "extraTexts": ["x"]}], "options": {"thresholds": {"minScore": 0.7}}},
        {"answer": UNCITED + ". Odd[1] {c1}", "sources": [{"text": ICE}]},
        {"answer": ANSWER, "sources": [{"text": STEAM}], "options": {"judge": False}}, {"answer": " ", "sources": []},
    ]
    (tmp_path / "jobs.json").write_text("\n".join([*map(json.dumps, jobs + jobs[:2]), "no json", ""]))
    a, s, rejects = read_jobs(spark, str(tmp_path / "jobs.json"))
    assert (a.count(), s.count(), rejects.count()) == (3, 4, 2) and a.filter("min_score = 0.7").count() == 1
    judge = J.CallableJudge(lambda items: [{"id": x["id"], "class": "entailed", "confidence": 0.6, "reasons": ["r"]} for x in items])
    write_verdicts(job_verdicts(spark, str(tmp_path / "jobs.json"), judge), str(tmp_path / "out"))
    got = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    assert len(got) == 5 and sorted((x["verdict"], x["exitCode"]) for x in got) == [("error", 1)] * 2 + [("revise", 2)] * 3
    weak = next(x for x in got if x["summary"] and x["summary"]["citationCount"] == 2)
    assert weak["problems"][0] == {"claimId": "c1", "sourceIndex": 1, "claimText": "Ice floats.", "type": "weakly_supported", "textMatch": {"method": "exact", "score": 1.0}, "entailment": {"class": "entailed", "confidence": 0.6, "reasons": ["r"]}, "score": 0.6}
    assert len(weak["problems"]) == 2 and weak["uncited"] == [] and weak["warnings"] == [] and weak["summary"]["meanScore"] == 0.6 and "c2" in weak["instructionsForModel"]
    odd = next(x for x in got if x["uncited"])
    assert odd["uncited"] == [UNCITED + "."] and len(odd["warnings"]) == 1 and odd["problems"] == []
    plain = next(x for x in got if x["summary"] and x["summary"]["citationCount"] == 1)
    assert plain["problems"][0]["entailment"] is None and plain["problems"][0]["type"] == "quote_not_in_source" and len(plain["warnings"]) == 1
    assert [x["instructionsForModel"] for x in got if x["verdict"] == "error"] == [None, None]


def test_jobs_with_their_own_thresholds(spark):
    a, s = tables(spark, ANSWER)
    judge = J.CallableJudge(lambda items: [{"id": x["id"], "class": "entailed", "confidence": 0.6, "reasons": []} for x in items])
    for change, want in (({"min_score": 0.7}, 2), ({"min_score": 0.5}, 0), ({"min_score": 0.7, "judge": False}, 0), ({"min_score": None}, 0)):
        own = a
        for k, v in change.items():
            own = own.withColumn(k, F.lit(v).cast({"min_score": "double", "judge": "boolean"}[k]))
        assert G.gate_jobs(own, s, judge).first().exit_code == want
    long = a.withColumn("answer", F.lit(UNCITED + ".")).withColumn("min_uncited_chars", F.lit(200))
    assert G.gate_jobs(long, s).first().verdict == "pass" and G.gate_jobs(long.drop("min_uncited_chars"), s).first().verdict == "revise"
    assert G.gate_jobs(a.limit(0), s).count() == 0


def test_every_item_is_judged_once(spark, tmp_path):
    def call(items):
        for x in items:
            with open(tmp_path / "asked", "a") as f:
                f.write(x["id"] + "\n")
        return [{"id": x["id"], "class": "entailed", "confidence": 0.9} for x in items]

    a, s = tables(spark, *[ANSWER] * 9, "nothing")
    report = V.verify_answers(a, s, J.CallableJudge(call, 4))
    assert V.nested_report(report).count() == 10 and report["warnings"].count() == 0 and report["summary"].filter("min_score = 0.9").count() == 9
    asked = (tmp_path / "asked").read_text().split()
    assert len(asked) == len(set(asked)) == 18
    G.gate_jobs(a, s, J.CallableJudge(call, 4)).collect()
    assert len((tmp_path / "asked").read_text().split()) == 36


def judge_items(spark, n):
    return spark.createDataFrame([(i, "c1|1", "claim", "q", "x") for i in range(n)], "answer_id bigint, id string, claim string, quote string, context string").coalesce(1)


def test_batches_run_at_the_same_time(spark):
    def call(items):
        time.sleep(0.5)
        return [{"id": x["id"], "class": "entailed", "confidence": 0.5} for x in items]

    began = time.perf_counter()
    got = [r.answer_id for r in J.CallableJudge(call, 1, concurrent=8).judge(judge_items(spark, 24)).collect()]
    assert got == list(range(24)) and time.perf_counter() - began < 9  # one after the other: 12 s at least


def test_abort(spark, tmp_path):
    def call(items):
        (tmp_path / "stop").touch()
        return []

    judge = J.CallableJudge(call, 1, concurrent=1, aborted=(tmp_path / "stop").exists)
    with pytest.raises(Exception, match="aborted"):
        judge.judge(judge_items(spark, 50)).collect()
    chat = J.ChatJudge("m", transport=lambda *x: 1 / 0, sleep=lambda s: None, aborted=lambda: True)
    with pytest.raises(J.Aborted):
        chat.ask([{"id": "a"}])


@pytest.mark.parametrize("failure, tries", [(TimeoutError("late"), 3), (ValueError("no json"), 3), (ConnectionError("gone"), 3), (J.TransportError(404, "none"), 1)])
def test_failures_without_a_status_are_tried_again(failure, tries):
    seen = []

    def transport(*x):
        seen.append(x)
        raise failure

    with pytest.raises(type(failure)):
        J.ChatJudge("m", transport=transport, sleep=lambda s: None).ask([{"id": "a"}])
    assert len(seen) == tries


def test_nested_report(spark):
    a, s = tables(spark, ANSWER + "", "nothing")
    judge = results(spark, (0, "c1|1", "entailed", 0.95, []))
    r = {x.answer_id: x for x in V.nested_report(V.verify_answers(a, s, judge)).collect()}
    assert [c.claim_id for c in r[0].claims] == ["c1", "c2"] and [c["class"] for c in r[0].citations] == ["entailed", "error"] and r[0].summary.citation_count == 2
    assert [w.kind for w in r[0].warnings] == ["judge_count_mismatch"] and r[1].claims == [] and r[1].summary.citation_count == 0


def test_contexts_of_all_methods(spark, tmp_path):
    """Every method's context against a search by hand, from the query over tables."""
    text = "Zero. " * 20 + "The old \uff30ump <b>ran</b> dry in May 1990 near the lake. Later the new turbine ran without any fault through the whole of the summer season." + " End." * 20
    quotes = {"exact": "in May 1990", "normalized": "The old pump", "fuzzy": "Later the new turbine ran without any fault through the whole of the sumer season", "not_found": "quite another thing altogether here"}
    body = " ".join(f"Claim {m}.[1]{{c{k}}}" for k, m in enumerate(quotes, 1))
    answer = body + "\nEVI1\n" + "\n".join(f'c{k}|1|"{q}"' for k, q in enumerate(quotes.values(), 1)) + "\nEND_EVI1"
    a = spark.createDataFrame([(1, answer, 9, None)], "answer_id bigint, answer string, context_window_chars int, received_at timestamp")
    s = spark.createDataFrame([(1, 1, text, None)], "answer_id bigint, source_index int, text string, extra_texts array<string>")
    a.write.parquet(str(tmp_path / "answers.parquet"))
    s.write.parquet(str(tmp_path / "sources.parquet"))
    found = {f"{r.claim_id}|1": r for r in V.citations(a.select("answer_id", "answer"), s).collect()}
    assert [found[f"c{k}|1"].method for k in range(1, 5)] == list(quotes)
    got = {r.id: r.context for r in registry.queries()["judge_inputs"](spark, str(tmp_path)).collect()}
    want = {}
    for k, r in found.items():
        near = text[: 2 * 9] if r.start is None else text[max(0, r.start - 9) : r.end + 9]
        want[k] = " ".join(re.sub(r"<[^>]*>", " ", near).split())[:1200]
    assert got == want and "1990" in got["c1|1"] and "\uff30ump" in got["c2|1"] and "turbine" in got["c3|1"] and got["c4|1"] == "Zero. Zero. Zero."


def test_sanitized_documents_are_whole(spark, tmp_path):
    texts = ["<p>Long</p> text\x07 " * 500 + "the end", "short", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in registry.queries()["sanitized_documents"](spark, str(tmp_path)).collect()}
    assert got == {0: "Long text " * 500 + "the end", 1: "short", 2: None, 3: ""}

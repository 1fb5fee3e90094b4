"""The gate: which citations are problems, which sentences cite nothing, the verdict, and what to tell the writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenquote.functions.text import trim_blank, truncate
from lumenquote.operators.judge import Judge, first_results, validate_results
from lumenquote.operators.protocol import answer_events, event_evidence, event_warnings, message, strip_appendix
from lumenquote.operators.verify import JUDGEABLE, apply_judge, event_citations, judge_inputs, summarize, verifier_warnings
from lumenquote.session import written

# Fixed values of the gate.
MIN_SCORE, MIN_UNCITED_CHARS = 0.5, 40
SENTENCE_BREAK = r"""(?<=[.!?])[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+(?=[A-Z0-9"'“(])"""
HEADING = r"^#{1,6}[\s\x{A0}]"
MOST_SENTENCE, MOST_CLAIM = 240, 120

HEAD = "The citations of the last answer did not hold. Write it again in full, with its appendix, and mend this:"
FOOT = "State nothing new that the given sources do not back."
ADVICE = {
    "quote_not_in_source": "its quote is not in the cited source; quote the source word for word or drop the claim",
    "contradicted_by_source": "the cited source says otherwise; drop it or say what the source says",
    "overstated": "it says more than its quote; keep to what the quote supports",
    "weakly_supported": "its quote hardly supports it; cite better or say less",
}
UNCITED_ADVICE = "cite a quote for it or drop it"


def round_2(c: Column) -> Column:
    return F.floor(c * 100 + 0.5) / 100


def gate_problems(cited: DataFrame, min_score: float | Column = MIN_SCORE) -> DataFrame:
    """answer_id, line_no, claim_id, source_index, claim_text, type, method, text_score, class, confidence, reasons, score of each problem; scores to two places, the test on the full ones."""
    c = cited if "class" in cited.columns else cited.withColumn("class", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("double")).withColumn("reasons", F.lit(None).cast("array<string>"))
    bad_class = F.coalesce(F.col("class").isin("contradicted", "overstated"), F.lit(False))
    low = F.coalesce(F.col("score") < min_score, F.lit(False))
    kind = F.when(F.col("method") == "not_found", "quote_not_in_source").when(F.col("class") == "contradicted", "contradicted_by_source").when(F.col("class") == "overstated", "overstated").otherwise("weakly_supported")
    rows = c.filter((F.col("method") == "not_found") | bad_class | low)
    return rows.select("answer_id", "line_no", "claim_id", "source_index", "claim_text", kind.alias("type"), "method", round_2(F.col("text_score")).alias("text_score"), "class", round_2(F.col("confidence")).alias("confidence"), "reasons", round_2(F.col("score")).alias("score"))


def _uncited(body: Column, least: Column) -> Column:
    """Array of (line_no, sentence_no, sentence) of a body, within the row."""
    lines = F.transform(F.split(body, "\n", -1), lambda x, i: F.struct(i.alias("line_no"), trim_blank(x).alias("l")))
    lines = F.filter(lines, lambda x: (F.length(x["l"]) >= least) & ~x["l"].rlike(HEADING))

    def states(s: Column) -> Column:
        return (F.length(s) >= least) & ~F.endswith(s, F.lit("?")) & ~s.rlike(r"\[[0-9]+\]") & s.rlike("[A-Za-z]{3}")

    def short(s: Column) -> Column:
        return F.when(F.length(s) > MOST_SENTENCE, F.concat(F.substring(s, 1, MOST_SENTENCE - 3), F.lit("…"))).otherwise(s)

    def of_line(x: Column) -> Column:
        parts = F.transform(F.split(x["l"], SENTENCE_BREAK, -1), lambda s, i: F.struct(x["line_no"].alias("line_no"), i.alias("sentence_no"), trim_blank(s).alias("sentence")))
        return F.filter(parts, lambda p: states(p["sentence"]))

    found = F.flatten(F.transform(lines, of_line))
    return F.transform(found, lambda p: F.struct(p["line_no"].alias("line_no"), p["sentence_no"].alias("sentence_no"), short(p["sentence"]).alias("sentence")))


def answer_states(answers: DataFrame, min_chars: int | str = MIN_UNCITED_CHARS) -> DataFrame:
    """answer_id, blank, uncited (array of line_no, sentence_no, sentence): what the gate needs of each answer, by one reading without a shuffle.

    uncited are sentences of the body that state something and cite nothing. min_chars may name a column of answers.
    """
    own = isinstance(min_chars, str)
    least = F.coalesce(F.col(min_chars), F.lit(MIN_UNCITED_CHARS)) if own else F.lit(min_chars)
    bodies = strip_appendix(answers, keep=("answer", *([min_chars] if own else [])))
    blank = trim_blank(F.coalesce(F.col("answer").cast("string"), F.lit(""))) == ""
    return bodies.select("answer_id", blank.alias("blank"), _uncited(F.col("body"), least).alias("uncited"))


def uncited_sentences(answers: DataFrame, min_chars: int | str = MIN_UNCITED_CHARS) -> DataFrame:
    """answer_id, line_no, sentence_no, sentence: the uncited sentences as rows."""
    return answer_states(answers, min_chars).select("answer_id", F.explode("uncited").alias("_u")).select("answer_id", "_u.*")


def problem_line(type_: Column, claim_id: Column, claim_text: Column) -> Column:
    advice = F.lit("")
    for k, v in ADVICE.items():
        advice = F.when(type_ == k, v).otherwise(advice)
    return F.concat(F.lit("- Claim "), claim_id, F.lit(' ("'), truncate(claim_text, MOST_CLAIM), F.lit('"): '), advice, F.lit("."))


def uncited_line(sentence: Column) -> Column:
    return F.concat(F.lit('- No citation: "'), truncate(sentence, MOST_CLAIM), F.lit(f'"; {UNCITED_ADVICE}.'))


def gate_verdicts(answers: DataFrame, problems: DataFrame, min_chars: int | str = MIN_UNCITED_CHARS) -> DataFrame:
    """answer_id, n_problems, n_uncited, verdict, exit_code, instructions (null on pass), problems, uncited; blank answers are errors.

    problems and uncited are arrays in the order of the answer. answers are unique by answer_id.
    """
    fields = [c for c in ("claim_id", "source_index", "claim_text", "type", "method", "text_score", "class", "confidence", "reasons", "score") if c in problems.columns]
    listed = problems.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("line_no", F.struct(*fields).alias("p")))).alias("_p"))
    j = answer_states(answers, min_chars).join(listed, "answer_id", "left")
    found, uncited = F.coalesce(F.transform("_p", lambda x: x["p"]), F.array()), F.col("uncited")
    j = j.select("answer_id", "blank", found.alias("problems"), F.transform(uncited, lambda x: x["sentence"]).alias("uncited"))
    verdict = F.when(F.col("blank"), "error").when((F.size("problems") == 0) & (F.size("uncited") == 0), "pass").otherwise("revise")
    lines = F.concat(F.transform("problems", lambda x: problem_line(x["type"], x["claim_id"], x["claim_text"])), F.transform("uncited", uncited_line))
    text = F.concat(F.lit(HEAD + "\n"), F.array_join(lines, "\n"), F.lit("\n" + FOOT))
    return j.select(
        "answer_id", F.size("problems").alias("n_problems"), F.size("uncited").alias("n_uncited"), verdict.alias("verdict"),
        F.when(verdict == "pass", 0).when(verdict == "revise", 2).otherwise(1).alias("exit_code"), F.when(verdict == "revise", text).alias("instructions"), "problems", "uncited",
    )


def gate_jobs(answers: DataFrame, sources: DataFrame, judge: Judge | None = None) -> DataFrame:
    """Verdicts of jobs as sources.jobs reads them, with summary and warnings: each with its own thresholds where it names any, and without judge where it says so.

    answers: answer_id, answer and, where wanted, min_score, min_uncited_chars and judge. Citations are located once
    and each item is judged once.
    """
    for c, kind in (("min_score", "double"), ("min_uncited_chars", "int"), ("judge", "boolean")):
        if c not in answers.columns:
            answers = answers.withColumn(c, F.lit(None).cast(kind))
    texts = answers.select("answer_id", "answer")
    events = written(answer_events(texts), "events")
    cited = written(event_citations(events, sources), "citations")
    asked = answers.filter(F.coalesce("judge", F.lit(True))).select("answer_id")
    none = {"class": "string", "confidence": "double", "reasons": "array<string>"}
    inputs = results = judged = None
    plain = cited
    if judge is not None:
        judged, plain = cited.join(asked, "answer_id", "left_semi"), cited.join(asked, "answer_id", "left_anti")
        results = written(judge.judge(judge_inputs(judged, answers, sources)), "judged")
        inputs = judged.filter(JUDGEABLE).select("answer_id")
        whole = apply_judge(judged, first_results(validate_results(results)))
    plain = plain.select("*", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    whole = whole.unionByName(plain) if judge is not None else plain
    least = answers.select("answer_id", F.coalesce("min_score", F.lit(MIN_SCORE)).alias("_least"))
    verdicts = gate_verdicts(answers, gate_problems(whole.join(least, "answer_id"), F.col("_least")), "min_uncited_chars")
    said = event_warnings(events).unionByName(verifier_warnings(None, sources, judged, inputs, results, event_evidence(events)))
    said = said.withColumn("m", message(F.col("kind"), F.col("claim_id"), F.col("source_index"), F.col("detail")))
    said = said.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("phase", "ord", "m"))).alias("_w"))
    summary = summarize(answers, whole)
    summary = summary.select("answer_id", F.struct(*[c for c in summary.columns if c != "answer_id"]).alias("summary"))
    out = verdicts.join(summary, "answer_id", "left").join(said, "answer_id", "left")
    return out.select(*verdicts.columns, "summary", F.coalesce(F.transform("_w", lambda w: w["m"]), F.array().cast("array<string>")).alias("warnings"))

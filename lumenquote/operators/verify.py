"""Verification of answers: every quote against the source it cites, scores, summaries and the full report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenquote.operators import judge as J
from lumenquote.operators import protocol as P
from lumenquote.operators.match import MatchOptions, match_quotes
from lumenquote.session import written

DEFAULT_CONTEXT = 420
#: Citations that a judge is asked about.
JUDGEABLE = "claim_text <> '' AND quote <> ''"


def _located(evidence: DataFrame, sources: DataFrame, options: MatchOptions) -> DataFrame:
    s = sources.select("answer_id", F.col("source_index").cast("bigint").alias("source_index"), "text", "extra_texts")
    joined = evidence.join(s, ["answer_id", "source_index"]).select(*evidence.columns, "text", "extra_texts")
    return match_quotes(joined, options=options).dropDuplicates(["answer_id", "claim_id", "source_index"])


def located_evidence(answers: DataFrame, sources: DataFrame, options: MatchOptions = MatchOptions()) -> DataFrame:
    """answer_id, line_no, claim_id, source_index, quote and the match, for first evidence whose source was given.

    Evidence is unique by (answer_id, claim_id, source_index); the join is by (answer_id, source_index). Resent
    sources fall together after the matching, when the texts are gone, so texts are moved once.
    """
    return _located(P.first_evidence(P.parse_evidence(answers)), sources, options)


def missing_sources(answers: DataFrame | None, sources: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """First evidence that cites a source nobody gave. evidence: that of the answers, if it has been parsed."""
    s = sources.select("answer_id", F.col("source_index").cast("bigint").alias("source_index"))
    first = P.first_evidence(P.parse_evidence(answers)) if evidence is None else evidence
    return first.join(s, ["answer_id", "source_index"], "left_anti").select("answer_id", "line_no", "claim_id", "source_index", "quote")


def citations(answers: DataFrame, sources: DataFrame, options: MatchOptions = MatchOptions()) -> DataFrame:
    """One row per citation: the match, the claim's text ('' if there is none) and the score from the text alone. Answers are read once."""
    return event_citations(P.answer_events(answers), sources, options)


def event_citations(events: DataFrame, sources: DataFrame, options: MatchOptions = MatchOptions()) -> DataFrame:
    """As citations, from answer_events."""
    located = _located(P.event_evidence(events), sources, options)
    return located.withColumnRenamed("score", "text_score").withColumn("score", F.col("text_score"))


def context_window(text: Column, start: Column, end: Column, field: Column, width: Column) -> Column:
    """The source text around the match, or its beginning if the match is not in the main text."""
    near = F.substring(text, F.greatest(start - width, F.lit(0)) + 1, end + width - F.greatest(start - width, F.lit(0)))
    return F.coalesce(F.when(start.isNotNull() & (field == "text"), near).otherwise(F.substring(text, F.lit(1), 2 * width)), F.lit(""))


def judge_inputs(cited: DataFrame, answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answer_id, id, claim, quote, context of the citations that have both a claim and a quote; the width is the answer's own, else the default."""
    width = answers.select("answer_id", F.coalesce("context_window_chars", F.lit(DEFAULT_CONTEXT)).alias("_w")) if "context_window_chars" in answers.columns else answers.select("answer_id", F.lit(DEFAULT_CONTEXT).alias("_w"))
    s = sources.select("answer_id", F.col("source_index").cast("bigint").alias("source_index"), "text")
    rows = cited.filter(JUDGEABLE).join(width, "answer_id").join(s, ["answer_id", "source_index"])
    context = context_window(F.col("text"), F.col("start"), F.col("end"), F.col("field"), F.col("_w"))
    return rows.select("answer_id", F.concat_ws("|", "claim_id", F.col("source_index").cast("string")).alias("id"), F.col("claim_text").alias("claim"), "quote", context.alias("context")).dropDuplicates(["answer_id", "id"])


def apply_judge(cited: DataFrame, results: DataFrame) -> DataFrame:
    """cited with class, confidence, reasons and the combined score: null on an error or without confidence, else the smaller of both.

    results are valid and unique by (answer_id, id). A citation that could be judged but has no result counts as an
    error; one that could not keeps its text score.
    """
    judgeable = F.expr(JUDGEABLE)
    c = cited.withColumn("id", F.concat_ws("|", "claim_id", F.col("source_index").cast("string")))
    r = results.select("answer_id", "id", F.col("class").alias("_c"), F.col("confidence").alias("_f"), F.col("reasons").alias("_r"), F.lit(True).alias("_hit"))
    j = c.join(r, ["answer_id", "id"], "left")
    missing = F.col("_hit").isNull()
    cls = F.when(judgeable, F.when(missing, "error").otherwise(F.col("_c")))
    confidence = F.when(judgeable, F.col("_f"))
    reasons = F.when(judgeable, F.when(missing, F.array(F.lit("missing_item"))).otherwise(F.col("_r")))
    j = j.withColumn("class", cls).withColumn("confidence", confidence).withColumn("reasons", reasons)
    score = F.when(F.col("class").isNull(), F.col("text_score")).when((F.col("class") == "error") | F.col("confidence").isNull(), None).otherwise(F.least("text_score", "confidence"))
    return j.withColumn("score", score).drop("_c", "_f", "_r", "_hit", "id")


def summarize(answers: DataFrame, cited: DataFrame) -> DataFrame:
    """answer_id, citation_count, verbatim_rate, entailed_rate, mean_score, min_score for every answer; rates without rows are null."""
    judged = "class" in cited.columns
    literal = F.col("method").isin("exact", "normalized")
    per = cited.groupBy("answer_id").agg(
        F.count(F.lit(1)).alias("_n"), F.avg(F.when(literal, 1.0).otherwise(0.0)).alias("verbatim_rate"),
        (F.count_if(F.col("class") == "entailed") / F.nullif(F.count("class"), F.lit(0)) if judged else F.lit(None).cast("double")).alias("entailed_rate") if judged else F.max(F.lit(None).cast("double")).alias("entailed_rate"),
        F.avg("score").alias("mean_score"), F.min("score").alias("min_score"),
    )
    out = answers.select("answer_id").join(per, "answer_id", "left")
    return out.select("answer_id", F.coalesce("_n", F.lit(0)).alias("citation_count"), "verbatim_rate", "entailed_rate", "mean_score", "min_score")


def verifier_warnings(answers: DataFrame | None, sources: DataFrame, cited: DataFrame | None = None, inputs: DataFrame | None = None, results: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """Warnings of phases 5 to 7; the last two only with a judge's inputs and raw results. evidence: that of the answers, if it has been parsed."""
    parts = [P._typed(missing_sources(answers, sources, evidence), 5, "source_not_provided", ["line_no"], source=True)]
    if inputs is not None and results is not None:
        asked = inputs.groupBy("answer_id").agg(F.count(F.lit(1)).alias("_in"))
        given = results.groupBy("answer_id").agg(F.count(F.lit(1)).alias("_out"))
        counts = asked.join(given, "answer_id", "left").withColumn("_out", F.coalesce("_out", F.lit(0))).filter("_in <> _out")
        counts = counts.withColumn("detail", F.concat_ws("/", F.col("_out").cast("string"), F.col("_in").cast("string"))).withColumn("_z", F.lit(0))
        parts.append(P._typed(counts, 6, "judge_count_mismatch", ["_z"], claim=False, detail="detail"))
    if cited is not None:
        parts.append(P._typed(cited.filter("claim_text = ''"), 7, "no_claim_text", ["line_no"], source=True))
    return reduce(DataFrame.unionByName, parts)


def verify_answers(answers: DataFrame, sources: DataFrame, judge: J.Judge | None = None, options: MatchOptions = MatchOptions()) -> dict[str, DataFrame]:
    """The report as tables: clean_text, claims, citations, warnings and summary. answers are unique by answer_id.

    What the parser sees, citations, and the judge's results if there is one, are written once to the shared folder, so that every answer is
    read, every quote located and every item judged once, however many of the tables are used.
    """
    keep = ("context_window_chars",) if "context_window_chars" in answers.columns else ()
    parsed = written(P.answer_events(answers, with_text=True, keep=keep), "events")
    heads, events = parsed.filter("type IS NULL").select("answer_id", "clean_text", *keep), parsed.filter("type IS NOT NULL").drop("clean_text", *keep)
    cited = written(event_citations(events, sources, options), "citations")
    inputs = results = None
    if judge is not None:
        results = written(judge.judge(judge_inputs(cited, heads, sources)), "judged")
        inputs = cited.filter(JUDGEABLE).select("answer_id")
        cited = apply_judge(cited, J.first_results(J.validate_results(results)))
    warnings = P.event_warnings(events).unionByName(verifier_warnings(None, sources, cited if judge is not None else None, inputs, results, P.event_evidence(events)))
    return {"clean_text": heads.select("answer_id", "clean_text"), "claims": P.event_claims(events), "citations": cited, "warnings": warnings, "summary": summarize(heads, cited)}


def nested_report(tables: dict[str, DataFrame]) -> DataFrame:
    """The report as one row per answer: clean_text, claims, citations and warnings (arrays in order), summary."""

    def listed(df: DataFrame, name: str, order: list[str], fields: list[str]) -> DataFrame:
        rows = df.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("_v")))).alias("_l"))
        return rows.select("answer_id", F.transform("_l", lambda x: x["_v"]).alias(name))

    c = tables["citations"]
    claims = listed(tables["claims"], "claims", ["line_no", "seg_no"], ["claim_id", "claim_text", "source_indexes"])
    cited = listed(c, "citations", ["line_no"], [x for x in ("claim_id", "source_index", "claim_text", "quote", "method", "text_score", "start", "end", "field", "class", "confidence", "reasons", "score") if x in c.columns])
    said = tables["warnings"].withColumn("message", P.message(F.col("kind"), F.col("claim_id"), F.col("source_index"), F.col("detail")))
    out = tables["clean_text"]
    for part in (claims, cited, listed(said, "warnings", ["phase", "ord", "message"], ["kind", "message"])):
        out = out.join(part, "answer_id", "left")
    summary = tables["summary"]
    nested = summary.select("answer_id", F.struct(*[x for x in summary.columns if x != "answer_id"]).alias("summary"))
    return out.join(nested, "answer_id", "left").select("answer_id", "clean_text", *[F.coalesce(x, F.array()).alias(x) for x in ("claims", "citations", "warnings")], "summary")

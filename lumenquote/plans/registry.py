"""All queries of the core over the test tables; oracles.py has their SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenquote.functions.json_recover import recover_items
from lumenquote.functions.normalize import normal_text, normalize_for_match
from lumenquote.functions.text import collapse_whitespace, strip_control_chars, strip_html_tags
from lumenquote.operators import gate, judge, match, protocol, verify
from lumenquote.operators.rejects import parse_records
from lumenquote.plans import oracles
from lumenquote.schemas import ENTAILMENT_CLASSES
from lumenquote.session import map_batches

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def answers(spark: SparkSession, folder: str) -> DataFrame:
    return protocol.unique_answers(table(spark, folder, "answers"))


def sources(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sources").select("answer_id", "source_index", "text", "extra_texts")


def quotes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "evidence").select("rec_id", "answer_id", "line_no", "claim_id", "source_index", "quote").dropDuplicates(["rec_id"])


def cited(spark: SparkSession, folder: str) -> DataFrame:
    return verify.citations(answers(spark, folder), sources(spark, folder))


def judge_table(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "judge_results").select("answer_id", "id", F.col("entailment_class").alias("class"), "confidence", "reasons", "judged_at")


def first_judged(spark: SparkSession, folder: str) -> DataFrame:
    """One row per item, the earliest judged, as a judge gives it."""
    return judge.first_results(judge_table(spark, folder))


def judged(spark: SparkSession, folder: str) -> DataFrame:
    results = judge.first_results(judge.validate_results(judge_table(spark, folder)))
    return verify.apply_judge(cited(spark, folder), results)


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@query
def p2_found(spark, folder):
    return parse_records(table(spark, folder, "raw_lines")).filter("reason IS NOT NULL").select("raw_id", "reason")


@query
def p2_loaded(spark, folder):
    return parse_records(table(spark, folder, "raw_lines")).filter("reason IS NULL").drop("reason")


@query
def parse_evidence(spark, folder):
    return protocol.parse_evidence(answers(spark, folder))


@query
def malformed_lines(spark, folder):
    return protocol.malformed_lines(answers(spark, folder))


@query
def invalid_index(spark, folder):
    return protocol.invalid_indexes(answers(spark, folder))


@query
def strip_appendix(spark, folder):
    return protocol.strip_appendix(answers(spark, folder))


@query
def clean_text(spark, folder):
    return protocol.clean_text(answers(spark, folder))


@query
def extract_claims(spark, folder):
    claims = protocol.extract_claims(answers(spark, folder))
    return claims.withColumn("source_indexes", F.array_join(F.col("source_indexes").cast("array<string>"), ","))


@query
def duplicate_claims(spark, folder):
    return protocol.duplicate_claims(answers(spark, folder))


@query
def nonadjacent_markers(spark, folder):
    return protocol.nonadjacent_markers(answers(spark, folder))


@query
def serialize_appendix(spark, folder):
    return protocol.serialize_appendix(quotes(spark, folder))


@query
def serialize_roundtrip(spark, folder):
    """Evidence written as appendices and read again: every row comes back at its place, with the line it had in the table."""
    rows = quotes(spark, folder)
    again = protocol.parse_evidence(protocol.serialize_appendix(rows).withColumnRenamed("appendix", "answer"))
    at = rows.select("answer_id", "line_no").groupBy("answer_id").agg(F.array_sort(F.collect_list("line_no")).alias("_l"))
    return again.join(at, "answer_id").select("answer_id", "claim_id", "source_index", "quote", F.element_at("_l", F.col("line_no")).alias("original_line"))


@query
def evidence_dedupe(spark, folder):
    return protocol.first_evidence(protocol.parse_evidence(answers(spark, folder)))


@query
def duplicate_evidence(spark, folder):
    return protocol.duplicate_evidence(protocol.parse_evidence(answers(spark, folder)))


@query
def orphan_evidence(spark, folder):
    a = answers(spark, folder)
    return protocol.orphan_evidence(protocol.parse_evidence(a), protocol.extract_claims(a)).select("answer_id", "line_no", "claim_id", "source_index", "quote")


@query
def missing_evidence(spark, folder):
    a = answers(spark, folder)
    return protocol.missing_evidence(protocol.parse_evidence(a), protocol.extract_claims(a)).select("answer_id", "claim_id", "source_index")


@query
def missing_sources(spark, folder):
    return verify.missing_sources(answers(spark, folder), sources(spark, folder))


def all_warnings(spark, folder):
    events = protocol.answer_events(answers(spark, folder))
    return protocol.event_warnings(events).unionByName(verify.verifier_warnings(None, sources(spark, folder), evidence=protocol.event_evidence(events)))


@query
def warnings(spark, folder):
    said = all_warnings(spark, folder)
    return said.select("answer_id", "phase", "kind", F.array_join(F.col("ord").cast("array<string>"), ".").alias("place"), "claim_id", "source_index", "detail")


@query
def warnings_by_kind(spark, folder):
    return all_warnings(spark, folder).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("answer_id").alias("n_answers"))


def listed(array: str, *fields: str) -> Column:
    """An array of structs as one text, a line per element."""
    return F.array_join(F.transform(array, lambda x: F.concat_ws("|", *[F.array_join(x[f].cast("array<string>"), ",") if f == "source_indexes" else x[f].cast("string") for f in fields])), "\n").alias(array)


@query
def parsed_answers(spark, folder):
    p = protocol.parse_answers(answers(spark, folder))
    return p.select("answer_id", "clean_text", listed("claims", "claim_id", "claim_text", "source_indexes"), listed("evidence", "claim_id", "source_index", "quote"), F.array_join("warnings", "\n").alias("warnings"))


@query
def exact_match(spark, folder):
    return verify.located_evidence(answers(spark, folder), sources(spark, folder)).filter("method = 'exact'").select("answer_id", "line_no", "start", "end", "field")


@query
def normalized_match(spark, folder):
    return verify.located_evidence(answers(spark, folder), sources(spark, folder)).filter("method = 'normalized'").select("answer_id", "line_no", "start", "end", "field")


@query
def fuzzy_match(spark, folder):
    return verify.located_evidence(answers(spark, folder), sources(spark, folder)).filter("method IN ('fuzzy', 'not_found')").select("answer_id", "line_no", "method", *r6("score"), "start", "end", "field")


@query
def best_field_match(spark, folder):
    return verify.located_evidence(answers(spark, folder), sources(spark, folder)).select("answer_id", "line_no", "claim_id", "source_index", "method", *r6("score"), "field")


@query
def match_method_histogram(spark, folder):
    located = verify.located_evidence(answers(spark, folder), sources(spark, folder))
    return located.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("field") != "text").alias("n_extra"))


@query
def normal_offsets(spark, folder):
    """Normal form of each quote, with the places that its characters have in the quote."""

    def run(batches):
        for b in batches:
            found = [(None, None) if x is None else normalize_for_match(x) for x in b.column(1).to_pylist()]
            places = [None if at is None else ",".join(map(str, at.tolist())) for _, at in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in found], pa.string()), pa.array(places, pa.string())], names=["rec_id", "normal", "places"])

    return map_batches(quotes(spark, folder).select("rec_id", "quote"), run, "rec_id bigint, normal string, places string")


@query
def normalized_quotes(spark, folder):
    """Normal form of each quote of the evidence table."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else normal_text(x) for x in b.column(1).to_pylist()], pa.string())], names=["rec_id", "normal"])

    return map_batches(quotes(spark, folder).select("rec_id", "quote"), run, "rec_id bigint, normal string")


@query
def verification_report(spark, folder):
    """Each answer's nested report with the judge's results; the lists as texts."""
    a, s = answers(spark, folder), sources(spark, folder)
    r = verify.nested_report(verify.verify_answers(a, s, judge.LookupJudge(first_judged(spark, folder))))
    return r.select(
        "answer_id", "clean_text", listed("claims", "claim_id", "claim_text", "source_indexes"), listed("citations", "claim_id", "source_index", "method", "class", "quote"),
        F.array_join(F.transform("warnings", lambda w: w["kind"]), "\n").alias("warnings"), "summary.citation_count", *[F.round(f"summary.{c}", 6).alias(c) for c in ("verbatim_rate", "entailed_rate", "mean_score", "min_score")],
    )


@query
def trigram_counts(spark, folder):
    return match.gram_table(quotes(spark, folder), ["rec_id"], "quote")


@query
def dice_pairs(spark, folder):
    """Dice of each quote and the text it cites; 0 where one has no trigram, null and empty texts included."""
    pairs = quotes(spark, folder).join(sources(spark, folder).select("answer_id", "source_index", "text"), ["answer_id", "source_index"])
    return match.dice_pairs(pairs, ["answer_id", "line_no"], "quote", "text").select("answer_id", "line_no", *r6("dice")).distinct()


@query
def answer_summary(spark, folder):
    summary = verify.summarize(answers(spark, folder), cited(spark, folder))
    return summary.select("answer_id", "citation_count", *r6("verbatim_rate", "mean_score", "min_score"))


def inputs(spark, folder):
    a, s = answers(spark, folder), sources(spark, folder)
    return verify.judge_inputs(verify.citations(a, s), a, s)


@query
def judge_inputs(spark, folder):
    """What a judge is asked, contexts of all citations included."""
    return judge.sanitize(inputs(spark, folder))


@query
def callable_judge(spark, folder):
    """Results of a judge that is a function: it goes by lengths, leaves some items out, adds some and calls some classes by unknown names."""

    def call(items):
        out = [{"id": "c0|0", "class": "entailed", "confidence": 1.0}]
        for x in items:
            n = len(x["claim"])
            if n % 7:
                out.append({"id": x["id"], "class": (*ENTAILMENT_CLASSES, "maybe")[n % 6], "confidence": n / 100 if n % 5 else None, "reasons": ["  by \n length ", str(n), "third"]})
        return out

    found = judge.CallableJudge(call).judge(inputs(spark, folder))
    return found.select("answer_id", "id", "class", *r6("confidence"), F.array_join("reasons", "|").alias("reasons"))


@query
def judged_scores(spark, folder):
    return judged(spark, folder).select("answer_id", "line_no", "claim_id", "source_index", "class", *r6("confidence", "text_score", "score"), F.array_join("reasons", "|").alias("reasons"))


@query
def judged_summary(spark, folder):
    summary = verify.summarize(answers(spark, folder), judged(spark, folder))
    return summary.select("answer_id", "citation_count", *r6("verbatim_rate", "entailed_rate", "mean_score", "min_score"))


@query
def judge_warnings(spark, folder):
    a, s = answers(spark, folder), sources(spark, folder)
    r = verify.verify_answers(a, s, judge.LookupJudge(first_judged(spark, folder)))
    return r["warnings"].filter("phase >= 6").select("kind", "answer_id", "claim_id", "detail")


@query
def json_recovery(spark, folder):
    """Judge results written as a model might: whole, inside prose, cut off within a further item, with a broken item, as a bare array."""
    rows = table(spark, folder, "judge_results").dropDuplicates()
    item = F.to_json(F.struct("id", F.col("entailment_class").alias("class"), "confidence", "reasons"))
    per = rows.groupBy("answer_id").agg(F.array_join(F.array_sort(F.collect_list(item)), ", ").alias("items"), F.count(F.lit(1)).alias("n"))
    k = F.col("answer_id") % 5
    whole = F.concat(F.lit('{"items": ['), F.col("items"), F.lit("]}"))
    content = (
        F.when(k == 0, whole).when(k == 1, F.concat(F.lit('Here {it is}: "fine" '), whole, F.lit(" Done.")))
        .when(k == 2, F.concat(F.lit('{"items": ['), F.col("items"), F.lit(', {"id": "c9|1", "cla')))
        .when(k == 3, F.concat(F.lit('{"items": [{"id": broken}, '), F.col("items"), F.lit("]}")))
        .otherwise(F.concat(F.lit("["), F.col("items"), F.lit("]")))
    )
    found = per.select("answer_id", recover_items()(content).alias("found"))
    items = F.array_sort(F.transform("found", lambda x: F.concat_ws(" ", F.get_json_object(x, "$.id"), F.coalesce(F.get_json_object(x, "$.class"), F.lit("-")), F.coalesce(F.round(F.get_json_object(x, "$.confidence").cast("double") * 1000).cast("bigint").cast("string"), F.lit("-")), F.coalesce(F.get_json_object(x, "$.reasons[0]"), F.lit("-")))))
    return found.select("answer_id", F.size("found").alias("n_items"), F.array_join(items, "\n").alias("items"))


@query
def uncited_sentences(spark, folder):
    return gate.uncited_sentences(answers(spark, folder))


@query
def gate_problems(spark, folder):
    return gate.gate_problems(judged(spark, folder)).drop("reasons")


def verdicts(spark, folder):
    return gate.gate_verdicts(answers(spark, folder), gate.gate_problems(judged(spark, folder)))


@query
def gate_verdicts(spark, folder):
    return verdicts(spark, folder).drop("instructions", "problems", "uncited")


@query
def gate_jobs(spark, folder):
    """The answers as jobs, each with its own thresholds or none, a third of them without judge."""
    k = F.col("answer_id") % 3
    a = answers(spark, folder).withColumn("min_score", F.when(k > 0, k * 0.45)).withColumn("min_uncited_chars", F.when(k != 1, (k * 35 + 20).cast("int"))).withColumn("judge", F.when(k == 2, False))
    v = gate.gate_jobs(a, sources(spark, folder), judge.LookupJudge(first_judged(spark, folder)))
    return v.select("answer_id", "verdict", "exit_code", listed("problems", "claim_id", "source_index", "type"), F.array_join("uncited", "\n").alias("uncited"), "summary.citation_count", F.round("summary.mean_score", 6).alias("mean_score"), F.size("warnings").alias("n_warnings"))


@query
def correction_prompt(spark, folder):
    return verdicts(spark, folder).filter("verdict = 'revise'").select("answer_id", "instructions")


def sanitized(text):
    return collapse_whitespace(strip_html_tags(strip_control_chars(F.col(text))))


@query
def sanitized_documents(spark, folder):
    """The whole sanitized text of each document."""
    return table(spark, folder, "documents").select("doc_id", sanitized("text").alias("text"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()

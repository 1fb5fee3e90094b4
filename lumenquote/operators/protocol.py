"""Parsing of annotated answers: claims in the body, evidence in the appendix, and what breaks the rules.

One answer is one row (answer_id, answer). Everything up to the warnings about pairs is made by higher-order
functions within the row or by exploding it, so it needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenquote.functions.text import CLAIM_MARKER, clean_claim_text, escape_quote, strip_claim_markers, trim_blank, trim_end, truncate, unescape_quote

# Fixed values of the answer format.
APPENDIX_START, APPENDIX_END = "EVI1", "END_EVI1"
EVIDENCE_LINE = r'^(c[0-9]+)\|([0-9]+)\|"([\s\S]*)"$'
CITATION_GROUP = r"((?:\[[0-9]+\])+)$"
DETAIL_CHARS = 80

#: What each kind of warning says; filled with its claim, source and detail.
MESSAGES = {
    "malformed_line": "Appendix line cannot be read: %3$s",
    "invalid_index": "Appendix line has no valid source number: %3$s",
    "nonadjacent_group": "Claim %1$s has no source number right before its marker",
    "duplicate_claim": "Claim %1$s occurs again and is left out",
    "duplicate_evidence": "Second quote for claim %1$s and source %2$s is left out",
    "orphan_evidence": "Quote for claim %1$s and source %2$s is cited nowhere",
    "missing_evidence": "Claim %1$s cites source %2$s without a quote",
    "source_not_provided": "Claim %1$s cites source %2$s, which was not given",
    "judge_count_mismatch": "The judge gave another number of results than it was asked for: %3$s",
    "no_claim_text": "Claim %1$s on source %2$s has no text to judge",
}


def unique_answers(answers: DataFrame) -> DataFrame:
    """Resent answers once: by answer_id, the one received first. Only the needed columns go through the shuffle."""
    keep = [c for c in ("answer_id", "answer", "context_window_chars", "received_at") if c in answers.columns]
    rest = [c for c in keep if c != "answer_id"]
    by = F.struct(*[F.col(c) for c in (["received_at"] if "received_at" in keep else []) + [c for c in rest if c != "received_at"]])
    first = answers.select(*keep).groupBy("answer_id").agg(F.min(by).alias("_a"))
    return first.select("answer_id", *[F.col(f"_a.{c}").alias(c) for c in rest if c != "received_at"])


def _with_lines(answers: DataFrame) -> DataFrame:
    """answer, _lines, _start and _end: 0-based lines of the appendix' marks, both null without a whole appendix."""
    lines = answers.withColumn("_lines", F.split(F.coalesce(F.col("answer").cast("string"), F.lit("")), "\n", -1))
    # Few lines can be marks, so few are trimmed.
    marks = F.transform("_lines", lambda x: F.when(F.contains(x, F.lit(APPENDIX_START)), trim_blank(x)))
    found = lines.withColumn("_marks", marks).withColumn("_end", F.array_max(F.transform("_marks", lambda x, i: F.when(x == APPENDIX_END, i))))
    start = F.array_max(F.transform("_marks", lambda x, i: F.when((x == APPENDIX_START) & (i < F.col("_end")), i)))
    found = found.withColumn("_start", start).drop("_marks")
    return found.withColumn("_end", F.when(F.col("_start").isNotNull(), F.col("_end")))


def strip_appendix(answers: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """answer_id, body: the answer without its appendix and trailing blanks; without an appendix the answer unchanged. keep names further columns."""
    return _with_lines(answers).select("answer_id", *keep, _body().alias("body"))


def _body() -> Column:
    rest = F.concat(F.slice("_lines", 1, F.col("_start")), F.slice("_lines", F.col("_end") + 2, F.size("_lines")))
    return F.when(F.col("_start").isNull(), F.coalesce(F.col("answer").cast("string"), F.lit(""))).otherwise(trim_end(F.array_join(rest, "\n")))


def clean_text(answers: DataFrame) -> DataFrame:
    """answer_id, clean_text: the body without claim markers."""
    return strip_appendix(answers).select("answer_id", strip_claim_markers(F.col("body")).alias("clean_text"))


def appendix_lines(answers: DataFrame) -> DataFrame:
    """answer_id, line_no (from 1 within the appendix), line, trimmed and not blank; no rows without an appendix."""
    a = _with_lines(answers).filter(F.col("_start").isNotNull())
    inner = F.slice("_lines", F.col("_start") + 2, F.col("_end") - F.col("_start") - 1)
    rows = a.select("answer_id", F.posexplode(inner).alias("_p", "_l"))
    return rows.select("answer_id", (F.col("_p") + 1).alias("line_no"), trim_blank(F.col("_l")).alias("line")).filter(F.col("line") != "")


def _read_lines(answers: DataFrame) -> DataFrame:
    lines = appendix_lines(answers)
    ok = F.col("line").rlike(EVIDENCE_LINE)
    digits = F.regexp_extract("line", EVIDENCE_LINE, 2)
    # A number too large for a bigint is still a number: it names a source nobody provided.
    index = F.when(ok, F.coalesce(digits.try_cast("bigint"), F.lit(2**63 - 1)))
    return lines.withColumn("_ok", ok).withColumn("source_index", index)


def parse_evidence(answers: DataFrame) -> DataFrame:
    """answer_id, line_no, claim_id, source_index, quote of the readable appendix lines."""
    good = _read_lines(answers).filter(F.col("_ok") & (F.col("source_index") >= 1))
    return good.select("answer_id", "line_no", F.regexp_extract("line", EVIDENCE_LINE, 1).alias("claim_id"), "source_index", unescape_quote(F.regexp_extract("line", EVIDENCE_LINE, 3)).alias("quote"))


def malformed_lines(answers: DataFrame) -> DataFrame:
    return _read_lines(answers).filter(~F.col("_ok")).select("answer_id", "line_no", truncate(F.col("line"), DETAIL_CHARS).alias("detail"))


def invalid_indexes(answers: DataFrame) -> DataFrame:
    return _read_lines(answers).filter(F.col("_ok") & (F.col("source_index") < 1)).select("answer_id", "line_no", truncate(F.col("line"), DETAIL_CHARS).alias("detail"))


def serialize_appendix(evidence: DataFrame) -> DataFrame:
    """answer_id, appendix: the evidence rows of each answer as an appendix, in order of line_no; the inverse of parse_evidence."""
    line = F.concat(F.col("claim_id"), F.lit("|"), F.col("source_index").cast("string"), F.lit('|"'), escape_quote(F.coalesce("quote", F.lit(""))), F.lit('"'))
    lines = evidence.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("line_no", line.alias("l")))).alias("_l"))
    return lines.select("answer_id", F.concat(F.lit(APPENDIX_START + "\n"), F.array_join(F.transform("_l", lambda x: x["l"]), "\n"), F.lit("\n" + APPENDIX_END)).alias("appendix"))


def claim_segments(answers: DataFrame) -> DataFrame:
    """answer_id, line_no, seg_no, claim_id, segment (text since the marker before), citation_group: one row per claim marker."""
    lines = strip_appendix(answers).select("answer_id", F.posexplode(F.split("body", "\n", -1)).alias("_p", "_l")).filter(F.contains("_l", F.lit("{c")))
    ids = F.regexp_extract_all("_l", F.lit(r"\{c([0-9]+)\}"), F.lit(1))
    zipped = F.arrays_zip(ids.alias("id"), F.slice(F.split("_l", CLAIM_MARKER, -1), 1, F.size(ids)).alias("text"))
    rows = lines.select("answer_id", F.col("_p").alias("line_no"), F.posexplode(zipped).alias("seg_no", "_z"))
    return rows.select("answer_id", "line_no", "seg_no", F.concat(F.lit("c"), F.col("_z.id")).alias("claim_id"), F.col("_z.text").alias("segment"), F.regexp_extract(F.col("_z.text"), CITATION_GROUP, 1).alias("citation_group"))


def _ranked_segments(answers: DataFrame) -> DataFrame:
    once = Window.partitionBy("answer_id", "claim_id").orderBy("line_no", "seg_no")
    return claim_segments(answers).withColumn("_rank", F.row_number().over(once))


def group_indexes(group: Column) -> Column:
    """Distinct source numbers of a citation group in order."""
    numbers = F.regexp_extract_all(group, F.lit(r"\[([0-9]+)\]"), F.lit(1))
    return F.array_distinct(F.transform(numbers, lambda x: F.coalesce(x.try_cast("bigint"), F.lit(2**63 - 1))))


def extract_claims(answers: DataFrame) -> DataFrame:
    """answer_id, line_no, seg_no, claim_id, claim_text, source_indexes; of a repeated claim id only the first."""
    first = _ranked_segments(answers).filter("_rank = 1")
    return first.select("answer_id", "line_no", "seg_no", "claim_id", clean_claim_text(F.col("segment")).alias("claim_text"), group_indexes(F.col("citation_group")).alias("source_indexes"))


def duplicate_claims(answers: DataFrame) -> DataFrame:
    return _ranked_segments(answers).filter("_rank > 1").select("answer_id", "line_no", "seg_no", "claim_id")


def nonadjacent_markers(answers: DataFrame) -> DataFrame:
    return claim_segments(answers).filter("citation_group = ''").select("answer_id", "line_no", "seg_no", "claim_id")


def cited_pairs(claims: DataFrame) -> DataFrame:
    """answer_id, claim_id, source_index, line_no, seg_no, cite_no of every citation."""
    return claims.select("answer_id", "claim_id", "line_no", "seg_no", F.posexplode("source_indexes").alias("cite_no", "source_index"))


PAIR = ["answer_id", "claim_id", "source_index"]


def _ranked_evidence(evidence: DataFrame) -> DataFrame:
    return evidence.withColumn("_rank", F.row_number().over(Window.partitionBy(*PAIR).orderBy("line_no")))


def first_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence without second quotes for the same claim and source."""
    return _ranked_evidence(evidence).filter("_rank = 1").drop("_rank")


def duplicate_evidence(evidence: DataFrame) -> DataFrame:
    return _ranked_evidence(evidence).filter("_rank > 1").drop("_rank")


def orphan_evidence(evidence: DataFrame, claims: DataFrame) -> DataFrame:
    return first_evidence(evidence).join(cited_pairs(claims).select(*PAIR), PAIR, "left_anti")


def missing_evidence(evidence: DataFrame, claims: DataFrame) -> DataFrame:
    return cited_pairs(claims).join(evidence.select(*PAIR), PAIR, "left_anti")


def _typed(df: DataFrame, phase: int, kind: str, order: list[str], claim: bool = True, source: bool = False, detail: str | None = None) -> DataFrame:
    return df.select(
        "answer_id", F.lit(phase).alias("phase"), F.array(*[F.col(c).cast("bigint") for c in order]).alias("ord"), F.lit(kind).alias("kind"),
        (F.col("claim_id") if claim else F.lit(None).cast("string")).alias("claim_id"),
        (F.col("source_index") if source else F.lit(None)).cast("bigint").alias("source_index"),
        (F.col(detail) if detail else F.lit(None)).cast("string").alias("detail"),
    )


def answer_events(answers: DataFrame, with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """answer_id, type, line_no, seg_no, claim_id, source_index, cites, text, detail of all that the parser sees, from one reading.

    type: evidence, malformed_line or invalid_index for appendix lines, claim for claim markers (with their cites). text
    is the quote or the claim's text. with_text adds clean_text, on one further row of null type for each answer. keep names columns of answers that all rows get.
    """
    tagged = F.concat(
        F.transform(F.split("_b", "\n", -1), lambda x, i: F.struct(F.lit(True).alias("body"), i.alias("line_no"), x.alias("line"))),
        F.coalesce(F.transform(F.slice("_lines", F.col("_start") + 2, F.col("_end") - F.col("_start") - 1), lambda x, i: F.struct(F.lit(False).alias("body"), (i + 1).alias("line_no"), trim_blank(x).alias("line"))), F.array()),
    )
    used = F.filter(tagged, lambda x: F.when(x["body"], F.contains(x["line"], F.lit("{c")) & x["line"].rlike(CLAIM_MARKER)).otherwise(x["line"] != ""))
    if with_text:
        used = F.concat(F.array(F.struct(F.lit(None).cast("boolean").alias("body"), F.lit(-1).alias("line_no"), strip_claim_markers(F.col("_b")).alias("line"))), used)
    lines = _with_lines(answers).withColumn("_b", _body()).select("answer_id", *keep, F.explode(used).alias("_t")).select("answer_id", *keep, "_t.*")
    ids = F.regexp_extract_all("line", F.lit(r"\{c([0-9]+)\}"), F.lit(1))
    segments = F.arrays_zip(ids.alias("id"), F.slice(F.split("line", CLAIM_MARKER, -1), 1, F.size(ids)).alias("text"))
    one = F.array(F.struct(F.lit("").alias("id"), F.lit("").alias("text")))
    # A line of the body is not carried along with each of its markers.
    lines = lines.select("answer_id", *keep, "body", "line_no", F.when(~F.col("body"), F.col("line")).alias("line"), F.when(F.col("body").isNull(), F.col("line")).alias("clean_text"), F.when(F.col("body"), segments).otherwise(one).alias("_s"))
    rows = lines.select("answer_id", *keep, "body", "line_no", "line", "clean_text", F.posexplode("_s").alias("seg_no", "_z"))
    ok = F.coalesce(F.col("line").rlike(EVIDENCE_LINE), F.lit(False))
    index = F.when(ok, F.coalesce(F.regexp_extract("line", EVIDENCE_LINE, 2).try_cast("bigint"), F.lit(2**63 - 1)))
    kind = F.when(F.col("body"), "claim").when(~F.col("body"), F.when(~ok, "malformed_line").when(F.col("_i") < 1, "invalid_index").otherwise("evidence"))
    claim = F.when(F.col("body"), F.concat(F.lit("c"), F.col("_z.id"))).when(ok, F.regexp_extract("line", EVIDENCE_LINE, 1))
    text = F.when(F.col("body"), clean_claim_text(F.col("_z.text"))).when(ok, unescape_quote(F.regexp_extract("line", EVIDENCE_LINE, 3)))
    return rows.withColumn("_i", index).select(
        "answer_id", kind.alias("type"), "line_no", "seg_no", claim.alias("claim_id"), F.col("_i").alias("source_index"),
        F.when(F.col("body"), group_indexes(F.regexp_extract(F.col("_z.text"), CITATION_GROUP, 1))).alias("cites"), text.alias("text"), truncate(F.col("line"), DETAIL_CHARS).alias("detail"),
        *(["clean_text"] if with_text else []), *keep,
    )


def ranked_events(events: DataFrame) -> DataFrame:
    """events with _rank: 1 for the first claim of an id and the first quote for a claim and source."""
    return events.withColumn("_rank", F.row_number().over(Window.partitionBy("answer_id", "type", "claim_id", "source_index").orderBy("line_no", "seg_no")))


def event_claims(events: DataFrame) -> DataFrame:
    """As extract_claims, from answer_events."""
    first = ranked_events(events.filter("type = 'claim'")).filter("_rank = 1")
    return first.select("answer_id", "line_no", "seg_no", "claim_id", F.col("text").alias("claim_text"), F.col("cites").alias("source_indexes"))


def event_evidence(events: DataFrame) -> DataFrame:
    """First evidence with claim_text, the text of its claim ('' if there is none), from answer_events, without a join."""
    ranked = ranked_events(events)
    claim = F.max(F.when((F.col("type") == "claim") & (F.col("_rank") == 1), F.col("text"))).over(Window.partitionBy("answer_id", "claim_id"))
    first = ranked.withColumn("_claim", claim).filter("type = 'evidence' AND _rank = 1")
    return first.select("answer_id", "line_no", "claim_id", "source_index", F.col("text").alias("quote"), F.coalesce("_claim", F.lit("")).alias("claim_text"))


def _with_warnings(events: DataFrame) -> DataFrame:
    """Ranked events with _found, the array of their warnings, and _once, false on the further rows that a claim has for its cites."""
    events = ranked_events(events)
    # Each first claim becomes one row per source it cites; the others stay one row, told by a null place.
    cites = F.when((F.col("type") == "claim") & (F.col("_rank") == 1), F.col("cites"))
    rows = events.select("*", F.posexplode_outer(cites).alias("cite_no", "_cited")).withColumn("source_index", F.coalesce("_cited", "source_index"))
    pair = Window.partitionBy("answer_id", "claim_id", "source_index")
    is_cite, is_quote = F.col("_cited").isNotNull(), F.coalesce(F.col("type") == "evidence", F.lit(False))
    rows = rows.withColumn("_has_cite", F.max(is_cite).over(pair)).withColumn("_has_quote", F.max(is_quote).over(pair))
    line, seg, zero, one = F.col("line_no").cast("bigint"), F.col("seg_no").cast("bigint"), F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    once = F.coalesce(F.col("cite_no"), F.lit(0)) == 0
    is_claim = F.col("type") == "claim"

    def warn(when: Column, phase: int, kind: Column | str, at: tuple[Column, ...], claim: bool = True, source: bool = False, detail: bool = False) -> Column:
        none = F.lit(None).cast("string")
        return F.when(when, F.struct(
            F.lit(phase).alias("phase"), F.array(*at).alias("ord"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), (F.col("claim_id") if claim else none).alias("claim_id"),
            (F.col("source_index") if source else F.lit(None).cast("bigint")).alias("source_index"), (F.col("detail") if detail else none).alias("detail"),
        ))

    found = F.array_compact(F.array(
        warn(F.col("type").isin("malformed_line", "invalid_index"), 1, F.col("type"), (line,), claim=False, detail=True),
        warn(is_claim & once & (F.size("cites") == 0), 2, "nonadjacent_group", (line, seg, zero)),
        warn(is_claim & (F.col("_rank") > 1), 2, "duplicate_claim", (line, seg, one)),
        warn(is_quote & (F.col("_rank") > 1), 3, "duplicate_evidence", (line,), source=True),
        warn(is_quote & (F.col("_rank") == 1) & ~F.col("_has_cite"), 3, "orphan_evidence", (line,), source=True),
        warn(is_cite & ~F.col("_has_quote"), 4, "missing_evidence", (line, seg, F.col("cite_no").cast("bigint")), source=True),
    ))
    return rows.withColumn("_found", found).withColumn("_once", once)


def event_warnings(events: DataFrame) -> DataFrame:
    """answer_id, phase, ord, kind, claim_id, source_index, detail: all that the parser has to say, in order by phase and ord (an array of places)."""
    return _with_warnings(events).select("answer_id", F.explode("_found").alias("_w")).select("answer_id", "_w.*")


def parser_warnings(answers: DataFrame) -> DataFrame:
    """Warnings of answers. They are read once; both windows keep to the partitioning by answer_id, so only rows of events are sorted."""
    return event_warnings(answer_events(answers))


def message(kind: Column, claim: Column, source: Column, detail: Column) -> Column:
    text = F.lit(None).cast("string")
    for k, pattern in MESSAGES.items():
        text = F.when(kind == k, F.format_string(pattern, F.coalesce(claim, F.lit("")), F.coalesce(source.cast("string"), F.lit("")), F.coalesce(detail, F.lit("")))).otherwise(text)
    return text


def parse_answers(answers: DataFrame) -> DataFrame:
    """One row per answer: clean_text, claims, evidence and warnings as arrays in the order of the answer.

    Answers are read once; what follows keeps to the partitioning by answer_id.
    """
    rows = _with_warnings(answer_events(answers, with_text=True))
    said = F.transform("_found", lambda w: F.struct(w["phase"].alias("phase"), w["ord"].alias("ord"), message(w["kind"], w["claim_id"], w["source_index"], w["detail"]).alias("message")))
    first = F.col("_once") & (F.col("_rank") == 1)
    claim = F.when(first & (F.col("type") == "claim"), F.struct("line_no", "seg_no", "claim_id", F.col("text").alias("claim_text"), F.col("cites").alias("source_indexes")))
    quote = F.when(first & (F.col("type") == "evidence"), F.struct("line_no", "claim_id", "source_index", F.col("text").alias("quote")))
    out = rows.groupBy("answer_id").agg(
        F.max("clean_text").alias("clean_text"), F.array_sort(F.collect_list(claim)).alias("claims"), F.array_sort(F.collect_list(quote)).alias("evidence"), F.array_sort(F.flatten(F.collect_list(said))).alias("_w")
    )
    return out.select(
        "answer_id", "clean_text",
        F.transform("claims", lambda x: F.struct(x["claim_id"].alias("claim_id"), x["claim_text"].alias("claim_text"), x["source_indexes"].alias("source_indexes"))).alias("claims"),
        F.transform("evidence", lambda x: F.struct(x["claim_id"].alias("claim_id"), x["source_index"].alias("source_index"), x["quote"].alias("quote"))).alias("evidence"),
        F.transform("_w", lambda x: x["message"]).alias("warnings"),
    )

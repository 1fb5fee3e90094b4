"""Values cut by a field limit or in transfer, and how often each source cuts.

Per source and column, histograms of the length in characters and in bytes are searched for spikes at the upper
end: lengths at which far more unterminated values stand than at the lengths around. Values of a spike's length
without terminal punctuation are cut, whatever their last line looks like. Cuts in transfer stand at no spike; these are
an addition to the method, told by the value itself: an opened appendix that never closes, a last line that is no
sentence end and no usual closing line, or, for a quote, a break after which its source goes on inside the sentence.
A full stop after a word that usually goes on in small letters or digits (an abbreviation, learned from the answers)
ends no sentence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenquote.session import written

# Fixed values of the answer format.
APPENDIX_BEGIN, APPENDIX_END = "EVI1", "END_EVI1"

BLANKS = r"[\s\p{Z}\x{FEFF}]"
TERMINAL = r"""[.!?。！？]["'»”“’)\]]*$"""
DOTS = r"(?:(?<!\.)\.{2,}|…)$"
MARKER = r"\{c[0-9]+\}$"
# A word begins after what is none, so that long runs are read once.
LAST_WORD = r"(?<![\p{L}\p{N}])([\p{L}\p{N}]+)\.$"
BEFORE_STOP = r"(?<![\p{L}\p{N}])([\p{L}\p{N}]+)$"


@dataclass(frozen=True)
class SpikeRule:
    around: int = 20  # lengths on either side that a spike is held against
    factor: float = 4.0  # times the mean number of unterminated values around
    least: int = 3  # unterminated values at the length
    above: float = 4.0  # longer unterminated values, as a part of those at the length, are at most this
    usual_line: float = 0.02  # share among the unterminated last lines from which their form is a usual closing line
    abbreviation: float = 0.9  # share of a word's full stops followed by small letters or digits from which it is an abbreviation
    abbreviation_df: float = 0.001  # its stops by the number of answers, at least; so there are few, whatever the corpus


def right_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"(?<!{BLANKS}){BLANKS}+$", "")


def is_terminated(c: Column, short: list[str]) -> Column:
    """Whether the text ends a sentence; short: words whose full stop ends none."""
    inner = F.regexp_extract(c, LAST_WORD, 1).isin(short) if short else F.lit(False)
    return c.rlike(TERMINAL) & ~c.rlike(DOTS) & ~inner


def abbreviations(answers: DataFrame, rule: SpikeRule = SpikeRule()) -> list[str]:
    """Words after whose full stop the answers go on in small letters or digits.

    At most (full stops of an answer, on average) / abbreviation_df words can be so common, whatever the corpus.
    """
    parts = answers.select(F.split(F.coalesce(F.col("answer"), F.lit("")), r"\.[\s\p{Z}]+", -1).alias("_p"))
    stops = parts.select(F.explode(F.transform(F.slice("_p", 1, F.size("_p") - 1), lambda x, i: F.struct(F.regexp_extract(x, BEFORE_STOP, 1).alias("word"), F.substring(F.get("_p", i + 1), 1, 1).alias("next")))).alias("_s"))
    stops = stops.select("_s.*").filter((F.col("word") != "") & F.col("next").rlike(r"[\p{L}\p{N}]"))
    words = stops.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("next").rlike(r"[\p{Ll}\p{N}]")).alias("k"))
    total = answers.agg(F.count(F.lit(1))).scalar()
    found = words.filter((F.col("n") >= rule.abbreviation_df * total) & (F.col("n") >= 5) & (F.col("k") >= rule.abbreviation * F.col("n")))
    return sorted(r.word for r in found.select("word").collect())


def line_form(line: Column) -> Column:
    """The line with numbers as 0 and capitalised words as X."""
    return F.regexp_replace(F.regexp_replace(F.trim(line), r"[0-9]+", "0"), r"(^|[^\p{L}\p{M}])\p{Lu}[\p{L}\p{M}]+", "$1X")


def length_spikes(values: DataFrame, source: str, length_chars: str, length_bytes: str, unterminated: str, rule: SpikeRule = SpikeRule()) -> DataFrame:
    """source, unit (chars or bytes), length, n: the spikes. Null sources count as one source of their own.

    The histogram is made by partial aggregation; the windows run per source over distinct lengths, not over rows.
    """
    units = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col(length_chars).alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col(length_bytes).alias("length")))).alias("u")
    open_values = values.filter(F.col(unterminated)).select(F.col(source).alias("source"), units).select("source", "u.unit", "u.length")
    histogram = open_values.groupBy("source", "unit", "length").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source", "unit").orderBy("length")
    near = F.sum("n").over(w.rangeBetween(-rule.around, rule.around)) - F.col("n")
    over = F.coalesce(F.sum("n").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    scored = histogram.withColumn("near", near / (2.0 * rule.around)).withColumn("over", over)
    return scored.filter((F.col("n") >= rule.least) & (F.col("n") >= rule.factor * F.col("near")) & (F.col("over") <= rule.above * F.col("n"))).select("source", "unit", "length", "n")


def mark_spikes(values: DataFrame, spikes: DataFrame, source: str, length_chars: str, length_bytes: str) -> DataFrame:
    """values with at_spike: its length in characters or bytes is a spike of its source."""
    out = values
    for unit, length in (("chars", length_chars), ("bytes", length_bytes)):
        own = spikes.filter(F.col("unit") == unit).select(F.col("source").alias("_s"), F.col("length").alias("_l"), F.lit(True).alias(f"_{unit}"))
        out = out.join(own, out[source].eqNullSafe(F.col("_s")) & (out[length] == F.col("_l")), "left").drop("_s", "_l")
    return out.withColumn("at_spike", F.coalesce(F.col("_chars"), F.col("_bytes"), F.lit(False))).drop("_chars", "_bytes")


def cut_answers(answers: DataFrame, rule: SpikeRule = SpikeRule(), short: list[str] | None = None) -> DataFrame:
    """answer_id, channel, reason of each cut answer: limit (at a spike), appendix or break.

    Null, empty and blank answers are none. Resent rows are taken once. A finished answer may end without a full
    stop: with a citation marker, a closed appendix, or a line of a form that many answers end with; the last does not
    save one at a spike. short: the abbreviations, by default those of the answers.
    """
    short = abbreviations(answers, rule) if short is None else short
    a = answers.select("answer_id", "channel", F.col("answer").alias("_t")).filter(F.col("_t").isNotNull())
    a = a.withColumn("_r", right_trim(F.col("_t"))).filter(F.col("_r") != "")
    a = a.withColumn("_n", F.length("_t")).withColumn("_b", F.octet_length("_t"))
    lines = F.transform(F.split(F.col("_r"), "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"\r|\t", " ")))
    begin = F.array_max(F.transform(lines, lambda x, i: F.when(x == APPENDIX_BEGIN, i)))
    end = F.array_max(F.transform(lines, lambda x, i: F.when(x == APPENDIX_END, i)))
    a = a.withColumn("_open", begin.isNotNull() & (end.isNull() | (end < begin))).withColumn("_closed", end.isNotNull() & ~F.col("_open"))
    last = F.substring_index("_r", "\n", -1)
    ended = F.col("_closed") | is_terminated(F.col("_r"), short) | F.col("_r").rlike(MARKER)
    # Only answers that may be cut go on, without their texts; they are written once for the spikes, the usual lines and the result.
    a = a.filter(F.col("_open") | ~ended).select("answer_id", "channel", "_n", "_b", "_open", line_form(last).alias("_form"))
    a = written(a.dropDuplicates(["answer_id"]), "open_answers")
    a = a.join(usual_lines(a.filter(~F.col("_open")), rule), "_form", "left")
    a = a.withColumn("_u", F.col("_open") | F.col("_usual").isNull())  # finished answers make no spike
    marked = mark_spikes(a, length_spikes(a, "channel", "_n", "_b", "_u", rule), "channel", "_n", "_b")
    reason = F.when(F.col("at_spike"), "limit").when(F.col("_open"), "appendix").when(F.col("_usual").isNull(), "break")
    return marked.select("answer_id", "channel", reason.alias("reason")).filter(F.col("reason").isNotNull())


def usual_lines(values: DataFrame, rule: SpikeRule) -> DataFrame:
    """_form of the closing lines that many values of many lengths share (at most 1 / usual_line of them); a lone masked word is none."""
    forms = values.groupBy("_form").agg(F.count(F.lit(1)).alias("_k"), F.count_distinct("_n").alias("_d"))
    forms = forms.filter(F.col("_d") >= F.least(F.lit(10), F.col("_k") / 2))  # else they are cut alike
    total = values.agg(F.count(F.lit(1)))
    forms = forms.filter((F.col("_k") >= rule.usual_line * total.scalar()) & (F.col("_k") >= 2))
    return forms.filter(~F.col("_form").rlike(r"^[X0 ,.]*$")).select("_form", F.lit(True).alias("_usual"))


def cut_quotes(evidence: DataFrame, sources: DataFrame, answers: DataFrame, rule: SpikeRule = SpikeRule(), short: list[str] | None = None) -> DataFrame:
    """answer_id, line_no, channel, reason (limit or break) of each cut quote.

    An unterminated quote at a spike is cut, unless its source shows that it lacks only the full stop; one elsewhere if
    its source goes on inside the sentence. Dots after a break do not end it.
    Null, empty and blank quotes are none. Resent rows are taken once; a quote without its answer has a null channel.
    """
    short = abbreviations(answers, rule) if short is None else short
    e = evidence.select("answer_id", "line_no", "source_index", F.col("quote").alias("_q")).filter(F.col("_q").isNotNull())
    e = e.withColumn("_r", right_trim(F.col("_q"))).filter((F.col("_r") != "") & ~is_terminated(F.col("_r"), short))
    e = e.withColumn("_core", right_trim(F.regexp_replace("_r", DOTS, ""))).filter(F.col("_core") != "")
    e = e.withColumn("_n", F.length("_q")).withColumn("_b", F.octet_length("_q")).withColumn("_u", F.lit(True)).dropDuplicates(["answer_id", "line_no"])
    s = sources.select("answer_id", "source_index", F.concat(F.array(F.coalesce("text", F.lit(""))), F.coalesce("extra_texts", F.array())).alias("_fields"))
    c = answers.select("answer_id", "channel").dropDuplicates(["answer_id"])
    e = written(e.join(c, "answer_id", "left").drop("_q"), "open_quotes")
    spikes = length_spikes(e, "channel", "_n", "_b", "_u", rule)
    joined = e.join(s, ["answer_id", "source_index"], "left")

    def plain(x: Column) -> Column:
        return F.regexp_replace(x, r"[^\x{21}-\x{7E}]+", "")

    def holds(fields: Column, core: Column) -> Column:
        return F.exists(fields, lambda field: F.contains(field, core))

    def closes(fields: Column, core: Column) -> Column:
        return F.exists(fields, lambda field: ends_sentence(field, core))

    def ends_sentence(field: Column, core: Column) -> Column:
        return F.contains(field, F.concat(core, F.lit("."))) | F.contains(field, F.concat(core, F.lit("!"))) | F.contains(field, F.concat(core, F.lit("?"))) | F.endswith(right_trim(field), core)

    inner = F.regexp_extract("_r", LAST_WORD, 1).isin(short) if short else F.lit(False)
    tail = F.substring(F.col("_core"), -24, 24)
    ascii_tail = F.substring(plain(F.col("_core")), -24, 24)
    fields = F.filter(F.coalesce("_fields", F.array()), lambda f: f.isNotNull())
    verdict = F.when(inner, True)
    for piece, seen in ((F.col("_core"), lambda f: f), (tail, lambda f: f), (ascii_tail, plain)):
        own = F.transform(fields, seen)
        verdict = verdict.when((F.length(piece) >= 8) & holds(own, piece), ~closes(own, piece))
    found = joined.withColumn("_verdict", verdict).groupBy("answer_id", "line_no").agg(
        F.first("channel").alias("channel"), F.first("_n").alias("_n"), F.first("_b").alias("_b"), F.min("_verdict").alias("_verdict")
    )
    marked = mark_spikes(found, spikes, "channel", "_n", "_b")
    whole = F.coalesce(~F.col("_verdict"), F.lit(False))  # the source has its full stop here
    return marked.filter((F.col("at_spike") & ~whole) | F.col("_verdict")).select("answer_id", "line_no", "channel", F.when(F.col("at_spike"), "limit").otherwise("break").alias("reason"))


def cut_rates(answers: DataFrame, evidence: DataFrame, sources: DataFrame, rule: SpikeRule = SpikeRule()) -> DataFrame:
    """channel, field, n_values, n_cut, cut_rate: how often each channel's answers and quotes are cut; resent rows count once."""
    channels = answers.select("answer_id", "channel").dropDuplicates(["answer_id"])
    quotes = evidence.select("answer_id", "line_no").dropDuplicates().join(channels, "answer_id", "left")
    whole = channels.groupBy("channel").agg(F.count(F.lit(1)).alias("n_values")).withColumn("field", F.lit("answer"))
    whole = whole.unionByName(quotes.groupBy("channel").agg(F.count(F.lit(1)).alias("n_values")).withColumn("field", F.lit("quote")))
    short = abbreviations(answers, rule)
    cut = cut_answers(answers, rule, short).select("channel", F.lit("answer").alias("field")).unionByName(cut_quotes(evidence, sources, answers, rule, short).select("channel", F.lit("quote").alias("field")))
    cut = cut.groupBy("channel", "field").agg(F.count(F.lit(1)).alias("n_cut")).withColumnsRenamed({"channel": "_c", "field": "_f"})
    joined = whole.join(cut, whole["channel"].eqNullSafe(F.col("_c")) & (whole["field"] == F.col("_f")), "left")
    n_cut = F.coalesce("n_cut", F.lit(0))
    return joined.select("channel", "field", "n_values", n_cut.alias("n_cut"), (n_cut / F.col("n_values")).alias("cut_rate"))

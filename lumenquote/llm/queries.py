"""The pN_ queries of the operators in this subpackage; each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenquote.llm import encode, lookalike, mixing, mojibake, spam, spans, truncation


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """All texts of sources and quotes of evidence as one column."""
    return _table(spark, folder, "sources").select("text").unionByName(_table(spark, folder, "evidence").select(F.col("quote").alias("text")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = lookalike.fit_vocabulary(_texts(spark, folder))
    return lookalike.quotes_that_only_look_alike(_table(spark, folder, "evidence"), _table(spark, folder, "sources"), vocabulary)


def p1_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """rec_id and the canonical form of each source text and quote; resent rows once."""
    vocabulary = lookalike.fit_vocabulary(_texts(spark, folder))
    texts = _table(spark, folder, "sources").select("rec_id", "text").unionByName(_table(spark, folder, "evidence").select("rec_id", F.col("quote").alias("text")))
    return lookalike.canonical_columns(texts.dropDuplicates(["rec_id"]), {"text": "canonical"}, vocabulary).select("rec_id", "canonical")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    answers, evidence, sources = (_table(spark, folder, t) for t in ("answers", "evidence", "sources"))
    short = truncation.abbreviations(answers)
    a = truncation.cut_answers(answers, short=short).select(F.lit("answer").alias("field"), "answer_id", F.lit(0).alias("line_no"))
    return a.unionByName(truncation.cut_quotes(evidence, sources, answers, short=short).select(F.lit("quote").alias("field"), "answer_id", "line_no"))


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_rates(*(_table(spark, folder, t) for t in ("answers", "evidence", "sources")))


def _garbled(spark: SparkSession, folder: str) -> DataFrame:
    texts = _texts(spark, folder)
    records = _table(spark, folder, "sources").select("rec_id", "text").unionByName(_table(spark, folder, "evidence").select("rec_id", F.col("quote").alias("text")))
    return mojibake.find_garbled(records, "rec_id", "text", model=mojibake.fit_pairs(texts))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _garbled(spark, folder).select("rec_id").distinct()


def p4_restored(spark: SparkSession, folder: str) -> DataFrame:
    return _garbled(spark, folder).dropDuplicates(["rec_id"])


def _span_records(spark: SparkSession, folder: str) -> DataFrame:
    sources = spans.long_fields(_table(spark, folder, "sources"), "rec_id", "answer_id", text_cols=("text",), array_cols=("extra_texts",))
    return sources.unionByName(spans.long_fields(_table(spark, folder, "evidence"), "rec_id", "answer_id", text_cols=("quote",)))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_pairs(_span_records(spark, folder))


def p5_links(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of p5_found as links to representatives, in a form that stays linear where many records share a passage."""
    return spans.shared_links(_span_records(spark, folder)).withColumnsRenamed({"rec": "rec_id", "rep": "rep_id"})


def p5_shares(spark: SparkSession, folder: str) -> DataFrame:
    extra = F.aggregate(F.coalesce("extra_texts", F.array()), F.lit(0), lambda n, x: n + F.coalesce(F.length(x), F.lit(0)))
    totals = _table(spark, folder, "sources").select(F.col("rec_id").alias("rec"), (F.coalesce(F.length("text"), F.lit(0)) + extra).alias("n_chars"))
    totals = totals.unionByName(_table(spark, folder, "evidence").select(F.col("rec_id").alias("rec"), F.coalesce(F.length("quote"), F.lit(0)).alias("n_chars")))
    return spans.shared_share(_span_records(spark, folder), totals).withColumnRenamed("rec", "rec_id")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode_documents(_table(spark, folder, "documents"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    tokens = mixing.document_tokens(_table(spark, folder, "documents"))
    return mixing.mix(tokens, _table(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    tokens = mixing.document_tokens(_table(spark, folder, "documents"))
    return mixing.report_shares(tokens, _table(spark, folder, "mix_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.score_documents(_table(spark, folder, "documents")).filter("is_spam").select("doc_id")


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    return spam.score_documents(_table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_canonical, p3_found, p3_rates, p4_found, p4_restored, p5_found, p5_links, p5_shares, p6_ids, p7_mix, p7_shares, p8_found, p8_scores)}


# Every window of 160 characters of every field, those that more than one answer has, and what follows from them.
WINDOWS = """WITH f AS (
  SELECT DISTINCT rec_id AS rec, answer_id AS grp, 0 AS field, text AS t FROM sources UNION ALL SELECT DISTINCT rec_id, answer_id, 0, quote FROM evidence
  UNION ALL SELECT rec, grp, unnest(range(1, len(x) + 1)), unnest(x) FROM (SELECT DISTINCT rec_id AS rec, answer_id AS grp, extra_texts AS x FROM sources)
), w AS (SELECT rec, grp, field, i, substr(t, i, 160) AS x FROM (SELECT *, unnest(range(1, length(t) - 158)) AS i FROM f WHERE length(t) >= 160)
), g AS (SELECT x FROM w GROUP BY x HAVING min(grp) < max(grp)
), s AS (SELECT w.* FROM w JOIN g ON w.x = g.x)"""


_W, _GAP = r"[\pL\pN]", r"[\s\x0B\pZ\x{FEFF}]"
_RTRIM = lambda x: f"regexp_replace({x}, '{_GAP}+$', '')"
_ENDED = lambda x: f"""(regexp_matches({x}, '[.!?。！？]["''»”“’)\\]]*$') AND NOT regexp_matches({x}, '(?:\\.{{2,}}|…)$') AND NOT coalesce(list_contains((SELECT list(w) FROM ab), regexp_extract({x}, '({_W}+)\\.$', 1)), false))"""
_PLAIN = lambda x: f"regexp_replace({x}, '[^\\x{{21}}-\\x{{7E}}]+', '', 'g')"


def _spikes(name: str, values: str) -> str:
    """Spikes of the lengths n and b of values by channel."""
    return f"""{name}h AS (SELECT channel, unit, l, count(*) AS n FROM (SELECT channel, 'c' AS unit, n AS l FROM {values} UNION ALL SELECT channel, 'b', b FROM {values}) GROUP BY ALL
), {name}w AS (SELECT *, (sum(n) OVER (PARTITION BY channel, unit ORDER BY l RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING) - n) / 40.0::DOUBLE AS near, coalesce(sum(n) OVER (PARTITION BY channel, unit ORDER BY l ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS above FROM {name}h
), {name} AS (SELECT channel, unit, l FROM {name}w WHERE n >= 3 AND n >= 4 * near AND above <= 4 * n)"""


def _at(name: str, row: str) -> str:
    return f"EXISTS (SELECT 1 FROM {name} z WHERE z.channel IS NOT DISTINCT FROM {row}.channel AND z.l = CASE unit WHEN 'c' THEN {row}.n ELSE {row}.b END)"


def _held(piece: str, field: str) -> str:
    """Whether a field holds the piece of a quote, and whether it closes its sentence there."""
    return f"bool_or(contains({field}, {piece})) AS h{{k}}, bool_or(contains({field}, {piece} || '.') OR contains({field}, {piece} || '!') OR contains({field}, {piece} || '?') OR ends_with({_RTRIM(field)}, {piece})) AS c{{k}}"


CUT = f"""WITH a0 AS (SELECT answer_id, any_value(channel) AS channel, any_value(answer) AS t FROM answers GROUP BY answer_id
), st AS (SELECT unnest(p[1:len(p) - 1]) AS x, unnest(p[2:]) AS y FROM (SELECT string_split_regex(coalesce(answer, ''), '\\.[\\s\\x0B\\pZ]+') AS p FROM answers)
), ab AS (
  SELECT w FROM (SELECT regexp_extract(x, '({_W}+)$', 1) AS w, regexp_matches(y, '^[\\p{{Ll}}\\pN]') AS low FROM st WHERE regexp_matches(y, '^{_W}')) WHERE w <> ''
  GROUP BY w HAVING count(*) >= 0.001 * (SELECT count(*) FROM answers) AND count(*) >= 5 AND count(*) FILTER (low) >= 0.9 * count(*)
), a1 AS (SELECT *, {_RTRIM('t')} AS r, length(t) AS n, strlen(t) AS b FROM a0 WHERE {_RTRIM('t')} <> ''
), ln AS (SELECT answer_id, unnest(range(0, len(l))) AS i, trim(regexp_replace(unnest(l), '\\r|\\t', ' ', 'g')) AS x FROM (SELECT answer_id, string_split(r, chr(10)) AS l FROM a1)
), mk AS (SELECT answer_id, max(i) FILTER (x = 'EVI1') AS s, max(i) FILTER (x = 'END_EVI1') AS e FROM ln GROUP BY answer_id
), a2 AS (
  SELECT channel, a1.answer_id, n, b, r, s IS NOT NULL AND (e IS NULL OR e < s) AS open, e IS NOT NULL AND NOT (s IS NOT NULL AND e < s) AS closed,
    regexp_replace(regexp_replace(trim(string_split(r, chr(10))[-1]), '[0-9]+', '0', 'g'), '(^|[^\\pL\\pM])\\p{{Lu}}[\\pL\\pM]+', '\\1X', 'g') AS form FROM a1 JOIN mk ON a1.answer_id = mk.answer_id
), a3 AS (SELECT * FROM a2 WHERE open OR NOT (closed OR {_ENDED('r')} OR regexp_matches(r, '\\{{c[0-9]+\\}}$'))
), us AS (
  SELECT form FROM a3 WHERE NOT open AND NOT regexp_matches(form, '^[X0 ,.]*$') GROUP BY form
  HAVING count(DISTINCT n) >= least(10, count(*) / 2.0) AND count(*) >= 0.02 * (SELECT count(*) FROM a3 WHERE NOT open) AND count(*) >= 2
), a4 AS (SELECT a3.*, us.form IS NOT NULL AS usual FROM a3 LEFT JOIN us ON a3.form = us.form), ao AS (SELECT * FROM a4 WHERE open OR NOT usual
), {_spikes('sa', 'ao')}, ca AS (SELECT answer_id, channel FROM a4 WHERE open OR NOT usual OR {_at('sa', 'a4')}
), q0 AS (SELECT DISTINCT answer_id, line_no, source_index, quote AS t, {_RTRIM('quote')} AS r FROM evidence WHERE quote IS NOT NULL
), q1 AS (
  SELECT q0.answer_id, line_no, source_index, channel, q0.r, length(q0.t) AS n, strlen(q0.t) AS b, {_RTRIM("regexp_replace(q0.r, '(?:\\.{2,}|…)$', '')")} AS core FROM q0 LEFT JOIN a0 ON q0.answer_id = a0.answer_id
  WHERE q0.r <> '' AND NOT {_ENDED('q0.r')}
), q2 AS (SELECT *, right(core, 24) AS tail, right({_PLAIN('core')}, 24) AS bare FROM q1 WHERE core <> ''
), sf AS (SELECT answer_id, source_index, unnest(list_prepend(coalesce(text, ''), coalesce(extra_texts, []))) AS f FROM (SELECT DISTINCT answer_id, source_index, text, extra_texts FROM sources)
), {_spikes('sq', 'q2')}, q3 AS (
  SELECT q2.answer_id, line_no, {', '.join(_held(p, f).replace('{k}', str(k)) for k, (p, f) in enumerate((('core', 'f'), ('tail', 'f'), ('bare', _PLAIN('f')))))}
  FROM q2 JOIN sf ON q2.answer_id = sf.answer_id AND q2.source_index = sf.source_index GROUP BY q2.answer_id, line_no
), q4 AS (
  SELECT q2.*, CASE WHEN coalesce(list_contains((SELECT list(w) FROM ab), regexp_extract(r, '({_W}+)\\.$', 1)), false) THEN true
    WHEN length(core) >= 8 AND h0 THEN NOT c0 WHEN length(tail) >= 8 AND h1 THEN NOT c1 WHEN length(bare) >= 8 AND h2 THEN NOT c2 END AS cut
  FROM q2 LEFT JOIN q3 ON q2.answer_id = q3.answer_id AND q2.line_no = q3.line_no
), cq AS (SELECT answer_id, line_no, channel FROM q4 WHERE cut OR (cut IS NULL AND {_at('sq', 'q4')}))"""
RATES = """, al AS (SELECT channel, 'answer' AS field, answer_id, 0 AS line_no FROM a0 UNION ALL SELECT channel, 'quote', e.answer_id, line_no FROM (SELECT DISTINCT answer_id, line_no FROM evidence) e LEFT JOIN a0 ON e.answer_id = a0.answer_id
), ct AS (SELECT 'answer' AS field, answer_id, 0 AS line_no FROM ca UNION ALL SELECT 'quote', answer_id, line_no FROM cq)
SELECT al.channel, al.field, count(*) AS n_values, count(ct.answer_id) AS n_cut, count(ct.answer_id) / count(*)::DOUBLE AS cut_rate FROM al LEFT JOIN ct ON al.field = ct.field AND al.answer_id = ct.answer_id AND al.line_no = ct.line_no GROUP BY al.channel, al.field"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"{CUT} SELECT 'answer' AS field, answer_id, 0::INTEGER AS line_no FROM ca UNION ALL SELECT 'quote', answer_id, line_no FROM cq",
        "p3_rates": CUT + RATES,
        "p5_found": f"{WINDOWS} SELECT DISTINCT a.rec AS rec_a, b.rec AS rec_b FROM (SELECT DISTINCT rec, grp, x FROM s) a JOIN (SELECT DISTINCT rec, grp, x FROM s) b ON a.x = b.x WHERE a.rec < b.rec AND a.grp <> b.grp",
        "p5_shares": f"""{WINDOWS}, n AS (SELECT rec, max(grp) AS grp, sum(coalesce(length(t), 0))::BIGINT AS n_chars FROM f GROUP BY rec
), c AS (SELECT rec, sum(least(160, i - coalesce(b, i - 160)))::BIGINT AS shared_chars FROM (SELECT rec, i, lag(i) OVER (PARTITION BY rec, field ORDER BY i) AS b FROM s) GROUP BY rec
) SELECT n.rec AS rec_id, n_chars::INTEGER AS n_chars, coalesce(shared_chars, 0) AS shared_chars, CASE WHEN n_chars > 0 THEN coalesce(shared_chars, 0) / n_chars::DOUBLE END AS shared_share FROM n LEFT JOIN c ON n.rec = c.rec""",
    }

"""The same queries as SQL for another engine, written apart from the operators."""

from __future__ import annotations

import unicodedata

from lumenquote.functions.text import BLANK
from lumenquote.operators import gate
from lumenquote.operators.protocol import MESSAGES

WS = BLANK
TRIM = lambda x: f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"
COLLAPSE = lambda x: f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"
TRUNCATE = lambda x, n: f"CASE WHEN length({x}) <= {n} THEN {x} ELSE substr({x}, 1, {n - 1}) || '…' END"
UNESCAPE = lambda x: f"array_to_string([regexp_replace(replace(p, '\\n', chr(10)), '\\\\(.)', '\\1', 'g') for p in string_split({x}, '\\\\')], '\\')"
LINE = r'^(c[0-9]+)\|([0-9]+)\|"([\s\S]*)"$'
HUGE = LARGEST = str(2**63 - 1)


# What the normal form says of a character, written here once more and apart from the operator's own tables.
_SAME = {"'": (0x2018, 0x2019, 0x201A, 0x201B, 0x2032), '"': (0x201C, 0x201D, 0x201E, 0x201F, 0x2033, 0xAB, 0xBB), "-": (*range(0x2010, 0x2016), 0x2212), "": (0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF)}
_BLOCKS = (range(0x41, 0x5B), range(0xA0, 0x530), range(0x1E00, 0x2150), range(0x2212, 0x2213), range(0x3000, 0x3001), range(0xFB00, 0xFB07), range(0xFEFF, 0xFF00), range(0xFF01, 0xFF5F))


def _changed() -> list[tuple[str, str]]:
    """Characters of the blocks above that the normal form changes, and into what."""
    same = {chr(c): x for x, own in _SAME.items() for c in own}
    pairs = ((chr(c), same.get(chr(c), unicodedata.normalize("NFKC", chr(c)).lower())) for r in _BLOCKS for c in r)
    return [(a, b) for a, b in pairs if a != b]


def _q(x: str) -> str:
    return x.replace("'", "''")


def _normal_sql(x: str) -> str:
    """Normal form of a text, by replacements."""
    pairs = _changed()
    for a, b in pairs:
        if len(b) > 1 and (ord(a) < 0x250 or 0x2000 <= ord(a) < 0x2150 or ord(a) > 0xFA00):
            x = f"replace({x}, '{_q(a)}', '{_q(b)}')"
    gone = "".join(a for a, b in pairs if not b)
    one = [(a, b) for a, b in pairs if len(b) == 1]
    return COLLAPSE(f"translate({x}, '{_q(''.join(a for a, _ in one) + gone)}', '{_q(''.join(b for _, b in one))}')")


# Normal form character by character, with places: rows of (key, t) become (key, place in the normal form, character, place in t).
_MAP = "nmap(c, n) AS (VALUES " + ", ".join(f"('{_q(a)}', '{_q(b)}')" for a, b in _changed()) + ")"


def _places(name: str, rows: str, key: str) -> str:
    return f"""{name}0 AS (SELECT {key}, t, unnest(range(0, length(t))) AS i FROM ({rows})
), {name}1 AS (SELECT {key}, i, coalesce(nmap.n, substr(t, i + 1, 1)) AS n FROM {name}0 LEFT JOIN nmap ON nmap.c = substr(t, i + 1, 1)
), {name}2 AS (SELECT {key}, i, unnest(range(0, length(n))) AS k, n FROM {name}1 WHERE n <> ''
), {name}3 AS (SELECT {key}, i, k, substr(n, k + 1, 1) AS x, regexp_matches(substr(n, k + 1, 1), '{WS}') AS b FROM {name}2
), {name}4 AS (SELECT *, lag(b) OVER (PARTITION BY {key} ORDER BY i, k) AS pb FROM {name}3
), {name} AS (SELECT {key}, i, CASE WHEN b THEN ' ' ELSE x END AS x, row_number() OVER (PARTITION BY {key} ORDER BY i, k) - 1 AS p FROM {name}4 WHERE NOT (b AND coalesce(pb, true)))"""


ANS = """ans AS (SELECT answer_id, arg_min(answer, received_at) AS answer, arg_min(coalesce(context_window_chars, 420), received_at) AS width FROM answers GROUP BY answer_id)"""

PARTS = f"""{ANS}, ln AS (
  SELECT answer_id, answer, width, unnest(range(0, len(l))) AS i, unnest(l) AS line FROM (SELECT *, string_split(coalesce(answer, ''), chr(10)) AS l FROM ans)
), tl AS (SELECT *, {TRIM('line')} AS t FROM ln
), e0 AS (SELECT answer_id, max(i) FILTER (t = 'END_EVI1') AS e FROM tl GROUP BY answer_id
), mk AS (SELECT tl.answer_id, any_value(e) AS e, max(i) FILTER (t = 'EVI1' AND i < e) AS s FROM tl JOIN e0 ON tl.answer_id = e0.answer_id GROUP BY tl.answer_id
), body AS (
  SELECT a.answer_id, CASE WHEN mk.s IS NULL THEN coalesce(a.answer, '') ELSE regexp_replace(coalesce(b.txt, ''), '{WS}+$', '') END AS body
  FROM ans a JOIN mk ON a.answer_id = mk.answer_id
  LEFT JOIN (SELECT tl.answer_id, string_agg(line, chr(10) ORDER BY i) AS txt FROM tl JOIN mk ON tl.answer_id = mk.answer_id WHERE i < s OR i > e GROUP BY tl.answer_id) b ON a.answer_id = b.answer_id
), ap AS (
  SELECT tl.answer_id, i - s AS line_no, t AS line, regexp_matches(t, '{LINE}') AS ok,
    CASE WHEN regexp_matches(t, '{LINE}') THEN coalesce(try_cast(regexp_extract(t, '{LINE}', 2) AS BIGINT), {HUGE}) END AS source_index
  FROM tl JOIN mk ON tl.answer_id = mk.answer_id WHERE s IS NOT NULL AND i > s AND i < e AND t <> ''
), ev AS (
  SELECT answer_id, line_no, regexp_extract(line, '{LINE}', 1) AS claim_id, source_index, {UNESCAPE(f"regexp_extract(line, '{LINE}', 3)")} AS quote
  FROM ap WHERE ok AND source_index >= 1
), ev1 AS (SELECT *, row_number() OVER (PARTITION BY answer_id, claim_id, source_index ORDER BY line_no) AS rn FROM ev
), bl AS (
  SELECT answer_id, unnest(range(0, len(l))) AS line_no, unnest(l) AS line FROM (SELECT answer_id, string_split(body, chr(10)) AS l FROM body)
), sg AS (
  SELECT answer_id, line_no, unnest(range(0, len(ids))) AS seg_no, 'c' || unnest(ids) AS claim_id, unnest(segs[1:len(ids)]) AS segment
  FROM (SELECT answer_id, line_no, regexp_extract_all(line, '\\{{c([0-9]+)\\}}', 1) AS ids, string_split_regex(line, '\\{{c[0-9]+\\}}') AS segs FROM bl WHERE contains(line, '{{c'))
), sq AS (SELECT *, regexp_extract(segment, '((?:\\[[0-9]+\\])+)$', 1) AS grp, row_number() OVER (PARTITION BY answer_id, claim_id ORDER BY line_no, seg_no) AS rn FROM sg
), cl AS (
  SELECT answer_id, line_no, seg_no, claim_id, grp, {COLLAPSE("regexp_replace(regexp_replace(segment, '\\[[0-9]+\\]', '', 'g'), '\\{c[0-9]+\\}', '', 'g')")} AS claim_text FROM sq WHERE rn = 1
), ci0 AS (
  SELECT answer_id, claim_id, line_no, seg_no, unnest(range(0, len(ns))) AS p, coalesce(try_cast(unnest(ns) AS BIGINT), {HUGE}) AS source_index
  FROM (SELECT *, regexp_extract_all(grp, '\\[([0-9]+)\\]', 1) AS ns FROM cl)
), ci1 AS (SELECT answer_id, claim_id, source_index, min(line_no) AS line_no, min(seg_no) AS seg_no, min(p) AS p FROM ci0 GROUP BY ALL
), ci AS (SELECT *, row_number() OVER (PARTITION BY answer_id, claim_id ORDER BY p) - 1 AS cite_no FROM ci1
), src AS (SELECT answer_id, source_index::BIGINT AS source_index, any_value(text) AS text, any_value(extra_texts) AS extra_texts FROM sources GROUP BY answer_id, source_index
), dup_ev AS (SELECT * FROM ev1 WHERE rn > 1
), orphan AS (SELECT e.* FROM ev1 e WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM ci WHERE ci.answer_id = e.answer_id AND ci.claim_id = e.claim_id AND ci.source_index = e.source_index)
), lacking AS (SELECT ci.* FROM ci WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ci.answer_id = ev.answer_id AND ci.claim_id = ev.claim_id AND ci.source_index = ev.source_index)
), nosrc AS (SELECT e.* FROM ev1 e WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM src WHERE src.answer_id = e.answer_id AND src.source_index = e.source_index)
)"""

# Fields of a source in order, with the evidence that cites it; then literal, normal and fuzzy hits per field.
MATCH = f"""{PARTS}, pr AS (
  SELECT e.answer_id, e.line_no, e.claim_id, e.source_index, e.quote, s.text, s.extra_texts FROM ev1 e JOIN src s ON e.answer_id = s.answer_id AND e.source_index = s.source_index WHERE rn = 1
), fd AS (
  SELECT answer_id, line_no, {TRIM('quote')} AS q, unnest(range(0, 1 + coalesce(len(extra_texts), 0))) AS f, unnest(list_concat([text], coalesce(extra_texts, []))) AS t FROM pr
), f1 AS (SELECT *, CASE WHEN strpos(t, q) > 0 THEN strpos(t, q) - 1 END AS hit FROM fd WHERE length({TRIM("coalesce(t, '')")}) >= 40 AND q <> ''
), f2 AS (SELECT *, CASE WHEN hit IS NULL THEN {_normal_sql('q')} END AS nq, CASE WHEN hit IS NULL THEN {_normal_sql('t')} END AS nt FROM f1
), lit AS (SELECT *, hit IS NULL AND nq <> '' AND nt <> '' AND strpos(nt, nq) > 0 AS norm FROM f2
), fz AS (
  SELECT answer_id, line_no, f, nq, nt, length(nq) AS l, length(nt) AS n, least(80, greatest(10, floor(length(nq) / 8.0 + 0.5)))::BIGINT AS step
  FROM lit WHERE hit IS NULL AND NOT norm AND length(nq) >= 3 AND length(nt) >= 3
), qg AS (SELECT answer_id, line_no, f, g, count(*) AS want FROM (SELECT answer_id, line_no, f, substr(nq, unnest(range(1, l - 1)), 3) AS g FROM fz) GROUP BY ALL
), tg AS (
  SELECT x.answer_id, x.line_no, x.f, x.p, x.g, qg.want FROM (SELECT answer_id, line_no, f, unnest(range(0, n - 2)) AS p, substr(nt, unnest(range(1, n - 1)), 3) AS g FROM fz) x
  JOIN qg ON x.answer_id = qg.answer_id AND x.line_no = qg.line_no AND x.f = qg.f AND x.g = qg.g
), sc AS (
  SELECT answer_id, line_no, f, l, n, step, k, CASE WHEN w > n THEN n ELSE w END AS w, w > n AS whole
  FROM (SELECT *, greatest(40, floor(l * s + 0.5))::BIGINT AS w FROM fz, (VALUES (0, 0.85::DOUBLE), (1, 1.0::DOUBLE), (2, 1.15::DOUBLE)) v(k, s))
), ps AS (SELECT answer_id, line_no, f, l, k, w, unnest(CASE WHEN whole THEN [0::BIGINT] ELSE range(0, n - w + 1, step) END) AS pos FROM sc
), cn AS (
  SELECT ps.answer_id, ps.line_no, ps.f, k, w, l, pos, g, least(any_value(want), count(*)) AS c FROM ps JOIN tg ON ps.answer_id = tg.answer_id AND ps.line_no = tg.line_no AND ps.f = tg.f AND tg.p >= pos AND tg.p < pos + w - 2 GROUP BY ALL
), dc AS (SELECT answer_id, line_no, f, k, w, l, pos, 2.0::DOUBLE * sum(c) / (l - 2 + w - 2) AS d FROM cn GROUP BY answer_id, line_no, f, k, w, l, pos
), b1 AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY answer_id, line_no, f, k ORDER BY (d >= 0.995) DESC, CASE WHEN d >= 0.995 THEN pos END, d DESC, pos) AS r FROM dc) WHERE r = 1
), b2 AS (SELECT * FROM (SELECT * EXCLUDE r, row_number() OVER (PARTITION BY answer_id, line_no, f ORDER BY d DESC, k) AS r FROM b1) WHERE r = 1
), pf AS (
  SELECT b2.answer_id, b2.line_no, b2.f, b2.w, b2.l, unnest(range(greatest(0, pos - step), least(pos + step, n - w) + 1)) AS pos FROM b2 JOIN fz ON b2.answer_id = fz.answer_id AND b2.line_no = fz.line_no AND b2.f = fz.f
), cf AS (
  SELECT pf.answer_id, pf.line_no, pf.f, w, l, pos, g, least(any_value(want), count(*)) AS c FROM pf JOIN tg ON pf.answer_id = tg.answer_id AND pf.line_no = tg.line_no AND pf.f = tg.f AND tg.p >= pos AND tg.p < pos + w - 2 GROUP BY ALL
), df AS (SELECT answer_id, line_no, f, pos, 2.0::DOUBLE * sum(c) / (any_value(l) - 2 + any_value(w) - 2) AS d FROM cf GROUP BY ALL
), b3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY answer_id, line_no, f ORDER BY (d >= 0.995) DESC, CASE WHEN d >= 0.995 THEN pos END, d DESC, pos) AS r FROM df) WHERE r = 1
), fu AS (
  SELECT b2.answer_id, b2.line_no, b2.f, greatest(b2.d, b3.d) AS d, b2.l, CASE WHEN b3.d > b2.d THEN b3.pos ELSE b2.pos END AS pos, b2.w FROM b2 JOIN b3 ON b2.answer_id = b3.answer_id AND b2.line_no = b3.line_no AND b2.f = b3.f
), sf AS (
  SELECT lit.answer_id, lit.line_no, lit.f, lit.hit, length(lit.q) AS ql, lit.t, CASE WHEN norm THEN strpos(lit.nt, lit.nq) - 1 ELSE fu.pos END AS np, CASE WHEN norm THEN length(lit.nq) ELSE fu.w END AS nw,
    CASE WHEN hit IS NOT NULL THEN 'exact' WHEN norm THEN 'normalized' WHEN least(0.99, coalesce(fu.d, 0) * least(1.0, coalesce(fu.l, 0) / 90.0::DOUBLE)) >= 0.4 THEN 'fuzzy' ELSE 'not_found' END AS method,
    CASE WHEN hit IS NOT NULL OR norm THEN 1.0 ELSE least(0.99, coalesce(fu.d, 0) * least(1.0, coalesce(fu.l, 0) / 90.0::DOUBLE)) END::DOUBLE AS score
  FROM lit LEFT JOIN fu ON lit.answer_id = fu.answer_id AND lit.line_no = fu.line_no AND lit.f = fu.f
), bf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY answer_id, line_no ORDER BY score DESC, f) AS r FROM sf WHERE score > 0) WHERE r = 1
), cit AS (
  SELECT pr.answer_id, pr.line_no, pr.claim_id, pr.source_index, pr.quote, pr.text, coalesce(bf.method, 'not_found') AS method, coalesce(bf.score, 0.0) AS score, bf.hit AS start,
    CASE WHEN coalesce(bf.f, 0) = 0 THEN 'text' ELSE 'extraTexts[' || (bf.f - 1) || ']' END AS field, bf.ql, bf.t, bf.np, bf.nw, coalesce(cl.claim_text, '') AS claim_text
  FROM pr LEFT JOIN bf ON pr.answer_id = bf.answer_id AND pr.line_no = bf.line_no LEFT JOIN cl ON pr.answer_id = cl.answer_id AND pr.claim_id = cl.claim_id
)"""

# Citations with the places of all hits in the raw text.
PLACED = f"""{MATCH}, {_MAP}, {_places('pl', "SELECT answer_id, line_no, t FROM cit WHERE method IN ('normalized', 'fuzzy')", 'answer_id, line_no')}, pm AS (
  SELECT c.answer_id, c.line_no, min(i) FILTER (p = np) AS s, max(i) FILTER (p <= np + nw - 1) + 1 AS e FROM cit c JOIN pl ON c.answer_id = pl.answer_id AND c.line_no = pl.line_no GROUP BY c.answer_id, c.line_no
), cix AS (
  SELECT c.* EXCLUDE (start), coalesce(start, pm.s) AS start, coalesce(start + ql, pm.e) AS stop FROM cit c LEFT JOIN pm ON c.answer_id = pm.answer_id AND c.line_no = pm.line_no
)"""

JUDGED = f"""{MATCH}, rs AS (
  SELECT answer_id, id, CASE WHEN entailment_class IN ('entailed', 'partially_entailed', 'overstated', 'insufficient', 'contradicted') THEN entailment_class ELSE 'error' END AS class,
    CASE WHEN confidence IS NOT NULL AND isfinite(confidence) THEN greatest(0.0, least(1.0, confidence)) END AS confidence, judged_at,
    [substr({COLLAPSE("coalesce(x, '')")}, 1, 200) for x in coalesce(reasons, [])[1:2]] AS reasons
  FROM judge_results WHERE id <> ''
), r1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY answer_id, id ORDER BY judged_at, class, confidence NULLS FIRST) AS rn FROM rs) WHERE rn = 1
), jc AS (
  SELECT c.*, CASE WHEN c.claim_text <> '' AND c.quote <> '' THEN coalesce(r1.class, 'error') END AS class, CASE WHEN c.claim_text <> '' AND c.quote <> '' THEN r1.confidence END AS confidence,
    CASE WHEN c.claim_text <> '' AND c.quote <> '' THEN CASE WHEN r1.id IS NULL THEN ['missing_item'] ELSE r1.reasons END END AS reasons
  FROM cit c LEFT JOIN r1 ON c.answer_id = r1.answer_id AND r1.id = c.claim_id || '|' || c.source_index
), js AS (SELECT *, CASE WHEN class IS NULL THEN score WHEN class = 'error' OR confidence IS NULL THEN NULL ELSE least(score, confidence) END AS final FROM jc)"""

R6 = lambda x: f"round({x}, 6)"

UNCITED = f"""uc AS (
  SELECT answer_id, line_no, unnest(range(0, len(ss))) AS sentence_no, {TRIM('unnest(ss)')} AS s
  FROM (SELECT answer_id, line_no, string_split(regexp_replace(t, '([.!?]){WS}+([A-Z0-9"''“(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ss
        FROM (SELECT answer_id, line_no, {TRIM('line')} AS t FROM bl) WHERE t <> '' AND NOT regexp_matches(t, '^#{{1,6}}[\\s\\x{{A0}}]'))
), un AS (
  SELECT answer_id, line_no, sentence_no, CASE WHEN length(s) > 240 THEN substr(s, 1, 237) || '…' ELSE s END AS sentence FROM uc
  WHERE length(s) >= 40 AND NOT ends_with(s, '?') AND NOT regexp_matches(s, '\\[[0-9]+\\]') AND regexp_matches(s, '[A-Za-z]{{3}}')
)"""

PROBLEMS = f"""gp AS (
  SELECT answer_id, line_no, claim_id, source_index, claim_text, method, floor(score * 100 + 0.5) / 100 AS text_score, class, floor(confidence * 100 + 0.5) / 100 AS confidence, floor(final * 100 + 0.5) / 100 AS score,
    CASE WHEN method = 'not_found' THEN 'quote_not_in_source' WHEN class = 'contradicted' THEN 'contradicted_by_source' WHEN class = 'overstated' THEN 'overstated' ELSE 'weakly_supported' END AS type
  FROM js WHERE method = 'not_found' OR coalesce(class IN ('contradicted', 'overstated'), false) OR coalesce(final < 0.5, false)
)"""

_ADVICE = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in gate.ADVICE.items()) + " END"
_LINE_OF = f"'- Claim ' || claim_id || ' (\"' || {TRUNCATE('claim_text', 120)} || '\"): ' || {_ADVICE} || '.'"
_UNCITED_OF = f"'- No citation: \"' || {TRUNCATE('sentence', 120)} || '\"; {gate.UNCITED_ADVICE}.'"
GATE = f"""{JUDGED}, {UNCITED}, {PROBLEMS}, gl AS (
  SELECT answer_id, 0 AS part, [line_no::BIGINT] AS ord, {_LINE_OF} AS line FROM gp
  UNION ALL SELECT answer_id, 1, [line_no::BIGINT, sentence_no], {_UNCITED_OF} FROM un
), gv AS (
  SELECT a.answer_id, coalesce(p, 0) AS n_problems, coalesce(u, 0) AS n_uncited, CASE WHEN {TRIM("coalesce(a.answer, '')")} = '' THEN 'error' WHEN p IS NULL THEN 'pass' ELSE 'revise' END AS verdict, txt
  FROM ans a LEFT JOIN (SELECT answer_id, count(*) FILTER (part = 0) AS p, count(*) FILTER (part = 1) AS u, string_agg(line, chr(10) ORDER BY part, ord) AS txt FROM gl GROUP BY answer_id) g ON a.answer_id = g.answer_id
)"""

# As jobs: thresholds by k = answer_id % 3, no judge for k = 2.
_K = "(answer_id % 3)"
JOBS = f"""{JUDGED}, {UNCITED.replace('length(s) >= 40', f"length(s) >= CASE {_K} WHEN 1 THEN 40 ELSE {_K} * 35 + 20 END")}, jb AS (
  SELECT * REPLACE (CASE WHEN {_K} < 2 THEN class END AS class, CASE WHEN {_K} < 2 THEN final ELSE score END AS final) FROM js
), gp AS (
  SELECT *, CASE WHEN method = 'not_found' THEN 'quote_not_in_source' WHEN class = 'contradicted' THEN 'contradicted_by_source' WHEN class = 'overstated' THEN 'overstated' ELSE 'weakly_supported' END AS type
  FROM jb WHERE method = 'not_found' OR coalesce(class IN ('contradicted', 'overstated'), false) OR coalesce(final < CASE {_K} WHEN 0 THEN 0.5::DOUBLE ELSE {_K} * 0.45::DOUBLE END, false)
)"""

_WARN = f"""wn AS (
  SELECT answer_id, 1 AS phase, CASE WHEN ok THEN 'invalid_index' ELSE 'malformed_line' END AS kind, [line_no::BIGINT] AS ord, NULL::VARCHAR AS claim_id, NULL::BIGINT AS source_index, {TRUNCATE('line', 80)} AS detail FROM ap WHERE NOT ok OR source_index < 1
  UNION ALL SELECT answer_id, 2, 'nonadjacent_group', [line_no::BIGINT, seg_no, 0], claim_id, NULL, NULL FROM sq WHERE grp = ''
  UNION ALL SELECT answer_id, 2, 'duplicate_claim', [line_no::BIGINT, seg_no, 1], claim_id, NULL, NULL FROM sq WHERE rn > 1
  UNION ALL SELECT answer_id, 3, 'duplicate_evidence', [line_no::BIGINT], claim_id, source_index, NULL FROM dup_ev
  UNION ALL SELECT answer_id, 3, 'orphan_evidence', [line_no::BIGINT], claim_id, source_index, NULL FROM orphan
  UNION ALL SELECT answer_id, 4, 'missing_evidence', [line_no::BIGINT, seg_no, cite_no], claim_id, source_index, NULL FROM lacking
  UNION ALL SELECT answer_id, 5, 'source_not_provided', [line_no::BIGINT], claim_id, source_index, NULL FROM nosrc
)"""
# What there is to say about a judge's results, for the citations of jx (answer_id, line_no, claim_id, source_index, claim_text, quote).
_JUDGE_WARN = """ja AS (SELECT answer_id, claim_id || '|' || source_index AS id FROM jx WHERE claim_text <> '' AND quote <> ''
), jn AS (SELECT ja.answer_id, count(*) AS k, count(r1.id) AS h FROM ja LEFT JOIN (SELECT DISTINCT answer_id, id FROM judge_results) r1 ON ja.answer_id = r1.answer_id AND ja.id = r1.id GROUP BY ja.answer_id
), jw AS (
  SELECT answer_id, 6 AS phase, 'judge_count_mismatch' AS kind, [0::BIGINT] AS ord, NULL::VARCHAR AS claim_id, NULL::BIGINT AS source_index, h || '/' || k AS detail FROM jn WHERE k <> h
  UNION ALL SELECT answer_id, 7, 'no_claim_text', [line_no::BIGINT], claim_id, source_index, NULL FROM jx WHERE claim_text = ''
)"""
_SAID = "CASE kind " + " ".join(f"WHEN '{k}' THEN replace(replace(replace('{_q(m)}', '%1$s', coalesce(claim_id, '')), '%2$s', coalesce(source_index::VARCHAR, '')), '%3$s', coalesce(detail, ''))" for k, m in MESSAGES.items()) + " END"
_CLAIMS = "(SELECT string_agg(concat_ws('|', claim_id, claim_text, coalesce((SELECT string_agg(source_index::VARCHAR, ',' ORDER BY p) FROM ci WHERE ci.answer_id = cl.answer_id AND ci.claim_id = cl.claim_id), '')), chr(10) ORDER BY line_no, seg_no) FROM cl WHERE cl.answer_id = b.answer_id)"


_FIELD = r'(?:"(?:[^"\\]|\\[\s\S])*"|[^"|]*)'
_PLAIN, _QUOTED = r'[^"|]*', r'"(?:[^"\\]|\\[\s\S])*"'
_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_DIGITS = lambda i, least, most: f"(regexp_matches(f[{i}], '^[0-9]+$') AND length(ltrim(f[{i}], '0')) <= 19 AND coalesce(try_cast('0' || ltrim(f[{i}], '0') AS HUGEINT), -1) BETWEEN {least} AND {most})"
REJECTS = f"""WITH r AS (
  SELECT raw_id, kind, regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS l FROM raw_lines WHERE line IS NOT NULL
), k AS (SELECT *, CASE kind WHEN 'evidence' THEN 4 WHEN 'answer' THEN 5 ELSE -1 END AS n FROM r WHERE l <> ''
), s AS (
  SELECT *, regexp_full_match(l, '{_FIELD}(?:\\|{_FIELD})*') AS lexed, regexp_full_match(l, '(?:{_PLAIN}\\|)*{_QUOTED}') AS last_only,
    CASE n WHEN 4 THEN regexp_full_match(l, '{_FIELD}(?:\\|{_FIELD}){{3}}') WHEN 5 THEN regexp_full_match(l, '{_FIELD}(?:\\|{_FIELD}){{4}}') ELSE false END AS counted FROM k
), v AS (
  SELECT *, string_split(l, '|') AS f, replace(replace(regexp_extract(l, '({_QUOTED})$', 1), '\\\\', chr(1)), '\\n', ' ') AS q FROM s
), t AS (
  SELECT *, {_DIGITS(1, 1, LARGEST)} AND regexp_full_match(regexp_replace(q[2:-2], '\\\\(.)', '\\1', 'g'), '{_SPACE}*') IS NOT TRUE
    AND CASE WHEN n = 4 THEN regexp_matches(f[2], '^c[0-9]+$') AND {_DIGITS(3, 1, 99)}
      ELSE f[2] IN ('web', 'api', 'mobile', 'mail', 'batch', 'kiosk') AND regexp_matches(f[3], '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-5][0-9]Z$')
        AND try_strptime(f[3], '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL AND {_DIGITS(4, 0, 5000)} END AS valid FROM v
) SELECT raw_id, CASE WHEN NOT lexed THEN 'quoting' WHEN NOT counted THEN 'columns' WHEN NOT last_only THEN 'quoting' ELSE 'value' END AS reason FROM t
WHERE NOT (lexed AND counted AND last_only AND coalesce(valid, false))"""


LOADED = REJECTS[: REJECTS.index(") SELECT raw_id, CASE WHEN NOT lexed")] + f""") SELECT raw_id, kind, f[1]::BIGINT AS answer_id, CASE WHEN n = 4 THEN f[2] END AS claim_id, CASE WHEN n = 4 THEN f[3]::INTEGER END AS source_index,
  CASE WHEN n = 4 THEN {UNESCAPE('x')} END AS quote, CASE WHEN n = 5 THEN f[2] END AS channel, CASE WHEN n = 5 THEN strptime(f[3], '%Y-%m-%dT%H:%M:%SZ') END AS created_at,
  CASE WHEN n = 5 THEN f[4]::INTEGER END AS context_window_chars, CASE WHEN n = 5 THEN {UNESCAPE('x')} END AS answer
FROM (SELECT *, regexp_extract(l, '({_QUOTED})$', 1)[2:-2] AS x FROM t WHERE lexed AND counted AND last_only AND coalesce(valid, false))"""


#: Columns that are int here and would be bigint there.
_INTS = {
    "json_recovery": "n_items", "parse_evidence": "line_no", "malformed_lines": "line_no", "invalid_index": "line_no", "extract_claims": "line_no seg_no", "duplicate_claims": "line_no seg_no",
    "nonadjacent_markers": "line_no seg_no", "evidence_dedupe": "line_no", "duplicate_evidence": "line_no", "orphan_evidence": "line_no", "missing_sources": "line_no",
    "exact_match": "line_no start end", "normalized_match": "line_no start end", "fuzzy_match": "line_no start end", "best_field_match": "line_no",
    "judged_scores": "line_no", "uncited_sentences": "line_no sentence_no", "gate_problems": "line_no", "gate_verdicts": "n_problems n_uncited", "gate_jobs": "n_warnings",
}


def oracle_sql() -> dict[str, str]:
    out = _sql()
    for name, columns in _INTS.items():
        casts = ", ".join(f'"{c}"::INTEGER AS "{c}"' for c in columns.split())
        out[name] = f"SELECT * REPLACE ({casts}) FROM ({out[name]})"
    return out


def _clean(x: str, most: int, tags: bool = False) -> str:
    """A text as a judge gets it."""
    plain = f"regexp_replace({x}, '[\\x00-\\x1F\\x7F-\\x9F]', ' ', 'g')"
    plain = f"regexp_replace({plain}, '<[^>]*>', ' ', 'g')" if tags else plain
    return f"substr({COLLAPSE(plain)}, 1, {most})"


_CONTEXT = "coalesce(CASE WHEN field = 'text' AND start IS NOT NULL THEN substr(text, greatest(start - width, 0) + 1, stop + width - greatest(start - width, 0)) ELSE substr(text, 1, 2 * width) END, '')"


def _sql() -> dict[str, str]:
    p, m, j = f"WITH {PARTS} ", f"WITH {MATCH} ", f"WITH {JUDGED} "
    return {
        "p2_found": REJECTS,
        "json_recovery": "SELECT answer_id, CASE WHEN answer_id % 5 = 4 THEN 0 ELSE count(*) END AS n_items, CASE WHEN answer_id % 5 = 4 THEN '' ELSE string_agg(x, chr(10) ORDER BY x) END AS items FROM (SELECT answer_id, concat_ws(' ', id, coalesce(entailment_class, '-'), coalesce(round(confidence * 1000)::BIGINT::VARCHAR, '-'), coalesce(reasons[1], '-')) AS x FROM (SELECT DISTINCT * FROM judge_results)) GROUP BY answer_id",
        "parse_evidence": p + "SELECT answer_id, line_no, claim_id, source_index, quote FROM ev",
        "malformed_lines": p + f"SELECT answer_id, line_no, {TRUNCATE('line', 80)} AS detail FROM ap WHERE NOT ok",
        "invalid_index": p + f"SELECT answer_id, line_no, {TRUNCATE('line', 80)} AS detail FROM ap WHERE ok AND source_index < 1",
        "strip_appendix": p + "SELECT answer_id, body FROM body",
        "clean_text": p + "SELECT answer_id, regexp_replace(body, '\\{c[0-9]+\\}', '', 'g') AS clean_text FROM body",
        "extract_claims": p + "SELECT cl.answer_id, cl.line_no, cl.seg_no, cl.claim_id, cl.claim_text, coalesce((SELECT string_agg(source_index::VARCHAR, ',' ORDER BY p) FROM ci WHERE ci.answer_id = cl.answer_id AND ci.claim_id = cl.claim_id), '') AS source_indexes FROM cl",
        "duplicate_claims": p + "SELECT answer_id, line_no, seg_no, claim_id FROM sq WHERE rn > 1",
        "nonadjacent_markers": p + "SELECT answer_id, line_no, seg_no, claim_id FROM sq WHERE grp = ''",
        "serialize_appendix": "SELECT answer_id, 'EVI1' || chr(10) || string_agg(claim_id || '|' || source_index || '|\"' || replace(replace(replace(quote, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n') || '\"', chr(10) ORDER BY line_no) || chr(10) || 'END_EVI1' AS appendix FROM (SELECT DISTINCT answer_id, line_no, claim_id, source_index, quote FROM evidence) GROUP BY answer_id",
        "serialize_roundtrip": "SELECT DISTINCT answer_id, claim_id, source_index::BIGINT AS source_index, quote, line_no AS original_line FROM evidence WHERE source_index >= 1 AND regexp_matches(claim_id, '^c[0-9]+$')",
        "evidence_dedupe": p + "SELECT answer_id, line_no, claim_id, source_index, quote FROM ev1 WHERE rn = 1",
        "duplicate_evidence": p + "SELECT answer_id, line_no, claim_id, source_index, quote FROM dup_ev",
        "orphan_evidence": p + "SELECT answer_id, line_no, claim_id, source_index, quote FROM orphan",
        "missing_evidence": p + "SELECT answer_id, claim_id, source_index FROM lacking",
        "missing_sources": p + "SELECT answer_id, line_no, claim_id, source_index, quote FROM nosrc",
        "warnings": p + f", {_WARN} SELECT answer_id, phase, kind, array_to_string(ord, '.') AS place, claim_id, source_index, detail FROM wn",
        "warnings_by_kind": p + f", {_WARN} SELECT kind, count(*) AS n, count(DISTINCT answer_id) AS n_answers FROM wn GROUP BY kind",
        "parsed_answers": p + f", {_WARN} SELECT b.answer_id, regexp_replace(body, '\\{{c[0-9]+\\}}', '', 'g') AS clean_text, coalesce({_CLAIMS}, '') AS claims, coalesce((SELECT string_agg(concat_ws('|', claim_id, source_index::VARCHAR, quote), chr(10) ORDER BY line_no) FROM ev1 WHERE rn = 1 AND ev1.answer_id = b.answer_id), '') AS evidence, coalesce((SELECT string_agg({_SAID}, chr(10) ORDER BY phase, ord) FROM wn WHERE phase < 5 AND wn.answer_id = b.answer_id), '') AS warnings FROM body b",
        "exact_match": m + "SELECT answer_id, line_no, start, start + ql AS \"end\", field FROM cit WHERE method = 'exact'",
        "normalized_match": f"WITH {PLACED} " + "SELECT answer_id, line_no, start, stop AS \"end\", field FROM cix WHERE method = 'normalized'",
        "fuzzy_match": f"WITH {PLACED} " + f"SELECT answer_id, line_no, method, {R6('score')} AS score, CASE WHEN method = 'fuzzy' THEN start END AS start, CASE WHEN method = 'fuzzy' THEN stop END AS \"end\", field FROM cix WHERE method IN ('fuzzy', 'not_found')",
        "best_field_match": m + f"SELECT answer_id, line_no, claim_id, source_index, method, {R6('score')} AS score, field FROM cit",
        "match_method_histogram": m + "SELECT method, count(*) AS n, count(*) FILTER (field <> 'text') AS n_extra FROM cit GROUP BY method",
        "normalized_quotes": f"SELECT rec_id, {_normal_sql('quote')} AS normal FROM (SELECT DISTINCT rec_id, quote FROM evidence)",
        "verification_report": j + f", {_WARN}, jx AS (SELECT * FROM cit), {_JUDGE_WARN}, w AS (SELECT * FROM wn UNION ALL SELECT * FROM jw), g AS (SELECT answer_id, count(*) AS n, string_agg(concat_ws('|', claim_id, source_index::VARCHAR, method, class, quote), chr(10) ORDER BY line_no) AS c, avg(CASE WHEN method IN ('exact', 'normalized') THEN 1.0 ELSE 0.0 END) AS v, count(*) FILTER (class = 'entailed') / nullif(count(class), 0)::DOUBLE AS er, avg(final) AS me, min(final) AS mi FROM js GROUP BY answer_id) SELECT b.answer_id, regexp_replace(body, '\\{{c[0-9]+\\}}', '', 'g') AS clean_text, coalesce({_CLAIMS}, '') AS claims, coalesce(c, '') AS citations, coalesce((SELECT string_agg(kind, chr(10) ORDER BY phase, ord) FROM w WHERE w.answer_id = b.answer_id), '') AS warnings, coalesce(n, 0) AS citation_count, {R6('v')} AS verbatim_rate, {R6('er')} AS entailed_rate, {R6('me')} AS mean_score, {R6('mi')} AS min_score FROM body b LEFT JOIN g ON b.answer_id = g.answer_id",
        "normal_offsets": f"WITH {_MAP}, {_places('pl', 'SELECT DISTINCT rec_id, quote AS t FROM evidence', 'rec_id')}, tr AS (SELECT *, max(p) FILTER (x <> ' ') OVER (PARTITION BY rec_id) AS z FROM pl), pt AS (SELECT rec_id, string_agg(x, '' ORDER BY p) AS normal, string_agg(i::VARCHAR, ',' ORDER BY p) AS places FROM tr WHERE p <= z GROUP BY rec_id) SELECT e.rec_id, CASE WHEN quote IS NOT NULL THEN coalesce(normal, '') END AS normal, CASE WHEN quote IS NOT NULL THEN coalesce(places, '') END AS places FROM (SELECT DISTINCT rec_id, quote FROM evidence) e LEFT JOIN pt ON e.rec_id = pt.rec_id",
        "trigram_counts": "SELECT rec_id, gram, count(*) AS n FROM (SELECT rec_id, substr(quote, unnest(range(1, length(quote) - 1)), 3) AS gram FROM (SELECT DISTINCT rec_id, quote FROM evidence) WHERE length(quote) >= 3) GROUP BY rec_id, gram",
        "dice_pairs": "WITH e AS (SELECT DISTINCT answer_id, line_no, source_index, quote FROM evidence), s AS (SELECT answer_id, source_index, any_value(text) AS text FROM sources GROUP BY ALL), p AS (SELECT e.answer_id, e.line_no, coalesce(quote, '') AS quote, coalesce(text, '') AS text FROM e JOIN s ON e.answer_id = s.answer_id AND e.source_index = s.source_index), l AS (SELECT * FROM p WHERE length(quote) >= 3 AND length(text) >= 3), a AS (SELECT answer_id, line_no, g, count(*) AS n FROM (SELECT answer_id, line_no, substr(quote, unnest(range(1, length(quote) - 1)), 3) AS g FROM l) GROUP BY ALL), b AS (SELECT answer_id, line_no, g, count(*) AS n FROM (SELECT answer_id, line_no, substr(text, unnest(range(1, length(text) - 1)), 3) AS g FROM l) GROUP BY ALL), i AS (SELECT a.answer_id, a.line_no, sum(least(a.n, b.n)) AS c FROM a JOIN b ON a.answer_id = b.answer_id AND a.line_no = b.line_no AND a.g = b.g GROUP BY ALL) SELECT p.answer_id, p.line_no, CASE WHEN length(quote) >= 3 AND length(text) >= 3 THEN round(2.0::DOUBLE * coalesce(c, 0) / (length(quote) + length(text) - 4), 6) ELSE 0.0::DOUBLE END AS dice FROM p LEFT JOIN i ON p.answer_id = i.answer_id AND p.line_no = i.line_no",
        "answer_summary": m + f", g AS (SELECT answer_id, count(*) AS n, avg(CASE WHEN method IN ('exact', 'normalized') THEN 1.0 ELSE 0.0 END) AS v, avg(score) AS me, min(score) AS mi FROM cit GROUP BY answer_id) SELECT a.answer_id, coalesce(n, 0) AS citation_count, {R6('v')} AS verbatim_rate, {R6('me')} AS mean_score, {R6('mi')} AS min_score FROM ans a LEFT JOIN g ON a.answer_id = g.answer_id",
        "judge_inputs": f"WITH {PLACED} " + f"SELECT c.answer_id, c.claim_id || '|' || c.source_index AS id, {_clean('c.claim_text', 700)} AS claim, {_clean('c.quote', 700)} AS quote, {_clean(_CONTEXT, 1200, True)} AS context FROM cix c JOIN ans a ON c.answer_id = a.answer_id WHERE c.claim_text <> '' AND c.quote <> ''",
        "callable_judge": m + f", z AS (SELECT answer_id, claim_id || '|' || source_index AS id, length({_clean('claim_text', 700)}) AS n FROM cit WHERE claim_text <> '' AND quote <> '') SELECT answer_id, id, CASE WHEN n % 7 = 0 THEN 'error' ELSE ['entailed', 'partially_entailed', 'overstated', 'insufficient', 'contradicted', 'error'][n % 6 + 1] END AS class, CASE WHEN n % 7 > 0 AND n % 5 > 0 THEN {R6('least(1.0, n / 100.0::DOUBLE)')} END AS confidence, CASE WHEN n % 7 = 0 THEN 'missing_item' ELSE 'by length|' || n END AS reasons FROM z",
        "judged_scores": j + f"SELECT answer_id, line_no, claim_id, source_index, class, {R6('confidence')} AS confidence, {R6('score')} AS text_score, {R6('final')} AS score, array_to_string(reasons, '|') AS reasons FROM js",
        "judged_summary": j + f", g AS (SELECT answer_id, count(*) AS n, avg(CASE WHEN method IN ('exact', 'normalized') THEN 1.0 ELSE 0.0 END) AS v, count(*) FILTER (class = 'entailed') / nullif(count(class), 0)::DOUBLE AS er, avg(final) AS me, min(final) AS mi FROM js GROUP BY answer_id) SELECT a.answer_id, coalesce(n, 0) AS citation_count, {R6('v')} AS verbatim_rate, {R6('er')} AS entailed_rate, {R6('me')} AS mean_score, {R6('mi')} AS min_score FROM ans a LEFT JOIN g ON a.answer_id = g.answer_id",
        "judge_warnings": j + f", jx AS (SELECT * FROM cit), {_JUDGE_WARN} SELECT kind, answer_id, claim_id, detail FROM jw",
        "uncited_sentences": p + f", {UNCITED} SELECT answer_id, line_no, sentence_no, sentence FROM un",
        "gate_problems": j + f", {PROBLEMS} SELECT answer_id, line_no, claim_id, source_index, claim_text, type, method, text_score, class, confidence, score FROM gp",
        "gate_verdicts": f"WITH {GATE} SELECT answer_id, n_problems, n_uncited, verdict, CASE verdict WHEN 'pass' THEN 0 WHEN 'revise' THEN 2 ELSE 1 END AS exit_code FROM gv",
        "gate_jobs": f"WITH {JOBS}, {_WARN}, jx AS (SELECT * FROM cit WHERE answer_id % 3 < 2), {_JUDGE_WARN}, w AS (SELECT answer_id FROM wn UNION ALL SELECT answer_id FROM jw), p AS (SELECT answer_id, string_agg(concat_ws('|', claim_id, source_index::VARCHAR, type), chr(10) ORDER BY line_no) AS x FROM gp GROUP BY answer_id), u AS (SELECT answer_id, string_agg(sentence, chr(10) ORDER BY line_no, sentence_no) AS x FROM un GROUP BY answer_id), g AS (SELECT answer_id, count(*) AS n, avg(final) AS me FROM jb GROUP BY answer_id), v AS (SELECT a.answer_id, CASE WHEN {TRIM("coalesce(a.answer, '')")} = '' THEN 'error' WHEN p.x IS NULL AND u.x IS NULL THEN 'pass' ELSE 'revise' END AS verdict, coalesce(p.x, '') AS problems, coalesce(u.x, '') AS uncited FROM ans a LEFT JOIN p ON a.answer_id = p.answer_id LEFT JOIN u ON a.answer_id = u.answer_id) SELECT v.answer_id, verdict, CASE verdict WHEN 'pass' THEN 0 WHEN 'revise' THEN 2 ELSE 1 END AS exit_code, problems, uncited, coalesce(n, 0) AS citation_count, {R6('me')} AS mean_score, (SELECT count(*) FROM w WHERE w.answer_id = v.answer_id) AS n_warnings FROM v LEFT JOIN g ON v.answer_id = g.answer_id",
        "correction_prompt": f"WITH {GATE} SELECT answer_id, '{gate.HEAD}' || chr(10) || txt || chr(10) || '{gate.FOOT}' AS instructions FROM gv WHERE verdict = 'revise'",
        "sanitized_documents": f"SELECT doc_id, {_clean('text', 2**31, True)} AS text FROM documents",
        "p2_loaded": LOADED,
    }

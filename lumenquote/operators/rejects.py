"""Loading of delimited records whose faulty rows come out apart, each with the reason.

Records with odd quoting are held out by a columnar test. Blocks of the others go through a columnar CSV parse. A block that cannot be parsed as a whole is halved
until the faulty records stand alone; records whose columns do not give back their own line, or hold an
invalid value, are picked out by a mask. Only those are read by the strict, record-wise scanner.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenquote.session import map_batches

# Fixed values of the record layout.
CHANNELS = ("web", "api", "mobile", "mail", "batch", "kiosk")
FIELDS = {
    "evidence": ("answer_id", "claim_id", "source_index", "quote"),
    "answer": ("answer_id", "channel", "created_at", "context_window_chars", "answer"),
}
TIME_FORMAT = "%Y-%m-%dT%H:%M:%SZ"
LARGEST_ID = 2**63 - 1

BLOCK_RECORDS = 256
LEAF_RECORDS = 4

#: Bytes that stand for escapes during the columnar parse; records that hold them are read strictly.
ESCAPED_BACKSLASH, ESCAPED_QUOTE, ESCAPED_NEWLINE = "\x01", "\x02", "\x03"

OUTPUT = (
    "raw_id bigint, kind string, reason string, answer_id bigint, claim_id string, source_index int, quote string, "
    "channel string, created_at timestamp, context_window_chars int, answer string"
)
_TYPES = {
    "raw_id": pa.int64(),
    "kind": pa.string(),
    "reason": pa.string(),
    "answer_id": pa.int64(),
    "claim_id": pa.string(),
    "source_index": pa.int32(),
    "quote": pa.string(),
    "channel": pa.string(),
    "created_at": pa.timestamp("us", tz="UTC"),
    "context_window_chars": pa.int32(),
    "answer": pa.string(),
}


def split_strict(line: str) -> list[tuple[bool, str]] | None:
    """(quoted, raw content) of each field; None if a quoted field never ends or goes on, or a quote stands in a plain field."""
    fields, at = [], 0
    while True:
        if at < len(line) and line[at] == '"':
            end = at + 1
            while end < len(line) and line[end] != '"':
                end += 2 if line[end] == "\\" else 1
            if end >= len(line) or (end + 1 < len(line) and line[end + 1] != "|"):
                return None
            fields.append((True, line[at + 1 : end]))
            at = end + 1
        else:
            end = line.find("|", at)
            end = len(line) if end < 0 else end
            if '"' in line[at:end]:
                return None
            fields.append((False, line[at:end]))
            at = end
        if at >= len(line):
            return fields
        at += 1


def unescape(raw: str) -> str:
    """Backslash-n becomes a line feed, any other backslash pair its second character."""
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], raw, flags=re.DOTALL)


def _whole(text: str, least: int, most: int) -> int | None:
    if not re.fullmatch(r"[0-9]+", text):
        return None
    digits = text.lstrip("0") or "0"
    return int(digits) if len(digits) <= 19 and least <= int(digits) <= most else None


def _time(text: str) -> datetime | None:
    if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z", text):
        return None
    try:
        return datetime.strptime(text[:-1], "%Y-%m-%dT%H:%M:%S").replace(tzinfo=timezone.utc) if text[17:19] < "60" else None
    except ValueError:
        return None


def diagnose(kind: str | None, line: str) -> tuple[str | None, dict]:
    """(reason, {}) of a record that cannot be loaded, (None, typed values) of one that can. An unknown kind has no layout: columns."""
    fields = split_strict(line.strip())
    if fields is None:
        return "quoting", {}
    names = FIELDS.get(kind or "")
    if names is None or len(fields) != len(names):
        return "columns", {}
    if not fields[-1][0] or any(quoted for quoted, _ in fields[:-1]):
        return "quoting", {}
    raw = [x for _, x in fields]
    value = {"answer_id": _whole(raw[0], 1, LARGEST_ID), names[-1]: unescape(raw[-1])}
    if kind == "evidence":
        value["claim_id"] = raw[1] if re.fullmatch(r"c[0-9]+", raw[1]) else None
        value["source_index"] = _whole(raw[2], 1, 99)
    else:
        value["channel"] = raw[1] if raw[1] in CHANNELS else None
        value["created_at"] = _time(raw[2])
        value["context_window_chars"] = _whole(raw[3], 0, 5000)
    if any(value[n] is None for n in names) or not value[names[-1]].strip():
        return "value", {}
    return None, value


def _plainly_quoted(lines: pa.Array) -> pa.Array:
    """Whether a record has two quotation marks besides escaped ones, the second at its end; the others would only make their blocks fail."""
    bare = pc.replace_substring(pc.replace_substring(lines, "\\\\", ""), '\\"', "")
    return pc.and_(pc.equal(pc.count_substring(bare, '"'), 2), pc.ends_with(bare, '"'))


def _columnar(kind: str, lines: pa.Array) -> tuple[dict[str, pa.Array], pa.Array] | None:
    """Columns of the block and a mask of the records that are certainly right; None if the block can't be parsed as a whole."""
    names = FIELDS[kind]
    text = "\n".join(lines.to_pylist())
    if text.count("\n") != len(lines) - 1 or "\r" in text:  # records with line ends inside
        return None
    if ESCAPED_BACKSLASH in text or ESCAPED_QUOTE in text or ESCAPED_NEWLINE in text:
        return None
    text = text.replace("\\\\", ESCAPED_BACKSLASH).replace('\\"', ESCAPED_QUOTE).replace("\\n", ESCAPED_NEWLINE)
    data = text.encode()
    try:
        table = csv.read_csv(
            pa.BufferReader(data),
            read_options=csv.ReadOptions(column_names=list(names), use_threads=False, block_size=len(data) + 16),
            parse_options=csv.ParseOptions(delimiter="|", quote_char='"', double_quote=False, escape_char=False, newlines_in_values=False, ignore_empty_lines=False),
            convert_options=csv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=False, check_utf8=False),
        )
    except pa.ArrowInvalid:
        return None
    if table.num_rows != len(lines):
        return None
    column = {n: table[n].combine_chunks() if table[n].num_chunks != 1 else table[n].chunk(0) for n in names}
    body = column[names[-1]]
    rebuilt = pc.binary_join_element_wise(*[column[n] for n in names[:-1]], pc.binary_join_element_wise('"', body, '"', ""), "|")
    right = pc.equal(rebuilt, pa.array(text.split("\n"), pa.string()))
    right = pc.and_(right, pc.invert(pc.match_substring(body, "\\")))
    for n, pattern in (("answer_id", r"^0*[1-9][0-9]{0,17}$"), ("claim_id", r"^c[0-9]+$"), ("source_index", r"^0*[1-9][0-9]?$"), ("context_window_chars", r"^0*([0-4]?[0-9]{1,3}|5000)$")):
        if n in column:
            right = pc.and_(right, pc.match_substring_regex(column[n], pattern))
    if kind == "answer":
        right = pc.and_(right, pc.is_in(column["channel"], pa.array(CHANNELS)))
        shaped = pc.match_substring_regex(column["created_at"], r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-5][0-9]Z$")
        at = pc.strptime(pc.if_else(shaped, column["created_at"], None), TIME_FORMAT, "us", error_is_null=True)
        back = pc.equal(pc.strftime(at, "%Y-%m-%dT%H:%M:%S"), pc.utf8_slice_codeunits(column["created_at"], 0, 19))
        back = pc.or_(back, pc.equal(pc.strftime(pc.cast(at, pa.timestamp("s")), TIME_FORMAT), column["created_at"]))
        right = pc.and_(right, pc.fill_null(back, False))
        column["created_at"] = pc.assume_timezone(at, "UTC")
    body = pc.replace_substring(body, ESCAPED_NEWLINE, "\n")
    body = pc.replace_substring(pc.replace_substring(body, ESCAPED_QUOTE, '"'), ESCAPED_BACKSLASH, "\\")
    column[names[-1]] = body
    right = pc.and_(right, pc.not_equal(pc.utf8_trim_whitespace(body), ""))
    return column, pc.fill_null(right, False)


def _typed(column: dict[str, pa.Array], ids: pa.Array, kind: str, keep: pa.Array) -> pa.RecordBatch:
    ids, n = ids.filter(keep), pc.sum(keep).as_py() or 0
    values = {k: pc.cast(v.filter(keep), _TYPES[k]) for k, v in column.items()}
    values |= {"raw_id": ids, "kind": pa.array([kind] * n, pa.string())}
    return pa.RecordBatch.from_arrays([values.get(k, pa.nulls(n, t)) for k, t in _TYPES.items()], names=list(_TYPES))


def _strictly(ids: list, kind: str | None, lines: list[str]) -> pa.RecordBatch:
    rows = [{"raw_id": i, "kind": kind, "reason": r} | v for i, (r, v) in ((i, diagnose(kind, x)) for i, x in zip(ids, lines))]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(_TYPES.items())))


def _block(kind: str, ids: pa.Array, lines: pa.Array) -> Iterator[pa.RecordBatch]:
    if len(lines) <= LEAF_RECORDS:
        yield _strictly(ids.to_pylist(), kind, lines.to_pylist())
        return
    parsed = _columnar(kind, lines)
    if parsed is None:
        half = len(lines) // 2
        yield from _block(kind, ids[:half], lines[:half])
        yield from _block(kind, ids[half:], lines[half:])
        return
    column, right = parsed
    yield _typed(column, ids, kind, right)
    wrong = pc.invert(right)
    if pc.any(wrong).as_py():
        yield _strictly(ids.filter(wrong).to_pylist(), kind, lines.filter(wrong).to_pylist())


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, kinds, lines = batch.columns
        lines = pc.utf8_trim_whitespace(lines)
        record = pc.fill_null(pc.not_equal(lines, ""), False)
        ids, kinds, lines = ids.filter(record), kinds.filter(record), lines.filter(record)
        out = []
        for kind in pc.unique(kinds).to_pylist():
            own = pc.is_null(kinds) if kind is None else pc.fill_null(pc.equal(kinds, kind), False)
            i, x = ids.filter(own), lines.filter(own)
            if kind not in FIELDS:
                out.append(_strictly(i.to_pylist(), kind, x.to_pylist()))
                continue
            plain = _plainly_quoted(x)
            odd = pc.invert(plain)
            if pc.any(odd).as_py():
                out.append(_strictly(i.filter(odd).to_pylist(), kind, x.filter(odd).to_pylist()))
                i, x = i.filter(plain), x.filter(plain)
            for at in range(0, len(x), BLOCK_RECORDS):
                out.extend(_block(kind, i[at : at + BLOCK_RECORDS], x[at : at + BLOCK_RECORDS]))
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(map(len, out)) else out[0]


def parse_records(raw: DataFrame, id_col: str = "raw_id", kind_col: str = "kind", line_col: str = "line") -> DataFrame:
    """One row per record: its typed values, or the reason (quoting, columns, value) why it cannot be loaded.

    Null and blank lines are no records. An unknown or null kind has no layout and gives `columns` (`quoting`
    comes first). Repeated rows are parsed each. An answer_id beyond a bigint gives `value`. Other columns of
    raw are ignored, whatever their names.
    """
    named = raw.select(F.col(id_col).cast("bigint").alias("raw_id"), F.col(kind_col).cast("string").alias("kind"), F.col(line_col).cast("string").alias("line"))
    return map_batches(named, _parse, OUTPUT)


def split_records(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evidence items, answers, rejects) of parse_records; each is a narrow projection, so one scan serves a caller that persists parsed."""
    good = parsed.filter(F.col("reason").isNull())
    evidence = good.filter(F.col("kind") == "evidence").select("raw_id", "answer_id", "claim_id", "source_index", "quote")
    answers = good.filter(F.col("kind") == "answer").select("raw_id", "answer_id", "channel", "created_at", "context_window_chars", "answer")
    return evidence, answers, parsed.filter(F.col("reason").isNotNull()).select("raw_id", "kind", "reason")

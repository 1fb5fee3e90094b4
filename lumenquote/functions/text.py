"""Text functions as column expressions; lengths and positions count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: white space as the answer format means it, in a form that Java and RE2 both read.
BLANK = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Begins after what is no blank, so that a long run is read once.
LAST_BLANKS = f"(?<!{BLANK}){BLANK}+$"
CONTROL = r"[\x00-\x1F\x7F-\x9F]"
CLAIM_MARKER = r"\{c[0-9]+\}"
SOURCE_MARKER = r"\[[0-9]+\]"
ELLIPSIS = "…"


def trim_blank(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{LAST_BLANKS}", "")


def trim_end(c: Column) -> Column:
    return F.regexp_replace(c, LAST_BLANKS, "")


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def strip_control_chars(c: Column) -> Column:
    """Control characters become blanks, so that words never fuse."""
    return F.regexp_replace(c, CONTROL, " ")


def strip_html_tags(c: Column) -> Column:
    """Each tag (from a < to the next >) becomes a blank; texts with many < and no > are read once too."""
    parts = F.split(c, ">", -1)
    closed = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.when(F.contains(p, F.lit("<")), F.concat(F.substring_index(p, "<", 1), F.lit(" "))).otherwise(F.concat(p, F.lit(">"))))
    return F.when(F.contains(c, F.lit("<")), F.array_join(F.concat(closed, F.array(F.element_at(parts, -1))), "")).otherwise(c)


def truncate(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 1), F.lit(ELLIPSIS)))


def escape_quote(c: Column) -> Column:
    """Backslash and quotation mark get a backslash, a line end becomes backslash-n; the CR of a CRLF is lost."""
    doubled = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.regexp_replace(doubled, "\r?\n", r"\\n")


def unescape_quote(c: Column) -> Column:
    """The inverse of escape_quote; a backslash before another character goes, one at the end stays."""
    # Between escaped backslashes no other backslash is escaped, so each part can be read by itself.
    parts = F.transform(F.split(c, r"\\\\", -1), lambda x: F.regexp_replace(F.replace(x, F.lit("\\n"), F.lit("\n")), r"\\(.)", "$1"))
    return F.array_join(parts, "\\")


def strip_claim_markers(c: Column) -> Column:
    return F.regexp_replace(c, CLAIM_MARKER, "")


def clean_claim_text(c: Column) -> Column:
    return collapse_whitespace(F.regexp_replace(F.regexp_replace(c, SOURCE_MARKER, ""), CLAIM_MARKER, ""))

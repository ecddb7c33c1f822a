"""Rules that tell lines of aligned tables from prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions.textcols import SPACES, WS, strip

NUMERIC = r"(?d)^[+\-]?\$?\d[\d.,/\-:]*%?$"
SEPARATOR = rf"(?d)^[{SPACES}=\-:_|+*~.]*[=\-:_|+*~.][{SPACES}=\-:_|+*~.]*$"
MIN_LINES = 3


def words(line: Column) -> Column:
    return F.filter(F.split(line, f"{WS}+", -1), lambda t: t != "")


def line_is_tabular(line: Column) -> Column:
    gaps = F.regexp_count(strip(line), F.lit(" {2,}"))
    w = words(line)
    numeric = F.when(F.size(w) > 0, F.size(F.filter(w, lambda t: t.rlike(NUMERIC))) / F.size(w)).otherwise(0.0)
    return line.rlike(SEPARATOR) | (gaps >= 2) | ((gaps >= 1) & (numeric >= 0.5))


def classify_block(block: Column) -> Column:
    """array<struct<line, is_tabular, n_tokens>> of a block's lines that aren't blank; fewer than three are narrative."""
    lines = F.filter(F.split(block, "\n", -1), lambda x: strip(x) != "")
    few = F.size(lines) < MIN_LINES
    return F.transform(lines, lambda x: F.struct(x.alias("line"), F.when(few, False).otherwise(line_is_tabular(x)).alias("is_tabular"), F.size(words(x)).alias("n_tokens")))


def is_tabular_body(p: Column, tabular: Column, narrative: Column) -> Column:
    return (tabular > 0) & (tabular >= p) & (tabular >= narrative)


# Trailers of wire copy.
TRAILERS = [
    r"^(?:-0-?|\(END\)|(?:\(MORE\)\s*)+)\s*$",
    r"^(?:[A-Z][a-z]+\s+)?[A-Z][a-z]+\s+\d{1,2},?\s+\d{4}\s+\d{1,2}:\d{2}\s+[A-Z]{2,4}(?:\s+\([^)]+\))?\s*$",
    r"(?i)^\(END\)\s+Dow\s+Jones\s+Newswires?\s*$",
    r"(?i)^\(MORE TO FOLLOW\)\s+Dow\s+Jones\s+Newswires?\s*$",
]


def is_trailer(text: Column) -> Column:
    s = strip(text)
    hit = F.lit(False)
    for pattern in TRAILERS:
        hit = hit | s.rlike(pattern)
    return (s != "") & hit

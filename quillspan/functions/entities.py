"""HTML character references, decoded in the JVM as html.unescape decodes them."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions.textcols import let

# What HTML takes for a reference, and the numbers that stand for no character.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
NONE = [(0x1, 0x8), (0xB, 0xB), (0xE, 0x1F), (0x7F, 0x9F), (0xFDD0, 0xFDEF)]
LAST = 0x10FFFF


def numbered() -> dict[int, str]:
    """Numbers that stand for another character: those of Windows-1252 for the control characters from 0x80, and two more."""
    out = {0: "�", 0x0D: "\r"}
    for n in range(0x80, 0xA0):
        try:
            out[n] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            out[n] = chr(n)
    return out


def bare_names() -> list[str]:
    """Names that count without a semicolon, the longest first."""
    return sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))


def _character(digits: Column, base: int) -> Column:
    """The character of a number in decimal or hexadecimal digits, of any length."""
    short = F.regexp_replace(digits, "^0+", "")
    most = len(str(LAST)) if base == 10 else len(f"{LAST:x}")
    value = F.when(F.length(short) > most, LAST + 1).when(short == "", 0).otherwise(F.conv(short, base, 10).cast("int"))

    def shown(n: Column) -> Column:
        told = F.from_json(F.lit(json.dumps({str(k): v for k, v in numbered().items()})), "map<string, string>")
        nothing = F.lit(False)
        for low, high in NONE:
            nothing = nothing | n.between(low, high)
        other = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.coalesce(F.try_element_at(told, n.cast("string")), F.when(n.between(0xD800, 0xDFFF) | (n > LAST), "�").when(nothing | (n.bitwiseAND(0xFFFE) == 0xFFFE), "").otherwise(other))

    return let(value, shown)


def _decoded(reference: Column) -> Column:
    names = F.from_json(F.lit(json.dumps(html5)), "map<string, string>")
    prefix = F.regexp_extract(reference, "^&(" + "|".join(bare_names()) + ")", 1)
    name = F.coalesce(F.try_element_at(names, F.substring(reference, 2, 64)), F.when(prefix != "", F.concat(F.try_element_at(names, prefix), F.substring(reference, F.length(prefix) + 2, F.lit(64)))), reference)
    digits = F.regexp_extract(reference, "^&#([0-9]+)", 1)
    hexed = F.regexp_extract(reference, "^&#[xX]([0-9a-fA-F]+)", 1)
    return F.when(digits != "", _character(digits, 10)).when(hexed != "", _character(hexed, 16)).otherwise(name)


def unescape_text(text: Column) -> Column:
    """A text with its references decoded; names without a semicolon count as far as the longest known one goes."""
    gaps, found = F.split(text, REFERENCE, -1), F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    rebuilt = F.array_join(F.zip_with(gaps, found, lambda g, r: F.concat(g, F.when(r.isNull(), "").otherwise(_decoded(r)))), "")
    return F.when(F.contains(text, F.lit("&")), rebuilt).otherwise(text)


def unescape(texts: Column) -> Column:
    return F.transform(texts, unescape_text)

"""Secret scans that link the parts of a credential.

Base detectors find assigned secrets, access key ids and long hex strings; these are reported wherever they stand. Weaker parts say
too little by themselves: labelled identifiers, addresses, and words that look random. They are candidates, and an interval
join within a scope decides: an identifier or an address needs a secret, a random word an identifier or an address, at most `reach`
characters before or after it with no blank line between, for blank lines part scopes. Only candidates that are joined are reported.

The join runs over the parts of one text, sorted by start and by end, so a part looks at its nearest complements to either side and
no pairs are listed: if the nearest lies beyond the reach or in another scope, so do all others on that side.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import bound_batches, pick

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "identifier", "endpoint", "phrase")
# Kinds of each role, and the roles that complete it.
ROLE = {"assign": "secret", "hex": "secret", "phrase": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}
COMPLETES = {"secret": ("identifier", "endpoint"), "identifier": ("secret",), "endpoint": ("secret",)}

# Patterns that RE2 reads alike; the first three are fixed by contract. A scheme has a bounded length, or long runs would be read again and again.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
IDENTIFIER = r"""\b(?i:user_?name|user_?id|login|client_?id|account_?id|access_?key_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]+"""
ENDPOINT = r"""\b(?i:host|host_?name|endpoint|server|url|uri|dsn)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/@?&=%-]+|\b[a-z][a-z0-9+.-]{0,30}://[A-Za-z0-9._:/@?&=%-]+"""
PHRASE = r"[A-Za-z0-9+/_-]+"
BLANK_LINE = r"\n[\t\r\x20]*\n"
LEAST = {"assign": 8, "access": 16, "hex": 32, "phrase": 16}

# The look-behinds change no match, for these runs always match from their first character; they keep long texts linear.
_ASSIGN, _ACCESS = re.compile(ASSIGN, re.A), re.compile(ACCESS)
_HEX = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{LEAST['hex']},}}")
_PHRASE = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST['phrase']},}}")
_IDENTIFIER, _ENDPOINT, _BLANK_LINE = (re.compile(p, re.A) for p in (IDENTIFIER, ENDPOINT, BLANK_LINE))
_MIXED = [re.compile(p) for p in ("[a-z]", "[A-Z]", "[0-9]")]


@dataclass(frozen=True)
class LinkPlan:
    """reach: most characters between complementary parts."""

    reach: int = 200


class Part(NamedTuple):
    start: int
    end: int
    kind: str
    text: str


class Link(NamedTuple):
    part: Part
    partner: Part | None


def base_parts(text: str) -> list[Part]:
    """Assigned secrets, access key ids and hex strings, leftmost and not overlapping within a kind."""
    out = [Part(m.start(), m.end(), "assign", m[0]) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST["assign"]]
    out += [Part(m.start(), m.end(), "access", m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return out + [Part(m.start(), m.end(), "hex", m[0]) for m in _HEX.finditer(text)]


def _apart(found: Iterator[Part], taken: list[Part]) -> list[Part]:
    """Parts that touch none of `taken`; neither list need be sorted."""
    spans = sorted((p.start, p.end) for p in taken)
    starts, ends, most = [s for s, _ in spans], [], 0
    for _, e in spans:
        most = max(most, e)
        ends.append(most)
    return [p for p in found if not (k := bisect_left(starts, p.end)) or ends[k - 1] <= p.start]


def candidates(text: str, base: list[Part]) -> list[Part]:
    """Weak parts outside the base ones: random words only where no label claims them. None of a text that has nothing secret."""
    words = (Part(m.start(), m.end(), "phrase", m[0]) for m in _PHRASE.finditer(text) if all(p.search(m[0]) for p in _MIXED))
    words = _apart(words, base)
    if not words and not any(ROLE[p.kind] == "secret" for p in base):
        return []
    named = _apart((Part(m.start(), m.end(), kind, m[0]) for kind, p in (("identifier", _IDENTIFIER), ("endpoint", _ENDPOINT)) for m in p.finditer(text)), base)
    return named + _apart(iter(words), named)


def _nearest(text: str, part: Part, by_start: list[Part], by_end: list[Part], reach: int) -> Part | None:
    """The nearest of some parts within reach and scope, of two equally near the one before; by_start and by_end are sorted alike."""
    found = []
    k = bisect_right(by_end, part.start, key=lambda p: p.end)
    if k and part.start - by_end[k - 1].end <= reach and not _BLANK_LINE.search(text, by_end[k - 1].end, part.start):
        found.append((part.start - by_end[k - 1].end, 0, by_end[k - 1]))
    k = bisect_left(by_start, part.end, key=lambda p: p.start)
    if k < len(by_start) and by_start[k].start - part.end <= reach and not _BLANK_LINE.search(text, part.end, by_start[k].start):
        found.append((by_start[k].start - part.end, 1, by_start[k]))
    return min(found, default=(0, 0, None))[2]


def linked(text: str | None, plan: LinkPlan = LinkPlan()) -> list[Link]:
    """Base parts, joined or not, and the candidates that are joined, by start, then kind, each with its nearest complement."""
    if not text:
        return []
    base = base_parts(text)
    parts = base + candidates(text, base)
    if not parts:
        return []
    sides = {}
    for role, partners in COMPLETES.items():
        those = [p for p in parts if ROLE[p.kind] in partners]
        sides[role] = sorted(those), sorted(those, key=lambda p: (p.end, p.start, p.kind))
    links = [Link(p, _nearest(text, p, *sides[ROLE[p.kind]], plan.reach)) for p in parts]
    return sorted((x for x in links if x.partner or x.part.kind in BASE), key=lambda x: (x.part.start, KINDS.index(x.part.kind)))


def redacted(text: str, links: list[Link]) -> str:
    """The text with each span as its kind in brackets; where spans overlap, the first one's, or the longer one's from the same start."""
    out, end = [], 0
    for p in sorted((x.part for x in links), key=lambda p: (p.start, -p.end)):
        if p.start >= end:
            out += [text[end : p.start], f"[{p.kind.upper()}]"]
            end = p.end
    return "".join(out) + text[end:]


def credentials(docs: DataFrame, plan: LinkPlan = LinkPlan()) -> DataFrame:
    """(doc_id, kind, start, end, partner_kind, partner_start, partner_end): a row for each part that is reported, in code points,
    with its nearest complement, null for base parts that stand alone.

    Null and empty texts have none. Texts of any length are read whole, in linear time but for the sort of their parts. Repeated
    rows and rows without doc_id count each for itself; an empty table gives an empty result. Other columns of docs are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, text in enumerate(map(pa.StringScalar.as_py, b.column(1))):
                for p, other in linked(text, plan):
                    rows.append((k, p.kind, p.start, p.end, *((other.kind, other.start, other.end) if other else (None, None, None))))
            if rows:
                k, *columns = zip(*rows, strict=True)
                types = [pa.string(), pa.int64(), pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(k)), *map(pa.array, columns, types)], names=["doc_id", "kind", "start", "end", "partner_kind", "partner_start", "partner_end"])

    d = pick(docs, doc_id="doc_id", text="text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, kind string, start long, `end` long, partner_kind string, partner_start long, partner_end long")


def redact(docs: DataFrame, plan: LinkPlan = LinkPlan()) -> DataFrame:
    """docs' own rows and columns, with what is reported masked in the text."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def masked(text: pd.Series) -> pd.Series:
        return text.map(lambda t: redacted(t, linked(t, plan)) if t else t)

    return docs.withColumn("text", masked("text"))


def _told(parts: list[Part]) -> str:
    return ",".join(f"{p.kind}:{p.start}:{p.end}" for p in parts)


def secrets_query(docs: DataFrame, plan: LinkPlan = LinkPlan()) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and n_linked, the parts that have a complement.
    Rules for texts are those of `credentials`."""
    names = [*(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_linked"]
    types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in map(pa.StringScalar.as_py, b.column(1)):
                links = linked(text, plan)
                base = [x.part for x in links if x.part.kind in BASE]
                n = Counter(p.kind for p in base)
                rows.append((*(n[k] for k in BASE), hashlib.sha256(_told(base).encode()).hexdigest(), _told([x.part for x in links]), sum(x.partner is not None for x in links)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns, types)], names=["doc_id", *names])

    d = pick(docs, doc_id="doc_id", text="text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")

"""Information-theoretic sanitisation of personal data.

Base detectors find e-mail addresses, IPv4 addresses, card and phone numbers. Protected entities are their values and the
classes that these belong to and that recur where values don't: the mail's domain, the network, the card's issuer, the phone's
area, and the kind itself. Corpus statistics then tell how strongly a document's words reveal its entities. With N documents,
n(e) and n(t) of them with entity e and term t, and
c(e, t) of them with both, term t discloses PMI(e; t) = log2(N c / (n(e) n(t))) of the IC(e) = log2(N / n(e)) bits that e
holds. Terms that disclose at least `generalise` of an entity's bits in at least `support` documents become spans wherever they
occur, in texts without the entity too: they are generalised, or removed from `remove` on.

A term is generalised to the words that begin as it does, written as their common beginning and *. It keeps the longest beginning, up to
`stem` letters, that tells too little: n(p) documents have such a word, so it discloses no more than log2(N / n(p)) bits of any
entity, and n(p) is at least the n(t) of the most common one. A term that has no such beginning is removed.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import durable, pick

KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the look-behind changes no match: a digit run always matches from its first digit; it keeps long runs linear
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]{3,}")


@dataclass(frozen=True)
class PrivacyPlan:
    """broadcast_rows: most shared entities and revealing terms that are handed to every task; more are joined by a shuffle."""

    support: int = 3
    generalise: float = 0.8
    remove: float = 0.95
    stem: int = 6
    broadcast_rows: int = 100_000


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start; leftmost and not overlapping within a kind. Null: none."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def entities(text: str, kind: str, start: int, end: int) -> list[int]:
    """Hashes of the value that a span stands for and of its classes."""
    value = text[start:end].lower()
    if kind == "email":
        classes = [value, value.rpartition("@")[2]]
    elif kind == "ip":
        parts = value.split(".")
        classes = [value, ".".join(parts[:3]), ".".join(parts[:2])]
    else:
        digits = re.sub(r"[^0-9]", "", value)
        classes = [digits, digits[: 6 if kind == "card" else 4]]
    found = (xxhash.xxh64_intdigest(f"{kind}{k}:{x}".encode("utf-8", "surrogatepass")) for k, x in enumerate([*classes, ""]))
    return [x - (1 << 64) if x >> 63 else x for x in found]


def terms_outside(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the words of a text that don't touch the spans."""
    taken, k, end = sorted((a, b) for _, a, b in spans), 0, 0
    for m in WORD.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            end = max(end, taken[k][1])
            k += 1
        if end <= m.start():
            yield m[0].lower(), m.start(), m.end()


def _terms(text: str | None) -> set[str]:
    return {w.lower() for w in set(WORD.findall(text))} if text else set()


def _counted(names: list[str], of, rows: int = 100_000):
    """Rows of `names` and n: how many of some texts have each tuple that `of` finds in a text, once each; about `rows` are held at a time."""
    types = [pa.int64() if x == "entity" else pa.string() for x in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def emit() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*n, strict=True)] or [[] for _ in names]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns, types), pa.array(list(n.values()), pa.int64())], names=[*names, "n"])

        for b in batches:
            for text in map(pa.StringScalar.as_py, b.column(0)):
                found = iter(of(text))
                while some := list(islice(found, rows)):
                    n.update(some)
                    if len(n) >= rows:
                        yield emit()
                        n.clear()
        yield emit()

    return run


def _entities(text: str | None) -> set[tuple[int]]:
    return {(e,) for s in base_spans(text) for e in entities(text, *s)}


def _pairs(shared: frozenset[int] | None):
    """The pairs of a text's entities, all or the shared ones, with its terms."""

    def of(text: str | None) -> Iterator[tuple[int, str]]:
        spans = base_spans(text)
        keys = {e for s in spans for e in entities(text, *s)}
        keys = keys if shared is None else keys & shared
        terms = {t for t, _, _ in terms_outside(text, spans)} if keys else ()
        return ((e, t) for e in keys for t in terms)

    return of


def _few(df: DataFrame, rows: int) -> frozenset | None:
    """The values of df's only column, None if there are more than `rows`."""
    few = df.limit(rows + 1).collect()
    return frozenset(r[0] for r in few) if len(few) <= rows else None


def revealing_terms(docs: DataFrame, plan: PrivacyPlan) -> DataFrame:
    """(term, disclosure, keep): terms that reach the threshold, with the most that they disclose of any entity, and how many letters
    they keep when they are generalised, 0 if they are removed; counts of terms are over all documents of docs (doc_id, text), those
    of entities and pairs over rows with doc_id."""
    total = docs.count()
    named = docs.where("doc_id is not null").select("text")
    # a pair is in no more documents than its entity
    held = named.mapInArrow(_counted(["entity"], _entities), "entity long, n long").groupBy("entity").agg(F.sum("n").alias("n_e"))
    held = durable(held.where(F.col("n_e") >= plan.support))
    shared = _few(held.select("entity"), plan.broadcast_rows)
    pairs = named.mapInArrow(_counted(["entity", "term"], _pairs(shared)), "entity long, term string, n long")
    if shared is None:
        pairs = pairs.join(held.select("entity"), "entity", "left_semi")
    pairs = durable(pairs.groupBy("entity", "term").agg(F.sum("n").alias("c")).where(F.col("c") >= plan.support))
    # every term is counted, at any size: the terms of pairs are too many to be handed to all tasks
    counts = docs.select("text").mapInArrow(_counted(["term"], lambda text: {(t,) for t in _terms(text)}), "term string, n long")
    counts = durable(counts.groupBy("term").agg(F.sum("n").alias("n_t")))
    told = pairs.join(counts, "term").join(held if shared is None else F.broadcast(held), "entity")
    bits = F.log2(F.lit(float(max(total, 1))) / F.col("n_e"))
    pmi = F.log2(F.lit(float(max(total, 1))) * F.col("c") / (F.col("n_e") * F.col("n_t")))
    told = told.withColumn("disclosure", F.when(bits > 0, pmi / bits).otherwise(0.0)).withColumn("bits", bits).where(F.col("disclosure") >= plan.generalise)
    told = durable(told.groupBy("term").agg(F.max("disclosure").alias("disclosure"), F.min("bits").alias("bits")))
    lengths = lambda term, most: F.transform(F.sequence(F.lit(1), F.least(F.lit(plan.stem), most)), lambda n: F.substring(term, F.lit(1), n))
    term = F.col("term")
    softer = told.where((F.col("disclosure") < plan.remove) & (F.length("term") > 1)).select("term", "bits", F.explode(lengths(term, F.length("term") - 1)).alias("stem"))
    common = counts.select("n_t", F.explode(lengths(term, F.length("term"))).alias("stem")).groupBy("stem").agg(F.max("n_t").alias("n_p"))
    least = F.log2(F.lit(float(max(total, 1))) / F.col("n_p"))
    safe = softer.join(common, "stem").where(least < plan.generalise * F.col("bits")).groupBy("term").agg(F.max(F.length("stem")).alias("keep"))
    return told.join(safe, "term", "left").select("term", "disclosure", F.coalesce("keep", F.lit(0)).alias("keep"))


def sanitise_text(text: str | None, told: dict[str, int]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], str | None]:
    """(base spans, term spans, sanitised text) for the terms with the letters that they keep."""
    base = base_spans(text)
    terms = [("term", a, b) for t, a, b in terms_outside(text, base) if t in told] if text and told else []
    if not base and not terms:
        return [], [], text
    out, end = [], 0
    for kind, a, b in sorted(base + terms, key=lambda s: (s[1], -s[2])):
        if a < end:
            continue
        word = text[a:b]
        with_ = f"[{kind.upper()}]" if kind != "term" else word[: told[word.lower()]] + "*" if told[word.lower()] else ""
        out += [text[end:a], with_]
        end = b
    return base, terms, "".join(out) + text[end:]


def _text_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(th, t) for th, text in zip(b.column(0).to_pylist(), map(pa.StringScalar.as_py, b.column(1)), strict=True) for t in _terms(text)]
        h, t = zip(*rows, strict=True) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(t, pa.string())], names=["th", "term"])


RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_terms long, sanitised string"


def _sanitiser(everywhere: dict[str, int] | None):
    """everywhere: all revealing terms; None if each text comes with its own."""

    @F.pandas_udf(RESULT)
    def run(text: pd.Series, told: pd.Series) -> pd.DataFrame:
        rows = []
        for t, x in zip(text, told, strict=True):
            known = everywhere if everywhere is not None else {} if x is None else {p["term"]: p["keep"] for p in x}
            base, terms, clean = sanitise_text(t if isinstance(t, str) else None, known)
            join = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
            n = Counter(k for k, _, _ in base)
            rows.append((*(n[k] for k in KINDS), hashlib.sha256(join(base).encode()).hexdigest(), join(base + terms), len(terms), clean))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_terms", "sanitised"])

    return run


def sanitise(docs: DataFrame, plan: PrivacyPlan = PrivacyPlan()) -> DataFrame:
    """docs (doc_id, text) plus a struct `privacy`: counts of base spans, their digest, all spans, n_terms and the sanitised text.

    Null text counts as empty and stays null. Rows without doc_id tell nothing about entities; they are sanitised like others.
    Rows that share a doc_id count as documents of their own. Equal rows get equal results; an empty table gives an empty result.
    Texts of any length are read whole, in linear time; other columns of docs are not looked at.
    """
    d = pick(docs, doc_id="doc_id", text="text")
    revealing = durable(revealing_terms(d, plan))
    few = revealing.limit(plan.broadcast_rows + 1).collect()
    if len(few) <= plan.broadcast_rows:
        none = F.lit(None).cast("array<struct<term:string,keep:int>>")
        return d.select("doc_id", "text", _sanitiser({r["term"]: r["keep"] for r in few})("text", none).alias("privacy"))
    # a text's terms meet the revealing ones by a shuffle, and come back by the text's hash: terms of another text do no harm
    keyed = d.withColumn("th", F.xxhash64("text"))
    told = keyed.select("th", "text").mapInArrow(_text_terms, "th long, term string").join(revealing, "term").distinct()
    told = told.groupBy("th").agg(F.collect_list(F.struct("term", "keep")).alias("told"))
    return keyed.join(told, "th", "left").select("doc_id", "text", _sanitiser(None)("text", "told").alias("privacy"))


def privacy_query(docs: DataFrame, plan: PrivacyPlan = PrivacyPlan()) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms, sanitised_sha256 (of the sanitised text; null: empty)."""
    p = sanitise(docs, plan)
    digest = F.sha2(F.coalesce("privacy.sanitised", F.lit("")), 256).alias("sanitised_sha256")
    return p.select("doc_id", *(f"privacy.{c}" for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_terms")), digest)

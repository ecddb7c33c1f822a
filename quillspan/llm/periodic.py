"""Periodic runs of words, by way of the longest previous factors of a text.

A run is a maximal stretch of words with smallest period q that goes on for at least `min_repeats` periods. Texts are ranked by
doubling, which leaves a suffix array and, level by level, a name for every stretch of 2**k words; equal names give the LCP
array and the longest extensions of two places to either side. A linked list over the suffix array turns LCP into the longest
previous factor of each place and so into the text's Lempel-Ziv blocks. By Main's theorem a run that isn't inside a block
touches a boundary with a period below the two blocks' joint length over min_repeats - 1: all such (boundary, period) pairs are
extended at once. Runs inside a block are copies of earlier ones and are taken from buckets of runs by their start.

Many documents are analysed side by side, as one sequence of words in which no stretch of one document equals one of another.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import bound_batches, pick


@dataclass(frozen=True)
class RunPlan:
    """A run has min_repeats (2 or more) periods and min_words words at least; about `words` words are analysed side by side."""

    min_repeats: int = 4
    min_words: int = 6
    words: int = 200_000


def rank_levels(first: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """levels[k][i] equals levels[k][j] exactly if the 2**k words from i are those from j, within one document; the last level has
    no equal names and is the inverse of the suffix array.

    first: names of words, no two documents share one; ends: for each place the end of its document. Each level has one more
    entry, equal to no name. Only places whose name isn't unique yet are sorted again.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    levels: list[np.ndarray] = []
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    key, base, h = first[order], np.zeros(n, np.int64), 1
    while True:
        m = len(order)
        new = np.empty(m, bool)
        new[:1] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        at = np.arange(m)
        # a name is the place, in the order of all suffixes, at which its group begins
        rank[order] = (base + np.maximum.accumulate(np.where(new, at, 0))) if m else base
        levels.append(rank.copy())
        last = np.empty(m, bool)
        last[-1:] = True
        last[:-1] = new[1:]
        order = order[~(new & last)]
        if not len(order):
            return levels
        old = rank[order].astype(np.int64)
        after = order + h
        second = np.where(after < ends[order], rank[np.minimum(after, n)], -1)
        key = old * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        order, key, old = order[by], key[by], old[by]
        begins = np.empty(len(old), bool)
        begins[0] = True
        np.not_equal(old[1:], old[:-1], out=begins[1:])
        # base + place among those sorted = name of the group + offset in it
        base = old - np.maximum.accumulate(np.where(begins, np.arange(len(old)), 0))
        h *= 2


def _extended(same, pairs: int, levels: int) -> np.ndarray:
    """How far pairs of places go on alike; same(k, which, far) tells which pairs have equal stretches of 2**k words at distance far."""
    far = np.zeros(pairs, np.int64)
    which, nested = np.arange(pairs), []
    for k in range(levels):
        which = which[same(k, which, far[which])]
        if not len(which):
            break
        nested.append(which)
    for k in range(len(nested) - 1, -1, -1):
        which = nested[k]
        far[which] += same(k, which, far[which]).astype(np.int64) << k
    return far


def common_prefixes(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest stretches that begin at i and at j alike; i and j differ, each pair in one document."""
    return _extended(lambda k, w, far: levels[k][i[w] + far] == levels[k][j[w] + far], len(i), len(levels))


def common_suffixes(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Lengths of the longest stretches that end before i and before j alike, not beyond the start of their document."""

    def same(k: int, w: np.ndarray, far: np.ndarray) -> np.ndarray:
        a, b = i[w] - far - (1 << k), j[w] - far - (1 << k)
        inside = np.minimum(a, b) >= starts[w]
        return inside & (levels[k][np.where(inside, a, 0)] == levels[k][np.where(inside, b, 0)])

    return _extended(same, len(i), len(levels))


def previous_factors(levels: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """(longest previous factor of each place, a place where it occurs before), the place meaning nothing where the factor is empty."""
    n = len(levels[-1]) - 1
    array = np.empty(n, np.int64)
    array[levels[-1][:n]] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    lcp[1:] = common_prefixes(levels, array[:-1], array[1:])
    before, after, shared = (np.full(n + 1, n, np.int64) for _ in range(3))
    before[array[1:]], after[array[:-1]] = array[:-1], array[1:]
    shared[array], shared[n] = lcp, 0
    prev, succ, with_prev = before.tolist(), after.tolist(), shared.tolist()
    factor = [0] * n
    # places leave the list from the last on: those beside a place when it leaves are its nearest suffixes among earlier places
    for i in range(n - 1, -1, -1):
        p, q, a = prev[i], succ[i], with_prev[i]
        b = with_prev[q]
        if a < b:
            factor[i] = b
            with_prev[q] = a
        else:
            factor[i] = a
        succ[p] = q
        prev[q] = p
    return factor, [prev[i] if with_prev[i] == factor[i] else succ[i] for i in range(n)]


def find_runs(codes: np.ndarray, sizes: np.ndarray, plan: RunPlan = RunPlan()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run of some documents, by start, then period; codes: their words as numbers, sizes: words of each."""
    n, least = len(codes), max(plan.min_words, plan.min_repeats)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    begin, end = cuts[doc], cuts[doc + 1]
    levels = rank_levels(doc * (int(codes.max()) + 1) + codes, end)
    factor, source = previous_factors(levels)
    blocks, i = [], 0
    while i < n:
        blocks.append(i)
        i += factor[i] or 1
    block = np.array(blocks, np.int64)
    length = np.diff(np.append(block, n))
    # boundaries: starts of blocks that have one before them in their document, and ends of documents, with the two blocks' joint length
    inner = np.flatnonzero(block > begin[block])
    closing = np.flatnonzero(np.append(block[1:], n) == end[block])
    boundary = np.concatenate([block[inner], block[closing] + length[closing]])
    joint = np.concatenate([length[inner] + length[inner - 1], length[closing]])
    low, high = (np.concatenate([x[block[inner]], x[block[closing]]]) for x in (begin, end))
    most = (joint - 1) // (plan.min_repeats - 1)
    which = np.repeat(np.arange(len(boundary)), most)
    period = np.arange(len(which)) - np.repeat(np.cumsum(most) - most, most) + 1
    name = levels[0]
    b, lo, hi = boundary[which], low[which], high[which]
    # the run goes on over the boundary and a period before it; it ends there; it begins less than a period before it
    back, ahead = b - period >= lo, b + period < hi
    over = back & (b < hi) & (name[b] == name[np.where(back, b - period, n)])
    ends_there = back & ~over & (b - period - 1 >= lo) & (name[b - 1] == name[np.where(b - period - 1 >= lo, b - period - 1, n)])
    begins = ahead & (name[b] == name[np.where(ahead, b + period, n)])
    left, right = np.flatnonzero(over | ends_there), np.flatnonzero(begins)
    i = np.concatenate([b[left], b[right] + period[right]])
    p, lo, hi = (np.concatenate([x[left], x[right]]) for x in (period, lo, hi))
    start = i - p - common_suffixes(levels, i, i - p, lo)
    stop = i.copy()
    inside = np.flatnonzero(i < hi)
    stop[inside] += common_prefixes(levels, i[inside], i[inside] - p[inside])
    good = np.flatnonzero(stop - start >= np.maximum(plan.min_words, plan.min_repeats * p))
    by = good[np.lexsort((p[good], stop[good], start[good]))]
    # of several periods of one stretch the smallest; the others are its multiples
    fresh = np.ones(len(by), bool)
    fresh[1:] = (start[by[1:]] != start[by[:-1]]) | (stop[by[1:]] != stop[by[:-1]])
    by = by[fresh]
    found = list(zip(start[by].tolist(), stop[by].tolist(), p[by].tolist(), strict=True))
    buckets: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for s, e, q in found:
        buckets[s].append((e, q))
    with_runs = set(doc[start[by]].tolist())
    long = np.flatnonzero(length >= least + 2)
    for s, size in zip(block[long].tolist(), length[long].tolist(), strict=True) if with_runs else ():
        if doc[s] not in with_runs or not factor[s]:
            continue
        shift = s - source[s]
        for j in range(source[s] + 1, source[s] + size):
            for e, q in buckets.get(j, ()):
                if e < source[s] + size:
                    buckets[j + shift].append((e + shift, q))
                    found.append((j + shift, e + shift, q))
    found.sort(key=lambda r: (r[0], r[2]))
    return tuple(np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (none, none, none)


Analysed = tuple[list[bytes], list[tuple[int, int, int]]]


def damaged_words(words: list[bytes], h: int) -> list[bytes]:
    """The words, where h is divisible by 10 with a tail that repeats a few words of them."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def analysed(texts: list[bytes | None], seeds: list[int] | None, plan: RunPlan) -> Iterator[list[Analysed]]:
    """For each text its words and its runs (start, length, period), some texts at a time; with seeds the words are damaged first."""
    held, size = [], 0
    for k, text in enumerate(texts):
        words = (text or b"").split()  # of bytes: the six white-space characters of ASCII
        held.append(words if seeds is None else damaged_words(words, seeds[k]))
        size += len(words)
        if size >= plan.words:
            yield _piece(held, plan)
            held, size = [], 0
    if held:
        yield _piece(held, plan)


def _piece(held: list[list[bytes]], plan: RunPlan) -> list[Analysed]:
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    number = defaultdict(count().__next__).__getitem__
    codes = np.fromiter((number(w) for words in held for w in words), np.int64, int(sizes.sum()))
    start, end, period = find_runs(codes, sizes, plan)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    at = np.searchsorted(start, cuts)
    out = []
    for k, words in enumerate(held):
        s = slice(at[k], at[k + 1])
        out.append((words, list(zip((start[s] - cuts[k]).tolist(), (end[s] - start[s]).tolist(), period[s].tolist(), strict=True))))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    gone = bytearray(len(words))
    for start, length, period in runs:
        gone[start + period : start + length] = b"\1" * (length - period)
    return [w for w, g in zip(words, gone, strict=True) if not g]


def _binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def document_runs(docs: DataFrame, plan: RunPlan = RunPlan()) -> DataFrame:
    """(doc_id, start, length, period): every run of every document's text, start a word number from 0.

    Words are what stands between white space of ASCII. Null, empty and blank texts have no runs, texts of any length are
    analysed whole; one text lies in one task, some fifty times its words in bytes. Repeated rows count each for itself, rows
    without doc_id too; an empty table gives an empty result. Other columns of docs are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for piece in analysed(_binary(b.column(1)), None, plan):
                rows = [(at + k, *r) for k, (_, runs) in enumerate(piece) for r in runs]
                at += len(piece)
                if rows:
                    k, *parts = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(k)), *(pa.array(x, pa.int64()) for x in parts)], names=["doc_id", "start", "length", "period"])

    d = pick(docs, doc_id="doc_id", text="text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, start long, length long, period long")


def collapse_runs(docs: DataFrame, plan: RunPlan = RunPlan()) -> DataFrame:
    """docs' own rows and columns; texts with runs become their words without the repetitions, joined by one space, others stay as they are."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def shortened(text: pd.Series) -> pd.Series:
        told = [None if t is None else t.encode("utf-8", "surrogatepass") for t in text]
        found = [x for piece in analysed(told, None, plan) for x in piece]
        return pd.Series([b" ".join(collapsed(w, r)).decode("utf-8", "surrogatepass") if r else t for t, (w, r) in zip(text, found, strict=True)], dtype="object")

    return docs.withColumn("text", shortened("text"))


COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digested(plan: RunPlan):
    def row(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        exponent = 1000 * best[1] // best[2] if runs else None
        return len(runs), *best, exponent, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        types = [pa.int64()] * 5 + [pa.string()] * 2
        for b in batches:
            rows = [row(*x) for piece in analysed(_binary(b.column(1)), b.column(2).to_pylist(), plan) for x in piece]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *names])

    return run


def runs_query(docs: DataFrame, plan: RunPlan = RunPlan()) -> DataFrame:
    """One row a document, its text damaged by crc32(doc_id): doc_id, n_runs, the longest run (start, length, period,
    exponent_milli), runs_sha256 and collapsed_sha256. Without doc_id nothing is damaged; rules for texts are those of document_runs."""
    d = pick(docs, doc_id="doc_id", text="text")
    seed = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(1).cast("long"))
    d = d.select("doc_id", "text", seed.alias("seed"))
    return d.mapInArrow(_digested(plan), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")

"""Bottom-k document fingerprints: the k smallest distinct hashes of a document's word shingles.

Sketches of parts merge by keeping the k smallest of their union, and two sketches estimate resemblance, containment and
the number of distinct shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import pick

SPACE = float(2**64)
MOST_RANGES = 100_000
SAMPLED, MOST_SAMPLED = 100, 2_000_000  # places of a range, and in all
STEP = 256  # bounds between two that are looked at first


@dataclass(frozen=True)
class SketchPlan:
    k: int = 64
    words: int = 5
    rows_per_range: int = 8_000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every word shingle (words split at white space, A-Z as a-z); a shorter text is one shingle, a wordless one none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(b" ".join(w))], np.uint64)
    joined = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w))
    stops = np.cumsum(size + 1) - 1
    starts, ends = (stops - size)[: 1 - words].tolist(), stops[words - 1 :].tolist()
    return np.fromiter((digest(joined[a:b]) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))


def smallest(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distinct values, ascending."""
    if len(hashes) > 4 * k:
        cut = hashes[hashes <= np.partition(hashes, 2 * k)[2 * k]]
        found = np.unique(cut)
        if len(found) >= k:
            return found[:k]
    return np.unique(hashes)[:k]


def sketch(text: str | None, plan: SketchPlan = SketchPlan()) -> np.ndarray:
    return smallest(shingle_hashes(text, plan.words), plan.k)


def merge(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """The sketch of the union of what a and b were made of."""
    return smallest(np.concatenate([a, b]), k)


def distinct_count(a: np.ndarray, k: int) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * SPACE / (float(a[k - 1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Estimated Jaccard similarity; 1 for two empty sketches."""
    if not len(a) and not len(b):
        return 1.0
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Estimated share of a's shingles that b has; 1 if a has none."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / distinct_count(a, k))


def to_text(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def edited(text: str | None, following: str | None) -> str:
    """The text with its last half replaced by as many first code points of the following text, or all of them."""
    text, following = text or "", following or ""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, contained_edited double"


def _walk(plan: SketchPlan):
    """Rows of a range in order, each with the row after it; the last of a range is only there for the one before it."""

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        types = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.split()[1]] for f in FIELDS.split(", ")]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, doc_id, text, sketch)
        for b in batches:
            rows = []
            for part, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), map(pa.StringScalar.as_py, b.column(2)), strict=True):
                own = sketch(text, plan)
                if held is not None and held[0] == part:
                    _, d, t, s = held
                    e = edited(t, text)
                    x = sketch(e, plan)
                    rows.append((d, len(t or ""), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), to_text(s), to_text(x), resemblance(s, x, plan.k), resemblance(s, own, plan.k), distinct_count(s, plan.k), containment(s, x, plan.k)))
                held = (part, doc, text, own)
            yield emit(rows)

    return run


def range_bounds(d: DataFrame, place: Column, n: int, plan: SketchPlan) -> list[int]:
    """Places that part d's n rows into ranges of about rows_per_range, from a sample of some SAMPLED places a range, MOST_SAMPLED at most.

    They only say which task reads which rows, so that a sample serves; there are MOST_RANGES at most, larger ones beyond.
    """
    ranges = max(1, min(MOST_RANGES, -(-n // plan.rows_per_range)))
    if ranges == 1:
        return []
    told = d.select(place.alias("place")).sample(min(1.0, min(SAMPLED * ranges, MOST_SAMPLED) / n), seed=1).toArrow()["place"].to_numpy()
    return np.unique(np.sort(told)[np.arange(1, ranges) * len(told) // ranges]).tolist() if len(told) else []


def in_range(d: DataFrame, place: Column, bounds: list[int]) -> DataFrame:
    """d with `part`, the number of bounds below a row's place: first among every STEPth of them, then among those between two of these."""
    below = lambda xs: F.size(F.filter(xs, lambda b: b < place))
    coarse = bounds[STEP - 1 :: STEP]
    if not coarse:
        return d.withColumn("part", below(F.array(*map(F.lit, bounds)).cast("array<long>")))
    fine = d.sparkSession.createDataFrame([(k, bounds[k * STEP : (k + 1) * STEP]) for k in range(len(coarse) + 1)], "step int, fine array<long>")
    d = d.withColumn("step", below(F.array(*map(F.lit, coarse)))).join(F.broadcast(fine), "step")  # MOST_RANGES numbers at most
    return d.withColumn("part", F.col("step") * STEP + below(F.col("fine"))).drop("step", "fine")


def fingerprint_query(docs: DataFrame, plan: SketchPlan = SketchPlan()) -> DataFrame:
    """One row per document with its fingerprint, that of its edited text, and how alike they and the next document's are.

    Null text counts as empty. The next document is the one of the next doc_id, after the last the first; rows without doc_id
    come first, rows of one doc_id follow each other in the order of their texts. An only document is its own next. An empty
    table gives an empty result. Documents are dealt to ranges of about rows_per_range ids; each range is read in order by
    one task, and the first document of the next range comes along.
    """
    d = pick(docs, doc_id="doc_id", text="text")
    place = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    n = d.count()
    if not n:
        return docs.sparkSession.createDataFrame([], FIELDS)
    bounds = range_bounds(d, place, n, plan)
    d = in_range(d.withColumn("place", place), F.col("place"), bounds)
    first = {r[0]: r[1] for r in d.groupBy("part").agg(F.min("place")).collect()}  # a row for each range
    order = sorted(first)
    heads = docs.sparkSession.createDataFrame([(first[p], order[i - 1]) for i, p in enumerate(order)], "head long, before int")
    # of the rows with a range's first id, the one that comes first goes to the range before as well
    head_rows = d.select("doc_id", "text", "place").join(F.broadcast(heads), F.col("place") == F.col("head")).groupBy("before").agg(F.min(F.struct("place", F.coalesce("text", F.lit("")).alias("text"))).alias("m"))
    head_rows = head_rows.select(F.col("before").alias("part"), F.lit(1).alias("tail"), F.col("m.place").alias("place"), F.lit(None).cast("long").alias("doc_id"), "m.text")
    body = d.select("part", F.lit(0).alias("tail"), "place", "doc_id", "text")
    # each range is a task of its own: by a hash, some tasks would get several and others none
    dealt = body.unionByName(head_rows).repartitionById(len(bounds) + 1, F.col("part").cast("int")).sortWithinPartitions("part", "tail", "place", "text")
    return dealt.select("part", "doc_id", "text").mapInArrow(_walk(plan), FIELDS)

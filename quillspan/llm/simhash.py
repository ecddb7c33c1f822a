"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes. Two fingerprints that differ in at most two bits share at least six of
them, so of the four two-byte fields at least two agree: the index lists each distinct fingerprint under the six
pairs of its fields (four positional bytes a key, so that lists stay short at any corpus size). Pairs that meet in
a list get their shared positional bytes tallied, those with the guaranteed six are verified by their differing bits.

A list longer than `long_list` would emit all pairs of a group. Its members are instead listed under their 65
midpoints (themselves and each single-bit change): two fingerprints differ in two bits or fewer exactly if they share
one, and no midpoint can have more than 65 owners. Equal fingerprints are one entry throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import components, durable, pick

MAX_BITS = 2
MIN_BYTES = 8 - MAX_BITS
SHINGLE = 3
SEED = 42


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the text's three-word shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.cumsum(size + 1) - 1
        starts, ends = (stops - size)[: 1 - SHINGLE].tolist(), stops[SHINGLE - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)]
    ones, n = np.zeros(64, np.int64), len(hashes)
    for i in range(0, n, 16384):
        part = np.array(hashes[i : i + 16384], np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter(map(fingerprint, map(pa.StringScalar.as_py, b.column(1))), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row of docs."""
    return pick(docs, doc_id="doc_id", text="text").mapInArrow(_hash_batches, "doc_id long, fp long")


def _field(k: int):
    return F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))


def index_lists(distinct: DataFrame) -> DataFrame:
    """(key, fp, rep): every fingerprint under each pair of its two-byte fields."""
    keys = [F.shiftleft(F.shiftleft(F.lit(n).cast("long"), 16) + _field(i), 16) + _field(j) for n, (i, j) in enumerate(combinations(range(4), 2))]
    return distinct.select(F.explode(F.array(*keys)).alias("key"), "fp", "rep")


def _shared_bytes():
    same = lambda k: F.when(F.shiftrightunsigned(F.col("a.fp").bitwiseXOR(F.col("b.fp")), 8 * k).bitwiseAND(F.lit(0xFF)) == 0, 1).otherwise(0)
    return sum((same(k) for k in range(1, 8)), same(0))


def links(distinct: DataFrame, long_list: int = 48) -> DataFrame:
    """Pairs (a, b) of representatives whose fingerprints are linked; those of long lists as stars on shared midpoints."""
    lists = durable(index_lists(distinct))
    sizes = lists.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = durable(lists.join(sizes, "key"))
    short = met.where(F.col("n") <= long_list)
    pairs = short.alias("a").join(short.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")))
    pairs = pairs.where(_shared_bytes() >= MIN_BYTES).where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_BITS)
    pairs = pairs.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))
    crowded = met.where(F.col("n") > long_list).select("fp", "rep").distinct()
    flips = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), k)) for k in range(64))]
    owners = crowded.select(F.explode(F.array(*flips)).alias("mid"), "rep").groupBy("mid").agg(F.collect_list("rep").alias("reps"))
    stars = owners.where(F.size("reps") > 1).select(F.array_min("reps").alias("a"), F.explode("reps").alias("b")).where("a <> b")
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, long_list: int = 48) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the smallest doc_id reachable over links of two differing bits or fewer. Null, empty and
    wordless texts have fingerprint zero and are linked like any other. A row without doc_id takes the component of its
    fingerprint, null if no row with a doc_id has it linked. Repeated rows get equal results; an empty table an empty one.
    """
    prints = durable(fingerprints(docs))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    joined = components(links(distinct.where("rep is not null"), long_list))
    groups = distinct.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(groups, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs' own rows and columns, of each group of near-duplicates those of the smallest doc_id; rows without doc_id stay."""
    gone = near_duplicates(docs).where("component_id < doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def simhash_query(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lowercase hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Mixing sources to target weights as a Pfair schedule of source blocks.

Shares are integers with sum P. Block j (from 1) of a source with share s is released at floor((j-1)P/s) and due at
ceil(jP/s); earliest deadline first over slots of one block then keeps every source within one block of its target at
every prefix. Shares are the weights in units of 2**-60, so that the target is the weight itself however long the stream.
One task runs the schedule, in memory that grows with the number of sources only, and writes it as it goes: a row for some blocks
of a source. A document is placed by its position in its source.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.llm.common import durable, pick


@dataclass(frozen=True)
class MixPlan:
    """block: documents in a block; period: shares are rounded to integers of this sum, at least 1 each, if it is given; broadcast_slots: most slots, 8 bytes each, of a schedule that is broadcast, a longer one is joined by a shuffle; temperature: target shares grow as size**temperature if no weights are given; rows_per_bucket: documents numbered in one sort, more of them beyond 10,000 buckets a source."""

    block: int = 16
    period: int | None = None
    broadcast_slots: int = 4_000_000
    temperature: float = 0.7
    rows_per_bucket: int = 2_000


PART, PARTS = 1024, 4_000_000  # slots of a source in one row of the schedule, and of all sources that wait for their row


def integer_shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Shares of the period by largest remainder, at least 1 each. The period grows to twice the sources if there are that many."""
    live = {k: w for k, w in weights.items() if w > 0}
    if not live:
        return {}
    period = max(period, 2 * len(live))
    total = sum(live.values())
    spare = period - len(live)
    exact = {k: spare * w / total for k, w in live.items()}
    shares = {k: 1 + int(x) for k, x in exact.items()}
    for k in sorted(live, key=lambda k: (int(exact[k]) - exact[k], k))[: period - sum(shares.values())]:
        shares[k] += 1
    return shares


def exact_shares(weights: dict[str, float]) -> dict[str, int]:
    """The weights' parts of their sum in units of 2**-60."""
    total = sum(w for w in weights.values() if w > 0)
    return {k: max(1, round(w / total * 2**60)) for k, w in weights.items() if w > 0}


def pfair_period(shares: dict[str, int]) -> list[str]:
    """The source of each slot of one period."""
    return pfair(shares, shares)


def pfair(shares: dict[str, int], blocks: dict[str, int]) -> list[str]:
    """The source of each slot until every source has had its `blocks`."""
    return list(pfair_slots(shares, blocks))


def pfair_slots(shares: dict[str, int], blocks: dict[str, int]) -> Iterator[str]:
    """The same, one by one: earliest deadline first among released blocks, ties by name. What waits is a block for each source."""
    period = sum(shares.values())
    lacking = len(shares)
    released: list[tuple[int, str, int]] = []
    waiting = [(0, k, 1) for k in sorted(shares)]
    heapq.heapify(waiting)
    t = 0
    while lacking:
        while waiting and waiting[0][0] <= t:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(released, (-(-j * period // shares[k]), k, j))
        due, k, j = heapq.heappop(released)
        if due <= t:
            raise AssertionError(f"block {j} of {k} missed its deadline {due} at {t}")
        yield k
        t += 1
        lacking -= j == blocks[k]
        heapq.heappush(waiting, (j * period // shares[k], k, j + 1))


def schedule(spark: SparkSession, shares: dict[str, int], blocks: dict[str, int], part: int) -> DataFrame:
    """(mix_source, mix_part, mix_slots): the slots of every source's blocks, `part` of them a row, in order; durable.

    One task makes it, for each slot depends on those before it; it holds `part` slots of each source at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["mix_source", "mix_part", "mix_slots"]

        def batch(rows: list[tuple[str, int, array]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].tolist() for r in rows], pa.list_(pa.int64()))], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            held: dict[str, array] = {k: array("q") for k in shares}
            done, rows = dict.fromkeys(shares, 0), []
            for t, k in enumerate(pfair_slots(shares, blocks)):
                held[k].append(t)
                if len(held[k]) == part:
                    rows.append((k, done[k], held[k]))
                    held[k] = array("q")
                    done[k] += 1
                    if len(rows) * part >= PARTS // 16:
                        yield batch(rows)
                        rows = []
            rows += [(k, done[k], slots) for k, slots in sorted(held.items()) if slots]
            if rows:
                yield batch(rows)

    return durable(spark.range(1, numPartitions=1).mapInArrow(run, "mix_source string, mix_part long, mix_slots array<long>"))


def numbered(docs: DataFrame, plan: MixPlan) -> tuple[DataFrame, dict[str, int]]:
    """(row, mix_source, mix_idx): each row, as a struct, with its place from 0 in its source; and the sources' sizes.

    A source is numbered in buckets of about rows_per_bucket documents by a hash of doc_id and source: counts of buckets
    give the offsets, so no source, however hot, is sorted in one task. Equal rows follow each other in any order.
    """
    source = F.coalesce(docs["source"], F.lit(""))
    d = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), source.alias("mix_source"), F.xxhash64(docs["doc_id"], source).alias("h"))
    sizes = {r[0]: r[1] for r in d.groupBy("mix_source").count().collect()}
    buckets = min(10_000, max(1, -(-max(sizes.values(), default=1) // plan.rows_per_bucket)))
    d = d.withColumn("bucket", F.floor(F.shiftrightunsigned("h", 32) * buckets / F.lit(2**32)).cast("int"))
    counts = d.groupBy("mix_source", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("mix_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("mix_source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("mix_source", "bucket").orderBy("h", "row.doc_id")) - 1
    placed = d.withColumn("rank", rank).join(offsets, ["mix_source", "bucket"])
    return placed.select("row", "mix_source", (F.col("rank") + F.col("offset")).alias("mix_idx")), sizes


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, plan: MixPlan = MixPlan()) -> DataFrame:
    """docs' columns plus mix_epoch, mix_slot and mix_position: a row for every place in the mixed stream.

    The stream is as long as the source that is largest against its target share needs to come out whole; every other
    source starts over (mix_epoch counts from 0) as often as its share asks. So each document of a weighted source is there
    at least once, nothing is dropped, and each prefix of the stream keeps every source within one block of its target.
    Without weights, the target of a source is its size to the power `temperature`. Null sources count as the source ''.
    Sources of weight 0 or absent from `weights` are left out; an empty table gives an empty stream. Repeated rows count
    as documents of their own. Input columns named like the new ones give way.
    """
    spark = docs.sparkSession
    docs = docs.select(*(docs[c] for c in docs.columns if c not in ("mix_epoch", "mix_slot", "mix_position")))
    if weights is not None:
        docs = docs.where(F.coalesce(docs["source"], F.lit("")).isin([k for k, w in weights.items() if w > 0]))
    places, sizes = numbered(docs, plan)
    if weights is None:
        weights = {k: n**plan.temperature for k, n in sizes.items()}
    targets = {k: weights[k] for k in sizes}
    shares = integer_shares(targets, plan.period) if plan.period else exact_shares(targets)
    if not sizes:
        return docs.select("*", *(F.lit(0).cast("long").alias(c) for c in ("mix_epoch", "mix_slot", "mix_position"))).limit(0)
    part = max(16, min(PART, PARTS // len(sizes)))
    slots = schedule(spark, shares, {k: -(-n // plan.block) for k, n in sizes.items()}, part)
    had = dict(slots.groupBy("mix_source").agg(F.sum(F.size("mix_slots"))).collect())  # a row for each source
    taken = spark.createDataFrame([(k, sizes[k], plan.block * had[k]) for k in sorted(sizes)], "mix_source string, mix_size long, mix_taken long")
    slots = F.broadcast(slots) if sum(had.values()) <= plan.broadcast_slots else slots
    placed = places.join(F.broadcast(taken), "mix_source").where("mix_idx < mix_taken")  # a row for each source
    placed = placed.withColumn("epoch", F.explode(F.expr("sequence(0L, (mix_taken - mix_idx - 1) div mix_size)")))
    placed = placed.withColumn("seq", F.col("epoch") * F.col("mix_size") + F.col("mix_idx")).withColumn("nth", F.expr(f"seq div {plan.block}L"))
    placed = placed.withColumn("mix_part", F.expr(f"nth div {part}L")).join(slots, ["mix_source", "mix_part"])
    placed = placed.withColumn("slot", F.expr(f"element_at(mix_slots, cast(nth % {part} as int) + 1)"))
    place = F.col("slot") * plan.block + F.expr(f"seq % {plan.block}L")
    return placed.select("row.*", F.col("epoch").alias("mix_epoch"), F.col("slot").alias("mix_slot"), place.alias("mix_position"))


def mixing_query(docs: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """One row per place in the mixed stream: doc_id, source, mix_epoch, mix_slot, mix_position."""
    return mixed(pick(docs, doc_id="doc_id", source="source"), None, plan)

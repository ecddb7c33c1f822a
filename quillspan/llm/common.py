"""Helpers shared by the corpus operators: durable intermediates, projection, components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the cluster's shared folder; a temporary one serves local masters only."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="quillspan-ckpt-")
    sc.setCheckpointDir(shared)


def bound_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Whole texts go to Python in smaller Arrow batches than Spark's defaults, unless the session has sizes of its own.

    Batches end at either bound, so that one of very long texts holds few of them.
    """
    for key, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", size)):
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so a lost executor costs a re-read and no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.checkpoint(eager=True)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed: extra columns of any name can't clash with the operator's own."""
    bound_batches(df.sparkSession)
    return df.select(*(df[old].alias(new) for new, old in columns.items()))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of `edges` (a, b: long) as (node, component), component being the smallest node.

    Alternating large-star and small-star contraction: each round is two grouped minima with map-side
    combine and two joins, on the edges alone. Rounds grow with the logarithm of a component's width.
    An empty input gives an empty result; self loops and repeated edges do no harm.
    """
    def starred(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.where("b <= a")
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        linked = both.join(low, "a")
        out = linked.where("b > a") if large else linked
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(low.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    edges = durable(edges.select("a", "b").where("a <> b").distinct())
    seen = None
    for _ in range(max_rounds):
        edges = durable(starred(starred(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

"""A training-data pipeline over `documents`: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import decontam, language, lines, mixing, simhash
from quillspan.llm.common import ensure_checkpoint_dir
from quillspan.sources.reading import table

MIN_LANGUAGE_SCORE = 0.34


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null, empty and letterless texts go.

    Rows are judged each by its text alone: repeated rows and rows that share a doc_id, or have none, stay or go alike. Without
    labelled documents nothing can be recognised, so all go. Texts of any length are read whole; other columns pass through.
    """
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = language.train(docs.select("doc_id", "text", "lang"), ~F.coalesce(held, F.lit(False)))
    return language.reject_unknown(docs, model, MIN_LANGUAGE_SCORE)


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; n_chars follows the text.

    Documents of whose text nothing is left go; those that had none, null or empty, stay. Of equal or near lines the one of the
    smallest doc_id, then the earliest, stays; rows without doc_id lose only repeats of their own lines, and rows that share a doc_id
    count as one document.
    """
    kept = lines.remove_repeated_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of smallest doc_id.

    Null, empty and wordless texts are one group, since their fingerprints are equal. Rows that share the smallest doc_id stay
    together, repeated rows among them; rows without doc_id stay.
    """
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items; null and empty texts, and rows without doc_id, stay. An empty benchmark drops nothing."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed stream: documents with mix_epoch, mix_slot and mix_position.

    Every row is there once at least, repeated rows and rows without doc_id or text too; null sources count as one source. Small
    sources start over, which mix_epoch counts.
    """
    return mixing.mixed(docs)


STAGES = [("language", identify_language), ("lines", remove_lines), ("simhash", drop_near_copies), ("decontamination", decontaminate), ("mixing", mix_sources)]

#: The recurrent network, the hashes and the schedule are not expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, through Parquet tables in the folder of checkpoints; only the last one's stays, and none if a stage fails."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, read = table(spark, sf_dir, "documents"), None
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if read:
                _remove(spark, read)
            read = f"{folder}/{name}"
    except Exception:
        _remove(spark, folder)
        raise
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    """Remove a stage's table, or all of a run that failed, in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

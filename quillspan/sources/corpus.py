"""A corpus of articles laid out by month, with an index of its files that spares a lookup by id most of them.

The index is a table itself: a row for each file with its month, ids from least to greatest and the size of its Bloom filter, and
a row for each word of 64 bits of such a filter that isn't empty. No row grows with the corpus, and a lookup reads a few rows of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.store import Store
from quillspan.sources.reading import month_of

PROBES = 5  # bits of an id
BITS = 10  # of a filter for each id: about one lookup in a hundred opens a file in vain


def write_corpus(articles: DataFrame, folder: str, rows_per_file: int = 200_000) -> None:
    """Articles as Parquet, a folder for each month that an id begins with; `unknown` where it begins with none.

    Rows are sorted by id within a file, and a month of any size is as many files as it takes: ids of a month are dealt by range.
    """
    month = month_of(F.col("id"))
    a = articles.withColumn("month", F.when(F.coalesce(month, F.lit("")) == "", "unknown").otherwise(month))
    a.repartitionByRange(F.col("month"), F.col("id")).sortWithinPartitions("month", "id").write.mode("overwrite").partitionBy("month").option("maxRecordsPerFile", rows_per_file).parquet(f"{folder}/articles")


def read_corpus(spark: SparkSession, folder: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The articles of the months within the bounds, both included: months are folders, so that others aren't listed in the plan's scan."""
    df = spark.read.option("basePath", f"{folder}/articles").parquet(f"{folder}/articles")
    df = df.withColumn("month", F.col("month").cast("string"))
    if start is not None:
        df = df.where(F.col("month") >= start)
    return df.where(F.col("month") <= end) if end is not None else df


def _bit(article_id: Column, probe: int, words: Column) -> Column:
    """The place of an id's bit: a word and a bit in it, as one number."""
    return F.pmod(F.xxhash64(article_id, F.lit(probe)), words * 64)


def write_index(spark: SparkSession, folder: str) -> None:
    """(Re)make the index of a corpus. Ids are hashed twice: once to count them, once for the filters; both are grouped by file in part
    before they are shuffled, and a filter's words are rows, so that no task holds a whole one."""
    ids = read_corpus(spark, folder).where("id is not null").select("month", "id", F.col("_metadata.file_path").alias("file"))
    files = ids.groupBy("month", "file").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"))
    files = files.withColumn("words", F.ceil(F.col("n") * BITS / 64))
    files.write.mode("overwrite").parquet(f"{folder}/index/files")
    known = spark.read.parquet(f"{folder}/index/files")
    places = ids.join(known.select("file", "words"), "file").select("file", F.explode(F.array(*(_bit(F.col("id"), k, F.col("words")) for k in range(PROBES)))).alias("place"))
    words = places.select("file", F.expr("place div 64").alias("word"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bits")).groupBy("file", "word").agg(F.bit_or("bits").alias("bits"))
    words.repartitionByRange("file", "word").sortWithinPartitions("file", "word").write.mode("overwrite").parquet(f"{folder}/index/words")


def candidate_files(spark: SparkSession, folder: str, article_id: str) -> list[str]:
    """The files that may hold an id: those of its month whose range and Bloom filter have it."""
    month = spark.range(1).select(month_of(F.lit(article_id))).first()[0] or "unknown"
    files = spark.read.parquet(f"{folder}/index/files").where((F.col("month") == month) & (F.col("low") <= article_id) & (F.col("high") >= article_id))
    asked = files.select("file", F.explode(F.array(*(_bit(F.lit(article_id), k, F.col("words")) for k in range(PROBES)))).alias("place")).distinct()
    asked = asked.select("file", F.expr("place div 64").alias("word"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bit"))
    words = spark.read.parquet(f"{folder}/index/words")
    found = asked.join(words, ["file", "word"], "left").groupBy("file").agg(F.bool_and(F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))).alias("has"))
    return sorted(r[0] for r in found.where("has").select("file").collect())  # of the files of one month whose range has the id


def find_article(spark: SparkSession, folder: str, article_id: str) -> DataFrame:
    """The rows of an id, the first by file; empty if no file has it. Without an index the month's files are searched."""
    whole = read_corpus(spark, folder)
    if not Store(spark).exists(f"{folder}/index/files"):
        month = spark.range(1).select(month_of(F.lit(article_id))).first()[0] or "unknown"
        return whole.where((F.col("month") == month) & (F.col("id") == article_id)).limit(1)
    files = candidate_files(spark, folder, article_id)
    if not files:
        return whole.limit(0)
    return spark.read.schema(whole.schema).option("basePath", f"{folder}/articles").parquet(*files).where(F.col("id") == article_id).limit(1)

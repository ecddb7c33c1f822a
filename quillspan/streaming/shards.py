"""New shards of articles as they come: an available-now stream, every batch of it committed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import mapper, scoring, sinks
from quillspan.operators.store import Store, committed
from quillspan.sources.reading import ARTICLE, screened, tabular_results, tagged_documents, within_tokens

FILE = "path string, modificationTime timestamp, length long, content binary"


def process_new_shards(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Hand the articles of shards that no run has seen to `handle`, then stop; the checkpoint remembers what is done."""
    stream = spark.readStream.schema(ARTICLE).json(folder)
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def once(store: Store, output: str, write: Callable[[DataFrame, str], dict]) -> Callable[[DataFrame, int], None]:
    """A handler that commits each batch under its number, and leaves out a batch that is committed: a stream that stops between
    the commit and its own checkpoint hands the same batch on again."""

    def handle(batch: DataFrame, number: int) -> None:
        path = f"{output}/batch-{number:08d}.jsonl"
        if not committed(store, path):
            write(batch, path)

    return handle


def map_new_shards(spark: SparkSession, folder: str, checkpoint: str, output: str, groups: DataFrame, prompts: dict[str, str], make_backend, keyword_gate: bool = True, max_tokens: int | None = None, count_tokens=None, tabular: DataFrame | None = None) -> None:
    """The mapper lane over new shards: length filter, screening by the sidecar (a stream-static join), gate, scorer, records."""

    def write(batch: DataFrame, path: str) -> dict:
        batch = within_tokens(batch, max_tokens, 1.0, count_tokens, F.coalesce("text", F.array_join("paragraphs", "\n")))
        prepared = mapper.with_fired(screened(batch, tabular), groups, keyword_gate).persist()
        try:
            _, gate = mapper.gate_counts(prepared, groups, keyword_gate)
            records = mapper.records_of(prepared.drop("fired"), scoring.score(mapper.mapper_tasks(prepared, groups, prompts), make_backend))
            return sinks.write_run(records, path, lambda rows: sinks.mapper_summary(rows, {"stream": folder}, gate), keyword_gate)
        finally:
            prepared.unpersist()

    process_new_shards(spark, folder, checkpoint, once(Store(spark), output, write))


def tabulate_new_files(spark: SparkSession, folder: str, checkpoint: str, output: str) -> None:
    """The tabular lane over new files of tagged newswire.

    A file is a unit of the source: it comes whole, in one batch, so that all documents of an accession number, however far apart in
    the file, are merged when the batch is, by the reader of the batch lane. There is nothing to keep from one batch to the next,
    for accession numbers are merged within a file only.
    """
    store = Store(spark)

    def write(names: DataFrame, path: str) -> dict:
        files = [r[0] for r in names.select("path").distinct().collect()]  # one a file of the batch
        rows = tabular_results(tagged_documents(spark, files))
        return sinks.write_run(rows, path, lambda told: {"files": sorted(files), "rows": told.count()})

    names = spark.readStream.format("binaryFile").schema(FILE).load(folder).select("path")  # contents are pruned: a batch is a list of names
    names.writeStream.foreachBatch(once(store, output, write)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

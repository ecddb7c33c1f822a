"""The lanes from files to files: what a run's settings say is read, filtered, screened, scored and committed."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from quillspan.functions import tokens
from quillspan.operators import mapper, scoring, sinks, universe
from quillspan.operators.config import GraderRun, MapperRun
from quillspan.operators.store import Store
from quillspan.sources import dimensions, reading

PROMPT = "Answer with one object."
CHARS_PER_TOKEN = 1.0  # a token has a character at least; a higher bound would let dense texts in unmeasured


def _counter(spark: SparkSession, vocabulary: str | None):
    return tokens.counter(spark, vocabulary) if vocabulary and Store(spark).exists(vocabulary) else None


def production_articles(spark: SparkSession, run: MapperRun) -> DataFrame:
    """The very articles that a run sees: whatever measures a run reads them here too."""
    return reading.load_articles(
        spark, run.dataset, run.path, max_articles=run.max_articles, start=run.start_date, end=run.end_date, seed=run.random_seed,
        tabular=reading.tabular_sidecars(spark, run.sidecars) if run.sidecars else None, max_tokens=run.max_article_tokens, chars_per_token=CHARS_PER_TOKEN, count_tokens=_counter(spark, run.vocabulary), open_records=run.open_records,
        denied=reading.deny_list(spark, run.denylist) if run.denylist else None,
    )


def system_prompts(spark: SparkSession, groups: DataFrame, template: str | None, rules: str | None) -> dict[str, str]:
    """A system prompt for each class of the groups: the template with the class's rules, or one for all without files."""
    classes = {r[0] for r in groups.select("asset_class").distinct().collect()}
    if template is None:
        return dict.fromkeys(classes, PROMPT)
    store = Store(spark)
    return scoring.class_prompts(store.read(template), dimensions.rule_texts(store, rules), classes)


def map_shard(spark: SparkSession, run: MapperRun, groups: DataFrame, make_backend) -> dict:
    """One mapper run, committed; its summary. groups: the mapper's view of the universe.

    Articles are kept while the run lasts, since their tasks and their records need them: they are read and cut once.
    """
    began = time.monotonic()
    prompts = system_prompts(spark, groups, run.template, run.rules)
    prepared = mapper.with_fired(production_articles(spark, run), groups, run.keyword_gate).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, gate = mapper.gate_counts(prepared, groups, run.keyword_gate)
        read = time.monotonic()
        records = mapper.run_mapper(prepared, groups, prompts, make_backend)

        def summary(rows: DataFrame) -> dict:
            timing = {"corpus_s": round(read - began, 2), "map_s": round(time.monotonic() - read, 2), "n_articles": n}
            return sinks.mapper_summary(rows, run.record() | {"timing": timing}, gate)

        return sinks.write_run(records, run.output, summary, run.keyword_gate)
    finally:
        prepared.unpersist()


def plan(spark: SparkSession, run: MapperRun) -> list[dict]:
    """The shards of a run's input folder with their status; of a run without one, its one input."""
    if run.input_dir is None:
        return [{"shard": sinks.output_name(run.path), "path": run.path, "status": "pending"}]
    rows = sinks.shard_plan(spark, run.input_dir, run.output_dir, run.pattern).collect()  # one a shard
    inside = lambda shard: (run.start_date is None or shard[:7] >= run.start_date) and (run.end_date is None or shard[:7] <= run.end_date)
    return [r.asDict() if inside(r["shard"]) else r.asDict() | {"status": "other"} for r in rows]


def map_pending(spark: SparkSession, run: MapperRun, groups: DataFrame, make_backend) -> dict[str, dict]:
    """Summaries of the shards that this run did: those of its folder that weren't done, each committed by itself."""
    store = Store(spark)
    if run.input_dir is None:
        return {sinks.output_name(run.path): map_shard(spark, run, groups, make_backend)}
    out = {}
    for shard in plan(spark, run):
        if shard["status"] == "pending":
            one = replace(run, input_dir=None, input_file=shard["path"], path=shard["path"], start_date=None, end_date=None, files=store)
            out[shard["shard"]] = map_shard(spark, one, groups, make_backend)
    return out


def grade_output(spark: SparkSession, run: GraderRun, groups: DataFrame, make_backend) -> dict:
    """One grader run, committed; its summary. groups: the whole universe. Articles pass the grader's own length filter."""
    sources = reading.load_articles(spark, run.dataset, run.path or run.input_file, max_tokens=run.max_article_tokens, chars_per_token=CHARS_PER_TOKEN, count_tokens=_counter(spark, run.vocabulary))
    system = Store(spark).read(run.prompt) if run.prompt else PROMPT
    verdicts = mapper.grade(dimensions.mapper_records(spark, run.mapper_output), sources, groups, system, make_backend)
    return sinks.write_run(verdicts, run.output, lambda rows: sinks.grader_summary(rows, run.record()))


def gradable(spark: SparkSession, mapped_dir: str, source_dir: str, output_dir: str) -> DataFrame:
    """(shard, status) of the mapper's outputs: `no_source` if its shard of articles is gone, `done` if graded, else `pending`.

    Sources and verdicts are joined by name: a semi join keeps what has a source, an anti join what isn't graded.
    """
    from quillspan.operators.store import committed

    store = Store(spark)
    names = lambda rows: spark.createDataFrame([(r,) for r in rows], "shard string")
    mapped = names(sinks.output_name(e.name) for e in store.listing(mapped_dir, "*.jsonl"))
    sources = names(sinks.output_name(e.name) for e in store.listing(source_dir, reading.SHARD))
    done = names(sinks.output_name(e.name) for e in store.listing(output_dir, "*.jsonl") if committed(store, f"{output_dir}/{e.name}"))
    there = mapped.join(sources, "shard", "left_semi")
    told = lambda df, status: df.selectExpr("shard", f"'{status}' AS status")
    parts = told(mapped.join(sources, "shard", "left_anti"), "no_source"), told(there.join(done, "shard", "left_semi"), "done"), told(there.join(done, "shard", "left_anti"), "pending")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("shard")


def mapper_groups(groups: DataFrame) -> DataFrame:
    return universe.mapper_view(groups)

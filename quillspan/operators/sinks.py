"""Writing records and summaries, and the checks before it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.store import Store, beside, commit, committed


def refuse_mixed_gate(store: Store, folder: str, own: str, keyword_gate: bool) -> None:
    """RuntimeError if another *.summary.json in the folder was made with the other gate; without a gate block it was ungated."""
    for e in store.listing(folder, "*.summary.json"):
        if e.name == own:
            continue
        try:
            other = bool(json.loads(store.read(e.path)).get("gate", {}).get("keyword_gate", False))
        except Exception as fault:  # whatever a store says of a file that it can't read
            raise RuntimeError(f"{e.path} can't be read: {fault}") from fault
        if other != keyword_gate:
            raise RuntimeError(f"{e.path} was made with keyword_gate={other}, this run has {keyword_gate}")


def write_records(records: DataFrame, path: str, optional: tuple[str, ...] = ("url", "extra")) -> int:
    """JSON lines with null fields kept, but for the `optional` ones, which come last if at all; the number of rows."""
    line = F.to_json(F.struct(*(c for c in records.columns if c not in optional)), {"ignoreNullFields": "false"})
    for c in optional:
        if c in records.columns:
            more = F.concat(F.substring(line, 1, F.length(line) - 1), F.lit(","), F.substring(F.to_json(F.struct(c)), 2, 2**31 - 1))
            line = F.when(F.col(c).isNull(), line).otherwise(more)
    seen = Observation()
    records.select(line.alias("value")).observe(seen, F.count("*").alias("n")).write.mode("overwrite").text(path)
    return seen.get["n"]


def _side(name: str, key) -> F.Column:
    return F.struct(F.lit(name).alias("side"), key.alias("key"))


def mapper_summary(records: DataFrame, run: dict, gate: dict) -> dict:
    """Totals, reasons and counts of a run's records, in one pass; a row for each article, screened and untagged ones too."""
    none = F.array().cast("array<struct<side: string, key: string>>")
    screened = F.when(F.size("filtered_reasons") > 0, F.array(_side("filtered", F.lit("")))).otherwise(none)
    told = [F.transform("mappings", lambda m: _side("mapping", F.lit(""))), F.transform("mappings", lambda m: _side("class", m["asset_class"])), F.transform("mappings", lambda m: _side("group", m["group"]))]
    sides = F.concat(F.array(_side("article", F.lit(""))), screened, F.transform("filtered_reasons", lambda r: _side("reason", r)), *told)
    counts: dict[str, dict] = {}
    for side, key, n in records.select(F.explode(sides).alias("x")).groupBy("x.side", "x.key").count().collect():
        counts.setdefault(side, {})[key] = n
    by = lambda side: dict(sorted(counts.get(side, {}).items()))
    total = lambda side: counts.get(side, {}).get("", 0)
    return {"total_articles": total("article"), "filtered_articles": total("filtered"), "filtered_by_reason": by("reason"), "run": run, "gate": gate, "total_mappings": total("mapping"), "by_asset_class": by("class"), "by_group": by("group")}


def grader_summary(verdicts: DataFrame, run: dict) -> dict:
    """Counts of verdicts, of reasons to skip, and by class and group, those without the skipped, in one pass. Percentages round as Python does."""
    sides = F.when(F.col("skip_reason").isNotNull(), F.array(_side("skip", F.col("skip_reason")))).otherwise(F.array(_side("all", F.lit("")), _side("class", F.col("asset_class")), _side("group", F.col("group_name"))))
    v = verdicts.select("verdict", "self_inconsistent", F.explode(sides).alias("x"))
    rows = v.groupBy("x.side", "x.key").agg(F.count("*"), F.count_if(F.col("verdict") == "correct"), F.count_if(F.col("verdict") == "incorrect"), F.count_if("self_inconsistent")).collect()
    skips = {r[1]: r[2] for r in sorted(rows, key=lambda r: r[1]) if r[0] == "skip"}
    n = next((r[2:] for r in rows if r[0] == "all"), (0, 0, 0, 0))

    def by(side: str) -> dict:
        mine = sorted((r for r in rows if r[0] == side), key=lambda r: r[1])
        return {r[1]: {"total": r[2], "correct": r[3], "incorrect": r[4], "self_inconsistent": r[5], "correct_pct": round(100 * r[3] / r[2], 2)} for r in mine}

    skipped = sum(skips.values())
    return {"run": run, "total_mappings": n[0] + skipped, "graded": n[0], "correct": n[1], "incorrect": n[2], "self_inconsistent": n[3], "skipped": skipped, "skip_reasons": skips, "by_asset_class": by("class"), "by_group": by("group")}


def write_run(records: DataFrame, output: str, summarise: Callable[[DataFrame], dict], keyword_gate: bool | None = None) -> dict:
    """Records, then the summary that `summarise` makes of them as they were written, each moved into place when it is whole.

    A gated or ungated run is refused beside runs of the other kind, before anything is written or removed.
    """
    spark, kind = records.sparkSession, records.drop("extra").schema
    store = Store(spark)
    if keyword_gate is not None:
        own = beside(output, "summary")
        refuse_mixed_gate(store, own.rpartition("/")[0] or ".", own.rpartition("/")[2], keyword_gate)
    return commit(store, output, lambda path: write_records(records, path), lambda path: summarise(spark.read.schema(kind).json(path)))


def publish_prompts(store: Store, prompts: dict[str, str], folder: str) -> list[str]:
    """A text file for each class, named after it with _ for spaces."""
    out = []
    for name, text in prompts.items():
        out.append(f"{folder}/rendered_prompt_{name.replace(' ', '_')}.txt")
        store.write(out[-1], text)
    return out


def pending(shards: DataFrame, records: DataFrame, summaries: DataFrame) -> DataFrame:
    """Shards that lack their records or their summary."""
    done = records.select("shard").join(summaries.select("shard"), "shard", "left_semi")
    return shards.join(done, "shard", "left_anti")


def shard_plan(spark: SparkSession, input_dir: str, output_dir: str, pattern: str = "*", suffix: str = "_clean.jsonl") -> DataFrame:
    """(shard, path, status) of a folder's shards by name: `other` if the name doesn't fit the pattern, `done` if the
    output is committed, else `pending`."""
    import fnmatch

    store = Store(spark)
    rows = []
    for e in store.listing(input_dir, f"*{suffix}"):
        shard = output_name(e.name)
        if not fnmatch.fnmatchcase(shard, pattern):
            status = "other"
        else:
            status = "done" if committed(store, f"{output_dir}/{shard}.jsonl") else "pending"
        rows.append((shard, e.path, status))
    return spark.createDataFrame(rows, "shard string, path string, status string").orderBy("shard")


def output_name(source: str) -> str:
    name = source.rsplit("/", 1)[-1]
    return name.removesuffix("_clean.jsonl") if name.endswith("_clean.jsonl") else name.rsplit(".", 1)[0]

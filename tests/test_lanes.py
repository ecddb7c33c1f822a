"""Mapper and grader end to end with toy backends, the stream of shards, and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from quillspan import cli
from quillspan.operators import config, mapper, scoring, sinks, universe
from quillspan.operators.store import Store
from quillspan.sources import dimensions
from quillspan.streaming.shards import process_new_shards

ARTICLES = "id string, headline string, paragraphs array<string>, filtered_reasons array<string>"


def keen():
    return lambda prompts: ['{"evidence_paragraphs": [0, 0, -1, 9], "relevance_score": 0.5, "relevant": true}' for _ in prompts]


def strict():
    return lambda prompts: ['{"verdict": "incorrect", "relevance_score": 0.45}' for _ in prompts]


def test_lanes(spark):
    a = spark.createDataFrame([("1", "h", ["the first", "last"], []), ("2", "", ["und das"], ["denylist"]), ("3", "x", ["nichts"], None)], ARTICLES)
    g = universe.mapper_view(universe.to_frame(spark, universe.FIXTURE))
    prompts = {c: "s" for c in ("equity index", "rates", "commodity", "volatility", "currency")}
    records = mapper.run_mapper(a, g, prompts, keen)
    got = {r.article_id: r for r in records.collect()}
    assert got["1"].groups == ["English markers"] and got["1"].paragraphs == {"-1": "last", "0": "the first"}
    assert got["1"].mappings[0].evidence_paragraphs == [0, 0, -1, 9] and [x.ticker_symbol for x in got["1"].assets] == ["ANG", "ISL"]
    assert got["2"].mappings == got["3"].mappings == [] and got["2"].filtered_reasons == ["denylist"]
    assert len(mapper.run_mapper(a, g, prompts, keen, gated=False).where("article_id = '3'").first().groups) == 6
    verdicts = mapper.grade(records, a, g, "s", strict).collect()
    assert [(v.verdict, v.self_inconsistent) for v in verdicts] == [("incorrect", True)]
    assert [v.skip_reason for v in mapper.grade(records, a.limit(0), g.limit(0), "s", strict).collect()] == ["article_not_in_source"]
    assert [v.skip_reason for v in mapper.grade(records, a, g.limit(0), "s", strict).collect()] == ["group_not_in_universe"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []
    for k in range(2):
        (tmp_path / f"in/{k}.json").write_text(json.dumps({"id": str(k)}) + "\n")
        process_new_shards(spark, str(tmp_path / "in"), str(tmp_path / "ck"), lambda df, _: seen.extend(r.id for r in df.collect()))
    assert seen == ["0", "1"]


def test_cli(spark, tmp_path, capsys):
    assert cli.main(["mapper", "--dataset", "gold", "--path", str(tmp_path), "--output-file", "y", "--dry-run"]) == 0
    told, planned, tally = map(json.loads, capsys.readouterr().out.splitlines())
    assert planned["status"] == "pending" and tally == {"total": 1, "other": 0, "done": 0, "pending": 1}
    assert told["lane"] == "mapper" and told["keyword_gate"] is False and told["max_article_tokens"] == 57_536
    with pytest.raises(SystemExit):
        cli.main(["mapper", "--dataset", "gold", "--path", str(tmp_path), "--dry-run"])
    (tmp_path / "f.nml").write_text('<doc><djn-mdata accession-number="A" /><text><p>some words</p></text></doc>')
    assert cli.main(["tabular", "--nml-file", str(tmp_path / "f.nml"), "--output", str(tmp_path / "out")]) == 0
    row = json.loads(spark.read.text(str(tmp_path / "out")).first().value)
    assert list(row) == ["accession_number", "p_tokens", "pre_tabular_tokens", "pre_narrative_tokens", "is_tabular_body"] and row["p_tokens"] == 2


def test_last_source_wins(spark):
    a = spark.createDataFrame([("1", "h", ["the first"], [])], ARTICLES)
    g = universe.mapper_view(universe.to_frame(spark, universe.FIXTURE))
    records = mapper.run_mapper(a, g, {c: "s" for c in ("equity index", "rates", "commodity", "volatility", "currency")}, keen).withColumn("headline", F.lit(""))
    twice = spark.createDataFrame([("1", "old", ["a"], 1), ("1", "new", ["b"], 2)], "id string, headline string, paragraphs array<string>, ord long")

    def reader():
        return lambda prompts: [json.dumps({"verdict": "correct" if "new" in user else "incorrect", "relevance_score": 0.5}) for _, user in prompts]

    got = mapper.grade(records, twice, g.union(g), "s", reader).collect()
    assert [v.verdict for v in got] == ["correct"]


def test_run_settings(tmp_path):
    shard = tmp_path / "2014-05_clean.jsonl"
    shard.write_text("")
    run = config.MapperRun(input_file=str(shard), output_dir="out")
    assert run.dataset == "djnw" and run.keyword_gate is True and run.output == "out/2014-05.jsonl" and run.record()["max_article_tokens"] == 57_536
    assert config.MapperRun(dataset="sports", path=str(tmp_path), output_file="x").keyword_gate is False
    assert config.MapperRun(dataset="sports", path=str(tmp_path), output_file="x", keyword_gate=True).keyword_gate is True
    assert config.max_article_tokens(4096, "grader") == 1024
    assert config.MapperRun(mode="dev", dataset="sports", path=str(tmp_path), max_articles=9).output == "results/sports.jsonl"
    assert config.MapperRun(mode="prod", input_dir=str(tmp_path), output_dir="out").dataset == "djnw"
    for wrong in ({"mode": "prod", "dataset": "sports", "path": str(tmp_path), "output_dir": "x"}, {"mode": "prod", "input_file": str(shard), "output_file": "x"}, {"mode": "prod", "input_file": str(shard), "output_dir": "x", "max_articles": 3}, {"mode": "test", "input_file": str(shard), "output_dir": "x"}, {"input_dir": str(tmp_path), "output_file": "x"}, {"input_dir": str(tmp_path), "input_file": str(shard), "output_dir": "x"}, {"dataset": "gold", "path": str(tmp_path), "output_file": "x", "rules": str(tmp_path)}):
        with pytest.raises(ValueError):
            config.MapperRun(**wrong)
    for wrong in ({"output_file": "x"}, {"dataset": "gold", "path": str(tmp_path)}, {"dataset": "gold", "path": str(tmp_path), "output_file": "x", "output_dir": "y"}, {"dataset": "gold", "input_file": str(shard), "output_file": "x"}, {"dataset": "gold", "path": str(tmp_path / "no"), "output_file": "x"}, {"dataset": "other", "output_file": "x"}):
        with pytest.raises(ValueError):
            config.MapperRun(**wrong)
    (tmp_path / "config.json").write_text('{"text_config": {"max_position_embeddings": 2048}}')
    assert config.model_context(str(tmp_path)) == 2048
    with pytest.raises(ValueError):
        config.MapperRun(input_file=str(shard), output_dir="out", model=str(tmp_path))
    (tmp_path / "config.json").write_text("{")
    with pytest.raises(RuntimeError):
        config.model_context(str(tmp_path))
    for wrong in ({"dataset": "djnw"}, {"dataset": "gold"}, {"dataset": "sports", "path": str(tmp_path)}, {"dataset": "gold", "path": str(tmp_path), "mapper_output": "no"}):
        with pytest.raises(ValueError):
            config.GraderRun(**({"mapper_output": str(shard), "output": "o"} | wrong))


def test_runs_are_written(spark, tmp_path):
    a = spark.createDataFrame([("1", "h", ["the first", "last"], []), ("2", "", ["und das"], ["denylist"])], ARTICLES)
    g = universe.mapper_view(universe.to_frame(spark, universe.FIXTURE))
    prompts = {c: "s" for c in ("equity index", "rates", "commodity", "volatility", "currency")}
    records = mapper.run_mapper(a, g, prompts, keen)
    out = str(tmp_path / "a.jsonl")
    told = sinks.write_run(records, out, lambda rows: sinks.mapper_summary(rows, {"k": 1}, {"keyword_gate": True}), True)
    assert told == json.loads((tmp_path / "a.summary.json").read_text())
    assert (told["total_articles"], told["filtered_articles"], told["total_mappings"]) == (2, 1, 1) and told["filtered_by_reason"] == {"denylist": 1} and told["by_group"] == {"English markers": 1}
    with pytest.raises(RuntimeError):
        sinks.write_run(records, str(tmp_path / "b.jsonl"), dict, False)
    assert not (tmp_path / "b.jsonl").exists()
    back = dimensions.mapper_records(spark, out)
    assert {r.article_id: r.groups for r in back.collect()} == {"1": ["English markers"], "2": []} and dimensions.results_of(back, "1").count() == 1
    linked = records.withColumn("url", F.when(F.col("article_id") == "1", 'http://x/"'))
    assert sinks.write_records(linked, str(tmp_path / "u.jsonl")) == 2
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "u.jsonl")).collect()]
    assert {x["article_id"]: x.get("url", "none") for x in lines} == {"1": 'http://x/"', "2": "none"} and all(x["headline"] is not None for x in lines)
    with_url = mapper.run_mapper(a.withColumn("url", F.lit("")), g, prompts, keen)
    assert [r.url for r in with_url.collect()] == [None, None]
    summary = sinks.grader_summary(mapper.grade(back, a, g, "s", strict), {})
    assert (summary["graded"], summary["incorrect"], summary["self_inconsistent"], summary["skipped"]) == (1, 1, 1, 0) and summary["by_group"]["English markers"]["correct_pct"] == 0.0


def test_dimensions(spark, tmp_path):
    universe_file = tmp_path / "u.json"
    universe_file.write_text(json.dumps(universe.FIXTURE))
    assert dimensions.groups_file(str(universe_file)) == universe.FIXTURE
    one = {"exchange_name": "X", "calcseriesname": "c", "name": "Anglo Index", "asset_class": "equity index", "curcdd": "USD", "ric": "r"}
    futures = tmp_path / "f.json"
    futures.write_text(json.dumps({"ANG": one, "#no": {}}))
    assert [(r.symbol, r.name) for r in dimensions.futures(spark, str(futures)).collect()] == [("ANG", "Anglo Index")]
    for wrong, error in (({k: v for k, v in one.items() if k != "ric"}, KeyError), (one | {"asset_class": "other"}, ValueError)):
        futures.write_text(json.dumps({"ANG": wrong}))
        with pytest.raises(error):
            dimensions.futures(spark, str(futures))
    paths = sinks.publish_prompts(Store(spark), {"equity index": "text"}, str(tmp_path / "p"))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["rendered_prompt_equity_index.txt"] and dimensions.prompt_texts(str(tmp_path / "p"), {"equity index": "rendered_prompt_equity_index.txt"}) == {"equity index": "text"}


def test_tasks_of_a_class_follow_each_other(spark):
    tasks = spark.createDataFrame([(str(k), c, "s", "u") for k in range(40) for c in ("a", "b")], "id string, asset_class string, system string, user string")
    got = scoring.score(tasks, scoring.stub_backend).withColumn("part", F.spark_partition_id()).collect()
    assert len(got) == 80
    for p in {r.part for r in got}:
        classes = [r.asset_class for r in got if r.part == p]
        assert classes == sorted(classes)

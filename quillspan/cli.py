"""python -m quillspan.cli LANE ...: the tabular lane over files, the mapper and the grader with stub scorers, prompts, and registered queries."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession


def _model_flags(p: argparse.ArgumentParser) -> None:
    p.add_argument("--max-model-len", type=int, default=65_536)
    p.add_argument("--model", help="folder whose config.json bounds the length and whose tokenizer.json measures articles")
    p.add_argument("--tokenizer", help="vocabulary file that measures articles, in place of the model's")
    p.add_argument("--groups", help="file of the asset groups")
    p.add_argument("--scorer", choices=["stub", "keywords"], default="stub")
    p.add_argument("--dry-run", action="store_true", help="print the settings and what is pending")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspan")
    lanes = p.add_subparsers(dest="lane", required=True)
    t = lanes.add_parser("tabular", help="tell tables from prose in tagged newswire")
    t.add_argument("--nml-file", required=True)
    t.add_argument("--output", required=True)
    m = lanes.add_parser("mapper", help="tag articles with asset groups")
    m.add_argument("--mode", choices=["dev", "prod"])
    m.add_argument("--dataset")
    m.add_argument("--path")
    m.add_argument("--input-file", help="a wire shard")
    m.add_argument("--input-dir", help="a folder of wire shards; those that are done are left out")
    m.add_argument("--pattern", default="*", help="names of the shards of the folder")
    m.add_argument("--output-file")
    m.add_argument("--output-dir")
    m.add_argument("--keyword-gate", action=argparse.BooleanOptionalAction, help="the dataset decides unless given")
    m.add_argument("--max-articles", type=int)
    m.add_argument("--start-date", help="YYYY-MM")
    m.add_argument("--end-date", help="YYYY-MM")
    m.add_argument("--random-seed", type=int)
    m.add_argument("--sidecars", help="folder of the tabular lane's output")
    m.add_argument("--denylist", help="JSON lines of ids to screen, with a reason each")
    m.add_argument("--template", help="text of the system prompt, with places for a class's rules")
    m.add_argument("--rules", help="folder of the classes' rules")
    m.add_argument("--open-records", action="store_true", help="keep keys that the schema doesn't know")
    m.add_argument("--report-stats", action="store_true", help="print each summary")
    _model_flags(m)
    g = lanes.add_parser("grade", help="judge the tags of a mapper's output")
    g.add_argument("--mapper-output", required=True)
    g.add_argument("--output", required=True)
    g.add_argument("--dataset", default="gold")
    g.add_argument("--path")
    g.add_argument("--input-file")
    g.add_argument("--prompt", help="text of the system prompt")
    g.add_argument("--max-tokens", type=int, default=1024, help="of an answer")
    _model_flags(g)
    r = lanes.add_parser("prompts", help="publish the system prompt of each class")
    r.add_argument("--template", required=True)
    r.add_argument("--rules", required=True)
    r.add_argument("--output", required=True)
    r.add_argument("--groups", help="file of the asset groups")
    q = lanes.add_parser("query", help="run a registered query")
    q.add_argument("name")
    q.add_argument("--sf-dir", required=True)
    q.add_argument("--output", required=True)
    return p


def main(argv: list[str] | None = None) -> int:
    from quillspan.operators import lanes, scoring, sinks, universe
    from quillspan.operators.config import GraderRun, MapperRun
    from quillspan.operators.store import Store
    from quillspan.sources import dimensions

    p = parser()
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("quillspan").getOrCreate()
    run = None
    if args.lane in ("mapper", "grade"):
        kind = MapperRun if args.lane == "mapper" else GraderRun
        try:
            run = kind(**{f: v for f, v in vars(args).items() if f in kind.__dataclass_fields__}, files=Store(spark))
        except (ValueError, FileNotFoundError) as e:
            p.error(str(e))
    print(json.dumps(vars(args) | (run.record() if run else {}), sort_keys=True))
    if getattr(args, "dry_run", False):
        if args.lane == "mapper":
            planned = lanes.plan(spark, run)
            for shard in planned:
                print(json.dumps(shard))
            print(json.dumps({"total": len(planned)} | {status: sum(x["status"] == status for x in planned) for status in ("other", "done", "pending")}))
        return 0
    if args.lane == "tabular":
        from quillspan.sources.reading import tabular_results, tagged_documents

        print(json.dumps({"rows": sinks.write_records(tabular_results(tagged_documents(spark, args.nml_file)), args.output)}))
    elif args.lane == "query":
        from quillspan.plans.catalogue import QUERIES

        QUERIES[args.name](spark, args.sf_dir).write.mode("overwrite").parquet(args.output)
    else:
        known = dimensions.groups_file(args.groups) if args.groups else universe.FIXTURE
        every = universe.to_frame(spark, known)
        if args.lane == "prompts":
            prompts = lanes.system_prompts(spark, lanes.mapper_groups(every), args.template, args.rules)
            print(json.dumps(sinks.publish_prompts(Store(spark), prompts, args.output)))
        elif args.lane == "grade":
            print(json.dumps(lanes.grade_output(spark, run, every, scoring.stub_backend)))
        else:
            backend = scoring.stub_backend if args.scorer == "stub" else scoring.keyword_backend({g["name"]: g["keywords"] for g in known.values()})
            for shard, summary in lanes.map_pending(spark, run, lanes.mapper_groups(every), backend).items():
                print(json.dumps({"shard": shard} | (summary if run.report_stats else {"total_articles": summary["total_articles"], "total_mappings": summary["total_mappings"]})))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

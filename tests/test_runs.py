"""The lanes from files to files: length filter, screening, months, prompts, batches, commits, resume, streams, and the month corpus."""

from __future__ import annotations

import json
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspan import cli
from quillspan.functions import tokens
from quillspan.operators import config, gate, lanes, mapper, scoring, sinks, store, universe
from quillspan.sources import corpus, reading
from quillspan.streaming import shards

VOCABULARY = Path("/opt/tokenizers")
KEYWORDS = scoring.keyword_backend({g["name"]: g["keywords"] for g in universe.FIXTURE.values()})


def greedy(vocabulary, word):
    """The merges as they are defined: again and again the leftmost pair of least rank, looked for in the whole word."""
    parts = [word[k : k + 1] for k in range(len(word))]
    while True:
        ranked = [(r, k) for k in range(len(parts) - 1) if (r := vocabulary.rank(parts[k], parts[k + 1])) is not None]
        if not ranked:
            return parts
        k = min(ranked)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def toy_vocabulary():
    """A tokenizer.json with merges over a, b and é, of which some make others possible."""
    merges = ["a b", "ab a", "b b", "aba bb", "Ã ©", "a Ã©", "a a", "aa aa"]
    return json.dumps({"model": {"type": "BPE", "merges": merges}, "pre_tokenizer": {"type": "ByteLevel", "use_regex": True}}).encode()


def test_merges():
    rng, vocabulary = random.Random(1), tokens.parse(toy_vocabulary(), "tokenizer.json")
    for _ in range(3000):
        word = "".join(rng.choice("aabbéx") for _ in range(rng.randint(0, 14))).encode()
        assert vocabulary.pieces(word) == greedy(vocabulary, word)
    assert vocabulary.count("abab " + "a" * 200_000) == len(greedy(vocabulary, b"abab")) + 50_001  # a word of any length costs about its length
    for wrong in ({"model": {"type": "WordPiece"}}, {"model": {"type": "BPE", "merges": []}, "pre_tokenizer": {"type": "Whitespace"}}):
        with pytest.raises(ValueError):
            tokens.parse(json.dumps(wrong).encode(), "tokenizer.json")


@pytest.mark.skipif(not VOCABULARY.exists(), reason="no public vocabularies here")
def test_public_vocabularies(spark):
    """Counts equal those of the vocabularies' own library, from either kind of file, over texts of all languages."""
    from tokenizers import Tokenizer

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.substring("text", 1, 3000).alias("text")).collect()
    texts = [r.text or "" for r in rows] + ["it's 12 o'clock\n\n  now\t　x", "日本語 emoji 🙂", "", "  "]
    theirs = Tokenizer.from_file(str(VOCABULARY / "byte_bpe_50k.json"))
    theirs.encode_special_tokens = True
    want = [len(e.ids) for e in theirs.encode_batch(texts, add_special_tokens=False)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(-1, None)], "k int, text string")
    for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"):
        got = dict(df.select("k", tokens.counter(spark, f"file://{VOCABULARY / name}")(F.col("text"))).collect())
        assert got.pop(-1) is None and [got[k] for k in range(len(texts))] == want


@pytest.fixture
def wire(tmp_path):
    """Two months of shards, a sidecar for one, a vocabulary, prompts."""
    (tmp_path / "in").mkdir()
    texts = {"20140501A": "the rise that was told", "20140502B": "a b " * 700, "20140503C": "ab" * 900, "20140601D": "los precios del mes"}
    for month in ("2014-05", "2014-06"):
        rows = [{"id": i, "headline": "", "paragraphs": [t[:60]], "text": t, "codes": {"subject": ["N/X"]}} for i, t in texts.items() if i.startswith(month.replace("-", ""))]
        (tmp_path / f"in/{month}_clean.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (tmp_path / "in/notes.txt").write_text("no shard")
    (tmp_path / "side").mkdir()
    (tmp_path / "side/2014-05.jsonl").write_text('{"accession_number": "20140501A", "is_tabular_body": true}\n' * 2 + '{"accession_number": "20140503C", "is_tabular_body": false}\n')
    (tmp_path / "tokenizer.json").write_bytes(toy_vocabulary())
    (tmp_path / "config.json").write_text('{"max_position_embeddings": 65536}')
    return tmp_path


def told(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines()]


def test_lane_over_a_folder(spark, wire, capsys):
    """Length filter, screening, resume and dry run, by the command line and on a URI."""
    base = ["mapper", "--input-dir", f"file://{wire}/in", "--output-dir", f"file://{wire}/out", "--sidecars", f"file://{wire}/side", "--max-model-len", "9000", "--scorer", "keywords"]
    with pytest.raises(ValueError, match="tokenizer"):
        cli.main(base)
    assert not list((wire / "out").glob("*.summary.json")) if (wire / "out").exists() else True
    capsys.readouterr()
    run = [*base, "--tokenizer", f"file://{wire}/tokenizer.json", "--report-stats"]
    assert cli.main([*run, "--dry-run"]) == 0
    settings, *planned, tally = told(capsys)
    assert tally == {"total": 2, "other": 0, "done": 0, "pending": 2} and settings["max_article_tokens"] == 1024 and [(x["shard"], x["status"]) for x in planned] == [("2014-05", "pending"), ("2014-06", "pending")]
    assert cli.main([*run, "--pattern", "*-05"]) == 0
    _, may = told(capsys)
    # 2,800 characters of "a b " are 1,400 tokens and go; 1,800 of "ab" are some hundred and stay
    assert may["shard"] == "2014-05" and may["total_articles"] == 2 and may["filtered_by_reason"] == {"tabular_body": 1} and may["run"]["timing"]["n_articles"] == 2
    assert may["gate"] == {"keyword_gate": True, "calls_made": 0, "calls_skipped": 6, "calls_saved_pct": 100.0}
    assert cli.main([*run, "--dry-run"]) == 0
    assert [x["status"] for x in told(capsys)[1:-1]] == ["done", "pending"]
    assert cli.main([*run, "--dry-run", "--start-date", "2014-06", "--pattern", "*-0?"]) == 0
    assert told(capsys)[-1] == {"total": 2, "other": 1, "done": 0, "pending": 1}
    before = (wire / "out/2014-05.summary.json").stat().st_mtime_ns
    assert cli.main(run) == 0
    assert [x["shard"] for x in told(capsys)[1:]] == ["2014-06"] and (wire / "out/2014-05.summary.json").stat().st_mtime_ns == before
    june = json.loads((wire / "out/2014-06.summary.json").read_text())
    assert june["by_group"] == {"Spanish markers": 1} and june["total_mappings"] == 1
    assert cli.main(run) == 0 and told(capsys)[1:] == []
    with pytest.raises(RuntimeError):
        cli.main(["mapper", "--input-file", f"{wire}/in/2014-06_clean.jsonl", "--output-dir", f"{wire}/out", "--no-keyword-gate", "--max-model-len", "9000"])


def test_months(spark, wire, capsys):
    """Shards of other months aren't opened: a broken one does no harm; bounds are checked."""
    (wire / "in/2014-07_clean.jsonl").write_bytes(b"\xff\xfe broken")
    df = reading.wire_articles(spark, f"{wire}/in", "2014-05", "2014-06")
    assert len(df.inputFiles()) == 2 and df.count() == 4
    assert [r.id for r in reading.wire_articles(spark, f"{wire}/in", start="2014-06", end="2014-06").collect()] == ["20140601D"]
    with pytest.raises(FileNotFoundError):
        reading.wire_articles(spark, f"{wire}/in", start="2015-01")
    with pytest.raises(FileNotFoundError):
        reading.wire_articles(spark, f"{wire}/nowhere")
    for wrong in ("2014", "2014-13"):
        with pytest.raises(ValueError):
            config.MapperRun(dataset="djnw", path=str(wire), output_file="x", start_date=wrong)
    assert [r.id for r in reading.wire_articles(spark, f"{wire}/in", "2014-05", "2014-06", max_articles=2).orderBy("ord").collect()] == ["20140501A", "20140502B"]
    assert len({r.id for r in reading.wire_articles(spark, f"{wire}/in", "2014-05", "2014-06", max_articles=3, seed=4).collect()}) == 3


def test_sources_take_what_they_know(spark, tmp_path):
    """Gold is read whole whatever the bounds; a folder of web articles is cut before its filters, a line file after them."""
    (tmp_path / "gold_1.json").write_text(json.dumps({"id": "1", "headline": "h", "paragraphs": ["p" * 5000], "text": "x" * 5000}))
    options = {"max_articles": 0, "max_tokens": 1, "start": "2014-01", "tabular": None}
    assert reading.load_articles(spark, "gold", str(tmp_path), **options).first().filtered_reasons == []
    with pytest.raises(TypeError):
        reading.load_articles(spark, "gold", str(tmp_path), pages=1)


def test_screened_once(spark):
    df = spark.createDataFrame([("A", ["tabular_body"]), ("A", None), ("B", ["x"])], "id string, filtered_reasons array<string>")
    side = spark.createDataFrame([("A", True), ("A", True), ("B", False), ("C", True)], "accession_number string, is_tabular_body boolean")
    assert sorted((r.id, r.filtered_reasons) for r in reading.screened(df, side).collect()) == [("A", ["tabular_body"]), ("A", ["tabular_body"]), ("B", ["x"])]
    denied = spark.createDataFrame([("B", None), ("B", "unembeddable"), ("B", "x"), ("A", "tabular_body")], "id string, reason string")
    assert sorted((r.id, r.filtered_reasons) for r in reading.screened(df, side, denied).collect()) == [("A", ["tabular_body"]), ("A", ["tabular_body"]), ("B", ["x", "denylist", "unembeddable"])]
    assert [r.filtered_reasons for r in reading.screened(df, None).where("id = 'A'").orderBy(F.size("filtered_reasons")).collect()] == [[], ["tabular_body"]]


def test_killed_write(spark, tmp_path):
    """What fails midway leaves no summary, is done again, and leaves no staging folder then."""
    s, out = store.Store(spark), f"file://{tmp_path}/out/a.jsonl"
    df = spark.createDataFrame([("1", "x")], "id string, text string")
    assert sinks.write_run(df, out, lambda rows: {"n": rows.count()}) == {"n": 1} and store.committed(s, out)
    with pytest.raises(ZeroDivisionError):
        sinks.write_run(df, out, lambda rows: {"n": 1 // 0})
    assert not store.committed(s, out) and not s.exists(store.beside(out, "summary"))
    with pytest.raises(Exception, match="late"):
        sinks.write_run(df.select("id", F.raise_error(F.lit("late")).alias("text")), out, lambda rows: {})
    assert not store.committed(s, out) and any("staging" in e.name for e in s.listing(f"file://{tmp_path}/out"))
    sinks.write_run(df, out, lambda rows: {"n": rows.count()})
    assert store.committed(s, out) and sorted(e.name for e in s.listing(f"file://{tmp_path}/out") if not e.name.startswith(".")) == ["a.jsonl", "a.manifest.json", "a.summary.json"]
    part = next(p for p in (tmp_path / "out/a.jsonl").iterdir() if p.name.startswith("part"))
    part.unlink()
    assert not store.committed(s, out)  # a part that went missing


def test_graders_plan(spark, wire, capsys):
    """Mapper outputs without source, graded ones and pending ones; the grader's prompt is a file."""
    run = ["mapper", "--input-dir", f"{wire}/in", "--output-dir", f"{wire}/out", "--max-model-len", "9000", "--scorer", "keywords", "--model", str(wire)]
    assert cli.main(run) == 0
    (wire / "out/1999-01.jsonl").mkdir()
    (wire / "prompt.txt").write_text("Judge.")
    capsys.readouterr()
    mapped = f"{wire}/out/2014-06.jsonl"
    assert cli.main(["grade", "--mapper-output", mapped, "--output", f"{wire}/graded/2014-06.jsonl", "--dataset", "djnw", "--input-file", f"{wire}/in/2014-06_clean.jsonl", "--prompt", f"{wire}/prompt.txt"]) == 0
    settings, summary = told(capsys)
    assert settings["max_tokens"] == 1024 and summary["graded"] == 1 and summary["by_group"]["Spanish markers"]["correct_pct"] == 100.0
    got = {r.shard: r.status for r in lanes.gradable(spark, f"{wire}/out", f"{wire}/in", f"{wire}/graded").collect()}
    assert got == {"1999-01": "no_source", "2014-05": "pending", "2014-06": "done"}


def test_deny_list(spark, wire, capsys):
    (wire / "deny.jsonl").write_text('{"id": "20140601D", "reason": "unembeddable"}\n{"id": "nowhere"}\n\n')
    run = ["mapper", "--input-file", f"{wire}/in/2014-06_clean.jsonl", "--output-file", f"{wire}/d/x.jsonl", "--scorer", "keywords", "--report-stats"]
    assert cli.main([*run, "--denylist", f"file://{wire}/deny.jsonl"]) == 0
    summary = told(capsys)[1]
    assert summary["filtered_by_reason"] == {"unembeddable": 1} and summary["total_mappings"] == 0 and summary["total_articles"] == 1
    with pytest.raises(SystemExit):
        cli.main([*run, "--denylist", f"{wire}/none.jsonl"])


def test_prompt_files(spark, wire, capsys):
    (wire / "rules").mkdir()
    classes = {g["asset_class"] for g in universe.FIXTURE.values() if g["asset_class"] != universe.EXCLUDED}
    for c in classes:
        (wire / f"rules/{c.replace(' ', '_')}.txt").write_text(f"not {c}\n===POSITIVE RULES===\nyes {c}\n")
    (wire / "template.txt").write_text("Task. {{DISQUALIFIERS}} / {{POSITIVE_RULES}}")
    files = ["--template", f"{wire}/template.txt", "--rules", f"{wire}/rules"]
    assert cli.main(["prompts", *files, "--output", f"file://{wire}/published"]) == 0
    assert (wire / "published/rendered_prompt_equity_index.txt").read_text() == "Task. not equity index / yes equity index"
    capsys.readouterr()
    assert cli.main(["mapper", "--input-file", f"{wire}/in/2014-06_clean.jsonl", "--output-file", f"{wire}/o/x.jsonl", "--scorer", "keywords", *files]) == 0
    assert told(capsys)[1]["total_mappings"] == 1
    (wire / "rules/rates.txt").unlink()
    with pytest.raises(ValueError, match="without rules"):
        cli.main(["prompts", *files, "--output", f"{wire}/published"])


def test_batches_of_a_class(spark):
    """No batch holds two classes or goes over its budget, at any size of Arrow batches; answers come back to their rows."""
    rng = random.Random(7)
    rows = [(f"{k}", rng.choice(["a", "b", "c"]), f"user {k} " + "x" * rng.randint(0, 40)) for k in range(400)]
    tasks = spark.createDataFrame([(i, c, f"system of {c}", u) for i, c, u in rows], "id string, asset_class string, system string, user string")

    def recorder():
        def answer(prompts):
            assert len({s for s, _ in prompts}) == 1
            assert len(prompts) == 1 or len(prompts[0][0]) + sum(len(u) for _, u in prompts) <= 300
            return [json.dumps({"evidence_paragraphs": [int(u.split()[1]), len(prompts)], "relevant": True}) for _, u in prompts]

        return answer

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for size in ("1", "7", "10000"):
            spark.conf.set(key, size)
            got = scoring.score(tasks, recorder, batch_chars=300).collect()
            assert sorted(r.id for r in got) == sorted(i for i, _, _ in rows) and all(r.result.evidence_paragraphs[0] == int(r.id) for r in got)
            assert max(r.result.evidence_paragraphs[1] for r in got) > 3
    finally:
        spark.conf.set(key, before)
    with pytest.raises(Exception, match="answers to"):
        scoring.score(tasks, lambda: lambda prompts: [], batch_chars=300).collect()
    assert [len(b) for b in scoring.packed([("a", "s", "x" * 9)] * 3 + [("b", "s", "x" * 99)] * 2, 20)] == [2, 1, 1, 1]


def test_gate_equals_its_patterns(spark):
    """Phrases of any characters, folded letters, empty words: the fired groups are those of every group's pattern, without a nested loop."""
    rng = random.Random(11)
    bits = ["gold", "Gold", "crude oil", "S&P 500", "C++", "$gold", "Öl", "são paulo", "T-bill", "t bill", "K", "ſ", "oil-crude", "€", "all rights reserved", "no. 1", "1,000", "\\E", "a|b", "(x)", "US", "İx"]
    groups = spark.createDataFrame([(f"g{k}", "n", "rates", rng.sample(bits, rng.randint(1, 5)), []) for k in range(40)], universe.SCHEMA)
    texts = [""] + ["".join(rng.choice([rng.choice(bits), rng.choice(bits).upper(), rng.choice(bits).lower(), "K", "word"]) + rng.choice([" ", "", "-", "\n", "  ", "é", "1", ", "]) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    a = spark.createDataFrame(list(enumerate(texts)), "article_id long, gate_text string")
    pairs = gate.fired_pairs(a, groups)
    got, want = ({tuple(r) for r in df.collect()} for df in (pairs, gate.theta_pairs(a, groups)))
    assert got == want and len(got) > 3000 and pairs.count() == len(got)
    plan = pairs._sc._jvm.PythonSQLUtils.explainString(pairs._jdf.queryExecution(), "formatted")
    assert "NestedLoop" not in plan and "Exchange" not in plan


def test_repeated_ids_keep_their_own_text(spark):
    """Articles that share an id aren't multiplied by the gate."""
    a = spark.createDataFrame([("1", "h", ["the first"], []), ("1", "h", ["nichts"], [])], "id string, headline string, paragraphs array<string>, filtered_reasons array<string>")
    t = mapper.mapper_tasks(a, universe.mapper_view(universe.to_frame(spark, universe.FIXTURE)), dict.fromkeys(("equity index", "rates", "commodity", "volatility", "currency"), "s"))
    assert [(r.group_key, r.paragraphs) for r in t.collect()] == [("english", ["the first"])]


def test_month_corpus(spark, tmp_path):
    """Month bounds prune folders; a lookup opens only files whose range and filter have the id, and finds every id."""
    ids = [f"2014{m:02d}{d:02d}{n:05d}" for m in (1, 2, 3) for d in range(1, 29) for n in range(0, 60)] + ["oddity"]
    df = spark.createDataFrame([(i, f"h {i}", ["p"]) for i in ids], "id string, headline string, paragraphs array<string>")
    folder = f"file://{tmp_path}/corpus"
    corpus.write_corpus(df, folder, rows_per_file=400)
    assert corpus.find_article(spark, folder, ids[5]).first().headline == f"h {ids[5]}"  # no index yet
    corpus.write_index(spark, folder)
    feb = corpus.read_corpus(spark, folder, "2014-02", "2014-02")
    assert feb.count() == 28 * 60 and corpus.read_corpus(spark, folder).count() == len(ids)
    plan = feb._sc._jvm.PythonSQLUtils.explainString(feb._jdf.queryExecution(), "formatted")
    assert "2014-02" in re.search(r"PartitionFilters: \[(.*)\]", plan)[1]
    rng = random.Random(5)
    for i in [*rng.sample(ids, 12), "oddity"]:
        found = corpus.find_article(spark, folder, i)
        assert [r.headline for r in found.collect()] == [f"h {i}"] and len(found.inputFiles()) == 1
    absent = [f"201402{rng.randint(1, 28):02d}{rng.randint(100, 99999):05d}" for _ in range(40)]
    assert all(corpus.find_article(spark, folder, i).collect() == [] for i in absent[:5])
    opened = [len(corpus.candidate_files(spark, folder, i)) for i in absent[:12]]
    assert sum(opened) <= 3  # by range alone it would be about one each
    assert corpus.find_article(spark, folder, "20150101x").collect() == [] == corpus.candidate_files(spark, folder, "20150101x")


def test_streams_commit_once(spark, wire):
    """A batch that is handed on again writes nothing; rows are those of the batch lane, documents far apart merged."""
    groups = universe.mapper_view(universe.to_frame(spark, universe.FIXTURE))
    prompts = dict.fromkeys(("equity index", "rates", "commodity", "volatility", "currency"), "s")
    out = f"file://{wire}/stream"
    count = tokens.counter(spark, f"{wire}/tokenizer.json")
    go = lambda mark: shards.map_new_shards(spark, f"{wire}/in/*.jsonl", f"{wire}/{mark}", out, groups, prompts, KEYWORDS, max_tokens=1024, count_tokens=count, tabular=reading.tabular_sidecars(spark, f"{wire}/side"))
    go("ck")
    first = {e.path: e.size for e in store.Store(spark).listing(out)}
    summary = json.loads((wire / "stream/batch-00000000.summary.json").read_text())
    assert summary["total_articles"] == 3 and summary["filtered_by_reason"] == {"tabular_body": 1} and summary["by_group"] == {"Spanish markers": 1}
    stamp = (wire / "stream/batch-00000000.summary.json").stat().st_mtime_ns
    go("lost")  # its checkpoint is gone, so the batch comes again
    assert {e.path: e.size for e in store.Store(spark).listing(out)} == first and (wire / "stream/batch-00000000.summary.json").stat().st_mtime_ns == stamp
    doc = lambda acc, body: f'<doc>\n<djn-mdata accession-number="{acc}" />\n<text>{body}</text>\n</doc>\n'
    (wire / "nml").mkdir()
    (wire / "nml/a.nml").write_text(doc("A", "<p>one two</p>") + "".join(doc(f"X{k}", "<p>filler</p>") for k in range(200)) + doc("A", "<p>three</p>"))
    for _ in range(2):
        shards.tabulate_new_files(spark, f"{wire}/nml", f"{wire}/nml-ck", f"{wire}/tab")
    (wire / "nml/b.nml").write_text(doc("A", "<p>another file</p>"))
    shards.tabulate_new_files(spark, f"{wire}/nml", f"{wire}/nml-ck", f"{wire}/tab")
    rows = [json.loads(r.value) for r in spark.read.text(f"{wire}/tab/*.jsonl").collect()]
    assert len(rows) == 202 and sorted(r["p_tokens"] for r in rows if r["accession_number"] == "A") == [2, 3]
    whole = [json.loads(r.value) for r in reading.tabular_results(reading.tagged_documents(spark, f"{wire}/nml")).select(F.to_json(F.struct("*")).alias("value")).collect()]
    assert sorted(map(str, whole)) == sorted(map(str, rows))


def test_open_records(spark, wire, capsys):
    """Keys outside the schema survive from the shard to the record, whatever their kind, and can be asked for by path."""
    odd = {"id": "20140701E", "headline": "the odd one", "paragraphs": ["the odd paragraph"], "codes": {"subject": ["N/OIL", "M/EN"]}, "rank": 7, "flag": None, "url": "http://x/"}
    plain = {"id": "20140702F", "headline": "", "paragraphs": ["no more keys"]}
    (wire / "in/2014-07_clean.jsonl").write_text(json.dumps(odd) + "\n" + json.dumps(plain) + "\n")
    df = reading.wire_articles(spark, f"{wire}/in/2014-07_clean.jsonl", open_records=True)
    typed = reading.wire_articles(spark, f"{wire}/in/2014-07_clean.jsonl")
    assert sorted(map(str, df.drop("extra", "ord").collect())) == sorted(map(str, typed.drop("ord").collect()))
    row = df.select("id", reading.extra_value("codes.subject[1]").alias("code"), reading.extra_value("rank", "int").alias("rank"), reading.extra_value("none").alias("none")).where("code is not null").collect()
    assert [tuple(r) for r in row] == [("20140701E", "M/EN", 7, None)]
    assert cli.main(["mapper", "--input-file", f"{wire}/in/2014-07_clean.jsonl", "--output-file", f"{wire}/open/x.jsonl", "--scorer", "keywords", "--open-records"]) == 0
    lines = {r["article_id"]: r for r in (json.loads(x.value) for x in spark.read.text(f"{wire}/open/x.jsonl").collect())}
    assert lines["20140701E"]["extra"] == {"codes": odd["codes"], "rank": 7, "flag": None} and lines["20140701E"]["url"] == "http://x/" and lines["20140701E"]["groups"] == ["English markers"]
    assert "extra" not in lines["20140702F"] and "url" not in lines["20140702F"]
    (wire / "gold").mkdir()
    (wire / "gold/gold_1.json").write_text(json.dumps(odd, indent=1))
    assert reading.load_articles(spark, "gold", f"{wire}/gold", open_records=True).select(reading.extra_value("codes.subject", "array<string>")).first()[0] == ["N/OIL", "M/EN"]

"""Rules of the article lanes on the awkward inputs."""

import json
import math
import random

import ladder_rule
import pytest
from pyspark.sql import functions as F

from quillspan.functions import ladder, tabular, textcols
from quillspan.operators import gate, scoring, sinks, universe
from quillspan.operators.store import Store
from quillspan.sources import reading


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_clean_web_text(spark):
    assert one(spark, "Home\n\n a | b | c | d \nShort!\nA line of prose that stays\n", textcols.clean_web_text) == "Short!\nA line of prose that stays"


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (None, []), ("", []), (" \n ", []), ("tiny", ["tiny"]),
        ("one long single line. " * 3, [("one long single line. " * 3).strip()]),
        ("a" * 40 + " \t b\n\n\n" + "c" * 30, ["a" * 40 + " b", "c" * 30]),
        ("\n".join(["x" * 80, "y" * 80]), ["x" * 80, "y" * 80]),
        ("\n".join(f"Sentence number {k} is right here." for k in range(4)), [" ".join(f"Sentence number {k} is right here." for k in range(3)), "Sentence number 3 is right here."]),
        ("\n".join(f"Sentence number {k} is here." for k in range(3)), [" ".join(f"Sentence number {k} is here." for k in range(3))]),
    ],
)
def test_paragraphs(spark, text, expected):
    assert one(spark, text, textcols.paragraphs) == expected


@pytest.mark.parametrize(("text", "fires"), [("turmoil", []), ("(oil)", ["oil"]), ("OIL!", ["oil"]), ("éoil", ["oil"]), ("the S&P 500 fell", ["spx"]), ("S&P 5000", []), ("Kit", ["kit"]), ("oil_x", ["oil"]), ("o\u0131l", ["oil"]), ("O\u0130L", ["oil"]), ("the \u017f&p 500", ["spx"]), ("x\u0131oil", []), ("\u039f\u0394\u039f\u03a3 gap", ["odos"])])
def test_gate(spark, text, fires):
    g = spark.createDataFrame([("oil", ["oil", "crude oil"]), ("spx", ["S&P 500"]), ("kit", ["kit"]), ("odos", ["\u03bf\u03b4\u03bf\u03c3 gap"])], "group_key string, keywords array<string>")
    a = spark.createDataFrame([(1, text)], "article_id long, gate_text string")
    assert [r.group_key for r in gate.fired_pairs(a, g).collect()] == fires == [r.group_key for r in gate.theta_pairs(a, g).collect()]


def test_gate_text_of_null_headline(spark):
    d = spark.createDataFrame([(None, ["p", "q"])], "h string, p array<string>")
    assert d.select(textcols.gate_text(F.col("h"), F.col("p"))).first()[0] == "\np\nq"


def test_universe_checks():
    group = lambda **kw: {"name": "G", "asset_class": "rates", "keywords": ["k"], "members": [{"name": "A", "ticker_symbol": "T", "short_name": "a"}]} | kw
    for bad in ({"g": []}, {"g": group(keywords=[])}, {"g": group(members=[{"name": "A", "ticker_symbol": "T"}])}, {"g": group(), "h": group(name="H")}):
        with pytest.raises(ValueError):
            universe.validate(bad)
    with pytest.raises(ValueError):
        universe.lookup({"g": group(), "h": group(name="a", members=[])})
    assert universe.lookup({"g": group()}) == {"G": "g", "a": "g"}
    assert universe.constituents({"g": group()}, "g") == [("A", "a")] and universe.member_index({"g": group()}) == {"A": "g"} and universe.ticker_index({"g": group()}) == {"A": "T"}
    with pytest.raises(KeyError):
        universe.constituents({"g": group()}, "h")
    with pytest.raises(ValueError):
        universe.member_index({"g": group(), "h": group()})


def test_overlap(spark):
    g = universe.to_frame(spark, universe.FIXTURE)
    assert universe.overlap(g).collect() == []
    twice = g.where("group_key = 'rare'").selectExpr("'again' AS group_key", "name", f"'{universe.EXCLUDED}' AS asset_class", "keywords", "members")
    assert [r.name for r in universe.overlap(g.union(twice)).collect()] == ["Ghost Index"]
    with pytest.raises(ValueError, match="unknown class"):
        universe.validate({"x": {"name": "n", "asset_class": "stamps", "keywords": ["k"], "members": []}})


def test_listing():
    kinds = {"ZZ": "currency", "AA": "currency", "LE": "commodity", "GC": "commodity", "CL": "commodity", "NKD": "equity index", "ES": "equity index", "Q": "other"}
    assets = {s: {"name": s.lower(), "asset_class": c} for s, c in kinds.items()} | {"VX": {"asset_class": "volatility"}}
    told = ["**COMMODITIES**", "- **Energy:** CL (cl)", "- **Metals:** GC (gc)", "- **Agri/Softs/Livestock:** LE (le)", "", "**CURRENCIES**", "AA (aa), ZZ (zz)", ""]
    told += ["**EQUITY INDEX FUTURES**", "- **US:** ES (es)", "- **Asia/Other:** NKD (nkd)", "", "**VOLATILITY**", "VX (VX)", ""]
    assert universe.listing(assets) == "\n".join(told) and universe.listing({}) == ""


@pytest.mark.parametrize(
    ("block", "flags"),
    [
        ("a  b  1\nc  d  2\ne  f  3", [True] * 3), ("one line here\nand one more\nand a third", [False] * 3), ("a  b  1\nc  d  2", [False] * 2),
        ("=====\ncaption of it\n1  2", [True, False, True]), ("name  12.5%\nname  x\n  lead only", [True, False, False]), (" \n\n", []),
    ],
)
def test_tabular_lines(spark, block, flags):
    assert [x.is_tabular for x in one(spark, block, tabular.classify_block)] == flags


def test_trailers(spark):
    shown = ["-0-", "(END)", "(MORE) (MORE)", "June 13, 1979 08:08 ET (12:08 GMT)", "Corrected July 19, 2004 16:49 ET", "(end) Dow Jones Newswires", "(MORE TO FOLLOW) Dow Jones Newswire"]
    got = one(spark, [*shown, "", "prose (END) here"], lambda x: F.transform(x, tabular.is_trailer), "array<string>")
    assert got == [True] * len(shown) + [False, False]


def test_ladder():
    """The rule that the JVM's ladder is held against."""
    default = {"evidence_paragraphs": [], "relevance_score": 0.0, "relevant": False}
    ok = {"evidence_paragraphs": [1, 2], "relevance_score": 0.5, "relevant": True}
    raw = '{"evidence_paragraphs": ["1", 2.0], "relevance_score": "0.5", "relevant": "true", "more": 1}'
    assert ladder_rule.read(raw, ladder_rule.MAPPER) == ladder_rule.read(f"so: {raw} end", ladder_rule.MAPPER) == ok
    for bad in (None, "", "{", "[]", "null", '{"relevant": null}', '{"evidence_paragraphs": [1.5]}', '{"evidence_paragraphs": ["a"], "relevant": true}', '{"a": "}"'):
        assert ladder_rule.read(bad, ladder_rule.MAPPER) == default
    assert ladder_rule.read('{"verdict": "borderline"}', ladder_rule.GRADER)["verdict"] == ladder_rule.read("{}", ladder_rule.GRADER)["verdict"] == "correct"
    assert ladder_rule.read('{"verdict": "incorrect", "relevance_score": 7}', ladder_rule.GRADER)["relevance_score"] == 7.0


def test_ladder_in_the_jvm(spark):
    """Answers of every kind and state of repair, read as the rule reads them, without a Python worker."""
    rng = random.Random(9)
    values = ["1", "0", "1.0", "0.5", "2.0", "1.5", "-3", "1e2", "1e400", "12345678901", "true", "false", "null", '"0.5"', '" 3 "', '"+4"', '"1_0"', '"1_0.5"', '"x"', '"true"', '"YES"', '"off"', '"1"', '".5"', '"5."', '"1d"', '"nan"', '"-Infinity"', "NaN", "-Infinity", "[]", "{}", "[1]", '[1, "2", 3.0, true]', "[1.5]", '["a"]', "[null]", "[[1]]", "[1, 12345678901]", '"correct"', '"incorrect"', '"borderline"', '"a } b"', '"{"', '"x: NaN, y"']
    keys = ["evidence_paragraphs", "relevance_score", "relevant", "verdict", "more"]

    def answer():
        told = "{" + ", ".join(f'"{k}": {rng.choice(values)}' for k in rng.sample(keys, rng.randint(0, 5))) + "}"
        return rng.choice([told, told, f"I think: {told} done", f"{told}{told}", f"{told}]", f"```json\n{told}\n```", told[:-1], f"}}{told}", f"[{told}]", f" {told}\n", f"{{{told}}}", f"1, {told}", f'{told},"z":1', "{} " + told])

    raws = [answer() for _ in range(6000)] + [None, "", "{", "}", "{}", "null", "[]", "1", "\ufeff{}", '{"a":1}}', "{{}", "{}}", " ", "{'a': 1}", '{"relevant": 01}']
    df = spark.createDataFrame(list(enumerate(raws)), "k int, raw string")
    for parse, fields in ((ladder.parse_mapper, ladder_rule.MAPPER), (ladder.parse_grader, ladder_rule.GRADER)):
        parsed = df.select("k", parse(F.col("raw")).alias("r"))
        assert "EvalPython" not in parsed._sc._jvm.PythonSQLUtils.explainString(parsed._jdf.queryExecution(), "formatted")
        got = {k: r.asDict() for k, r in parsed.collect()}
        wrong = []
        for k, raw in enumerate(raws):
            want = ladder_rule.read(raw, fields)
            if any(abs(i) >= 2**31 for i in want["evidence_paragraphs"]):
                want = ladder_rule.read("{}", fields)  # an int can't hold it
            want["relevance_score"] = None if math.isnan(want["relevance_score"]) else want["relevance_score"]
            if got[k] != want:
                wrong.append((raw, got[k], want))
        assert not wrong, (len(wrong), wrong[:5])
    twice = spark.createDataFrame([('{"relevant": true, "relevant": true}',)], "raw string").select(ladder.parse_mapper(F.col("raw")).alias("r")).first().r
    assert twice.relevant is False


def test_two_decimals(spark):
    assert [one(spark, x, ladder.two_decimals, "double") for x in (0.125, 2.675, None)] == ["0.12", "2.67", None]
    rng = random.Random(2)
    xs = [k / 1000 for k in range(2001)] + [rng.uniform(-2000, 2000) for _ in range(500)] + [-0.0, -0.001, 0.005, 1e15, float("inf"), float("-inf")]
    got = dict(spark.createDataFrame(list(enumerate(xs)), "k int, x double").select("k", ladder.two_decimals("x")).collect())
    assert [got[k] for k in range(len(xs))] == [f"{x:.2f}" for x in xs]


def test_scorer(spark):
    tasks = spark.createDataFrame([("s", "u1"), ("s", "u2")], "system string, user string")
    assert [r.result.relevant for r in scoring.score(tasks, scoring.stub_backend).collect()] == [False, False]
    with pytest.raises(Exception, match="answers to"):
        scoring.score(tasks, lambda: lambda prompts: []).collect()


def test_class_prompts():
    assert scoring.class_prompts("A {{DISQUALIFIERS}} B {{POSITIVE_RULES}}", {"x": "\nd\n===POSITIVE RULES===\np\n"}, {"x"}) == {"x": "A d B p"}
    for template, rules, needed in (("{{DISQUALIFIERS}}", {"x": "d===POSITIVE RULES===p"}, {"x"}), ("t", {"x": "d"}, {"x"}), ("t", {}, {"x"}), ("t", {"x": ""}, set())):
        with pytest.raises(ValueError):
            scoring.class_prompts(template, rules, needed)


def test_mixed_gate(spark, tmp_path):
    (tmp_path / "a.summary.json").write_text(json.dumps({"gate": {"keyword_gate": True}}))
    for folder in (str(tmp_path), f"file://{tmp_path}"):
        check = lambda own, gate, folder=folder: sinks.refuse_mixed_gate(Store(spark), folder, own, gate)
        check("b.summary.json", True)
        check("a.summary.json", False)
        with pytest.raises(RuntimeError):
            check("b.summary.json", False)
    (tmp_path / "c.summary.json").write_text("{")
    with pytest.raises(RuntimeError):
        check("b.summary.json", True)
    (tmp_path / "c.summary.json").write_text("{}")  # a summary without a gate block is of an ungated run
    with pytest.raises(RuntimeError):
        check("b.summary.json", True)


def test_sources(spark, tmp_path):
    (tmp_path / "gold").mkdir()
    (tmp_path / "gold/gold_1.json").write_text(json.dumps({"id": "1", "headline": "h", "paragraphs": ["p"]}))
    assert reading.load_articles(spark, "gold", str(tmp_path / "gold")).first().id == "1"
    (tmp_path / "web").mkdir()
    for k in range(3):
        (tmp_path / f"web/{k}.json").write_text(json.dumps({"title": f"t{k}", "text": "A line of prose that stays here.\n" * (k + 1) if k else ""}))
    (tmp_path / "web/summary.json").write_text("{}")
    assert [r.id for r in reading.sports_articles(spark, str(tmp_path / "web"), max_articles=2).collect()] == ["1"]
    with pytest.raises(ValueError):
        reading.sports_articles(spark, str(tmp_path / "web"), max_tokens=5).collect()
    (tmp_path / "w.jsonl").write_text('{"title": "a", "text": ""}\n{"page_id": "7", "text": "some words that make a line\\nmenu"}\n\n{"text": "other words that make a line"}\n')
    assert [(r.id, r.paragraphs) for r in reading.wiki_articles(spark, str(tmp_path / "w.jsonl"), 2).collect()] == [("wiki_7", ["some words that make a line"]), ("wiki_3", ["other words that make a line"])]
    with pytest.raises(ValueError):
        reading.load_articles(spark, "nope", "x")
    (tmp_path / "n.txt").write_text("".join(f"line {k}\n" for k in range(4000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        numbered = reading.numbered_lines(spark, str(tmp_path / "n.txt"))
        assert numbered.rdd.getNumPartitions() > 1 and sorted((r.line, r.value) for r in numbered.collect()) == [(k, f"line {k}") for k in range(4000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    (tmp_path / "bare").mkdir()
    with pytest.raises(FileNotFoundError, match="wrong path"):
        reading.tabular_sidecars(spark, str(tmp_path / "no"))
    assert reading.tabular_sidecars(spark, str(tmp_path / "bare")).count() == 0  # months may lack
    (tmp_path / "bare/s.jsonl").write_text('{"accession_number": "A", "is_tabular_body": true}\n')
    assert reading.tabular_sidecars(spark, str(tmp_path / "bare")).first().is_tabular_body
    (tmp_path / "codes").mkdir()
    (tmp_path / "codes/a.csv").write_text("symbol,description\n#c,x\nK,old\n")
    (tmp_path / "codes/b.csv").write_text("K,new\n")
    assert [tuple(r) for r in reading.code_dictionary(spark, str(tmp_path / "codes")).collect()] == [("K", "new")]


def test_tagged_documents(spark, tmp_path):
    doc = lambda acc, body: f'<doc>\n<djn-mdata accession-number="{acc}" />\n<text>{body}</text>\n</doc>\n'
    raw = '<?xml version="1.0"?>\n' + doc("A", "<p> caf\xe9 &amp; co </p><p>-0-</p>") + doc("B", "<pre>a  b  1\nc  d  2\ne  f  3</pre>") + "<doc><text><p>none</p></text></doc>" + doc("A", "<p>later</p><pre>x &amp; y</pre>")
    (tmp_path / "f.nml").write_bytes(raw.encode("latin-1"))
    got = reading.tagged_documents(spark, str(tmp_path / "f.nml"))
    assert [(r.accession_number, r.p_blocks, r.pre_blocks) for r in got.orderBy("first_seen").collect()] == [("A", ["café & co", "later"], ["x &amp; y"]), ("B", [], ["a  b  1\nc  d  2\ne  f  3"])]
    acc = {r.accession_number: r for r in reading.tabular_results(got).collect()}
    assert acc["B"].is_tabular_body and acc["B"].pre_tabular_tokens == 9 and acc["A"].p_tokens == 4 and acc["A"].pre_narrative_tokens == 3


def test_references(spark):
    """Decoded in the JVM as the standard library decodes them: every name, whole, cut and run on, every number that is special."""
    import html
    import random
    from html.entities import html5

    from quillspan.functions.entities import unescape_text

    rng = random.Random(1)
    texts = [form.format(n) for n in html5 for form in ("a &{} b", "&{}x")] + [f"&{n[:-1]}" for n in html5]
    texts += [f"&#{n};" for n in [*range(700), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFFFD, 0xFFFE, 0x1FFFF, 0x10FFFF, 0x110000, 10**30]] + [f"&#x{n:x}" for n in range(400)]
    texts += ["&#x0000000000041;", "&#;", "&#x;", "&", "&&amp;", "&amp;lt;", "&notit;", "&ampamp;", "", "no reference"]
    texts += ["".join(rng.choice(["&", "#", "x", "amp", "lt", ";", "not", "in", "1", "65", " ", "é", "copy", "\n", "<", "8217"]) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "k int, t string").select("k", unescape_text(F.col("t")))
    got = dict(df.collect())
    assert got.pop(-1) is None and [got[k] for k in range(len(texts))] == [html.unescape(t) for t in texts]
    assert "EvalPython" not in df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")

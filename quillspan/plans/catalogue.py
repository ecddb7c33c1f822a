"""Queries by name over a folder of tables, with the SQL that each is held against."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import ladder, tabular, textcols
from quillspan.operators import mapper, scoring, sinks, universe
from quillspan.operators.store import Store, beside, scratch_folder
from quillspan.plans import oracle
from quillspan.sources import corpus, dimensions, reading
from quillspan.sources.reading import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, source, headline, paragraphs, filtered_reasons) of the documents."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "source", "text")
    bars = F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit("")))
    reasons = F.array_compact(F.array(F.when(F.length("text") < 200, "short"), F.when(bars > 10, "pipe_table")))
    d = d.select("article_id", "source", F.substring_index("text", "\n", 1).alias("headline"), textcols.paragraphs(F.col("text")).alias("paragraphs"), reasons.alias("filtered_reasons"))
    return d


def groups(spark: SparkSession, mapper: bool = True) -> DataFrame:
    found = universe.to_frame(spark, universe.FIXTURE)
    return universe.mapper_view(found) if mapper else found


def open_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).where(F.size("filtered_reasons") == 0)


def _joined(xs: Column, by: str = ",") -> Column:
    return F.array_join(F.transform(xs, lambda x: x.cast("string")), by)


@query(oracle.CLEAN)
def clean_web_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", textcols.clean_web_text(F.col("text")).alias("cleaned"))


@query(oracle.SPLIT)
def split_paragraphs(spark, sf_dir):
    return articles(spark, sf_dir).select("article_id", F.size("paragraphs").cast("long").alias("n_paragraphs"), F.sha2(F.array_join("paragraphs", "\n\n"), 256).alias("digest"))


@query(oracle.STATS)
def paragraph_stats(spark, sf_dir):
    chars = F.aggregate("paragraphs", F.lit(0).cast("long"), lambda acc, p: acc + F.length(p))
    a = articles(spark, sf_dir).select("source", F.size("paragraphs").cast("long").alias("n"), chars.alias("chars"))
    return a.groupBy("source").agg(F.count("*").alias("n_articles"), F.sum("n").alias("n_paragraphs"), F.sum("chars").alias("n_chars"), F.max("n").alias("most"))


def prepared(spark, sf_dir) -> DataFrame:
    """The lane's articles (id, ...) with the keys that their gate fires."""
    return mapper.with_fired(articles(spark, sf_dir).withColumnRenamed("article_id", "id"), groups(spark))


@query(oracle.FIRES)
def gate_fires(spark, sf_dir):
    fired = prepared(spark, sf_dir).where(F.size("filtered_reasons") == 0)
    return fired.select(F.col("id").alias("article_id"), F.array_join("fired", ",").alias("groups"))


@query(oracle.GATE_STATS)
def gate_stats(spark, sf_dir):
    is_open = F.size("filtered_reasons") == 0
    x = prepared(spark, sf_dir).agg((F.count_if(is_open) * groups(spark).count()).alias("n"), F.coalesce(F.sum(F.size("fired")), F.lit(0)).alias("calls_made"))
    skipped = F.col("n") - F.col("calls_made")
    return x.select("calls_made", skipped.alias("calls_skipped"), F.when(F.col("n") > 0, 100.0 * skipped / F.col("n")).otherwise(0.0).alias("calls_saved_pct"))


@query(oracle.UNGATED)
def cross_fanout_ungated(spark, sf_dir):
    pairs = open_articles(spark, sf_dir).select("article_id").crossJoin(F.broadcast(groups(spark).select("group_key", "asset_class")))  # a dimension of fixed size
    return pairs.groupBy("asset_class", "group_key").agg(F.count("*").alias("n_tasks"), F.sum("article_id").cast("long").alias("sum_ids"))


def asked(spark, sf_dir) -> DataFrame:
    """The mapper lane's tasks, one prompt each."""
    g = groups(spark)
    prompts = {r[0]: "Answer with one object." for r in g.select("asset_class").distinct().collect()}
    return mapper.mapper_tasks(prepared(spark, sf_dir), g, prompts)


def tasks(spark, sf_dir) -> DataFrame:
    """The lane's tasks with the keyword scorer's answers."""
    return scoring.score(asked(spark, sf_dir), scoring.keyword_backend({g["name"]: g["keywords"] for g in universe.FIXTURE.values()}))


def records(spark, sf_dir) -> DataFrame:
    """The lane's records: one for each article, screened and untagged ones too."""
    return mapper.records_of(articles(spark, sf_dir).withColumnRenamed("article_id", "id"), tasks(spark, sf_dir))


@query(oracle.PROMPT)
def render_article_prompt(spark, sf_dir):
    return asked(spark, sf_dir).select(F.col("id").alias("article_id"), "group_key", F.length("user").cast("long").alias("n_chars"), F.sha2("user", 256).alias("digest"))


@query(oracle.REASONS)
def screen_reasons(spark, sf_dir):
    return articles(spark, sf_dir).select(F.explode("filtered_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(oracle.STUB)
def stub_map(spark, sf_dir):
    return tasks(spark, sf_dir).select(F.col("id").alias("article_id"), "group_key", _joined(F.col("result.evidence_paragraphs")).alias("evidence"), "result.relevance_score", "result.relevant")


@query(oracle.RECORDS)
def mapper_records(spark, sf_dir):
    r = records(spark, sf_dir)
    key = F.create_map(*(F.lit(x) for k, g in universe.FIXTURE.items() for x in (g["name"], k)))
    assets = F.transform("assets", lambda a: F.concat(a["name"], F.lit("/"), a["ticker_symbol"]))
    shown = F.transform("mappings", lambda m: F.concat(key[m["group"]], F.lit(":"), m["asset_class"], F.lit(":"), _joined(m["evidence_paragraphs"], "+")))
    used = F.array_sort(F.transform(F.map_keys("paragraphs"), lambda k: k.cast("int")))
    return r.select(
        "article_id", "headline", _joined(F.col("filtered_reasons")).alias("reasons"), F.array_join("groups", ",").alias("groups"), F.array_join(assets, ",").alias("assets"), F.array_join(shown, ";").alias("mappings"), _joined(used).alias("evidence")
    )


@query(oracle.ROLLUP)
def mapper_rollup(spark, sf_dir):
    side = lambda d, key: F.struct(F.lit(d).alias("dimension"), key.alias("key"))
    sides = F.concat(F.transform("mappings", lambda m: side("asset_class", m["asset_class"])), F.transform("mappings", lambda m: side("group", m["group"])), F.transform("filtered_reasons", lambda r: side("reason", r)))
    return records(spark, sf_dir).select(F.explode(sides).alias("side")).groupBy("side.dimension", "side.key").agg(F.count("*").alias("n"))


@query(oracle.TOTALS)
def mapper_totals(spark, sf_dir):
    """Articles, screened ones and mappings of a run, in one pass over its records."""
    r = records(spark, sf_dir)
    return r.agg(F.count("*").alias("total_articles"), F.count_if(F.size("filtered_reasons") > 0).alias("filtered_articles"), F.coalesce(F.sum(F.size("mappings")), F.lit(0)).cast("long").alias("total_mappings"))


@query(oracle.RESULTS_OF)
def results_of_article(spark, sf_dir):
    """All verdicts on one article."""
    return self_consistency(spark, sf_dir).where("article_id = 27")


@query(oracle.MISMATCH)
def universe_mismatch(spark, sf_dir):
    """Assets without group and members that are no asset; the assets here are the members' own and one more, without one."""
    g = groups(spark, mapper=False)
    members = g.select(F.explode("members.name").alias("name"))
    known = members.where("name <> 'Ghost Index'").union(spark.createDataFrame([("Orphan Bond",)], "name string"))
    return dimensions.mismatch(known, g)


@query(oracle.EVIDENCE)
def evidence_lookup(spark, sf_dir):
    return records(spark, sf_dir).select("article_id", F.explode("paragraphs").alias("paragraph", "text"))


def labelled(spark, sf_dir) -> DataFrame:
    """Source articles for the grader: labelled documents, a row for each label, the last of an id to count."""
    label = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic", F.struct("quality", "toxic").alias("ord"))
    return label.join(articles(spark, sf_dir).withColumnRenamed("article_id", "id"), "id", "left")


def told_sources(spark, sf_dir) -> DataFrame:
    """The same, their labels and their number of paragraphs written out as the text that the label grader reads."""
    told = F.array(*(F.concat(F.lit(f"{name} "), value.cast("string")) for name, value in (("quality", F.col("quality")), ("toxic", F.col("toxic")), ("paragraphs", F.coalesce(F.size("paragraphs"), F.lit(0))))))
    return labelled(spark, sf_dir).select("id", "headline", told.alias("paragraphs"), "ord")


def label_backend():
    """Toxic articles are graded incorrect, poor ones at half the mapper's score, which is the share of the paragraphs cited."""

    def answer(user: str) -> str:
        value = {name: int(re.search(rf"^\[[0-9]\] {name} (\d+)$", user, re.MULTILINE)[1]) for name in ("quality", "toxic", "paragraphs")}
        cited = user.partition("[MAPPER_EVIDENCE]\n")[2].partition("\n")[0]
        n = 0 if cited == mapper.NO_EVIDENCE else cited.count(",") + 1
        score = n / max(value["paragraphs"], 1)
        return json.dumps({"relevance_score": score if value["quality"] == 1 else score / 2, "verdict": "incorrect" if value["toxic"] == 1 else "correct"})

    return lambda prompts: [answer(user) for _, user in prompts]


def known_groups(spark) -> DataFrame:
    return groups(spark, mapper=False).where("group_key <> 'spanish'")


def graded(spark, sf_dir, sources=told_sources) -> DataFrame:
    """The grader lane's tasks: each mapping of the mapper with its prompt, or why it is skipped."""
    return mapper.grader_tasks(records(spark, sf_dir), sources(spark, sf_dir), known_groups(spark), "Answer with one object.")


@query(oracle.GRADE_TASKS)
def grade_tasks(spark, sf_dir):
    return graded(spark, sf_dir).where("skip_reason is null").select("article_id", "group_name", "asset_class", "headline", F.col("mapper_score").alias("relevance_score"), _joined(F.col("mapper_evidence")).alias("evidence"))


@query(oracle.GRADE_SKIPS)
def grade_skips(spark, sf_dir):
    return graded(spark, sf_dir).where("skip_reason is not null").groupBy("skip_reason").agg(F.count("*").alias("n"))


def verdicts(spark, sf_dir) -> DataFrame:
    """The grader lane's rows, those that it skips too."""
    return mapper.grade(records(spark, sf_dir), told_sources(spark, sf_dir), known_groups(spark), "Answer with one object.", label_backend)


@query(oracle.SELF)
def self_consistency(spark, sf_dir):
    return verdicts(spark, sf_dir).where("skip_reason is null").select("article_id", "group_name", "verdict", "grader_score", "self_inconsistent")


@query(oracle.SIDECAR)
def grader_sidecar(spark, sf_dir):
    return verdicts(spark, sf_dir).select("article_id", "group_name", "asset_class", "verdict", "grader_score", "skip_reason")


@query(oracle.GRADER_ROLLUP)
def grader_rollup(spark, sf_dir):
    v = verdicts(spark, sf_dir).where("skip_reason is null").withColumnRenamed("group_name", "name")
    right = F.count_if(F.col("verdict") == "correct")
    counts = [F.count("*").alias("total"), right.alias("correct"), F.count_if(F.col("verdict") == "incorrect").alias("incorrect"), F.count_if("self_inconsistent").alias("self_inconsistent"), (F.lit(100.0) * right / F.count("*")).alias("pct")]
    return _by(v, *counts).withColumn("correct_pct", ladder.two_decimals("pct").cast("double")).drop("pct")


def _by(df: DataFrame, *counts: Column) -> DataFrame:
    """Counts by class and by group, in one pass over df."""
    sides = F.array(F.struct(F.lit("asset_class").alias("dimension"), F.col("asset_class").alias("key")), F.struct(F.lit("group").alias("dimension"), F.col("name").alias("key")))
    return df.withColumn("side", F.explode(sides)).groupBy("side.dimension", "side.key").agg(*counts)


@query(oracle.MESSAGE)
def grader_message(spark, sf_dir):
    """The text that a grader reads for each claim."""
    g = graded(spark, sf_dir, labelled).where("skip_reason is null")
    return g.select("article_id", "group_name", F.col("user").alias("message"))


def plain_tokens(text: Column) -> Column:
    """Runs of letters, runs of digits and other marks: a count of tokens that SQL can tell too."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]"))


@query(oracle.LENGTHS)
def length_filter(spark, sf_dir):
    """What a length filter of 120 tokens keeps and drops of each source, at one character a token: texts of up to 120 characters
    pass unmeasured, in others runs of letters, runs of digits and other marks count."""
    limit = 120
    d = table(spark, sf_dir, "documents").select("source", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("source", (F.length("text") <= limit).alias("short"), reading.measured(F.col("text"), limit, 1.0, plain_tokens).alias("kept"))
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_if("short").alias("unmeasured"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


@query(oracle.NML_P)
def nml_extract_p(spark, sf_dir):
    """Paragraph bodies of tagged pages that hold no other element, trimmed, without blanks and trailers; references stay as they are written."""
    p = F.regexp_extract_all("html", F.lit(r"(?s)<p>([^<]*)</p>"), F.lit(1))
    kept = F.filter(F.transform(p, textcols.strip), lambda x: (x != "") & ~tabular.is_trailer(x))
    return table(spark, sf_dir, "pages").select("page_id", F.size(kept).cast("long").alias("n_p"), F.sha2(F.array_join(kept, "\n"), 256).alias("digest"))


def wire_id() -> Column:
    """An id of the wire for each document: a day in one of the twelve months of a year, then the number."""
    return F.concat(F.lit("2014"), F.lpad((F.pmod("doc_id", F.lit(12)) + 1).cast("string"), 2, "0"), F.lit("01"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))


def wire_shards(spark, sf_dir) -> str:
    """A folder with the documents as twelve shards of a month."""
    folder = scratch_folder(spark, "wire")
    d = table(spark, sf_dir, "documents").select(wire_id().alias("id"), F.substring_index("text", "\n", 1).alias("headline"), F.split("text", "\n").alias("paragraphs"), "text", F.when(F.col("lang") == "de", F.array(F.lit("foreign"))).alias("filtered_reasons"))
    d.withColumn("month", reading.month_of(F.col("id"))).write.partitionBy("month").json(f"{folder}/raw")
    store = Store(spark)
    for e in store.listing(f"{folder}/raw", "month=*"):
        store.replace(e.path, f"{folder}/in/{e.name.removeprefix('month=')}_clean.jsonl")
    return folder


@query(oracle.WIRE)
def wire_screening(spark, sf_dir):
    """The documents as shards, read back as a run reads them: months from May to August, the length filter of length_filter, and
    reasons from a sidecar, here that of the order of the same number."""
    folder = wire_shards(spark, sf_dir)
    sidecar = accounted(spark, sf_dir).select(F.concat(F.lit("2014"), F.lpad((F.pmod("accession", F.lit(12)) + 1).cast("string"), 2, "0"), F.lit("01"), F.lpad(F.col("accession").cast("string"), 12, "0")).alias("accession_number"), "is_tabular_body")
    a = reading.load_articles(spark, "djnw", f"{folder}/in", start="2014-05", end="2014-08", tabular=sidecar, max_tokens=120, count_tokens=plain_tokens)
    return a.select("id", "headline", F.size("paragraphs").cast("long").alias("n_paragraphs"), _joined(F.col("filtered_reasons")).alias("reasons"))


@query(oracle.RESUME)
def resume_plan(spark, sf_dir):
    """What a rerun over the shards has to do once the first three months are committed and a fourth was killed before its summary."""
    folder = wire_shards(spark, sf_dir)
    store = Store(spark)
    for month in ("2014-01", "2014-02", "2014-03", "2014-04"):
        articles = reading.load_articles(spark, "djnw", f"{folder}/in/{month}_clean.jsonl")
        sinks.write_run(articles.select("id", "headline"), f"{folder}/out/{month}.jsonl", lambda rows: {"n": rows.count()})
    store.delete(beside(f"{folder}/out/2014-04.jsonl", "summary"))
    return sinks.shard_plan(spark, f"{folder}/in", f"{folder}/out", "2014-0*").select("shard", "status")


@query(oracle.RUN)
def run_summary(spark, sf_dir):
    """A mapper run, committed, by the summary that stands beside its records."""
    out = f"{scratch_folder(spark, 'run')}/documents.jsonl"
    sinks.write_run(records(spark, sf_dir), out, lambda rows: sinks.mapper_summary(rows, {}, {"keyword_gate": True}), True)
    told = json.loads(Store(spark).read(beside(out, "summary")))
    rows = [(field, key, n) for field, by in told.items() if field not in ("run", "gate") for key, n in (by.items() if isinstance(by, dict) else [("", by)])]
    return spark.createDataFrame(rows, "field string, key string, n long")  # a row for each reason, class and group


@query(oracle.GRADED)
def grading_summary(spark, sf_dir):
    """A grader run, committed, by the summary that stands beside its verdicts."""
    out = f"{scratch_folder(spark, 'graded')}/documents.jsonl"
    sinks.write_run(verdicts(spark, sf_dir), out, lambda rows: sinks.grader_summary(rows, {}))
    told = json.loads(Store(spark).read(beside(out, "summary")))
    rows = [("total", field, told[field], None) for field in ("total_mappings", "graded", "correct", "incorrect", "self_inconsistent", "skipped")]
    rows += [("skip", reason, n, None) for reason, n in told["skip_reasons"].items()]
    rows += [(side, key, x["total"], x["correct_pct"]) for side in ("by_asset_class", "by_group") for key, x in told[side].items()]
    return spark.createDataFrame(rows, "field string, key string, n long, correct_pct double")


@query(oracle.WIKI)
def wiki_lines(spark, sf_dir):
    """The documents as a line file, read back: cleaned, cut into paragraphs, numbered by line where they have no page id."""
    folder = scratch_folder(spark, "wiki")
    d = table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("p"), F.col("doc_id").cast("string"))).alias("page_id"), F.col("source").alias("domain"))
    d.orderBy("doc_id").drop("doc_id").write.json(f"{folder}/lines.jsonl")
    a = reading.load_articles(spark, "wikigaming", f"{folder}/lines.jsonl")
    return a.select("id", "headline", "domain", F.size("paragraphs").cast("long").alias("n_paragraphs"), F.sha2(F.array_join("paragraphs", "\n\n"), 256).alias("digest"))


@query(oracle.CORPUS)
def corpus_lookup(spark, sf_dir):
    """Articles of the month corpus by id, through the index of its files; one of the ids is of no article."""
    folder = scratch_folder(spark, "corpus")
    corpus.write_corpus(table(spark, sf_dir, "documents").select(wire_id().alias("id"), F.substring_index("text", "\n", 1).alias("headline"), "source"), folder)
    corpus.write_index(spark, folder)
    found = None
    for n in (5, 27, 123, 10**11):
        one = corpus.find_article(spark, folder, f"2014{n % 12 + 1:02d}01{n:012d}").select("id", "headline", "source", "month")
        found = one if found is None else found.unionByName(one)
    return found


@query(oracle.NML_DOCUMENTS)
def nml_documents(spark, sf_dir):
    """Tagged pages by the newswire reader's own rules: <p> bodies decoded, trimmed, without blanks and trailers, <pre> bodies verbatim."""
    d = table(spark, sf_dir, "pages").select("page_id", reading.paragraph_bodies(F.col("html")).alias("p"), reading.bodies(F.col("html"), "pre").alias("pre"))
    return d.select("page_id", F.size("p").cast("long").alias("n_p"), F.size("pre").cast("long").alias("n_pre"), F.sha2(F.array_join("p", "\n"), 256).alias("digest"))


@query(oracle.NML_MERGE)
def nml_merge_docs(spark, sf_dir):
    """Documents of one accession number merge in document order, wherever they stand; here the accession is a page's host part."""
    d = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "//([^/?#]*)", 1).alias("accession"), "page_id", F.regexp_extract_all("html", F.lit(r"(?s)<p>([^<]*)</p>"), F.lit(1)).alias("p"))
    merged = d.groupBy("accession").agg(F.min("page_id").alias("first_seen"), F.array_sort(F.collect_list(F.struct("page_id", "p"))).alias("xs"))
    flat = F.flatten(F.transform("xs", lambda x: x["p"]))
    return merged.select("accession", "first_seen", F.size(flat).cast("long").alias("n_p"), F.sha2(F.array_join(flat, "\n"), 256).alias("digest"))


def rendered_blocks(spark, sf_dir) -> DataFrame:
    """(accession, block): an order's lines as a preformatted table; returned lines are told in prose."""
    cells = F.concat(F.rpad(F.col("l_linenumber").cast("string"), 4, " "), F.lpad(F.col("l_partkey").cast("string"), 9, " "), F.lpad(F.col("l_quantity").cast("long").cast("string"), 6, " "), F.lit("  "), "l_linestatus")
    line = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("line "), F.col("l_linenumber").cast("string"), F.lit(" came back from the customer in good order"))).otherwise(cells)
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("accession"), F.struct("l_linenumber", "l_partkey", line.alias("line")).alias("x"))
    return x.groupBy("accession").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("accession", F.array_join(F.transform("xs", lambda x: x["line"]), "\n").alias("block"))


def classified(spark, sf_dir) -> DataFrame:
    return rendered_blocks(spark, sf_dir).select("accession", tabular.classify_block(F.col("block")).alias("lines"))


@query(oracle.LINES)
def tabular_lines(spark, sf_dir):
    flags = F.array_join(F.transform("lines", lambda x: F.when(x["is_tabular"], "T").otherwise("N")), "")
    return classified(spark, sf_dir).select("accession", flags.alias("flags"), _joined(F.transform("lines", lambda x: x["n_tokens"])).alias("n_tokens"))


def accounted(spark, sf_dir) -> DataFrame:
    tokens = lambda flag: F.aggregate(F.filter("lines", lambda x: x["is_tabular"] == flag), F.lit(0).cast("long"), lambda acc, x: acc + x["n_tokens"])
    c = classified(spark, sf_dir).select("accession", tokens(True).alias("pre_tabular_tokens"), tokens(False).alias("pre_narrative_tokens"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("accession"), F.size(F.split("o_orderpriority", "-")).cast("long").alias("p_tokens"))
    c = c.join(orders, "accession", "left").withColumn("p_tokens", F.coalesce("p_tokens", F.lit(0)))
    body = tabular.is_tabular_body(F.col("p_tokens"), F.col("pre_tabular_tokens"), F.col("pre_narrative_tokens"))
    total = F.col("pre_tabular_tokens") + F.col("pre_narrative_tokens")
    return c.select("accession", "p_tokens", "pre_tabular_tokens", "pre_narrative_tokens", body.alias("is_tabular_body"), F.when(total > 0, F.col("pre_tabular_tokens") / total).otherwise(0.0).alias("pre_aligned_pct"))


@query(oracle.ACCOUNTING)
def tabular_accounting(spark, sf_dir):
    return accounted(spark, sf_dir)


@query(oracle.TABULAR_JOIN)
def tabular_join(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"))
    t = accounted(spark, sf_dir).select(F.col("accession").alias("article_id"), "is_tabular_body")
    return a.join(t, "article_id", "left").select("article_id", F.when(F.coalesce("is_tabular_body", F.lit(False)), "tabular_body").otherwise("").alias("reason"))


@query(oracle.LADDER)
def json_ladder(spark, sf_dir):
    """A scorer's answers in several states of repair, read by the ladder."""
    e = table(spark, sf_dir, "events").select("event_id", "value", "props")
    k = F.pmod("event_id", F.lit(5))
    body = F.concat(F.lit('{"evidence_paragraphs": ["1", 2.0], "relevance_score": "'), F.col("value").cast("string"), F.lit('", "relevant": "true"}'))
    raw = F.when(k == 0, body).when(k == 1, F.concat(F.lit("I think: "), body, F.lit(" done"))).when(k == 2, F.expr("substring(props, 1, 4)")).when(k == 3, "{}").otherwise('{"evidence_paragraphs": ["a"], "relevant": true}')
    return e.select("event_id", ladder.parse_mapper(raw).alias("r")).select("event_id", _joined(F.col("r.evidence_paragraphs")).alias("evidence"), "r.relevance_score", "r.relevant")


@query(oracle.GRADER_LADDER)
def grader_ladder(spark, sf_dir):
    """A grader's answers: verdicts of two kinds, one that isn't known, scores as texts and flags, and texts around them."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    k = F.pmod("event_id", F.lit(6))
    of = lambda verdict, score: F.concat(F.lit('{"evidence_paragraphs": ['), F.col("user_id").cast("string"), F.lit(f', true], "relevance_score": {score}, "verdict": "{verdict}"}}'))
    half = F.concat(F.lit('Verdict {incorrect}? '), of("incorrect", 0.5))
    raw = F.when(k == 0, of("incorrect", '" 0.25 "')).when(k == 1, F.concat(F.lit("```json\n"), of("incorrect", "true"), F.lit("\n```"))).when(k == 2, of("borderline", 1)).when(k == 3, half).when(k == 4, of("correct", "1e-1"))
    return e.select("event_id", ladder.parse_grader(raw).alias("r")).select("event_id", _joined(F.col("r.evidence_paragraphs")).alias("evidence"), "r.relevance_score", "r.verdict")


@query(oracle.EXPLODE)
def universe_explode(spark, sf_dir):
    return groups(spark, mapper=False).select("group_key", F.col("name").alias("group_name"), "asset_class", F.explode("members").alias("m")).select("group_key", "group_name", "asset_class", F.col("m.name").alias("asset"), "m.ticker_symbol", "m.short_name")


@query(oracle.INTEGRITY)
def universe_integrity(spark, sf_dir):
    g = groups(spark, mapper=False)
    sizes = g.select(F.size("members").alias("n"), "asset_class")
    return sizes.agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_members"), F.count_if(F.col("n") == 1).alias("n_singletons"), F.countDistinct("asset_class").alias("n_classes"), F.count_if(F.col("asset_class") != universe.EXCLUDED).alias("n_mapper_groups"))


@query(oracle.LISTING)
def asset_listing(spark, sf_dir):
    m = universe_explode(spark, sf_dir).select("asset_class", F.concat("ticker_symbol", F.lit(" ("), "asset", F.lit(")")).alias("shown"))
    return m.groupBy("asset_class").agg(F.array_join(F.array_sort(F.collect_list("shown")), ", ").alias("listing"))


@query(oracle.CODES)
def code_lookup(spark, sf_dir):
    codes = spark.createDataFrame([("src0", "old wire", 0), ("src0", "main wire", 1), ("src1", "market desk", 0), ("#src2", "comment", 0)], "code string, description string, ord int").where("code not like '#%'")
    last = codes.withColumn("rn", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("ord")))).where("rn = 1").select("code", "description")
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("code")).join(F.broadcast(last), "code", "left")
    return d.groupBy("code", F.coalesce("description", F.lit("??? (undocumented)")).alias("description")).agg(F.count("*").alias("n"))


@query(oracle.LIMIT_BEFORE)
def limit_before_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").orderBy("doc_id").limit(100).where("lang = 'en'").select("doc_id", "source")


@query(oracle.LIMIT_AFTER)
def limit_after_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'en'").orderBy("doc_id").limit(100).select("doc_id", "source")


@query(oracle.LAST_WINS)
def last_wins_dedup(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    last = c.groupBy("conv_id").agg(F.max(F.struct("turn", "role", "text")).alias("x"))
    return last.select("conv_id", "x.turn", "x.role", F.sha2("x.text", 256).alias("digest"))


@query(oracle.PAIRS)
def conversation_pairs(spark, sf_dir):
    system = F.lit("Answer with one object.")
    pair = lambda u: F.to_json(F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), u.alias("content"))))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.length(pair(F.col("text"))).cast("long").alias("n_chars"), pair(F.col("text")).alias("messages"))


@query(oracle.PENDING)
def pending_shards(spark, sf_dir):
    """Shards that aren't done: done needs both the rows (an English document) and the summary (a toxic-free label)."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    shards = d.select("source").distinct()
    rows = d.where("lang = 'en'").select("source").distinct()
    summary = d.join(lab.where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("source").distinct()
    done = rows.join(summary, "source", "left_semi")
    pending = shards.join(done, "source", "left_anti")
    return pending.select("source", F.lit("pending").alias("status")).unionByName(done.select("source", F.lit("done").alias("status")))


@query(oracle.LOOKUP)
def point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_id = 42").select("event_id", "user_id", "event_type", "value")


@query(oracle.FINGERPRINT)
def corpus_fingerprint(spark, sf_dir):
    """Articles that survive, calls made, and one digest over the digests of all prompts in order.

    A tree folds them, 4,096 consecutive articles a node and as many nodes a level above, so no task sees the corpus.
    """
    p = render_article_prompt(spark, sf_dir)
    fold = lambda key, order: p.groupBy(key.alias("id")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "digest"))), lambda x: x["digest"]), ""), 256).alias("digest"), F.sum("calls").alias("calls"))
    p = p.withColumn("calls", F.lit(1).cast("long"))
    p = fold(F.col("article_id"), "group_key")
    for _ in range(5):  # 4,096 to the fifth covers all but the top bits of an id
        p = fold(F.shiftright("id", 12), "id")
    whole = p.agg(F.sum("calls").alias("calls"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "digest"))), lambda x: x["digest"]), "").alias("digests"))
    surviving = open_articles(spark, sf_dir).agg(F.count("*").alias("surviving"))
    return surviving.crossJoin(whole).select("surviving", F.coalesce("calls", F.lit(0)).alias("calls"), F.substring(F.sha2("digests", 256), 1, 16).alias("digest"))  # two single rows

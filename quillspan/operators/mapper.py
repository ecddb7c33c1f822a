"""The lanes end to end: articles to tags with a scorer, tags to verdicts with a grader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import ladder, textcols
from quillspan.operators import gate, scoring

CORRECT_GAP, INCORRECT_GAP = 0.40, 0.15
# The block that tells a grader what the mapper claims.
CLAIM = ("\n\n[MAPPER_CLAIM]\nAsset group: ", "\nAsset class: ", "\nMembers: ", "\nMapper relevance score: ", "\n[/MAPPER_CLAIM]\n\n[MAPPER_EVIDENCE]\n", "\n[/MAPPER_EVIDENCE]")
NO_MEMBERS, NO_EVIDENCE = "(no members listed)", "(none — mapper tagged on overall topic alone)"


def claim_block(group: Column, asset_class: Column, members: Column, score: Column, evidence: Column) -> Column:
    """members: names; evidence: paragraph numbers."""
    shown = F.when(F.size(members) > 0, F.array_join(members, ", ")).otherwise(NO_MEMBERS)
    cited = F.when(F.size(evidence) > 0, F.array_join(F.transform(evidence, lambda i: i.cast("string")), ", ")).otherwise(NO_EVIDENCE)
    parts = [group, asset_class, shown, ladder.two_decimals(score), cited]
    return F.concat(*(x for mark, part in zip(CLAIM, [*parts, None], strict=True) for x in (F.lit(mark), part) if x is not None))


def with_fired(articles: DataFrame, groups: DataFrame, gated: bool = True) -> DataFrame:
    """articles with `fired`, the keys of the groups to ask about: none for screened articles, all of them without the gate."""
    is_open = F.size(F.coalesce("filtered_reasons", F.array())) == 0
    none = F.array().cast("array<string>")
    if gated:
        keys = gate.fired(textcols.gate_text(F.col("headline"), F.col("paragraphs")), groups)
    else:
        keys = F.array(*(F.lit(r[0]) for r in groups.select("group_key").orderBy("group_key").collect()))  # the universe has a fixed size
    return articles.withColumn("fired", F.when(is_open, keys).otherwise(none))


def gate_counts(prepared: DataFrame, groups: DataFrame, keyword_gate: bool) -> tuple[int, dict]:
    """(articles, what a summary tells of the gate) of articles with `fired`, in one pass."""
    is_open = F.size(F.coalesce("filtered_reasons", F.array())) == 0
    n, tried, made = prepared.agg(F.count("*"), F.count_if(is_open), F.coalesce(F.sum(F.size("fired")), F.lit(0))).first()
    attempted = tried * groups.count()
    skipped = attempted - made
    return n, {"keyword_gate": keyword_gate, "calls_made": made, "calls_skipped": skipped, "calls_saved_pct": 100.0 * skipped / attempted if attempted else 0.0}


def mapper_tasks(articles: DataFrame, groups: DataFrame, prompts: dict[str, str], gated: bool = True) -> DataFrame:
    """(id, group_key, ..., system, user) of the articles that aren't screened; classes without prompt raise ValueError.

    Each task carries its article's row through the gate: the article is neither computed again nor joined back. Articles that have
    `fired` already aren't gated again.
    """
    spark = articles.sparkSession
    classes = {r[0] for r in groups.select("asset_class").distinct().collect()}
    if classes - set(prompts):
        raise ValueError(f"classes without prompt: {sorted(classes - set(prompts))}")
    a = articles if "fired" in articles.columns else with_fired(articles, groups, gated)
    # explode_outer: for explode the optimiser would filter by the array's size at the scan, and so compute paragraphs and gate twice
    t = a.withColumn("group_key", F.explode_outer("fired")).drop("fired").where("group_key is not null")
    system = spark.createDataFrame(sorted(prompts.items()), "asset_class string, system string")
    dim = groups.select("group_key", "name", "asset_class", "members", textcols.group_label(F.col("name"), F.col("asset_class"), F.col("members")).alias("label"))
    t = t.join(F.broadcast(dim.join(F.broadcast(system), "asset_class")), "group_key")  # dimensions of fixed size
    return t.withColumn("user", textcols.mapper_prompt(textcols.article_block(F.coalesce("headline", F.lit("")), F.col("paragraphs")), F.col("label")))


def run_mapper(articles: DataFrame, groups: DataFrame, prompts: dict[str, str], make_backend, gated: bool = True) -> DataFrame:
    """A record for each article, screened and untagged ones too, with its url where articles have one. Evidence beyond the
    article is left out of `paragraphs`; a negative one counts from the end."""
    return records_of(articles.drop("fired"), scoring.score(mapper_tasks(articles, groups, prompts, gated), make_backend))


def records_of(articles: DataFrame, scored: DataFrame) -> DataFrame:
    """The records of articles and their scored tasks; keys outside the schema, of articles that have them as `extra`, go along."""
    scored = scored.where("result.relevant")
    mapping = F.struct(F.col("group_key"), F.col("name").alias("group"), "asset_class", "members", F.col("result.relevance_score").alias("relevance_score"), F.col("result.evidence_paragraphs").alias("evidence_paragraphs"))
    per = scored.groupBy("id").agg(F.array_sort(F.collect_list(mapping)).alias("tagged"))
    kind = per.schema["tagged"].dataType
    r = articles.join(per, "id", "left").withColumn("tagged", F.coalesce("tagged", F.array().cast(kind)))
    more = [F.nullif("url", F.lit("")).alias("url")] if "url" in articles.columns else []
    more += [F.when(F.size("extra") > 0, F.col("extra")).alias("extra")] if "extra" in articles.columns else []
    used = F.array_sort(F.array_distinct(F.flatten(F.transform("tagged", lambda x: x["evidence_paragraphs"]))))
    cited = F.filter(used, lambda i: i < F.size("paragraphs"))
    return r.select(
        F.col("id").alias("article_id"), "headline", F.coalesce("filtered_reasons", F.array().cast("array<string>")).alias("filtered_reasons"),
        F.transform("tagged", lambda x: x["group"]).alias("groups"),
        F.flatten(F.transform("tagged", lambda x: F.transform(x["members"], lambda m: F.struct(m["name"].alias("name"), m["ticker_symbol"].alias("ticker_symbol"))))).alias("assets"),
        F.map_from_entries(F.transform(cited, lambda i: F.struct(i.cast("string"), F.element_at("paragraphs", F.when(i >= 0, i + 1).otherwise(i))))).alias("paragraphs"),
        F.transform("tagged", lambda x: F.struct(x["group"].alias("group"), x["asset_class"].alias("asset_class"), x["relevance_score"].alias("relevance_score"), x["evidence_paragraphs"].alias("evidence_paragraphs"))).alias("mappings"),
        *more,
    )


def last_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key: the last in `order`."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return df.withColumn("last_rank", rank).where("last_rank = 1").drop("last_rank")


def grader_tasks(records: DataFrame, sources: DataFrame, groups: DataFrame, system: str) -> DataFrame:
    """A row for each mapping: (article_id, group_name, asset_class, mapper_score, mapper_evidence, headline, skip_reason, system, user).

    Those without source article, or else without group, have a skip_reason and no prompt. Of several source rows of an id the last
    counts, by `ord` if there is one; of groups of one name that of the last key.
    """
    m = records.select("article_id", F.col("headline").alias("own_headline"), F.explode("mappings").alias("m")).select("article_id", "own_headline", F.col("m.group").alias("group_name"), F.col("m.asset_class").alias("asset_class"), F.col("m.relevance_score").alias("mapper_score"), F.col("m.evidence_paragraphs").alias("mapper_evidence"))
    place = F.col("ord") if "ord" in sources.columns else F.monotonically_increasing_id()
    src = last_wins(sources.select(F.col("id").alias("article_id"), F.col("headline").alias("source_headline"), F.coalesce("paragraphs", F.array().cast("array<string>")).alias("paragraphs"), place.alias("source_ord"), F.lit(True).alias("in_source")), "article_id", "source_ord")
    known = last_wins(groups.select("group_key", "name", "members"), "name", "group_key").select(F.col("name").alias("group_name"), F.transform("members", lambda x: x["name"]).alias("member_names"))
    t = m.join(src, "article_id", "left").join(F.broadcast(known), "group_name", "left")
    t = t.withColumn("skip_reason", F.when(F.col("in_source").isNull(), "article_not_in_source").when(F.col("member_names").isNull(), "group_not_in_universe"))
    headline = F.coalesce(F.nullif(F.col("own_headline"), F.lit("")), "source_headline", F.lit(""))
    claim = claim_block(F.col("group_name"), F.col("asset_class"), F.col("member_names"), F.col("mapper_score"), F.col("mapper_evidence"))
    user = F.when(F.col("skip_reason").isNull(), F.concat(textcols.article_block(headline, F.col("paragraphs")), claim))
    return t.select("article_id", "group_name", "asset_class", "mapper_score", "mapper_evidence", headline.alias("headline"), "skip_reason", F.lit(system).alias("system"), user.alias("user"))


def grade(records: DataFrame, sources: DataFrame, groups: DataFrame, system: str, make_backend) -> DataFrame:
    """Verdicts on every mapping, graded ones first; those that grader_tasks skips come after them with the reason."""
    t = grader_tasks(records, sources, groups, system)
    done = scoring.score(t.where("skip_reason is null").drop("headline"), make_backend, ladder.parse_grader)
    keep = ["article_id", "group_name", "asset_class", "mapper_score", "mapper_evidence"]
    verdict, score = F.col("result.verdict"), F.col("result.relevance_score")
    gap = F.abs(F.col("mapper_score") - score)
    flag = F.when(verdict == "correct", gap > CORRECT_GAP).otherwise(gap < INCORRECT_GAP)
    done = done.select(*keep, score.alias("grader_score"), F.col("result.evidence_paragraphs").alias("grader_evidence"), verdict.alias("verdict"), flag.alias("self_inconsistent"), "skip_reason")
    skipped = t.where("skip_reason is not null").select(*keep, F.lit(None).cast("double").alias("grader_score"), F.array().cast("array<int>").alias("grader_evidence"), F.lit("skipped").alias("verdict"), F.lit(False).alias("self_inconsistent"), "skip_reason")
    return done.unionByName(skipped)  # a union keeps its sides' order, so what is graded is written before what is skipped

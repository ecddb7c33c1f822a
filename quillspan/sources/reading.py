"""Reading tables and article files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import textcols

ARTICLE = "id string, headline string, paragraphs array<string>, filtered_reasons array<string>, url string, date string, source string, sport string, domain string, text string"
SHARD = "*_clean.jsonl"
SIDECAR = "accession_number string, p_tokens long, pre_tabular_tokens long, pre_narrative_tokens long, is_tabular_body boolean"
WEB = "title string, text string, date string, source string, sport string, url string, page_id string, domain string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table, dealt anew if its scan has fewer tasks than the cluster has cores: few large row groups would idle the rest."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def json_articles(reader: DataFrameReader, path: str | list[str], open_records: bool = False) -> DataFrame:
    """Articles of JSON files. Open records keep the keys that the schema doesn't know, in `extra`, as variants of whatever kind they have."""
    if not open_records:
        return reader.schema(ARTICLE).json(path)
    known = [tuple(f.strip().split(" ", 1)) for f in ARTICLE.split(",")]
    extra = F.map_filter(F.try_variant_get("record", "$", "map<string, variant>"), lambda k, _: ~k.isin(*(name for name, _ in known)))
    df = reader.option("singleVariantColumn", "record").json(path)
    return df.select(*(F.try_variant_get("record", f"$.{name}", kind).alias(name) for name, kind in known), extra.alias("extra"), "_metadata")


def extra_value(path: str, kind: str = "string", extra: str = "extra") -> Column:
    """A value among an open record's unknown keys, such as codes.subject[0]; null if there is none of that kind."""
    key, _, rest = path.partition(".")
    name, bracket, more = key.partition("[")
    return F.try_variant_get(F.try_element_at(extra, F.lit(name)), "$" + bracket + more + ("." + rest if rest else ""), kind)


def gold_articles(spark: SparkSession, folder: str, open_records: bool = False) -> DataFrame:
    """One article a file, gold_*.json, in the order of paths (`ord`); FileNotFoundError without files."""
    df = json_articles(spark.read.option("multiLine", True).option("pathGlobFilter", "gold_*.json"), folder, open_records)
    if not df.inputFiles():
        raise FileNotFoundError(f"no gold_*.json in {folder}")
    return df.withColumn("ord", F.col("_metadata.file_path")).drop("_metadata")


def measured(text: Column, max_tokens: int, chars_per_token: float, count_tokens) -> Column:
    """Whether a text has at most max_tokens tokens. Short texts pass unmeasured; only long ones reach count_tokens, a column
    function: for the others it gets null, which costs its worker nothing."""
    limit = int(max_tokens * chars_per_token)
    return (F.length(text) <= limit) | (count_tokens(F.when(F.length(text) > limit, text)) <= max_tokens)


def within_tokens(df: DataFrame, max_tokens: int | None, chars_per_token: float, count_tokens=None, text: Column | None = None) -> DataFrame:
    """Rows whose text, a column of that name unless told otherwise, has at most max_tokens tokens; null texts count as empty.

    Without count_tokens a long text raises ValueError.
    """
    if max_tokens is None:
        return df
    text = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    if count_tokens is not None:
        return df.where(measured(text, max_tokens, chars_per_token, count_tokens))
    long = F.length(text) > int(max_tokens * chars_per_token)
    if df.where(long).limit(1).count():
        raise ValueError("texts beyond the unmeasured length need a tokenizer")
    return df.where(~long)


def sports_articles(spark: SparkSession, folder: str, year: str | None = None, max_articles: int | None = None, max_tokens: int | None = None, chars_per_token: float = 2.0, count_tokens=None) -> DataFrame:
    """Web articles, one JSON file each; max_articles counts files in path order, before any filter. Articles without paragraphs go."""
    reader = spark.read.schema(WEB).option("multiLine", True).option("pathGlobFilter", "*.json")
    df = (reader.json(f"{folder}/{year}") if year else reader.option("recursiveFileLookup", True).json(folder)).withColumn("path", F.col("_metadata.file_path"))
    df = df.where(~F.col("path").endswith("/summary.json"))
    if max_articles is not None:
        df = df.orderBy("path").limit(max_articles)
    df = within_tokens(df.withColumn("text", textcols.clean_web_text(F.coalesce("text", F.lit("")))), max_tokens, chars_per_token, count_tokens)
    shown = lambda c: F.coalesce(c, F.lit("")).alias(c)
    df = df.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("id"), F.coalesce("title", F.lit("")).alias("headline"), textcols.paragraphs(F.col("text")).alias("paragraphs"), shown("date"), shown("source"), shown("sport"), shown("url"))
    return df.where(F.size("paragraphs") > 0)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of text files, numbered from 0 in the order of paths. Splits are counted first, a row each, so that no task reads a whole file."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"))
    splits = raw.groupBy("file", "at").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.sum("n").over(Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1))  # a row for each split
    offsets = splits.select("file", "at", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("offset"))
    return raw.join(F.broadcast(offsets), ["file", "at"]).select((F.col("row") + F.col("offset")).alias("line"), "value")


def tabular_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the tabular lane's output. FileNotFoundError if there is no such folder, for with a wrong path no article would be
    screened; a folder that lacks some months, or all, screens nothing of them."""
    try:
        return spark.read.schema(SIDECAR).option("recursiveFileLookup", True).json(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no sidecars in {folder}: a wrong path") from e


def wiki_articles(spark: SparkSession, path: str, max_articles: int | None = None) -> DataFrame:
    """JSON lines; ids are wiki_ and page_id or line number; max_articles counts articles that are kept."""
    raw = numbered_lines(spark, path).where("trim(value) <> ''")
    df = raw.select("line", F.from_json("value", WEB).alias("x")).select("line", "x.*")
    df = df.select("line", F.concat(F.lit("wiki_"), F.coalesce("page_id", F.col("line").cast("string"))).alias("id"), F.coalesce("title", F.lit("")).alias("headline"), textcols.paragraphs(textcols.clean_web_text(F.coalesce("text", F.lit("")))).alias("paragraphs"), F.lit("wikipedia").alias("source"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("domain", F.lit("")).alias("domain")).where(F.size("paragraphs") > 0)
    return df.orderBy("line").limit(max_articles) if max_articles is not None else df


def month_of(name: Column) -> Column:
    """YYYY-MM of a shard's name or an id, whose digits may have a dash between year and month."""
    return F.regexp_replace(F.regexp_extract(name, r"^(\d{4}-?\d{2})", 1), r"^(\d{4})(\d{2})$", "$1-$2")


def wire_shards(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> list[str]:
    """The shards of a folder whose month lies within the bounds, both included, by name; or the one file that path is.

    A listing of names: shards of other months are never opened. FileNotFoundError if nothing is left.
    """
    from quillspan.operators.store import Store

    store = Store(spark)
    found = store.listing(path, SHARD) if not path.endswith(".jsonl") else []
    if not found:
        if not store.exists(path):
            raise FileNotFoundError(f"no shards at {path}")
        return [path]
    kept = [e.path for e in found if (start is None or e.name[:7] >= start) and (end is None or e.name[:7] <= end)]
    if not kept:
        raise FileNotFoundError(f"no shards from {start} to {end} in {path}")
    return kept


def screened(df: DataFrame, tabular: DataFrame | None, denied: DataFrame | None = None) -> DataFrame:
    """Articles with more reasons among their own: `tabular_body` if the sidecar says so, and those of a list (id, reason), sorted.

    They stay, each once however often a list names it, and no reason comes twice.
    """
    none = F.array().cast("array<string>")
    reasons = F.coalesce("filtered_reasons", none)
    lists = [tabular.where("is_tabular_body").select(F.col("accession_number").alias("named_id"), F.lit("tabular_body").alias("reason"))] if tabular is not None else []
    lists += [denied.select(F.col("id").alias("named_id"), F.coalesce("reason", F.lit("denylist")).alias("reason"))] if denied is not None else []
    if not lists:
        return df.withColumn("filtered_reasons", reasons)
    named = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
    named = named.groupBy("named_id").agg(F.array_sort(F.collect_set("reason")).alias("more"))
    df = df.join(named, F.col("id") == F.col("named_id"), "left")
    return df.withColumn("filtered_reasons", F.array_union(reasons, F.coalesce("more", none))).drop("named_id", "more")


def deny_list(spark: SparkSession, path: str) -> DataFrame:
    """(id, reason) of JSON lines that name articles to screen; without a reason it is `denylist`."""
    return spark.read.schema("id string, reason string").json(path).where("id is not null")


def wire_articles(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, tabular: DataFrame | None = None, max_articles: int | None = None, seed: int | None = None, max_tokens: int | None = None, chars_per_token: float = 1.0, count_tokens=None, open_records: bool = False, denied: DataFrame | None = None) -> DataFrame:
    """Wire shards, a file or a folder of months, as far as their contract is known.

    Shards outside the months' bounds aren't read. Articles whose raw text, or where there is none their paragraphs, is beyond
    max_tokens go; screened ones stay with their reasons, tabular bodies by a join with the sidecar. max_articles are the first ones
    by shard and line, or with a seed a sample.
    """
    shards = wire_shards(spark, path, start, end)
    df = json_articles(spark.read, shards, open_records)
    if shards == [path]:  # one file, or a folder whose files don't tell their month
        month = month_of(F.col("id"))
        df = df.where(month >= start) if start else df
        df = df.where(month <= end) if end else df
    df = df.withColumn("ord", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"))).drop("_metadata")
    df = within_tokens(df, max_tokens, chars_per_token, count_tokens, F.coalesce("text", F.array_join("paragraphs", "\n")))
    if max_articles is not None:
        df = df.orderBy(F.rand(seed) if seed is not None else F.col("ord")).limit(max_articles)
    return screened(df, tabular, denied)


SOURCES = {"gold": gold_articles, "sports": sports_articles, "wikigaming": wiki_articles, "djnw": wire_articles}
# What each source knows of: gold is read whole, and web articles have no months and no sidecars.
OPTIONS = {
    "gold": ("open_records",),
    "sports": ("max_articles", "max_tokens", "chars_per_token", "count_tokens"),
    "wikigaming": ("max_articles",),
    "djnw": ("start", "end", "tabular", "max_articles", "seed", "max_tokens", "chars_per_token", "count_tokens", "open_records", "denied"),
}


def load_articles(spark: SparkSession, dataset: str, path: str, **options) -> DataFrame:
    """The articles of a dataset, with filtered_reasons, which may be empty but not null. Options that a source has no use for are left out, others raise TypeError."""
    if dataset not in SOURCES:
        raise ValueError(f"unknown dataset {dataset!r}; known: {', '.join(SOURCES)}")
    if strange := set(options) - set(OPTIONS["djnw"]):
        raise TypeError(f"unknown options: {sorted(strange)}")
    df = SOURCES[dataset](spark, path, **{k: v for k, v in options.items() if k in OPTIONS[dataset]})
    none = F.array().cast("array<string>")
    return df.withColumn("filtered_reasons", F.coalesce("filtered_reasons", none) if "filtered_reasons" in df.columns else none)


def bodies(x: Column, tag: str) -> Column:
    return F.regexp_extract_all(x, F.lit(rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))


def paragraph_bodies(x: Column) -> Column:
    """The <p> bodies of a tagged document, decoded and trimmed, without blanks and trailers."""
    from quillspan.functions.entities import unescape
    from quillspan.functions.tabular import is_trailer

    return F.filter(F.transform(unescape(bodies(x, "p")), textcols.strip), lambda p: (p != "") & ~is_trailer(p))


def tagged_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(accession_number, p_blocks, pre_blocks, first_seen) of tagged newswire files in Latin-1, documents of one accession merged in order.

    Records end at </doc>. <p> bodies are decoded, trimmed and lose blanks and trailers; <pre> bodies stay as they are.
    """
    raw = spark.read.option("lineSep", "</doc>").text(path)
    raw = raw.select(F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("x"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"))
    x = F.col("x")
    d = raw.where(x.contains("<doc")).select("file", F.struct("at", "row").alias("ord"), F.regexp_extract(x, 'accession-number="([^"]*)"', 1).alias("accession_number"), paragraph_bodies(x).alias("p"), bodies(x, "pre").alias("pre")).where("accession_number <> ''")
    merged = d.groupBy("file", "accession_number").agg(F.array_sort(F.collect_list(F.struct("ord", "p", "pre"))).alias("xs"))
    flat = lambda c: F.flatten(F.transform("xs", lambda x: x[c]))
    return merged.select("file", "accession_number", flat("p").alias("p_blocks"), flat("pre").alias("pre_blocks"), F.col("xs")[0]["ord"].alias("first_seen"))


def tabular_results(documents: DataFrame) -> DataFrame:
    """The accounting of tagged documents: tokens in paragraphs, in tables and in preformatted prose, and whether the body is a table."""
    from quillspan.functions.tabular import classify_block, is_tabular_body, words

    total = lambda xs, f: F.aggregate(xs, F.lit(0), lambda acc, x: acc + f(x))
    d = documents.select("accession_number", total(F.col("p_blocks"), lambda p: F.size(words(p))).alias("p_tokens"), F.flatten(F.transform("pre_blocks", classify_block)).alias("lines"))
    tokens = lambda flag: total(F.filter("lines", lambda x: x["is_tabular"] == flag), lambda x: x["n_tokens"])
    d = d.select("accession_number", "p_tokens", tokens(True).alias("pre_tabular_tokens"), tokens(False).alias("pre_narrative_tokens"))
    return d.withColumn("is_tabular_body", is_tabular_body(F.col("p_tokens"), F.col("pre_tabular_tokens"), F.col("pre_narrative_tokens")))


def code_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """(code, description) of every *.csv in the order of names; the header and comments are no codes, later files win."""
    raw = spark.read.option("header", False).schema("code string, description string").csv(f"{folder}/*.csv").withColumn("file", F.col("_metadata.file_name")).withColumn("row", F.monotonically_increasing_id())
    raw = raw.where("code <> 'symbol' and code not like '#%'")
    return raw.groupBy("code").agg(F.max_by("description", F.struct("file", "row")).alias("description"))


def article_by_id(articles: DataFrame, article_id: str, month: Column | None = None) -> DataFrame:
    """The first article of an id; the month that the id begins with prunes partitions."""
    found = articles.where(F.col("id") == article_id)
    return (found.where(month == article_id[:6]) if month is not None else found).limit(1)

"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text becomes typed tokens: numbers (with their separators), names and units (after a number) turn into slots <num>, <name>
and <unit>, other words are lower-cased. A name is a capitalised word inside a sentence, and where such a word opens a sentence,
unless the text has it in lower case too. Windows of `window` tokens of benchmark items and documents meet in a hash join.
Documents are probed at every window first, so each that shares one with an item is hit; documents that are hit are then
aligned token by token. Slots of an alignment have to be consistent (each value of the item stands for one value of the
document and the other way round), so a question with other numbers and names is caught, while a text that merely has numbers
and names in the same places is not. A changed slot that isn't consistent parts the alignment there, and each stretch between such
slots is judged by itself: what follows a copied passage can't hide it. Items that are mostly slots say too little as templates; they are looked up as written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.common import durable, pick

# Unit words and symbols that may follow a number.
UNITS = [
    "%", "percent", "km", "m", "cm", "mm", "mile", "miles", "meter", "meters", "metre", "metres", "foot", "feet", "inch", "inches",
    "kg", "g", "mg", "gram", "grams", "pound", "pounds", "ton", "tons", "l", "ml", "liter", "liters", "litre", "litres",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "dollar", "dollars", "cent", "cents", "euro", "euros", "degree", "degrees", "celsius", "fahrenheit", "mph", "kph",
]


@dataclass(frozen=True)
class LeakPlan:
    """A document leaks an item if aligned windows cover min_run of its tokens, or all of a shorter item, between two inconsistent slots.

    Windows with fewer than min_literals tokens outside slots say too little and don't count; an item that has no others
    counts by its windows as written. Items of fewer than whole_below tokens are looked up whole, those of fewer than
    min_literals not at all. broadcast_rows bounds what may be broadcast of hashes and ids (8 bytes each), after a count, and
    token_rows what may be broadcast of the benchmark's windows with their tokens (some hundred bytes each); beyond the bounds
    the joins shuffle.
    """

    window: int = 8
    whole_below: int = 10
    min_literals: int = 4
    min_run: int = 12
    broadcast_rows: int = 1_000_000
    token_rows: int = 100_000


NAME, NUM, UNIT = "\ue000", "\ue001", "\ue002"  # private-use characters open the three kinds of slot token
MAYBE, POINT = "\ue003", "\ue004"  # before a capitalised word that opens a sentence; between digits of one number
# a capitalised word after a word, comma or bracket and one space: inside a sentence
NAMES = r"\p{Lu}(?<=[\p{L}\p{M}\p{N},;)] \p{Lu})\p{Ll}[\p{L}\p{M}]*"
OPENS = rf"(?<![\p{{L}}\p{{M}}\p{{N}}{NAME}])\p{{Lu}}(?=\p{{Ll}})"
UNITS_AFTER = rf"({NUM}[0-9{POINT}]* +)(%|(?:{'|'.join(sorted(u for u in UNITS if u != '%'))})(?![\p{{L}}\p{{N}}]))"
GAPS = rf"[^\p{{L}}\p{{M}}\p{{N}}{NAME}-{UNIT}{POINT}]+"


def tokenised(df: DataFrame, written: bool = True) -> DataFrame:
    """df with `text` replaced by dt, its typed tokens, and if `written` by ds too, the same tokens with what is written in their slots behind them.

    Null counts as empty. Replacements and splits over the whole text, so that the cost of a token stays in compiled matchers.
    Two projections, for `marked` is used three times in the second.
    """
    others = [c for c in df.columns if c != "text"]
    x = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), NAME + NUM + UNIT + MAYBE + POINT, ""), NAMES, f"{NAME}$0")
    d = df.select(*others, F.lower(F.regexp_replace(x, OPENS, f"{MAYBE}$0")).alias("marked"))
    names = F.array_except(F.regexp_extract_all("marked", F.lit(rf"{NAME}([\p{{L}}\p{{M}}]+)")), F.split("marked", rf"[^\p{{L}}\p{{M}}\p{{N}}{NAME}{MAYBE}]+"))
    x = F.regexp_replace("marked", F.concat(F.lit(f"{MAYBE}("), F.array_join(names, "|"), F.lit(r")(?![\p{L}\p{M}])")), F.lit(f"{NAME}$1"))
    x = F.regexp_replace(F.translate(x, MAYBE, ""), "(?<=[0-9])[.,](?=[0-9])", POINT)
    x = F.regexp_replace(F.regexp_replace(x, f"[0-9{POINT}]+", f" {NUM}$0 "), UNITS_AFTER, f"$1 {UNIT}$2 ")
    d = d.select(*others, x.alias("typed"))
    split = lambda t: F.array_remove(F.split(t, GAPS), "")
    dt = split(F.regexp_replace("typed", rf"([{NAME}-{UNIT}])[\p{{L}}\p{{M}}\p{{N}}{POINT}]+", "$1")).alias("dt")
    return d.select(*others, dt, split(F.col("typed")).alias("ds")) if written else d.select(*others, dt)


def _token_hashes(tokens: str) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _window_hash(hashes: Column, at: Column, size: int | Column) -> Column:
    """The hash of a window's token hashes. Hashing columns or an array of them is the same, and columns cost no copy."""
    return F.xxhash64(*(F.get(hashes, at + k) for k in range(size))) if isinstance(size, int) else F.xxhash64(F.slice(hashes, at + 1, size))


def _windows(hashes: Column, size: Column) -> Column:
    """Places and hashes of the windows of `size` tokens; null for shorter arrays.

    They are exploded with explode_outer: for explode the optimiser would infer a filter on the array's size and evaluate
    the whole tokenisation again inside it, for every window.
    """
    return F.transform(_starts(hashes, size), lambda i: F.struct(i.alias("at"), _window_hash(hashes, i, size).alias("w")))


def _hashed(hashes: Column, size: int) -> Column:
    return F.transform(_starts(hashes, F.lit(size)), lambda i: _window_hash(hashes, i, size))


def _starts(template: Column, size: Column) -> Column:
    last = F.size(template) - size
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(1)))


def _item_windows(items: DataFrame, plan: LeakPlan) -> DataFrame:
    """(item_id, n_item, size, at, w, wt, ws, literal): every window of the items that says enough, its typed and its written tokens;
    `literal` are those of items looked up as written, where wt is ws."""
    d = tokenised(items.select("item_id", "text")).withColumn("n_item", F.size("dt"))
    # inside a sentence of a document, the word that opens an item looks like a name
    opens = F.when(F.size("ds") > 0, F.concat(F.array(F.lit(NAME)), F.slice("dt", 2, F.greatest(F.size("dt"), F.lit(1)))))
    opened = F.when(F.size("ds") > 0, F.concat(F.array(F.concat(F.lit(NAME), F.col("ds")[0])), F.slice("ds", 2, F.greatest(F.size("ds"), F.lit(1)))))
    plain = F.coalesce(F.col("dt")[0].rlike(r"^\p{L}"), F.lit(False))
    ways = F.array_compact(F.array(F.struct("dt", "ds"), F.when(plain, F.struct(opens.alias("dt"), opened.alias("ds")))))
    d = d.select("item_id", "n_item", F.explode_outer(ways).alias("way")).select("item_id", "n_item", "way.dt", "way.ds")
    d = d.withColumn("size", F.when(F.col("n_item") >= plan.whole_below, plan.window).otherwise(F.col("n_item"))).where(f"size >= {plan.min_literals}")
    d = durable(d)

    def placed(tokens: str) -> DataFrame:
        hashed = d.withColumn("hashes", _token_hashes(tokens))
        return hashed.withColumn("win", F.explode_outer(_windows(F.col("hashes"), F.col("size")))).select(
            "item_id", "n_item", "size", "win.at", "win.w", F.slice(tokens, F.col("win.at") + 1, F.col("size")).alias("wt"), F.slice("ds", F.col("win.at") + 1, F.col("size")).alias("ws"), F.lit(tokens == "ds").alias("literal")
        )

    telling = placed("dt").where(F.size(F.filter("wt", lambda x: ~x.isin(NAME, NUM, UNIT))) >= plan.min_literals)
    poor = placed("ds").join(telling.select("item_id").distinct(), "item_id", "left_anti")
    return telling.unionByName(poor).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, plan: LeakPlan = LeakPlan()) -> DataFrame:
    """(doc_id, item_id, n_tokens, n_slots): documents with the items that they leak, n_tokens the item's tokens covered by the
    best stretch of an alignment, n_slots the distinct slot values that it maps.

    Null and empty texts, on either side, leak nothing. Rows without doc_id or item_id are not reported. Rows that share a
    doc_id count as one document (each text is aligned for itself), repeated rows count once. Empty tables give an empty result.
    Texts of any length are probed at every window; columns beside doc_id, item_id and text are not looked at.
    """
    d = pick(docs, doc_id="doc_id", text="text").where("doc_id is not null")
    wins = durable(_item_windows(pick(benchmark, item_id="item_id", text="text").where("item_id is not null").distinct(), plan))
    n_wins = wins.count()
    looked = sorted((r[0], r[1]) for r in wins.select("literal", "size").distinct().collect()) or [(False, plan.window)]  # at most twice whole_below of them
    hashes_of = lambda literal: F.col("hs" if literal else "ht")
    bounded = lambda x, rows: F.broadcast(x) if n_wins <= rows else x
    written = any(literal for literal, _ in looked)
    probe = tokenised(d, written).select("doc_id", _token_hashes("dt").alias("ht"), *([_token_hashes("ds").alias("hs")] if written else []))
    seen = [_hashed(hashes_of(x), n) for x, n in looked]
    probe = probe.select("doc_id", F.explode_outer(F.flatten(F.array_compact(F.array(*seen))) if len(seen) > 1 else seen[0]).alias("w"))
    hits = probe.join(bounded(wins.select("w").distinct(), plan.broadcast_rows), "w", "left_semi")
    hit_ids = durable(hits.select("doc_id").distinct())
    small = hit_ids.count() <= plan.broadcast_rows
    found = d.join(F.broadcast(hit_ids) if small else hit_ids, "doc_id", "left_semi")
    aligned = tokenised(found.distinct().withColumn("th", F.xxhash64("text"))).withColumns({"ht": _token_hashes("dt"), "hs": _token_hashes("ds")})
    sized = F.explode_outer(F.array(*(F.struct(F.lit(n).alias("size"), _windows(hashes_of(x), F.lit(n)).alias("ws")) for x, n in looked))).alias("z")
    aligned = aligned.select("doc_id", "th", "ds", sized).select("doc_id", "th", "ds", "z.size", F.explode_outer("z.ws").alias("x"))
    met = aligned.select("doc_id", "th", "size", F.col("x.at").alias("dat"), F.col("x.w").alias("w"), F.slice("ds", F.col("x.at") + 1, F.col("size")).alias("dws"))
    items = wins.select("item_id", "n_item", "size", "at", "w", "wt", "ws")
    met = met.join(bounded(items, plan.token_rows), ["w", "size"]).withColumn("diag", F.col("dat") - F.col("at"))
    cells = F.filter(F.transform(F.arrays_zip("wt", "ws", "dws"), lambda z, i: F.struct((F.col("at") + i).alias("p"), z["wt"].alias("t"), z["ws"].alias("a"), z["dws"].alias("b"))), lambda c: c["t"].isNotNull())
    tokens_met = met.select("doc_id", "th", "item_id", "n_item", "diag", F.explode_outer(cells).alias("c")).distinct()
    group = ["doc_id", "th", "item_id", "n_item", "diag"]
    tokens_met = tokens_met.repartition(*group)  # no larger than an item each; one shuffle serves all that follows
    slot = F.col("c.t").isin(NAME, NUM, UNIT)
    key = F.when(slot, F.struct("c.t", "c.a"))
    one_b = F.size(F.collect_set(F.when(slot, F.col("c.b"))).over(Window.partitionBy(*group, key)))
    one_a = F.size(F.collect_set(F.when(slot, F.col("c.a"))).over(Window.partitionBy(*group, F.when(slot, F.struct("c.t", "c.b")))))
    # a slot that is written alike on both sides is right whatever others are
    changed = slot & ~F.col("c.a").eqNullSafe(F.col("c.b"))
    judged = tokens_met.withColumn("clash", changed & ((one_b > 1) | (one_a > 1)))
    stretch = F.sum(F.col("clash").cast("int")).over(Window.partitionBy(*group).orderBy("c.p").rowsBetween(Window.unboundedPreceding, 0))
    runs = judged.withColumn("stretch", stretch).where(~F.col("clash")).groupBy(*group, "stretch").agg(F.count("*").alias("n_tokens"), F.countDistinct(key).alias("n_slots"))
    good = runs.where(F.col("n_tokens") >= F.least(F.lit(plan.min_run), F.col("n_item")))
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_tokens", "n_slots")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.n_tokens").cast("long").alias("n_tokens"), F.col("best.n_slots").cast("long").alias("n_slots"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, plan: LeakPlan = LeakPlan()) -> DataFrame:
    """docs' own rows and columns without the documents that leak a benchmark item; rows without doc_id stay."""
    gone = durable(leaks(docs, benchmark, plan).select(F.col("doc_id").alias("leak_doc")).distinct())
    gone = F.broadcast(gone) if gone.count() <= plan.broadcast_rows else gone
    return docs.join(gone, docs["doc_id"] == gone["leak_doc"], "left_anti")

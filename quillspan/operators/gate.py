"""The keyword gate: which groups an article may be about."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.textcols import let

WORD = re.compile(r"[a-z0-9]+")
# Letters outside ASCII that a pattern without regard to case takes for i, i, k and s.
FOLDED = ("İıKſ", "iiks")
MOST_KEYWORDS = 20_000  # of a universe, which is part of the plan


def pattern(keywords: Column) -> Column:
    """A Java pattern that finds any keyword, in any case, not inside a run of ASCII letters and digits."""
    quoted = F.transform(keywords, lambda k: F.concat(F.lit("\\Q"), F.replace(k, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.concat(F.lit("(?iu)(?<![A-Za-z0-9])(?:"), F.array_join(quoted, "|"), F.lit(")(?![A-Za-z0-9])"))


def theta_pairs(articles: DataFrame, groups: DataFrame, key: str = "article_id") -> DataFrame:
    """The gate as written: every article against every group's pattern. groups is a dimension of fixed size."""
    dim = groups.select("group_key", pattern(F.col("keywords")).alias("pattern"))
    return articles.join(F.broadcast(dim), F.expr("gate_text rlike pattern")).select(key, "group_key")


def _folded(keyword: str) -> str:
    return keyword.translate(str.maketrans(*FOLDED)).lower()


def fired(gate_text: Column, groups: DataFrame) -> Column:
    """The keys of the groups that a gate text fires, sorted, in the row itself: no join, no shuffle, no second look at the text.

    Keywords become n-grams of words: a keyword of letters and digits fires exactly if it is a word of the text. Of several
    words, or with other characters, it can only stand where its words follow each other, so it is looked for by pattern in
    texts that have them in a row, at a place where its first word stands. A keyword without letters and digits of ASCII is looked
    for in every text. The universe is read on the driver; ValueError beyond MOST_KEYWORDS.
    """
    rows = groups.select("group_key", F.explode("keywords").alias("keyword")).distinct().withColumn("pattern", pattern(F.array("keyword"))).limit(MOST_KEYWORDS + 1).collect()
    if len(rows) > MOST_KEYWORDS:
        raise ValueError(f"the universe has more than {MOST_KEYWORDS} keywords")
    plain: dict[str, set[str]] = {}
    phrases: dict[str, list[tuple[str, str]]] = {}
    for key, keyword, found_by in rows:
        words = WORD.findall(_folded(keyword))
        if re.fullmatch("[A-Za-z0-9]+", keyword):
            plain.setdefault(words[0], set()).add(key)
        else:
            phrases.setdefault(" ".join(words), []).append((found_by, key))
    none = F.array().cast("array<string>")
    firsts = sorted({p.split(" ")[0] for p in phrases} - {""})
    lengths = sorted({p.count(" ") + 1 for p in phrases} - {0})

    def matched(words: Column) -> Column:
        """The keywords of the universe that the words have, those of several words by where their first one stands."""
        single = F.array_intersect(words, F.array(*map(F.lit, sorted(plain)))) if plain else none
        if not firsts:
            return single
        places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(*firsts))
        grams = F.flatten(F.transform(places, lambda i: F.array(*(F.array_join(F.slice(words, i + 1, n), " ") for n in lengths))))
        several = F.when(F.arrays_overlap(words, F.array(*map(F.lit, firsts))), F.array_intersect(grams, F.array(*map(F.lit, sorted(phrases)))))
        return F.concat(single, F.coalesce(several, none))

    def keys(found: Column) -> Column:
        out = [F.when(F.array_contains(found, w), F.array(*map(F.lit, sorted(ks)))).otherwise(none) for w, ks in sorted(plain.items())]
        for gram, told in sorted(phrases.items()):
            for by, key in told:
                hit = gate_text.rlike(by) if gram == "" else F.array_contains(found, gram) & gate_text.rlike(by)
                out.append(F.when(hit, F.array(F.lit(key))).otherwise(none))
        return F.array_sort(F.array_distinct(F.concat(*out))) if out else none

    words = F.split(F.lower(F.translate(gate_text, *FOLDED)), "[^a-z0-9]+")
    return let(let(words, matched), keys)


def fired_pairs(articles: DataFrame, groups: DataFrame, key: str = "article_id") -> DataFrame:
    """The pairs of theta_pairs, for articles whose keys are unique; a row of each article and group that fires."""
    return articles.select(key, F.explode_outer(fired(F.col("gate_text"), groups)).alias("group_key")).where("group_key is not null")

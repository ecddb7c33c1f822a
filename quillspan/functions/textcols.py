"""Text rules as columns: cleaning, paragraph splitting, gate text and prompt rendering. Columns in, columns out, no UDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that str.isspace holds for; Java's \s is another set.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{SPACES}]"
MIN_PARAGRAPH = 30
SENTENCES = 3
HARD_WRAP = 80


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def normalize_space(x: Column) -> Column:
    # single spaces, the usual case, are no match
    return strip(F.regexp_replace(x, f"[{SPACES.replace(' ', '')}]{WS}*| {WS}+", " "))


def stripped_lines(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, "\n", -1), strip), lambda line: line != "")


def clean_web_text(text: Column) -> Column:
    """Keep lines that look like prose: at most two bars, and 15 characters or a closing mark at the end."""
    bars = lambda line: F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    prose = lambda line: (bars(line) <= 2) & ((F.length(line) >= 15) | F.substring(line, -1, 1).isin(".", "!", "?", '"', "'"))
    return F.array_join(F.filter(stripped_lines(text), prose), "\n")


def sentences(x: Column) -> Column:
    parts = F.split(x, f'(?<=[.!?]){WS}+(?=[A-Z"“])', -1)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def group_sentences(x: Column, n: int = SENTENCES) -> Column:
    """Up to n sentences: the text as it is; more: chunks of n sentences."""
    chunks = lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1, F.lit(n)), lambda i: F.array_join(F.slice(s, i + 1, n), " "))
    return let(sentences(x), lambda s: F.when(F.size(s) <= n, F.array(x)).otherwise(chunks(s)))


def paragraphs(text: Column) -> Column:
    """Paragraphs of a text: blank lines always part them; a hard-wrapped block is cut by sentences, any other by lines. Null counts as empty."""
    none = F.array().cast("array<string>")
    text = F.coalesce(text, F.lit(""))

    def of_block(lines: Column) -> Column:
        total = F.aggregate(lines, F.lit(0), lambda acc, line: acc + F.length(line))
        wrapped = total / F.size(lines) < HARD_WRAP
        return F.when(F.size(lines) < 2, lines).when(wrapped, let(F.array_join(lines, " "), group_sentences)).otherwise(lines)

    blocks = F.transform(F.split(text, "\n\n", -1), lambda b: let(stripped_lines(b), of_block))
    kept = F.transform(F.filter(F.flatten(blocks), lambda p: F.length(p) >= MIN_PARAGRAPH), normalize_space)
    whole = let(normalize_space(text), lambda w: F.when(w == "", none).otherwise(F.array(w)))
    return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(whole))


def gate_text(headline: Column, paras: Column) -> Column:
    # never null, or joins would have the whole expression evaluated once more in a null check at the scan
    return F.concat(F.coalesce(headline, F.lit("")), F.lit("\n"), F.coalesce(F.array_join(paras, "\n"), F.lit("")))


def article_block(headline: Column, paras: Column) -> Column:
    shown = F.array_join(F.transform(paras, lambda p, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), p)), "\n\n")
    return F.concat(F.lit("[HEADLINE] "), headline, F.lit("\n\n[ARTICLE]\n"), shown, F.lit("\n[/ARTICLE]"))


def group_label(name: Column, asset_class: Column, members: Column) -> Column:
    return F.concat(name, F.lit(" | "), asset_class, F.lit(" — constituents: "), F.array_join(F.transform(members, lambda m: m["name"]), ", "))


def mapper_prompt(block: Column, label: Column) -> Column:
    """The article first, the group last, so that an article's prompts share their prefix."""
    return F.concat(block, F.lit("\n\n[ASSET_GROUP] "), label)

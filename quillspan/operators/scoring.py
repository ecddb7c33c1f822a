"""The scorer interface: a batch of (system, user) prompts in, as many answers out, in order."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import ladder

SHARES = 4096  # of a class, dealt apart
BATCH_CHARS = 4_000_000
Backend = Callable[[list[tuple[str, str]]], list[str]]


def stub_backend() -> Backend:
    """Answers that nothing is relevant; for tests and dry runs."""
    return lambda prompts: ['{"evidence_paragraphs": [], "relevance_score": 0.0, "relevant": false}' for _ in prompts]


def keyword_backend(keywords: dict[str, list[str]]) -> Callable[[], Backend]:
    """A backend for groups by name: evidence are the paragraphs with a keyword of the group, the score is their share."""
    found_by = {g: re.compile("(?<![A-Za-z0-9])(?:" + "|".join(map(re.escape, ks)) + ")(?![A-Za-z0-9])", re.IGNORECASE) for g, ks in keywords.items()}

    def answer(user: str) -> str:
        article, _, group = user.rpartition("\n\n[ASSET_GROUP] ")
        body = article.partition("\n\n[ARTICLE]\n")[2].removesuffix("\n[/ARTICLE]")
        paragraphs = [p.partition("] ")[2] for p in body.split("\n\n")] if body else []
        hits = [k for k, p in enumerate(paragraphs) if found_by[group.partition(" | ")[0]].search(p)]
        return json.dumps({"evidence_paragraphs": hits, "relevance_score": len(hits) / max(len(paragraphs), 1), "relevant": bool(hits)})

    return lambda: lambda prompts: [answer(user) for _, user in prompts]


def packed(rows: Iterable[tuple[str, str, str]], most_chars: int) -> Iterator[list[tuple[str, str]]]:
    """Rows (class, system, user) as batches of (system, user): a batch ends where the class changes, or where one more user prompt
    would take it over the budget; system prompts, one a class, count once."""
    batch: list[tuple[str, str]] = []
    kind, size = None, 0
    for of, system, user in rows:
        if batch and (of != kind or size + len(user) > most_chars):
            yield batch
            batch, size = [], 0
        if not batch:
            kind, size = of, len(system)
        batch.append((system, user))
        size += len(user)
    if batch:
        yield batch


def score(tasks: DataFrame, make_backend: Callable[[], Backend], parse=ladder.parse_mapper, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """tasks (system, user, ...) with `result`. A backend is made once a worker; ValueError if it answers out of number.

    Where tasks have an asset_class, those of one class and article follow each other, dealt by both so that no class is one task, and
    no batch of the backend holds two classes: its prompts share a prefix. Batches go on over Spark's own Arrow batches, whose size
    thus has no effect on them.
    """

    @F.pandas_udf("string")
    def raw(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        backend, answers, sizes = make_backend(), [], []

        def rows() -> Iterator[tuple[str, str, str]]:
            for kind, system, user in batches:
                sizes.append(len(system))
                yield from zip(kind, system, user, strict=True)

        def whole() -> Iterator[pd.Series]:
            while sizes and len(answers) >= sizes[0]:
                n = sizes.pop(0)
                yield pd.Series(answers[:n], dtype="object")
                del answers[:n]

        for prompts in packed(rows(), batch_chars):
            got = backend(prompts)
            if len(got) != len(prompts):
                raise ValueError(f"{len(got)} answers to {len(prompts)} prompts")
            answers += got
            yield from whole()
        yield from whole()

    kind = F.lit("")
    if "asset_class" in tasks.columns and {"article_id", "id"} & set(tasks.columns):
        key, kind = "id" if "id" in tasks.columns else "article_id", F.col("asset_class")
        tasks = tasks.repartition("asset_class", F.pmod(F.xxhash64(key), F.lit(SHARES))).sortWithinPartitions("asset_class", key)
    return tasks.withColumn("raw", raw(kind, F.col("system"), F.col("user"))).withColumn("result", parse(F.col("raw")))


def class_prompts(template: str, rules: dict[str, str], needed: set[str]) -> dict[str, str]:
    """A system prompt for each asset class: two placeholders, a rule text of two parts. Faults raise ValueError."""
    if missing := needed - set(rules):
        raise ValueError(f"classes without rules: {sorted(missing)}")
    if extra := set(rules) - needed:
        raise ValueError(f"rules without a class: {sorted(extra)}")
    out = {}
    for name, text in rules.items():
        parts = text.split("===POSITIVE RULES===")
        if len(parts) != 2:
            raise ValueError(f"the rules of {name} have {len(parts)} parts")
        prompt = template
        for mark, part in zip(("{{DISQUALIFIERS}}", "{{POSITIVE_RULES}}"), parts, strict=True):
            if mark not in prompt:
                raise ValueError(f"the template lacks {mark}")
            prompt = prompt.replace(mark, part.strip("\n"))
        out[name] = prompt
    return out

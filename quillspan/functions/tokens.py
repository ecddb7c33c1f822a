"""Token counts of byte-level byte-pair vocabularies, read from their files: merges in rank order, or ranks of tokens."""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The pattern that parts a text into words before merges, and the bytes that byte-level vocabularies write as themselves.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

MOST_BYTES = 64 << 20  # of a vocabulary file, which goes to every executor
CACHED = 100_000  # words a worker remembers


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself, or the next character from 256 on."""
    hidden = [b for b in range(256) if b not in set(SHOWN)]
    return {chr(b): b for b in SHOWN} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Ranks of merges: pairs of byte strings, or, from a rank file, what a pair makes."""

    def __init__(self, ranks: dict, by_pair: bool) -> None:
        self.ranks, self.by_pair, self.words, self.seen = ranks, by_pair, regex.compile(WORDS), {}

    def rank(self, a: bytes, b: bytes) -> int | None:
        return self.ranks.get((a, b) if self.by_pair else a + b)

    def pieces(self, word: bytes) -> list[bytes]:
        """The tokens of a word: of all neighbours the pair of least rank is merged, the leftmost first, until none has a rank.

        Neighbours wait in a heap, so that a word of any length costs about its length.
        """
        part: list[bytes | None] = [word[k : k + 1] for k in range(len(word))]
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap = [(r, k) for k in range(len(part) - 1) if (r := self.rank(part[k], part[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            n = after[k]
            if part[k] is None or n >= len(part) or self.rank(part[k], part[n]) != r:
                continue  # one of the two has been merged since
            part[k], part[n] = part[k] + part[n], None
            after[k] = after[n]
            if after[n] < len(part):
                before[after[n]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < len(part) and (r := self.rank(part[left], part[right])) is not None:
                    heapq.heappush(heap, (r, left))
        return [p for p in part if p is not None]

    def count(self, text: str) -> int:
        total = 0
        for m in self.words.finditer(text):
            word = m[0]
            n = self.seen.get(word)
            if n is None:
                n = len(self.pieces(word.encode("utf-8", "surrogatepass")))
                if len(word) <= 64:
                    if len(self.seen) >= CACHED:
                        self.seen.clear()
                    self.seen[word] = n
            total += n
        return total


def parse(content: bytes, name: str) -> Vocabulary:
    """A tokenizer.json of byte-level byte pairs, or a file of lines `token in base64, rank`; ValueError for other kinds."""
    if not name.endswith(".json"):
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, content.splitlines()) if t}
        return Vocabulary(ranks, False)
    told = json.loads(content)
    model, parts = told.get("model") or {}, told.get("pre_tokenizer") or {}
    split = parts.get("pretokenizers", [parts])
    if model.get("type") != "BPE" or not any(p.get("type") == "ByteLevel" and p.get("use_regex", True) for p in split) or told.get("normalizer"):
        raise ValueError(f"{name} is no byte-level byte-pair vocabulary")
    byte_of = _byte_of()
    as_bytes = lambda t: bytes(byte_of[c] for c in t)
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    return Vocabulary({(as_bytes(a), as_bytes(b)): k for k, (a, b) in enumerate(pairs)}, True)


def counter(spark: SparkSession, path: str) -> Callable[[Column], Column]:
    """A function from a text column to its count of tokens, special tokens aside; null texts stay null and cost nothing.

    The file is read through Spark, so it may lie in any store; it goes to executors once, MOST_BYTES at most.
    """
    rows = spark.read.format("binaryFile").load(path).select("length", "content").limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} is not one file")
    if rows[0]["length"] > MOST_BYTES:
        raise ValueError(f"{path} has {rows[0]['length']} bytes, more than {MOST_BYTES}")
    content, name = bytes(rows[0]["content"]), path.rsplit("/", 1)[-1]
    parse(content, name)  # a wrong file fails here, not in a task
    shared = spark.sparkContext.broadcast(content)

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = None
        for texts in batches:
            if vocabulary is None and texts.notna().any():
                vocabulary = parse(shared.value, name)
            yield pd.Series([None if t is None else vocabulary.count(t) for t in texts], dtype="Int64")

    return counted

"""The ladder's rules in plain Python, to hold the JVM's against: the whole text, else its first balanced object, else defaults."""

from __future__ import annotations

import json
from collections.abc import Callable

TRUE, FALSE = {"true", "t", "1", "yes", "y", "on"}, {"false", "f", "0", "no", "n", "off"}


def extract_json(text: str) -> str | None:
    try:
        json.loads(text)
        return text
    except ValueError:
        pass
    depth, start = 0, text.find("{")
    for k in range(start, len(text)) if start >= 0 else ():
        depth += (text[k] == "{") - (text[k] == "}")
        if not depth:
            return text[start : k + 1]
    return None


def _integer(x: object) -> int:
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, int) or isinstance(x, float) and x.is_integer():
        return int(x)
    if isinstance(x, str):
        return int(x.strip())
    raise ValueError(x)


def _number(x: object) -> float:
    if isinstance(x, (bool, int, float, str)):
        return float(x)
    raise ValueError(x)


def _flag(x: object) -> bool:
    if isinstance(x, bool):
        return x
    if x in (0, 1):
        return bool(x)
    if isinstance(x, str) and x.lower() in TRUE | FALSE:
        return x.lower() in TRUE
    raise ValueError(x)


def _list(x: object) -> list[int]:
    if not isinstance(x, list):
        raise ValueError(x)
    return [_integer(v) for v in x]


def _verdict(x: object) -> str:
    if x not in ("correct", "incorrect"):
        raise ValueError(x)
    return x


MAPPER = {"evidence_paragraphs": (_list, []), "relevance_score": (_number, 0.0), "relevant": (_flag, False)}
GRADER = {"evidence_paragraphs": (_list, []), "relevance_score": (_number, 0.0), "verdict": (_verdict, "correct")}
Fields = dict[str, tuple[Callable, object]]


def read(raw: str | None, fields: Fields) -> dict:
    """A valid object's fields, coerced; any fault leaves every field at its default."""
    default = {k: d for k, (_, d) in fields.items()}
    for text in (raw, extract_json(raw or "")):
        try:
            found = json.loads(text)
            if isinstance(found, dict):
                return {k: f(found[k]) if k in found else d for k, (f, d) in fields.items()}
        except (TypeError, ValueError, OverflowError):
            continue
    return default

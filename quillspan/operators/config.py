"""Settings of a run, checked before it starts, and the record of them that goes with its results."""

from __future__ import annotations

import json
import re
from dataclasses import InitVar, asdict, dataclass
from pathlib import Path

# Datasets, the one that is gated unless told otherwise, and token bounds.
DATASETS = ("gold", "sports", "wikigaming", "djnw")
GATED = "djnw"
MIN_ARTICLE_TOKENS = 1024
HEADROOM = {"mapper": 8000, "grader": 8000}
GRADER_TOKENS = 1024


class Local:
    """The driver's own files, for settings that are checked without a session."""

    @staticmethod
    def exists(path: str) -> bool:
        return Path(path).exists()

    @staticmethod
    def read(path: str) -> str:
        return Path(path).read_text()


def gate_default(dataset: str) -> bool:
    """Production wire is gated; measurement sets are not, for a gate would answer in place of the scorer."""
    return dataset == GATED


def max_article_tokens(max_model_len: int, stage: str) -> int:
    """The longest article that a stage's context length leaves room for."""
    return max(MIN_ARTICLE_TOKENS, max_model_len - HEADROOM[stage])


def model_context(folder: str, files=Local) -> int:
    """The context length that a model folder's config.json declares; RuntimeError if that can't be read, ValueError if it declares none."""
    path = f"{folder}/config.json"
    if not files.exists(path):
        raise ValueError(f"no model at {folder}")
    try:
        told = json.loads(files.read(path))
    except json.JSONDecodeError as e:
        raise RuntimeError(f"{path} is not JSON: {e}") from e
    for part in (told.get("text_config", told), told):
        if part.get("max_position_embeddings"):
            return int(part["max_position_embeddings"])
    raise ValueError(f"{path} declares no max_position_embeddings")


def checked_length(max_model_len: int, model: str | None, files=Local) -> int:
    if max_model_len <= 0:
        raise ValueError("max_model_len must be positive")
    if model is not None and max_model_len > (most := model_context(model, files)):
        raise ValueError(f"max_model_len {max_model_len} is beyond the model's {most}")
    return max_model_len


def vocabulary_path(tokenizer: str | None, model: str | None) -> str | None:
    """The vocabulary that lengths are measured by: the one that is named, else the model's own."""
    return tokenizer or (f"{model}/tokenizer.json" if model else None)


def _there(files, path: str | None, what: str) -> None:
    if path is not None and not files.exists(path):
        raise ValueError(f"no {what} at {path}")


def _month(value: str | None, name: str) -> None:
    if value is not None and not re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])", value):
        raise ValueError(f"{name} is no YYYY-MM: {value!r}")


@dataclass(frozen=True)
class MapperRun:
    """dataset is inferred from input_file, a wire shard, or input_dir, a folder of them; exactly one of output_file and
    output_dir is given, the latter for a folder; paths must exist in the store that `files` reads, the driver's own by default.

    Mode dev writes to results/<dataset>.jsonl unless told otherwise; prod is for whole shards into a folder.
    """

    mode: str | None = None
    dataset: str | None = None
    path: str | None = None
    input_file: str | None = None
    input_dir: str | None = None
    pattern: str = "*"
    output_file: str | None = None
    output_dir: str | None = None
    keyword_gate: bool | None = None
    max_model_len: int = 65_536
    model: str | None = None
    tokenizer: str | None = None
    max_articles: int | None = None
    start_date: str | None = None
    end_date: str | None = None
    random_seed: int | None = None
    sidecars: str | None = None
    denylist: str | None = None
    template: str | None = None
    rules: str | None = None
    report_stats: bool = False
    open_records: bool = False
    files: InitVar[object] = Local

    def __post_init__(self, files) -> None:
        shards = self.input_file or self.input_dir
        if self.dataset is None and shards is None:
            raise ValueError("give a dataset, an input file or an input folder")
        given = self.dataset or GATED
        if given not in DATASETS:
            raise ValueError(f"unknown dataset {given!r}; known: {', '.join(DATASETS)}")
        if self.mode not in (None, "dev", "prod"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.mode == "prod" and (shards is None or self.output_dir is None or self.max_articles is not None):
            raise ValueError("mode prod needs shards and an output folder, and takes them whole")
        if self.mode == "dev" and self.output_file is None and self.output_dir is None:
            object.__setattr__(self, "output_file", f"results/{given}.jsonl")
        if (self.output_file is None) == (self.output_dir is None):
            raise ValueError("give exactly one of output_file and output_dir")
        if shards is not None and given != GATED:
            raise ValueError(f"an input file or folder is of {GATED}, the dataset is {given}")
        if self.input_file is not None and self.input_dir is not None:
            raise ValueError("give an input file or an input folder, not both")
        if self.input_dir is not None and self.output_dir is None:
            raise ValueError("a folder of shards needs an output folder")
        if (self.template is None) != (self.rules is None):
            raise ValueError("give both the template and the folder of rules, or neither")
        for name in ("start_date", "end_date"):
            _month(getattr(self, name), name)
        for path, what in ((self.input_file, "shard"), (self.input_dir, "folder of shards"), (self.path, f"data of {given}"), (self.template, "template"), (self.rules, "folder of rules"), (self.denylist, "deny list")):
            _there(files, path, what)
        if self.sidecars is not None and not files.exists(self.sidecars):
            raise FileNotFoundError(f"no sidecars at {self.sidecars}")
        checked_length(self.max_model_len, self.model, files)
        resolved = {"dataset": given, "path": self.path or shards, "keyword_gate": gate_default(given) if self.keyword_gate is None else self.keyword_gate}
        if resolved["path"] is None:
            raise ValueError(f"give the path of {given}")
        for name, value in resolved.items():
            object.__setattr__(self, name, value)

    @property
    def output(self) -> str:
        from quillspan.operators.sinks import output_name

        return self.output_file or f"{self.output_dir}/{output_name(self.path)}.jsonl"

    @property
    def max_article_tokens(self) -> int:
        return max_article_tokens(self.max_model_len, "mapper")

    @property
    def vocabulary(self) -> str | None:
        return vocabulary_path(self.tokenizer, self.model)

    def record(self) -> dict:
        """What goes into the summary: the settings and the longest article that the length filter lets in."""
        return asdict(self) | {"max_article_tokens": self.max_article_tokens}


@dataclass(frozen=True)
class GraderRun:
    """The records to grade, where their articles are, and where the verdicts go; a wire run needs its shard."""

    mapper_output: str
    output: str
    dataset: str = "gold"
    path: str | None = None
    input_file: str | None = None
    max_model_len: int = 65_536
    model: str | None = None
    tokenizer: str | None = None
    prompt: str | None = None
    max_tokens: int = GRADER_TOKENS
    files: InitVar[object] = Local

    def __post_init__(self, files) -> None:
        if self.dataset not in ("gold", GATED):
            raise ValueError(f"only gold and {GATED} are graded")
        if self.dataset == GATED and self.input_file is None:
            raise ValueError(f"{GATED} needs its shard as input file")
        if self.dataset == "gold" and self.path is None:
            raise ValueError("gold needs the path of its articles")
        if self.max_tokens <= 0:
            raise ValueError("max_tokens must be positive")
        for path, what in ((self.input_file, "shard"), (self.path, "data"), (self.mapper_output, "mapper output"), (self.prompt, "prompt")):
            _there(files, path, what)
        checked_length(self.max_model_len, self.model, files)

    @property
    def max_article_tokens(self) -> int:
        return max_article_tokens(self.max_model_len, "grader")

    @property
    def vocabulary(self) -> str | None:
        return vocabulary_path(self.tokenizer, self.model)

    def record(self) -> dict:
        return asdict(self) | {"max_article_tokens": self.max_article_tokens}

"""Small files that the driver reads: the universe of groups, assets, futures and prompt texts; and results read back."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.universe import validate

# The classes of futures.
CLASSES = ("commodity", "currency", "government bond", "equity index", "volatility", "short-term interest rate", "US equity sector")
FUTURE = ("exchange_name", "calcseriesname", "name", "asset_class", "curcdd", "ric")
RECORD = "article_id string, headline string, filtered_reasons array<string>, groups array<string>, assets array<struct<name: string, ticker_symbol: string>>, paragraphs map<string, string>, mappings array<struct<group: string, asset_class: string, relevance_score: double, evidence_paragraphs: array<int>>>, url string"


def mapping_file(path: str) -> dict:
    """The object of a JSON file, or of a YAML file where a reader for it is installed."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def groups_file(path: str) -> dict[str, dict]:
    """Groups by key, checked; members that are a list of names stay as they are written."""
    found = mapping_file(path)
    validate(found)
    return found


def assets(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, name, asset_class) of an asset universe file, a symbol a key."""
    rows = [(k, v.get("name"), v.get("asset_class")) for k, v in mapping_file(path).items()]
    return spark.createDataFrame(rows, "symbol string, name string, asset_class string")


def futures(spark: SparkSession, path: str) -> DataFrame:
    """Typed futures of an asset universe file: symbols that begin with # are comments; a lacking field raises KeyError, an unknown class ValueError."""
    rows = []
    for symbol, v in mapping_file(path).items():
        if symbol.startswith("#"):
            continue
        row = [v[f] for f in FUTURE]
        if v["asset_class"] not in CLASSES:
            raise ValueError(f"{symbol} is of the unknown class {v['asset_class']!r}")
        rows.append((symbol, *row))
    return spark.createDataFrame(rows, "symbol string, " + ", ".join(f"{f} string" for f in FUTURE))


def mismatch(asset_names: DataFrame, groups: DataFrame) -> DataFrame:
    """(name, side): assets that no group has as a member, and members that are no asset."""
    members = groups.select(F.explode("members").alias("m")).select(F.col("m.name").alias("name")).distinct()
    known = asset_names.select("name").distinct()
    return known.join(members, "name", "left_anti").withColumn("side", F.lit("asset")).unionByName(members.join(known, "name", "left_anti").withColumn("side", F.lit("member")))


def prompt_texts(folder: str, names: dict[str, str]) -> dict[str, str]:
    """The text of each class's file."""
    return {c: (Path(folder) / f).read_text() for c, f in names.items()}


def rule_texts(store, folder: str) -> dict[str, str]:
    """The rules of each class: the text files of a folder in any store, named after their class with _ for spaces."""
    return {e.name.removesuffix(".txt").replace("_", " "): store.read(e.path) for e in store.listing(folder, "*.txt")}


def mapper_records(spark: SparkSession, path: str) -> DataFrame:
    """A mapper's output: JSON lines, blank ones ignored."""
    return spark.read.schema(RECORD).json(path)


def results_of(rows: DataFrame, article_id: str) -> DataFrame:
    """All result rows of an article."""
    return rows.where(F.col("article_id") == article_id)

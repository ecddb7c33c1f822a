"""The asset-group dimension: loading, checks, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "group_key string, name string, asset_class string, keywords array<string>, members array<struct<name: string, ticker_symbol: string, short_name: string>>"
EXCLUDED = "US equity sector"
# The classes of groups.
CLASSES = ("commodity", "currency", "equity index", "rates", "volatility", EXCLUDED)


def validate(groups: dict[str, dict]) -> None:
    """Raise ValueError unless every group and member is complete, classes are known, short names and assets are unique and each group has keywords."""
    seen: dict[str, str] = {}
    tickers: dict[str, str] = {}
    for key, g in groups.items():
        if not isinstance(g, dict):
            raise ValueError(f"group {key} is not a mapping")
        for field in ("name", "asset_class", "members"):
            if field not in g:
                raise ValueError(f"group {key} lacks {field}")
        if g["asset_class"] not in CLASSES:
            raise ValueError(f"group {key} is of the unknown class {g['asset_class']!r}")
        if not g.get("keywords"):
            raise ValueError(f"group {key} has no keywords")
        for m in g["members"]:
            for field in ("name", "ticker_symbol", "short_name"):
                if not m.get(field):
                    raise ValueError(f"a member of {key} lacks {field}")
            if m["short_name"] in seen:
                raise ValueError(f"short name {m['short_name']} is in {seen[m['short_name']]} and {key}")
            if m["name"] in tickers:
                raise ValueError(f"asset {m['name']} is in {tickers[m['name']]} and {key}")
            seen[m["short_name"]] = tickers[m["name"]] = key


def lookup(groups: dict[str, dict]) -> dict[str, str]:
    """Short names and group names to group keys; a name that means two groups raises ValueError."""
    out: dict[str, str] = {}
    for key, g in groups.items():
        for name in {g["name"], *(m["short_name"] for m in g["members"])}:
            if out.setdefault(name, key) != key:
                raise ValueError(f"{name} means {out[name]} and {key}")
    return out


def constituents(groups: dict[str, dict], key: str) -> list[tuple[str, str]]:
    """(name, short name) of a group's members as they are listed; an unknown key raises KeyError."""
    return [(m["name"], m["short_name"]) for m in groups[key]["members"]]


def member_index(groups: dict[str, dict]) -> dict[str, str]:
    """Asset names to the key of their group; an asset of two groups raises ValueError."""
    out: dict[str, str] = {}
    for key in groups:
        for name, _ in constituents(groups, key):
            if out.setdefault(name, key) != key:
                raise ValueError(f"asset {name} is in {out[name]} and {key}")
    return out


def ticker_index(groups: dict[str, dict]) -> dict[str, str]:
    """Asset names to their ticker symbols."""
    return {m["name"]: m["ticker_symbol"] for g in groups.values() for m in g["members"]}


# The classes of an asset listing in order, with their headings; classes without parts are sorted by symbol,
# others are told in parts by symbol, the last of which takes the rest.
LISTING = {
    "US equity sector": ("EQUITY SECTORS (GICS)", {}),
    "commodity": ("COMMODITIES", {"Energy": ("CL", "BRN", "RB", "NG", "HO", "G"), "Metals": ("GC", "SI", "HG", "AHD", "NID", "PBD", "ZSD"), "Agri/Softs/Livestock": ()}),
    "government bond": ("GOVERNMENT BONDS", {"US": ("ZT", "ZF", "ZN", "TN", "ZB", "UB"), "Europe": ("FGBS", "FGBM", "FGBL", "FGBX", "FOAT", "FBTP"), "Other": ()}),
    "currency": ("CURRENCIES", {}),
    "equity index": ("EQUITY INDEX FUTURES", {"US": ("ES", "NQ", "RTY", "YM", "EMD"), "Europe": ("FESX", "FDAX", "FCE", "FIB", "FIE", "FTI", "FSMI", "FATX"), "Asia/Other": ()}),
    "short-term interest rate": ("SHORT-TERM INTEREST RATE FUTURES (STIR)", {}),
    "volatility": ("VOLATILITY", {}),
}


def listing(assets: dict[str, dict]) -> str:
    """The assets of a universe file, symbol and name, by class and part; classes that aren't listed are left out."""
    out: list[str] = []
    for kind, (heading, parts) in LISTING.items():
        mine = [(symbol, a.get("name", symbol)) for symbol, a in assets.items() if a.get("asset_class") == kind]
        if not mine:
            continue
        out.append(f"**{heading}**")
        if parts:
            part_of = {symbol: part for part, symbols in parts.items() for symbol in symbols}
            rest = list(parts)[-1]
            for part in parts:
                if told := [f"{s} ({n})" for s, n in mine if part_of.get(s, rest) == part]:
                    out.append(f"- **{part}:** {', '.join(told)}")
        else:
            out.append(", ".join(f"{s} ({n})" for s, n in sorted(mine)))
        out.append("")
    return "\n".join(out)


def to_frame(spark: SparkSession, groups: dict[str, dict]) -> DataFrame:
    validate(groups)
    rows = [(k, g["name"], g["asset_class"], g["keywords"], [(m["name"], m["ticker_symbol"], m["short_name"]) for m in g["members"]]) for k, g in sorted(groups.items())]
    return spark.createDataFrame(rows, SCHEMA)


def mapper_view(groups: DataFrame) -> DataFrame:
    return groups.where(F.col("asset_class") != EXCLUDED)


def overlap(groups: DataFrame) -> DataFrame:
    """(name): assets that are members of groups that the mapper sees and of groups that it doesn't; there should be none."""
    members = lambda g: g.select(F.explode("members.name").alias("name"))
    return members(mapper_view(groups)).intersect(members(groups.where(F.col("asset_class") == EXCLUDED)))


# The universe of the registered queries: markers of the languages that the test articles are written in.
FIXTURE = {
    "english": {"name": "English markers", "asset_class": "equity index", "keywords": ["the", "and", "that"], "members": [{"name": "Anglo Index", "ticker_symbol": "ANG", "short_name": "anglo"}, {"name": "Isles Index", "ticker_symbol": "ISL", "short_name": "isles"}]},
    "french": {"name": "French markers", "asset_class": "rates", "keywords": ["les", "des", "elle"], "members": [{"name": "Hexagon Bond", "ticker_symbol": "HEX", "short_name": "hexagon"}, {"name": "Gaul Bill", "ticker_symbol": "GAU", "short_name": "gaul"}]},
    "german": {"name": "German markers", "asset_class": "rates", "keywords": ["der", "und", "die"], "members": [{"name": "Rhine Bond", "ticker_symbol": "RHI", "short_name": "rhine"}, {"name": "Alpine Bill", "ticker_symbol": "ALP", "short_name": "alpine"}, {"name": "Harbour Note", "ticker_symbol": "HAR", "short_name": "harbour"}]},
    "license": {"name": "License phrases", "asset_class": "commodity", "keywords": ["all rights reserved", "MIT License", "licensed"], "members": [{"name": "Paper Future", "ticker_symbol": "PAP", "short_name": "paper"}]},
    "rare": {"name": "Rare markers", "asset_class": "volatility", "keywords": ["nonesuch"], "members": [{"name": "Ghost Index", "ticker_symbol": "GHO", "short_name": "ghost"}]},
    "sector": {"name": "Sector markers", "asset_class": "US equity sector", "keywords": ["with"], "members": [{"name": "Sector Fund", "ticker_symbol": "SEC", "short_name": "sectorfund"}]},
    "spanish": {"name": "Spanish markers", "asset_class": "currency", "keywords": ["los", "del", "que"], "members": [{"name": "Iberia Peso", "ticker_symbol": "IBE", "short_name": "iberia"}, {"name": "Andes Peso", "ticker_symbol": "AND", "short_name": "andes"}]},
}

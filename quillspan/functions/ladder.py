"""Tolerant reading of a scorer's raw answer, in the JVM: the whole text, else its first balanced object, else defaults.

Answers are read as variants, so that a field's kind is known when it is coerced: "0.5" and true are numbers too, "3" and 3.0
paragraphs, 1.5 is none. Any fault in any field leaves all at their defaults. An object that names a key twice counts as no object.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions.textcols import let, strip

# The words that count as flags, and the verdicts.
TRUE, FALSE = ("true", "t", "1", "yes", "y", "on"), ("false", "f", "0", "no", "n", "off")
VERDICTS = ("correct", "incorrect")
INTEGER = r"^[+-]?[0-9]+(_[0-9]+)*$"
NUMBER = r"^[+-]?(?:[0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$"
MOST = 2**31
# numbers that JSON doesn't have but scorers write, where a value may stand
UNUSUAL = r"([:\[,]\s*)(-?(?:NaN|Infinity))(?=\s*[,}\]])"
Check = Callable[[Column], tuple[Column, Column]]  # (valid, value) of a field that is there


def _object(text: Column) -> tuple[Column, Column]:
    """(whether the whole text is JSON of any kind, its keys and values if it is an object).

    The parser stops behind the first value, so the text is read inside an object with a key of its own behind it: it is one value
    exactly if that object has these two keys.
    """
    wrapped = lambda t: F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"value":'), t, F.lit(',"z":0}'))), "$", "map<string, variant>")
    found = F.coalesce(wrapped(text), F.when(text.rlike(UNUSUAL), wrapped(F.regexp_replace(text, UNUSUAL, '$1"$2"'))))
    value = F.try_element_at(found, F.lit("value"))
    whole = F.coalesce((F.size(found) == 2) & F.map_contains_key(found, "z") & F.map_contains_key(found, "value"), F.lit(False))
    return whole, F.when(whole & F.schema_of_variant(value).startswith("OBJECT"), F.try_variant_get(value, "$", "map<string, variant>"))


def balanced(text: Column) -> Column:
    """From the first opening brace to the one that balances it, braces in strings counted too; null if none does."""
    rest = F.substring(text, F.instr(text, "{"), F.length(text))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("done"))

    def step(at: Column, piece: Column) -> Column:
        last = F.substring(piece, -1, 1)
        depth = at["depth"] + F.when(last == "{", 1).when(last == "}", -1).otherwise(0)
        ends = (last == "}") & (depth == 0)
        return F.when(at["done"], at).otherwise(F.struct(depth.alias("depth"), (at["size"] + F.length(piece)).alias("size"), ends.alias("done")))

    end = F.aggregate(F.split(rest, r"(?<=[{}])"), start, step)
    return F.when(F.instr(text, "{") > 0, let(F.struct(rest.alias("rest"), end.alias("end")), lambda x: F.when(x["end"]["done"], F.substring(x["rest"], F.lit(1), x["end"]["size"]))))


def _kinds(v: Column) -> tuple[Column, Column, Column, Column, Column]:
    """(is a flag, is a number, is a text, the number, the text) of a variant."""
    kind = F.schema_of_variant(v)
    number = (kind == "BIGINT") | (kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL")
    return kind == "BOOLEAN", number, kind == "STRING", F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")


def _integer(v: Column) -> Column:
    """An int, null if it is none: a flag, a number without fraction, a text of digits; others, and what an int can't hold, are none."""
    flag, number, text, value, shown = _kinds(v)
    digits = F.translate(strip(shown), "_+", "")
    told = F.when(flag, F.when(value == 1, 1).otherwise(0)).when(number & (F.floor(value) == value) & (F.abs(value) < MOST), value.cast("int"))
    return told.when(text & strip(shown).rlike(INTEGER), digits.try_cast("int"))


def _list(v: Column) -> tuple[Column, Column]:
    found = F.transform(F.try_variant_get(v, "$", "array<variant>"), _integer)
    valid = F.schema_of_variant(v).startswith("ARRAY") & ~F.exists(found, lambda x: x.isNull())
    return valid, found


def _number(v: Column) -> tuple[Column, Column]:
    """A flag, a number, or a text that writes one; what is not a number has no value."""
    flag, number, text, value, shown = _kinds(v)
    word = F.lower(strip(shown))
    bare = F.regexp_replace(word, r"^[+-]", "")
    endless = text & bare.isin("inf", "infinity")
    nan = text & (bare == "nan")
    told = F.when(flag | number, value).when(endless, F.when(word.startswith("-"), float("-inf")).otherwise(float("inf"))).when(text & strip(shown).rlike(NUMBER), F.translate(strip(shown), "_", "").try_cast("double"))
    return flag | number | endless | nan | told.isNotNull(), F.when(F.isnan(told), None).otherwise(told)


def _flag(v: Column) -> tuple[Column, Column]:
    flag, number, text, value, shown = _kinds(v)
    word = F.lower(shown)
    return flag | (number & value.isin(0.0, 1.0)) | (text & word.isin(*TRUE, *FALSE)), F.when(text, word.isin(*TRUE)).otherwise(value == 1)


def _verdict(v: Column) -> tuple[Column, Column]:
    _, _, text, _, shown = _kinds(v)
    return text & shown.isin(*VERDICTS), shown


MAPPER: dict[str, tuple[Check, str, object]] = {"evidence_paragraphs": (_list, "array<int>", None), "relevance_score": (_number, "double", 0.0), "relevant": (_flag, "boolean", False)}
GRADER: dict[str, tuple[Check, str, object]] = {"evidence_paragraphs": (_list, "array<int>", None), "relevance_score": (_number, "double", 0.0), "verdict": (_verdict, "string", "correct")}


def read(raw: Column, fields: dict[str, tuple[Check, str, object]]) -> Column:
    """A struct of the fields of an answer."""

    def of(text: Column) -> Column:
        whole, keys = _object(text)
        return F.struct(whole.alias("whole"), keys.alias("keys"))

    def coerced(keys: Column) -> Column:
        none = {f: F.array().cast(kind) if default is None else F.lit(default).cast(kind) for f, (_, kind, default) in fields.items()}
        good, values = keys.isNotNull(), []
        for f, (check, kind, _) in fields.items():
            there = F.coalesce(F.map_contains_key(keys, f), F.lit(False))
            valid, value = check(F.try_element_at(keys, F.lit(f)))
            good = good & (~there | F.coalesce(valid, F.lit(False)))
            values.append(F.when(there, value.cast(kind)).otherwise(none[f]).alias(f))
        return F.when(good, F.struct(*values)).otherwise(F.struct(*(c.alias(f) for f, c in none.items())))

    text = F.coalesce(raw, F.lit(""))
    keys = let(of(text), lambda x: F.when(x["whole"], x["keys"]).otherwise(let(of(F.coalesce(balanced(text), F.lit(""))), lambda y: y["keys"])))
    return let(keys, coerced)


def parse_mapper(raw: Column) -> Column:
    return read(raw, MAPPER)


def parse_grader(raw: Column) -> Column:
    return read(raw, GRADER)


def two_decimals(x: Column | str) -> Column:
    """%.2f as Python rounds it: half to even on the binary value; null for what is no number."""
    x = F.col(x) if isinstance(x, str) else x
    endless = F.when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.when(~F.isnan(x), F.coalesce(endless, F.call_function("format_number", x, F.lit("0.00"))))

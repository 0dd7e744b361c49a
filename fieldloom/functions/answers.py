"""Strict JSON answers and their text form, without a UDF."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_TOKEN = rf"(?:{_NUMBER}|NaN|-?Infinity)"
_FLAT = rf"^\[[ \t\n\r]*{_TOKEN}(?:[ \t\n\r]*,[ \t\n\r]*{_TOKEN})*[ \t\n\r]*\]$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_answer(text: Column) -> Column:
    """struct(values array<double>, error): a flat JSON array of finite numbers, and nothing else.

    error is null, or invalid_json, not_nonempty_array, nonnumeric_item or nonfinite_number. Null text is invalid_json.
    """
    t = stripped(text)
    flat = t.rlike(_FLAT)
    items = F.split(F.regexp_replace(t, r"[\[\] \t\n\r]", ""), ",")
    values = F.transform(items, lambda x: x.try_cast("double"))
    bad = F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    # other JSON: bare NaN and Infinity count as numbers; the two wrappers defeat trailing text
    y = F.regexp_replace(t, r"(?<![\w\"])-?(?:NaN|Infinity)(?![\w\"])", "0")
    listed = F.try_parse_json(F.concat(F.lit("["), y, F.lit("]")))
    held = F.try_parse_json(F.concat(F.lit('{"k":'), y, F.lit("}")))
    json = listed.isNotNull() & held.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    array = F.try_variant_get(held, "$.k[0]", "variant").isNotNull()
    error = (
        F.when(t.isNull(), "invalid_json")
        .when(flat, F.when(bad, "nonfinite_number"))
        .when(~F.coalesce(json, F.lit(False)), "invalid_json")
        .when(array, "nonnumeric_item")
        .otherwise("not_nonempty_array")
    )
    return F.struct(F.when(flat & ~bad, values).alias("values"), error.alias("error"))


def answer_text(values: Column) -> Column:
    """[a,b] of doubles or integers as JSON."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: v.cast("string")), ", "), F.lit("]"))

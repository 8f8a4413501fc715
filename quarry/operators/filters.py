"""Typed metadata filters as one boolean column, so that they reach the scan, and their summary in words.

A filter is a dict from field to {"type": ..., "value": ...}: a list for category, {"min", "max"}
for number and date, a word for boolean, a text for text. All must hold. Missing cells never pass;
an empty filter value doesn't constrain.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import FALSE_WORDS, TRUE_WORDS, is_missing, parse_boolean, parse_date, parse_number

Filters = dict[str, dict[str, Any]]


def category(c: Column, values: list, is_array: bool = False) -> Column:
    """One of the values, whatever the case and the spaces around; of an array, any element."""
    wanted = sorted({str(v).strip().lower() for v in values})
    fold = lambda x: F.lower(F.trim(x.cast("string")))
    return F.exists(c, lambda x: fold(x).isin(wanted)) if is_array else fold(c).isin(wanted)


def number(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds included; plain numbers are compared as they are, so that the scan can skip row groups."""
    tests = [*([c >= F.lit(low)] if low is not None else []), *([c <= F.lit(high)] if high is not None else [])]
    return reduce(lambda a, b: a & b, tests, c.isNotNull())


def boolean(c: Column, value: Any) -> Column | None:
    word = str(value).strip().lower()
    if word not in (*TRUE_WORDS, *FALSE_WORDS):
        return None
    return parse_boolean(c) == F.lit(word in TRUE_WORDS)


def contains(c: Column, value: str) -> Column:
    """A text within the cell, whatever the case; no wildcards."""
    return F.contains(F.lower(c.cast("string")), F.lit(value.strip().lower()))


def date(c: Column, low: str | None = None, high: str | None = None, compat: bool = False, plain: bool = False) -> Column:
    """Bounds included; plain: the cell is a timestamp already, and the scan can skip by it; a last day counts as a whole. compat: cells that are no dates pass, and days end as they begin."""
    at = c if plain else parse_date(c)
    tests = []
    if low:
        tests.append(at >= F.lit(low).cast("timestamp"))
    if high:
        end = F.lit(high).cast("timestamp")
        tests.append(at <= end if compat or len(high) > 10 else at < end + F.expr("interval 1 day"))
    test = reduce(lambda a, b: a & b, tests, F.lit(True))
    return F.coalesce(test, F.lit(True)) if compat else at.isNotNull() & test


def condition(df: DataFrame, filters: Filters, compat: bool = False) -> Column:
    """All filters as one column. A field that the table lacks lets nothing pass."""
    tests: list[Column] = []
    for field, spec in filters.items():
        kind, value = spec["type"], spec.get("value")
        if value is None or value == "" or value == [] or value == {}:
            continue
        if field not in df.columns:
            return F.lit(False)
        c, dtype = F.col(f"`{field}`"), df.schema[field].dataType.typeName()
        if kind == "category":
            tests.append(category(c, value if isinstance(value, (list, tuple, set)) else [value], dtype == "array"))
        elif kind == "number":
            plain = dtype in ("byte", "short", "integer", "long", "float", "double", "decimal")
            tests.append(number(c if plain else parse_number(c), value.get("min"), value.get("max")))
        elif kind == "boolean":
            if (test := boolean(c, value)) is not None:
                tests.append(test)
        elif kind == "text":
            tests.append(contains(c, value))
        elif kind == "date":
            tests.append(date(c, value.get("min"), value.get("max"), compat, dtype in ("timestamp", "timestamp_ntz", "date")))
        else:
            raise ValueError(f"no filter type: {kind}")
        if kind in ("category", "text") and dtype == "string":
            tests.append(~is_missing(c))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def apply_filters(df: DataFrame, filters: Filters, compat: bool = False) -> DataFrame:
    return df.filter(condition(df, filters, compat))


def in_scope(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key, as text, is among the ids (their first column)."""
    wanted = ids.select(F.col(ids.columns[0]).cast("string").alias("_id")).distinct()
    return df.join(wanted, F.col(key).cast("string") == F.col("_id"), "left_semi")


def summarize(filters: Filters) -> str:
    """The filters in words."""
    out = []
    for field, spec in filters.items():
        value = spec.get("value")
        if isinstance(value, dict):
            out.append(field + "".join(f" {sign} {value[k]}" for k, sign in (("min", "≥"), ("max", "≤")) if value.get(k) is not None))
        elif isinstance(value, (list, tuple)):
            more = f" +{len(value) - 3} more" if len(value) > 3 else ""
            out.append(f"{field}: {', '.join(map(str, value[:3]))}{more}")
        elif value not in (None, ""):
            out.append(f"{field}: {value}")
    return "; ".join(out)

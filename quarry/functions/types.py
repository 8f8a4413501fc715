"""Types of cells that come as text: what a value looks like, and lenient booleans, numbers and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The spellings of truth and of missing cells.
TRUE_WORDS = ("true", "yes", "1", "y")
FALSE_WORDS = ("false", "no", "0", "n")
MISSING_WORDS = ("", "nan")


def is_missing(c: Column) -> Column:
    """Null, blank, or the text nan in any case."""
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin(*MISSING_WORDS)


def parse_boolean(c: Column) -> Column:
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False)


def parse_number(c: Column) -> Column:
    """Null unless finite."""
    n = c.cast("string").try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


#: How dates are written, as patterns and as formats; the first two are ISO 8601.
DATE_FORMS = {
    "date": (r"^\d{4}-\d{2}-\d{2}$", None),
    "timestamp": (r"^\d{4}-\d{2}-\d{2}[T ].+$", None),
    "month/day/year": (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"),
    "month-day-year": (r"^\d{2}-\d{2}-\d{4}$", "MM-dd-yyyy"),
}


def parse_date_as(c: Column, form: str) -> Column:
    """The timestamp of a cell that is written in that form and is a day of the calendar, else null."""
    pattern, written = DATE_FORMS[form]
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(pattern), t.try_cast("timestamp") if written is None else F.try_to_timestamp(t, F.lit(written)))


def parse_date(c: Column) -> Column:
    """The timestamp of a cell in any of the forms, or as a cast reads it."""
    return F.coalesce(*(parse_date_as(c, form) for form, (_, written) in DATE_FORMS.items() if written), c.cast("string").try_cast("timestamp"))


def infer_type(c: Column) -> Column:
    """boolean, number, date or text, by how a value is written; null for missing cells."""
    t = F.trim(c.cast("string"))
    return (
        F.when(is_missing(c), F.lit(None).cast("string"))
        .when(F.lower(t).isin("true", "false"), "boolean")
        .when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "number")
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$|^\d{2}/\d{2}/\d{4}$|^\d{2}-\d{2}-\d{4}$"), "date")
        .otherwise("text")
    )


def loose_type(c: Column) -> Column:
    """number, date, boolean or text, by a looser rule: numbers are trimmed and exact, dates only begin like one."""
    t = F.trim(c)
    return (
        F.when(F.lower(t).isin("true", "false"), "boolean")
        .when(t.rlike(r"^-?\d+(\.\d+)?$"), "number")
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}") & (F.length(t) > 8), "date")
        .otherwise("text")
    )

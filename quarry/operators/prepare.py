"""From uploaded rows to documents and passages: extraction, clean-up, exact duplicates, windows.

Every operator is a plan without actions. Rows have no order in Spark, so those that keep the
first of equals take the column that orders them.
"""

from __future__ import annotations

import re
import time

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.types import DATE_FORMS, infer_type, is_missing, loose_type, parse_date, parse_date_as, parse_number

#: A passage's window and overlap in characters, and the least length that is kept.
CHUNK_SIZE, CHUNK_OVERLAP, CHUNK_LEAST = 512, 128, 50
_INDEX_NAME = re.compile(r"\s*|unnamed:.*|__index__|index|\d+", re.IGNORECASE)


def metadata_columns(df: DataFrame, text: str) -> list[str]:
    """Columns that describe a document: not its text, and no row numbers of spreadsheets."""
    return [c for c in df.columns if c != text and not _INDEX_NAME.fullmatch(c)]


def extract_documents(df: DataFrame, text: str, ordinal: str | Column, as_given: bool = False) -> DataFrame:
    """id ("doc_" and the ordinal), text, has_empty_text and original_index, then the metadata columns.

    Numbers become text. Null, blank and "nan" cells are empty texts; as_given: cells stay as they are.
    """
    at = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    raw = T.trimmed(F.col(f"`{text}`").cast("string"))
    cell = F.col(f"`{text}`").cast("string") if as_given else F.when(is_missing(raw), "").otherwise(raw)
    own = {"id", "text", "original_index", "has_empty_text"}
    meta = [F.col(f"`{c}`") for c in metadata_columns(df, text) if c not in own]
    return df.select(F.concat(F.lit("doc_"), at.cast("string")).alias("id"), cell.alias("text"), (cell == "").alias("has_empty_text"), at.alias("original_index"), *meta)


def drop_empty(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.filter(~is_missing(F.col(text)))


def dedupe_exact(docs: DataFrame, text: str = "text", order: str = "doc_id", spaces: str = T.SPACES) -> DataFrame:
    """The first of each group of texts that are equal without the spaces around them, with all its columns; null orders come last.

    Tasks keep the first of each text before the shuffle, so a text in a third of all rows is a row
    a task. Of rows that repeat both text and order one stays.
    """
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(spaces))
    first = F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.struct(F.col(order).isNull(), F.col(order)))
    return docs.groupBy(F.xxhash64(trimmed).alias("_a"), F.xxhash64(F.lit(1), trimmed).alias("_b")).agg(first.alias("_row")).select("_row.*")


def duplicate_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: rows, empty, distinct texts and duplicates."""
    same = F.sha2(T.trimmed(F.coalesce(F.col(text), F.lit(""))), 256)
    groups = docs.groupBy(same.alias("same"), is_missing(F.col(text)).alias("empty")).agg(F.count("*").alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    return groups.agg(total.alias("n_rows"), F.coalesce(F.sum(F.when(F.col("empty"), F.col("n"))), F.lit(0)).cast("long").alias("n_empty"), F.count("*").alias("n_distinct"), (total - F.count("*")).alias("n_duplicates"))


def write_prepared(docs: DataFrame, path: str, text: str = "text", order: str = "doc_id") -> dict[str, float]:
    """Writes the documents that are neither empty nor duplicates; the counts are observed in the pass that writes.

    Gives n_rows, n_empty, n_duplicates, n_kept and seconds.
    """
    seen, kept, began = Observation("seen"), Observation("kept"), time.monotonic()
    rows = docs.observe(seen, F.count("*").alias("n_rows"), F.count_if(is_missing(F.col(text))).alias("n_empty"))
    dedupe_exact(drop_empty(rows, text), text, order).observe(kept, F.count("*").alias("n_kept")).write.parquet(path)
    out = seen.get | kept.get
    return out | {"n_duplicates": out["n_rows"] - out["n_empty"] - out["n_kept"], "seconds": time.monotonic() - began}


def chunk(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, least: int = CHUNK_LEAST) -> DataFrame:
    """Rows (parent_id, chunk_id, position, total_chunks, chunk_position, text, chunk_chars), then nothing else.

    position counts windows before short ones are dropped, so that it can have gaps. Rows are made
    where their text is; nothing is shuffled.
    """
    # the column is computed once and read many times in the lambda, so it is projected first
    cut = docs.select(F.col(key).alias("parent_id"), F.col(text).alias("_t")).filter(F.col("_t").isNotNull())
    found = cut.select("parent_id", T.windows(F.col("_t"), size, overlap).alias("all"), F.length("_t").alias("_n"))
    kept = found.select("parent_id", F.filter("all", lambda w: (F.length(w["text"]) >= least) | (F.col("_n") <= int(1.2 * size))).alias("kept"))
    rows = kept.select("parent_id", F.size("kept").alias("total_chunks"), F.explode("kept").alias("w"))
    return rows.select(
        "parent_id",
        F.concat_ws("_chunk_", F.col("parent_id").cast("string"), F.col("w.position").cast("string")).alias("chunk_id"),
        F.col("w.position").alias("position"),
        "total_chunks",
        F.concat_ws("/", (F.col("w.position") + 1).cast("string"), F.col("total_chunks").cast("string")).alias("chunk_position"),
        F.col("w.text").alias("text"),
        F.length("w.text").alias("chunk_chars"),
    )


def column_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: rows, non-empty, empty, and least, mean and greatest trimmed length, rounded."""
    t = T.trimmed(F.col(column).cast("string"))
    n = F.when(~is_missing(t), F.length(t))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count(n).alias("n_filled"),
        (F.count("*") - F.count(n)).alias("n_empty"),
        F.min(n).cast("long").alias("min_chars"),
        F.floor(F.avg(n) + 0.5).alias("mean_chars"),
        F.max(n).cast("long").alias("max_chars"),
    )


def text_column_report(df: DataFrame, column: str, looked_at: int = 100) -> DataFrame:
    """One row on the first rows: how many, how many filled, and whether the column will do as text."""
    head = df.select(F.col(column).cast("string").alias("t")).limit(looked_at)
    filled = F.count_if(~is_missing(F.col("t")))
    return head.agg(F.count("*").alias("looked_at"), filled.alias("filled"), (filled > 0).alias("usable"), (filled * 2 < F.count("*")).alias("sparse"))


def _cells(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Rows (name, value, at): the cells of the columns as text, and their row's place in the order."""
    cells = F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))
    return df.select(F.col(order).alias("at"), F.explode(cells).alias("c")).select("c.*", "at")


def metadata_schema(df: DataFrame, columns: list[str], order: str, sample: int = 10) -> DataFrame:
    """Per field: type (of its first filled cell), distinct values, the first of them by spelling, least and greatest number.

    Values are counted per field before they meet, so a field with few values is few rows.
    """
    filled = _cells(df, columns, order).filter(~is_missing(F.col("value")))
    values = filled.groupBy("name", "value").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    number = parse_number(F.col("value"))
    fields = values.groupBy("name").agg(F.min_by(infer_type(F.col("value")), "at").alias("type"), F.count("*").alias("n_values"), F.sum("n").alias("n_filled"), F.min(number).alias("lo"), F.max(number).alias("hi"))
    number_only = lambda c: F.when(F.col("type") == "number", F.col(c))
    firsts = values.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("value"))).filter(F.col("k") <= sample)
    listed = firsts.groupBy("name").agg(F.sort_array(F.collect_list("value")).alias("first_values"))
    return fields.select("name", "type", "n_values", "n_filled", number_only("lo").alias("min_value"), number_only("hi").alias("max_value")).join(listed, "name")


def metadata_schema_api(df: DataFrame, columns: list[str], order: str, sample: int = 10, nulls: bool = True) -> DataFrame:
    """Per field: type by the looser rule (first filled cell), distinct values with null as "null" (without nulls: left out), the first in the order, and rows."""
    value = F.coalesce("value", F.lit("null")) if nulls else F.col("value")
    values = _cells(df, columns, order).select("name", "at", value.alias("value"), F.col("value").isNotNull().alias("known"))
    distinct = values.groupBy("name", "value").agg(F.count("*").alias("n"), F.min("at").alias("at"), F.max("known").alias("known"))
    fields = distinct.groupBy("name").agg(F.min_by(loose_type(F.col("value")), F.when(F.col("known") & (F.col("value") != ""), F.col("at"))).alias("type"), F.count("value").alias("n_values"), F.sum("n").alias("n_rows"))
    firsts = distinct.filter("value is not null").withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("at", "value"))).filter(F.col("k") <= sample)
    listed = firsts.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("f"))
    return fields.join(listed, "name", "left").select("name", "type", "n_values", "n_rows", F.transform("f", lambda x: x["value"]).alias("unique_values"))


def upload_schema(df: DataFrame, columns: list[str], order: str, looked_at: int = 10) -> DataFrame:
    """Per field: type by its first looked_at rows, when a table is uploaded: integer, number, date, boolean, category or text."""
    head = df.orderBy(order).limit(looked_at)
    filled = _cells(head, columns, order).filter(~is_missing(F.col("value")))
    all_ = lambda test: F.coalesce(F.min(F.coalesce(test, F.lit(False))), F.lit(False))
    v = F.trim("value")
    seen = filled.groupBy("name").agg(
        all_(parse_number(v).isNotNull()).alias("number"),
        all_(~v.contains(".")).alias("whole"),
        all_(parse_date(v).isNotNull()).alias("date"),
        all_(F.lower(v).isin("true", "false", "yes", "no", "0", "1")).alias("boolean"),
        (F.count_distinct("value") <= F.greatest(F.lit(5.0), F.count("*") * 0.1)).alias("category"),
        F.count("*").alias("n_sampled"),
    )
    kind = F.when(F.col("number"), F.when(F.col("whole"), "integer").otherwise("number")).when(F.col("date"), "date").when(F.col("boolean"), "boolean").when(F.col("category"), "category").otherwise("text")
    return seen.select("name", kind.alias("type"), "n_sampled")


def date_formats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: the form in which all of its filled cells are dates (null if none), filled cells, and the first and last day.

    Where two forms of ISO 8601 are mixed, the form is "timestamp". All columns are counted in one pass.
    """
    cells = F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))
    filled = df.select(F.explode(cells).alias("c")).select("c.*").filter(~is_missing(F.col("value")))
    names = list(DATE_FORMS)
    each = filled.select("name", *(parse_date_as(F.col("value"), form).alias(f"d{k}") for k, form in enumerate(names)))
    counts = each.groupBy("name").agg(F.count("*").alias("n_filled"), *(F.count(f"d{k}").alias(f"n{k}") for k in range(len(names))), *(F.min(f"d{k}").alias(f"a{k}") for k in range(len(names))), *(F.max(f"d{k}").alias(f"b{k}") for k in range(len(names))))
    form = F.lit(None).cast("string")
    for k in range(len(names) - 1, -1, -1):
        form = F.when(F.col(f"n{k}") == F.col("n_filled"), names[k]).otherwise(form)
    form = F.when((F.col("n0") + F.col("n1") == F.col("n_filled")) & (F.col("n1") > 0), "timestamp").otherwise(form)
    day = lambda f, c: F.when(F.col("form").isNotNull(), f(*(F.col(f"{c}{k}") for k in range(len(names)))).cast("date"))
    return counts.withColumn("form", form).select("name", "form", "n_filled", day(F.least, "a").alias("first_day"), day(F.greatest, "b").alias("last_day"))


def with_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with each of the columns whose cells agree on a form of date cast to a timestamp by that form; the others stay."""
    forms = {r["name"]: r["form"] for r in date_formats(df, columns).collect()}  # a row per column
    return df.withColumns({c: parse_date_as(F.col(f"`{c}`"), forms[c]) for c in columns if forms.get(c)})


def searchable_text(df: DataFrame, text: str, reserved: tuple[str, ...] = ("id", "doc_id", "embedding"), longest: int = 500) -> Column:
    """The text and the other text columns of fewer than longest characters, joined by a space."""
    others = [f.name for f in df.schema if f.dataType.typeName() == "string" and f.name != text and f.name not in reserved]
    return F.concat_ws(" ", F.col(text), *(F.when(F.length(c) < longest, F.col(c)) for c in others))

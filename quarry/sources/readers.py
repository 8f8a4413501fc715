"""Tables from files: CSV, JSON, JSON lines, text, Excel and Parquet, by any path that Spark can read."""

from __future__ import annotations

import datetime
import io
import itertools
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Characters that XML can't hold.
_PLAIN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


#: A quote is escaped by a quote, and nothing else escapes; without the second entry the parser drops NUL characters near quotes.
_QUOTES = {"escape": '"', "charToEscapeQuoteEscaping": '"'}


def read_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Header row, inferred types, bad rows kept with nulls. Without multiline, quoted line ends split rows and files can be split between tasks.

    An empty cell is null, and one of two quotes is the empty text.
    """
    nothing = uuid.uuid4().hex  # what the parser puts for empty cells: no text is spelled so
    return spark.read.csv(path, header=True, inferSchema=True, multiLine=multiline, nullValue=nothing, emptyValue="", mode="PERMISSIVE", **_QUOTES)


def write_csv(df: DataFrame, path: str, at_most: int) -> None:
    """Files of at most so many rows, which read_csv() reads as they were: nulls are empty cells, empty texts two quotes."""
    df.write.option("maxRecordsPerFile", at_most).csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n", **_QUOTES)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, or one object, per file; columns are the union of all keys."""
    return spark.read.json(path, multiLine=True)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def write_json_arrays(rows: DataFrame, path: str, at_most: int) -> None:
    """Files of an array of objects each, from rows (value) of one object's JSON; a file holds at most so many."""

    def arrays(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, at_most):
                yield pa.RecordBatch.from_arrays([pa.array(["[" + ",".join(batch.column(0).slice(at, at_most).to_pylist()) + "]"])], names=["value"])

    rows.select("value").mapInArrow(arrays, "value string").write.option("maxRecordsPerFile", 1).text(path)


def read_text(spark: SparkSession, path: str, file: bool = False, through: bool = False) -> DataFrame:
    """Rows (text, line_number), and file if asked for: the lines that aren't blank, numbered from 1 in each file.

    through: numbers go on from file to file, in order of their paths, so that a folder is numbered as one text.

    Lines are counted per block of a file, and a block's lines take the count of the blocks before
    it, so that no file is sorted or read by one task.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    lines = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("text"), *place).filter(F.trim("text").rlike(r"\S"))
    lines = lines.withColumn("_id", F.monotonically_increasing_id())
    blocks = lines.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(_by_file(through)) - F.col("_n")
    offsets = blocks.select("_file", "_block", (before - F.col("_first") + 1).alias("_shift"))
    return lines.join(offsets, ["_file", "_block"]).select("text", (F.col("_id") + F.col("_shift")).alias("line_number"), *([F.col("_file").alias("file")] if file else []))


def _by_file(through: bool):
    from pyspark.sql import Window

    window = Window.orderBy("_file", "_block") if through else Window.partitionBy("_file").orderBy("_block")  # a row per block
    return window.rowsBetween(Window.unboundedPreceding, 0)


def _column(reference: str) -> int:
    at = 0
    for c in re.match("[A-Z]+", reference)[0]:
        at = at * 26 + ord(c) - 64
    return at - 1


#: Number formats of the standard that show a date or a time, and the day from which serial numbers count.
DATE_STYLES = frozenset((*range(14, 23), *range(45, 48)))
_DAY_ZERO = datetime.datetime(1899, 12, 30)


def _date_cells(parse, names: list[str]) -> list[bool]:
    """For each style of a workbook's cells, whether it shows a date."""
    if "xl/styles.xml" not in names:
        return []
    styles = parse("xl/styles.xml")
    own = {int(x.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", x.get("formatCode", "")) for x in styles.iter(f"{_MAIN}numFmt")}
    shows = lambda k: k in DATE_STYLES or bool(re.search("[ymdhs]", own.get(k, "").lower()))
    cells = styles.find(f"{_MAIN}cellXfs")
    return [shows(int(x.get("numFmtId", 0))) for x in cells] if cells is not None else []


def _as_date(value: str) -> str:
    """A serial number as ISO 8601: a day, or with a time if it has one."""
    at = _DAY_ZERO + datetime.timedelta(seconds=round(float(value) * 86400))
    return at.date().isoformat() if at.time() == datetime.time() else at.isoformat(sep=" ")


def _sheet(content: bytes) -> Iterator[list[str]]:
    """Rows of a workbook's first sheet, one at a time, cells as strings; missing ones are empty, dates are ISO 8601."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parse = lambda name: ElementTree.fromstring(z.read(name))
        text = lambda x: "".join(t.text or "" for t in x.iter(f"{_MAIN}t"))
        shared = [text(x) for x in parse("xl/sharedStrings.xml").iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        dates = _date_cells(parse, z.namelist())
        first = next(parse("xl/workbook.xml").iter(f"{_MAIN}sheet")).get(_REL)
        target = next(x.get("Target") for x in parse("xl/_rels/workbook.xml.rels") if x.get("Id") == first)
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as stream:
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[str] = []
                for cell in row.iter(f"{_MAIN}c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    value, kind, style = cell.findtext(f"{_MAIN}v") or "", cell.get("t", "n"), int(cell.get("s", 0))
                    if kind == "s":
                        value = shared[int(value)] if value else ""
                    elif kind == "inlineStr":
                        value = text(cell)
                    elif kind == "b":
                        value = {"1": "true", "0": "false"}.get(value, value)
                    elif kind == "n" and value and style < len(dates) and dates[style]:
                        value = _as_date(value)
                    cells[at] = value
                row.clear()
                yield cells


def _sheets(batches):
    """Rows (path, names, row, cells): a file's own first row names its cells."""
    kinds = [("path", pa.string()), ("names", pa.list_(pa.string())), ("row", pa.int32()), ("cells", pa.list_(pa.string()))]
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows = _sheet(content.as_py())
            names = [n or f"column_{i + 1}" for i, n in enumerate(next(rows, []))]
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([names], kinds[1][1]), pa.array([0], pa.int32()), pa.array([[]], kinds[3][1])], schema=pa.schema(kinds))
            at = 0
            while some := [(cells + [""] * len(names))[: len(names)] for cells in itertools.islice(rows, 4096)]:
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(some)), pa.array([names] * len(some), kinds[1][1]), pa.array(range(at + 1, at + 1 + len(some)), pa.int32()), pa.array(some, kinds[3][1])], schema=pa.schema(kinds))
                at += len(some)


def from_workbooks(files: DataFrame) -> DataFrame:
    """The first sheet of each workbook of rows (path, content), all columns strings; columns are those of all files' first rows.

    A cell that its file lacks is empty. A file is one task and is parsed row by row.
    """
    cells = files.select("path", "content").mapInArrow(_sheets, "path string, names array<string>, row int, cells array<string>")
    heads = cells.filter("row = 0").select(F.posexplode("names").alias("at", "name")).groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name").collect()  # a row per column
    place = lambda n: F.array_position("names", n)
    return cells.filter("row > 0").select(*(F.when(place(h["name"]) > 0, F.get("cells", place(h["name"]).cast("int") - 1)).otherwise("").alias(h["name"]) for h in heads))


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """from_workbooks() of the .xlsx files at a path; the format holds at most 1,048,576 rows a file."""
    if path.lower().endswith(".xls"):
        raise ValueError("binary .xls workbooks can't be read; save them as .xlsx")
    return from_workbooks(spark.read.format("binaryFile").load(path).select("path", "content"))


def to_workbooks(df: DataFrame, at_most: int = 10_000) -> DataFrame:
    """Rows (path, content): .xlsx workbooks of at most so many rows each, with a row of names, all cells text."""
    names = df.columns
    cell = lambda v: f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_PLAIN.sub("", v))}</t></is></c>'

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, at_most):
                part = batch.slice(at, at_most)
                rows = [names, *zip(*(("" if v is None else v for v in c.to_pylist()) for c in part.columns), strict=True)]
                sheet = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-3]}"><sheets><sheet name="1" sheetId="1" r:id="rId1"/></sheets></workbook>')
                    z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
                    z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{sheet}</sheetData></worksheet>')
                yield pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4().hex}.xlsx"]), pa.array([out.getvalue()], pa.binary())], names=["path", "content"])

    return df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in names)).mapInArrow(run, "path string, content binary")


#: Readers by file extension.
READERS = {"csv": read_csv, "json": read_json, "jsonl": read_jsonl, "txt": read_text, "xlsx": read_excel, "xls": read_excel, "parquet": lambda spark, path: spark.read.parquet(path)}


def load_table(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    kind = (format or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if kind not in READERS:
        raise ValueError(f"unsupported file type {kind!r}; use one of {', '.join(READERS)}")
    return READERS[kind](spark, path)


def preview(df: DataFrame, n: int = 5) -> tuple[list[str], DataFrame, int]:
    """Columns, first rows, and the count of all rows."""
    return df.columns, df.limit(n), df.count()

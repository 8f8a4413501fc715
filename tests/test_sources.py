"""Readers and saved datasets: round trips on small files."""

import json
import zipfile

import pytest

from quarry.sources import datasets, readers


def _xlsx(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="A" r:id="r2"/><sheet name="B" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/other.xml"/><Relationship Id="r2" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>text</t></si><si><r><t>a</t></r><r><t> b</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c><c r="C1" t="str"><v>ok</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2" t="b"><v>1</v></c></row><row><c r="B3"><v>2.5</v></c></row></sheetData></worksheet>')


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,n\n"two\nlines, ""quoted""",1\nplain,2\n')
    assert [tuple(r) for r in readers.load_table(spark, f"{tmp_path}/a.csv").orderBy("n").collect()] == [('two\nlines, "quoted"', 1), ("plain", 2)]
    (tmp_path / "a.json").write_text(json.dumps([{"text": "x"}, {"text": "y", "n": 3}]))
    assert {(r["text"], r["n"]) for r in readers.load_table(spark, f"{tmp_path}/a.json").collect()} == {("x", None), ("y", 3)}
    (tmp_path / "one.json").write_text('{\n"text": "x"}')
    assert readers.preview(readers.load_table(spark, f"{tmp_path}/one.json"))[2] == 1
    _xlsx(tmp_path / "a.xlsx")
    sheet = readers.load_table(spark, f"{tmp_path}/a.xlsx")
    assert sheet.columns == ["text", "n", "ok"]
    assert sorted(tuple(r) for r in sheet.collect()) == [("", "2.5", ""), ("a b", "", "true")]
    with pytest.raises(ValueError, match="unsupported"):
        readers.load_table(spark, "a.doc")
    with pytest.raises(ValueError, match="xlsx"):
        readers.load_table(spark, "a.xls")


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    lines = [f"line {i}" if i % 3 else " " for i in range(4000)]
    (tmp_path / "a.txt").write_text("\r\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = readers.load_table(spark, f"{tmp_path}/a.txt").orderBy("line_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [tuple(r) for r in got] == [(t, n + 1) for n, t in enumerate(t for t in lines if t.strip())]


def test_lines_are_numbered_through_the_files_of_a_folder(spark, tmp_path):
    for name, count in (("b", 700), ("a", 900), ("c", 1)):
        (tmp_path / f"{name}.txt").write_text("\n".join(f"{name} {i:04}" for i in range(count)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = readers.read_text(spark, str(tmp_path), through=True).orderBy("line_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [tuple(r) for r in got] == [(t, n + 1) for n, t in enumerate([f"a {i:04}" for i in range(900)] + [f"b {i:04}" for i in range(700)] + ["c 0000"])]
    assert {(r["text"][0], r["line_number"]) for r in readers.read_text(spark, str(tmp_path), file=True).filter("line_number in (1, 700)").collect()} == {("a", 1), ("b", 1), ("c", 1), ("a", 700), ("b", 700)}


def test_csv_files_hold_a_bounded_number_of_rows(spark, monkeypatch):
    from quarry.plans import source_queries

    paths, load = [], readers.load_table
    monkeypatch.setattr(source_queries, "CSV_ROWS", 30)
    monkeypatch.setattr(source_queries.readers, "load_table", lambda spark, path: (paths.append(path), load(spark, path))[1])
    assert source_queries.src_csv(spark, "/root/testdata/sf0.001").count() == 200
    per_file = spark.read.csv(paths[0], header=True, multiLine=True, escape='"').groupBy("_metadata.file_path").count().agg({"count": "max"}).first()[0]
    assert per_file <= 30


def test_datasets(spark, tmp_path):
    root = f"{tmp_path}/store"
    docs, vectors = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, [0.5])], "doc_id long, embedding array<double>")
    assert datasets.catalog(spark, root).isEmpty()
    with pytest.raises(ValueError, match="embeddings"):
        datasets.save(spark, root, "x", {"documents": docs})
    datasets.save(spark, root, "x", {"documents": docs, "embeddings": vectors})
    datasets.save(spark, root, "y", {"documents": docs, "embeddings": vectors})
    datasets.save(spark, root, "x", {"documents": docs.union(docs), "embeddings": vectors})
    assert [r["name"] for r in datasets.catalog(spark, root).collect()] == ["x", "y"]
    assert datasets.load(spark, root, "x")["documents"].count() == 2
    datasets.delete(spark, root, "x")
    assert not datasets.exists(spark, root, "x") and datasets.exists(spark, root, "y")
    with pytest.raises(ValueError, match="no dataset"):
        datasets.load(spark, root, "x")


def test_conversation_csv(spark, tmp_path):
    schema = "timestamp string, query string, answer string, sources array<string>, model string, temperature double"
    log = spark.createDataFrame([("t", 'say "hi"', "a,b", ["1", "2"], "m", 0.5), ("u", "q", "r", None, "m", 0.0)], schema)
    datasets.write_conversation(log, f"{tmp_path}/log")
    got = readers.read_csv(spark, f"{tmp_path}/log").orderBy("timestamp").collect()
    assert [(r["query"], r["num_sources"], r["source_ids"]) for r in got] == [('say "hi"', 2, "1|2"), ("q", 0, None)]


def test_workbooks_with_their_own_headers_and_dates(spark, tmp_path):
    def book(name, header, rows):
        main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        cells = lambda row: "".join(f'<c s="{s}"><v>{v}</v></c>' if isinstance(v, float) else f'<c t="inlineStr"><is><t>{v}</t></is></c>' for v, s in row)
        sheet = "".join(f"<row>{cells(r)}</row>" for r in ([(h, 0) for h in header], *rows))
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="1" sheetId="1" r:id="rId1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy hh:mm"/><numFmt numFmtId="171" formatCode="0.0&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')

    book("a.xlsx", ["when", "n"], [[(45292.0, 1), (45292.0, 0)], [(45292.75, 2), (2.5, 3)]])
    book("b.xlsx", ["n", "extra", ""], [[("x", 0), ("y", 0), ("z", 0)], [("only", 0)]])
    book("c.xlsx", [], [])
    got = readers.read_excel(spark, f"{tmp_path}/*.xlsx")
    assert set(got.columns) == {"when", "n", "extra", "column_3"}
    rows = sorted(tuple(r[c] for c in ("when", "n", "extra", "column_3")) for r in got.collect())
    assert rows == [("", "only", "", ""), ("", "x", "y", "z"), ("2024-01-01", "45292.0", "", ""), ("2024-01-01 18:00:00", "2.5", "", "")]

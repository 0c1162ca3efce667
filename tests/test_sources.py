"""Readers, writers and streams on small files."""

import io
import zipfile

from pyspark.sql import functions as F

from palimpsest.sources import files, tables
from palimpsest.streaming import ledger


def archive(path, parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    path.write_bytes(data.getvalue())


def read(spark, folder, extension):
    return [(r.kind, r.page, r.text) for r in files.read_files(spark, str(folder), extension).orderBy("path", "ordinal").collect()]


def test_office_files(spark, tmp_path):
    w = 'xmlns:w="w"'
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    archive(tmp_path / "a.docx", {"word/document.xml": body})
    (tmp_path / "b.docx").write_bytes(b"no archive")
    got = read(spark, tmp_path, "docx")
    assert got[:3] == [("heading", None, "Title"), ("paragraph", None, "One two"), ("table_row", None, "a | b")]
    assert got[3][0] == "error" and len(got) == 4
    archive(tmp_path / "a.xlsx", {"xl/sharedStrings.xml": "<sst><si><t>word</t></si></sst>", "xl/worksheets/sheet1.xml": '<s><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>7</v></c></row></s>'})
    assert read(spark, tmp_path, "xlsx") == [("heading", 1, "Sheet 1"), ("table_row", 1, "A1=word | B1=7")]
    slide = lambda t: f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sld>'
    archive(tmp_path / "a.pptx", {"ppt/slides/slide2.xml": slide("two"), "ppt/slides/slide10.xml": slide("ten")})
    assert read(spark, tmp_path, "pptx") == [("paragraph", 1, "two"), ("paragraph", 2, "ten")]
    archive(tmp_path / "a.epub", {"META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>', "o/p.opf": '<p><item id="i" href="x.html"/><itemref idref="i"/></p>', "o/x.html": "<h1>A</h1><p>b <i>c</i></p>"})
    assert read(spark, tmp_path, "epub") == [("heading", 1, "A"), ("paragraph", 1, "b c")]


def test_office_notes_and_bombs(spark, tmp_path):
    w = 'xmlns:w="w"'
    notes = f'<w:footnotes {w}><w:footnote w:type="separator"><w:p><w:r><w:t>-</w:t></w:r></w:p></w:footnote><w:footnote><w:p><w:r><w:t>See below.</w:t></w:r></w:p></w:footnote></w:footnotes>'
    archive(tmp_path / "n.docx", {"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p></w:body></w:document>", "word/footnotes.xml": notes})
    assert read(spark, tmp_path, "docx") == [("paragraph", None, "One"), ("footnote", None, "See below.")]
    bomb = '<!DOCTYPE x [<!ENTITY a "aaaaaaaaaa"><!ENTITY b "&a;&a;&a;&a;">]><s><row><c r="A1"><v>&b;</v></c></row></s>'
    archive(tmp_path / "n.xlsx", {"xl/workbook.xml": '<w><sheet name="Fees"/></w>', "xl/worksheets/sheet1.xml": '<s><row><c r="A1"><v>7</v></c></row></s>'})
    archive(tmp_path / "o.xlsx", {"xl/worksheets/sheet1.xml": bomb})
    assert [(k, t[:12]) for k, _, t in read(spark, tmp_path, "xlsx")] == [("heading", "Fees"), ("table_row", "A1=7"), ("error", "ValueError: ")]
    cell = "<a:tc><a:p><a:r><a:t>{}</a:t></a:r></a:p></a:tc>"
    archive(tmp_path / "n.pptx", {
        "ppt/slides/slide1.xml": f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>x</a:t></a:r></a:p><a:tbl><a:tr>{cell.format("a")}{cell.format("b")}</a:tr></a:tbl></p:sld>',
        "ppt/notesSlides/notesSlide1.xml": '<p:n xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>say</a:t></a:r></a:p></p:n>',
    })
    assert read(spark, tmp_path, "pptx") == [("paragraph", 1, "x"), ("table_row", 1, "a | b"), ("note", 1, "say")]


def test_html_and_text(spark, tmp_path):
    (tmp_path / "a.html").write_text("<body>lost<h2>Head</h2><ul><li>one<li>two</ul><p>p &amp; q<script>x</script></p></body>")
    assert read(spark, tmp_path, "html")[:3] == [("heading", None, "Head"), ("list_item", None, "one"), ("list_item", None, "two")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one\r\n\r\n two  three\n")
    assert [(r.ordinal, r.text) for r in files.read_text(spark, str(tmp_path / "t")).orderBy("ordinal").collect()] == [(1, "one"), (3, "two three")]


def test_markdown_delimited_json(spark, tmp_path):
    md = "---\nkey: v\n---\n# Head\ntext\n- item\n```\n# code\n```\n| a | b |\n"
    got = [(r.kind, r.level, r.text) for r in files.markdown_nodes(spark.createDataFrame([("m", md), ("n", None)], "path string, text string")).orderBy("line_no").collect()]
    assert got == [("property", None, "key: v"), ("heading", 1, "Head"), ("list_item", None, "- item"), ("code", None, "# code"), ("table", None, "| a | b |")]
    # A fence in the first line, an open fence at the end, indented fences, no line end at the end, and front matter without an end.
    for md, want in [
        ("```\n# a\n```\n# b", [(1, "code"), (3, "heading")]), ("# a\n  ~~~\n- b\n\n# c", [(0, "heading"), (2, "code"), (3, "code"), (4, "code")]), ("---\nk: v\n- x", [(2, "list_item")]),
        ("---\nk: v\nj: w\n---", [(1, "property"), (2, "property")]), ("```\n```\n```\nx\n", [(3, "code"), (4, "code")]), ("", []), ("# a\n" * 20_000, [(i, "heading") for i in range(20_000)]),
    ]:
        assert [(r.line_no, r.kind) for r in files.markdown_nodes(spark.createDataFrame([("m", md)], "path string, text string")).orderBy("line_no").collect()] == want
    (tmp_path / "a.csv").write_text("x,y\n1,\n2,b\n")
    assert {tuple(r) for r in files.delimited_nodes(spark, str(tmp_path / "a.csv")).collect()} == {("header", "x | y"), ("row", "1 | "), ("row", "2 | b")}
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": {"c": "d"}}\nbad{\n')
    assert {(r.pointer, r.value) for r in files.json_nodes(spark, str(tmp_path / "a.jsonl")).collect()} == {("/a", "1"), ("/b/c", '"d"'), ("/error", "bad{")}


def test_release_export_package(spark, tmp_path):
    df = spark.createDataFrame([("d", 2, "paragraph", "body"), ("d", 1, "heading", "Head"), ("e", 1, "paragraph", None)], "document_id string, ordinal int, kind string, text string")
    root = f"file://{tmp_path}/release"
    tables.write_release(spark, root, {"blocks": df.limit(1)})
    tables.write_release(spark, root, {"blocks": df})
    assert tables.read_release(spark, root, "blocks").count() == 3
    tables.export_markdown(df, f"file://{tmp_path}/md", 2)
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "md").rglob("*.txt")))
    assert text.index("## Head") < text.index("body")
    tables.export_package({"blocks": df}, f"file://{tmp_path}/pack")
    (tmp_path / "pack" / "blocks" / "bad.json").write_text("{broken\n")
    back = tables.import_package(spark, f"file://{tmp_path}/pack", "blocks", "document_id string, ordinal int, kind string, text string").cache()
    assert back.where("_corrupt is not null").count() == 1 and back.where("_corrupt is null").count() == 3


def test_streams(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    rows = [(1, "2024-01-01 00:00:10", 1, "a", 1.0), (2, "2024-01-01 00:00:50", 1, "a", 2.0), (2, "2024-01-01 00:00:50", 1, "a", 2.0), (3, "2024-01-01 03:00:00", 2, "b", 1.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{tmp_path}/events")
    events = ledger.event_stream(spark, f"{tmp_path}/events", schema)
    q = ledger.windowed_counts(events, "1 minute").writeStream.format("memory").queryName("w1").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.event_type, r.n, r.value) for r in spark.table("w1").collect()] == [("a", 2, 3.0)]
    plain = spark.readStream.schema(schema).parquet(f"{tmp_path}/events")
    q = plain.writeStream.foreachBatch(ledger.keep_latest(f"file://{tmp_path}/latest", ["user_id"], ["ts", "event_id"])).option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.user_id, r.event_id) for r in ledger.latest_state(spark, f"file://{tmp_path}/latest", schema).collect()} == {(1, 2), (2, 3)}
    items = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "id int, until int")
    assert [r.id for r in ledger.expired(items, "until", F.lit(5)).collect()] == [1]




def test_latest_state_loses_nothing(spark, tmp_path):
    path, schema = f"file://{tmp_path}/state", "k string, at int, v string"
    merge = ledger.keep_latest(path, ["k"], ["at"], buckets=4)
    put = lambda batch, *rows: merge(spark.createDataFrame(rows, schema), batch)
    state = lambda: {tuple(r) for r in ledger.latest_state(spark, path, schema).collect()}
    assert state() == set()
    put(0, ("a", 1, "x"), ("b", 5, "y"), (None, 1, "n"))
    put(2, ("c", 1, "z"), ("b", 4, "late"))
    want = {("a", 1, "x"), ("b", 5, "y"), ("c", 1, "z"), (None, 1, "n")}
    assert state() == want
    put(2, ("c", 1, "z"), ("b", 4, "late"))
    assert state() == want
    put(0, ("a", 3, "again"))
    assert state() == want - {("a", 1, "x")} | {("a", 3, "again")}
    put(1)
    assert state() == want - {("a", 1, "x")} | {("a", 3, "again")}
    assert len(list((tmp_path / "state").glob("state-*.json"))) == 2


def test_release_pointer_is_replaced_in_one_step(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    for i in range(3):
        tables.write_release(spark, root, {"t": spark.range(i + 1)})
        assert tables.read_release(spark, root, "t").count() == i + 1
    assert not list((tmp_path / "r").glob(".new-*"))

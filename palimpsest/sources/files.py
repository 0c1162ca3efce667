"""File formats to one row per block: path, ordinal, kind, page, text.

Plain text, delimited, JSON lines and Markdown are read by Spark's own readers and expressions. Zipped XML formats and
HTML go through ``binaryFile`` and a small parser per file inside ``mapInArrow``; a file that can't be parsed gives one
row of kind ``error``, so one bad file doesn't end a job.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import squeeze
from palimpsest.plans.session import in_arrow

BLOCK_SCHEMA = "path string, ordinal int, kind string, page int, text string"
# Elements of HTML that become blocks.
HTML_BLOCKS = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "p": "paragraph", "li": "list_item", "pre": "code_block", "code": "code_block", "td": "cell", "th": "cell", "figcaption": "caption"}


# Bound on one unzipped member; a file with a larger one gives an error row.
MAX_MEMBER_BYTES = 256 << 20


def _member(z: zipfile.ZipFile, name: str) -> bytes:
    if z.getinfo(name).file_size > MAX_MEMBER_BYTES:
        raise ValueError(f"{name} is larger than {MAX_MEMBER_BYTES} bytes")
    with z.open(name) as f:
        data = f.read(MAX_MEMBER_BYTES + 1)
    if len(data) > MAX_MEMBER_BYTES:
        raise ValueError(f"{name} is larger than {MAX_MEMBER_BYTES} bytes")
    return data


def _xml(z: zipfile.ZipFile, name: str):
    """A member as XML; one that declares a document type could hold entities that grow without end and is refused."""
    data = _member(z, name)
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError(f"{name} declares a document type")
    return ElementTree.fromstring(data)


def _inner(element, tag: str) -> str:
    return "".join(x.text or "" for x in element.iter() if x.tag.rpartition("}")[2] == tag)


def _named(root, tag: str):
    return (x for x in root.iter() if x.tag.rpartition("}")[2] == tag)


def _docx(data: bytes) -> Iterator[tuple[str, int | None, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(_named(_xml(z, "word/document.xml"), "body"))
        notes = [(kind, note) for kind in ("footnote", "endnote") if f"word/{kind}s.xml" in z.namelist() for note in _named(_xml(z, f"word/{kind}s.xml"), kind)]
    for part in body:
        tag = part.tag.rpartition("}")[2]
        if tag == "p":
            style = next((v for s in _named(part, "pStyle") for k, v in s.attrib.items() if k.endswith("val")), "")
            yield "heading" if re.match("(?i)heading|title", style) else "paragraph", None, _inner(part, "t")
        elif tag == "tbl":
            for row in _named(part, "tr"):
                yield "table_row", None, " | ".join(_inner(cell, "t") for cell in _named(row, "tc"))
    for kind, note in notes:
        # Notes with a type draw lines only.
        if not any(k.endswith("type") for k in note.attrib):
            yield kind, None, _inner(note, "t")


def _numbered(names: list[str], pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def _pptx(data: bytes) -> Iterator[tuple[str, int | None, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for page, name in enumerate(_numbered(z.namelist(), r"ppt/slides/slide(\d+)\.xml"), 1):
            slide = _xml(z, name)
            in_tables = {p for table in _named(slide, "tbl") for p in _named(table, "p")}
            for p in _named(slide, "p"):
                if p not in in_tables:
                    yield "paragraph", page, _inner(p, "t")
            for table in _named(slide, "tbl"):
                for row in _named(table, "tr"):
                    yield "table_row", page, " | ".join(_inner(cell, "t") for cell in _named(row, "tc"))
            notes = re.sub(r"slides/slide(\d+)", r"notesSlides/notesSlide\1", name)
            if notes in z.namelist():
                for p in _named(_xml(z, notes), "p"):
                    yield "note", page, _inner(p, "t")


def _xlsx(data: bytes) -> Iterator[tuple[str, int | None, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [_inner(s, "t") for s in _named(_xml(z, "xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in z.namelist() else []
        titles = [s.get("name") for s in _named(_xml(z, "xl/workbook.xml"), "sheet")] if "xl/workbook.xml" in z.namelist() else []
        for page, name in enumerate(_numbered(z.namelist(), r"xl/worksheets/sheet(\d+)\.xml"), 1):
            yield "heading", page, titles[page - 1] if page <= len(titles) else f"Sheet {page}"
            for row in _named(_xml(z, name), "row"):
                cells = []
                for c in _named(row, "c"):
                    value = _inner(c, "v") if c.get("t") != "inlineStr" else _inner(c, "t")
                    cells.append(f"{c.get('r')}={shared[int(value)] if c.get('t') == 's' else value}")
                yield "table_row", page, " | ".join(cells)


class _Blocks(HTMLParser):
    """Text inside the chosen elements; opening one ends the one before."""

    def __init__(self):
        super().__init__()
        self.out, self.tag, self.text = [], None, []

    def flush(self):
        if self.tag:
            self.out.append((HTML_BLOCKS[self.tag], None, " ".join("".join(self.text).split())))
        self.tag, self.text = None, []

    def handle_starttag(self, tag, attrs):
        if tag in HTML_BLOCKS:
            self.flush()
            self.tag = tag

    def handle_endtag(self, tag):
        if tag == self.tag:
            self.flush()

    def handle_data(self, data):
        if self.tag:
            self.text.append(data)


def _html(data: bytes) -> Iterator[tuple[str, int | None, str]]:
    parser = _Blocks()
    parser.feed(data.decode("utf-8", "replace"))
    parser.flush()
    return iter(parser.out)


def _epub(data: bytes) -> Iterator[tuple[str, int | None, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        package = next(r.get("full-path") for r in _named(_xml(z, "META-INF/container.xml"), "rootfile"))
        root = _xml(z, package)
        items = {i.get("id"): i.get("href") for i in _named(root, "item")}
        base = package.rpartition("/")[0]
        for page, ref in enumerate(_named(root, "itemref"), 1):
            for kind, _, text in _html(_member(z, f"{base}/{items[ref.get('idref')]}".lstrip("/"))):
                yield kind, page, text


PARSERS = {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx, "html": _html, "htm": _html, "epub": _epub}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                blocks = [b for b in PARSERS[path.rpartition(".")[2].lower()](data) if b[2].strip()]
            except Exception as error:  # noqa: BLE001 - a broken file is a row, not the end of the job
                blocks = [("error", None, f"{type(error).__name__}: {error}"[:500])]
            n = len(blocks)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * n, pa.string()), pa.array(range(1, n + 1), pa.int32()), pa.array([b[0] for b in blocks], pa.string()), pa.array([b[1] for b in blocks], pa.int32()), pa.array([b[2] for b in blocks], pa.string())],
                names=["path", "ordinal", "kind", "page", "text"],
            )


def read_files(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """Blocks of all files with the extension (docx, pptx, xlsx, html, epub) below a folder."""
    if extension not in PARSERS:
        raise ValueError(f"no reader for {extension}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").option("recursiveFileLookup", "true").load(folder)
    return in_arrow(files.select("path", "content"), _parse, BLOCK_SCHEMA)


def read_text(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of plain text files: one per non-empty line."""
    whole = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    lines = whole.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split(F.regexp_replace("value", r"\r\n?", "\n"), "\n")).alias("n", "line"))
    return lines.select("path", (F.col("n") + 1).alias("ordinal"), F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("page"), squeeze(F.col("line")).alias("text")).where("text <> ''")


def markdown_nodes(texts: DataFrame) -> DataFrame:
    """(path, line_no, kind, level, text) of Markdown texts (path, text): heading, list_item, table, code line, property.

    Lines of fenced code belong to the fence that opened before them: the text is split at its fence lines, so a line's
    part tells whether it is fenced, and each line is looked at once. Properties stand between ``---`` in the first line
    and the next ``---``. Other lines are dropped. Null texts have no lines.
    """
    text = F.col("text")
    head = F.substring_index(F.concat(text, F.lit("\n")), "\n---\n", 1)
    closing = F.when(text.startswith("---\n") & (F.length(head) <= F.length(text)), F.regexp_count(head, F.lit("\n")) + 1).otherwise(0)
    # Fence lines stay at the head of the part they begin: odd parts are code.
    parts = F.split(text, r"(?m)^(?=[^\S\n]*(?:```|~~~))", -1)
    lines_of = lambda part: F.split(part, "\n", -1)
    cells = F.flatten(
        F.transform(
            parts,
            # A part that ends with its line end has an empty last cell, which belongs to the next part's first line.
            lambda part, i: F.transform(
                F.when((i < F.size(parts) - 1) & part.endswith("\n"), F.slice(lines_of(part), F.lit(1), F.size(lines_of(part)) - 1)).otherwise(lines_of(part)),
                lambda line: F.struct(line.alias("line"), i.alias("part")),
            ),
        )
    )
    starts_fenced = text.rlike(r"\A[^\S\n]*(?:```|~~~)")
    rows = texts.select("path", closing.alias("front"), starts_fenced.alias("early"), F.posexplode(cells).alias("n", "c")).select("path", "front", "early", "n", "c.line", "c.part")
    line = F.col("line")
    # Without an empty first part, a text that begins with a fence has its first code in part 0.
    fence = F.pmod(F.col("part") + F.col("early").cast("int"), F.lit(2)) == 1
    kind = (
        F.when((F.col("n") > 0) & (F.col("n") < F.col("front")) & line.rlike(r"^[\w-]+:"), "property").when(line.rlike(r"^\s*(```|~~~)"), None).when(fence, "code").when(line.rlike(r"^#{1,6} "), "heading")
        .when(line.rlike(r"^\s*([-*+]|\d+[.)]) "), "list_item").when(F.regexp_count(line, F.lit(r"\|")) >= 2, "table")
    )
    level = F.when(kind == "heading", F.length(F.regexp_extract(line, r"^(#+)", 1)))
    return rows.select("path", F.col("n").alias("line_no"), kind.alias("kind"), level.alias("level"), F.when(kind == "heading", F.trim(F.regexp_replace(line, r"^#{1,6} ", ""))).otherwise(F.rtrim(line)).alias("text")).where("kind is not null")


def delimited_nodes(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(kind, text) of a delimited file: its header and its rows, cells joined by `` | ``."""
    df = spark.read.option("sep", separator).option("header", "true").csv(path)
    header = spark.createDataFrame([("header", " | ".join(df.columns))], "kind string, text string")
    return header.unionByName(df.select(F.lit("row").alias("kind"), F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in df.columns]).alias("text")))


def json_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(pointer, value) of the scalar members of JSON lines, two levels deep; a line that is no JSON has pointer ``/error``."""
    v = spark.read.text(path).select("value", F.try_parse_json("value").alias("v"))
    v.createOrReplaceTempView("_json_lines")
    top = spark.sql("SELECT x.key AS k, x.value AS v FROM _json_lines, LATERAL variant_explode_outer(v) AS x WHERE v IS NOT NULL")
    top.createOrReplaceTempView("_json_members")
    scalars = spark.sql("SELECT '/' || k AS pointer, CAST(v AS STRING) AS value FROM _json_members WHERE schema_of_variant(v) NOT LIKE 'OBJECT%' AND schema_of_variant(v) NOT LIKE 'ARRAY%'")
    nested = spark.sql("SELECT '/' || m.k || '/' || coalesce(y.key, CAST(y.pos AS STRING)) AS pointer, to_json(y.value) AS value FROM _json_members m, LATERAL variant_explode(m.v) AS y")
    return scalars.unionByName(nested).unionByName(v.where("v is null").select(F.lit("/error").alias("pointer"), "value"))

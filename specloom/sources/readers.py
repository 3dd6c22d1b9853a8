"""Documents from files: text, PDF by pluggable backends, segment JSON, query lists."""

from __future__ import annotations

import io
import subprocess
import tempfile
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.functions.text import strip

# fixed values: the markers that page texts and tables are put between
PAGE_MARK, TABLE_MARK, TABLES_MARK = "<<PAGE {n}>>", "<<TABLE page={n}>>", "<<STRUCTURED_TABLES>>"
ENOUGH = 1000  # stripped characters for which the generic waterfall accepts a backend's text


class PdfBackend(Protocol):
    """Pages' texts, and tables by position as (page, rows of cells), of a PDF's bytes; None if it can't."""

    def pages(self, data: bytes) -> list[str] | None: ...

    def tables(self, data: bytes, pages: list[int] | None) -> list[tuple[int, list[list[str]]]]: ...


class NoTables:
    def tables(self, data: bytes, pages: list[int] | None) -> list[tuple[int, list[list[str]]]]:
        return []


class PyMuPdf(NoTables):
    def pages(self, data: bytes) -> list[str] | None:
        try:
            import fitz
        except ImportError:
            return None
        with fitz.open(stream=data, filetype="pdf") as doc:
            return [p.get_text("text") for p in doc]


class PyPdf(NoTables):
    def pages(self, data: bytes) -> list[str] | None:
        try:
            from pypdf import PdfReader
        except ImportError:
            try:
                from PyPDF2 import PdfReader
            except ImportError:
                return None
        return [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]


class PdfMiner(NoTables):
    def pages(self, data: bytes) -> list[str] | None:
        try:
            from pdfminer.high_level import extract_text
        except ImportError:
            return None
        return extract_text(io.BytesIO(data)).split("\f")


class PdfPlumber:
    #: Ruled lines, joined within 3 points, edges of 30 points or more.
    RULED = {"vertical_strategy": "lines", "horizontal_strategy": "lines", "snap_tolerance": 3, "join_tolerance": 3, "edge_min_length": 30}
    BY_TEXT = {"vertical_strategy": "text", "horizontal_strategy": "text"}

    def pages(self, data: bytes) -> list[str] | None:
        try:
            import pdfplumber
        except ImportError:
            return None
        with pdfplumber.open(io.BytesIO(data)) as doc:
            return [p.extract_text() or "" for p in doc.pages]

    def tables(self, data: bytes, pages: list[int] | None) -> list[tuple[int, list[list[str]]]]:
        try:
            import pdfplumber
        except ImportError:
            return []
        out = []
        with pdfplumber.open(io.BytesIO(data)) as doc:
            for n, p in enumerate(doc.pages, 1):
                if pages is None or n in pages:
                    found = p.extract_tables(self.RULED) or ([] if pages is not None else p.extract_tables(self.BY_TEXT))
                    out += [(n, [[(c or "").strip() for c in row] for row in t]) for t in found]
        return out


class PdfToText(NoTables):
    """The command of that name, 120 seconds at most; its layout is kept if asked for."""

    def __init__(self, layout: bool = False, least: int = 500):
        self.layout, self.least = layout, least

    def pages(self, data: bytes) -> list[str] | None:
        with tempfile.NamedTemporaryFile(suffix=".pdf") as f:
            f.write(data)
            f.flush()
            try:
                done = subprocess.run(["pdftotext", *["-layout"] * self.layout, f.name, "-"], capture_output=True, timeout=120, check=True)
            except (OSError, subprocess.SubprocessError):
                return None
        text = done.stdout.decode("utf-8", "replace")
        return text.split("\f") if sum(c.isprintable() for c in text) > self.least else None


WORKSHOP_BACKENDS = (PyMuPdf(), PyPdf(), PdfPlumber())
GENERIC_BACKENDS = (PyMuPdf(), PdfMiner(), PdfPlumber(), PdfToText())


def is_pdf(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.lit(b"%PDF")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, source_file, text, total_chars, total_lines) of text files; bytes that are no UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").load(path).filter(~is_pdf(F.col("content")))
    return _texts(files)


def _texts(files: DataFrame) -> DataFrame:
    text = F.decode("content", "utf-8")
    rows = files.select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("source_file"), F.when(F.is_valid_utf8(F.col("content").cast("string")), text).otherwise(F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))
    return rows.select("*", F.length("text").cast("long").alias("total_chars"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("long").alias("total_lines"))


def table_pages(pages: Column) -> Column:
    """Numbers of the pages with more than three lines of two numbers side by side."""
    numeric = lambda p: F.size(F.filter(F.split(p["text"], "\n"), lambda line: line.rlike(r"\d+\s+\d+")))
    return F.transform(F.filter(pages, lambda p: numeric(p) > 3), lambda p: p["page"])


_PAGES = pa.schema([("doc_id", pa.string()), ("method", pa.string()), ("pages", pa.list_(pa.struct([("page", pa.int32()), ("text", pa.string())]))), ("tables", pa.list_(pa.struct([("page", pa.int32()), ("rows", pa.list_(pa.list_(pa.string())))])))])
PAGES = "doc_id string, method string, pages array<struct<page:int,text:string>>, tables array<struct<page:int,rows:array<array<string>>>>"


def decode_pdfs(files: DataFrame, backends: tuple[PdfBackend, ...] = WORKSHOP_BACKENDS, enough: int = 0, every_table: bool = False) -> DataFrame:
    """Pages and tables of (path, content): the first backend whose text has more than ``enough`` characters, blanks aside.

    A backend that fails on a file is passed over; a file that none can read has no pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                pages, method, tables = [], "none", []
                for b in backends:
                    try:
                        got = b.pages(data)
                    except Exception:  # noqa: BLE001  any parser may fail on any file
                        got = None
                    if got and len("".join(got).strip()) > enough:
                        pages, method = got, type(b).__name__
                        break
                wanted = None if every_table else [n for n, t in enumerate(pages, 1) if sum(_two_numbers(x) for x in t.split("\n")) > 3]
                for b in backends if wanted is None or wanted else ():
                    try:
                        tables = b.tables(data, wanted)
                    except Exception:  # noqa: BLE001
                        tables = []
                    if tables:
                        break
                row = [path, method, [{"page": n, "text": t} for n, t in enumerate(pages, 1) if t.strip()], [{"page": n, "rows": r} for n, r in tables]]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _PAGES)], schema=_PAGES)

    return files.select("path", "content").mapInArrow(run, PAGES)


def _two_numbers(line: str) -> bool:
    import re

    return re.search(r"\d+\s+\d+", line) is not None


def assemble(decoded: DataFrame) -> DataFrame:
    """Pages and tables as one text: a marker before each page, tables tab-separated at the end, blank cells as dashes."""
    page = lambda p: F.concat(F.lit("<<PAGE "), p["page"].cast("string"), F.lit(">>\n"), p["text"])
    cell = lambda c: F.when(F.coalesce(strip(c), F.lit("")) == "", F.lit("—")).otherwise(strip(c))
    row = lambda r: F.array_join(F.transform(r, cell), "\t")
    full = lambda r: F.exists(r, lambda c: F.coalesce(strip(c), F.lit("")) != "")
    table = lambda t: F.concat(F.lit("<<TABLE page="), t["page"].cast("string"), F.lit(">>\n"), F.array_join(F.transform(F.filter(t["rows"], full), row), "\n"))
    text = F.concat_ws("\n", F.array_join(F.transform("pages", page), "\n"), F.when(F.size("tables") > 0, F.concat(F.lit(TABLES_MARK + "\n"), F.array_join(F.transform("tables", table), "\n"))))
    return decoded.select("doc_id", F.element_at(F.split("doc_id", "/"), -1).alias("source_file"), text.alias("text"), F.col("method").alias("extraction_method"), F.size("pages").alias("total_pages"), F.size(table_pages(F.col("pages"))).alias("table_pages"), "tables")


def read_documents(spark: SparkSession, path: str, generic: bool = False, layout_first: bool = False) -> DataFrame:
    """Text and PDF files of a folder or glob as documents, told apart by their first bytes.

    ``layout_first``: the ``pdftotext`` command with its layout before the other backends.
    A PDF that no backend reads takes the text of the first file beside it that has one of the
    names of ``companion``. Tables found by position come along in ``tables``.
    """
    files = spark.read.format("binaryFile").load(path)
    backends = GENERIC_BACKENDS if generic else WORKSHOP_BACKENDS
    backends = (PdfToText(layout=True, least=0), *backends) if layout_first else backends
    pdfs = assemble(decode_pdfs(files.filter(is_pdf(F.col("content"))), backends, ENOUGH if generic else 0, generic))
    texts = _texts(files.filter(~is_pdf(F.col("content"))))
    unread = pdfs.filter("extraction_method = 'none'").select("doc_id", F.posexplode(companion(F.col("doc_id"))).alias("_rank", "_path"))
    beside = unread.join(texts.select(F.col("doc_id").alias("_path"), F.col("text").alias("_beside")), "_path").groupBy("doc_id").agg(F.min_by("_beside", "_rank").alias("_beside"))
    pdfs = pdfs.join(beside, "doc_id", "left").withColumn("text", F.coalesce("_beside", "text"))
    out = ["doc_id", "source_file", "text", "extraction_method", "total_pages", "tables"]
    plain = texts.select("doc_id", "source_file", "text", F.lit("text").alias("extraction_method"), F.lit(0).alias("total_pages"), F.lit(None).cast(dict(pdfs.dtypes)["tables"]).alias("tables"))
    return pdfs.select(*out).unionByName(plain)


def check_upload(spark: SparkSession, path: str) -> None:
    """Refuse files that are neither .pdf nor .txt, and an upload without any content; only names are read.

    Empty files beside others have no rows and so no documents.
    """
    files = spark.read.format("binaryFile").load(path).select("path")
    bad = files.filter(~F.lower("path").rlike(r"\.(pdf|txt)$")).first()
    if bad is not None:
        raise ValueError(f"neither PDF nor text: {bad['path']}")
    if files.isEmpty():
        raise ValueError(f"empty: {path}")


SEGMENT_JSON = "text string, content_type string, section_id string, section_name string, subsection_type string, page_number int, line_number int, component string, spec_value struct<value_nm:double,value_lbft:double,value_lbin:double,value_kgcm:double,value_mm:double,value_deg:double,raw:string>, vehicle_variant array<string>, stage_number int, is_safety_critical boolean, has_condition boolean, confidence double"


def read_segments(spark: SparkSession, path: str, multi_line: bool = True, more: str = "") -> DataFrame:
    """Segments from JSON arrays, a document for each file; what is missing takes its default.

    ``multi_line``: each file is one array; without, JSON lines. ``more``: further columns, as in DDL.
    """
    rows = spark.read.schema(", ".join(x for x in (SEGMENT_JSON, more) if x)).option("multiLine", multi_line).json(path).withColumn("doc_id", F.input_file_name())
    rows = rows.withColumn("seg_seq", F.monotonically_increasing_id())
    defaults = {"text": "", "content_type": "general_text", "section_id": "", "section_name": "", "subsection_type": "", "page_number": 0, "line_number": 0, "component": "", "stage_number": 0, "is_safety_critical": False, "has_condition": False, "confidence": 1.0}
    return rows.na.fill(defaults).withColumn("vehicle_variant", F.coalesce("vehicle_variant", F.array().cast("array<string>")))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query): lines that are not blank and do not begin with '#', without white space around."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#")).withColumn("query", strip(F.col("value"))).filter("query != ''")
    return lines.select(F.monotonically_increasing_id().alias("query_id"), "query")


def companion(path: Column) -> Column:
    """The paths beside a PDF under which its text may lie, in the order in which they are tried."""
    folder, stem = F.regexp_replace(path, r"[^/]*$", ""), F.regexp_replace(path, r"\.[^./]*$", "")
    # fixed values: the endings and names of text files
    return F.array(F.concat(stem, F.lit(".txt")), F.concat(stem, F.lit("_cleaned.txt")), F.concat(folder, F.lit("extracted_text_cleaned.txt")), F.concat(folder, F.lit("extracted_text.txt")))

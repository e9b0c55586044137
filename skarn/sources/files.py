"""Reading a folder of documents: scan, parse by plug-in, assemble document rows."""

from __future__ import annotations

import io
import re
import subprocess
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import text as T

# fixed values: extensions that a scan keeps
EXTENSIONS = (".pdf", ".docx", ".doc", ".docm", ".xlsx", ".xls", ".pptx", ".txt")
#: Rows of a sheet that parse_xlsx() reads unless told otherwise; None reads all.
XLSX_ROWS = 500
#: Extension to a function from bytes to pages; callers may add or replace entries.
PARSERS: dict[str, Callable[[bytes], list[str]]] = {}


def parser(*extensions: str):
    def add(f):
        PARSERS.update(dict.fromkeys(extensions, f))
        return f

    return add


@parser(".txt", ".md")
def parse_txt(raw: bytes) -> list[str]:
    return [raw.decode("utf-8", "ignore")]


def _local(node) -> str:
    return node.tag.rpartition("}")[2]


def _paragraphs(root) -> list[str]:
    return [s for p in root.iter() if _local(p) == "p" and (s := "".join(t.text or "" for t in p.iter() if _local(t) == "t")).strip()]


@parser(".docx", ".docm")
def parse_docx(raw: bytes) -> list[str]:
    """Paragraphs that aren't blank, then each table row as cells joined by bars; one page."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
    tables = [t for t in body.iter() if _local(t) == "tbl"]
    inside = {id(p) for t in tables for p in t.iter()}
    top = [s for p in body.iter() if _local(p) == "p" and id(p) not in inside and (s := "".join(x.text or "" for x in p.iter() if _local(x) == "t")).strip()]
    rows = [" | ".join("".join(x.text or "" for x in c.iter() if _local(x) == "t").strip() for c in r if _local(c) == "tc") for t in tables for r in t if _local(r) == "tr"]
    return ["\n".join(top + rows)]


@parser(".doc")
def parse_doc(raw: bytes) -> list[str]:
    """A mislabelled new file, else an external converter, else nothing."""
    try:
        return parse_docx(raw)
    except Exception:
        with tempfile.NamedTemporaryFile(suffix=".doc") as f:
            f.write(raw)
            f.flush()
            done = subprocess.run(["antiword", f.name], capture_output=True, timeout=30, check=True)
        return [done.stdout.decode("utf-8", "ignore")]


@parser(".xlsx")
def parse_xlsx(raw: bytes, most: int | None = XLSX_ROWS) -> list[str]:
    """A page a sheet: its first ``most`` rows (a parser of all rows: lambda raw: parse_xlsx(raw, None)), cells joined by bars."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter() if _local(t) == "t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(s) == "si"]
    titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(s) == "sheet"]
    sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    pages = []
    for title, name in zip(titles, sheets):
        lines = []
        for row in [r for r in ElementTree.fromstring(z.read(name)).iter() if _local(r) == "row"][:most]:
            cells = []
            for c in row:
                value = next((v.text for v in c.iter() if _local(v) in ("v", "t") and v.text), None)
                if value is not None:
                    cells.append(shared[int(value)] if c.get("t") == "s" else value)
            if cells:
                lines.append(" | ".join(cells))
        if lines:
            pages.append("\n".join([f"Sheet: {title}", *lines]))
    return pages


@parser(".pptx")
def parse_pptx(raw: bytes) -> list[str]:
    """A page a slide."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    return [page for n in slides if (page := "\n".join(_paragraphs(ElementTree.fromstring(z.read(n)))))]


@parser(".pdf")
def parse_pdf(raw: bytes) -> list[str]:
    """A page an element, where a PDF library is installed; else nothing."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return []
    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(raw)).pages]


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"(\.[^./]*)$", 1))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of the files of known kinds, recursively; content is read only where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(extension("path").isin(*EXTENSIONS)).select("path", "length", "content")


def parse(files: DataFrame, parsers: dict[str, Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    """(path, pages): a file that fails or has no parser has no pages."""
    known = dict(parsers or PARSERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            pages = []
            for path, raw in zip(rows["path"], rows["content"]):
                try:
                    pages.append(known[path[path.rindex(".") :].lower()](bytes(raw)))
                except Exception:  # a broken file must not end the job
                    pages.append([])
            yield pd.DataFrame({"path": rows["path"], "pages": pages})

    return files.select("path", "content").mapInPandas(run, "path string, pages array<string>")


def documents(parsed: DataFrame) -> DataFrame:
    """Document rows with their pages, from (path, pages); texts under 100 characters are left out."""
    text = F.array_join("pages", "\n\n")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    d = parsed.select("path", "pages", text.alias("text"), name.alias("filename"), T.category("path").alias("k")).where(F.length(T.strip("text")) >= 100)
    return d.select(
        T.doc_id("path").alias("id"), "path", "filename", "k.category", "k.source_type", T.title("text", "filename").alias("title"), T.authors("text").alias("authors"), T.year("text", "filename").alias("year"),
        T.language("text").alias("language"), T.geography("text", "filename").alias("geography"), F.size("pages").alias("num_pages"), F.length("text").alias("text_length"), F.current_timestamp().alias("imported_at"),
        T.trust("k.source_type").alias("trust"), F.create_map(F.lit("extension"), extension("path")).alias("metadata"), "pages",
    )


def ingest(spark: SparkSession, folder: str, max_docs: int | None = None, existing: DataFrame | None = None) -> DataFrame:
    """Documents of a folder; max_docs keeps the first paths, then documents already known are skipped."""
    files = scan(spark, folder)
    if max_docs is not None:
        files = files.join(F.broadcast(files.select("path").orderBy("path").limit(max_docs)), "path", "left_semi")
    if existing is not None:
        files = files.withColumn("id", T.doc_id("path")).join(existing.select("id"), "id", "left_anti").drop("id")
    return documents(parse(files))


# fixed values: stages that an upload passes, in order
STAGES = ("upload", "recognition", "normalization", "extraction", "indexing")


def upload_errors(files: DataFrame, most_bytes: int = 50 << 20, most_files: int = 10) -> DataFrame:
    """(path, error) of the files of an upload; error is null for those it takes: of known kind, not too large, among the first by path."""
    first = files.select("path").orderBy("path").limit(most_files).withColumn("_in", F.lit(True))
    bad = F.when(~extension("path").isin(*EXTENSIONS), "extension").when(F.col("length") > most_bytes, "size").when(F.col("_in").isNull(), "count")
    return files.select("path", "length").join(F.broadcast(first), "path", "left").select("path", bad.alias("error"))


def upload_progress(events: DataFrame) -> DataFrame:
    """(path, stage, done) from events (path, stage, at): the furthest stage that each file has reached and the share of all stages."""
    place = F.array_position(F.array(*[F.lit(x) for x in STAGES]), F.col("stage"))
    return events.groupBy("path").agg(F.max(place).alias("k")).where("k > 0").select("path", F.element_at(F.array(*[F.lit(x) for x in STAGES]), F.col("k").cast("int")).alias("stage"), (F.col("k") / len(STAGES)).alias("done"))


def sniffed(content: Column | str) -> Column:
    """The kind that a file's first bytes tell."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit("unknown")
    for magic, kind in {"504B0304": "zip", "25504446": "pdf", "D0CF11E0": "ole", "52617221": "rar", "377ABCAF": "7z", "1F8B": "gzip"}.items():
        out = F.when(F.startswith(head, F.lit(magic)), kind).otherwise(out)
    return out


def joined_parts(files: DataFrame, most_bytes: int = 512 << 20) -> DataFrame:
    """(archive, parts, length, content) of archives split into name.001, name.002 and so on.

    An archive is parsed as one value, so one of more than ``most_bytes`` has no content, nor one that lacks a part.
    """
    at = files.select("path", "content", F.octet_length("content").cast("long").alias("length"), F.regexp_extract("path", r"^(.*)\.\d{3}$", 1).alias("archive"), F.regexp_extract("path", r"\.(\d{3})$", 1).cast("int").alias("k")).where("archive <> ''")
    size = at.groupBy("archive").agg(F.count(F.lit(1)).alias("parts"), F.sum("length").alias("length"), F.max("k").alias("last"))
    whole = size.where((F.col("length") <= most_bytes) & (F.col("last") == F.col("parts"))).select("archive")
    joined = at.join(whole, "archive", "left_semi").groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("k", F.hex("content").alias("h")))).alias("p"))
    return size.join(joined, "archive", "left").select("archive", "parts", "length", F.unhex(F.array_join(F.transform("p", lambda x: x.h), "")).alias("content"))

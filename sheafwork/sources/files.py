"""Files as sources: format detection, text and DOCX readers, and failures as rows."""

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

FORMATS = ("pdf", "docx", "txt", "md")
#: Files above this size are refused unread; least characters other than white space of a text; characters of a page.
MOST_BYTES, LEAST_CHARS, PAGE_CHARS = 10 * 1024 * 1024, 80, 3400
#: A PDF needs more, since scans often carry a few stray characters.
LEAST_PDF_CHARS = 120
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "path string, format string, plain_text string, page_count int, table_count int, fonts array<string>, links array<string>, error string"


def detect_format(name: Column, mime: Column | None = None) -> Column:
    """Format by the extension, else by the MIME type; null for others, the old .doc among them."""
    extension = F.regexp_extract(F.lower(name), rf"\.({'|'.join(FORMATS)})$", 1)
    found = F.when(extension != "", extension)
    if mime is not None:
        kinds = {"application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "text/plain": "txt", "text/markdown": "md"}
        for kind, fmt in kinds.items():
            found = found.when(~F.lower(name).endswith(".doc") & (mime == kind), fmt)
    return found


def tidy_text(raw: str) -> str:
    text = raw.replace("\r\n", "\n").replace("\r", "\n")
    while "\n\n\n" in text:
        text = text.replace("\n\n\n", "\n\n")
    return text.strip()


def read_docx(data: bytes) -> dict:
    """Paragraphs (list items behind a bullet) and table rows of a DOCX, its fonts, links and own page count."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")
        links, pages = [], None
        if "word/_rels/document.xml.rels" in names:
            links = [r.get("Target") for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels")) if r.get("TargetMode") == "External" and "hyperlink" in (r.get("Type") or "")]
        if "docProps/app.xml" in names:
            found = [e.text for e in ElementTree.fromstring(z.read("docProps/app.xml")).iter() if e.tag.endswith("}Pages")]
            pages = int(found[0]) if found and (found[0] or "").isdigit() else None

    def text_of(p: ElementTree.Element) -> str:
        out = []
        for e in p.iter():
            if e.tag == _W + "t":
                out.append(e.text or "")
            elif e.tag == _W + "tab":
                out.append("\t")
            elif e.tag in (_W + "br", _W + "cr"):
                out.append("\n")
        text = "".join(out).strip()
        return f"• {text}" if text and p.find(f"{_W}pPr/{_W}numPr") is not None else text

    lines, tables = [], 0
    for e in body if body is not None else ():
        if e.tag == _W + "p":
            lines.append(text_of(e))
        elif e.tag == _W + "tbl":
            tables += 1
            for row in e.iter(_W + "tr"):
                cells = [" ".join(filter(None, (text_of(p) for p in cell.iter(_W + "p")))) for cell in row.iter(_W + "tc")]
                lines.append("   ".join(cells))
    fonts = sorted({f.get(_W + "ascii") for f in (body.iter(_W + "rFonts") if body is not None else ()) if f.get(_W + "ascii")})
    text = tidy_text("\n".join(lines))
    return {"plain_text": text, "page_count": pages or max(1, -(-len(text) // 3200)), "table_count": tables, "fonts": fonts, "links": sorted(set(filter(None, links)))}


def extract_bytes(path: str, fmt: str | None, data: bytes | None, size: int) -> dict:
    """One row of SCHEMA; whatever goes wrong becomes its error code."""
    row = dict.fromkeys(x.split()[0] for x in SCHEMA.split(", ")) | {"path": path, "format": fmt}
    if size > MOST_BYTES:
        return row | {"error": "file-too-large"}
    if fmt not in FORMATS:
        return row | {"error": "unsupported-format"}
    try:
        if fmt == "docx":
            row |= read_docx(data)
        elif fmt == "pdf":
            from .pdf import read_pdf

            row |= read_pdf(data)
        else:
            text = tidy_text(data.decode("utf-8-sig", "replace"))
            row |= {"plain_text": text, "page_count": max(1, -(-len(text) // PAGE_CHARS)), "table_count": 0, "fonts": [], "links": []}
    except Exception as problem:  # noqa: BLE001 - a bad file must be a row, not the end of the job
        return row | {"error": getattr(problem, "code", "extraction-failed")}
    if row.get("error") is None and len("".join((row["plain_text"] or "").split())) < (LEAST_PDF_CHARS if fmt == "pdf" else LEAST_CHARS):
        row["error"] = "no-text-layer" if fmt == "pdf" else "empty-document"
    return row


def read_files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Extractions of all files under a path, one row a file (SCHEMA); size is checked before the content is read.

    The content of files that are too large is not fetched: Spark prunes it by the filter on length.
    """
    ship(spark)
    reader = spark.read.format("binaryFile").options(recursiveFileLookup="true", **options)
    files = reader.load(path).withColumn("format", detect_format(F.col("path")))
    ok = files.where((F.col("length") <= MOST_BYTES) & F.col("format").isNotNull()).select("path", "format", "length", "content")
    refused = files.where((F.col("length") > MOST_BYTES) | F.col("format").isNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([extract_bytes(*r) for r in zip(batch["path"], batch["format"], batch["content"], batch["length"])])

    error = F.when(F.col("length") > MOST_BYTES, "file-too-large").otherwise("unsupported-format")
    empty = refused.select("path", "format", *[F.expr(f"cast(null as {t})").alias(n) for n, t in (x.split(" ", 1) for x in SCHEMA.split(", ")[2:-1])], error.alias("error"))
    return ok.mapInPandas(run, SCHEMA).unionByName(empty)

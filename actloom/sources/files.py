"""Files of documents as tables: text in unknown encodings, XML, CSV and JSON, DOCX and PDF where a reader is there."""

from __future__ import annotations

import io

import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actloom.functions.text import base_name, collapse, content_hash, extension, normalize_text, parse_date

# Fixed value: the encodings that are tried, in this order.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1251", "cp866")
SUPPORTED = (".txt", ".xml", ".docx", ".pdf")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decode(data: bytes) -> str:
    """A01. The first encoding that fits, with plain line ends."""
    for name in ENCODINGS:
        try:
            return data.decode(name).replace("\r\n", "\n").replace("\r", "\n")
        except UnicodeDecodeError:
            continue
    raise ValueError("no known encoding")


def xml_text(data: bytes) -> str:
    """A04. All text nodes, one to a line."""
    return "\n".join(x for x in (t.strip() for t in ElementTree.fromstring(data).itertext()) if x)


def docx_text(data: bytes) -> str:
    """A02. Paragraphs and tables in the order of the body; cells of a row joined by ' | ', the paragraphs
    of a cell by line ends. A table inside a cell comes as the paragraphs of that cell, once."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    words = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
    lines: list[str] = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            lines.append(words(node))
        elif node.tag == f"{_W}tbl":
            cell_text = lambda cell: "\n".join(x for x in map(words, cell.iter(f"{_W}p")) if x)
            lines += [" | ".join(c for c in map(cell_text, row.findall(f"{_W}tc")) if c) for row in node.findall(f"{_W}tr")]
    return "\n".join(x for x in lines if x)


def pdf_text(data: bytes) -> str:
    """A03. The text of each page, joined by form feeds; needs pypdf, no OCR."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("no PDF reader is installed") from e
    return "\f".join(t for t in (page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages) if t.strip())


READERS = {".txt": decode, ".xml": xml_text, ".docx": docx_text, ".pdf": pdf_text}


def extract(files: DataFrame) -> DataFrame:
    """A05-A07. (path, length, extracted_text, error) of a binaryFile table. What cannot be read keeps
    its row: error names why, the text is null. (The source itself lists no files of length 0.)"""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, errors = [], []
            for path, data in zip(pdf["path"], pdf["content"]):
                kind = "." + path.rpartition(".")[2].lower()
                text, error = None, None
                try:
                    if kind not in READERS:
                        error = "unsupported format"
                    elif not data:
                        error = "empty file"
                    else:
                        text = READERS[kind](bytes(data)).strip() or None
                        error = None if text else "no text layer" if kind == ".pdf" else "no text"
                except Exception as e:  # a broken file is a row, not a failed job
                    error = f"unreadable: {type(e).__name__}"
                texts.append(text)
                errors.append(error)
            yield pd.DataFrame({"path": pdf["path"], "length": pdf["length"], "extracted_text": texts, "error": errors})

    return files.select("path", "length", "content").mapInPandas(read, "path string, length bigint, extracted_text string, error string")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A06. Files below folder as extracted, normalised and hashed texts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    text = normalize_text(F.col("extracted_text"))
    return extract(files).select("path", base_name(F.col("path")).alias("filename"), extension(F.col("path")).alias("extension"), "length", "extracted_text", text.alias("normalized_text"), content_hash(text).alias("content_hash"), "error")


def stream_documents(spark: SparkSession, folder: str):
    """A10. The same as a file stream: new files become rows as they come."""
    kind = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    return extract(spark.readStream.format("binaryFile").schema(kind).option("recursiveFileLookup", "true").load(folder))


def read_acts(spark: SparkSession, folder: str) -> DataFrame:
    """A08. Acts as XML: metadata by tag (its val attribute, else its text) and the body, white space collapsed."""
    raw = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("xml"))
    tag = lambda name: F.coalesce(F.expr(f"nullif(xpath_string(xml, '//{name}/@val'), '')"), F.expr(f"nullif(xpath_string(xml, '//{name}'), '')"))
    return raw.select("path", tag("id").alias("act_id"), collapse(tag("heading")).alias("heading"), parse_date(tag("date")).alias("document_date"), collapse(tag("body")).alias("cleaned_text"))


def act_xml(df: DataFrame, fields: list[str], body: str) -> DataFrame:
    """A09. One XML string for each row."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    tags = [F.concat(F.lit(f'<{f} val="'), esc(F.col(f)), F.lit('"/>')) for f in fields]
    return df.select(*fields, F.concat(F.lit("<act>"), *tags, F.lit("<body>"), esc(F.col(body)), F.lit("</body></act>")).alias("xml"))


def upsert(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """A11. target with the rows of source put in or replacing those of the same key; `change` says created, updated or kept."""
    rest = [c for c in target.columns if c != key]
    s = source.select(key, F.struct(*rest).alias("_s"))
    t = target.select(key, F.struct(*rest).alias("_t"))
    both = t.join(s, key, "full_outer")
    change = F.when(F.col("_t").isNull(), "created").when(F.col("_s").isNotNull(), "updated").otherwise("kept")
    return both.select(key, F.coalesce("_s", "_t").alias("_r"), change.alias("change")).select(key, "_r.*", "change")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A12. CSV with a header and a given schema; quotes double themselves, cells may have line breaks."""
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A13. Fixed order of columns, nulls as empty cells."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A14, A18, A20. JSON documents, one to a file or a list of them."""
    return spark.read.option("multiLine", "true").schema(schema).json(path)


def preview(df: DataFrame, n: int, chars: int) -> DataFrame:
    """A24. The first n rows, text cells cut."""
    return df.limit(n).select(*[F.substring(c, 1, chars).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])

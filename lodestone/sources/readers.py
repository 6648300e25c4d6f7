"""Files as rows: CSV as text cells, and documents of several formats."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalised, spaced, trimmed, without_markdown


def csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """All cells as text, with the names of the header. Without an encoding,
    UTF-8, or Latin-1 if a file is not valid UTF-8."""
    if not path.lower().rstrip("/").endswith(".csv"):
        raise ValueError(f"{path} is no .csv")
    if encoding is None:
        valid = spark.read.format("binaryFile").load(path).select(F.min(F.is_valid_utf8(F.col("content").cast("string"))).alias("v")).first().v
        encoding = "UTF-8" if valid in (None, True) else "ISO-8859-1"
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', encoding=encoding)
    if not rows.columns:
        raise ValueError(f"{path} has no header")
    return rows


def decoded(content: Column) -> Column:
    """UTF-8, with or without a mark, and else Latin-1, which fits any bytes."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^\ufeff", "")


def docx_text(content: bytes) -> str:
    """The filled paragraphs of a Word file."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{space}t")).strip() for p in body.iter(f"{space}p"))
    return "\n".join(x for x in lines if x)


def grouped_lines(words: list[tuple[str, float]], tolerance: float = 3.0) -> list[str]:
    """Lines of positioned words (text, top): a new one where the top differs
    from the line's first by more than ``tolerance``."""
    lines: list[list[str]] = []
    top = None
    for text, at in words:
        if top is None or abs(at - top) > tolerance:
            lines.append([])
            top = at
        lines[-1].append(text)
    return [" ".join(x) for x in lines]


def pdf_text(content: bytes) -> str:
    """Pages of lines, a blank line between; needs the pdfplumber package."""
    try:
        import pdfplumber
    except ImportError as e:
        raise RuntimeError("reading PDF needs pdfplumber") from e
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return "\n\n".join("\n".join(grouped_lines([(w["text"], w["top"]) for w in page.extract_words()])) for page in pdf.pages)


BINARY: dict[str, Callable[[bytes], str]] = {".docx": docx_text, ".pdf": pdf_text}
TEXT = (".txt", ".md", "")


def extracted(files: DataFrame, extract: Callable[[bytes], str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([extract(c) for c in batch.column(1).to_pylist()], pa.string())], ["path", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, text string")


def documents(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".txt", ".md", "", ".docx", ".pdf")) -> DataFrame:
    """(path, text) of the files of a folder or pattern: plain, Markdown, Word
    and PDF by suffix, normalised; other files are an error, as are empty ones."""
    files = spark.read.format("binaryFile").load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)?$", 1))
    files = files.select("path", suffix.alias("suffix"), "content")
    found = [r.suffix for r in files.select("suffix").distinct().limit(100).collect()]
    unknown = [s for s in found if s not in suffixes]
    if unknown:
        raise ValueError(f"unsupported files: {', '.join(unknown)}")
    parts = []
    for s in found:
        own = files.filter(F.col("suffix") == s)
        if s in BINARY:
            rows = extracted(own, BINARY[s])
            rows = rows.withColumn("text", spaced(normalised(F.col("text")))) if s == ".pdf" else rows
        else:
            text = decoded(F.col("content"))
            rows = own.select("path", (without_markdown(text) if s == ".md" else text).alias("text"))
        parts.append(rows)
    if not parts:
        return spark.createDataFrame([], "path string, text string")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumn("text", normalised(F.col("text")))
    return rows.withColumn("text", F.when(F.length(trimmed(F.col("text"))) > 0, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("empty file: "), F.col("path")))))


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database; its driver must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def stem_of(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])

"""Files as documents: discovery, loaders for text, Markdown, HTML and PDF, and ids."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.html import html_text
from lodestone.functions.identity import document_id
from lodestone import schemas
from lodestone.session import ship_package

SUPPORTED = (".txt", ".md", ".html", ".htm", ".pdf")


class SourceError(ValueError):
    """A path that cannot be loaded."""


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The lower-case extension with its dot, or nothing."""
    name = name_of(path)
    return F.when(name.rlike(r"(?s).\.[^.]+\z"), F.lower(F.concat(F.lit("."), F.substring_index(name, ".", -1)))).otherwise("")


def plain_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\Afile:/*(?=/)", "")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, content and extension of the supported files in a folder (not below it)."""
    ship_package(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    rows = files.select("path", "content", extension(F.col("path")).alias("extension"))
    return rows.where(F.col("extension").isin(*SUPPORTED))


def load(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """The documents of one file. Raises FileNotFoundError or SourceError, as the extension or path demand."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    if fs.getFileStatus(at).isDirectory():
        raise SourceError(f"not a file: {path}")
    name = at.getName()
    kind = "." + name.rpartition(".")[2].lower() if "." in name[1:] else ""
    if kind not in SUPPORTED:
        raise SourceError(f"unsupported file type {kind!r}; supported: {', '.join(sorted(SUPPORTED))}")
    return documents(scan(spark, path).withColumn("path", F.lit(source or path)))


def html_to_text(page: Column | str) -> Column:
    """The visible text of HTML pages."""

    @F.pandas_udf("string")
    def convert(pages: pd.Series) -> pd.Series:
        return pages.map(html_text, na_action=None)

    return convert(page)


def documents(files: DataFrame) -> DataFrame:
    """Documents (text, source, file_type, metadata) from files (path, content, extension).

    Text is UTF-8 and normalized; an .htm file's type is html; a PDF gives a
    document for each page that has text.
    """
    no_page = F.lit(None).cast(schemas.of("DOCUMENT")["metadata"].dataType)
    source = plain_path(F.col("path"))
    body = F.decode("content", "UTF-8")
    rows = lambda df, text, kind: df.select(
        text.alias("text"), source.alias("source"), kind.alias("file_type"), no_page.alias("metadata")
    )
    plain = rows(files.where(F.col("extension").isin(".txt", ".md")), T.normalize(body), F.substring("extension", 2, 10))
    pages = rows(files.where(F.col("extension").isin(".html", ".htm")), T.normalize(html_to_text(body)), F.lit("html"))
    return plain.unionByName(pages).unionByName(pdf_pages(files.where(F.col("extension") == ".pdf")))


def pdf_pages(files: DataFrame) -> DataFrame:
    """A document for each non-empty page of PDF files. Needs the optional pypdf on the executors."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for batch in batches:
            if not len(batch):
                continue
            try:
                from pypdf import PdfReader
            except ImportError as missing:
                raise SourceError("reading PDF files needs the package pypdf") from missing
            for path, content in zip(batch["path"], batch["content"]):
                pages = PdfReader(io.BytesIO(content)).pages
                texts = [(p.extract_text() or "").replace("\r\n", "\n").replace("\r", "\n").strip() for p in pages]
                yield pd.DataFrame(
                    [(t, path, "pdf", i, len(texts)) for i, t in enumerate(texts, 1) if t],
                    columns=["text", "source", "file_type", "page_number", "page_count"],
                )

    found = files.select(plain_path(F.col("path")).alias("path"), "content").mapInPandas(
        rows, "text string, source string, file_type string, page_number int, page_count int"
    )
    return found.select("text", "source", "file_type", F.struct("page_number", "page_count").alias("metadata"))


def document_ids(files: DataFrame) -> DataFrame:
    """path, document_id and filename of files."""
    return files.select("path", document_id("content").alias("document_id"), name_of(F.col("path")).alias("filename"))

"""Source files: Markdown and PDF read through Spark's ``binaryFile`` source."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from excerpta.errors import ImportPolicyError
from excerpta.functions import text as tx
from excerpta.operators import chunking
from excerpta.sources import uploads


def listed_files(spark: SparkSession, paths) -> dict[str, tuple[int, int]]:
    """Size and modification time by path of the files that ``paths`` (files or globs) name.

    Every path must name at least one file; folders, other special files and symbolic links are refused.
    """
    jvm, conf, found = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), {}
    for asked in map(str, paths):
        pattern = jvm.org.apache.hadoop.fs.Path(asked)
        statuses = pattern.getFileSystem(conf).globStatus(pattern)
        if not statuses:
            raise ImportPolicyError(f"{asked}: no such file")
        for status in statuses:
            path = status.getPath()
            name, uri = path.getName(), path.toUri()
            if uri.getScheme() == "file" and jvm.java.nio.file.Files.isSymbolicLink(jvm.java.io.File(uri.getPath()).toPath()) or status.isSymlink():
                raise ImportPolicyError(f"{name}: a symbolic link is no source")
            if not status.isFile() or uri.getScheme() == "file" and not jvm.java.io.File(uri.getPath()).isFile():
                raise ImportPolicyError(f"{name}: not a regular file")
            found[path.toString()] = (status.getLen(), status.getModificationTime())
    return found


def read_files(spark: SparkSession, paths) -> DataFrame:
    """``path, source_name, content, byte_size, source_sha256, suffix`` for a list of files or globs."""
    if not paths:
        raise ImportPolicyError("no source file was given")
    raw = spark.read.format("binaryFile").load([str(path) for path in paths])
    named = raw.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("source_name"),
        "content",
        F.octet_length("content").cast("long").alias("byte_size"),
        F.sha2("content", 256).alias("source_sha256"),
    )
    return named.withColumn("suffix", uploads.suffix("source_name"))


def source_faults(files: DataFrame) -> DataFrame:
    """Files the importer must refuse, with the reason."""
    text = F.col("content").cast("string")
    markdown = F.col("suffix").isin(".md", ".markdown")
    reason = (
        F.when(~F.col("suffix").isin(*uploads.SUFFIXES), "unsupported_suffix")
        .when(markdown & ~F.is_valid_utf8(text), "not_utf8")
        .when(markdown & text.contains("�"), "replacement_character")
    )
    return files.select("source_name", "path", "byte_size", reason.alias("reason")).filter(F.col("reason").isNotNull())


def _pdf_pages(payload):
    """Text layer of one PDF: (status, pages, title). Needs pypdf; its absence is reported as a status."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return "pypdf_missing", [], ""
    try:
        reader = PdfReader(io.BytesIO(payload), strict=False)
        if reader.is_encrypted:
            return "encrypted", [], ""
        title = (reader.metadata.title if reader.metadata else None) or ""
        pages = [(page.extract_text() or "").replace("\0", " ") for page in reader.pages]
        return "ok", [p.replace("\r\n", "\n").replace("\r", "\n").strip() for p in pages], str(title)
    except Exception:
        return "unreadable", [], ""


def extract_pdf(files: DataFrame) -> DataFrame:
    """Add ``units`` (text per page), ``pdf_title`` and ``pdf_status``, one file at a time per task."""

    def run(frames):
        for frame in frames:
            found = [_pdf_pages(payload) for payload in frame["content"]]
            yield frame.assign(
                pdf_status=[f[0] for f in found], units=[f[1] for f in found], pdf_title=[f[2] for f in found]
            )

    added = StructType.fromDDL("pdf_status string, units array<string>, pdf_title string")
    return files.mapInPandas(run, StructType([*files.schema.fields, *added.fields]))


PREPARED = (
    "document_id", "asset_id", "source_name", "source_sha256", "byte_size", "title", "title_hint", "media_type",
    "extraction_method", "extraction_status", "page_count", "extracted_char_count", "content", "units", "chunks",
    "import_status",
)


def prepare(files: DataFrame, *keep: str) -> DataFrame:
    """Parsed and chunked documents, one row per file, with the columns ``keep`` of ``files``; refused files carry
    ``import_status``."""
    markdown = files.filter(F.col("suffix").isin(".md", ".markdown")).withColumn(
        "content_text", F.col("content").cast("string")
    )
    made = chunking.markdown_documents(markdown).withColumn("units", F.array(tx.normalize_newlines("content_text")))
    pdf = chunking.pdf_documents(extract_pdf(files.filter(F.col("suffix") == ".pdf"))).withColumn(
        "import_status", F.when(F.col("pdf_status") != "ok", F.col("pdf_status")).otherwise(F.col("import_status"))
    )
    return made.select(*PREPARED, *keep).unionByName(pdf.select(*PREPARED, *keep))

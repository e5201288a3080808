"""Sections, tables of contents, budgeted reads and excerpts over stored chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from excerpta.functions import identity, text as tx
from excerpta.schemas import EVIDENCE

ORDER = ("asset_id", "ordinal", "chunk_id")


def evidence(chunks: DataFrame, documents: DataFrame, *extra: str) -> DataFrame:
    """Chunks with the public columns of their document."""
    about = documents.select(
        "document_id", "title", "identifiers", "source_name", "media_type", "material_type",
        "language", "topics", "evidence_role",
    )
    return chunks.join(about, "document_id").select(*EVIDENCE, "ordinal", "chunk_text", *extra)


def with_sections(chunks: DataFrame, *keys: str) -> DataFrame:
    """Add ``section_no``: runs of equal page (PDF) or heading path (Markdown) in reading order.

    A heading that comes back later opens a new section. The window runs per document, and one
    document is one imported file, so no task sees more than that file's chunks.
    """
    window = Window.partitionBy(*keys, "document_id").orderBy(*ORDER)
    page = F.when(F.col("material_type") == "pdf", F.col("pdf_page_start"))
    path = F.when(F.col("material_type") != "pdf", F.col("heading_path"))
    run = F.struct("asset_id", page.alias("page"), path.alias("path"))
    opens = (~run.eqNullSafe(F.lag(run).over(window))).cast("int")
    return chunks.withColumn("_opens", opens).withColumn("section_no", F.sum("_opens").over(window)).drop("_opens")


def sections(chunks: DataFrame, library, snapshot, *keys: str) -> DataFrame:
    """One row per section with its id, anchors and chunk range; ``total`` counts the document's."""
    narrow = with_sections(chunks, *keys)
    position = F.struct(*ORDER)
    grouped = narrow.groupBy(*keys, "document_id", "section_no").agg(
        F.min_by("asset_id", position).alias("asset_id"),
        F.when(F.first("material_type") == "pdf", "pdf_page").otherwise("heading").alias("section_kind"),
        F.min_by("heading_path", position).alias("heading_path"),
        F.min_by("pdf_page_start", position).alias("_page"),
        F.min("pdf_page_start").alias("pdf_page_start"),
        F.max("pdf_page_end").alias("pdf_page_end"),
        F.min("source_line_start").alias("source_line_start"),
        F.max("source_line_end").alias("source_line_end"),
        F.min_by("anchor_label", position).alias("anchor_label"),
        F.min_by("chunk_id", position).alias("first_chunk_id"),
        F.max_by("chunk_id", position).alias("last_chunk_id"),
        F.count("*").alias("chunk_count"),
    )
    named = grouped.withColumn(
        "section_id",
        identity.section_id(
            library, snapshot, F.col("document_id"), F.col("asset_id"), F.col("section_kind"),
            F.col("heading_path"), F.col("_page"), F.col("first_chunk_id"), F.col("last_chunk_id"),
        ),
    ).drop("_page")
    return named.withColumn("total", F.max("section_no").over(Window.partitionBy(*keys, "document_id")))


def toc(chunks: DataFrame, library, snapshot, max_items: int = 100, *keys: str) -> DataFrame:
    """First ``max_items`` sections of every document and whether more follow."""
    return (
        sections(chunks, library, snapshot, *keys)
        .filter(F.col("section_no") <= max_items)
        .withColumn("truncated", F.col("total") > max_items)
        .drop("total")
    )


def budgeted(chunks: DataFrame, budget: int, *partition: str) -> DataFrame:
    """Keep leading text until ``budget`` characters of each partition are used up."""
    window = Window.partitionBy(*partition).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("chunk_text").cast("long")
    left = F.lit(budget) - F.coalesce(F.sum(size).over(window), F.lit(0))
    return (
        chunks.withColumn("taken_chars", F.greatest(F.lit(0).cast("long"), F.least(size, left)))
        .filter(F.col("taken_chars") > 0)
        .withColumn("excerpt", F.expr("substring(chunk_text, 1, cast(taken_chars as int))"))
    )


def read_section(chunks: DataFrame, budget: int, *keys: str) -> DataFrame:
    """Budgeted text of every section."""
    return budgeted(with_sections(chunks, *keys), budget, *keys, "document_id", "section_no")


def requested_excerpts(chunks: DataFrame, wanted: DataFrame, limit: int) -> DataFrame:
    """Excerpts of the requested chunks with the request position; ``wanted(position, chunk_id)``."""
    return (
        chunks.join(wanted, "chunk_id")
        .withColumn("excerpt", tx.excerpt("chunk_text", limit))
        .withColumn("truncated", tx.is_truncated("chunk_text", limit))
    )


def asset_summary(assets: DataFrame, chunks: DataFrame, *keys: str) -> DataFrame:
    """Assets with their chunk count; an asset without chunks counts 0."""
    counts = chunks.groupBy(*keys, "asset_id").agg(F.count("chunk_id").alias("chunk_count"))
    return (
        assets.join(counts, [*keys, "asset_id"], "left")
        .withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
        .select(
            *keys, "document_id", "asset_id", "extraction_method", "extraction_status", "page_count",
            "extracted_char_count", "chunk_count",
        )
    )


# --- list view -----------------------------------------------------------------------------------


def listing(documents: DataFrame) -> DataFrame:
    """Kind, shown title and subtitle of a document list; ``documents`` carries ``chunk_count``."""
    lower_name = F.lower(F.coalesce("source_name", F.lit("")))
    pdf = F.lower(F.coalesce("media_type", F.lit(""))).contains("pdf") | lower_name.endswith(".pdf")
    topics = F.array_join(F.slice("topics", 1, 3), " · ")
    subtitle = F.concat_ws(
        " · ",
        F.nullif(F.col("material_type"), F.lit("")),
        F.nullif(topics, F.lit("")),
        F.when(F.col("chunk_count").isNotNull(), F.concat(F.lit("chunks: "), "chunk_count")),
    )
    return documents.select(
        "*",
        F.when(pdf, "PDF").otherwise("MD").alias("kind"),
        F.coalesce(F.nullif("title", F.lit("")), F.nullif("source_name", F.lit("")), "document_id").alias("shown_title"),
        F.coalesce(F.nullif(subtitle, F.lit("")), "document_id").alias("subtitle"),
    )


def filter_listing(listed: DataFrame, needle: str = "", kind: str = "all") -> DataFrame:
    haystack = F.lower(F.concat_ws(" ", "shown_title", F.coalesce("source_name", F.lit("")), "subtitle"))
    kept = listed if kind == "all" else listed.filter(F.col("kind") == kind)
    return kept.filter(haystack.contains(needle.lower()))

"""Heading-aware chunking of Markdown and page-scoped chunking of extracted PDF text.

One document is one row, so everything here is a narrow projection without a shuffle. Lines are split, cleaned and measured
in the JVM. The sequential part (heading stack, greedy packing to 1200 characters) is a small function over line sizes,
levels and flags, exchanged as Arrow batches: an ``aggregate`` over the row copies its whole state at every line, which
grows with the square of a file. Chunk texts are then cut from the lines in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from excerpta.functions import identity, text as tx


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable: evaluated once per row however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add an expensive column that later filters and projections must not duplicate.

    The optimizer substitutes a projected expression into every filter and projection above it;
    it does not do so across a generator, and this one yields exactly one row per input row.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def _lines(source: Column, headings: bool, page: Column | None = None) -> Column:
    """Non-blank numbered lines; a line beyond the limit becomes fixed-width pieces marked solo."""
    page = (F.lit(None) if page is None else page).cast("int").alias("page")

    def number(raw, index):
        line = (index + 1).cast("int")
        if headings:
            level = F.when(raw.startswith("#"), F.length(F.regexp_extract(raw, tx.HEADING, 1))).otherwise(0)
            title = tx.clean_title(F.regexp_extract(raw, tx.HEADING, 2), tx.UNTITLED_SECTION)
            shown = F.when(level > 0, title).otherwise(tx.collapse_line(raw))
        else:
            level, shown = F.lit(0), tx.collapse_line(raw)
        return F.struct(
            line.alias("line"),
            level.cast("int").alias("level"),
            shown.alias("text"),
            F.length(shown).alias("chars"),
            F.lit(False).alias("solo"),
            page,
        )

    numbered = F.filter(F.transform(tx.split_lines(source), number), lambda item: item["text"] != "")

    def pieces(item):
        cut = F.regexp_extract_all(item["text"], F.lit(rf"(?s).{{1,{tx.MAX_CHUNK_CHARS}}}"), F.lit(0))
        kept = F.filter(F.transform(cut, tx.strip), lambda piece: piece != "")
        wide = F.transform(
            kept,
            lambda piece: F.struct(
                item["line"].alias("line"),
                F.lit(0).alias("level"),
                piece.alias("text"),
                F.length(piece).alias("chars"),
                F.lit(True).alias("solo"),
                page,
            ),
        )
        return F.when(item["chars"] > tx.MAX_CHUNK_CHARS, wide).otherwise(F.array(item))

    def widen(lines):
        too_wide = F.exists(lines, lambda item: item["chars"] > tx.MAX_CHUNK_CHARS)
        return F.when(too_wide, F.flatten(F.transform(lines, pieces))).otherwise(lines)

    return let(numbered, widen)


def chunk_starts(levels, sizes, solo, pages):
    """Positions where a chunk starts, each with the positions of the headings in force there.

    A chunk starts at a heading, at a solo line and after one, on a new page, and where one more line would exceed the
    limit. One pass over small integers; the texts stay where they are. A null text has no lines and no chunks.
    """
    out, path, size, page = [], [], -1, None
    if levels is None:
        return out
    for at, (level, chars, alone, own) in enumerate(zip(levels, sizes, solo, pages)):
        if level:
            path = path[: level - 1] + [at]
        if size < 0 or level or alone or own != page or size + 1 + chars > tx.MAX_CHUNK_CHARS:
            out.append((at, path))
            size = chars
        else:
            size += 1 + chars
        page = own
        if alone:
            size = -1
    return out


def packed(df: DataFrame, name: str, lines: Column) -> DataFrame:
    """Adds ``name``: the chunks of ``lines`` in order (text, heading path, line range, page) and the first level-1 heading."""
    starts = F.udf(chunk_starts, "array<struct<at:int,path:array<int>>>", useArrow=True)
    held = once(df, "_lines", lines)
    held = once(held, "_starts", starts("_lines.level", "_lines.chars", "_lines.solo", "_lines.page"))

    def piece(start, index):
        until = F.coalesce(F.get("_starts", index + 1)["at"], F.size("_lines"))
        part = F.slice("_lines", start["at"] + 1, until - start["at"])
        return F.struct(
            F.array_join(F.transform(part, lambda item: item["text"]), "\n").alias("chunk_text"),
            F.transform(start["path"], lambda at: F.get("_lines", at)["text"]).alias("heading_path"),
            F.element_at(part, 1)["line"].alias("first_line"),
            F.element_at(part, -1)["line"].alias("last_line"),
            F.element_at(part, 1)["page"].alias("page"),
        )

    titles = F.filter("_lines", lambda item: item["level"] == 1)
    made = F.struct(F.transform("_starts", piece).alias("pieces"), F.get(titles, F.lit(0))["text"].alias("first_h1"))
    return once(held, name, made).drop("_lines", "_starts")


def markdown_anchor(first_line: Column, last_line: Column, heading_path: Column) -> Column:
    base = F.concat(F.lit("Markdown lines "), first_line, F.lit("-"), last_line)
    return F.when(
        F.size(heading_path) > 0, F.concat(base, F.lit(" · "), F.array_join(heading_path, " / "))
    ).otherwise(base)


def pdf_anchor(page: Column) -> Column:
    return F.concat(F.lit("PDF page "), page)


def markdown_documents(sources: DataFrame) -> DataFrame:
    """``sources(source_name, content_text, ...)`` to one row per document with its chunks nested.

    Adds identity, title and ``chunks``. Documents without any letter, number or chunk are kept
    with ``import_status`` so that the caller can refuse the batch.
    """
    digest = F.sha2(F.encode("content_text", "UTF-8"), 256)
    chunks = F.transform(
        "_packed.pieces",
        lambda piece, index: F.struct(
            (index + 1).cast("int").alias("ordinal"),
            piece["chunk_text"].alias("chunk_text"),
            piece["heading_path"].alias("heading_path"),
            F.lit(None).cast("int").alias("pdf_page_start"),
            F.lit(None).cast("int").alias("pdf_page_end"),
            piece["first_line"].alias("source_line_start"),
            piece["last_line"].alias("source_line_end"),
            markdown_anchor(piece["first_line"], piece["last_line"], piece["heading_path"]).alias("anchor_label"),
        ),
    )
    stem = tx.clean_title(tx.file_stem("source_name"), tx.UNTITLED_DOCUMENT)
    hint = F.coalesce(F.col("title_hint"), F.lit(""))
    made = packed(sources, "_packed", _lines(F.col("content_text"), headings=True))
    if "source_sha256" not in made.columns:
        made = made.withColumn("source_sha256", digest)
    if "byte_size" not in made.columns:
        made = made.withColumn("byte_size", F.octet_length("content_text").cast("long"))
    return (
        made.withColumn("title_hint", F.coalesce("_packed.first_h1", F.lit("")))
        .withColumn("chunks", chunks)
        .drop("_packed")
        .withColumn("document_id", identity.document_id("source_name", "source_sha256"))
        .withColumn("asset_id", identity.asset_id("source_name", "source_sha256"))
        .withColumn("title", F.when(hint == "", stem).otherwise(tx.clean_title(hint, stem)))
        .withColumn("media_type", F.lit("text/markdown"))
        .withColumn("extraction_method", F.lit("native_utf8_markdown"))
        .withColumn("extraction_status", F.lit("native_text"))
        .withColumn("page_count", F.lit(None).cast("int"))
        .withColumn("extracted_char_count", _total_chars(F.col("chunks")))
        .withColumn(
            "import_status",
            F.when((F.size("chunks") == 0) | (tx.visible_chars("content_text") < 1), "no_text").otherwise("ok"),
        )
    )


def pdf_documents(sources: DataFrame) -> DataFrame:
    """``sources(source_name, source_sha256, byte_size, units, pdf_title, ...)`` likewise, page by page."""

    def piece(piece, index):
        return F.struct(
            (index + 1).cast("int").alias("ordinal"),
            piece["chunk_text"].alias("chunk_text"),
            F.array().cast("array<string>").alias("heading_path"),
            piece["page"].alias("pdf_page_start"),
            piece["page"].alias("pdf_page_end"),
            F.lit(None).cast("int").alias("source_line_start"),
            F.lit(None).cast("int").alias("source_line_end"),
            pdf_anchor(piece["page"]).alias("anchor_label"),
        )

    lines = F.flatten(F.transform("units", lambda unit, index: _lines(unit, False, index + 1)))
    stem = tx.clean_title(tx.file_stem("source_name"), tx.UNTITLED_DOCUMENT)
    visible = F.aggregate("units", F.lit(0), lambda total, unit: total + tx.visible_chars(unit))
    return (
        packed(sources, "_packed", lines)
        .withColumn("chunks", F.transform("_packed.pieces", piece))
        .drop("_packed")
        .withColumn("title_hint", F.lit(""))
        .withColumn("document_id", identity.document_id("source_name", "source_sha256"))
        .withColumn("asset_id", identity.asset_id("source_name", "source_sha256"))
        .withColumn("title", tx.clean_title(F.nullif(F.col("pdf_title"), F.lit("")), stem))
        .withColumn("media_type", F.lit("application/pdf"))
        .withColumn("extraction_method", F.lit("pypdf_text_layer"))
        .withColumn("extraction_status", F.lit("text_layer"))
        .withColumn("page_count", F.size("units").cast("int"))
        .withColumn("extracted_char_count", _total_chars(F.col("chunks")))
        .withColumn("import_status", F.when((visible < 10) | (F.size("chunks") == 0), "no_text").otherwise("ok"))
        .drop("pdf_title")
    )


def _total_chars(chunks: Column) -> Column:
    return F.aggregate(chunks, F.lit(0).cast("long"), lambda total, chunk: total + F.length(chunk["chunk_text"]))


def explode_chunks(documents: DataFrame, *keep: str) -> DataFrame:
    """One row per chunk, with its derived id."""
    # explode_outer plus a filter: plain explode would make the optimizer repeat the whole chunking
    # expression in an inferred size(...) > 0 filter below the generator.
    rows = (
        documents.select(*keep, "document_id", "asset_id", F.explode_outer("chunks").alias("_c"))
        .filter(F.col("_c").isNotNull())
        .select(*keep, "document_id", "asset_id", "_c.*")
    )
    return rows.withColumn("chunk_id", identity.chunk_id("document_id", "ordinal", "anchor_label", "chunk_text"))


def chunk_pages(pages: DataFrame, key: str, page: str, column: str) -> DataFrame:
    """Page-scoped chunks where every page is its own row.

    Each page is packed where it lies. Only page sizes are shuffled to number the chunks through a
    document, and a document of any length is numbered block by block (see ``running_offset``).
    """
    paged = pages.select(key, F.col(page).alias("_page"), F.col(column).alias("_text"))
    made = packed(paged, "_packed", _lines(F.col("_text"), headings=False))
    sized = made.select(key, "_page", F.col("_packed.pieces").alias("_pieces"), F.size("_packed.pieces").alias("_n"))
    offsets = running_offset(sized.select(key, "_page", "_n"), key, "_page", "_n")
    placed = sized.join(offsets, [key, "_page"])
    return placed.select(
        key,
        F.col("_page").alias("page"),
        "_offset",
        F.posexplode("_pieces").alias("_i", "_piece"),
    ).select(
        key,
        "page",
        (F.col("_offset") + F.col("_i") + 1).cast("long").alias("ordinal"),
        F.col("_piece.chunk_text").alias("chunk_text"),
        pdf_anchor(F.col("page")).alias("anchor_label"),
    )


def running_offset(rows: DataFrame, key: str, position: str, amount: str, block: int = 65_536) -> DataFrame:
    """Sum of ``amount`` over earlier positions of the same key, without one task per key.

    Positions are cut into blocks; a hot key is summed per block in parallel, the block totals
    (one row per block) are accumulated, and each block adds its own start.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(position) / block))
    totals = blocked.groupBy(key, "_block").agg(F.sum(amount).alias("_total"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(key, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(key, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocked.withColumn("_inner", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(starts, [key, "_block"])
        .select(key, position, (F.col("_inner") + F.col("_start")).alias("_offset"))
    )

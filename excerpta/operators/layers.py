"""Memoised layers of a document: what the bytes were parsed to, and what that was cut into.

A layer is named by the digest it was made from and the identity of the step that made it. The memo lists the object that
each such pair gave. Under other steps the memo is asked first: a layer it knows is read from the store, a layer below which
nothing changed is decoded and not made again, and only the rest is computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from excerpta.functions.identity import canonical_json
from excerpta.operators import chunking, objects

MEMO = "kind string, upstream string, step string, sha256 string"


def step_id(steps, name) -> Column:
    """Digest of the step that makes a row's layer, by its media type; null for a type without steps."""
    chosen = F.lit(None).cast("string")
    for media_type, identity in steps.items():
        chosen = F.when(F.col("media_type") == media_type, F.sha2(F.lit(canonical_json(identity[name])), 256)).otherwise(chosen)
    return chosen


def memo(payloads: DataFrame, steps=objects.STEPS) -> DataFrame:
    """Memo rows of :func:`objects.object_payloads` rows that also carry ``media_type``; copies of a document are one."""
    step = F.when(F.col("kind") == "parsed", step_id(steps, "parser")).otherwise(step_id(steps, "chunker"))
    made = payloads.filter(F.col("kind") != "source").select("kind", "upstream", step.alias("step"), "sha256")
    return made.filter("step is not null").distinct()


def plan(documents: DataFrame, known: DataFrame, steps=objects.STEPS) -> DataFrame:
    """``documents`` (media_type, source_sha256, ...) with ``parsed_sha256`` and ``chunks_sha256``: the objects the memo has
    for the layers under ``steps``, null where a layer must be made.

    A layer above one that must be made has no upstream yet, so it must be made too. The memo is keyed by digest: one row
    per key meets any number of copies, and adaptive execution splits a key with very many.
    """

    def known_layer(kind, upstream, step, name):
        rows = known.filter(F.col("kind") == kind).groupBy("upstream", "step").agg(F.min("sha256").alias(name))
        return rows.withColumnsRenamed({"upstream": upstream, "step": step})

    asked = documents.withColumns({"_parser": step_id(steps, "parser"), "_chunker": step_id(steps, "chunker")})
    parsed = asked.join(known_layer("parsed", "source_sha256", "_parser", "parsed_sha256"), ["source_sha256", "_parser"], "left")
    cut = parsed.join(known_layer("chunks", "parsed_sha256", "_chunker", "chunks_sha256"), ["parsed_sha256", "_chunker"], "left")
    return cut.drop("_parser", "_chunker")


def cut_again(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents whose parsed layer is kept, chunked from its stored object; the source bytes are not read.

    ``documents(source_name, source_sha256, byte_size, title, media_type, parsed_sha256, ...)``; ``stored(kind, sha256,
    payload)``. A document whose object is absent or does not decode strictly gives no row.
    """
    wanted = documents.select(F.col("parsed_sha256").alias("sha256")).distinct()
    units = objects.decoded(stored, "parsed", wanted).filter("fault is null").select(F.col("sha256").alias("parsed_sha256"), "o.payload.units")
    rows = documents.drop("document_id", "asset_id", "chunks_sha256").join(units, "parsed_sha256")
    markdown = rows.filter("media_type = 'text/markdown'").withColumn("content_text", F.get("units", F.lit(0)))
    pages = rows.filter("media_type = 'application/pdf'").withColumnRenamed("title", "pdf_title").withColumn("content_text", F.lit(""))
    made = chunking.markdown_documents(markdown.drop("title"))
    cut = chunking.pdf_documents(pages)
    return made.unionByName(cut.select(*made.columns))


def parse_again(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """``documents`` with the ``content`` of their stored source objects, whose digest is checked."""
    wanted = documents.select(F.col("source_sha256").alias("sha256")).distinct()
    held = stored.filter("kind = 'source'").join(wanted, "sha256", "left_semi").filter(F.sha2("payload", 256) == F.col("sha256"))
    held = held.dropDuplicates(["sha256"]).select(F.col("sha256").alias("source_sha256"), F.col("payload").alias("content"))
    return documents.join(held, "source_sha256")


def kept_chunks(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """``documents`` with the ``chunks`` of their stored chunk objects."""
    wanted = documents.select(F.col("chunks_sha256").alias("sha256")).distinct()
    cut = objects.decoded(stored, "chunks", wanted).filter("fault is null")
    return documents.join(cut.select(F.col("sha256").alias("chunks_sha256"), F.col("o.payload.chunks").alias("chunks")), "chunks_sha256")


def states(planned: DataFrame) -> DataFrame:
    """``planned`` with the columns ``parsed`` and ``chunks_layer``: reused or rebuilt."""
    state = lambda c: F.when(F.col(c).isNull(), "rebuilt").otherwise("reused")
    return planned.withColumns({"parsed": state("parsed_sha256"), "chunks_layer": state("chunks_sha256")})

"""Fixed table schemas. Reads always name them; nothing is inferred or merged."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA_VERSION = 1

DOCUMENT = (
    "document_id string, title string, identifiers map<string,string>, source_name string, "
    "source_type string, media_type string, material_type string, language string, "
    "topics array<string>, evidence_role string, fulltext_verified boolean, formula_verified boolean"
)
ASSET = (
    "asset_id string, document_id string, stored_path string, source_sha256 string, byte_size bigint, "
    "extraction_method string, extraction_status string, page_count int, extracted_char_count bigint"
)
CHUNK = (
    "chunk_id string, document_id string, asset_id string, ordinal int, chunk_text string, "
    "heading_path array<string>, pdf_page_start int, pdf_page_end int, source_line_start int, "
    "source_line_end int, anchor_label string, fulltext_verified boolean, formula_verified boolean"
)
OBJECT_REF = (
    "document_id string, kind string, sha256 string, byte_size bigint, path string, created_in_snapshot boolean"
)
OBJECT = "sha256 string, byte_size bigint, payload binary"
POSTING = "document_id string, chunk_id string, length int, position int, term string"
LENGTH = "document_id string, chunk_id string, length bigint"
VECTOR_MAP = "chunk_id string, vector_object_id string"
VECTOR_OBJECT = (
    "vector_object_id string, input_sha256 string, input_byte_size bigint, payload_sha256 string, "
    "payload_byte_size bigint, payload binary, created_in_artifact boolean"
)

TABLES = {
    "document": DOCUMENT,
    "asset": ASSET,
    "chunk": CHUNK,
    "posting": POSTING,
    "length": LENGTH,
}


def struct(name) -> StructType:
    return StructType.fromDDL(TABLES.get(name, name))


def schema_sha256() -> str:
    """Identity of the whole table layout, kept in every manifest and compared on open."""
    layout = "\n".join(f"{name}:{ddl}" for name, ddl in sorted(TABLES.items()))
    return hashlib.sha256(layout.encode()).hexdigest()


# Evidence columns every retrieval tool returns; no paths, no hashes.
EVIDENCE = (
    "document_id", "asset_id", "chunk_id", "title", "identifiers", "source_name", "media_type",
    "material_type", "language", "topics", "evidence_role", "heading_path", "pdf_page_start",
    "pdf_page_end", "source_line_start", "source_line_end", "anchor_label", "fulltext_verified",
    "formula_verified",
)


def document_rows(prepared):
    """Document table of imported sources, with the constants an import always sets."""
    return prepared.select(
        "document_id",
        "title",
        F.create_map().cast("map<string,string>").alias("identifiers"),
        "source_name",
        F.lit("local_file").alias("source_type"),
        "media_type",
        F.when(F.col("media_type") == "application/pdf", "pdf").otherwise("markdown").alias("material_type"),
        F.lit("und").alias("language"),
        F.array().cast("array<string>").alias("topics"),
        F.lit("imported_source").alias("evidence_role"),
        F.lit(False).alias("fulltext_verified"),
        F.lit(False).alias("formula_verified"),
    )


def source_path():
    return F.concat(F.lit("objects/source/"), "source_sha256", F.lit("/payload"))


def asset_rows(prepared):
    return prepared.select(
        "asset_id",
        "document_id",
        source_path().alias("stored_path"),
        "source_sha256",
        "byte_size",
        "extraction_method",
        "extraction_status",
        "page_count",
        "extracted_char_count",
    )


def chunk_rows(prepared):
    from excerpta.operators.chunking import explode_chunks

    return explode_chunks(prepared).select(
        "chunk_id", "document_id", "asset_id", "ordinal", "chunk_text", "heading_path",
        "pdf_page_start", "pdf_page_end", "source_line_start", "source_line_end", "anchor_label",
        F.lit(False).alias("fulltext_verified"), F.lit(False).alias("formula_verified"),
    )

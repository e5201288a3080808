"""Import, chunking, identity and navigation queries, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from excerpta.functions import identity, text as tx
from excerpta.operators import chunking, navigation
from excerpta.plans import inputs as io
from excerpta.schemas import asset_rows, document_rows
from excerpta.sources import uploads

LIBRARY = "lib_" + "0" * 32
SNAPSHOT = "20240101T000000000000Z-" + "0" * 12 + "-" + "0" * 8


def chunk_counts(spark, sf):
    return io.chunks(spark, sf, "lang").groupBy("lang").agg(
        F.countDistinct("document_id").alias("documents"),
        F.count("*").alias("chunks"),
        F.sum(F.length("chunk_text")).alias("chars"),
        F.max(F.length("chunk_text")).cast("long").alias("longest"),
    )


def _chunk_table(headings):
    def run(spark, sf):
        return io.chunks(spark, sf, "doc_id", headings=headings).select(
            "doc_id",
            F.col("ordinal").cast("long").alias("ordinal"),
            F.col("source_line_start").cast("long").alias("line_start"),
            F.col("source_line_end").cast("long").alias("line_end"),
            "anchor_label",
            identity.sha256("chunk_text").alias("text_sha256"),
        )

    return run


def heading_paths(spark, sf):
    return (
        io.chunks(spark, sf)
        .groupBy(F.array_join("heading_path", " / ").alias("path"), F.size("heading_path").cast("long").alias("depth"))
        .agg(F.count("*").alias("chunks"))
    )


def document_ids(spark, sf):
    made = io.prepared(spark, sf)
    return made.select(
        "doc_id", "document_id", "asset_id", "title", "source_sha256", "byte_size", "extracted_char_count",
        F.size("chunks").cast("long").alias("chunk_count"),
    )


def chunk_ids(spark, sf):
    return io.chunks(spark, sf, "doc_id").select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "chunk_id")


def corpus_hash(spark, sf):
    made = io.files(spark, sf).select(
        "lang", "source_name", F.sha2(F.encode("content_text", "UTF-8"), 256).alias("source_sha256")
    )
    members = made.withColumn("document_id", identity.document_id("source_name", "source_sha256"))
    return identity.corpus_digest(members, "lang")


def import_checks(spark, sf):
    """What the importer looks at before it accepts a file."""
    raw = io.table(spark, sf, "documents").select("lang", F.encode("text", "UTF-8").alias("content"), "text")
    return raw.groupBy("lang").agg(
        F.count("*").alias("files"),
        F.sum(F.octet_length("content")).cast("long").alias("bytes"),
        F.count_if(F.is_valid_utf8(F.col("content").cast("string"))).alias("valid_utf8"),
        F.count_if(F.col("text").contains("�")).alias("replacement_chars"),
        F.sum(tx.visible_chars("text")).cast("long").alias("visible_chars"),
        F.count_if(tx.visible_chars("text") < 1).alias("without_text"),
    )


def upload_collisions(spark, sf):
    """Names of one upload batch that differ only in case or Unicode form."""
    names = io.table(spark, sf, "pages").select(
        F.regexp_extract("url", r"^https?://([^/]+)/", 1).alias("batch"),
        F.concat(F.regexp_extract("url", r"^https?://[^/]+/([A-Za-z]+)/", 1), F.lit(".MD")).alias("name"),
        F.octet_length("html").cast("long").alias("byte_size"),
    )
    return uploads.batch_faults(names, "batch")


def page_chunks(spark, sf):
    """Conversations as paged documents: one turn, one page; chunks never span pages."""
    pages = io.table(spark, sf, "conversations").withColumn("page", F.col("turn") + 1)
    return chunking.chunk_pages(pages, "conv_id", "page", "text").select(
        "conv_id", "page", "ordinal", "anchor_label", identity.sha256("chunk_text").alias("text_sha256")
    )


def toc_sections(spark, sf):
    rows = navigation.toc(io.navigable(spark, sf, "doc_id"), F.lit(LIBRARY), F.lit(SNAPSHOT), 100, "doc_id")
    return rows.select(
        "doc_id",
        F.col("section_no").cast("long").alias("section_no"),
        "section_id",
        F.array_join("heading_path", " / ").alias("path"),
        F.col("source_line_start").cast("long").alias("line_start"),
        F.col("source_line_end").cast("long").alias("line_end"),
        "first_chunk_id",
        "last_chunk_id",
        "chunk_count",
        "truncated",
    )


def toc_limited(spark, sf):
    rows = navigation.toc(io.navigable(spark, sf, "doc_id"), F.lit(LIBRARY), F.lit(SNAPSHOT), 3, "doc_id")
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("items"), F.max("truncated").alias("truncated"), F.sum("chunk_count").alias("chunks")
    )


def section_reads(spark, sf):
    """Every section read with the default budget."""
    rows = navigation.read_section(io.navigable(spark, sf, "doc_id"), 1200, "doc_id")
    return rows.select(
        "doc_id",
        F.col("section_no").cast("long").alias("section_no"),
        F.col("ordinal").cast("long").alias("ordinal"),
        "taken_chars",
        identity.sha256("excerpt").alias("excerpt_sha256"),
    )


def excerpt_batch(spark, sf):
    """First, middle and last chunk of every document, requested in reverse order."""
    made = io.prepared(spark, sf)
    wanted = made.select("document_id", F.size("chunks").alias("n")).select(
        "document_id",
        F.posexplode(F.array_distinct(F.array("n", F.floor((F.col("n") + 1) / 2).cast("int"), F.lit(1)))).alias("position", "ordinal"),
    )
    rows = chunking.explode_chunks(made, "doc_id").join(wanted, ["document_id", "ordinal"])
    return rows.select(
        "doc_id",
        F.col("position").cast("long").alias("position"),
        "chunk_id",
        tx.excerpt("chunk_text", 600).alias("excerpt"),
        tx.is_truncated("chunk_text", 600).alias("truncated"),
    )


def document_metadata(spark, sf):
    made = io.prepared(spark, sf)
    summary = navigation.asset_summary(asset_rows(made), chunking.explode_chunks(made))
    about = document_rows(made).select(
        "document_id", "title", "source_name", "source_type", "media_type", "material_type", "language", "evidence_role",
        F.size("topics").cast("long").alias("topics"), "fulltext_verified", "formula_verified",
    )
    return about.join(summary, "document_id").select(
        *about.columns, "asset_id", "extraction_method", "extraction_status",
        F.col("page_count").cast("long").alias("page_count"), "extracted_char_count", "chunk_count",
    )


def document_list(spark, sf):
    """The list view narrowed by media kind and a search string."""
    made = io.prepared(spark, sf).select(
        "document_id", "title", "source_name", "media_type", F.lit("markdown").alias("material_type"),
        F.array("lang", "source").alias("topics"), F.size("chunks").alias("chunk_count"),
    )
    shown = navigation.filter_listing(navigation.listing(made), "SRC1", "MD")
    return shown.select("document_id", "kind", "shown_title", "subtitle")


def evidence_columns(spark, sf):
    """The public evidence projection over every chunk."""
    documents, chunks = io.documents_and_chunks(spark, sf)
    verified = chunks.withColumn("fulltext_verified", F.lit(False)).withColumn("formula_verified", F.lit(False))
    rows = navigation.evidence(verified, documents)
    return rows.groupBy("source_name", "title", "media_type", "material_type", "language", "evidence_role").agg(
        F.count("*").alias("chunks"),
        F.min("source_line_start").cast("long").alias("first_line"),
        F.max("source_line_end").cast("long").alias("last_line"),
        F.count_if(F.col("pdf_page_start").isNotNull()).alias("paged"),
        F.count_if(F.col("fulltext_verified") | F.col("formula_verified")).alias("promoted"),
    )


QUERIES = {
    "chunk_count_by_lang": chunk_counts,
    "chunk_pack": _chunk_table(False),
    "chunk_pack_headings": _chunk_table(True),
    "heading_paths": heading_paths,
    "document_ids": document_ids,
    "chunk_ids": chunk_ids,
    "corpus_hash": corpus_hash,
    "import_checks": import_checks,
    "upload_collisions": upload_collisions,
    "page_chunks": page_chunks,
    "toc_sections": toc_sections,
    "toc_truncated": toc_limited,
    "section_read_budget": section_reads,
    "excerpt_batch": excerpt_batch,
    "document_metadata": document_metadata,
    "doc_filter_list": document_list,
    "evidence_projection": evidence_columns,
}

CHUNKS = io.sql_chunks()
TITLES = """titles AS (
  SELECT ids.*, coalesce(h.title, 'doc-' || doc_id) AS title FROM ids LEFT JOIN (
    SELECT doc_id, min_by(body, line) AS title FROM cleaned WHERE lvl = 1 GROUP BY doc_id) h USING (doc_id)),
sizes AS (
  SELECT doc_id, count(*) AS chunk_count, sum(length(chunk_text))::BIGINT AS extracted_char_count FROM chunks GROUP BY doc_id)"""
SECTIONS = f"""runs AS (
  SELECT *, CASE WHEN heading_path IS NOT DISTINCT FROM lag(heading_path) OVER w AND ordinal > 1 THEN 0 ELSE 1 END AS opens
  FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY ordinal)::BIGINT AS section_no FROM runs),
sections AS (
  SELECT doc_id, section_no, any_value(document_id) AS document_id, any_value(asset_id) AS asset_id,
    any_value(heading_path) AS heading_path, min(line_start)::BIGINT AS line_start, max(line_end)::BIGINT AS line_end,
    min_by(chunk_id, ordinal) AS first_chunk_id, max_by(chunk_id, ordinal) AS last_chunk_id, count(*) AS chunk_count
  FROM numbered GROUP BY doc_id, section_no),
named AS (
  SELECT *, 'sec_' || substr(sha256('[' || concat_ws(',', '"{LIBRARY}"', '"{SNAPSHOT}"', to_json(document_id),
      to_json(asset_id), '"heading"', to_json(heading_path), 'null', to_json(first_chunk_id), to_json(last_chunk_id)) || ']'), 1, 24) AS section_id,
    max(section_no) OVER (PARTITION BY doc_id) AS total
  FROM sections)"""


def _chunk_table_sql(files):
    return f"""WITH {io.sql_chunks(files)}
SELECT doc_id, ordinal, line_start::BIGINT AS line_start, line_end::BIGINT AS line_end, anchor_label,
  sha256(chunk_text) AS text_sha256 FROM chunks"""


ORACLES = {
    "chunk_count_by_lang": f"""WITH {CHUNKS}
SELECT lang, count(DISTINCT document_id) AS documents, count(*) AS chunks, sum(length(chunk_text))::BIGINT AS chars,
  max(length(chunk_text)) AS longest FROM chunks GROUP BY lang""",
    "chunk_pack": _chunk_table_sql(io.PLAIN_FILES),
    "chunk_pack_headings": _chunk_table_sql(io.FILES),
    "heading_paths": f"""WITH {CHUNKS}
SELECT array_to_string(heading_path, ' / ') AS path, len(heading_path) AS depth, count(*) AS chunks FROM chunks GROUP BY ALL""",
    "document_ids": f"""WITH {CHUNKS}, {TITLES}
SELECT doc_id, document_id, asset_id, title, source_sha256, strlen(content_text) AS byte_size, extracted_char_count, chunk_count
FROM titles JOIN sizes USING (doc_id)""",
    "chunk_ids": f"WITH {CHUNKS} SELECT doc_id, ordinal, chunk_id FROM chunks",
    "corpus_hash": f"""WITH {io.FILES},
ids AS (SELECT lang, source_name, sha256(content_text) AS source_sha256,
  'doc_' || substr(sha256(source_name || chr(0) || sha256(content_text)), 1, 24) AS document_id FROM files),
{io.sql_digest("ids", "lang")}""",
    "import_checks": """SELECT lang, count(*) AS files, sum(strlen(text))::BIGINT AS bytes, count(*) AS valid_utf8,
  count(*) FILTER (contains(text, chr(65533))) AS replacement_chars,
  sum(length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')))::BIGINT AS visible_chars,
  count(*) FILTER (length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) < 1) AS without_text
FROM documents GROUP BY lang""",
    "upload_collisions": """WITH names AS (
  SELECT regexp_extract(url, '^https?://([^/]+)/', 1) AS batch,
    regexp_extract(url, '^https?://[^/]+/([A-Za-z]+)/', 1) || '.MD' AS name, strlen(html) AS byte_size FROM pages),
keyed AS (SELECT batch, byte_size, count(*) OVER (PARTITION BY batch, lower(nfc_normalize(name))) AS same FROM names)
SELECT batch, count(*) AS files, sum(byte_size)::BIGINT AS total_bytes, count(*) FILTER (same > 1) AS colliding_names,
  0::BIGINT AS invalid_names, count(*) FILTER (byte_size > 10485760) AS oversize_files, count(*) > 20 AS too_many_files,
  sum(byte_size) > 20971520 AS too_many_bytes FROM keyed GROUP BY batch""",
    "page_chunks": f"""WITH {io.sql_chunks('''files AS (
  SELECT conv_id * 1000000 + turn + 1 AS doc_id, '' AS lang, '' AS source, '' AS source_name,
    regexp_replace(text, '(^|\\n)#', '\\1 #', 'g') AS content_text FROM conversations)''')}
SELECT doc_id // 1000000 AS conv_id, doc_id % 1000000 AS page,
  row_number() OVER (PARTITION BY doc_id // 1000000 ORDER BY doc_id, ordinal) AS ordinal,
  'PDF page ' || doc_id % 1000000 AS anchor_label, sha256(chunk_text) AS text_sha256 FROM chunks""",
    "toc_sections": f"""WITH {CHUNKS}, {SECTIONS}
SELECT doc_id, section_no, section_id, array_to_string(heading_path, ' / ') AS path, line_start, line_end,
  first_chunk_id, last_chunk_id, chunk_count, total > 100 AS truncated FROM named WHERE section_no <= 100""",
    "toc_truncated": f"""WITH {CHUNKS}, {SECTIONS}
SELECT doc_id, count(*) AS items, bool_or(total > 3) AS truncated, sum(chunk_count)::BIGINT AS chunks
FROM named WHERE section_no <= 3 GROUP BY doc_id""",
    "section_read_budget": f"""WITH {CHUNKS}, {SECTIONS},
spent AS (
  SELECT *, coalesce(sum(length(chunk_text)) OVER (PARTITION BY doc_id, section_no ORDER BY ordinal
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM numbered),
taken AS (SELECT *, greatest(0, least(length(chunk_text), 1200 - used))::BIGINT AS taken_chars FROM spent)
SELECT doc_id, section_no, ordinal, taken_chars, sha256(substr(chunk_text, 1, taken_chars)) AS excerpt_sha256
FROM taken WHERE taken_chars > 0""",
    "excerpt_batch": f"""WITH {CHUNKS},
sized AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id),
asked AS (SELECT doc_id, u.o AS ordinal, u.p - 1 AS position
  FROM sized, unnest(CASE WHEN n = 1 THEN [1] WHEN n = 2 THEN [2, 1] ELSE [n, (n + 1) // 2, 1] END) WITH ORDINALITY AS u(o, p))
SELECT doc_id, position, chunk_id, substr(chunk_text, 1, 600) AS excerpt, length(chunk_text) > 600 AS truncated
FROM asked JOIN chunks USING (doc_id, ordinal)""",
    "document_metadata": f"""WITH {CHUNKS}, {TITLES}
SELECT document_id, title, source_name, 'local_file' AS source_type, 'text/markdown' AS media_type, 'markdown' AS material_type,
  'und' AS language, 'imported_source' AS evidence_role, 0::BIGINT AS topics, false AS fulltext_verified, false AS formula_verified,
  asset_id, 'native_utf8_markdown' AS extraction_method, 'native_text' AS extraction_status, NULL::BIGINT AS page_count,
  extracted_char_count, chunk_count FROM titles JOIN sizes USING (doc_id)""",
    "doc_filter_list": f"""WITH {CHUNKS}, {TITLES},
shown AS (SELECT document_id, 'MD' AS kind, title AS shown_title, source_name,
  'markdown · ' || lang || ' · ' || source || ' · chunks: ' || coalesce(chunk_count, 0) AS subtitle
  FROM titles LEFT JOIN sizes USING (doc_id))
SELECT document_id, kind, shown_title, subtitle FROM shown
WHERE contains(lower(shown_title || ' ' || source_name || ' ' || subtitle), 'src1')""",
    "evidence_projection": f"""WITH {CHUNKS}, {TITLES}
SELECT titles.source_name, title, 'text/markdown' AS media_type, 'markdown' AS material_type, 'und' AS language,
  'imported_source' AS evidence_role, count(*) AS chunks, min(line_start)::BIGINT AS first_line, max(line_end)::BIGINT AS last_line,
  0::BIGINT AS paged, 0::BIGINT AS promoted FROM titles JOIN chunks USING (doc_id) GROUP BY titles.source_name, title""",
}

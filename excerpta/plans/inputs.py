"""The driver's tables as library inputs, and the SQL fragments that mirror them for the oracle.

``documents`` stand in for Markdown files: one row, one file. The prose has no headings, so short
lines are marked as headings by an expression both engines evaluate.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from excerpta.operators import chunking
from excerpta.schemas import document_rows
from excerpta.session import spread_files

HEADING_RULES = ((r"(?m)^(.{1,12})$", "# "), (r"(?m)^([^#\n].{12,24})$", "## "), (r"(?m)^([^#\n].{25,39})$", "### "))


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark, sf, *keep):
    return spread_files(table(spark, sf, "documents").select(*keep, "doc_id", "text"))


def body(column="text"):
    text = F.col(column)
    for pattern, mark in HEADING_RULES:
        text = F.regexp_replace(text, pattern, f"{mark}$1")
    return text


def files(spark, sf, *, headings=True):
    """``doc_id, lang, source, source_name, content_text``."""
    return spread_files(table(spark, sf, "documents").select("doc_id", "lang", "source", "text")).select(
        "doc_id",
        "lang",
        "source",
        F.concat(F.lit("doc-"), "doc_id", F.lit(".md")).alias("source_name"),
        (body() if headings else F.col("text")).alias("content_text"),
    )


def prepared(spark, sf, *, headings=True):
    return chunking.markdown_documents(files(spark, sf, headings=headings))


def chunks(spark, sf, *keep, headings=True):
    return chunking.explode_chunks(prepared(spark, sf, headings=headings), *keep)


def navigable(spark, sf, *keep):
    """Chunks with the material type the section rules need."""
    return chunks(spark, sf, *keep).withColumn("material_type", F.lit("markdown"))


def documents_and_chunks(spark, sf):
    made = prepared(spark, sf)
    return document_rows(made), chunking.explode_chunks(made)


# --- oracle SQL ------------------------------------------------------------------------------------


def sql_body(column="text"):
    text = column
    for pattern, mark in HEADING_RULES:
        text = f"regexp_replace({text}, '{pattern}', '{mark}\\1', 'g')"
    return text


FILES = f"""files AS (
  SELECT doc_id, lang, source, 'doc-' || doc_id || '.md' AS source_name, {sql_body()} AS content_text
  FROM documents)"""

PLAIN_FILES = """files AS (
  SELECT doc_id, lang, source, 'doc-' || doc_id || '.md' AS source_name, text AS content_text FROM documents)"""

SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def sql_chunks(files_cte=FILES):
    """CTEs ``files .. chunks``: the chunking rules as folds over line lists."""
    return f"""{files_cte},
ids AS (
  SELECT *, sha256(content_text) AS source_sha256,
    'doc_' || substr(sha256(source_name || chr(0) || sha256(content_text)), 1, 24) AS document_id,
    'asset_' || substr(sha256(source_name || chr(0) || sha256(content_text)), 1, 24) AS asset_id
  FROM files),
raw_lines AS (
  SELECT doc_id, u.raw, u.line FROM ids,
    unnest(string_split_regex(content_text, '\\r\\n?|\\n')) WITH ORDINALITY AS u(raw, line)),
leveled AS (
  SELECT doc_id, line, raw, length(regexp_extract(raw, '^(#{{1,6}})\\s+.+', 1)) AS lvl FROM raw_lines),
cleaned AS (
  SELECT doc_id, line, lvl,
    CASE WHEN lvl > 0
      THEN coalesce(nullif(substr(trim(regexp_replace(regexp_extract(raw, '^#{{1,6}}\\s+(.+?)\\s*$', 1), '\\s+', ' ', 'g')), 1, 500), ''), 'Untitled section')
      ELSE trim(regexp_replace(raw, '[\\t ]+', ' ', 'g'), {SPACES}) END AS body
  FROM leveled),
pieces AS (
  SELECT doc_id, line, 0 AS part, lvl, body, false AS solo FROM cleaned WHERE body <> '' AND length(body) <= 1200
  UNION ALL
  SELECT doc_id, line, p AS part, 0 AS lvl, trim(substr(body, p * 1200 + 1, 1200), {SPACES}) AS body, true AS solo
  FROM cleaned, unnest(range(0, (length(body) + 1199) // 1200)) AS u(p)
  WHERE length(body) > 1200 AND trim(substr(body, p * 1200 + 1, 1200), {SPACES}) <> ''),
nested AS (
  SELECT doc_id, list({{'line': line::INT, 'lvl': lvl::INT, 'body': body, 'solo': solo}} ORDER BY line, part) AS items
  FROM pieces GROUP BY doc_id),
packed AS (
  SELECT doc_id, items, list_reduce(items,
    lambda acc, x: {{
      'brk': CASE WHEN acc.size < 0 OR x.lvl > 0 OR x.solo OR acc.size + 1 + length(x.body) > 1200
        THEN list_append(acc.brk, {{'at': acc.seen, 'path': CASE WHEN x.lvl > 0
          THEN list_append(acc.path[1:least(len(acc.path), x.lvl - 1)], x.body) ELSE acc.path END}})
        ELSE acc.brk END,
      'size': (CASE WHEN x.solo THEN -1
        WHEN acc.size < 0 OR x.lvl > 0 OR acc.size + 1 + length(x.body) > 1200 THEN length(x.body)
        ELSE acc.size + 1 + length(x.body) END)::INT,
      'seen': (acc.seen + 1)::INT,
      'path': CASE WHEN x.lvl > 0
        THEN list_append(acc.path[1:least(len(acc.path), x.lvl - 1)], x.body) ELSE acc.path END}},
    {{'brk': []::STRUCT("at" INT, path VARCHAR[])[], 'size': -1::INT, 'seen': 0::INT, 'path': []::VARCHAR[]}}).brk AS brk
  FROM nested),
placed AS (
  SELECT doc_id, items, brk, i AS ordinal, brk[i]."at" + 1 AS lo,
    CASE WHEN i < len(brk) THEN brk[i + 1]."at" ELSE len(items) END AS hi, brk[i].path AS heading_path
  FROM packed, unnest(range(1, len(brk) + 1)) AS u(i)),
anchored AS (
  SELECT doc_id, ordinal, heading_path,
    array_to_string(list_transform(items[lo:hi], lambda x: x.body), chr(10)) AS chunk_text,
    items[lo].line AS line_start, items[hi].line AS line_end,
    'Markdown lines ' || items[lo].line || '-' || items[hi].line ||
      CASE WHEN len(heading_path) > 0 THEN ' · ' || array_to_string(heading_path, ' / ') ELSE '' END AS anchor_label
  FROM placed),
chunks AS (
  SELECT ids.doc_id, ids.lang, ids.source, ids.source_name, ids.document_id, ids.asset_id, ordinal, heading_path,
    chunk_text, line_start, line_end, anchor_label,
    'chunk_' || substr(sha256(ids.document_id || chr(0) || ordinal || chr(0) || anchor_label || chr(0) || chunk_text), 1, 24) AS chunk_id
  FROM anchored JOIN ids USING (doc_id))"""


def sql_words(text):
    return f"regexp_extract_all(lower(strip_accents({text})), '[\\p{{L}}\\p{{N}}]+')"


def sql_bm25(corpus, key, text, phrases, groups=()):
    """CTEs ending in ``scored(groups.., key, score)`` for literal phrases given as word lists."""
    g = "".join(f"{name}, " for name in groups)
    on = f"USING ({', '.join(groups)})" if groups else "ON true"
    counts = []
    for i, phrase in enumerate(phrases):
        words = "[" + ", ".join(f"'{w}'" for w in phrase) + "]"
        n = len(phrase)
        counts.append(
            f"len(list_filter(w, lambda t: t = '{phrase[0]}')) AS f{i}" if n == 1
            else f"len(list_filter(range(1, len(w) - {n} + 2), lambda i: w[i:i + {n - 1}] = {words})) AS f{i}"
        )
    idfs = ", ".join(
        f"greatest(ln((count(*) - count(*) FILTER (f{i} > 0) + 0.5) / (count(*) FILTER (f{i} > 0) + 0.5)), 1e-6) AS idf{i}"
        for i in range(len(phrases))
    )
    score = " + ".join(
        f"idf{i} * (f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)))" for i in range(len(phrases))
    )
    hit = " OR ".join(f"f{i} > 0" for i in range(len(phrases)))
    grouped = f"GROUP BY {', '.join(groups)}" if groups else ""
    return f"""words AS (SELECT {g}{key}, {sql_words(text)} AS w FROM {corpus}),
freq AS (SELECT {g}{key}, len(w) AS dl, {', '.join(counts)} FROM words),
stats AS (SELECT {g}sum(dl) / count(*) AS avgdl, {idfs} FROM freq {grouped}),
scored AS (SELECT {g}{key}, -({score}) AS score FROM freq JOIN stats {on} WHERE {hit})"""


def sql_leaves(rows, key):
    """The corpus digest's leaves and nodes of ``rows`` (document_id, source_name, source_sha256) per ``key``; two steps of a WITH."""
    return f"""leaves AS (SELECT {key}, substr(document_id, 5, 6) AS leaf, count(*) AS members,
  sha256('[' || string_agg('{{"document_id":"' || document_id || '","source_name":"' || source_name || '","source_sha256":"'
    || source_sha256 || '"}}', ',' ORDER BY document_id) || ']') AS digest FROM {rows} GROUP BY ALL),
nodes AS (SELECT {key}, substr(leaf, 1, 3) AS node, sum(members) AS members, sha256(string_agg(digest, '' ORDER BY leaf)) AS digest
  FROM leaves GROUP BY ALL)"""


def sql_digest(rows, key):
    """The corpus digest per ``key``; the last steps of a WITH and its query."""
    return f"""{sql_leaves(rows, key)}
SELECT {key}, sum(members)::BIGINT AS members, sha256(string_agg(digest, '' ORDER BY node)) AS corpus_sha256 FROM nodes GROUP BY {key}"""

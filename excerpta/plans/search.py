"""Retrieval queries over the driver's documents, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from excerpta.functions import query as q, text as tx
from excerpta.operators import bm25, chunking
from excerpta.plans import inputs as io
from excerpta.session import settle

OR_QUERY = "Where is the attion, eriner and thanedble?"
MIXED_QUERY = "attion oument einlich erkeit cionll"
PHRASE_QUERY = "the_anea eaesth_thesedst attion"
REPEATED_QUERY = "attion attion ertion"
STOPWORD_QUERY = "the of"
IDENTIFIER_QUERY = "555-2373"
CHUNK_QUERY = "thanedble ertion the_the"


def _documents(query, k=10, places=6):
    def run(spark, sf):
        docs = io.texts(spark, sf)
        scored = bm25.score_scan(docs, q.checked_query(query), key="doc_id", text="text")
        return bm25.top_k(scored, k, key="doc_id").select("doc_id", F.round("score", places).alias("score"))

    return run


def _documents_sql(query, k=10, places=6):
    return f"""WITH {io.sql_bm25('documents', 'doc_id', 'text', q.phrases(query))}
SELECT doc_id, round(score, {places}) AS score FROM scored ORDER BY score, doc_id LIMIT {k}"""


def all_hits(spark, sf):
    docs = io.texts(spark, sf)
    return bm25.score_scan(docs, OR_QUERY, key="doc_id", text="text").select("doc_id", F.round("score", 6).alias("score"))


def by_library(spark, sf):
    docs = io.texts(spark, sf, "lang")
    scored = bm25.score_scan(docs, MIXED_QUERY, key="doc_id", text="text", groups=["lang"])
    return bm25.top_k(scored, 5, key="doc_id", groups=["lang"]).select(
        "lang", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score")
    )


def within_source(spark, sf):
    """Scope is applied after scoring: statistics stay those of the whole corpus."""
    docs = io.texts(spark, sf)
    scored = bm25.score_scan(docs, OR_QUERY, key="doc_id", text="text")
    scope = io.table(spark, sf, "documents").filter("source = 'src3'").select("doc_id")
    hits = scored.join(scope, "doc_id", "left_semi")
    return bm25.top_k(hits, 5, key="doc_id").select("doc_id", F.round("score", 6).alias("score"))


def chunk_evidence(spark, sf):
    """The search tool: best chunks with anchors and a bounded excerpt."""
    files = io.files(spark, sf)
    made = chunking.explode_chunks(chunking.markdown_documents(files), "doc_id")
    keyed = made.select("chunk_text", F.struct("chunk_id", "doc_id").alias("key"))
    scored = bm25.score_scan(keyed, CHUNK_QUERY, key="key", text="chunk_text").select("key.*", "score")
    # At most five rows, so both joins broadcast a proven bound; only the files of the hits are
    # chunked again for their text.
    best = F.broadcast(bm25.top_k(scored, 5, key="chunk_id"))
    hit_files = files.join(best.select("doc_id"), "doc_id", "left_semi")
    found = chunking.explode_chunks(chunking.markdown_documents(hit_files), "source_name")
    return found.join(best.drop("doc_id"), "chunk_id").select(
        "chunk_id",
        "document_id",
        "source_name",
        "anchor_label",
        F.array_join("heading_path", " / ").alias("heading_path"),
        F.col("source_line_start").cast("long").alias("source_line_start"),
        F.col("source_line_end").cast("long").alias("source_line_end"),
        F.round("score", 6).alias("score"),
        tx.excerpt("chunk_text", 240).alias("excerpt"),
        tx.is_truncated("chunk_text", 240).alias("truncated"),
    )


def find_in_documents(spark, sf):
    """Best chunk inside every matching document, scored against the whole corpus."""
    made = io.chunks(spark, sf)
    scored = bm25.score_scan(
        made.select("chunk_text", F.struct("document_id", "chunk_id").alias("key")), CHUNK_QUERY, key="key", text="chunk_text"
    ).select("key.document_id", "key.chunk_id", "score")
    return bm25.top_k(scored, 1, key="chunk_id", groups=["document_id"]).select(
        "document_id", "chunk_id", F.round("score", 6).alias("score")
    )


def batch(spark, sf):
    """Every benchmark item as a query against every document, best five each."""
    queries = io.table(spark, sf, "benchmark").select("item_id", "text")
    words = q.query_words(queries, "item_id", "text")
    docs = io.texts(spark, sf)
    stats = settle(bm25.corpus_stats(bm25.lengths(docs, key="doc_id", text="text")), "stats")
    # The number of tasks follows the number of words, which the statistics have.
    tasks = bm25.tasks_for(docs, stats.first()["tokens"] or 0)
    dealt = bm25.deal(io.table(spark, sf, "documents").select("doc_id", "text"), tasks, key="doc_id")
    scored = bm25.score_postings(
        bm25.postings(dealt, key="doc_id", text="text"), stats, words, key="doc_id", query_id="item_id"
    )
    scored = scored.withColumn("score", F.round("score", 9))
    top = bm25.top_k(scored, 5, key="doc_id", groups=["item_id"])
    asked = queries.select("item_id", q.query_status("text").alias("status"))
    # Every query is answered: one without a hit, or refused, has a row of rank 0.
    return asked.join(top, "item_id", "left").select(
        "item_id", "status", F.coalesce("rank", F.lit(0)).cast("long").alias("rank"), F.coalesce("doc_id", F.lit(-1)).alias("doc_id"),
        F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"),
    )


STOP_LIST = ", ".join(f"'{word}'" for word in q.STOPWORDS)
BATCH_SQL = f"""WITH normal AS (
  SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS qt FROM benchmark),
split AS (
  SELECT item_id, regexp_extract_all(qt, '[\\p{{L}}\\p{{N}}_]+') AS ws FROM normal
  WHERE length(qt) BETWEEN 1 AND 400),
content AS (
  SELECT item_id, CASE WHEN len(list_filter(ws, lambda x: lower(x) NOT IN ({STOP_LIST}))) > 0
    THEN list_filter(ws, lambda x: lower(x) NOT IN ({STOP_LIST})) ELSE ws END AS ws FROM split),
terms AS (SELECT item_id, u.i AS phrase, lower(strip_accents(u.w)) AS term
  FROM content, unnest(ws) WITH ORDINALITY AS u(w, i)),
tok AS (SELECT doc_id, {io.sql_words('text')} AS w FROM documents),
lens AS (SELECT doc_id, len(w) AS dl FROM tok),
tf AS (SELECT doc_id, t AS term, count(*) AS f FROM (SELECT doc_id, unnest(w) AS t FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS n FROM tf GROUP BY term),
st AS (SELECT count(*) AS total, sum(dl) / count(*) AS avgdl FROM lens),
part AS (
  SELECT item_id, doc_id, phrase,
    greatest(ln((total - n + 0.5) / (n + 0.5)), 1e-6) * (f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS p
  FROM terms JOIN tf USING (term) JOIN df USING (term) JOIN lens USING (doc_id) CROSS JOIN st),
scored AS (SELECT item_id, doc_id, round(-sum(p), 9) AS score FROM part GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score, doc_id) AS rank FROM scored)
SELECT item_id, CASE WHEN length(qt) NOT BETWEEN 1 AND 400 THEN 'refused' WHEN NOT regexp_matches(qt, '[\\p{{L}}\\p{{N}}_]') THEN 'empty'
  ELSE 'asked' END AS status, coalesce(rank, 0) AS rank, coalesce(doc_id, -1) AS doc_id, round(coalesce(score, 0), 6) AS score
FROM normal LEFT JOIN (SELECT * FROM ranked WHERE rank <= 5) USING (item_id)"""


def term_statistics(spark, sf):
    """Index vocabulary: total occurrences and documents per word."""
    docs = io.texts(spark, sf)
    posts = bm25.postings(docs, key="doc_id", text="text")
    per_doc = posts.groupBy("term", "doc_id").agg(F.count("*").alias("f"))
    return per_doc.groupBy("term").agg(F.sum("f").alias("occurrences"), F.count("*").alias("documents"))


def tied_copies(spark, sf):
    """Equal scores are ordered by key: the first 50 hits of each source with their ranks."""
    docs = io.texts(spark, sf, "source")
    scored = bm25.score_scan(docs, REPEATED_QUERY, key="doc_id", text="text", groups=["source"])
    ranked = scored.withColumn(
        "rank", F.row_number().over(Window.partitionBy("source").orderBy("score", "doc_id"))
    )
    # The filter on the rank cuts each task's rows before they meet, however many hits a source has.
    return ranked.filter("rank <= 50").select("source", "doc_id", F.col("rank").cast("long").alias("rank"))


def cjk_hint(spark, sf):
    """Documents whose text holds contiguous CJK, which the index does not segment."""
    docs = io.table(spark, sf, "documents")
    return docs.groupBy("lang").agg(
        F.count("*").alias("documents"), F.count_if(tx.contiguous_cjk("text")).alias("contiguous_cjk")
    )


_PHRASES = q.phrases(CHUNK_QUERY)

QUERIES = {
    "bm25_topk": _documents(OR_QUERY),
    "bm25_phrase": _documents(PHRASE_QUERY),
    "bm25_repeated_term": _documents(REPEATED_QUERY),
    "bm25_stopwords": _documents(STOPWORD_QUERY, places=12),
    "bm25_identifier": _documents(IDENTIFIER_QUERY),
    "bm25_all_hits": all_hits,
    "bm25_multi_snapshot": by_library,
    "bm25_in_scope": within_source,
    "bm25_chunk_evidence": chunk_evidence,
    "bm25_find_in_document": find_in_documents,
    "bm25_query_table": batch,
    "bm25_tie_order": tied_copies,
    "index_vocabulary": term_statistics,
    "cjk_hint": cjk_hint,
}

ORACLES = {
    "bm25_topk": _documents_sql(OR_QUERY),
    "bm25_phrase": _documents_sql(PHRASE_QUERY),
    "bm25_repeated_term": _documents_sql(REPEATED_QUERY),
    "bm25_stopwords": _documents_sql(STOPWORD_QUERY, places=12),
    "bm25_identifier": _documents_sql(IDENTIFIER_QUERY),
    "bm25_all_hits": f"""WITH {io.sql_bm25('documents', 'doc_id', 'text', q.phrases(OR_QUERY))}
SELECT doc_id, round(score, 6) AS score FROM scored""",
    "bm25_multi_snapshot": f"""WITH {io.sql_bm25('documents', 'doc_id', 'text', q.phrases(MIXED_QUERY), ['lang'])},
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score, doc_id) AS rank FROM scored)
SELECT lang, rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= 5""",
    "bm25_in_scope": f"""WITH {io.sql_bm25('documents', 'doc_id', 'text', q.phrases(OR_QUERY))}
SELECT doc_id, round(score, 6) AS score FROM scored WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'src3')
ORDER BY score, doc_id LIMIT 5""",
    "bm25_chunk_evidence": f"""WITH {io.sql_chunks()},
{io.sql_bm25('chunks', 'chunk_id', 'chunk_text', _PHRASES)},
best AS (SELECT * FROM scored ORDER BY score, chunk_id LIMIT 5)
SELECT chunk_id, document_id, source_name, anchor_label, array_to_string(heading_path, ' / ') AS heading_path,
  line_start::BIGINT AS source_line_start, line_end::BIGINT AS source_line_end, round(score, 6) AS score,
  substr(chunk_text, 1, 240) AS excerpt, length(chunk_text) > 240 AS truncated
FROM best JOIN chunks USING (chunk_id)""",
    "bm25_find_in_document": f"""WITH {io.sql_chunks()},
{io.sql_bm25('chunks', 'chunk_id', 'chunk_text', _PHRASES)},
ranked AS (
  SELECT document_id, chunk_id, score,
    row_number() OVER (PARTITION BY document_id ORDER BY score, chunk_id) AS rank
  FROM scored JOIN chunks USING (chunk_id))
SELECT document_id, chunk_id, round(score, 6) AS score FROM ranked WHERE rank = 1""",
    "bm25_query_table": BATCH_SQL,
    "bm25_tie_order": f"""WITH {io.sql_bm25('documents', 'doc_id', 'text', q.phrases(REPEATED_QUERY), ['source'])}
SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY score, doc_id) AS rank FROM scored QUALIFY rank <= 50""",
    "index_vocabulary": f"""WITH tok AS (SELECT doc_id, unnest({io.sql_words('text')}) AS term FROM documents)
SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM tok GROUP BY term""",
    "cjk_hint": """SELECT lang, count(*) AS documents,
  count(*) FILTER (regexp_matches(text, '[\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}\\x{ac00}-\\x{d7af}]{2,}')) AS contiguous_cjk
FROM documents GROUP BY lang""",
}

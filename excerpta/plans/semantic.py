"""Vector, rerank and evaluation queries over the driver's tables, with their oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from excerpta.functions import query as q, text as tx, vectors as vec
from excerpta.functions.identity import canonical_json
from excerpta.operators import bm25, chunking, evaluate, rerank, vectors
from excerpta.plans import inputs as io
from excerpta.plans.search import BATCH_SQL
from excerpta.session import settle, shared_folder, small_side

PROFILE = vec.checked_profile(
    {
        "provider": "example", "model_id": "passages", "model_revision": "3", "dimensions": 8, "input_role": "passage",
        "instruction": "Stand for this passage.", "preprocessing": {"implementation": "plain", "version": 1, "config": {}},
    }
)
OTHER = vec.checked_profile({**PROFILE, "instruction": "Stand for this question."})


def _embeddings(spark, sf):
    return io.table(spark, sf, "embeddings")


def _query_vector(spark, sf):
    return _embeddings(spark, sf).orderBy("vec_id").limit(1).select("embedding")


def cosine_topk(spark, sf):
    best = vectors.nearest(
        _embeddings(spark, sf), _query_vector(spark, sf), 10, key="vec_id", vector="embedding", query_vector="embedding"
    )
    return best.select("vec_id", F.round("score", 6).alias("score"))


def cosine_topk_by_label(spark, sf):
    best = vectors.nearest(
        _embeddings(spark, sf), _query_vector(spark, sf), 5, key="vec_id", vector="embedding",
        query_vector="embedding", groups=["label"],
    )
    return best.select("label", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


def vector_checks(spark, sf):
    wide = _embeddings(spark, sf).select("label", F.col("embedding").cast("array<double>").alias("v"))
    return wide.groupBy("label").agg(
        F.count("*").alias("vectors"),
        F.count_if(vec.is_valid_vector("v", 64)).alias("valid"),
        F.count_if(vec.is_valid_vector("v", 63)).alias("valid_as_63"),
        F.count_if(F.array_max(F.transform("v", F.abs)) == 0).alias("zero"),
    )


def vector_codec(spark, sf):
    """Big-endian payloads of every vector: size, digest and loss-free round trip. Vectors of even numbers are decoded from
    their payload without its last double."""
    coded = _embeddings(spark, sf).select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn(
        "payload", vec.encode_vector("v")
    )
    size = F.octet_length("payload")
    kept = F.when(F.col("vec_id") % 2 == 0, F.expr("substring(payload, 1, octet_length(payload) - 8)")).otherwise(F.col("payload"))
    return coded.select(
        "vec_id", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        (vec.decode_vector(kept) == F.col("v")).alias("round_trip"),
    )


def _inputs(spark, sf):
    return vectors.inputs(io.chunks(spark, sf, "lang", "doc_id"), PROFILE, "lang", "doc_id")


def _stored(spark, sf):
    """Vectors that already exist: those of the documents with a quality label of 1."""
    good = io.table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    made = io.files(spark, sf).join(good, "doc_id", "left_semi")
    return vectors.inputs(chunking.explode_chunks(chunking.markdown_documents(made)), PROFILE)


def vector_object_ids(spark, sf):
    return _inputs(spark, sf).select("chunk_id", "vector_object_id")


def vector_stats(spark, sf):
    return vectors.stats(_inputs(spark, sf), _stored(spark, sf), 8, "lang")


def vector_preview(spark, sf):
    return vectors.preview(_inputs(spark, sf), _stored(spark, sf), "lang")


def vector_coverage(spark, sf):
    """Per document: covered chunks, and whether only the other profile has vectors."""
    other = _inputs(spark, sf).filter("lang = 'de'").select(
        F.lit(vec.profile_id(OTHER)).alias("profile_id"), vec.vector_object_id(OTHER, "chunk_text").alias("vector_object_id")
    )
    stored = _stored(spark, sf).select(F.lit(vec.profile_id(PROFILE)).alias("profile_id"), "vector_object_id")
    return vectors.document_coverage(io.chunks(spark, sf), stored.unionByName(other), PROFILE, [OTHER])


def vector_readiness(spark, sf):
    """Conversations as snapshots: assistants built the chosen profile, long users another one."""
    turns = io.table(spark, sf, "conversations").withColumn("snapshot_id", F.concat_ws("-", "conv_id", "turn"))
    artifacts = turns.filter("role = 'assistant' or length(text) > 300").select(
        "snapshot_id", F.when(F.col("role") == "assistant", "mine").otherwise("other").alias("profile_id")
    )
    running = turns.filter("length(text) < 150").select(
        "snapshot_id", F.lit("mine").alias("profile_id"), F.when(F.col("turn") == 0, "preparing").otherwise("failed").alias("operation")
    )
    return vectors.snapshot_readiness(turns.select("snapshot_id"), artifacts, "mine", running)


def embed_plan(spark, sf):
    """The calls an embedder will get: distinct missing inputs in batches, numbered within parts of the id space."""
    missing = vectors.missing_inputs(_inputs(spark, sf), _stored(spark, sf))
    return vectors.embed_batches(missing, digits=1)


def mapping_audit(spark, sf):
    """The mapping of all chunks, with faults: toxic documents have lost their vectors, first chunks of clean ones are mapped
    twice, benchmark items are mapped without a chunk or an object, and objects of texts of even length have lost a byte."""
    labels = io.table(spark, sf, "labels")
    mapped = vectors.inputs(io.chunks(spark, sf, "doc_id"), PROFILE, "doc_id", "ordinal")
    mapped = settle(mapped.join(labels, "doc_id", "left"), "mapped")
    stray = io.table(spark, sf, "benchmark").select(F.concat(F.lit("item-"), "item_id").alias("chunk_id"), F.lit("vec_none").alias("vector_object_id"))
    clean = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0) & (F.col("ordinal") == 1), F.lit(False))
    times = F.when(F.col("toxic") == 1, 0).when(clean, 2).otherwise(1)
    mapping = mapped.select("chunk_id", "vector_object_id", F.explode(F.array_repeat(F.lit(0), times))).drop("col").unionByName(stray)
    payload = F.encode("chunk_text", "UTF-8")
    stored = vectors.missing_inputs(mapped, None).select(
        "vector_object_id", F.sha2(payload, 256).alias("payload_sha256"), F.octet_length(payload).cast("long").alias("payload_byte_size"),
        F.when(F.octet_length(payload) % 2 == 0, F.substring(payload, 2, 10_000)).otherwise(payload).alias("payload"),
    )
    return vectors.mapping_faults(mapped.select("chunk_id"), mapping, stored)


def vector_state(spark, sf):
    """Artifacts in the catalog against those in the folders. Each source of documents is written as an artifact; the catalog
    does not know those with an even greatest id, remembers another size of those with an odd number of characters, and
    has one for each benchmark item that was never written."""
    docs = io.table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    path = f"{shared_folder(spark)}/vector-state-{uuid.uuid4().hex}/objects"
    docs.withColumn("artifact", F.col("source")).write.partitionBy("artifact").parquet(path)
    stored = settle(vectors.stored_artifacts(vectors.artifact_files(spark, [path])), "stored-artifacts")
    of_source = docs.groupBy(F.col("source").alias("artifact_id")).agg(F.max("doc_id").alias("last"), F.sum("n_chars").alias("chars"))
    known = stored.join(of_source.filter("last % 2 = 1"), "artifact_id")
    known = known.select("artifact_id", "part", "files", (F.col("bytes") + F.col("chars") % 2).alias("bytes"))
    lost = io.table(spark, sf, "benchmark").select(
        F.concat(F.lit("item-"), "item_id").alias("artifact_id"), F.lit("objects").alias("part"), F.lit(1).cast("long").alias("files"), F.lit(1).cast("long").alias("bytes")
    )
    return vectors.artifact_states(known.unionByName(lost), stored)


def _recalled(spark, sf):
    """Best ten documents per language by cosine with the first vector."""
    texts = io.table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "text")
    labelled = _embeddings(spark, sf).join(texts.select("vec_id", "lang"), "vec_id")
    best = vectors.nearest(
        labelled, _query_vector(spark, sf), rerank.MAX_CANDIDATES, key="vec_id", vector="embedding",
        query_vector="embedding", groups=["lang"],
    )
    # A few rows a language: texts are fetched by their ids, not shuffled to meet them, and kept for all that follows.
    best = settle(best, "recalled-ids")
    rows = texts.drop("lang").join(small_side(best), "vec_id").select(
        "lang", "rank", F.col("vec_id").alias("chunk_id"), F.round("score", 9).alias("score"), F.col("text").alias("chunk_text")
    )
    return settle(rows, "recalled")


def rerank_budget(spark, sf):
    kept = rerank.candidates(_recalled(spark, sf), "lang")
    return kept.select(
        "lang", F.col("rank").cast("long").alias("rank"), F.col("chunk_id").alias("doc_id"), "candidate_chars",
        F.sha2("candidate_text", 256).alias("text_sha256"),
    )


def enhanced_search(spark, sf):
    """Recall, budget and rerank with a scripted reranker that prefers many distinct words."""
    kept = rerank.candidates(_recalled(spark, sf), "lang")
    words = F.size(F.array_distinct(tx.index_tokens("candidate_text")))
    answers = kept.select("lang", "chunk_id", (words / 600.0).alias("rerank_score")).filter("rerank_score > 0.05")
    final = rerank.apply_rerank(kept, answers, 5, "lang")
    return final.select(
        "lang", F.col("position").cast("long").alias("position"), F.col("chunk_id").alias("doc_id"),
        F.round("score", 6).alias("score"), F.round("vector_score", 6).alias("vector_score"),
    )


def rerank_by_index(spark, sf):
    """Answers by place: every second candidate, one place beyond the last, and the first place twice for German."""
    kept = rerank.candidates(_recalled(spark, sf), "lang").select("lang", "rank", "chunk_id")
    places = kept.groupBy("lang").agg(F.count("*").alias("n")).select(
        "lang", "n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("index")
    )
    once = places.filter("index % 2 = 0 or index = n").select("lang", F.col("index").cast("int").alias("index"))
    answers = once.unionByName(once.filter("lang = 'de' and index = 0")).withColumn("rerank_score", 1.0 / (F.col("index") + 1))
    found = rerank.by_index(answers, kept, "lang")
    return found.select(
        "lang", F.col("index").cast("long").alias("index"), F.coalesce("chunk_id", F.lit(-1)).alias("doc_id"),
        F.round("rerank_score", 6).alias("rerank_score"), F.coalesce("fault", F.lit("none")).alias("fault"),
    )


def rerank_answer_audit(spark, sf):
    """A malformed answer: candidates of all languages, English ones twice, German without a score."""
    kept = rerank.candidates(_recalled(spark, sf), "lang").select("lang", "chunk_id")
    answers = kept.withColumn("rerank_score", F.when(F.col("lang") != "de", F.lit(0.5))).unionByName(
        kept.filter("lang = 'en'").withColumn("rerank_score", F.lit(0.1))
    )
    return rerank.rerank_faults(answers, kept.filter("lang <> 'fr'"), "lang")


def _markers(spark, sf):
    """The smallest document whose text holds each benchmark item, found through its rarest word."""
    items = io.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("marker"))
    docs = io.texts(spark, sf)
    return evaluate.find_markers(items, docs, item="item_id", marker="marker", key="doc_id", text="text")


def marker_targets(spark, sf):
    return _markers(spark, sf)


def scoped_targets(spark, sf):
    """Marker chunks inside known documents: the last line of every file, sought in its own chunks. A line longer than
    a chunk stands in pieces; its first piece is sought. A file without a line has no marker and no target."""
    files = io.prepared(spark, sf)
    lines = F.filter(F.transform(tx.split_lines("content_text"), tx.collapse_line), lambda line: line != "")
    last = F.try_element_at(lines, F.lit(-1))
    marker = tx.strip(F.substring(last, 1, tx.MAX_CHUNK_CHARS)).alias("marker")
    # Every file is read and cut once, for its case and for its chunks.
    made = settle(files.select("doc_id", "document_id", "asset_id", "chunks", marker), "scoped")
    cases = made.select(F.col("doc_id").alias("case_id"), "document_id", "marker")
    return evaluate.scoped_targets(cases, chunking.explode_chunks(made))


def _judged(spark, sf):
    items = io.table(spark, sf, "benchmark").select("item_id", "text")
    words = q.query_words(items, "item_id", "text")
    docs = io.texts(spark, sf)
    # One frame of postings, of the words that queries and markers have, serves the scores and the markers' candidates.
    terms = words.select("term").union(items.select(F.explode(tx.index_tokens("text"))).toDF("term")).distinct()
    posts = settle(bm25.postings(docs, key="doc_id", text="text").join(small_side(settle(terms, "terms")), "term", "left_semi"), "postings")
    # Dealt by document over as many tasks as they fill; counting them reads no column.
    posts = bm25.deal(posts, bm25.tasks_for(posts, posts.count()), key="doc_id")
    stats = bm25.corpus_stats(bm25.lengths(docs, key="doc_id", text="text"))
    scored = bm25.score_postings(posts, stats, words, key="doc_id", query_id="item_id").withColumn("score", F.round("score", 9))
    top = settle(bm25.top_k(scored, 5, key="doc_id", groups=["item_id"]), "top")
    markers = items.select("item_id", F.col("text").alias("marker"))
    targets = evaluate.find_markers(markers, docs, item="item_id", marker="marker", key="doc_id", text="text", postings=posts)
    targets = settle(targets, "targets")
    cases = items.select("item_id", F.explode(F.array(F.lit("bm25"), F.lit("enhanced"))).alias("mode")).join(
        targets, "item_id", "left"
    )
    name = F.concat_ws("-", "item_id", "mode")
    plan = cases.select(
        name.alias("case_id"), "mode", F.lit("library").alias("library_id"), F.lit("snapshot").alias("snapshot_id"),
        F.col("doc_id").alias("expected_document_id"), F.col("doc_id").alias("target_chunk_id"),
        (F.col("item_id") % 5 == 0).alias("known_limitation"), F.col("doc_id").isNotNull().alias("traced"),
    )
    found = top.select("item_id", "rank", "doc_id")
    plain = found.withColumn("mode", F.lit("bm25"))
    # The scripted reranker answers with the target alone, when recall found it.
    scripted = found.join(targets, ["item_id", "doc_id"], "left_semi").withColumn("mode", F.lit("enhanced")).withColumn(
        "rank", F.lit(1)
    )
    results = plain.unionByName(scripted).select(
        name.alias("case_id"), "rank", F.col("doc_id").alias("document_id"), F.col("doc_id").alias("chunk_id")
    )
    owners = io.table(spark, sf, "documents").filter("lang <> 'es'").select(
        F.lit("library").alias("library_id"), F.lit("snapshot").alias("snapshot_id"), F.col("doc_id").alias("document_id")
    )
    return evaluate.judge(plan, results, owners)


def eval_cases(spark, sf):
    return _judged(spark, sf).withColumn("first_expected_rank", F.coalesce("first_expected_rank", F.lit(0)).cast("long"))


def eval_metrics(spark, sf):
    return evaluate.metrics(_judged(spark, sf))


QUERIES = {
    "cosine_topk": cosine_topk,
    "cosine_topk_by_label": cosine_topk_by_label,
    "vector_checks": vector_checks,
    "vector_codec": vector_codec,
    "vector_object_ids": vector_object_ids,
    "vector_stats": vector_stats,
    "vector_preview": vector_preview,
    "vector_coverage": vector_coverage,
    "vector_readiness": vector_readiness,
    "vector_mapping_audit": mapping_audit,
    "vector_state": vector_state,
    "embed_plan": embed_plan,
    "rerank_budget": rerank_budget,
    "enhanced_search": enhanced_search,
    "rerank_by_index": rerank_by_index,
    "rerank_answer_audit": rerank_answer_audit,
    "eval_marker_targets": marker_targets,
    "eval_scoped_targets": scoped_targets,
    "eval_cases": eval_cases,
    "eval_metrics": eval_metrics,
}

COSINE = """base AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings ORDER BY vec_id LIMIT 1),
cosines AS (
  SELECT e.vec_id, e.label, list_cosine_similarity(e.embedding::DOUBLE[], qv) AS score FROM embeddings e, base)"""


def _vec_id(profile, text):
    return f"""'vec_' || sha256('{{"profile":{canonical_json(profile)},"text":' || to_json({text}) || '}}')"""


INPUTS = f"""WITH {io.sql_chunks()},
inputs AS (SELECT lang, doc_id, document_id, chunk_id, chunk_text, {_vec_id(PROFILE, 'chunk_text')} AS vector_object_id FROM chunks),
stored AS (SELECT vector_object_id, chunk_id FROM inputs WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
uniq AS (
  SELECT lang, vector_object_id, count(*) AS refs, max(length(chunk_text)) AS chars,
    vector_object_id IN (SELECT vector_object_id FROM stored) AS known
  FROM inputs GROUP BY lang, vector_object_id)"""
RECALL = f"""WITH {COSINE},
ranked AS (
  SELECT d.lang, c.vec_id, round(score, 9) AS score, d.text,
    row_number() OVER (PARTITION BY d.lang ORDER BY score DESC, c.vec_id) AS rank
  FROM cosines c JOIN documents d ON d.doc_id = c.vec_id),
sized AS (SELECT *, least(length(text), 600) AS size FROM ranked WHERE rank <= 10),
spent AS (SELECT *, 4000 - coalesce(sum(size) OVER (PARTITION BY lang ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM sized),
kept AS (SELECT *, greatest(0, least(size, room))::BIGINT AS candidate_chars, substr(text, 1, greatest(0, least(size, room))::BIGINT) AS candidate_text
  FROM spent WHERE least(size, room) > 0)"""
TARGETS = """targets AS (
  SELECT item_id, min(doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id)"""

_RANKED = BATCH_SQL[: BATCH_SQL.rindex("SELECT item_id, CASE")]
JUDGED = f"""{_RANKED.rstrip()},
{TARGETS},
results AS (
  SELECT item_id, 'bm25' AS mode, rank, doc_id FROM ranked WHERE rank <= 5
  UNION ALL SELECT item_id, 'enhanced', 1, doc_id FROM ranked JOIN targets USING (item_id, doc_id) WHERE rank <= 5),
cases AS (
  SELECT b.item_id, m.mode, t.doc_id AS target, b.item_id % 5 = 0 AS limited
  FROM benchmark b LEFT JOIN targets t USING (item_id) CROSS JOIN (VALUES ('bm25'), ('enhanced')) m(mode)),
seen AS (
  SELECT r.item_id, r.mode, count(*) AS returned, min(CASE WHEN r.doc_id = c.target THEN rank END) AS first_rank,
    count(*) FILTER (r.doc_id IN (SELECT doc_id FROM documents WHERE lang = 'es')) AS outside,
    bool_or(r.doc_id = c.target) AS target_seen
  FROM results r JOIN cases c USING (item_id, mode) GROUP BY ALL),
full_cases AS (
  SELECT c.*, coalesce(returned, 0) AS returned, first_rank, coalesce(outside, 0) AS outside, coalesce(target_seen, false) AS target_seen
  FROM cases c LEFT JOIN seen USING (item_id, mode)),
judged AS (
  SELECT item_id || '-' || mode AS case_id, mode, target IS NULL AS expects_empty, returned, first_rank AS first_expected_rank,
    outside AS library_isolation_violations, outside AS snapshot_isolation_violations,
    CASE WHEN target IS NULL THEN 'true_empty' WHEN mode = 'bm25' AND limited THEN 'observational_known_limitation'
      ELSE 'expected_document_hit' END AS acceptance,
    CASE WHEN target IS NOT NULL THEN target_seen END AS traceability_pass,
    first_rank IS NOT NULL AND outside = 0 AS metric_hit,
    CASE WHEN target IS NULL THEN returned = 0 WHEN mode = 'bm25' AND limited THEN true ELSE first_rank IS NOT NULL END
      AND outside = 0 AND (target IS NULL OR target_seen) AS case_pass
  FROM full_cases)"""


def _ratio(numerator, denominator):
    return f"CASE WHEN {denominator} = 0 THEN 1.0::DOUBLE ELSE round(({numerator})::DOUBLE / ({denominator}), 6) END"


_POS = "count(*) FILTER (NOT expects_empty)"
_HIT = "count(*) FILTER (NOT expects_empty AND metric_hit)"
_APP = "NOT expects_empty AND acceptance <> 'observational_known_limitation'"

ORACLES = {
    "cosine_topk": f"WITH {COSINE} SELECT vec_id, round(score, 6) AS score FROM cosines ORDER BY score DESC, vec_id LIMIT 10",
    "cosine_topk_by_label": f"""WITH {COSINE},
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM cosines)
SELECT label, rank, vec_id, round(score, 6) AS score FROM ranked WHERE rank <= 5""",
    "vector_checks": """SELECT label, count(*) AS vectors,
  count(*) FILTER (len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64) AS valid,
  0::BIGINT AS valid_as_63, count(*) FILTER (list_max(list_transform(embedding, lambda x: abs(x))) = 0) AS zero
FROM embeddings GROUP BY label""",
    "vector_codec": """SELECT vec_id, (len(embedding) * 8)::BIGINT AS payload_bytes, vec_id % 2 = 1 AS round_trip,
  sha256(unhex(array_to_string(list_transform(embedding, lambda x: hex(x::DOUBLE::BIT::BLOB)), ''))) AS payload_sha256 FROM embeddings""",
    "vector_object_ids": f"{INPUTS} SELECT chunk_id, vector_object_id FROM inputs",
    "vector_stats": f"""{INPUTS}
SELECT lang, sum(refs)::BIGINT AS vector_references, count(*) AS unique_inputs, count(*) FILTER (NOT known) AS new_objects,
  count(*) FILTER (known) AS reused_objects, (sum(refs) * 64)::BIGINT AS referenced_vector_bytes,
  count(*) * 64 AS unique_vector_bytes, count(*) FILTER (NOT known) * 64 AS new_object_bytes,
  count(*) FILTER (known) * 64 AS reused_object_bytes, ((sum(refs) - count(*)) * 64)::BIGINT AS deduplicated_vector_bytes
FROM uniq GROUP BY lang""",
    "vector_preview": f"""{INPUTS}
SELECT lang, count(*) FILTER (NOT known) AS new_inputs, count(*) FILTER (known) AS reused_inputs,
  coalesce(sum(chars) FILTER (NOT known), 0)::BIGINT AS new_input_chars,
  ceil(count(*) FILTER (NOT known) / 10.0)::BIGINT AS planned_calls FROM uniq GROUP BY lang""",
    "embed_plan": f"""{INPUTS},
wanted AS (SELECT vector_object_id AS id, max(length(chunk_text)) AS chars, substr(vector_object_id, 5, 1) AS part FROM inputs
  WHERE vector_object_id NOT IN (SELECT vector_object_id FROM stored) GROUP BY 1),
batched AS (SELECT *, (row_number() OVER (PARTITION BY part ORDER BY id) - 1) // 10 AS batch FROM wanted)
SELECT part, batch, count(*) AS inputs, sum(chars)::BIGINT AS input_chars, min(id) AS first_id FROM batched GROUP BY part, batch""",
    "vector_coverage": f"""{INPUTS},
other AS (SELECT DISTINCT chunk_text FROM inputs WHERE lang = 'de'),
per AS (
  SELECT document_id, count(*) FILTER (vector_object_id IN (SELECT vector_object_id FROM stored)) AS vector_covered_chunks,
    count(*) AS vector_total_chunks, bool_or(chunk_text IN (SELECT chunk_text FROM other)) AS elsewhere
  FROM inputs GROUP BY document_id)
SELECT document_id, CASE WHEN vector_covered_chunks = vector_total_chunks THEN 'ready' WHEN elsewhere THEN 'mismatch' ELSE 'missing' END AS vector_status,
  vector_covered_chunks, vector_total_chunks FROM per""",
    "vector_readiness": """SELECT conv_id || '-' || turn AS snapshot_id,
  CASE WHEN length(text) < 150 AND (turn = 0 OR role <> 'assistant') THEN CASE WHEN turn = 0 THEN 'preparing' ELSE 'failed' END
    WHEN role = 'assistant' THEN 'ready' WHEN length(text) > 300 THEN 'mismatch' ELSE 'missing' END AS vector_status
FROM conversations""",
    "vector_mapping_audit": f"""{INPUTS},
marked AS (SELECT i.*, c.ordinal, quality, toxic FROM inputs i JOIN chunks c USING (chunk_id) LEFT JOIN labels l ON l.doc_id = i.doc_id)
SELECT 'chunk_without_vector' AS "check", (SELECT count(*) FROM marked WHERE toxic = 1) AS violations
UNION ALL SELECT 'vector_without_chunk', (SELECT count(*) FROM benchmark)
UNION ALL SELECT 'chunk_mapped_twice', (SELECT count(*) FROM marked WHERE quality = 1 AND toxic = 0 AND ordinal = 1)
UNION ALL SELECT 'mapping_without_object', (SELECT count(*) FROM benchmark)
UNION ALL SELECT 'object_payload_changed', (SELECT count(DISTINCT vector_object_id) FROM inputs WHERE strlen(chunk_text) % 2 = 0)""",
    "vector_state": """SELECT source AS artifact_id, 'objects' AS part,
  CASE WHEN max(doc_id) % 2 = 0 THEN 'unlisted' WHEN sum(n_chars) % 2 = 1 THEN 'altered' ELSE 'present' END AS state
FROM documents GROUP BY source
UNION ALL SELECT 'item-' || item_id, 'objects', 'missing' FROM benchmark""",
    "rerank_budget": f"""{RECALL}
SELECT lang, rank, vec_id AS doc_id, candidate_chars, sha256(candidate_text) AS text_sha256 FROM kept""",
    "enhanced_search": f"""{RECALL},
answered AS (SELECT *, len(list_distinct({io.sql_words('candidate_text')})) / 600.0 AS rs FROM kept),
final AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY rs DESC, vec_id) AS position FROM answered WHERE rs > 0.05)
SELECT lang, position, vec_id AS doc_id, round(rs, 6)::DOUBLE AS score, round(score, 6) AS vector_score FROM final WHERE position <= 5""",
    "rerank_by_index": f"""{RECALL},
sent AS (SELECT lang, vec_id, row_number() OVER (PARTITION BY lang ORDER BY rank) - 1 AS "index" FROM kept),
sizes AS (SELECT lang, count(*) AS n FROM kept GROUP BY lang),
asked AS (SELECT lang, u.i AS "index" FROM sizes, unnest(range(0, n + 1)) AS u(i) WHERE u.i % 2 = 0 OR u.i = n),
twice AS (SELECT * FROM asked UNION ALL SELECT * FROM asked WHERE lang = 'de' AND "index" = 0)
SELECT t.lang, t."index", coalesce(s.vec_id, -1) AS doc_id, round(1.0::DOUBLE / (t."index" + 1), 6) AS rerank_score,
  CASE WHEN s.vec_id IS NULL THEN 'no_candidate' WHEN t.lang = 'de' AND t."index" = 0 THEN 'repeated' ELSE 'none' END AS fault
FROM twice t LEFT JOIN sent s ON s.lang = t.lang AND s."index" = t."index" """,
    "rerank_answer_audit": f"""{RECALL}
SELECT 'foreign_chunk' AS "check", count(*) FILTER (lang = 'fr') AS violations FROM kept
UNION ALL SELECT 'repeated_chunk', count(*) FILTER (lang = 'en') FROM kept
UNION ALL SELECT 'score_not_finite', count(*) FILTER (lang = 'de') FROM kept""",
    "eval_marker_targets": f"WITH {TARGETS} SELECT item_id, doc_id FROM targets",
    "eval_scoped_targets": f"""WITH {io.sql_chunks()},
marked AS (SELECT doc_id, trim(substr(max_by(trim(regexp_replace(raw, '[\\t ]+', ' ', 'g'), {io.SPACES}), line), 1, 1200), {io.SPACES}) AS marker
  FROM raw_lines WHERE trim(raw, {io.SPACES}) <> '' GROUP BY doc_id)
SELECT doc_id AS case_id, min(chunk_id) AS target_chunk_id FROM marked JOIN chunks USING (doc_id)
WHERE contains(chunk_text, marker) GROUP BY doc_id""",
    "eval_cases": f"{JUDGED} SELECT * REPLACE (coalesce(first_expected_rank, 0) AS first_expected_rank) FROM judged",
    "eval_metrics": f"""{JUDGED}
SELECT mode, count(*) AS case_count, {_POS} AS positive_case_count,
  {_ratio(_HIT, _POS)} AS positive_hit_at_k, {_ratio(_HIT, _POS)} AS positive_recall_at_k,
  {_ratio("coalesce(sum(1.0::DOUBLE / first_expected_rank) FILTER (NOT expects_empty AND metric_hit), 0)", _POS)} AS mrr,
  round(avg(first_expected_rank) FILTER (NOT expects_empty AND metric_hit), 6) AS first_hit_rank_mean,
  {_ratio(f"count(*) FILTER ({_APP} AND metric_hit)", f"count(*) FILTER ({_APP})")} AS applicable_positive_hit_at_k,
  {_ratio("count(*) FILTER (expects_empty AND returned = 0)", "count(*) FILTER (expects_empty)")} AS true_empty_accuracy,
  sum(library_isolation_violations)::BIGINT AS library_isolation_violations,
  sum(snapshot_isolation_violations)::BIGINT AS snapshot_isolation_violations,
  {_ratio("count(*) FILTER (traceability_pass)", "count(traceability_pass)")} AS traceability_coverage,
  count(*) FILTER (case_pass) AS contract_passed_case_count
FROM judged GROUP BY mode""",
}

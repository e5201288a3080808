"""Registered queries of the operators, with production parameters, and their oracle SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from excerpta.llm import alignment, bpe, exact_dedup, language, licenses, near_dedup, packing, pii, prefix_trie, sharding, token_counts, tool_calls, topk
from excerpta.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""


def op2_exact_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.nearest(rows, F.col("vec_id") % 20 == 0, k=20)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


def op3_license_scan(spark, sf_dir):
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("matches")


ASK = {
    "type": "object",
    "required": ["text", "words"],
    "additionalProperties": False,
    "properties": {
        "text": {"type": "string", "minLength": 1},
        "words": {"type": "integer", "minimum": 1, "maximum": 40},
    },
}


def op4_tool_calls(spark, sf_dir):
    """Each user turn as a call, each assistant turn as the result of the turn before. A call needs the one two turns before,
    or, where the number of its words is divisible by five, the one two turns after: some conversations are out of order,
    and some have cycles."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    name = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    words = F.size(F.regexp_extract_all("text", F.lit("[^ \n]+"), F.lit(0)))
    calls = turns.where("role = 'user'").select(
        "conv_id", name(F.col("turn")).alias("call_id"), "turn", F.lit("ask").alias("name"),
        F.to_json(F.struct("text", words.alias("words"))).alias("arguments"),
        F.array(name(F.col("turn") + F.when(words % 5 == 0, 2).otherwise(-2))).alias("needs"),
    )
    results = turns.where("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    linked = tool_calls.link_tool_calls(calls, results, {"ask": ASK})
    return linked.fillna(-1, ["call_turn", "result_turn", "position"])  # integers without nulls compare everywhere


# Each call has one need, so a call's level is the length of its chain of needs; a chain as long as the conversation is cyclic.
OP4_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, text, len(regexp_extract_all(text, '[^ \n]+')) AS words FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
e AS (SELECT c.conv_id, c.turn, n.turn AS need FROM c JOIN c n ON n.conv_id = c.conv_id AND n.turn = c.turn + CASE WHEN c.words % 5 = 0 THEN 2 ELSE -2 END),
s AS (SELECT conv_id, count(*) AS calls FROM c GROUP BY conv_id),
w AS (
  SELECT conv_id, turn, need AS at, 1 AS steps FROM e
  UNION ALL SELECT w.conv_id, w.turn, e.need, steps + 1 FROM w JOIN e ON e.conv_id = w.conv_id AND e.turn = w.at JOIN s ON s.conv_id = w.conv_id WHERE steps <= calls),
l AS (SELECT c.conv_id, c.turn, coalesce(max(steps), 0) AS level FROM c LEFT JOIN w ON w.conv_id = c.conv_id AND w.turn = c.turn GROUP BY 1, 2),
b AS (SELECT DISTINCT conv_id FROM e WHERE need > turn),
p AS (
  SELECT c.*, coalesce(b.conv_id IS NOT NULL AND level >= calls, false) AS cyclic, CASE WHEN b.conv_id IS NULL THEN 0 ELSE level END AS level
  FROM c JOIN l USING (conv_id, turn) JOIN s USING (conv_id) LEFT JOIN b USING (conv_id)),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, cyclic ORDER BY level, turn) - 1 AS place FROM p),
j AS (
  SELECT coalesce(q.conv_id, r.conv_id) AS conv_id, 'call-' || coalesce(q.turn, r.turn - 1) AS call_id, coalesce(q.turn, -1) AS call_turn,
    coalesce(r.turn, -1) AS result_turn, q.text AS asked, r.text AS answered, words, CASE WHEN q.turn IS NULL OR cyclic THEN -1 ELSE place END AS position,
    CASE WHEN q.turn IS NULL THEN 'orphan' WHEN cyclic THEN 'cyclic' WHEN r.turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status
  FROM q FULL JOIN r ON q.conv_id = r.conv_id AND q.turn = r.turn - 1)
SELECT conv_id, call_id, call_turn, result_turn, status, position,
  CASE WHEN status <> 'orphan' THEN asked <> '' AND words BETWEEN 1 AND 40 END AS valid,
  concat_ws('; ', CASE WHEN asked = '' THEN 'text has a wrong length' END, CASE WHEN words NOT BETWEEN 1 AND 40 THEN 'words is out of range' END) AS faults,
  CASE WHEN status = 'orphan' THEN '{"id":' || to_json(call_id) || ',"result":' || to_json(answered) || ',"status":"orphan"}'
    ELSE '{"arguments":{"text":' || to_json(asked) || ',"words":' || words || '},"id":' || to_json(call_id) || ',"name":"ask","result":'
      || coalesce(CAST(to_json(answered) AS VARCHAR), 'null') || ',"status":"' || status || '"}' END AS message
FROM j
"""


def op5_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), WORD_BPE)


def op6_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.personal_spans(docs)
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    number = {name: F.size(F.array_remove(kinds, k)) for k, name in enumerate(pii.NAMES[: pii.BASE])}
    return found.select(
        "doc_id",
        *[(F.size(kinds) - others).cast("long").alias(f"n_{name}") for name, others in number.items()],
        F.sha2(pii.spelled(base), 256).alias("base_sha256"),
        pii.spelled(F.col("spans")).alias("spans"),
    )


def op7_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), width=2, percent=80)


# All pairs that share a shingle: for the small tables of a comparison.
OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
h AS (
  SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
s AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM h),
links AS (
  SELECT a.doc_id AS i, b.doc_id AS j FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
ways AS (SELECT i, j FROM links UNION ALL SELECT j, i FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM h UNION SELECT r.doc_id, v.j FROM reach r JOIN ways v ON r.other = v.i)
SELECT doc_id, len(sh) AS n_shingles, component_id, doc_id = component_id AS kept
FROM h JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""


def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = language.held_out(F.col("doc_id"))
    model = language.train(docs.where(~learned))
    found = language.predict(docs.select("doc_id", learned.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op9_bpe_coding(spark, sf_dir):
    return bpe.encode_digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op10_best_fit_packing(spark, sf_dir):
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), BYTE_BPE)


def op11_histogram_sort(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.histogram_sort(docs, shards=16).select(
        "row.doc_id",
        "size",
        F.crc32(F.coalesce("row.text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op12_prefix_trie(spark, sf_dir):
    """Every conversation c begins with the first crc32(c) % 9 turns of conversation c - c % 5."""
    turns = prefix_trie.placed_turns(table(spark, sf_dir, "conversations"))
    ids = turns.select("conv_id").distinct()
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    openings = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("source_id"), h.alias("h"))
    nodes = prefix_trie.prefix_trie(*prefix_trie.with_shared_openings(turns, openings))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


# Nodes are grouped by their whole list of turns. The CRC-32 is spelled out bit by bit (its fixed polynomial).
OP12_SQL = r"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list({'r': r, 't': t} ORDER BY p) AS ts FROM o GROUP BY conv_id),
c AS (
  SELECT conv_id, ts, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda x: CAST(ascii(x) AS BIGINT))), lambda s, b: list_reduce(list_prepend(xor(s, b), CAST(range(8) AS BIGINT[])),
    lambda u, i: xor(u >> 1, 3988292384 * (u & 1))))) % 9 AS h FROM l),
b AS (
  SELECT c.conv_id, list_concat(list_slice(coalesce(l.ts, []), 1, h), list_slice(c.ts, h + 1, len(c.ts))) AS ts
  FROM c LEFT JOIN l ON l.conv_id = c.conv_id - c.conv_id % 5),
m AS (SELECT conv_id, len(ts) AS n, d, list_slice(ts, 1, d) AS p FROM b, unnest(range(len(ts) + 1)) AS u(d)),
g AS (
  SELECT p, min(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256 FROM m GROUP BY p),
k AS (SELECT list_slice(p, 1, depth - 1) AS p, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY 1),
v AS (
  SELECT g.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(p[-1].t) ELSE 0 END AS saved FROM g LEFT JOIN k USING (p)),
s AS (
  SELECT list_slice(p, 1, d) AS p, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM v, unnest(range(depth + 1)) AS u(d) GROUP BY 1)
SELECT v.conv_id, v.depth, a.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM v JOIN s ON v.p = s.p LEFT JOIN v a ON v.depth > 0 AND a.p = list_slice(v.p, 1, v.depth - 1)
"""


def op13_tokenizer_alignment(spark, sf_dir):
    found = alignment.cross_tokenizer_alignment(table(spark, sf_dir, "documents"), BYTE_BPE, PIECES)
    return found.withColumnRenamed("groups", "groups_sha256")


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_exact_topk, op3_license_scan, op4_tool_calls, op5_token_counts, op6_pii, op7_minhash_near_dedup, op8_language_id, op9_bpe_coding, op10_best_fit_packing, op11_histogram_sort, op12_prefix_trie, op13_tokenizer_alignment)}
ORACLES = {"op1_exact_dedup": OP1_SQL, "op2_exact_topk": OP2_SQL, "op4_tool_calls": OP4_SQL, "op7_minhash_near_dedup": OP7_SQL, "op12_prefix_trie": OP12_SQL}

"""Snapshot membership, object reuse and audit queries, with their oracle SQL.

The base version holds every document. The next one removes documents labelled bad and toxic,
replaces the text of the other toxic ones, and adds the benchmark items as new files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from excerpta.functions import identity
from excerpta.operators import audit, chunking, layers, members, objects
from excerpta.plans import inputs as io
from excerpta.schemas import asset_rows, document_rows
from excerpta.session import settle

REVISION = "\n\nRevised edition."


def _identified(files):
    hashed = files.withColumn("source_sha256", F.sha2(F.encode("content_text", "UTF-8"), 256))
    return hashed.withColumn("document_id", identity.document_id("source_name", "source_sha256"))


MEMBER = ("document_id", "source_name", "source_sha256")


def _change_set(spark, sf):
    """Base, removals, replacements and additions, from one pass over the documents: their identities, and those of the texts
    that replace them, are computed once and kept without the texts."""
    base = _identified(io.files(spark, sf, headings=False)).join(io.table(spark, sf, "labels"), "doc_id", "left")
    revised = F.concat("content_text", F.lit(REVISION))
    digest = F.sha2(F.encode(revised, "UTF-8"), 256)
    size = lambda text: F.octet_length(text).cast("long")
    change = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "remove").when((F.col("toxic") == 1) & (F.col("quality") == 1), "replace")
    tagged = base.withColumn("change", F.coalesce(change, F.lit("keep"))).select(
        "doc_id", "lang", *MEMBER, size(F.col("content_text")).alias("byte_size"), "change",
        F.when(F.col("change") == "replace", F.struct(
            identity.document_id("source_name", digest).alias("document_id"), digest.alias("source_sha256"), size(revised).alias("byte_size")
        )).alias("new"),
    )
    base = settle(tagged, "change-set")
    removals = base.filter("change = 'remove'").select("document_id")
    replacements = base.filter("change = 'replace'").select("new.document_id", "source_name", "new.source_sha256", "new.byte_size", F.col("document_id").alias("replaced_document_id"))
    added = io.table(spark, sf, "benchmark").select(
        F.concat(F.lit("item-"), "item_id", F.lit(".md")).alias("source_name"), F.col("text").alias("content_text")
    )
    additions = _identified(added).select(*MEMBER, size(F.col("content_text")).alias("byte_size"))
    return base.drop("change", "new"), removals, replacements, additions


def _versions(spark, sf):
    base, removals, replacements, additions = _change_set(spark, sf)
    old = base.select(*MEMBER)
    new = members.apply_changes(
        old,
        removals=removals,
        replacements=replacements.select(*MEMBER, "replaced_document_id"),
        additions=additions.select(*MEMBER),
    )
    return old, new


def snapshot_build(spark, sf):
    return _versions(spark, sf)[1]


def snapshot_diff(spark, sf):
    old, new = _versions(spark, sf)
    return members.difference(new, old)


def snapshot_diff_counts(spark, sf):
    return members.difference_counts(snapshot_diff(spark, sf))


def change_faults(spark, sf):
    base, removals, replacements, additions = _change_set(spark, sf)
    # A faulty request: every replaced document is also removed, and the additions repeat the base.
    return members.change_faults(
        base.select("document_id"),
        removals.union(replacements.select("replaced_document_id")),
        replacements.select("document_id", "replaced_document_id"),
        additions.select("document_id").union(base.filter("lang = 'es'").select("document_id")),
    )


def corpus_versions(spark, sf):
    old, new = _versions(spark, sf)
    both = old.withColumn("version", F.lit("base")).unionByName(new.withColumn("version", F.lit("next")))
    return identity.corpus_digest(both, "version")


def corpus_tree(spark, sf):
    """The leaves in which the hash trees of both versions differ, and both roots. The next tree is the base's with the
    leaves of touched documents hashed again."""
    base, removals, replacements, additions = _change_set(spark, sf)
    leaves = settle(identity.corpus_leaves(base), "leaves")
    touched = removals.union(replacements.select("replaced_document_id")).union(replacements.select("document_id")).union(additions.select("document_id"))
    new = members.apply_changes(
        base.select(*MEMBER), removals=removals, replacements=replacements.select(*MEMBER, "replaced_document_id"), additions=additions.select(*MEMBER)
    )
    again = settle(identity.updated_leaves(leaves, new, touched), "leaves")
    changed = identity.differing_leaves(leaves, again)
    roots = identity.corpus_root(leaves).select(F.lit("").alias("leaf"), F.col("corpus_sha256").alias("left_digest"), F.lit(None).cast("string").alias("right_digest"))
    roots = roots.unionByName(
        identity.corpus_root(again).select(F.lit("").alias("leaf"), F.lit(None).cast("string").alias("left_digest"), F.col("corpus_sha256").alias("right_digest"))
    )
    return changed.unionByName(roots)


def version_prints(spark, sf):
    """Prints of the member tables: the next version's composed of the base's and the change, and computed from its rows."""
    base, removals, replacements, additions = _change_set(spark, sf)
    prints = lambda rows: audit.document_prints({"member": rows.select(*MEMBER)})
    before = settle(prints(base), "prints")
    removed = removals.unionByName(replacements.select(F.col("replaced_document_id").alias("document_id")))
    gone = before.join(removed, "document_id", "left_semi")
    came = prints(replacements.select(*MEMBER).unionByName(additions.select(*MEMBER)))
    versions = {
        "base": ((1, before),),
        "next, composed": ((1, before), (-1, gone), (1, came)),
        "next, computed": ((1, prints(_versions(spark, sf)[1])),),
    }
    out = None
    for version, parts in versions.items():
        sums = [F.col(c).cast("string").alias(c) for c in ("sum_a", "sum_b")]
        rows = audit.composed_prints(*parts).select(F.lit(version).alias("version"), "rows", *sums)
        out = rows if out is None else out.unionByName(rows)
    return out


def _turn_catalog(spark, sf):
    """Conversation turns as versions: assistants build on the turn before, users on a later one."""
    turns = io.table(spark, sf, "conversations")
    base = F.when(F.col("role") == "assistant", F.col("turn") - 1).when(F.col("turn") > 0, F.col("turn") + 1)
    name = F.concat(F.lit("v"), F.col("conv_id"), F.lit("-"))
    return turns.select(
        "conv_id",
        F.col("turn").alias("position"),
        F.concat(name, "turn").alias("snapshot_id"),
        F.concat(name, base).alias("base_snapshot_id"),
    )


def lineage_violations(spark, sf):
    return members.lineage_faults(_turn_catalog(spark, sf), "conv_id")


def snapshot_listing(spark, sf):
    catalog = _turn_catalog(spark, sf)
    pointers = catalog.groupBy("conv_id").agg(
        F.min_by("snapshot_id", "position").alias("current_snapshot_id"),
        F.max_by("snapshot_id", "position").alias("last_successful_snapshot_id"),
    )
    rows = members.snapshot_listing(catalog, pointers, "conv_id")
    return rows.withColumn("listed", F.col("listed").cast("long"))


def snapshot_labels(spark, sf):
    """Event times as snapshot ids: shared minutes show seconds, shared seconds a unique suffix."""
    events = io.table(spark, sf, "events").select(
        F.concat(
            F.date_format("ts", "yyyyMMdd'T'HHmmssSSSSSS"),
            F.lit("Z-"),
            F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 12),
            F.lit("-"),
            F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 8),
        ).alias("snapshot_id")
    )
    return members.snapshot_labels(events)


def _source_refs(spark, sf):
    """References of both versions: source objects are the texts, so copies and survivors are shared."""
    base, removals, replacements, additions = _change_set(spark, sf)
    gone = removals.union(replacements.select("replaced_document_id"))
    refs = lambda rows: rows.select("document_id", F.lit("source").alias("kind"), F.col("source_sha256").alias("sha256"), "byte_size")
    new = base.join(gone, "document_id", "left_anti")
    return refs(base), refs(new).unionByName(refs(replacements)).unionByName(refs(additions))


def object_dedup_stats(spark, sf):
    """Storage statistics of the next version against the objects the base already holds."""
    old, new = _source_refs(spark, sf)
    first = objects.storage_stats(objects.mark_created(old)).withColumn("version", F.lit("base"))
    second = objects.storage_stats(objects.mark_created(new, old)).withColumn("version", F.lit("next"))
    return first.unionByName(second)


def object_layers(spark, sf):
    """All three object layers of every document and how far copies share them."""
    made = io.prepared(spark, sf)
    refs = objects.object_payloads(made, "lang").drop("payload", "path")
    return objects.storage_stats(objects.mark_created(refs), "lang", "kind").select(
        "lang", "kind", "object_references", "new_objects", "reused_objects"
    )


def object_missing(spark, sf):
    """Objects the next version refers to that the base store lacks."""
    new = _source_refs(spark, sf)[1]
    payload = F.encode("content_text", "UTF-8")
    stored = io.files(spark, sf, headings=False).select(
        F.lit("source").alias("kind"), F.sha2(payload, 256).alias("sha256"), F.octet_length(payload).cast("long").alias("byte_size"), payload.alias("payload")
    )
    return objects.missing_objects(new, stored)


def _tables(spark, sf):
    # Several rules read each table: parse and chunk once, keep the result in the checkpoint folder.
    made = settle(io.prepared(spark, sf).drop("content_text"))
    chunks = chunking.explode_chunks(made, "doc_id").withColumn("fulltext_verified", F.lit(False)).withColumn(
        "formula_verified", F.lit(False)
    )
    return document_rows(made), asset_rows(made), chunks


def audit_sound(spark, sf):
    """The audit over untouched tables: every count is zero."""
    documents, assets, chunks = _tables(spark, sf)
    return audit.audit(documents, assets, chunks.drop("doc_id"))


def _faulty_tables(spark, sf):
    """Tables with faults injected into every labelled document."""
    documents, assets, chunks = _tables(spark, sf)
    labels = io.table(spark, sf, "labels")
    joined = chunks.join(labels, "doc_id", "left")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    bad = (F.col("quality") == 0) & (F.col("toxic") == 0)
    toxic = F.col("toxic") == 1
    faulty = joined.select(
        "chunk_id", "document_id", "asset_id",
        F.when(toxic, F.col("ordinal") + 1).otherwise(F.col("ordinal")).alias("ordinal"),
        F.when(bad, F.lit(" ")).otherwise(F.col("chunk_text")).alias("chunk_text"),
        "heading_path",
        F.when(good & (F.col("ordinal") == 1), F.lit(1)).otherwise(F.col("pdf_page_start")).alias("pdf_page_start"),
        "pdf_page_end", "source_line_start", "source_line_end", "anchor_label", "fulltext_verified",
        F.when(toxic, True).otherwise(F.col("formula_verified")).alias("formula_verified"),
    )
    return documents, assets, faulty


def audit_violations(spark, sf):
    """The audit over tables with faults injected into every labelled document."""
    return audit.audit(*_faulty_tables(spark, sf))


def audit_all_versions(spark, sf):
    """The audit of several snapshots over the same faulty tables: one per language, one of the documents without a label
    (sound), and one of everything, in whose members those of bad and toxic documents are repeated under unknown ids."""
    documents, assets, faulty = _faulty_tables(spark, sf)
    named = documents.select("document_id", F.regexp_extract("source_name", r"^doc-(.*)\.md$", 1).cast("long").alias("doc_id"))
    known = named.join(io.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").join(io.table(spark, sf, "labels"), "doc_id", "left")
    lost = (F.col("quality") == 0) & (F.col("toxic") == 1)
    names = F.array_compact(F.array(
        F.struct(F.concat(F.lit("language "), F.coalesce("lang", F.lit("none"))).alias("snapshot_id"), "document_id"),
        F.when(F.col("quality").isNull(), F.struct(F.lit("unlabelled").alias("snapshot_id"), "document_id")),
        F.struct(F.lit("whole").alias("snapshot_id"), "document_id"),
        F.when(lost, F.struct(F.lit("whole").alias("snapshot_id"), F.concat(F.lit("lost-"), "doc_id").alias("document_id"))),
    ))
    members_ = settle(known.select(F.inline(names)), "version-members")
    sizes = faulty.groupBy("document_id").agg(F.count("*").alias("n"))
    catalog = members_.join(sizes, "document_id").groupBy("snapshot_id").agg(F.count("*").alias("documents"), F.sum("n").alias("chunks"))
    return audit.version_rules(settle(catalog, "version-catalog"), members_, documents, assets, faulty)


def audit_objects(spark, sf):
    """Stored chunks against those decoded from chunk objects; the rows of toxic documents have lost their last character."""
    made = io.prepared(spark, sf)
    refs = settle(objects.object_payloads(made, "asset_id").filter("kind = 'chunks'"), "chunk-objects")
    rows = chunking.explode_chunks(made, "doc_id").join(io.table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    shorter = F.expr("substring(chunk_text, 1, char_length(chunk_text) - 1)")
    stored = rows.withColumn("chunk_text", F.when(F.col("toxic") == 1, shorter).otherwise(F.col("chunk_text")))
    return audit.object_chunk_rules(stored, objects.decoded_chunks(refs, refs))


def audit_manifest(spark, sf):
    """Tables against the manifest's source list, which has another title for English and no row for Spanish documents."""
    made = settle(io.prepared(spark, sf).drop("content_text"), "prepared")
    documents, assets, chunks = document_rows(made), asset_rows(made), chunking.explode_chunks(made)
    listed = documents.select("document_id", "title", "source_name", "media_type").join(assets, "document_id").join(
        made.select("document_id", "lang", F.size("chunks").cast("long").alias("chunk_count")), "document_id"
    )
    listed = listed.filter("lang <> 'es'").withColumn("title", F.when(F.col("lang") == "en", "other").otherwise(F.col("title")))
    return audit.manifest_rules(documents, assets, chunks, listed)[0]


CHANGED = {
    "none": objects.STEPS,
    "chunker": {k: {**v, "chunker": v["chunker"] + ", revised"} for k, v in objects.STEPS.items()},
    "parser": {k: {**v, "parser": v["parser"] + ", revised"} for k, v in objects.STEPS.items()},
}


def pipeline_change(spark, sf):
    """Which layers of every document three pipelines reuse or make again, and the chunks that come of it.

    The store holds all layers of today's steps, and those of an earlier run of the revised chunker over toxic documents.
    """
    made = settle(io.prepared(spark, sf).drop("lang", "source", "import_status"), "prepared")
    before = made.join(io.table(spark, sf, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    payloads = [
        objects.object_payloads(rows, "media_type", steps=CHANGED[name]).withColumn("steps", F.lit(name))
        for name, rows in (("none", made), ("chunker", before))
    ]
    stored = settle(payloads[0].unionByName(payloads[1]), "layer-objects")
    known = [layers.memo(stored.filter(F.col("steps") == name), CHANGED[name]) for name in ("none", "chunker")]
    known = settle(known[0].unionByName(known[1]), "layer-memo")
    documents = made.select("doc_id", "document_id", "asset_id", "source_name", "source_sha256", "byte_size", "title", "media_type")
    out = None
    for name, steps in CHANGED.items():
        planned = settle(layers.states(layers.plan(documents, known, steps)), "layer-plan")
        kept = layers.kept_chunks(planned.filter("chunks_layer = 'reused'"), stored)
        cut = layers.cut_again(planned.filter("parsed = 'reused' and chunks_layer = 'rebuilt'"), stored)
        parsed = layers.parse_again(planned.filter("parsed = 'rebuilt'"), stored).drop("title")
        parsed = chunking.markdown_documents(parsed.withColumn("content_text", F.col("content").cast("string")))
        for rows in (kept, cut, parsed):
            rows = rows.select(F.lit(name).alias("change"), "doc_id", "parsed", "chunks_layer", F.size("chunks").cast("long").alias("n_chunks"))
            out = rows if out is None else out.unionByName(rows)
    return out


def object_codec(spark, sf):
    """Faults that strict decoding finds, by layer, in objects whose documents' numbers choose what was done to them.

    Every changed object is stored under the digest of its changed bytes, so that only its form is wrong.
    """
    made = io.prepared(spark, sf)
    rows = objects.object_payloads(made, "doc_id", "lang").filter("kind <> 'source'")
    text = F.col("payload").cast("string")
    changed = (
        F.when(F.col("doc_id") % 10 == 1, F.concat(F.lit('{"extra":null,'), F.substr(text, F.lit(2))))
        .when(F.col("doc_id") % 10 == 2, F.regexp_replace(text, r'^\{(.*),("version":1)\}$', r"{$2,$1}"))
        .when(F.col("doc_id") % 10 == 3, F.regexp_replace(text, r'"version":1\}$', '"version":1.0}'))
        .when(F.col("doc_id") % 10 == 4, F.concat(text, F.lit(" ")))
        .when(F.col("doc_id") % 10 == 5, F.regexp_replace(text, r'"version":1\}$', '"version":2}'))
        .when(F.col("doc_id") % 10 == 6, F.substr(text, F.lit(3)))
        .otherwise(text)
    )
    payload = F.when(F.col("doc_id") % 10 == 7, F.concat(F.col("payload"), F.lit(b"!"))).otherwise(F.encode(changed, "UTF-8"))
    digest = F.when(F.col("doc_id") % 10 == 7, F.col("sha256")).otherwise(F.sha2("_new", 256))
    stored = rows.withColumn("_new", payload).select("kind", digest.alias("sha256"), F.col("_new").alias("payload"))
    stored = settle(stored, "codec-objects")
    found = None
    for kind in ("parsed", "chunks"):
        one = objects.decoded(stored, kind).groupBy(F.coalesce("fault", F.lit("sound")).alias("fault"))
        one = one.agg(F.count("*").alias("objects")).select(F.lit(kind).alias("kind"), "fault", "objects")
        found = one if found is None else found.unionByName(one)
    return found


QUERIES = {
    "version_prints": version_prints,
    "corpus_tree": corpus_tree,
    "object_codec": object_codec,
    "pipeline_change": pipeline_change,
    "audit_objects": audit_objects,
    "audit_manifest": audit_manifest,
    "snapshot_build": snapshot_build,
    "snapshot_diff": snapshot_diff,
    "snapshot_diff_counts": snapshot_diff_counts,
    "change_faults": change_faults,
    "corpus_hash_versions": corpus_versions,
    "lineage_violations": lineage_violations,
    "snapshot_listing": snapshot_listing,
    "snapshot_labels": snapshot_labels,
    "object_dedup_stats": object_dedup_stats,
    "object_layers": object_layers,
    "object_missing": object_missing,
    "audit_sound": audit_sound,
    "audit_violations": audit_violations,
    "audit_all_versions": audit_all_versions,
}

_ID = "'doc_' || substr(sha256(source_name || chr(0) || sha256(content_text)), 1, 24)"
CHANGES = f"""base AS (
  SELECT *, {_ID} AS document_id, sha256(content_text) AS source_sha256 FROM (
    SELECT doc_id, lang, 'doc-' || doc_id || '.md' AS source_name, text AS content_text FROM documents)),
removals AS (SELECT document_id FROM base JOIN labels USING (doc_id) WHERE quality = 0 AND toxic = 1),
replacements AS (
  SELECT *, {_ID} AS document_id, sha256(content_text) AS source_sha256 FROM (
    SELECT source_name, content_text || chr(10) || chr(10) || 'Revised edition.' AS content_text, document_id AS replaced_document_id
    FROM base JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 1)),
additions AS (
  SELECT *, {_ID} AS document_id, sha256(content_text) AS source_sha256 FROM (
    SELECT 'item-' || item_id || '.md' AS source_name, text AS content_text FROM benchmark)),
next AS (
  SELECT document_id, source_name, source_sha256, content_text FROM base
  WHERE document_id NOT IN (SELECT document_id FROM removals)
    AND document_id NOT IN (SELECT replaced_document_id FROM replacements)
  UNION ALL SELECT document_id, source_name, source_sha256, content_text FROM replacements
  UNION ALL SELECT document_id, source_name, source_sha256, content_text FROM additions)"""

DIFF = f"""WITH {CHANGES},
gone AS (SELECT * FROM base WHERE document_id NOT IN (SELECT document_id FROM next)),
came AS (SELECT * FROM next WHERE document_id NOT IN (SELECT document_id FROM base)),
pairs AS (
  SELECT source_name, any_value(c.document_id) AS document_id, any_value(g.document_id) AS base_document_id
  FROM came c JOIN gone g USING (source_name) GROUP BY source_name HAVING count(*) = 1),
diff AS (
  SELECT 'inherited' AS change, source_name, document_id, document_id AS base_document_id
  FROM next WHERE document_id IN (SELECT document_id FROM base)
  UNION ALL SELECT 'replaced', source_name, document_id, base_document_id FROM pairs
  UNION ALL SELECT 'added', source_name, document_id, NULL FROM came WHERE source_name NOT IN (SELECT source_name FROM pairs)
  UNION ALL SELECT 'removed', source_name, NULL, document_id FROM gone WHERE source_name NOT IN (SELECT source_name FROM pairs))"""

TURNS = """turns AS (
  SELECT conv_id, turn AS position, 'v' || conv_id || '-' || turn AS snapshot_id,
    'v' || conv_id || '-' || CASE WHEN role = 'assistant' THEN turn - 1 WHEN turn > 0 THEN turn + 1 END AS base_snapshot_id
  FROM conversations)"""


def _storage(version, rows, known):
    return f"""SELECT '{version}' AS version, count(*) AS object_references, sum(fresh) ::BIGINT AS new_objects,
  sum(size)::BIGINT AS logical_object_bytes, sum(CASE WHEN fresh = 1 THEN size ELSE 0 END)::BIGINT AS new_object_bytes,
  count(*) - sum(fresh)::BIGINT AS reused_objects,
  (sum(size) - sum(CASE WHEN fresh = 1 THEN size ELSE 0 END))::BIGINT AS reused_object_bytes
FROM (SELECT strlen(content_text) AS size,
    CASE WHEN row_number() OVER (PARTITION BY source_sha256 ORDER BY document_id) = 1 AND source_sha256 NOT IN ({known})
      THEN 1 ELSE 0 END AS fresh FROM {rows})"""


CHUNKS = io.sql_chunks()
ORACLES = {
    "corpus_tree": f"""WITH {CHANGES},
all_rows AS (SELECT 'base' AS version, document_id, source_name, source_sha256 FROM base
  UNION ALL SELECT 'next', document_id, source_name, source_sha256 FROM next),
{io.sql_leaves("all_rows", "version")},
roots AS (SELECT version, sha256(string_agg(digest, '' ORDER BY node)) AS digest FROM nodes GROUP BY version)
SELECT coalesce(a.leaf, b.leaf) AS leaf, a.digest AS left_digest, b.digest AS right_digest
FROM (SELECT * FROM leaves WHERE version = 'base') a FULL JOIN (SELECT * FROM leaves WHERE version = 'next') b ON a.leaf = b.leaf
WHERE a.digest IS DISTINCT FROM b.digest
UNION ALL SELECT '', CASE WHEN version = 'base' THEN digest END, CASE WHEN version = 'next' THEN digest END FROM roots""",
    "version_prints": f"""WITH {CHANGES},
hashed AS (
  SELECT version, sha256('{{"document_id":"' || document_id || '","source_name":"' || source_name || '","source_sha256":"' || source_sha256 || '"}}') AS h
  FROM (SELECT 'base' AS version, document_id, source_name, source_sha256 FROM base
    UNION ALL SELECT v, document_id, source_name, source_sha256 FROM next, (VALUES ('next, composed'), ('next, computed')) t(v)))
SELECT version, count(*) AS rows, sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR AS sum_a, sum(('0x' || substr(h, 16, 15))::BIGINT)::VARCHAR AS sum_b
FROM hashed GROUP BY version""",
    "pipeline_change": f"""WITH {CHUNKS},
cut AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id),
known AS (SELECT DISTINCT source_sha256 FROM ids JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT change, doc_id, CASE WHEN change = 'parser' THEN 'rebuilt' ELSE 'reused' END AS parsed,
  CASE WHEN change = 'none' OR change = 'chunker' AND source_sha256 IN (SELECT source_sha256 FROM known) THEN 'reused' ELSE 'rebuilt' END AS chunks_layer,
  coalesce(n, 0) AS n_chunks
FROM ids LEFT JOIN cut USING (doc_id), (VALUES ('none'), ('chunker'), ('parser')) v(change)""",
    # Copies share an object, and so do copies that are changed in the same way; one that is changed under its old digest counts
    # once with those that are not, and the sound bytes win.
    "object_codec": """WITH d AS (SELECT doc_id % 10 AS m, text FROM documents),
f AS (SELECT DISTINCT text, CASE m WHEN 1 THEN 'not_canonical' WHEN 2 THEN 'not_canonical' WHEN 3 THEN 'not_canonical' WHEN 4 THEN 'not_canonical'
  WHEN 5 THEN 'another_format' WHEN 6 THEN 'not_an_object' WHEN 7 THEN 'digest_differs' ELSE 'sound' END AS fault, CASE WHEN m BETWEEN 1 AND 7 THEN m ELSE 0 END AS m FROM d)
SELECT kind, fault, count(*) AS objects FROM (
  SELECT text, fault, m FROM f WHERE m <> 7 OR text NOT IN (SELECT text FROM f WHERE m = 0)), (VALUES ('parsed'), ('chunks')) k(kind) GROUP BY ALL""",
    "audit_objects": f"""WITH {CHUNKS}
SELECT 'chunk_differs_from_object' AS "check", count(*) AS violations FROM chunks WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "audit_manifest": """SELECT 'manifest_source_differs' AS "check", count(*) AS violations FROM documents WHERE lang IN ('en', 'es')""",
    "snapshot_build": f"WITH {CHANGES} SELECT document_id, source_name, source_sha256 FROM next",
    "snapshot_diff": f"{DIFF} SELECT * FROM diff",
    "snapshot_diff_counts": f"""{DIFF}
SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'inherited') AS inherited,
  count(*) FILTER (change = 'replaced') AS replaced, count(*) FILTER (change = 'removed') AS removed FROM diff""",
    "change_faults": f"""WITH {CHANGES},
gone AS (SELECT document_id FROM removals UNION ALL SELECT replaced_document_id FROM replacements),
added AS (SELECT document_id FROM additions UNION ALL SELECT document_id FROM base WHERE lang = 'es'),
result AS (
  SELECT document_id FROM base WHERE document_id NOT IN (SELECT document_id FROM gone)
  UNION ALL SELECT document_id FROM replacements UNION ALL SELECT document_id FROM added)
SELECT 'removal_repeated' AS "check", (SELECT count(*) FROM (SELECT document_id FROM gone GROUP BY 1 HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'replacement_repeated', (SELECT count(*) FROM (SELECT replaced_document_id FROM replacements GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'removed_and_replaced', (SELECT count(*) FROM gone WHERE document_id IN (SELECT replaced_document_id FROM replacements))
UNION ALL SELECT 'target_not_in_base', (SELECT count(*) FROM (SELECT document_id FROM gone UNION ALL SELECT replaced_document_id FROM replacements) WHERE document_id NOT IN (SELECT document_id FROM base))
UNION ALL SELECT 'addition_repeated', (SELECT count(*) FROM (SELECT document_id FROM added GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'result_collision', (SELECT count(*) FROM (SELECT document_id FROM result GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'empty_result', (SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM result)""",
    "corpus_hash_versions": f"""WITH {CHANGES},
both_versions AS (SELECT 'base' AS version, document_id, source_name, source_sha256 FROM base
  UNION ALL SELECT 'next', document_id, source_name, source_sha256 FROM next),
{io.sql_digest("both_versions", "version")}""",
    "lineage_violations": f"""WITH {TURNS}
SELECT t.conv_id, t.position, t.snapshot_id, t.base_snapshot_id FROM turns t
WHERE t.base_snapshot_id IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM turns b WHERE b.conv_id = t.conv_id AND b.snapshot_id = t.base_snapshot_id AND b.position < t.position)""",
    "snapshot_listing": f"""WITH {TURNS}
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY position DESC) AS listed, snapshot_id, base_snapshot_id,
  position = min(position) OVER (PARTITION BY conv_id) AS current,
  position = max(position) OVER (PARTITION BY conv_id) AS last_successful FROM turns""",
    "snapshot_labels": """WITH ids AS (
  SELECT ts, strftime(ts, '%Y%m%dT%H%M%S%f') || 'Z-' || substr(sha256(event_id::VARCHAR), 1, 12) || '-'
    || substr(sha256(user_id::VARCHAR), 1, 8) AS snapshot_id FROM events),
counted AS (SELECT *, count(*) OVER (PARTITION BY date_trunc('minute', ts)) AS in_minute,
  count(*) OVER (PARTITION BY date_trunc('second', ts)) AS in_second FROM ids),
clash AS (
  SELECT a.snapshot_id, min(n) AS len FROM counted a, range(4, 45) u(n)
  WHERE a.in_second > 1 AND NOT EXISTS (
    SELECT 1 FROM counted b WHERE date_trunc('second', b.ts) = date_trunc('second', a.ts)
      AND b.snapshot_id <> a.snapshot_id AND right(b.snapshot_id, n) = right(a.snapshot_id, n))
  GROUP BY a.snapshot_id)
SELECT snapshot_id, strftime(ts, '%Y-%m-%d %H:%M') || CASE WHEN in_minute > 1 THEN strftime(ts, ':%S') ELSE '' END
  || CASE WHEN in_second > 1 THEN ' · ' || right(snapshot_id, len) ELSE '' END AS label
FROM counted LEFT JOIN clash USING (snapshot_id)""",
    "object_dedup_stats": f"""WITH {CHANGES}
{_storage('base', 'base', "SELECT ''")}
UNION ALL BY NAME {_storage('next', 'next', 'SELECT source_sha256 FROM base')}""",
    "object_layers": f"""WITH {CHUNKS},
layers AS (
  SELECT lang, document_id, kind, source_sha256,
    row_number() OVER (PARTITION BY kind, source_sha256 ORDER BY document_id) AS nth
  FROM ids, unnest(['source', 'parsed', 'chunks']) u(kind))
SELECT lang, kind, count(*) AS object_references, count(*) FILTER (nth = 1) AS new_objects,
  count(*) FILTER (nth > 1) AS reused_objects FROM layers GROUP BY lang, kind""",
    "object_missing": f"""WITH {CHANGES}
SELECT DISTINCT 'source' AS kind, source_sha256 AS sha256, strlen(content_text) AS byte_size FROM next
WHERE source_sha256 NOT IN (SELECT source_sha256 FROM base)""",
}

_CHECKS = (
    "chunk_owner_differs chunk_ordinal_gap chunk_blank chunk_too_long chunk_heading_path_invalid chunk_anchor_range "
    "chunk_anchor_label chunk_id_forged chunk_promoted document_id_format document_source_type document_material_type "
    "document_identifiers_invalid document_topics_invalid document_promoted document_repeated asset_repeated "
    "chunk_repeated asset_without_document document_without_asset chunk_without_asset asset_without_chunk"
).split()


def _audit_sql(counts):
    rows = ", ".join(f"('{name}')" for name in _CHECKS)
    cases = " ".join(f"WHEN '{name}' THEN (SELECT {expr} FROM faulty)" for name, expr in counts.items())
    value = f"CASE name {cases} ELSE 0 END" if counts else "0"
    return f"""WITH {CHUNKS},
faulty AS (SELECT c.*, l.quality, l.toxic FROM chunks c LEFT JOIN labels l USING (doc_id))
SELECT name AS "check", ({value})::BIGINT AS violations FROM (VALUES {rows}) v(name)"""


ORACLES["audit_sound"] = _audit_sql({})
_INJECTED = {
    "chunk_ordinal_gap": "count(*) FILTER (toxic = 1)",
    "chunk_blank": "count(*) FILTER (quality = 0 AND toxic = 0)",
    "chunk_anchor_range": "count(*) FILTER (quality = 1 AND toxic = 0 AND ordinal = 1)",
    "chunk_id_forged": "count(*) FILTER (toxic = 1 OR (quality = 0 AND toxic = 0 AND chunk_text <> ' '))",
    "chunk_promoted": "count(*) FILTER (toxic = 1)",
}
ORACLES["audit_violations"] = _audit_sql(_INJECTED)
ORACLES["audit_all_versions"] = f"""WITH {CHUNKS},
faulty AS (SELECT c.*, l.quality, l.toxic FROM chunks c LEFT JOIN labels l USING (doc_id)),
known AS (SELECT ids.doc_id, ids.lang, l.quality, l.toxic FROM ids LEFT JOIN labels l USING (doc_id)),
versions AS (
  SELECT 'language ' || coalesce(lang, 'none') AS snapshot_id, doc_id FROM known
  UNION ALL SELECT 'unlabelled', doc_id FROM known WHERE quality IS NULL
  UNION ALL SELECT 'whole', doc_id FROM known),
found AS (
  SELECT snapshot_id, u."check", u.violations FROM (
    SELECT snapshot_id, [{", ".join(f"{{'check': '{name}', 'violations': {expr}}}" for name, expr in _INJECTED.items())}] AS rules
    FROM versions JOIN faulty USING (doc_id) GROUP BY snapshot_id) t, unnest(t.rules) AS x(u)
  UNION ALL SELECT 'whole', 'member_without_document', count(*) FROM known WHERE quality = 0 AND toxic = 1
  UNION ALL SELECT 'whole', 'documents', 1 WHERE EXISTS (FROM known WHERE quality = 0 AND toxic = 1))
SELECT v.snapshot_id, coalesce("check", 'sound') AS "check", coalesce(violations, 0)::BIGINT AS violations
FROM (SELECT DISTINCT snapshot_id FROM versions) v
LEFT JOIN (FROM found WHERE violations > 0) f ON v.snapshot_id = f.snapshot_id"""

"""Content-addressed objects of a document: source bytes, parsed units, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from excerpta.functions import text as tx
from excerpta.functions.identity import canonical_json, chunk_id, json_or_null, json_string, json_strings, object_path

FORMAT = "excerpta-object-store"
VERSION = 1
KINDS = ("source", "parsed", "chunks")

# How each media type is read and cut. The text of a step is its identity: changing it changes the objects of that step
# and of those after it, and no others.
STEPS = {
    "text/markdown": {
        "parser": "excerpta markdown 2: strict UTF-8, lines end in LF, no replacement characters",
        "chunker": f"excerpta lines 2: headings start chunks, {tx.MAX_CHUNK_CHARS} characters, blank lines left out",
    },
    "application/pdf": {
        "parser": "excerpta pdf text layer 2: page by page, stripped, not encrypted",
        "chunker": f"excerpta pages 2: pages start chunks, {tx.MAX_CHUNK_CHARS} characters, blank lines left out",
    },
}


def _step(steps, name) -> Column:
    """The identity of a row's step, as JSON, by its media type."""
    chosen = F.lit(None).cast("string")
    for media_type, identity in steps.items():
        chosen = F.when(F.col("media_type") == media_type, canonical_json(identity[name])).otherwise(chosen)
    return chosen


def _object(pairs) -> Column:
    """JSON object with the given (already encoded) members, keys sorted."""
    parts = []
    for name, value in sorted(pairs.items()):
        parts += [F.lit(("," if parts else "{") + canonical_json(name) + ":"), value]
    return F.concat(*parts, F.lit("}"))


def _envelope(kind, identity, payload) -> Column:
    return _object(
        {
            "format": F.lit(canonical_json(FORMAT)),
            "version": F.lit(str(VERSION)),
            "kind": F.lit(canonical_json(kind)),
            "identity": identity,
            "payload": payload,
        }
    )


def parsed_payload(steps=STEPS, units=None, step=None) -> Column:
    units = F.array(tx.normalize_newlines("content_text")) if units is None else units
    return _envelope(
        "parsed",
        _object({"source_sha256": json_string("source_sha256"), "parser": _step(steps, "parser") if step is None else step}),
        _object(
            {
                "media_type": json_string("media_type"),
                "extraction_method": json_string("extraction_method"),
                "extraction_status": json_string("extraction_status"),
                "title_hint": json_string("title_hint"),
                "units": json_strings(units),
                "page_count": json_or_null(F.col("page_count")),
            }
        ),
    )


def chunks_payload(parsed_sha256, steps=STEPS, step=None) -> Column:
    record = F.transform(
        "chunks",
        lambda c: _object(
            {
                "ordinal": c["ordinal"].cast("string"),
                "text": json_string(c["chunk_text"]),
                "heading_path": json_strings(c["heading_path"]),
                "pdf_page_start": json_or_null(c["pdf_page_start"]),
                "pdf_page_end": json_or_null(c["pdf_page_end"]),
                "source_line_start": json_or_null(c["source_line_start"]),
                "source_line_end": json_or_null(c["source_line_end"]),
                "anchor_label": json_string(c["anchor_label"]),
            }
        ),
    )
    return _envelope(
        "chunks",
        _object({"parsed_sha256": json_string(parsed_sha256), "chunker": _step(steps, "chunker") if step is None else step}),
        _object(
            {
                "title_hint": json_string("title_hint"),
                "extracted_char_count": F.col("extracted_char_count").cast("string"),
                "chunks": F.concat(F.lit("["), F.array_join(record, ","), F.lit("]")),
            }
        ),
    )


def object_payloads(documents: DataFrame, *keep: str, steps=STEPS, units=None) -> DataFrame:
    """Three rows per document: ``keep + (document_id, kind, upstream, sha256, byte_size, path, payload)``.

    ``upstream`` is the digest of the object that the layer was made from, null for the source.
    """
    source = F.col("content") if "content" in documents.columns else F.encode("content_text", "UTF-8")
    with_parsed = documents.withColumn("_parsed", parsed_payload(steps, units)).withColumn(
        "_parsed_sha", F.sha2("_parsed", 256)
    )
    layers = F.array(
        F.struct(F.lit("source").alias("kind"), F.lit(None).cast("string").alias("upstream"), source.alias("payload")),
        F.struct(F.lit("parsed").alias("kind"), F.col("source_sha256").alias("upstream"), F.encode("_parsed", "UTF-8").alias("payload")),
        F.struct(
            F.lit("chunks").alias("kind"),
            F.col("_parsed_sha").alias("upstream"),
            F.encode(chunks_payload(F.col("_parsed_sha"), steps), "UTF-8").alias("payload"),
        ),
    )
    return (
        with_parsed.select(*keep, "document_id", F.explode(layers).alias("_o"))
        .select(*keep, "document_id", "_o.kind", "_o.upstream", "_o.payload")
        .withColumn("sha256", F.sha2("payload", 256))
        .withColumn("byte_size", F.octet_length("payload").cast("long"))
        .withColumn("path", object_path(F.col("kind"), F.col("sha256")))
    )


def mark_created(refs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Add ``created_in_snapshot``: the first reference (by document_id) to an object not yet stored.

    The first reference is found with a map-side combined ``min`` per digest and joined back on the
    reference itself, so many copies of one object never meet in one task.
    """
    digest = ["kind", "sha256"]
    first = refs.groupBy(*digest).agg(F.min("document_id").alias("document_id"))
    if existing is not None:
        first = first.join(existing.select(*digest).distinct(), digest, "left_anti")
    flags = first.select("document_id", "kind", F.lit(True).alias("created_in_snapshot"))
    return refs.join(flags, ["document_id", "kind"], "left").withColumn(
        "created_in_snapshot", F.coalesce("created_in_snapshot", F.lit(False))
    )


def storage_stats(refs: DataFrame, *keys: str) -> DataFrame:
    new = F.col("created_in_snapshot")
    size = F.col("byte_size")
    return (
        refs.groupBy(*keys)
        .agg(
            F.count("*").alias("object_references"),
            F.count_if(new).alias("new_objects"),
            F.sum(size).alias("logical_object_bytes"),
            F.coalesce(F.sum(F.when(new, size)), F.lit(0)).alias("new_object_bytes"),
        )
        .withColumn("reused_objects", F.col("object_references") - F.col("new_objects"))
        .withColumn("reused_object_bytes", F.col("logical_object_bytes") - F.col("new_object_bytes"))
    )


def missing_objects(refs: DataFrame, stored: DataFrame) -> DataFrame:
    """Referenced objects that are absent, or stored under a digest or size that does not match.

    Only payloads that are referred to are hashed, however large the store is.
    """
    digest = ["kind", "sha256"]
    wanted = refs.select(*digest, "byte_size").distinct()
    sound = stored.join(wanted.select(*digest), digest, "left_semi").filter(
        (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("byte_size"))
    ).select(*digest, "byte_size")
    return wanted.join(sound, [*digest, "byte_size"], "left_anti")


RECORD = (
    "ordinal int, text string, heading_path array<string>, pdf_page_start int, pdf_page_end int, "
    "source_line_start int, source_line_end int, anchor_label string"
)
LAYOUT = {
    "parsed": (
        "identity struct<source_sha256:string,parser:string>, payload struct<media_type:string,extraction_method:string,"
        "extraction_status:string,title_hint:string,units:array<string>,page_count:int>"
    ),
    "chunks": (
        "identity struct<parsed_sha256:string,chunker:string>, payload struct<title_hint:string,extracted_char_count:bigint,"
        "chunks:array<struct<{}>>>"
    ),
}


def decoded(stored: DataFrame, kind: str, wanted: DataFrame | None = None) -> DataFrame:
    """``sha256, o, fault`` of the objects of one kind, each digest once: ``o`` has identity and payload.

    Decoding is strict: written again from the decoded columns, an object must give its very bytes. So an unknown, missing
    or repeated key, another order of keys, white space between tokens and a number in another form are all found.
    ``fault`` is null for a sound object, else what is wrong first. ``wanted(sha256)`` limits what is decoded.
    """
    rows = stored.filter(F.col("kind") == kind)
    if wanted is not None:
        rows = rows.join(wanted.select("sha256"), "sha256", "left_semi")
    text = F.col("payload").cast("string")
    layout = "format string, version int, kind string, " + LAYOUT[kind].format(_ddl(RECORD))
    # The better of two payloads under one digest: one of them has been changed.
    sound = F.sha2("payload", 256) == F.col("sha256")
    rows = rows.groupBy("sha256").agg(F.max_by("payload", sound.cast("int")).alias("payload"))
    rows = rows.withColumn("_text", text).withColumn("o", F.from_json("_text", layout)).select("*", "o.payload.*", "o.identity.*", F.col("payload").alias("_bytes"))
    if kind == "parsed":
        again = parsed_payload(units=F.col("units"), step=json_string("parser"))
    else:
        named = lambda c: F.struct(*[c[f.split()[0]].alias({"text": "chunk_text"}.get(f.split()[0], f.split()[0])) for f in RECORD.split(", ")])
        rows = rows.withColumn("chunks", F.transform("chunks", named))
        again = chunks_payload(F.col("parsed_sha256"), step=json_string("chunker"))
    fault = (
        F.when(F.sha2("_bytes", 256) != F.col("sha256"), "digest_differs")
        .when(~F.is_valid_utf8(F.col("_text")), "not_utf8")
        .when(F.col("o.kind").isNull(), "not_an_object")
        .when((F.col("o.format") != FORMAT) | (F.col("o.version") != VERSION) | (F.col("o.kind") != kind), "another_format")
        .when(~again.eqNullSafe(F.col("_text")), "not_canonical")
    )
    return rows.select("sha256", "o", fault.alias("fault"))


def decoded_chunks(refs: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunk rows of documents, rebuilt from the chunk objects they refer to.

    ``refs(document_id, asset_id, kind, sha256)``; ``stored(kind, sha256, payload)``. Identities are derived again, and an
    object that does not decode strictly gives no rows. An object that many documents share is decoded once.
    """
    chunk_refs = refs.filter("kind = 'chunks'").select("document_id", "asset_id", "sha256")
    sound = decoded(stored, "chunks", chunk_refs.select("sha256").distinct()).filter("fault is null")
    records = sound.select("sha256", F.explode_outer("o.payload.chunks").alias("c")).filter(F.col("c").isNotNull())
    rows = chunk_refs.join(records, "sha256")
    return rows.select(
        "document_id", "asset_id", "c.ordinal", F.col("c.text").alias("chunk_text"), "c.heading_path", "c.pdf_page_start",
        "c.pdf_page_end", "c.source_line_start", "c.source_line_end", "c.anchor_label",
    ).withColumn("chunk_id", chunk_id("document_id", "ordinal", "anchor_label", "chunk_text"))


def _ddl(fields) -> str:
    return ", ".join(":".join(field.split(" ", 1)) for field in fields.split(", "))

"""Content-derived identifiers and canonical JSON, as columns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

# --- fixed values: identifier formats -----------------------------------------------------------
ID_PATTERNS = {
    "document_id": r"^doc_[0-9a-f]{24}$",
    "asset_id": r"^asset_[0-9a-f]{24}$",
    "chunk_id": r"^chunk_[0-9a-f]{24}$",
    "section_id": r"^sec_[0-9a-f]{24}$",
    "library_id": r"^lib_[0-9a-f]{32}$",
    "snapshot_id": r"^[0-9]{8}T[0-9]{12}Z-[0-9a-f]{12}-[0-9a-f]{8}$",
    "profile_id": r"^profile_[0-9a-f]{64}$",
    "vector_object_id": r"^vec_[0-9a-f]{64}$",
    "sha256": r"^[0-9a-f]{64}$",
}
# ------------------------------------------------------------------------------------------------

# The corpus digest's tree: hex digits of the document id that name a leaf and an inner node.
ID_PREFIX = len("doc_")
LEAF_DIGITS = 6
NODE_DIGITS = 3


def canonical_json(value) -> str:
    """Sorted keys, no spaces, no ASCII escaping, no NaN; for small driver-side values only."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def json_string(text) -> Column:
    """JSON string literal with exactly the escapes of ``canonical_json``.

    Line feed, tab and carriage return are common; the other control characters have a test of their own, so that
    ordinary texts pay for three replacements.
    """
    text = F.col(text) if isinstance(text, str) else text
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    common = rare = escaped
    for char in "\n\t\r":
        common = F.replace(common, F.lit(char), F.lit(json.dumps(char)[1:-1]))
    for code in range(32):
        rare = F.replace(rare, F.lit(chr(code)), F.lit(json.dumps(chr(code))[1:-1]))
    body = F.when(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), rare).otherwise(common)
    return F.concat(F.lit('"'), body, F.lit('"'))


def json_or_null(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def json_strings(values: Column) -> Column:
    """JSON array of strings."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, json_string), ","), F.lit("]"))


def sha256(text) -> Column:
    return F.sha2(text, 256)


def _short(prefix, *parts) -> Column:
    """Prefix and the first 24 hex digits over the NUL-joined parts."""
    return F.concat(F.lit(prefix), F.substring(sha256(F.concat_ws("\0", *parts)), 1, 24))


def document_id(source_name, source_sha256) -> Column:
    return _short("doc_", source_name, source_sha256)


def asset_id(source_name, source_sha256) -> Column:
    return _short("asset_", source_name, source_sha256)


def chunk_id(document, ordinal, anchor, text) -> Column:
    return _short("chunk_", document, ordinal, anchor, text)


def section_id(library, snapshot, document, asset, kind, heading_path, page, first_chunk, last_chunk) -> Column:
    listing = F.concat(
        F.lit("["),
        F.concat_ws(
            ",",
            *(json_string(part) for part in (library, snapshot, document, asset, kind)),
            json_strings(heading_path),
            json_or_null(page),
            json_string(first_chunk),
            json_string(last_chunk),
        ),
        F.lit("]"),
    )
    return F.concat(F.lit("sec_"), F.substring(sha256(listing), 1, 24))


def object_path(kind, digest) -> Column:
    return F.concat(F.lit("objects/"), kind, F.lit("/"), digest, F.lit("/payload"))


def _leaf() -> Column:
    return F.substring("document_id", ID_PREFIX + 1, LEAF_DIGITS)


def corpus_leaves(members: DataFrame, *keys: str) -> DataFrame:
    """``keys, leaf, members, digest``: the leaves of the hash tree over ``(document_id, source_name, source_sha256)``.

    Members are dealt to leaves by the first ``LEAF_DIGITS`` hex digits of the document id, which is a hash itself, so
    leaves are even. A leaf is the SHA-256 of the canonical JSON list of its members in order of their ids.
    """
    entry = F.concat(
        F.lit('{"document_id":'), json_string("document_id"),
        F.lit(',"source_name":'), json_string("source_name"),
        F.lit(',"source_sha256":'), json_string("source_sha256"),
        F.lit("}"),
    )
    listing = F.array_sort(F.collect_list(F.struct("document_id", entry.alias("e"))))
    content = F.concat(F.lit("["), F.array_join(F.transform(listing, lambda m: m["e"]), ","), F.lit("]"))
    return members.groupBy(*keys, _leaf().alias("leaf")).agg(F.count("*").alias("members"), sha256(content).alias("digest"))


def _above(nodes: DataFrame, digits: int, *keys: str) -> DataFrame:
    below = F.array_sort(F.collect_list(F.struct("leaf", "digest")))
    return nodes.groupBy(*keys, F.substring("leaf", 1, digits).alias("_up")).agg(
        F.sum("members").alias("members"), sha256(F.array_join(F.transform(below, lambda n: n["digest"]), "")).alias("digest")
    ).withColumnRenamed("_up", "leaf")


def corpus_root(leaves: DataFrame, *keys: str) -> DataFrame:
    """``keys, members, corpus_sha256`` of a tree's leaves: an inner node is the SHA-256 of its leaves' digests in order, the
    root that of the inner nodes' digests. No task lists more than the digests of one node."""
    nodes = _above(_above(leaves, NODE_DIGITS, *keys), 0, *keys)
    return nodes.select(*keys, "members", F.col("digest").alias("corpus_sha256"))


def corpus_digest(members: DataFrame, *keys: str) -> DataFrame:
    """One SHA-256 per ``keys`` group over its members: the root of a hash tree of three levels, the same for every size."""
    return corpus_root(corpus_leaves(members, *keys), *keys)


def updated_leaves(leaves: DataFrame, members: DataFrame, touched: DataFrame) -> DataFrame:
    """The leaves of ``members``, given those of an earlier version and every document id that came or went since
    (``touched(document_id)``). Only leaves of touched ids are listed and hashed again."""
    changed = touched.select(_leaf().alias("leaf")).distinct()
    again = corpus_leaves(members.withColumn("_leaf", _leaf()).join(changed.withColumnRenamed("leaf", "_leaf"), "_leaf", "left_semi").drop("_leaf"))
    return leaves.join(changed, "leaf", "left_anti").select("leaf", "members", "digest").unionByName(again)


def differing_leaves(left: DataFrame, right: DataFrame) -> DataFrame:
    """``leaf, left_digest, right_digest`` of the leaves in which two trees differ, found by descending: leaves are compared
    below unequal inner nodes only. A leaf that a tree lacks has no digest there."""
    def side(nodes, name):
        return nodes.select("leaf", F.col("digest").alias(name))

    unequal = ~F.col("left_digest").eqNullSafe(F.col("right_digest"))
    nodes = side(_above(left, NODE_DIGITS), "left_digest").join(side(_above(right, NODE_DIGITS), "right_digest"), "leaf", "full")
    open_nodes = F.broadcast(nodes.filter(unequal).select(F.col("leaf").alias("_node")))  # at most 16 ** NODE_DIGITS rows
    below = [
        side(leaves, name).withColumn("_node", F.substring("leaf", 1, NODE_DIGITS)).join(open_nodes, "_node", "left_semi").drop("_node")
        for leaves, name in ((left, "left_digest"), (right, "right_digest"))
    ]
    return below[0].join(below[1], "leaf", "full").filter(unequal)

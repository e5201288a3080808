"""The eight read-only tools, their argument schemas and the dispatcher."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, functions as F

from excerpta import __version__
from excerpta.enhanced import EMPTY_MESSAGE
from excerpta.errors import EnhancedSearchError, EvidenceError, SearchInputError, SnapshotError
from excerpta.functions import query as q, text as tx
from excerpta.functions.identity import ID_PATTERNS
from excerpta.operators import bm25, navigation
from excerpta.registry import LibraryRegistry

MAX_BATCH = 5
NAVIGATION_NOTE = "Derived from heading paths or page numbers; not an author's table of contents."
CJK_HINT = "Contiguous CJK text is not segmented by the index; try spaces between the words."


def _identifier(value, name):
    if not isinstance(value, str) or not re.match(ID_PATTERNS[name], value):
        raise SearchInputError(f"{name} is malformed")
    return value


def _tool_query(value):
    if not isinstance(value, str) or not 1 <= len(value) <= q.MAX_QUERY_CHARS:
        raise SearchInputError(f"query must have 1-{q.MAX_QUERY_CHARS} characters")
    return q.checked_query(value)


def _rows(frame: DataFrame):
    """Bounded result rows as plain dictionaries."""
    return [row.asDict(recursive=True) for row in frame.collect()]


class EvidenceTools:
    def __init__(self, registry: LibraryRegistry, enhanced=None):
        self.registry = registry
        self.enhanced = enhanced
        self._libraries = {}

    def _library(self, library_id):
        self.registry.library_path(library_id)
        if library_id not in self._libraries:
            self._libraries[library_id] = self.registry.library(library_id)
        return self._libraries[library_id]

    def _open(self, library_id, snapshot_id):
        library = self._library(library_id)
        return library, library.opened(snapshot_id)

    # --- search ------------------------------------------------------------------------------

    def search_documents(self, library_id, snapshot_id, query, *, top_k=5, excerpt_chars=1000, mode="bm25"):
        if mode == "enhanced":
            if self.enhanced is None:
                raise EnhancedSearchError("enhanced search is not configured")
            library = self._library(library_id)
            found = self.enhanced.search(library, snapshot_id, query, top_k=top_k, excerpt_chars=excerpt_chars)
            return {**found, "library_id": library_id}
        if mode != "bm25":
            raise SearchInputError("mode must be bm25 or enhanced")
        query = _tool_query(query)
        q.bounded_int(top_k, "top_k", bm25.MAX_TOP_K)
        q.bounded_int(excerpt_chars, "excerpt_chars", 1200)
        library, manifest = self._open(library_id, snapshot_id)
        results = self._hits(library, manifest, query, top_k, excerpt_chars)
        base = {"library_id": library_id, "snapshot_id": snapshot_id, "retrieval_mode": "bm25"}
        if results:
            return {"found": True, "results": results, **base}
        empty = {"found": False, "results": [], "message": EMPTY_MESSAGE, **base}
        if re.search(r"[぀-ヿ㐀-䶿一-鿿豈-﫿가-힯]{2,}", query):
            empty["input_hint"] = CJK_HINT
        return empty

    def find_in_document(self, library_id, snapshot_id, document_id, query, *, top_k=5, excerpt_chars=600):
        _identifier(document_id, "document_id")
        query = _tool_query(query)
        q.bounded_int(top_k, "top_k", bm25.MAX_TOP_K)
        q.bounded_int(excerpt_chars, "excerpt_chars", 1200)
        library, manifest = self._open(library_id, snapshot_id)
        self._document(library, manifest, document_id)
        results = self._hits(library, manifest, query, top_k, excerpt_chars, document_id)
        base = {
            "library_id": library_id, "snapshot_id": snapshot_id, "document_id": document_id, "retrieval_mode": "bm25",
        }
        if not results:
            return {"found": False, "results": [], "message": EMPTY_MESSAGE, **base}
        return {"found": True, "results": results, **base}

    def _hits(self, library, manifest, query, top_k, excerpt_chars, document_id=None):
        phrases = q.phrases(query)
        if not phrases:
            return []
        snapshot_id = manifest["snapshot_id"]
        words = library.spark.createDataFrame(
            [(0, i, offset, len(p), word) for i, p in enumerate(phrases) for offset, word in enumerate(p)],
            "query_id int, phrase int, offset int, words int, term string",
        )
        terms = sorted({word for phrase in phrases for word in phrase})
        # The IN list reaches the Parquet scan; postings are sorted by term, so few row groups match.
        posts = library.table(snapshot_id, "posting", manifest).filter(F.col("term").isin(terms))
        stats = library.spark.createDataFrame(
            [(manifest["stats"]["rows"], manifest["stats"]["tokens"])], "rows bigint, tokens bigint"
        )
        posts = posts.withColumn("owned", F.struct("chunk_id", "document_id"))
        posts = bm25.deal(posts, bm25.tasks_for(posts, posts.count()), key="owned")
        scored = bm25.score_postings(posts, stats, words, key="owned").select("owned.*", "score")
        if document_id is not None:
            # After scoring: the statistics stay those of the whole snapshot.
            scored = scored.filter(F.col("document_id") == document_id)
        best = bm25.top_k(scored, top_k, key="chunk_id").collect()
        if not best:
            return []
        found = self._evidence(
            library, manifest, [row["chunk_id"] for row in best], sorted({row["document_id"] for row in best})
        )
        rows = {row["chunk_id"]: row for row in _rows(found.withColumn("excerpt", tx.excerpt("chunk_text", excerpt_chars)))}
        return [self._public(rows[row["chunk_id"]], score=row["score"]) for row in best]

    # --- excerpts ----------------------------------------------------------------------------

    def _document(self, library, manifest, document_id):
        documents = library.table(manifest["snapshot_id"], "document", manifest)
        row = documents.filter(F.col("document_id") == document_id).first()
        if row is None:
            raise SearchInputError("the snapshot has no such document_id")
        return row

    def _evidence(self, library, manifest, chunk_ids, document_ids):
        """Evidence rows of at most ten chunks.

        Both tables are range-partitioned by document, so the document ids prune files and row
        groups down to the few that hold the hits.
        """
        snapshot_id = manifest["snapshot_id"]
        inside = F.col("document_id").isin(document_ids)
        chunks = library.table(snapshot_id, "chunk", manifest).filter(inside & F.col("chunk_id").isin(chunk_ids))
        documents = library.table(snapshot_id, "document", manifest).filter(inside)
        return navigation.evidence(F.broadcast(chunks), documents)

    @staticmethod
    def _public(row, **extra):
        return {**{name: row[name] for name in navigation.EVIDENCE}, "excerpt": row["excerpt"], **extra}

    def get_excerpt(self, library_id, snapshot_id, document_id, chunk_id, *, max_chars=600):
        found = self._excerpts(library_id, snapshot_id, document_id, [chunk_id], max_chars, "max_chars")[0]
        truncated = found.pop("truncated")
        return {
            "found": True, "library_id": library_id, "snapshot_id": snapshot_id, "result": found, "truncated": truncated,
        }

    def get_multiple_excerpts(self, library_id, snapshot_id, document_id, chunk_ids, *, per_item_chars=600):
        if not isinstance(chunk_ids, list) or not 1 <= len(chunk_ids) <= MAX_BATCH:
            raise SearchInputError(f"chunk_ids must hold 1-{MAX_BATCH} ids")
        results = self._excerpts(library_id, snapshot_id, document_id, chunk_ids, per_item_chars, "per_item_chars")
        return {
            "found": True, "library_id": library_id, "snapshot_id": snapshot_id, "document_id": document_id,
            "results": results,
        }

    def _excerpts(self, library_id, snapshot_id, document_id, chunk_ids, limit, limit_name):
        _identifier(document_id, "document_id")
        for chunk_id in chunk_ids:
            _identifier(chunk_id, "chunk_id")
        if len(set(chunk_ids)) != len(chunk_ids):
            raise SearchInputError("chunk_ids must not repeat")
        q.bounded_int(limit, limit_name, 1200)
        library, manifest = self._open(library_id, snapshot_id)
        found = self._evidence(library, manifest, chunk_ids, [document_id])
        shown = found.withColumn("excerpt", tx.excerpt("chunk_text", limit)).withColumn(
            "truncated", tx.is_truncated("chunk_text", limit)
        )
        rows = {row["chunk_id"]: row for row in _rows(shown)}
        if set(rows) != set(chunk_ids):
            raise SearchInputError("a chunk_id is not in the snapshot or not in the document")
        return [self._public(rows[chunk_id], truncated=rows[chunk_id]["truncated"]) for chunk_id in chunk_ids]

    # --- documents ---------------------------------------------------------------------------

    def get_document_metadata(self, library_id, snapshot_id, document_id):
        _identifier(document_id, "document_id")
        library, manifest = self._open(library_id, snapshot_id)
        document = self._document(library, manifest, document_id).asDict(recursive=True)

        def own(name):
            return library.table(snapshot_id, name, manifest).filter(F.col("document_id") == document_id)

        assets = navigation.asset_summary(own("asset"), own("chunk")).orderBy("asset_id").drop("document_id")
        return {
            "found": True, "library_id": library_id, "snapshot_id": snapshot_id,
            "document": {**document, "assets": _rows(assets)},
        }

    def _own_chunks(self, library, manifest, document_id):
        about = self._document(library, manifest, document_id)
        chunks = library.table(manifest["snapshot_id"], "chunk", manifest).filter(F.col("document_id") == document_id)
        return about, chunks.withColumn("material_type", F.lit(about["material_type"]))

    def get_document_toc(self, library_id, snapshot_id, document_id, *, max_items=100):
        _identifier(document_id, "document_id")
        q.bounded_int(max_items, "max_items", 100)
        library, manifest = self._open(library_id, snapshot_id)
        about, chunks = self._own_chunks(library, manifest, document_id)
        found = navigation.toc(chunks, F.lit(library_id), F.lit(snapshot_id), max_items).orderBy("section_no")
        items = _rows(found)
        truncated = any(item["truncated"] for item in items)
        for item in items:
            del item["section_no"], item["truncated"]
        return {
            "found": True, "library_id": library_id, "snapshot_id": snapshot_id, "document_id": document_id,
            "title": about["title"], "source_name": about["source_name"], "items": items, "truncated": truncated,
            "navigation_semantics": NAVIGATION_NOTE,
        }

    def read_document_section(self, library_id, snapshot_id, document_id, section_id, *, max_chars=1200):
        _identifier(document_id, "document_id")
        _identifier(section_id, "section_id")
        q.bounded_int(max_chars, "max_chars", 1200)
        library, manifest = self._open(library_id, snapshot_id)
        _about, chunks = self._own_chunks(library, manifest, document_id)
        found = navigation.sections(chunks, F.lit(library_id), F.lit(snapshot_id)).filter(F.col("section_id") == section_id)
        section = found.first()
        if section is None:
            raise SearchInputError("section_id does not belong to this snapshot and document")
        section = section.asDict(recursive=True)
        number = section.pop("section_no")
        del section["total"]
        inside = navigation.with_sections(chunks).filter(F.col("section_no") == number)
        total = inside.agg(F.sum(F.length("chunk_text")).alias("chars")).first()["chars"]
        documents = library.table(snapshot_id, "document", manifest).filter(F.col("document_id") == document_id)
        kept = navigation.budgeted(inside.drop("material_type"), max_chars, "document_id")
        # A budget of 1200 characters bounds the rows that come back.
        rows = _rows(navigation.evidence(kept, documents, "excerpt").orderBy("asset_id", "ordinal", "chunk_id"))
        returned = sum(len(row["excerpt"]) for row in rows)
        return {
            "found": True, "library_id": library_id, "snapshot_id": snapshot_id, "document_id": document_id,
            "section": section, "results": [self._public(row) for row in rows], "returned_chars": returned,
            "truncated": returned < total,
        }

    def retrieval_status(self, library_id=None, snapshot_id=None):
        common = {"readonly": True, "closed_world": True, "service_version": __version__}
        if library_id is None and snapshot_id is not None:
            raise SearchInputError("a snapshot_id alone does not name a library")
        if library_id is None:
            keys = ("library_id", "name", "description", "current_snapshot_id", "last_successful_snapshot_id")
            libraries = [{key: item[key] for key in keys} for item in self.registry.overview()]
            return {"scope": "libraries", "libraries": libraries, **common}
        library = self._library(library_id)
        if snapshot_id is None:
            status = library.catalog_status()
            del status["snapshot_count"]
            return {
                "scope": "snapshots", "library_id": library_id, **status, "snapshots": library.list_snapshots(), **common,
            }
        return {
            "scope": "snapshot", "found": True, "ready": True, "library_id": library_id, "retrieval_mode": "bm25",
            **library.verify(snapshot_id), **common,
        }


# --- argument schemas and dispatch ------------------------------------------------------------------


def _text_schema(name):
    return {"type": "string", "pattern": ID_PATTERNS[name]}


def _int_schema(default, maximum):
    return {"type": "integer", "minimum": 1, "maximum": maximum, "default": default}


_SNAPSHOT = {"library_id": _text_schema("library_id"), "snapshot_id": _text_schema("snapshot_id")}
_DOCUMENT = {**_SNAPSHOT, "document_id": _text_schema("document_id")}
_QUERY = {"query": {"type": "string", "minLength": 1, "maxLength": q.MAX_QUERY_CHARS}}
_IDS = {"type": "array", "minItems": 1, "maxItems": MAX_BATCH, "uniqueItems": True, "items": _text_schema("chunk_id")}

# name: (required arguments, optional arguments)
ARGUMENTS = {
    "search_documents": (
        {**_SNAPSHOT, **_QUERY},
        {
            "top_k": _int_schema(5, 10),
            "excerpt_chars": _int_schema(1000, 1200),
            "mode": {"type": "string", "enum": ["bm25", "enhanced"], "default": "bm25"},
        },
    ),
    "get_excerpt": ({**_DOCUMENT, "chunk_id": _text_schema("chunk_id")}, {"max_chars": _int_schema(600, 1200)}),
    "get_multiple_excerpts": ({**_DOCUMENT, "chunk_ids": _IDS}, {"per_item_chars": _int_schema(600, 1200)}),
    "get_document_metadata": (_DOCUMENT, {}),
    "get_document_toc": (_DOCUMENT, {"max_items": _int_schema(100, 100)}),
    "read_document_section": (
        {**_DOCUMENT, "section_id": _text_schema("section_id")}, {"max_chars": _int_schema(1200, 1200)},
    ),
    "find_in_document": (
        {**_DOCUMENT, **_QUERY}, {"top_k": _int_schema(5, 10), "excerpt_chars": _int_schema(600, 1200)},
    ),
    "retrieval_status": ({}, _SNAPSHOT),
}


def tool_schemas():
    return {
        name: {
            "type": "object",
            "properties": {**required, **optional},
            "required": list(required),
            "additionalProperties": False,
        }
        for name, (required, optional) in ARGUMENTS.items()
    }


def call_tool(tools: EvidenceTools, name, arguments=None):
    """Run one tool; expected failures come back as an error code, never as a partial result."""
    arguments = dict(arguments or {})
    if name not in ARGUMENTS:
        return {"error": {"code": "UNKNOWN_TOOL", "message": "unknown tool"}}
    required, optional = ARGUMENTS[name]
    try:
        if set(arguments) - set(required) - set(optional):
            raise SearchInputError("the call has undeclared arguments")
        if set(required) - set(arguments):
            raise SearchInputError("the call lacks required arguments")
        return getattr(tools, name)(**arguments)
    except EnhancedSearchError as error:
        code = "ENHANCED_UNAVAILABLE" if tools.enhanced is None else "ENHANCED"
        return {"error": {"code": code, "message": str(error)}, "audit": error.audit}
    except SearchInputError as error:
        return {"error": {"code": "INVALID_INPUT", "message": str(error)}}
    except SnapshotError:
        return {"error": {"code": "SNAPSHOT", "message": "the snapshot is missing, foreign or failed its audit"}}
    except EvidenceError:
        return {"error": {"code": "LOCAL", "message": "the read-only request failed"}}
    except Exception:
        return {"error": {"code": "INTERNAL", "message": "internal error"}}


def to_json(payload):
    return json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

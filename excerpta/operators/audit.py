"""Integrity audit of snapshot tables: every rule is a count of violations, zero everywhere means sound."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from excerpta.functions import identity, text as tx
from excerpta.operators.members import lineage_faults
from excerpta.operators.chunking import markdown_anchor, pdf_anchor


def count_rows(name, frame) -> DataFrame:
    return frame.agg(F.count("*").cast("long").alias("violations")).select(F.lit(name).alias("check"), "violations")


def _sum_up(frame: DataFrame, rules: dict[str, Column], *keys: str) -> DataFrame:
    """All row rules of one table in a single pass, turned into one row per rule (and ``keys``)."""
    counted = frame.groupBy(*keys).agg(*(F.count_if(F.coalesce(bad, F.lit(True))).alias(name) for name, bad in rules.items()))
    return counted.unpivot(list(keys), list(rules), "check", "violations")


def _union(frames) -> DataFrame:
    return reduce(lambda left, right: left.unionByName(right), frames)


def _has_id(column, pattern) -> Column:
    return F.coalesce(F.col(column), F.lit("")).rlike(identity.ID_PATTERNS[pattern])


def chunk_rules(chunks: DataFrame, assets: DataFrame, documents: DataFrame, *keys: str) -> DataFrame:
    """Row rules of chunks: owner, ordinal, size, anchors, derived label and derived id.

    Everything that needs the text is decided where the row lies; only flags and anchors are
    shuffled, once, by asset.
    """
    markdown_label = markdown_anchor(F.col("source_line_start"), F.col("source_line_end"), F.col("heading_path"))
    local = chunks.select(
        "chunk_id", "document_id", "asset_id", "ordinal",
        "pdf_page_start", "pdf_page_end", "source_line_start", "source_line_end",
        (F.coalesce(tx.strip("chunk_text"), F.lit("")) == "").alias("_blank"),
        (F.length("chunk_text") > tx.MAX_CHUNK_CHARS).alias("_long"),
        (F.col("heading_path").isNull() | F.exists("heading_path", lambda h: h.isNull())).alias("_path_bad"),
        (F.size("heading_path") == 0).alias("_path_empty"),
        F.col("anchor_label").eqNullSafe(markdown_label).alias("_markdown_label"),
        F.col("anchor_label").eqNullSafe(pdf_anchor(F.col("pdf_page_start"))).alias("_pdf_label"),
        F.col("chunk_id")
        .eqNullSafe(identity.chunk_id("document_id", "ordinal", "anchor_label", "chunk_text"))
        .alias("_id_ok"),
        (F.col("fulltext_verified") | F.col("formula_verified")).alias("_promoted"),
    )
    owners = assets.select("asset_id", F.col("document_id").alias("_owner"), "page_count").join(
        documents.select(F.col("document_id").alias("_owner"), "media_type"), "_owner", "left"
    )
    # One asset is one imported file, so this window is bounded by that file.
    owned = local.join(owners, "asset_id", "left").withColumn(
        "_expected", F.row_number().over(Window.partitionBy("asset_id").orderBy("ordinal", "chunk_id"))
    )
    markdown = F.col("media_type") == "text/markdown"
    pdf = F.col("media_type") == "application/pdf"
    no_pages = F.col("pdf_page_start").isNull() & F.col("pdf_page_end").isNull()
    no_lines = F.col("source_line_start").isNull() & F.col("source_line_end").isNull()
    lines_ok = F.coalesce(
        (F.col("source_line_start") >= 1) & (F.col("source_line_start") <= F.col("source_line_end")), F.lit(False)
    )
    pages_ok = F.coalesce(
        (F.col("pdf_page_start") >= 1)
        & (F.col("pdf_page_start") == F.col("pdf_page_end"))
        & (F.col("pdf_page_end") <= F.col("page_count")),
        F.lit(False),
    )
    anchors = (
        F.when(markdown, no_pages & lines_ok)
        .when(pdf, no_lines & pages_ok & F.col("_path_empty"))
        .otherwise(False)
    )
    label_ok = F.when(markdown, F.col("_markdown_label")).when(pdf, F.col("_pdf_label")).otherwise(False)
    return _sum_up(
        owned,
        {
            "chunk_owner_differs": ~F.col("document_id").eqNullSafe(F.col("_owner")),
            "chunk_ordinal_gap": ~F.col("ordinal").eqNullSafe(F.col("_expected")),
            "chunk_blank": F.col("_blank"),
            "chunk_too_long": F.col("_long"),
            "chunk_heading_path_invalid": F.col("_path_bad"),
            "chunk_anchor_range": ~anchors,
            "chunk_anchor_label": ~label_ok,
            "chunk_id_forged": ~F.col("_id_ok"),
            "chunk_promoted": F.col("_promoted"),
        },
        *keys,
    )


def document_rules(documents: DataFrame, *keys: str) -> DataFrame:
    material = F.when(F.col("media_type") == "text/markdown", "markdown").when(
        F.col("media_type") == "application/pdf", "pdf"
    )
    return _sum_up(
        documents,
        {
            "document_id_format": ~_has_id("document_id", "document_id"),
            "document_source_type": ~F.col("source_type").eqNullSafe(F.lit("local_file")),
            "document_material_type": F.coalesce(F.col("material_type") != material, F.lit(True)),
            "document_identifiers_invalid": F.col("identifiers").isNull()
            | F.exists(F.map_values("identifiers"), lambda v: v.isNull()),
            "document_topics_invalid": F.col("topics").isNull() | F.exists("topics", lambda t: t.isNull()),
            "document_promoted": F.col("fulltext_verified") | F.col("formula_verified"),
        },
        *keys,
    )


def table_rules(documents: DataFrame, assets: DataFrame, chunks: DataFrame) -> list[DataFrame]:
    """Keys and references between the three tables.

    Each pair of tables is counted per shared key in one map-side combined aggregation, which
    answers uniqueness and both directions of the reference at once.
    """

    def side_by_side(left, right, key):
        both = left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
            right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
        )
        return both.groupBy(key).agg(F.sum("_l").alias("_left"), F.sum("_r").alias("_right"))

    def tally(frame, **counts):
        totals = frame.agg(
            *(F.coalesce(F.sum(value), F.lit(0)).cast("long").alias(name) for name, value in counts.items())
        )
        return totals.unpivot([], list(counts), "check", "violations")

    left, right = F.col("_left"), F.col("_right")
    repeated = F.when(left > 1, 1)
    return [
        tally(
            side_by_side(documents, assets, "document_id"),
            document_repeated=repeated,
            asset_without_document=F.when(left == 0, right),
            document_without_asset=F.when(right == 0, left),
        ),
        tally(
            side_by_side(assets, chunks, "asset_id"),
            asset_repeated=repeated,
            chunk_without_asset=F.when(left == 0, right),
            asset_without_chunk=F.when(right == 0, left),
        ),
        count_rows("chunk_repeated", chunks.groupBy("chunk_id").count().filter("count > 1")),
    ]


def serialized_rules(rows: DataFrame, *, lists=(), maps=()) -> DataFrame:
    """JSON text columns must hold string lists or string-to-string objects."""
    rules = {}
    for name in lists:
        parsed = F.from_json(name, "array<string>", {"mode": "PERMISSIVE"})
        # Re-encoding exposes members that were not strings: they lose or gain quotes.
        rules[f"{name}_not_string_list"] = parsed.isNull() | ~F.to_json(parsed).eqNullSafe(_squeezed(name))
    for name in maps:
        parsed = F.from_json(name, "map<string,string>", {"mode": "PERMISSIVE"})
        rules[f"{name}_not_string_map"] = parsed.isNull() | ~F.to_json(parsed).eqNullSafe(_squeezed(name))
    return _sum_up(rows, rules)


def _squeezed(name) -> Column:
    """JSON text without white space between its tokens."""
    return F.regexp_replace(F.col(name), r'("(?:[^"\\]|\\.)*")|\s+', "$1")


def manifest_rules(documents, assets, chunks, manifest_sources: DataFrame) -> list[DataFrame]:
    """Tables against the source list of the manifest, column by column (null-safe)."""
    counted = chunks.groupBy("asset_id").agg(F.count("*").alias("chunk_count"))
    actual = (
        documents.select("document_id", "title", "source_name", "media_type")
        .join(assets, "document_id")
        .join(counted, "asset_id", "left")
        .withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    )
    columns = (
        "asset_id", "title", "source_name", "media_type", "stored_path", "source_sha256", "byte_size",
        "extraction_method", "extraction_status", "page_count", "extracted_char_count", "chunk_count",
    )
    expected = manifest_sources.select("document_id", F.struct(*columns).alias("_expected"))
    both = actual.select("document_id", F.struct(*columns).alias("_actual")).join(expected, "document_id", "full_outer")
    return [
        count_rows("manifest_source_differs", both.filter(~F.col("_actual").eqNullSafe(F.col("_expected"))))
    ]


def object_chunk_rules(chunks: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Stored chunks against the chunks held by the content-addressed objects."""
    columns = (
        "chunk_id", "asset_id", "chunk_text", "heading_path", "pdf_page_start", "pdf_page_end",
        "source_line_start", "source_line_end", "anchor_label",
    )
    left = chunks.select("document_id", "ordinal", F.struct(*columns).alias("_stored"))
    right = rebuilt.select("document_id", "ordinal", F.struct(*columns).alias("_object"))
    both = left.join(right, ["document_id", "ordinal"], "full_outer")
    return count_rows("chunk_differs_from_object", both.filter(~F.col("_stored").eqNullSafe(F.col("_object"))))


def rules(documents: DataFrame, assets: DataFrame, chunks: DataFrame) -> list[DataFrame]:
    """The rules of the three tables as independent ``(check, violations)`` frames."""
    return [chunk_rules(chunks, assets, documents), document_rules(documents), *table_rules(documents, assets, chunks)]


def audit(documents: DataFrame, assets: DataFrame, chunks: DataFrame, *more: DataFrame) -> DataFrame:
    """``(check, violations)`` over all rules; ``more`` adds counts computed elsewhere."""
    return _union([*rules(documents, assets, chunks), *more])


def version_rules(catalog: DataFrame, members: DataFrame, documents: DataFrame, assets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Violations of every snapshot of a catalog, ``(snapshot_id, check, violations)``, whatever their number in one pass.

    ``catalog`` has snapshot_id, documents, chunks (the counts it states), ``members`` snapshot_id, document_id. Rows are
    audited once, by document; snapshots that share a document share its faults, so only the few faulty documents and three
    numbers of each other one meet the member lists. A snapshot without a violation has the one row ``sound``, 0; members
    of snapshots outside the catalog do not count. A repeated member counts each time.
    """
    faults = _union([chunk_rules(chunks, assets, documents, "document_id"), document_rules(documents, "document_id")])
    by_rows = members.join(faults.filter("violations > 0"), "document_id").groupBy("snapshot_id", "check")
    rows = documents.groupBy("document_id").agg(F.count("*").alias("_rows"))
    sizes = chunks.groupBy("document_id").agg(F.count("*").alias("_chunks"))
    held = members.join(rows, "document_id", "left").join(sizes, "document_id", "left")
    bound = {
        "member_without_document": F.col("_rows").isNull(),
        "document_repeated": F.coalesce("_rows", F.lit(0)) > 1,
        "document_without_chunk": F.col("_rows").isNotNull() & F.col("_chunks").isNull(),
    }
    totals = held.groupBy("snapshot_id").agg(F.count("*").alias("_documents"), F.sum(F.coalesce("_chunks", F.lit(0))).alias("_chunks"))
    counted = catalog.join(totals, "snapshot_id", "left").fillna(0, ["_documents", "_chunks"])
    stated = {
        "documents": ~F.col("documents").eqNullSafe(F.col("_documents")),
        "chunks": ~F.col("chunks").eqNullSafe(F.col("_chunks")),
    }
    found = _union([
        by_rows.agg(F.sum("violations").alias("violations")),
        _sum_up(held, bound, "snapshot_id"),
        _sum_up(counted, stated, "snapshot_id"),
    ]).filter("violations > 0")
    return catalog.select("snapshot_id").join(found, "snapshot_id", "left").select(
        "snapshot_id", F.coalesce("check", F.lit("sound")).alias("check"), F.coalesce("violations", F.lit(0)).cast("long").alias("violations")
    )


def content_fingerprint(table: DataFrame) -> DataFrame:
    """Order-independent identity of a table: row count and the sum of the rows' SHA-256 prefixes.

    A sum over 60-bit prefixes in decimal(38,0) combines map-side and does not overflow below
    10^20 rows.
    """
    row = F.sha2(F.to_json(F.struct(*table.columns), {"ignoreNullFields": "false"}), 256)

    def part(start):
        number = F.conv(F.substring(row, start, 15), 16, 10).cast("decimal(28,0)")
        return F.coalesce(F.sum(number).cast("string"), F.lit("0"))

    return table.agg(F.count("*").alias("rows"), part(1).alias("sum_a"), part(16).alias("sum_b"))


def row_checksum(table: DataFrame) -> DataFrame:
    """Row count and the sum of 64-bit row hashes: a cheap order-independent identity for derived tables."""
    return table.agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*table.columns).cast("decimal(38,0)")).cast("string"), F.lit("0")).alias("sum")
    )


PRINT = "document_id string, name string, rows bigint, sum_a decimal(38,0), sum_b decimal(38,0)"


def document_prints(tables: dict[str, DataFrame], derived=()) -> DataFrame:
    """Rows and two sums over the rows of each document in each table: ``document_id, name, rows, sum_a, sum_b``.

    Sums of SHA-256 prefixes as in :func:`content_fingerprint`; for ``derived`` tables, which are wide and often long, a sum
    of 64-bit hashes and 0. They combine map-side, and they add up: the print of any set of documents is the sum of theirs,
    so a change of a few documents changes the print of a table without reading the rest of it.
    """

    def one(name, table):
        columns = sorted(c for c in table.columns if c != "document_id")
        if name in derived:
            parts = [F.xxhash64("document_id", *columns).cast("decimal(28,0)"), F.lit(0).cast("decimal(28,0)")]
        else:
            row = F.sha2(F.to_json(F.struct("document_id", *columns), {"ignoreNullFields": "false"}), 256)
            parts = [F.conv(F.substring(row, start, 15), 16, 10).cast("decimal(28,0)") for start in (1, 16)]
        sums = [F.sum(part).cast("decimal(38,0)").alias(f"sum_{c}") for part, c in zip(parts, "ab")]
        return table.groupBy("document_id").agg(F.count("*").alias("rows"), *sums).select(
            "document_id", F.lit(name).alias("name"), "rows", "sum_a", "sum_b"
        )

    return _union([one(name, table) for name, table in tables.items()])


def composed_prints(*signed: tuple[int, DataFrame]) -> DataFrame:
    """``name, rows, sum_a, sum_b``: prints of documents or of tables, each added (1) or taken away (-1)."""
    def part(sign, prints):
        columns = {c: F.col(c).cast("decimal(38,0)") for c in ("rows", "sum_a", "sum_b")}
        return prints.select("name", *[(value if sign > 0 else -value).alias(c) for c, value in columns.items()])

    parts = [part(sign, prints) for sign, prints in signed]
    sums = [F.sum(c).cast("decimal(38,0)").alias(c) for c in ("rows", "sum_a", "sum_b")]
    return _union(parts).groupBy("name").agg(*sums).withColumn("rows", F.col("rows").cast("long"))


def print_rules(prints: DataFrame, again: DataFrame) -> DataFrame:
    """Documents whose stored prints are not those of their rows, compared by adding up what differs."""
    both = composed_by_document((1, prints), (-1, again))
    return count_rows("content_fingerprint", both.filter("rows <> 0 or sum_a <> 0 or sum_b <> 0"))


def composed_by_document(*signed) -> DataFrame:
    named = [(sign, p.withColumn("name", F.concat_ws("/", "document_id", "name"))) for sign, p in signed]
    return composed_prints(*named)


def catalog_rules(catalog: DataFrame, pointers: DataFrame) -> DataFrame:
    """Structure of a snapshot catalog: id format, uniqueness, digest, earlier base, both pointers."""
    last = catalog.agg(F.max_by("snapshot_id", "position")).scalar()
    current = pointers.select(F.col("current_snapshot_id").alias("snapshot_id"))
    unknown = current.filter(F.col("snapshot_id").isNotNull()).join(catalog, "snapshot_id", "left_anti")
    wrong_last = pointers.filter(~F.col("last_successful_snapshot_id").eqNullSafe(last))
    return _union(
        [
            _sum_up(
                catalog,
                {
                    "snapshot_id_format": ~_has_id("snapshot_id", "snapshot_id"),
                    "manifest_digest_format": ~_has_id("manifest_sha256", "sha256"),
                },
            ),
            count_rows("snapshot_repeated", catalog.groupBy("snapshot_id").count().filter("count > 1")),
            count_rows("base_not_earlier", lineage_faults(catalog)),
            count_rows("current_unknown", unknown),
            count_rows("last_successful_wrong", wrong_last),
        ]
    )

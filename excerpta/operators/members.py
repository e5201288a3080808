"""Snapshot membership as set algebra: apply changes, compare versions, check lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def apply_changes(base, *, removals=None, replacements=None, additions=None) -> DataFrame:
    """``base - removals - replaced + replacements + additions``, keyed by document_id.

    ``removals(document_id)``; ``replacements`` carries the new member rows plus
    ``replaced_document_id``; ``additions`` are member rows. See ``change_faults`` for the checks.
    """
    kept = base
    if removals is not None:
        kept = kept.join(removals.select("document_id").distinct(), "document_id", "left_anti")
    if replacements is not None:
        old = replacements.select(F.col("replaced_document_id").alias("document_id")).distinct()
        kept = kept.join(old, "document_id", "left_anti")
        kept = kept.unionByName(replacements.drop("replaced_document_id"))
    if additions is not None:
        kept = kept.unionByName(additions)
    return kept


def change_faults(base, removals, replacements, additions) -> DataFrame:
    """``(check, violations)``: every count must be zero before a change set may be published."""
    ids = base.select("document_id")
    gone = removals.select("document_id")
    old = replacements.select(F.col("replaced_document_id").alias("document_id"))
    new = replacements.select("document_id")
    added = additions.select("document_id")
    result = apply_changes(ids, removals=gone, replacements=replacements.select("document_id", "replaced_document_id"), additions=added)

    def count(name, frame):
        return frame.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")

    def repeated(frame):
        return frame.groupBy("document_id").count().filter("count > 1")

    checks = [
        count("removal_repeated", repeated(gone)),
        count("replacement_repeated", repeated(old)),
        count("removed_and_replaced", gone.join(old, "document_id", "left_semi")),
        count("target_not_in_base", gone.union(old).join(ids, "document_id", "left_anti")),
        count("addition_repeated", repeated(added)),
        count("result_collision", repeated(result)),
        result.agg(F.when(F.count("*") == 0, 1).otherwise(0).cast("long").alias("violations")).select(
            F.lit("empty_result").alias("check"), "violations"
        ),
    ]
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out


def difference(members: DataFrame, base: DataFrame, *keys: str) -> DataFrame:
    """``keys + (change, source_name, document_id, base_document_id)``.

    Ids on both sides are inherited. Among the rest, a source name that occurs exactly once on
    each side is a replacement; everything else is added or removed. Names are counted with
    map-side combine, and the join back meets at most one row per name.
    """
    keys = list(keys)
    both = members.select(*keys, "document_id", "source_name", F.lit(1).alias("_now")).unionByName(
        base.select(*keys, "document_id", "source_name", F.lit(0).alias("_now"))
    )
    by_id = both.groupBy(*keys, "document_id").agg(
        F.max("_now").alias("_in_now"), F.min("_now").alias("_min"),
        F.max_by("source_name", "_now").alias("source_name"),
    )
    state = by_id.withColumn(
        "_state", F.when(F.col("_in_now") == 0, "base").when(F.col("_min") == 1, "now").otherwise("both")
    ).select(*keys, "document_id", "source_name", "_state")
    inherited = state.filter("_state = 'both'").select(
        *keys, F.lit("inherited").alias("change"), "source_name", "document_id",
        F.col("document_id").alias("base_document_id"),
    )
    loose = state.filter("_state <> 'both'")
    names = (
        loose.groupBy(*keys, "source_name")
        .agg(
            F.count_if(F.col("_state") == "now").alias("_a"),
            F.count_if(F.col("_state") == "base").alias("_b"),
            F.max(F.when(F.col("_state") == "now", F.col("document_id"))).alias("_to"),
            F.max(F.when(F.col("_state") == "base", F.col("document_id"))).alias("_from"),
        )
        .filter("_a = 1 and _b = 1")
    )
    replaced = names.select(
        *keys, F.lit("replaced").alias("change"), "source_name", F.col("_to").alias("document_id"),
        F.col("_from").alias("base_document_id"),
    )
    rest = loose.join(names.select(*keys, "source_name"), [*keys, "source_name"], "left_anti").select(
        *keys,
        F.when(F.col("_state") == "now", "added").otherwise("removed").alias("change"),
        "source_name",
        F.when(F.col("_state") == "now", F.col("document_id")).alias("document_id"),
        F.when(F.col("_state") == "base", F.col("document_id")).alias("base_document_id"),
    )
    return inherited.unionByName(replaced).unionByName(rest)


def difference_counts(changes: DataFrame, *keys: str) -> DataFrame:
    def count(change):
        return F.count_if(F.col("change") == change).alias(change)

    columns = [count(c) for c in ("added", "inherited", "replaced", "removed")]
    return changes.groupBy(*keys).agg(*columns)


def lineage_faults(catalog: DataFrame, *keys: str) -> DataFrame:
    """Catalog rows ``(position, snapshot_id, base_snapshot_id)`` whose base is not an earlier row."""
    keys = list(keys)
    earlier = catalog.select(
        *keys, F.col("snapshot_id").alias("base_snapshot_id"), F.col("position").alias("_base_position")
    )
    return (
        catalog.filter(F.col("base_snapshot_id").isNotNull())
        .join(earlier, [*keys, "base_snapshot_id"], "left")
        .filter(F.col("_base_position").isNull() | (F.col("_base_position") >= F.col("position")))
        .select(*keys, "position", "snapshot_id", "base_snapshot_id")
    )


def snapshot_listing(catalog: DataFrame, pointers: DataFrame, *keys: str) -> DataFrame:
    """Newest first, with the flags of the two pointers."""
    keys = list(keys)
    newest = Window.partitionBy(*keys).orderBy(F.col("position").desc())
    if keys:
        joined = catalog.join(pointers, keys, "left")
    else:
        both = F.struct("current_snapshot_id", "last_successful_snapshot_id").alias("_p")
        joined = catalog.withColumn("_p", pointers.select(both).scalar()).select("*", "_p.*")
    return joined.select(
        *keys,
        F.row_number().over(newest).alias("listed"),
        "snapshot_id",
        "base_snapshot_id",
        F.coalesce(F.col("snapshot_id") == F.col("current_snapshot_id"), F.lit(False)).alias("current"),
        F.coalesce(F.col("snapshot_id") == F.col("last_successful_snapshot_id"), F.lit(False)).alias("last_successful"),
    )


def snapshot_labels(snapshots: DataFrame, *keys: str) -> DataFrame:
    """Readable label per snapshot id: minute; seconds if the minute is shared; then a suffix.

    The suffix is the shortest one, of at least 4 characters, that no other snapshot of the same
    second ends with. For ids sorted by their reversed text, the longest common suffix with any
    other id is reached at a neighbour, so two lags replace the comparison of all pairs.
    """
    parsed = snapshots.withColumn("_stamp", F.to_timestamp(F.substring("snapshot_id", 1, 15), "yyyyMMdd'T'HHmmss"))
    minute = Window.partitionBy(*keys, F.date_trunc("minute", "_stamp"))
    second = Window.partitionBy(*keys, "_stamp")
    backwards = second.orderBy("_reversed")

    def shared(other):
        width = F.length("snapshot_id")
        same = F.filter(
            F.sequence(F.lit(1), width),
            lambda n: F.substring("_reversed", F.lit(1), n) != F.substring(other, F.lit(1), n),
        )
        return F.when(other.isNull(), 0).otherwise(F.coalesce(F.array_min(same) - 1, width))

    counted = (
        parsed.withColumn("_reversed", F.reverse("snapshot_id"))
        .withColumn("_in_minute", F.count("*").over(minute))
        .withColumn("_in_second", F.count("*").over(second))
        .withColumn("_before", F.lag("_reversed").over(backwards))
        .withColumn("_after", F.lead("_reversed").over(backwards))
    )
    suffix_len = F.greatest(F.lit(4), shared(F.col("_before")) + 1, shared(F.col("_after")) + 1)
    label = F.concat(
        F.date_format("_stamp", "yyyy-MM-dd HH:mm"),
        F.when(F.col("_in_minute") > 1, F.date_format("_stamp", ":ss")).otherwise(""),
        F.when(F.col("_in_second") > 1, F.concat(F.lit(" · "), F.right("snapshot_id", suffix_len))).otherwise(""),
    )
    return counted.select(*keys, "snapshot_id", F.when(F.col("_stamp").isNull(), F.col("snapshot_id")).otherwise(label).alias("label"))

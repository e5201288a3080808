"""Deduplicated embedding, coverage reports and exact cosine recall."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from excerpta.errors import VectorError
from excerpta.functions import vectors as vec


def inputs(chunks: DataFrame, profile, *keep: str) -> DataFrame:
    """``keep + (chunk_id, vector_object_id, chunk_text)``."""
    return chunks.select(*keep, "chunk_id", vec.vector_object_id(profile, "chunk_text").alias("vector_object_id"), "chunk_text")


def missing_inputs(mapped: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Distinct inputs without a stored vector: what an embedder has to see, each once."""
    wanted = mapped
    if stored is not None:
        wanted = wanted.join(stored.select("vector_object_id").distinct(), "vector_object_id", "left_anti")
    return wanted.select("vector_object_id", "chunk_text").dropDuplicates(["vector_object_id"])


def embed_batches(missing: DataFrame, digits: int = 3, size: int = vec.BATCH_SIZE) -> DataFrame:
    """``(part, batch, inputs, input_chars, first_id)`` of the calls for ``missing`` inputs.

    Object ids are digests, so their first ``digits`` hex digits deal them evenly to parts that are numbered apart.
    """
    part = F.substring("vector_object_id", len("vec_") + 1, digits)
    placed = missing.select("vector_object_id", F.length("chunk_text").alias("_chars"), part.alias("part"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("vector_object_id")) - 1
    return (
        placed.withColumn("batch", F.floor(place / size))
        .groupBy("part", "batch")
        .agg(F.count("*").alias("inputs"), F.sum("_chars").alias("input_chars"), F.min("vector_object_id").alias("first_id"))
    )


def checked_embedder(embedder, profile):
    simulated = getattr(embedder, "simulated", None)
    if not callable(embedder) or type(simulated) is not bool or getattr(embedder, "offline", None) is not simulated:
        raise VectorError("embedder must state offline and simulated consistently")
    batch = getattr(embedder, "batch_size", None)
    if not simulated and (type(batch) is not int or not 1 <= batch <= vec.BATCH_SIZE):
        raise VectorError(f"a real embedder needs a batch size of 1-{vec.BATCH_SIZE}")
    if profile["provider"].casefold().startswith("offline-") is not simulated:
        raise VectorError("profile and embedder disagree about being simulated")
    return batch or 1000


def embed(missing: DataFrame, profile, embedder) -> DataFrame:
    """Embed in batches inside the tasks; any malformed output fails the whole job, nothing is retried by us."""
    batch_size = checked_embedder(embedder, profile)
    dimensions = profile["dimensions"]

    def run(frames):
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start:start + batch_size]
                answer = embedder(list(part["chunk_text"]), profile)
                sound = len(answer) == len(part) and all(
                    len(v) == dimensions and all(type(x) in (int, float) and math.isfinite(x) for x in v)
                    for v in answer
                )
                if not sound:
                    raise ValueError("embedder output has a wrong shape or a non-finite value")
                yield part[["vector_object_id", "chunk_text"]].assign(
                    payload=[np.asarray(v, dtype=">f8").tobytes() for v in answer]
                )

    embedded = missing.mapInPandas(run, "vector_object_id string, chunk_text string, payload binary")
    return embedded.select(
        "vector_object_id",
        F.sha2("chunk_text", 256).alias("input_sha256"),
        F.octet_length("chunk_text").cast("long").alias("input_byte_size"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.octet_length("payload").cast("long").alias("payload_byte_size"),
        "payload",
    )


def stats(mapped: DataFrame, stored, dimensions: int, *keys: str) -> DataFrame:
    """References, unique inputs, new and reused objects and their bytes.

    Two-step distinct: references are counted per input first (map-side combined), so a text that
    fills a third of the table is one row by the time groups are formed.
    """
    per_input = mapped.groupBy(*keys, "vector_object_id").agg(F.count("*").alias("_refs"))
    if stored is None:
        flagged = per_input.withColumn("_new", F.lit(1))
    else:
        known = stored.select("vector_object_id").distinct().withColumn("_known", F.lit(1))
        flagged = per_input.join(known, "vector_object_id", "left").withColumn(
            "_new", F.when(F.col("_known").isNull(), 1).otherwise(0)
        )
    width = dimensions * 8
    base = flagged.groupBy(*keys).agg(
        F.sum("_refs").alias("vector_references"),
        F.count("*").alias("unique_inputs"),
        F.sum("_new").cast("long").alias("new_objects"),
    )
    return base.select(
        *keys,
        "vector_references",
        "unique_inputs",
        "new_objects",
        (F.col("unique_inputs") - F.col("new_objects")).alias("reused_objects"),
        (F.col("vector_references") * width).alias("referenced_vector_bytes"),
        (F.col("unique_inputs") * width).alias("unique_vector_bytes"),
        (F.col("new_objects") * width).alias("new_object_bytes"),
        ((F.col("unique_inputs") - F.col("new_objects")) * width).alias("reused_object_bytes"),
        ((F.col("vector_references") - F.col("unique_inputs")) * width).alias("deduplicated_vector_bytes"),
    )


def preview(mapped: DataFrame, stored, *keys: str, batch_size: int = vec.BATCH_SIZE) -> DataFrame:
    """What a build would send: new and reused inputs, characters, planned calls."""
    per_input = mapped.groupBy(*keys, "vector_object_id").agg(F.max(F.length("chunk_text")).alias("_chars"))
    if stored is None:
        flagged = per_input.withColumn("_known", F.lit(None).cast("int"))
    else:
        known = stored.select("vector_object_id").distinct().withColumn("_known", F.lit(1))
        flagged = per_input.join(known, "vector_object_id", "left")
    new = F.col("_known").isNull()
    counts = flagged.groupBy(*keys).agg(
        F.count_if(new).alias("new_inputs"),
        F.count_if(~new).alias("reused_inputs"),
        F.coalesce(F.sum(F.when(new, F.col("_chars"))), F.lit(0)).cast("long").alias("new_input_chars"),
    )
    return counts.withColumn("planned_calls", F.ceil(F.col("new_inputs") / batch_size).cast("long"))


def document_coverage(chunks: DataFrame, stored: DataFrame, profile, others=()) -> DataFrame:
    """Per document: covered and total chunks and ready / mismatch / missing.

    ``stored(profile_id, vector_object_id)``; ``others`` are further profiles that may have vectors.
    """
    chosen = vec.profile_id(profile)
    wanted = chunks.select(
        "document_id",
        "chunk_id",
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(vec.profile_id(p)).alias("profile_id"),
                        vec.vector_object_id(p, "chunk_text").alias("vector_object_id"),
                    )
                    for p in (profile, *others)
                )
            )
        ).alias("_w"),
    ).select("document_id", "chunk_id", "_w.*")
    # Combine equal inputs of a document before the join: copies of one text travel as one row.
    packed = wanted.groupBy("document_id", "profile_id", "vector_object_id").agg(F.count("*").alias("_chunks"))
    have = stored.select("profile_id", "vector_object_id").distinct().withColumn("_have", F.lit(True))
    joined = packed.join(have, ["profile_id", "vector_object_id"], "left")
    mine = F.col("profile_id") == chosen
    summed = joined.groupBy("document_id").agg(
        F.coalesce(F.sum(F.when(mine & F.col("_have"), F.col("_chunks"))), F.lit(0)).alias("vector_covered_chunks"),
        F.sum(F.when(mine, F.col("_chunks"))).alias("vector_total_chunks"),
        F.max(F.coalesce(F.col("_have") & ~mine, F.lit(False))).alias("_other"),
    )
    status = (
        F.when(F.col("vector_covered_chunks") == F.col("vector_total_chunks"), "ready")
        .when(F.col("_other"), "mismatch")
        .otherwise("missing")
    )
    return summed.select("document_id", status.alias("vector_status"), "vector_covered_chunks", "vector_total_chunks")


def snapshot_readiness(snapshots: DataFrame, artifacts: DataFrame, profile_id: str, running=None) -> DataFrame:
    """Per snapshot: ready / mismatch / missing, overlaid with builds in progress.

    ``artifacts(snapshot_id, profile_id)``; ``running(snapshot_id, profile_id, operation)``.
    """
    have = artifacts.groupBy("snapshot_id").agg(F.max(F.col("profile_id") == profile_id).alias("_mine"))
    state = snapshots.join(have, "snapshot_id", "left").select(
        "snapshot_id",
        F.when(F.col("_mine"), "ready").when(F.col("_mine").isNotNull(), "mismatch").otherwise("missing").alias("vector_status"),
    )
    if running is None:
        return state
    now = running.filter(F.col("profile_id") == profile_id).groupBy("snapshot_id").agg(F.max("operation").alias("_now"))
    overlay = F.col("_now").isNotNull() & ((F.col("_now") == "preparing") | (F.col("vector_status") != "ready"))
    return state.join(now, "snapshot_id", "left").select(
        "snapshot_id", F.when(overlay, F.col("_now")).otherwise(F.col("vector_status")).alias("vector_status")
    )


def set_differences(left: DataFrame, right: DataFrame, *keys: str, buckets=4096) -> DataFrame:
    """``keys, n_left, n_right`` of the keys that do not occur equally often on both sides.

    Keys are dealt to buckets by hash, and each bucket is reconciled by the difference of its counts and of two sums of
    hashes, one small row per bucket and task. Only keys of buckets that differ, few where the sides nearly agree, are
    shuffled and compared one by one.
    """
    side = lambda df, n: df.select(*keys, F.lit(n).alias("_side"))
    both = side(left, 1).unionByName(side(right, -1)).withColumn("_bucket", F.expr(f"pmod(hash({', '.join(keys)}), {buckets})"))
    hashed = lambda seed: F.sum(F.col("_side") * F.xxhash64(F.lit(seed), *keys).cast("decimal(28,0)"))
    sums = both.groupBy("_bucket").agg(F.sum("_side").alias("_n"), hashed(1).alias("_a"), hashed(2).alias("_b"))
    unequal = sums.filter("_n <> 0 or _a <> 0 or _b <> 0").select("_bucket")
    near = both.join(F.broadcast(unequal), "_bucket", "left_semi")  # at most ``buckets`` rows
    counted = near.groupBy(*keys).agg(F.count_if(F.col("_side") > 0).alias("n_left"), F.count_if(F.col("_side") < 0).alias("n_right"))
    return counted.filter("n_left <> n_right")


def mapping_faults(chunks: DataFrame, mapping: DataFrame, stored: DataFrame) -> DataFrame:
    """``(check, violations)``: the mapping must cover exactly the snapshot's chunks, and its objects must be sound.

    Chunks and mapping are reconciled as sets; ids and objects meet in one aggregation with map-side combining.
    """

    def tally(frame, **counts):
        totals = frame.agg(*(F.coalesce(F.sum(value), F.lit(0)).cast("long").alias(name) for name, value in counts.items()))
        return totals.unpivot([], list(counts), "check", "violations")

    left, right = F.col("n_left"), F.col("n_right")
    sets = tally(
        set_differences(chunks, mapping, "chunk_id"),
        chunk_without_vector=F.when(right == 0, 1),
        vector_without_chunk=F.when(left == 0, right),
        chunk_mapped_twice=F.when(right > 1, 1),
    )
    changed = (F.sha2("payload", 256) != F.col("payload_sha256")) | (F.octet_length("payload") != F.col("payload_byte_size"))
    none = F.lit(0).cast("long")
    used = mapping.select("vector_object_id", F.lit(1).cast("long").alias("used"), none.alias("held"), none.alias("changed"))
    held = stored.select("vector_object_id", none.alias("used"), F.lit(1).cast("long").alias("held"), changed.cast("long").alias("changed"))
    met = used.unionByName(held).groupBy("vector_object_id").agg(*[F.sum(c).alias(c) for c in ("used", "held", "changed")])
    return sets.unionByName(
        tally(met, mapping_without_object=F.when(F.col("held") == 0, F.col("used")), object_payload_changed=F.col("changed"))
    )


ARTIFACT = "artifact_id string, part string, files long, bytes long"


def artifact_files(spark, folders) -> DataFrame | None:
    """``path, length`` of the Parquet files below ``folders``: a listing, no file is opened."""
    if not folders:
        return None
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return files.load(folders).select("path", "length")


def stored_artifacts(files: DataFrame) -> DataFrame:
    """Files and bytes of each part of each artifact, by the path ``.../<part>/artifact=<id>/...``."""
    part, artifact = (F.regexp_extract("path", r"([^/]+)/artifact=([^/]+)/", n) for n in (1, 2))
    return files.groupBy(artifact.alias("artifact_id"), part.alias("part")).agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes")
    )


def artifact_states(cataloged: DataFrame, stored: DataFrame) -> DataFrame:
    """``artifact_id, part, state`` from both sides: what the catalog says and what lies in the folders."""
    said = cataloged.select("artifact_id", "part", F.struct("files", "bytes").alias("_said"))
    found = stored.select("artifact_id", "part", F.struct("files", "bytes").alias("_found"))
    state = (
        F.when(F.col("_found").isNull(), "missing").when(F.col("_said").isNull(), "unlisted")
        .when(F.col("_said") == F.col("_found"), "present").otherwise("altered")
    )
    return said.join(found, ["artifact_id", "part"], "full_outer").select("artifact_id", "part", state.alias("state"))


def nearest(vectors: DataFrame, query: DataFrame, k: int, *, key: str, vector: str, query_vector: str, groups=()) -> DataFrame:
    """Exact cosine top ``k`` by (-score, key) for the one vector in ``query``.

    The query is a scalar; every stored vector is read once, and only the best ``k`` of each task
    leave it.
    """
    unit = query.limit(1).select(vec.scaled_unit(F.col(query_vector).cast("array<double>")).alias("_unit")).scalar()
    scored = vectors.withColumn("_unit", unit).select(
        *groups, key, vec.cosine(F.col("_unit"), F.col(vector).cast("array<double>")).alias("score")
    )
    if groups:
        window = Window.partitionBy(*groups).orderBy(F.desc("score"), key)
        return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
    return scored.orderBy(F.desc("score"), key).limit(k)

"""Candidate budget and rerank join of the three-step search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# --- fixed values -----------------------------------------------------------------------------
MAX_CANDIDATES = 10
MAX_CANDIDATE_CHARS = 600
MAX_TOTAL_CHARS = 4000
# ----------------------------------------------------------------------------------------------


def candidates(
    ranked: DataFrame, *keys: str, per_item=MAX_CANDIDATE_CHARS, total=MAX_TOTAL_CHARS, limit=MAX_CANDIDATES
) -> DataFrame:
    """Leading text of the best rows, within the per-item and total budgets, in rank order.

    ``ranked(rank, chunk_id, score, chunk_text)``. Rows beyond ``limit`` are cut before the window,
    so each window sees at most ``limit`` rows per key.
    """
    window = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    size = F.least(F.length("chunk_text"), F.lit(per_item)).cast("long")
    left = F.lit(total) - F.coalesce(F.sum(size).over(window), F.lit(0))
    return (
        ranked.filter(F.col("rank") <= limit)
        .withColumn("candidate_chars", F.greatest(F.lit(0).cast("long"), F.least(size, left)))
        .filter(F.col("candidate_chars") > 0)
        .withColumn("candidate_text", F.expr("substring(chunk_text, 1, cast(candidate_chars as int))"))
    )


def apply_rerank(found: DataFrame, answers: DataFrame, top_k: int, *keys: str) -> DataFrame:
    """Keep the candidates the reranker returned, best first; the cosine stays as ``vector_score``."""
    window = Window.partitionBy(*keys).orderBy(F.desc("rerank_score"), "chunk_id")
    return (
        found.withColumnRenamed("score", "vector_score")
        .join(answers, [*keys, "chunk_id"])
        .withColumn("position", F.row_number().over(window))
        .filter(F.col("position") <= top_k)
        .withColumnRenamed("rerank_score", "score")
    )


def by_index(answers: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """Answers that name candidates by their place in the request, as ``keys + (chunk_id, rerank_score, fault)``.

    ``answers(keys, index, rerank_score)``, ``index`` from 0 in rank order. ``fault`` is ``no_candidate`` for an index
    nothing was sent under, ``repeated`` for one that occurs again, else null; the first kind has no chunk_id.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("rank")) - 1
    sent = found.select(*keys, "chunk_id", place.alias("index"))
    times = answers.groupBy(*keys, "index").agg(F.count("*").alias("_times"))
    named = answers.join(times, [*keys, "index"]).join(sent, [*keys, "index"], "left")
    fault = F.when(F.col("chunk_id").isNull(), "no_candidate").when(F.col("_times") > 1, "repeated")
    return named.select(*keys, "index", "chunk_id", "rerank_score", fault.alias("fault"))


def rerank_faults(answers: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """``(check, violations)`` for a reranker's answer: foreign or repeated ids, unusable scores."""

    def count(name, frame):
        return frame.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")

    ids = [*keys, "chunk_id"]
    bad = F.col("rerank_score").isNull() | F.isnan("rerank_score") | (F.abs("rerank_score") == F.lit(float("inf")))
    return (
        count("foreign_chunk", answers.join(found, ids, "left_anti"))
        .unionByName(count("repeated_chunk", answers.groupBy(*ids).count().filter("count > 1")))
        .unionByName(count("score_not_finite", answers.filter(bad)))
    )

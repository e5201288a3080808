"""Retrieval-quality cases and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from excerpta.functions import text as tx
from excerpta.session import settle, small_side

WORDLESS_BLOCK = 1000

LIMITED = "observational_known_limitation"


def ratio(numerator, denominator) -> Column:
    """Rounded to six places; an empty denominator counts as 1."""
    return F.when(denominator == 0, 1.0).otherwise(F.round(numerator / denominator, 6))


def judge(cases: DataFrame, results: DataFrame, owners: DataFrame) -> DataFrame:
    """One judged row per case.

    ``cases(case_id, mode, library_id, snapshot_id, expected_document_id, target_chunk_id,
    known_limitation, traced)``; ``results(case_id, rank, document_id, chunk_id, anchor_label)``;
    ``owners(library_id, snapshot_id, document_id)``. Results per case are at most the top k.
    """
    mine = results.join(cases.select("case_id", "library_id", "snapshot_id", "expected_document_id", "target_chunk_id"), "case_id")
    by_snapshot = owners.select("library_id", "snapshot_id", "document_id").distinct().withColumn("_in_snapshot", F.lit(1))
    by_library = owners.select("library_id", "document_id").distinct().withColumn("_in_library", F.lit(1))
    looked_up = mine.join(by_snapshot, ["library_id", "snapshot_id", "document_id"], "left").join(
        by_library, ["library_id", "document_id"], "left"
    )
    seen = looked_up.groupBy("case_id").agg(
        F.count("*").alias("returned"),
        F.min(F.when(F.col("document_id") == F.col("expected_document_id"), F.col("rank"))).alias("first_expected_rank"),
        F.count_if(F.col("_in_library").isNull()).alias("library_isolation_violations"),
        F.count_if(F.col("_in_snapshot").isNull()).alias("snapshot_isolation_violations"),
        F.max(F.col("chunk_id") == F.col("target_chunk_id")).alias("_target_seen"),
    )
    joined = cases.join(seen, "case_id", "left").na.fill(
        0, ["returned", "library_isolation_violations", "snapshot_isolation_violations"]
    )
    empty = F.col("expected_document_id").isNull()
    isolated = (F.col("library_isolation_violations") == 0) & (F.col("snapshot_isolation_violations") == 0)
    limited = (F.col("mode") == "bm25") & F.col("known_limitation")
    behaves = (
        F.when(empty, F.col("returned") == 0).when(limited, True).otherwise(F.col("first_expected_rank").isNotNull())
    )
    traced = F.when(F.col("traced"), F.coalesce("_target_seen", F.lit(False)))
    return joined.select(
        "case_id",
        "mode",
        empty.alias("expects_empty"),
        "returned",
        "first_expected_rank",
        "library_isolation_violations",
        "snapshot_isolation_violations",
        F.when(empty, "true_empty").when(limited, LIMITED).otherwise("expected_document_hit").alias("acceptance"),
        traced.alias("traceability_pass"),
        (F.col("first_expected_rank").isNotNull() & isolated).alias("metric_hit"),
        (behaves & isolated & F.coalesce(traced, F.lit(True))).alias("case_pass"),
    )


def metrics(judged: DataFrame, *keys: str) -> DataFrame:
    """Hit@k, recall@k, MRR, mean first rank, true-empty accuracy, isolation and trace coverage."""
    positive = ~F.col("expects_empty")
    hit = positive & F.col("metric_hit")
    applicable = positive & (F.col("acceptance") != LIMITED)
    counts = judged.groupBy(*keys, "mode").agg(
        F.count("*").alias("case_count"),
        F.count_if(positive).alias("positive_case_count"),
        F.count_if(hit).alias("_hits"),
        F.coalesce(F.sum(F.when(hit, 1.0 / F.col("first_expected_rank"))), F.lit(0.0)).alias("_reciprocal"),
        F.avg(F.when(hit, F.col("first_expected_rank"))).alias("_mean"),
        F.count_if(applicable).alias("_applicable"),
        F.count_if(applicable & F.col("metric_hit")).alias("_applicable_hits"),
        F.count_if(~positive).alias("_negatives"),
        F.count_if(~positive & (F.col("returned") == 0)).alias("_empties"),
        F.sum("library_isolation_violations").alias("library_isolation_violations"),
        F.sum("snapshot_isolation_violations").alias("snapshot_isolation_violations"),
        F.count_if(F.col("traceability_pass").isNotNull()).alias("_traced"),
        F.count_if(F.coalesce("traceability_pass", F.lit(False))).alias("_trace_ok"),
        F.count_if("case_pass").alias("contract_passed_case_count"),
    )
    return counts.select(
        *keys,
        "mode",
        "case_count",
        "positive_case_count",
        ratio(F.col("_hits"), F.col("positive_case_count")).alias("positive_hit_at_k"),
        ratio(F.col("_hits"), F.col("positive_case_count")).alias("positive_recall_at_k"),
        ratio(F.col("_reciprocal"), F.col("positive_case_count")).alias("mrr"),
        F.round("_mean", 6).alias("first_hit_rank_mean"),
        ratio(F.col("_applicable_hits"), F.col("_applicable")).alias("applicable_positive_hit_at_k"),
        ratio(F.col("_empties"), F.col("_negatives")).alias("true_empty_accuracy"),
        "library_isolation_violations",
        "snapshot_isolation_violations",
        ratio(F.col("_trace_ok"), F.col("_traced")).alias("traceability_coverage"),
        "contract_passed_case_count",
    )


def scoped_targets(cases: DataFrame, chunks: DataFrame, *keys: str) -> DataFrame:
    """Per case the smallest chunk of its expected document that contains the marker.

    ``cases(case_id, document_id, marker)``; the join is on the document, so each case only meets
    the chunks of one file.
    """
    joined = cases.join(chunks.select(*keys, "document_id", "chunk_id", "chunk_text"), [*keys, "document_id"])
    hits = joined.filter(F.col("chunk_text").contains(F.col("marker")))
    return hits.groupBy("case_id").agg(F.min("chunk_id").alias("target_chunk_id"))


def find_markers(items: DataFrame, docs: DataFrame, *, item: str, marker: str, key: str, text: str, postings=None) -> DataFrame:
    """``(item, key)``: the smallest ``key`` whose text contains the item's marker.

    A text that contains the marker also contains each inner word of it, so candidates come from an equi-join on the
    marker's rarest inner word, and only they are compared. A marker of one or two words may begin and end inside words of
    the text: its longest word is looked for among the parts of that length of every distinct word. The few markers
    without a word are compared with each text as it is read; an empty or null marker names nothing. ``postings`` (key, term), if given, hold all rows of the
    markers' words; else the texts are tokenised.
    """
    words = items.select(item, tx.index_tokens(marker).alias("_w"))
    inner = words.filter(F.size("_w") > 2).select(
        item, F.explode(F.array_distinct(F.slice("_w", F.lit(2), F.size("_w") - 2))).alias("term")
    )
    vocabulary = docs.select(key, F.explode_outer(F.array_distinct(tx.index_tokens(text))).alias("term"))
    vocabulary = vocabulary.filter(F.col("term").isNotNull())
    short = words.filter(F.size("_w").between(1, 2)).select(
        item, F.array_max(F.transform("_w", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"].alias("part")
    )
    # Lengths of short markers' words: at most as many numbers as a query has characters.
    sizes = [row[0] for row in short.select(F.length("part")).distinct().collect()]
    if sizes:
        places = lambda n: F.transform(F.sequence(F.lit(1), F.length("term") - n + 1), lambda at: F.substring("term", at, F.lit(n)))
        parts = F.flatten(F.array(*[F.when(F.length("term") >= n, places(n)).otherwise(F.array()) for n in sizes]))
        terms = vocabulary.select("term").distinct().select("term", F.explode(F.array_distinct(parts)).alias("part"))
        several = short.join(terms, "part").select(item, "term")
    else:
        several = inner.limit(0)
    wanted = settle(inner.unionByName(several).select("term").distinct(), "marker-terms")
    source = vocabulary if postings is None or sizes else postings.select(key, "term").distinct()
    postings = settle(source.join(small_side(wanted), "term", "left_semi"), "marker-postings")
    frequency = postings.groupBy("term").agg(F.count("*").alias("_df"))
    rarest = inner.join(frequency, "term").groupBy(item).agg(F.min_by("term", F.struct("_df", "term")).alias("term"))
    candidates = settle(rarest.unionByName(several).join(postings, "term").select(item, key).distinct(), "marker-candidates")
    met = docs.select(key, text).join(small_side(candidates), key).join(items.select(item, marker), item)
    met = met.filter(F.col(text).contains(F.col(marker))).select(item, key)
    wordless = words.filter(F.size("_w") == 0).select(item).join(items.select(item, marker), item).filter(F.col(marker) != "")
    wordless = settle(wordless.groupBy(marker).agg(F.collect_set(item).alias("_items")), "wordless")
    blocks = -(-wordless.count() // WORDLESS_BLOCK)
    for block in range(blocks):
        own = wordless.filter(F.expr(f"pmod(hash({marker}), {blocks}) = {block}")).agg(F.collect_list(F.struct(marker, "_items"))).scalar()
        named = docs.select(key, text).withColumn("_m", own)
        found = named.select(key, F.explode(F.filter("_m", lambda m: F.col(text).contains(m[marker]))).alias("_m"))
        met = met.unionByName(found.select(F.explode("_m._items").alias(item), key))
    return met.groupBy(item).agg(F.min(key).alias(key))

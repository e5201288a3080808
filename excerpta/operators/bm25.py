"""Exact BM25 with phrase support over a corpus, by scanning text or from stored postings.

Scores are negative and lower is better: ``-sum(idf * f * (k1+1) / (f + k1 * (1 - b + b*dl/avgdl)))``
over the query's phrases, with ``idf = ln((N - n + 0.5) / (n + 0.5))`` floored at 1e-6. ``N``, ``n``
and ``avgdl`` always describe the whole corpus (per library and snapshot), whatever is filtered later.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from excerpta.functions import query as q, text as tx
from excerpta.session import is_small, small_side

# --- fixed values -----------------------------------------------------------------------------
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6
MAX_TOP_K = 10
WORDS_PER_TASK = 1 << 19
# ----------------------------------------------------------------------------------------------


def idf(total, matching) -> Column:
    ratio = (total - matching + F.lit(0.5)) / (matching + F.lit(0.5))
    return F.greatest(F.log(ratio), F.lit(IDF_FLOOR))


def contribution(frequency, length, average, weight) -> Column:
    norm = frequency + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / average)
    return weight * (frequency * F.lit(K1 + 1) / norm)


def score_scan(corpus: DataFrame, query: str, *, key: str, text: str, groups=()) -> DataFrame:
    """Score every row of ``corpus`` that matches one query, reading the text exactly once.

    Rows without a match collapse to one row per task and group in the map-side aggregation, so
    only the hits (key, length, phrase counts) are shuffled, spread by key. That one shuffle feeds
    both the corpus statistics and the scores. ``groups`` are the columns that delimit a corpus.
    Returns ``groups + [key, score]``.
    """
    groups = list(groups)
    phrases = q.phrases(query)
    if not phrases:
        return corpus.select(*groups, key, F.lit(0.0).alias("score")).filter(F.lit(False))
    names = [f"_f{i}" for i in range(len(phrases))]
    distinct = {tuple(phrase): f"_d{i}" for i, phrase in enumerate(phrases)}

    folded = corpus.select(*groups, key, tx.fold(text).alias("_folded"))
    counted = folded.select(
        *groups,
        key,
        tx.count_tokens(F.col("_folded")).alias("_len"),
        *(tx.count_phrase(F.col("_folded"), phrase).alias(name) for phrase, name in distinct.items()),
    )
    hit = reduce(or_, (F.col(name) > 0 for name in distinct.values()))
    merged = counted.groupBy(*groups, F.when(hit, F.col(key)).alias("_key")).agg(
        F.count("*").alias("_rows"),
        F.sum("_len").alias("_len"),
        *(F.max(name).alias(name) for name in distinct.values()),
    )
    # A row is a hit when some count is positive; testing the aggregates (not the key) keeps the
    # test above the shuffle, so both readers below share the same exchange.
    matched = reduce(or_, (F.col(name) > 0 for name in distinct.values()))
    stats = merged.groupBy(*groups).agg(
        F.sum("_rows").alias("_total"),
        (F.sum("_len") / F.sum("_rows")).alias("_average"),
        *(F.sum(F.when(F.col(name) > 0, 1).otherwise(0)).alias(f"_n{name}") for name in distinct.values()),
    )
    hits = merged.filter(matched & (F.col("_rows") > 0))
    total = reduce(
        lambda left, right: left + right,
        (
            contribution(
                F.col(distinct[tuple(phrase)]),
                F.col("_len"),
                F.col("_s._average"),
                idf(F.col("_s._total"), F.col(f"_s._n{distinct[tuple(phrase)]}")),
            )
            for phrase in phrases
        ),
    )
    return with_stats(hits, stats, groups).select(*groups, F.col("_key").alias(key), (-total).alias("score"))


def with_stats(rows: DataFrame, stats: DataFrame, groups) -> DataFrame:
    """Attach corpus statistics as struct ``_s``: a scalar for one corpus, an equi-join for several."""
    packed = F.struct(*(name for name in stats.columns if name not in groups)).alias("_s")
    if groups:
        return rows.join(stats.select(*groups, packed), list(groups))
    return rows.withColumn("_s", stats.select(packed).scalar())


def top_k(scored: DataFrame, k: int, *, key: str, groups=()) -> DataFrame:
    """Best ``k`` by (score, key); per group where groups are given."""
    if not groups:
        return scored.orderBy("score", key).limit(k)
    window = Window.partitionBy(*groups).orderBy("score", key)
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


# --- stored postings --------------------------------------------------------------------------


def postings(corpus: DataFrame, *, key: str, text: str, groups=()) -> DataFrame:
    """One row per word occurrence: ``groups + [key, length, position, term]``; a narrow projection.

    ``length`` is the row's own word count, so scoring a hit needs no join back to its row.
    """
    words = corpus.select(*groups, key, tx.index_tokens(text).alias("_w"))
    # Outer, then filtered: a plain posexplode makes the optimizer tokenize again in an inferred filter.
    rows = words.select(*groups, key, F.size("_w").alias("length"), F.posexplode_outer("_w").alias("position", "term"))
    return rows.filter(F.col("term").isNotNull())


def lengths(corpus: DataFrame, *, key: str, text: str, groups=()) -> DataFrame:
    return corpus.select(*groups, key, tx.count_tokens(tx.fold(text)).alias("length"))


def corpus_stats(lens: DataFrame, *, groups=()) -> DataFrame:
    return lens.groupBy(*groups).agg(F.count("*").alias("rows"), F.sum("length").alias("tokens"))


def tasks_for(rows: DataFrame, words: int) -> int:
    """Tasks over which ``words`` word occurrences of ``rows`` are dealt: as many as cores, and more as the words grow, so
    that what one task holds does not."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-words // WORDS_PER_TASK))


def deal(rows: DataFrame, tasks: int, *, key: str, groups=()) -> DataFrame:
    """``rows``, texts or postings, with all of one key in one task: what is counted per key then needs no more shuffles."""
    return rows.repartition(tasks, *groups, key)


def score_postings(
    posts: DataFrame, stats: DataFrame, words: DataFrame, *, key: str, query_id: str = "query_id", groups=()
) -> DataFrame:
    """Score a whole table of queries: ``groups + [query_id, key, score]``.

    Postings that are dealt by key (``deal``) are counted, voted and summed where they lie; others meet by row first, and
    what their tasks hold before that grows with the tasks' files.

    ``words`` comes from ``query_words``. Single words are counted per row and term before they meet
    the queries, so a word many queries share is counted once. In a phrase, a posting that could be
    word ``offset`` votes for the start ``position - offset``; a start with all its words is an
    occurrence. Everything is keyed by row, never by term alone, so a frequent word does not make a
    hot partition. Query words and their weights are broadcast only after a size check.
    """
    groups = list(groups)
    row = [*groups, key, "length"]
    single = words.filter(F.col("words") == 1).select(query_id, "phrase", "term")
    terms = small_side(single.select("term").distinct())
    frequency = posts.join(terms, "term").groupBy(*row, "term").agg(F.count("*").alias("_f"))
    # Counting on ``_f`` keeps this branch's columns equal to the scoring branch: both read one shuffle.
    matching = frequency.groupBy(*groups, "term").agg(F.count_if(F.col("_f") > 0).alias("_n"))
    weights = _weights(single.join(matching, "term"), stats, groups, query_id, "term")
    if not groups and is_small(single):
        # One row per query word, which was just counted.
        weights = F.broadcast(weights)
    parts = _parts(frequency.join(weights, [*groups, "term"]), groups, key, query_id)

    several = words.filter(F.col("words") > 1)
    if not several.isEmpty():
        by = [*row, query_id, "phrase"]
        votes = posts.join(small_side(several), "term").withColumn("_start", F.col("position") - F.col("offset"))
        found = votes.groupBy(*by, "words", "_start").count().filter(F.col("count") == F.col("words"))
        counts = found.groupBy(*by).agg(F.count("*").alias("_f"))
        matching = counts.groupBy(*groups, query_id, "phrase").agg(F.count_if(F.col("_f") > 0).alias("_n"))
        weights = _weights(matching, stats, groups, query_id)
        parts = parts.unionByName(
            _parts(counts.join(weights, [*groups, query_id, "phrase"]), groups, key, query_id)
        )
    # A decimal sum does not depend on the order of its parts, so equal rows tie exactly, and it
    # combines map-side. 24 places keep parts of the floored idf (1e-6) to full double precision.
    exact = F.sum(F.col("_part").cast("decimal(38,24)")).cast("double")
    return parts.groupBy(*groups, query_id, key).agg((-exact).alias("score"))


def _weights(matching: DataFrame, stats: DataFrame, groups, query_id, *keep) -> DataFrame:
    """Inverse document frequency and average length per query phrase."""
    return with_stats(matching, stats, groups).select(
        *groups,
        query_id,
        "phrase",
        *keep,
        (F.col("_s.tokens") / F.col("_s.rows")).alias("_average"),
        idf(F.col("_s.rows"), F.col("_n")).alias("_idf"),
    )


def _parts(weighted: DataFrame, groups, key, query_id) -> DataFrame:
    part = contribution(F.col("_f"), F.col("length"), F.col("_average"), F.col("_idf"))
    return weighted.select(*groups, key, query_id, "phrase", part.alias("_part"))

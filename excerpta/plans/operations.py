"""Stored-postings search and the operators on log lines, provider answers and metrics, over the driver's tables.

``events`` carry the log: each event becomes a log line, a provider answer and a metric sample by fixed rules on its
type, its value and the number in ``props``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from excerpta.functions import classify, query as q
from excerpta.operators import audit, bm25
from excerpta.plans import inputs as io
from excerpta.plans.search import OR_QUERY, PHRASE_QUERY, _documents_sql
from excerpta.session import settle
from excerpta.sources import metrics


def _stored(query):
    def run(spark, sf):
        """Postings are written once, sorted by word; a search reads the row groups of its words.

        Words are dealt by hash and their partitions cut at Spark's advisory size, so a frequent word lies in many files and
        no pass looks for ranges first. Both statistics are counts of rows: of documents, and of their postings.
        """
        docs = io.table(spark, sf, "documents").select("doc_id", "text")
        posts = bm25.postings(docs, key="doc_id", text="text")
        stored = settle(posts.hint("rebalance", F.col("term")).sortWithinPartitions("term"), "postings")
        stats = spark.createDataFrame([(docs.count(), stored.count())], "rows long, tokens long")
        phrases = q.phrases(query)
        words = spark.createDataFrame(
            [(0, i, offset, len(p), word) for i, p in enumerate(phrases) for offset, word in enumerate(p)],
            "query_id int, phrase int, offset int, words int, term string",
        )
        wanted = stored.filter(F.col("term").isin(sorted({word for phrase in phrases for word in phrase})))
        wanted = bm25.deal(wanted, bm25.tasks_for(wanted, wanted.count()), key="doc_id")
        scored = bm25.score_postings(wanted, stats, words, key="doc_id").withColumn("score", F.round("score", 9))
        return bm25.top_k(scored, 10, key="doc_id").select("doc_id", F.round("score", 6).alias("score"))

    return run


def _events(spark, sf):
    number = F.get_json_object("props", "$.k").cast("long")
    return io.table(spark, sf, "events").select("event_id", "event_type", "user_id", "value", number.alias("k"))


def log_states(spark, sf):
    """Log lines by event type and what they say about the connection; ``none`` where they say nothing."""
    k = F.col("k")
    line = F.to_json(
        F.struct(
            F.when(k % 10 == 0, 401).when(k % 10 == 1, 403).otherwise(200).alias("status_code"),
            F.when(k % 10 == 2, "invalid_api_key").alias("error_code"),
            F.when(k % 10 == 3, "poll failed; backing off")
            .when(k % 10 == 4, "poller recovered; polling operational")
            .when(k % 10 == 5, "health server error")
            .otherwise("served")
            .alias("msg"),
            F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        )
    )
    lines = _events(spark, sf).select("event_type", F.when(k == 99, F.lit("no json")).otherwise(line).alias("line"))
    coded = lines.select("event_type", F.coalesce(classify.log_code("line"), F.lit("none")).alias("code"))
    return coded.groupBy("event_type", "code").agg(F.count("*").alias("lines"))


def provider_codes(spark, sf):
    """Failed model calls by reason: the status comes from the event's number, the calls from its user."""
    k = F.col("k")
    status = F.when(k % 8 < 6, F.element_at(F.array(*map(F.lit, (401, 403, 429, 400, 404, 503))), (k % 8 + 1).cast("int")))
    calls = _events(spark, sf).select(status.alias("status"), (F.col("user_id") % 3).alias("calls"))
    return calls.select(classify.provider_code("status", "calls").alias("code")).groupBy("code").agg(F.count("*").alias("calls"))


def usage_sums(spark, sf):
    """Token usage summed by event type; negative, fractional and textual counts are left out."""
    k = F.col("k")
    body = F.concat(
        F.lit('{"usage":{"prompt_tokens":'), k, F.lit(',"completion_tokens":'), F.when(k % 5 == 0, -k).otherwise(2 * k),
        F.lit(',"total_tokens":'), F.when(k % 3 == 0, F.concat(k, F.lit(".5"))).otherwise((3 * k).cast("string")), F.lit("}}"),
    )
    used = _events(spark, sf).select("event_type", classify.usage(body).alias("u"))
    total = lambda name: F.coalesce(F.sum(f"u.{name}"), F.lit(0)).alias(name)
    return used.groupBy("event_type").agg(total("prompt_tokens"), total("completion_tokens"), total("total_tokens"))


def metric_samples(spark, sf):
    """Finite samples per metric name, with the largest value; comments and malformed lines are skipped."""
    k = F.col("k")
    line = (
        F.when(k % 10 == 0, F.lit("# HELP nothing"))
        .when(k % 10 == 1, F.concat("event_type", F.lit("_seconds NaN")))
        .when(k % 10 == 2, F.concat("event_type", F.lit(" is no sample")))
        .otherwise(F.concat("event_type", F.lit('_seconds{user="'), "user_id", F.lit('"} '), k))
    )
    found = metrics.samples(_events(spark, sf).select(line.alias("value")))
    return found.groupBy("name").agg(F.count("*").alias("samples"), F.max("value").alias("latest"))


def json_columns(spark, sf):
    """Serialised lists and maps of every event, some of them malformed."""
    k = F.col("k")
    topics = F.when(k % 4 == 0, F.concat(F.lit('["a", '), k, F.lit("]"))).when(k % 4 == 1, F.lit('["a"')).otherwise(F.lit('["a", "b"]'))
    identifiers = F.when(k % 3 == 0, F.concat(F.lit('{"n": '), k, F.lit("}"))).otherwise(F.concat(F.lit('{"n":"'), k, F.lit('"}')))
    rows = _events(spark, sf).select(topics.alias("topics"), identifiers.alias("identifiers"))
    return audit.serialized_rules(rows, lists=["topics"], maps=["identifiers"])


QUERIES = {
    "search_stored": _stored(OR_QUERY),
    "search_stored_phrase": _stored(PHRASE_QUERY),
    "log_states": log_states,
    "provider_codes": provider_codes,
    "usage_sums": usage_sums,
    "metric_samples": metric_samples,
    "json_columns": json_columns,
}

EVENTS = "WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"
ORACLES = {
    "search_stored": _documents_sql(OR_QUERY),
    "search_stored_phrase": _documents_sql(PHRASE_QUERY),
    "log_states": f"""{EVENTS}
SELECT event_type, CASE WHEN k = 99 THEN 'none' WHEN k % 10 IN (0, 1, 2) THEN 'auth_failed' WHEN k % 10 = 3 THEN 'recovering'
  WHEN k % 10 = 4 THEN 'recovered' WHEN k % 10 = 5 THEN 'transport_failed' WHEN event_type = 'error' THEN 'not_ready' ELSE 'none' END AS code,
  count(*) AS lines FROM e GROUP BY ALL""",
    "provider_codes": f"""{EVENTS}
SELECT CASE k % 8 WHEN 0 THEN 'authentication_failed' WHEN 1 THEN 'authentication_failed' WHEN 2 THEN 'rate_limited'
  WHEN 3 THEN 'model_unavailable' WHEN 4 THEN 'model_unavailable' WHEN 5 THEN 'provider_unavailable'
  ELSE CASE WHEN user_id % 3 = 0 THEN 'credential_unavailable' ELSE 'connection_failed' END END AS code, count(*) AS calls
FROM e GROUP BY ALL""",
    "usage_sums": f"""{EVENTS}
SELECT event_type, sum(k)::BIGINT AS prompt_tokens,
  coalesce(sum(CASE WHEN k % 5 <> 0 OR k = 0 THEN 2 * k END), 0)::BIGINT AS completion_tokens,
  coalesce(sum(CASE WHEN k % 3 <> 0 THEN 3 * k END), 0)::BIGINT AS total_tokens FROM e GROUP BY event_type""",
    "metric_samples": f"""{EVENTS}
SELECT event_type || '_seconds' AS name, count(*) AS samples, max(k)::DOUBLE AS latest FROM e WHERE k % 10 > 2 GROUP BY ALL""",
    "json_columns": f"""{EVENTS}
SELECT 'topics_not_string_list' AS "check", count(*) FILTER (k % 4 IN (0, 1)) AS violations FROM e
UNION ALL SELECT 'identifiers_not_string_map', count(*) FILTER (k % 3 = 0) FROM e""",
}

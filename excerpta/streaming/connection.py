"""Connection state folded from log lines, for a stored log and for a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from excerpta.functions.classify import log_code

FATAL = ("auth_failed", "transport_failed")


def connection_states(log: DataFrame, key: str = "connection_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """Final state per connection of a stored log.

    The first fatal line decides; lines after it are ignored. Without one, any recognised line
    leaves the connection not ready, and the last recovering/recovered line tells whether polling
    is recovering. The fold is a map-side combined aggregate, so no log meets in one task.
    """
    coded = log.select(key, order, log_code(line).alias("code")).filter(F.col("code").isNotNull())
    fatal = F.col("code").isin(*FATAL)
    polling = F.col("code").isin("recovering", "recovered")
    folded = coded.groupBy(key).agg(
        F.min_by(F.when(fatal, F.col("code")), F.when(fatal, F.col(order))).alias("failure"),
        F.max_by(F.when(polling, F.col("code")), F.when(polling, F.col(order))).alias("_polling"),
        F.count("*").alias("events"),
    )
    return folded.select(
        key,
        F.when(F.col("failure").isNotNull(), "error").otherwise("not_ready").alias("state"),
        "failure",
        F.coalesce(F.col("_polling") == "recovering", F.lit(False)).alias("recovering"),
        "events",
    )


STATE = "state string, failure string, recovering boolean, events bigint"


def _advance(key, frames, state):
    current, failure, recovering, events = state.get if state.exists else ("starting", None, False, 0)
    for frame in frames:
        for code in frame.sort_values("line_no")["code"]:
            events += 1
            if current == "error":
                continue
            if code in FATAL:
                current, failure = "error", code
            else:
                current = "not_ready"
                recovering = code == "recovering" if code in ("recovering", "recovered") else recovering
    state.update((current, failure, recovering, events))
    yield pd.DataFrame(
        {"connection_id": [key[0]], "state": [current], "failure": [failure], "recovering": [recovering], "events": [events]}
    )


def stream_connection_states(log: DataFrame) -> DataFrame:
    """The same fold over a stream of ``(connection_id, line_no, line)``; one update per trigger and key."""
    coded = log.select("connection_id", "line_no", log_code("line").alias("code")).filter(F.col("code").isNotNull())
    return coded.groupBy("connection_id").applyInPandasWithState(
        _advance, f"connection_id string, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout
    )

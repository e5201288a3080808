"""Prometheus text exposition as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# --- fixed values: one sample line ----------------------------------------------------------------
SAMPLE = r"^([A-Za-z_:][A-Za-z0-9_:]*)(\{[^}]*\})?[ \t]+([-+0-9.eE]+|[-+]?[Nn]a[Nn]|[-+]?[Ii]nf)$"
LAST_POLL = "commands_poll_last_successful_timestamp_seconds"
# --------------------------------------------------------------------------------------------------


def samples(lines: DataFrame, column: str = "value") -> DataFrame:
    """``name, labels, value`` of every finite sample; comments and malformed lines are skipped."""
    text = F.col(column)
    parsed = lines.select(
        F.regexp_extract(text, SAMPLE, 1).alias("name"),
        F.regexp_extract(text, SAMPLE, 2).alias("labels"),
        F.regexp_extract(text, SAMPLE, 3).try_cast("double").alias("value"),
    )
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != F.lit(float("inf")))
    return parsed.filter((F.col("name") != "") & finite)


def latest(lines: DataFrame, name: str = LAST_POLL, column: str = "value") -> DataFrame:
    """Largest value of one metric, 0 when there is none."""
    return samples(lines, column).filter(F.col("name") == name).agg(
        F.coalesce(F.max("value"), F.lit(0.0)).alias("latest")
    )

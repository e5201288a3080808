"""Acceptance rules of an upload batch, as aggregates over its files."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

# --- fixed values -----------------------------------------------------------------------------
MAX_FILES = 20
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_TOTAL_BYTES = 20 * 1024 * 1024
MAX_NAME_BYTES = 240
SUFFIXES = (".md", ".markdown", ".pdf")
# ----------------------------------------------------------------------------------------------


@F.pandas_udf(StringType())
def collision_key(names: pd.Series) -> pd.Series:
    """NFC and case-folded name; Spark has no Unicode normalization of its own."""
    return names.map(lambda name: unicodedata.normalize("NFC", name).casefold())


def suffix(name) -> Column:
    """Lower-case last suffix; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(name, r".(\.[^./\\]+)$", 1))


def is_valid_name(name) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    plain = (name != "") & ~name.isin(".", "..") & ~name.rlike(r"[/\\]") & ~name.rlike(r"\p{C}")
    return F.coalesce(plain & (F.octet_length(name) <= MAX_NAME_BYTES) & suffix(name).isin(*SUFFIXES), F.lit(False))


def batch_faults(files: DataFrame, *keys: str) -> DataFrame:
    """Per batch: sizes, limits, invalid names and names that collide; ``files(name, byte_size)``.

    Names are counted per collision key first (map-side combined); only counts meet per batch.
    """
    keyed = files.select(*keys, collision_key("name").alias("_key"), "byte_size", is_valid_name("name").alias("_valid"))
    named = keyed.groupBy(*keys, "_key").agg(
        F.count("*").alias("_n"),
        F.sum("byte_size").alias("_bytes"),
        F.count_if(~F.col("_valid")).alias("_invalid"),
        F.count_if(F.col("byte_size") > MAX_FILE_BYTES).alias("_big"),
    )
    return named.groupBy(*keys).agg(
        F.sum("_n").alias("files"),
        F.sum("_bytes").alias("total_bytes"),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("colliding_names"),
        F.sum("_invalid").alias("invalid_names"),
        F.sum("_big").alias("oversize_files"),
        (F.sum("_n") > MAX_FILES).alias("too_many_files"),
        (F.sum("_bytes") > MAX_TOTAL_BYTES).alias("too_many_bytes"),
    )

"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import sys
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from excerpta.session import settle  # noqa: F401  the operators' way to cut lineage

OUTPUT_ROWS = 4096
SLICE_ROWS = 256
ARROW_BYTES = 1 << 20
ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_worker(key: Hashable, make: Callable):
    """``make()``, once in each Python worker: functions of this package travel by value, so a cache of their own
    would begin empty in each task."""
    held = sys.__dict__.setdefault("_llm_held", {})
    if key not in held:
        held[key] = make()
    return held[key]


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches to Python hold about ``ARROW_BYTES``, or one row that is longer.

    Spark's own bound is 10 000 rows, so that a batch of texts or shingle sets grows with their length, and executor and
    worker each hold it more than once. Spark reads the setting when a job starts, so it stays set; a session's own limit
    is kept.
    """
    conf = df.sparkSession.conf
    if conf.get(ARROW_LIMIT, None) is None:
        conf.set(ARROW_LIMIT, str(ARROW_BYTES))
    return df


def slices(it: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``: texts become Python strings a slice at a time."""
    for batch in it:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_runs(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs of about ``limit`` characters, one text at least in each."""
    start, size = 0, 0
    for at, text in enumerate(texts):
        if at > start and size + len(text) > limit:
            yield start, at
            start, size = at, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = OUTPUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays(
        [pa.array(column, type=field.type) for column, field in zip(zip(*rows), schema)], schema=schema
    )

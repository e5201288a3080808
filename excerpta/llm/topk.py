"""Exact top-k inner products by distributed histogram selection.

Vectors are packed into blocks, and query blocks meet candidate blocks on a grid: each query block goes to every column of
its row of the grid, each candidate block to every row of its column, so a task holds a few blocks of either side whatever
the size of the table. All scores are computed, and computed again in each round, but never written.

A round narrows, for each query, the range of integers that holds its k-th best score: the tasks count scores by ``BINS``
bins of the current range, the counts are added up over all tasks, and the range becomes the bin in which the count from
above reaches k. When every range is one integer, a last round emits the scores above it, of which there are fewer than k,
and of those equal to it the least ids, at most k from a task; a window ranks these by score and id.

A task need not report bins below its own k-th best score: the global one is at least as high. That drops no score that
could matter and leaves about k counts per query and task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from excerpta.llm.common import settle

BINS = 1024
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
BLOCKS_A_CELL = 3
BLOCK = "block long, length long, rows long, peak double, reach double, ids binary, matrix binary"


def whole_vectors(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v) with v = floor(scale * x): rows with an id and a vector of finite numbers."""
    x = F.col(vector)
    finite = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    rows = vectors.where(x.isNotNull() & F.col(key).isNotNull() & finite & (F.size(x) > 0))
    return rows.select(F.col(key).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))


def of_one_length(batch: pa.RecordBatch, size: int):
    """(length, rows) of parts of at most ``size`` rows whose vectors are equally long."""
    lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        own = batch if (lengths == length).all() else batch.take(pa.array(np.flatnonzero(lengths == length)))
        for start in range(0, own.num_rows, size):
            yield int(length), own.slice(start, size)


def packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of at most ``size`` rows of one task and one vector length: ids, matrix, its largest component and its
    largest norm."""

    def run(it):
        number = TaskContext.get().partitionId() << 32
        for length, part in (p for batch in it for p in of_one_length(batch, size)):
            ids = part.column(0).to_numpy(zero_copy_only=False)
            values = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype("f8")
            made = (number, length, len(ids), np.abs(values).max(), np.sqrt((values**2).sum(1)).max(), ids.tobytes(), values.tobytes())
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in made], names=[f.split()[0] for f in BLOCK.split(", ")])

    return settle(rows.mapInArrow(run, BLOCK), name)


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], "i8"), np.frombuffer(row["matrix"], "f8").reshape(row["rows"], -1)


def scores_of(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products; by doubles where every partial sum is exact in them."""
    if float(np.abs(queries).max()) * float(np.abs(candidates).max()) * queries.shape[1] < 2**53:
        return (queries @ candidates.T).astype("i8")
    return queries.astype("i8") @ candidates.astype("i8").T


def _cell_scores(left: pa.Table, right: pa.Table, k: int):
    """(query ids, lows, highs, needed, candidate ids, scores, mask of the cell's k best) of each query block of a cell."""
    candidates = [unpacked(r) for r in right.to_pylist()]
    if not candidates:
        return
    ids = np.concatenate([c[0] for c in candidates])
    matrix = np.concatenate([c[1] for c in candidates])
    for row in left.to_pylist():
        query_ids, queries = unpacked(row)
        scores = scores_of(queries, matrix)
        scores[query_ids[:, None] == ids[None, :]] = np.iinfo("i8").min  # its own row
        if len(ids) > k:
            floor = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
        else:
            floor = np.full(len(query_ids), np.iinfo("i8").min)
        yield row, query_ids, ids, scores, (scores >= floor[:, None]) & (scores > np.iinfo("i8").min)


def nearest(vectors: DataFrame, is_query: Column, k: int, key="vec_id", vector="embedding", scale=64) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the ``k`` rows of highest score, ties to the smaller id.

    Score: inner product of floor(scale * x). A row without id, or whose vector is null, empty or holds a null or a
    non-finite number, takes no part; vectors meet those of their own length. A query is not its own candidate. Rows
    that repeat a query's id are one query (the least vector); repeated candidates each take a rank. A query with fewer
    than ``k`` candidates returns them all; an empty table gives no rows.
    """
    rows = whole_vectors(vectors.withColumn("_query", is_query), key, vector, scale)
    asked = whole_vectors(vectors.where(is_query), key, vector, scale).groupBy("id").agg(F.min("v").alias("v"))
    candidates, queries = packed(rows, CANDIDATE_BLOCK, "topk-rows"), packed(asked, QUERY_BLOCK, "topk-queries")
    many, reach = candidates.agg(F.count("*"), F.coalesce(F.max("reach"), F.lit(0.0))).first()
    lines = queries.count()
    across, down = max(1, many // BLOCKS_A_CELL), max(1, lines // BLOCKS_A_CELL)

    def dealt(frame, own, parts, other, others):
        return frame.withColumn(own, F.expr(f"pmod(xxhash64(block), {parts})").cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        )

    columns = dealt(candidates, "x", across, "y", down).groupBy("length", "x", "y")

    def count(key, left, right):
        tables = []
        for row, query_ids, ids, scores, best in _cell_scores(left, right, k):
            at, which = np.nonzero(best)
            low, high = np.array(row["low"]), np.array(row["high"])
            found = scores[at, which]
            inside = (found >= low[at]) & (found < high[at])
            at, found = at[inside], found[inside]
            bins = (found - low[at]) // -(-(high - low) // BINS)[at]
            pairs, n = np.unique(at * BINS + bins, return_counts=True)
            tables.append((query_ids[pairs // BINS], pairs % BINS, n))
        return _table(tables, ["query_id", "bin", "n"])

    def emit(key, left, right):
        tables = []
        for row, query_ids, ids, scores, best in _cell_scores(left, right, k):
            best &= scores >= np.array(row["low"])[:, None]
            at, which = np.nonzero(best)
            order = np.lexsort((ids[which], -scores[at, which], at))
            at, which = at[order], which[order]
            first = np.searchsorted(at, np.arange(len(query_ids)))
            kept = np.arange(len(at)) - first[at] < k
            at, which = at[kept], which[kept]
            tables.append((query_ids[at], ids[which], scores[at, which]))
        return _table(tables, ["query_id", "vec_id", "score"])

    def met(state, function, schema):
        """Query blocks with the state of their queries, on the grid."""
        parts = state.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "low", "high"))).alias("s"))  # a block's
        known = queries.join(parts.select("block", F.col("s.low").alias("low"), F.col("s.high").alias("high")), "block")
        return dealt(known, "y", down, "x", across).groupBy("length", "x", "y").cogroup(columns).applyInArrow(function, schema)

    bound = int(reach) + 1
    state = queries.mapInArrow(_first_ranges(bound), "query_id long, block long, place int, low long, high long, above long")
    state = settle(state.withColumn("settled", F.lit(False)), "topk-state")
    while (width := state.where("not settled").agg(F.max(F.col("high") - F.col("low"))).first()[0]) is not None and width > 1:
        counts = met(state, count, "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        above = Window.partitionBy("query_id").orderBy(F.desc("bin"))  # at most BINS rows
        running = counts.withColumn("upto", F.sum("n").over(above)).join(state, "query_id")
        hit = running.where(F.col("above") + F.col("upto") >= k).groupBy("query_id").agg(F.max_by(F.struct("bin", "n", "upto"), "bin").alias("h"))
        step = F.expr(f"(high - low + {BINS} - 1) div {BINS}")
        state = state.join(hit, "query_id", "left").select(
            "query_id", "block", "place",
            F.when(F.col("h").isNull(), F.col("low")).otherwise(F.col("low") + F.col("h.bin") * step).alias("low"),
            F.when(F.col("h").isNull(), F.col("high")).otherwise(F.least("high", F.col("low") + (F.col("h.bin") + 1) * step)).alias("high"),
            F.when(F.col("h").isNull(), F.col("above")).otherwise(F.col("above") + F.col("h.upto") - F.col("h.n")).alias("above"),
            F.col("h").isNull().alias("settled"),  # fewer than k candidates: all of them qualify
        )
        state = settle(state, "topk-state")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = met(state, emit, "query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(ranked))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _table(parts: list[tuple], names: list[str]) -> pa.Table:
    columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, "i8") for k in range(len(names))]
    return pa.Table.from_arrays([pa.array(c.astype("i8")) for c in columns], names=names)


def _first_ranges(bound: int):
    """No score exceeds the product of the norms."""

    def run(it):
        for batch in it:
            for row in batch.to_pylist():
                ids, queries = unpacked(row)
                most = np.floor(np.sqrt((queries**2).sum(1)) * bound).astype("i8") + 1
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(np.full(n, row["block"])), pa.array(np.arange(n, dtype="i4")), pa.array(-most), pa.array(most + 1), pa.array(np.zeros(n, "i8"))],
                    names=["query_id", "block", "place", "low", "high", "above"],
                )

    return run

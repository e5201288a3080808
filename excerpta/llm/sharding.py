"""Shards of near equal bytes by histogram sort, in DataFrame functions alone.

Rows are ordered by (hash of the text, id, place in the source): copies of a text lie side by side, and where they
outgrow a shard their ids, then their places, cut them. Splitters of that order are found without sorting anything:

1. Each round lays equally spaced probes over the open intervals and counts, in one aggregation with map-side combining,
   the exact bytes and rows between them. Only these counts, of a bounded number of cells, reach the driver.
2. A splitter is final when a boundary of its cell is within the tolerance of its target, or when the cell is one row.
   Otherwise its cell is the interval of the next round: of the same part of the key, or of the next part where the cell
   has one value left (one hot text, one repeated id).
3. Rows are exchanged once, each to the range between its splitters, and sorted there. A row's slot is its place in the
   range plus the rows of the ranges before, which the histogram knows.

Shards are cut into ranges so that tasks stay small however few shards there are.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from excerpta.llm.common import settle

FIRST_PROBES = 4096
PROBES = 8192  # of all open intervals of a later round
RANGE_BYTES = 256 << 20
RANGES = 1 << 14
TOLERANCE = 1e-6  # of a shard; a range inside a shard may be a tenth of its size off
KEYS = ("_k1", "_k2", "_k3")
PLACE = (1 << 33) - 1  # the bits of monotonically_increasing_id that count rows of a partition


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def keyed(docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """``row`` (a struct of the columns of ``docs``), ``_size`` and the three parts of the sort key.

    The last part is the row's place in its file. A frame whose rows have none is written to the shared folder first.
    """
    place = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    parts = [
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        text_bytes(F.col(text)).alias("_size"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_k1"),
        F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("_k2"),
        place.alias("_k3"),
    ]
    try:
        return docs.select(*parts)
    except AnalysisException:
        return settle(docs, "shard-rows").select(*parts)


class Interval:
    """A part of the key order that holds splitters still to be found: ``width`` values of key part ``part`` from
    ``low`` on make a cell."""

    def __init__(self, number, stats, part, probes, bytes_below, rows_below, after, targets):
        self.number, self.part = number, part
        low, high = stats[part]
        self.shift = int(high - low >= 1 << 63)  # differences stay 64-bit numbers
        self.low = low >> self.shift
        self.width = ((high >> self.shift) - self.low) // probes + 1
        self.bytes_below, self.rows_below, self.after, self.targets = bytes_below, rows_below, after, targets


def _cell(part: Column, low, shift, width) -> Column:
    value = F.when(part == 0, F.col(KEYS[0])).when(part == 1, F.col(KEYS[1])).otherwise(F.col(KEYS[2]))
    return F.call_function("div", F.call_function("shiftright", value, shift) - low, width)


def _values(df: DataFrame, rows: list[str], names: str) -> DataFrame:
    """A small table of literals."""
    return df.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({names})")


def _open_part(stats) -> int | None:
    return next((p for p, (low, high) in enumerate(stats) if low != high), None)


def _narrowed(frame: DataFrame, opened: list[Interval], links: list[tuple]) -> DataFrame:
    """The rows inside the open intervals, with the interval and the cell where each lies."""
    grid = [f"({at}, {cell}L, {i.number}, {i.part}, {i.low}L, {i.shift}, {i.width}L)" for (at, cell), i in zip(links, opened)]
    grid = _values(frame, grid, "_at, _cell, _next, _part, _low, _shift, _width")
    inside = frame.join(F.broadcast(grid), ["_at", "_cell"])  # at most as many rows as ranges
    cell = _cell(F.col("_part"), F.col("_low"), F.col("_shift"), F.col("_width"))
    return inside.select(F.col("_next").alias("_at"), cell.alias("_cell"), "_size", *KEYS)


def splitters(rows: DataFrame, parts: int, of_shard: int, tolerance=TOLERANCE):
    """The least keys of ranges 1 to ``parts - 1`` of near equal bytes, the rows below them, and the first round's cells.

    ``rows`` (a table) has ``_size`` and the key. Every ``of_shard``-th splitter ends a shard and is exact up to
    ``tolerance`` of a shard, or the nearest row boundary. Returns (found, cells, root): found has (key, rows below) in
    order, key None for the end; cells has (cell, least key) of the root interval.
    """
    ends = [f(k) for k in KEYS for f in (F.min, F.max)]
    total, count, *bounds = rows.agg(F.sum("_size"), F.count("*"), *ends).first()
    if not count:
        return [(None, 0)] * (parts - 1), [], None
    stats = list(zip(bounds[::2], bounds[1::2]))
    targets = list(range(1, parts))
    root = Interval(0, stats, 0, FIRST_PROBES, 0, 0, None, targets)
    found, first_cells, opened, links, number = {}, [], [root], [], 1
    frame = rows.select(F.lit(0).alias("_at"), _cell(F.lit(0), F.lit(root.low), F.lit(root.shift), F.lit(root.width)).alias("_cell"), "_size", *KEYS)
    while opened:
        if links:
            frame = _narrowed(frame, opened, links)
        cells: dict[int, list] = {}
        counted = frame.groupBy("_at", "_cell").agg(F.sum("_size"), F.count("*"), F.min(F.struct(*KEYS)), *ends)
        for at, cell, size, n, least, *bounds in counted.collect():  # at most FIRST_PROBES, later PROBES + 4 * parts
            cells.setdefault(at, []).append((cell, size, n, tuple(least), list(zip(bounds[::2], bounds[1::2]))))
        if not first_cells:
            first_cells = sorted((c[0], c[3]) for c in cells[0])
        closed, opened, links = opened, [], []
        waiting = []
        for interval in closed:
            below, rows_below, left = interval.bytes_below, interval.rows_below, list(interval.targets)
            own = sorted(cells[interval.number])
            for k, (cell, size, n, least, stats) in enumerate(own):
                after = own[k + 1][3] if k + 1 < len(own) else interval.after
                here = []
                while left and left[0] * total < (below + size) * parts:
                    here.append(left.pop(0))
                part = _open_part(stats)
                chosen = {}
                for j in here:
                    aim = j * total / parts
                    off, low_side = min((aim - below, True), (below + size - aim, False), key=lambda x: x[0])
                    allowed = total / parts * (tolerance * of_shard if j % of_shard == 0 else 0.1)
                    chosen[j] = (least, rows_below) if low_side else (after, rows_below + n)
                    if off > allowed and part is not None:
                        chosen = None  # all of the cell's splitters go on, so that they stay in order
                        break
                if chosen is None:
                    waiting.append((interval.number, cell, stats, part, below, rows_below, after, here))
                else:
                    found.update(chosen)
                below, rows_below = below + size, rows_below + n
        probes = max(4, PROBES // max(1, len(waiting)))
        for at, cell, stats, part, below, rows_below, after, here in waiting:
            opened.append(Interval(number, stats, part, probes, below, rows_below, after, here))
            links.append((at, cell))
            number += 1
    return [found[j] if found[j][0] is not None else (None, count) for j in targets], first_cells, root


def _range_of(keys: Column, splits: Column, steps: int) -> Column:
    """How many of the sorted ``splits`` are at most ``keys``, by halving."""
    state = lambda low, high: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))

    def halve(s, _):
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        beyond = F.get(splits, middle) <= keys
        return F.when(s["low"] >= s["high"], s).when(beyond, state(middle + 1, s["high"])).otherwise(state(s["low"], middle))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state(F.lit(0), F.size(splits)), halve)["low"]


def histogram_sort(docs: DataFrame, shards=16, key="doc_id", text="text", range_bytes=RANGE_BYTES, tolerance=TOLERANCE) -> DataFrame:
    """One row per row of ``docs``: row (a struct of all its columns), size, shard (from 0), slot (gapless from 0 in each
    shard, in key order).

    The shards' bytes are equal up to ``tolerance`` or to the one row that lies across a splitter. A null text has size
    1 and counts as an empty one; a null id comes first among equal texts. Equal texts are neighbours, so they share a
    shard unless a splitter falls among them. Rows that repeat each other are told apart by their place in the source. A
    row larger than a shard leaves others empty; with fewer rows than shards some are empty. An empty table gives no
    rows. Names of the columns of ``docs`` cannot clash, as they stay inside ``row``.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = docs.sparkSession
    whole = keyed(docs, key, text)
    rows = settle(whole.select("_size", *KEYS), "shard-keys")
    total = rows.agg(F.sum("_size")).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = max(-(-total // (shards * range_bytes)), -(-least // shards), 1)
    each = min(each, max(1, RANGES // shards))
    parts = shards * each
    found, cells, root = splitters(rows, parts, each, tolerance)
    if root is None:
        return whole.limit(0).select("row", F.col("_size").alias("size"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))

    inner = [k for k, _ in found if k is not None]
    kind = f"ARRAY<STRUCT<{', '.join(f'{k}: BIGINT' for k in KEYS)}>>"
    table, longest = [], 0
    for at, (cell, first) in enumerate(cells):
        low = bisect_right(inner, first)
        high = bisect_left(inner, cells[at + 1][1]) if at + 1 < len(cells) else len(inner)
        splits = ", ".join("struct({}L, {}L, {}L)".format(*k) for k in inner[low:high])
        table.append(f"({cell}L, {low}, CAST(array({splits}) AS {kind}))")
        longest = max(longest, high - low)
    table = _values(whole, table, "_cell, _first, _splits")
    whole = whole.withColumn("_cell", _cell(F.lit(0), F.lit(root.low), F.lit(root.shift), F.lit(root.width)))
    ranged = whole.join(F.broadcast(table), "_cell")  # at most FIRST_PROBES rows and ``parts`` splitters
    part = F.col("_first") + F.when(F.size("_splits") > 0, _range_of(F.struct(*KEYS), F.col("_splits"), longest.bit_length() + 1)).otherwise(0)
    before = [0, *(n for _, n in found)]
    starts = [before[p] - before[p - p % each] for p in range(parts)]
    dealt = ranged.select("row", "_size", *KEYS, part.alias("_part")).repartitionById(parts, F.col("_part")).sortWithinPartitions(*KEYS)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(PLACE))
    return dealt.select(
        "row",
        F.col("_size").alias("size"),
        F.floor(F.col("_part") / each).cast("int").alias("shard"),
        (place + F.get(F.lit(starts), F.col("_part"))).cast("long").alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str, columns=None) -> None:
    """Write the rows of :func:`histogram_sort` as Parquet, a folder ``shard=N`` for each shard; ``slot`` is written with
    each row, and rows lie in its order in each file."""
    columns = columns or sharded.schema["row"].dataType.names
    kept = [F.col(f"row.`{c}`").alias(c) for c in columns if c not in ("shard", "slot")]
    sharded.select(*kept, "slot", "shard").write.partitionBy("shard").parquet(path)

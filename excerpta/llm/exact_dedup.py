"""Exact deduplication by Grace hashing over complete texts.

Copies meet in three steps. Each map task folds its own rows in an open-addressing table of bounded size, so a
text that makes up a third of all rows leaves a task once, not once per row. A shuffle on the digest is the first
partitioning. Each reduce task folds its bucket in the same kind of table; a bucket whose distinct texts exceed the
table is partitioned again, by the next four bits of the digest, into anonymous spill files, and so on until each
part fits. The table compares complete texts: two texts with one digest would be refused, never merged.

Only one row per distinct text crosses the shuffle with its text. The rows themselves learn their group by a join on
the digest with the groups of two and more, which adaptive execution splits where one text is hot.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from excerpta.llm.common import batches, in_small_batches

COMBINE_BYTES = 24 << 20
BUCKET_BYTES = 64 << 20
FAN_OUT_BITS = 4
HEAD = "<32sqq?Q"
RECORDS = pa.schema([("bucket", pa.int64()), ("digest", pa.binary()), ("content", pa.string()), ("low", pa.int64()), ("rows", pa.int64())])
GROUPS = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def normal_text(text: Column) -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def lower_id(left, right):
    """The smaller id; null comes after every id."""
    if left is None or right is None:
        return right if left is None else left
    return min(left, right)


class ContentTable:
    """Open addressing with linear probing; a slot matches only if the complete content does."""

    def __init__(self, slots: int = 1024):
        self.slots = [-1] * slots
        self.entries: list[list] = []  # digest, content, lowest id, rows
        self.bytes = 0

    def add(self, digest: bytes, content: bytes, low, rows: int) -> None:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:], "little") & mask
        while (found := self.slots[at]) >= 0:
            entry = self.entries[found]
            if entry[0] == digest:
                if entry[1] != content:
                    raise ValueError(f"two texts share the digest {digest.hex()}")
                entry[2] = lower_id(entry[2], low)
                entry[3] += rows
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.entries)
        self.entries.append([digest, content, low, rows])
        self.bytes += len(content) + 200
        if 2 * len(self.entries) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for number, entry in enumerate(self.entries):
            at = int.from_bytes(entry[0][-8:], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = number


def _bucket(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def combine(batches_in: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple]:
    """Fold equal texts of one task; the table is emptied whenever it holds ``limit`` bytes."""
    held = ContentTable()
    for batch in batches_in:
        for low, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            content = content.as_buffer().to_pybytes()
            held.add(hashlib.sha256(content).digest(), content, low, 1)
            if held.bytes >= limit:
                yield from ((_bucket(d), d, c.decode(), k, n) for d, c, k, n in held.entries)
                held = ContentTable()
    yield from ((_bucket(d), d, c.decode(), k, n) for d, c, k, n in held.entries)


class Spill:
    """Records of one part in an anonymous file that goes with the task."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()

    def add(self, digest, content, low, rows):
        self.file.write(struct.pack(HEAD, digest, low or 0, rows, low is None, len(content)))
        self.file.write(content)

    def records(self):
        self.file.seek(0)
        while head := self.file.read(struct.calcsize(HEAD)):
            digest, low, rows, missing, size = struct.unpack(HEAD, head)
            yield digest, self.file.read(size), None if missing else low, rows
        self.file.close()


def grace(records: Iterator[tuple], limit: int, level: int = 0) -> Iterator[tuple]:
    """Distinct contents with lowest id and number of rows, from (digest, content, lowest id, rows).

    Memory: ``limit`` bytes of distinct contents, however many records repeat them.
    """
    held, parts = ContentTable(), None
    shift = 8 * 16 - FAN_OUT_BITS * (level + 1)  # bits after those of the shuffle
    for digest, content, low, rows in records:
        if parts is None:
            held.add(digest, content, low, rows)
            if held.bytes <= limit or len(held.entries) == 1 or shift < 0:
                continue
            parts, entries, held = [Spill() for _ in range(1 << FAN_OUT_BITS)], held.entries, None
        else:
            entries = [(digest, content, low, rows)]
        for entry in entries:
            parts[int.from_bytes(entry[0][8:24], "big") >> shift & (1 << FAN_OUT_BITS) - 1].add(*entry)
    if parts is None:
        yield from held.entries
    else:
        for part in parts:
            yield from grace(part.records(), limit, level + 1)


def content_groups(docs: DataFrame, key="doc_id", text="text", combine_bytes=COMBINE_BYTES, bucket_bytes=BUCKET_BYTES) -> DataFrame:
    """One row per distinct normalised text: text_sha256, keep_id (lowest id), group_size."""

    def fold(it):
        return batches(combine(it, combine_bytes), RECORDS, 256)

    def meet(it):
        records = (
            (d.as_py(), c.as_buffer().to_pybytes(), k, n)
            for b in it
            for d, c, k, n in zip(b.column(0), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist())
        )
        return batches(((d.hex(), k, n) for d, _, k, n in grace(records, bucket_bytes)), GROUPS)

    rows = docs.select(F.col(key).cast("long").alias("low"), normal_text(F.col(text)).alias("content"))
    folded = in_small_batches(rows).mapInArrow(fold, "bucket long, digest binary, content string, low long, rows long")
    return folded.repartition("bucket").drop("bucket").mapInArrow(meet, "text_sha256 string, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, key="doc_id", text="text", **sizes) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. A null id comes after all others: it is the keep_id only of a group without ids.
    Rows that repeat an id are one document: each is reported, group_size counts them all, and ``kept`` is true on
    each row whose id is the keep_id. An empty table gives no rows; other columns are ignored.
    """
    digests = docs.select(F.col(key).cast("long").alias("doc_id"), F.sha2(normal_text(F.col(text)), 256).alias("text_sha256"))
    groups = content_groups(docs, key, text, **sizes).where("group_size > 1")
    return digests.join(groups, "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )

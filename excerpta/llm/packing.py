"""Best-fit packing of token sequences under several capacities at once.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared lengths). An item goes to
the open sequence that is tightest for it, among those where it fits in every dimension; "tightest" is the smallest
weighted residual norm, or the smallest weighted dot product of item and residual.

An item's demands depend on its length alone, so the decisions are taken on the histogram of lengths, longest first:
equal sequences are one class with a multiplicity, and placing n items of one length touches classes, not items. The
histogram has at most ``capacity`` entries at any input size. Spark does the rest: it tokenises, counts lengths, numbers
the items of each length (in about sqrt(n) groups of about sqrt(n) rows, so that a hot length stays spread) and looks
the numbers up in the plan.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from excerpta.llm.common import batches, in_small_batches, per_worker, settle

CAPACITY = 2048
# The split pattern of byte-level BPE: a fixed value of the tokenizer's format.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


def encoder(path: str):
    """The function from a text to its ids of a byte-level tokenizer file.

    tiktoken's pattern backtracks over white space and gives up on runs of about a million; such a text goes, whole, to the
    tokenizers library, which has no such bound and gives the same ids.
    """
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {t["content"]: t["id"] for t in content["added_tokens"]}
    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in token): n for token, n in content["model"]["vocab"].items() if token not in special}
    bpe = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def encode(text):
        try:
            return bpe.encode(text, allowed_special="all")
        except ValueError:
            return per_worker(("tokenizers", path), lambda: Tokenizer.from_file(path)).encode(text, add_special_tokens=False).ids

    return encode


def token_pieces(docs: DataFrame, tokenizer: str, capacity=CAPACITY, end_id=0, key="doc_id", text="text") -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32.

    A document is its ids and ``end_id``. Only a longer one is cut, into full pieces; the first takes the remainder.
    A null text is empty, which leaves the end token alone. Repeated rows give repeated pieces. ``tokenizer`` is a path
    that exists on every machine, like the installed package it comes from.
    """

    def cut(it):
        encode = per_worker(("byte-level", tokenizer), lambda: encoder(tokenizer))

        def rows():
            for batch in it:
                for doc, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = encode(content.as_py())
                    ids.append(end_id)
                    ids = np.array(ids, "<u4")
                    first = (len(ids) - 1) % capacity + 1
                    bounds = [0, *range(first, len(ids) + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        yield doc, piece, a, b - a, zlib.crc32(ids[a:b])

        return batches(rows(), PIECES)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return in_small_batches(rows).mapInArrow(cut, "doc_id long, piece long, start long, length long, ids_crc32 long")


class Plan:
    """Vector best fit of a histogram of lengths.

    Three equal-long arrays describe the classes: how many sequences, their residual vector, and what each holds:
    (length, copies in each sequence, place of the first copy, number of the first item).
    """

    def __init__(self, histogram: dict[int, int], limits=(CAPACITY, CAPACITY, CAPACITY**2), weights=(1.0, 1.0, 1.0), rule="norm"):
        if rule not in ("norm", "dot"):
            raise ValueError("rule is norm or dot")
        self.limits = np.array(limits, "f8")
        self.scale = np.array(weights, "f8") / self.limits
        self.rule = rule
        self.many = np.zeros(64, "i8")
        self.rest = np.zeros((64, 3))
        self.holds: list[tuple] = []
        for length in sorted(histogram, reverse=True):
            self._place(length, histogram[length])

    def _open(self, many, rest, holds):
        if (n := len(self.holds)) == len(self.many):
            self.many, self.rest = np.resize(self.many, 2 * n), np.resize(self.rest, (2 * n, 3))
        self.many[n], self.rest[n] = many, rest
        self.holds.append(holds)
        return n

    def _tightest(self, item):
        rest = self.rest[: len(self.holds)]
        fits = np.flatnonzero((rest >= item).all(1))
        if not len(fits):
            return None
        left = rest[fits] * self.scale
        tight = (left**2).sum(1) if self.rule == "norm" else left @ (item * self.scale)
        return int(fits[np.argmin(tight)])

    def _place(self, length, n):
        item, number = np.array([length, 1, length * length], "f8"), 0
        if (item > self.limits).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        while number < n:
            at = self._tightest(item)
            if at is None:
                each = int((self.limits // item).min())
                at = self._open(max(1, (n - number) // each), self.limits, ())
            each = min(int((self.rest[at] // item).min()), n - number)
            full = min(int(self.many[at]), (n - number) // each)
            if full < self.many[at]:  # the others stay as they are
                moved = tuple((l, k, p, first + full * k) for l, k, p, first in self.holds[at])
                self._open(self.many[at] - full, self.rest[at], moved)
                self.many[at] = full
            place = int(self.limits[0] - self.rest[at, 0])
            self.holds[at] += ((length, each, place, number),)
            self.rest[at] -= each * item
            number += full * each

    @property
    def sequences(self):
        return int(self.many[: len(self.holds)].sum())

    def lookup(self):
        """Sorted by (length, first item): length, first item, first sequence, copies per sequence, first place."""
        rows, base = [], 0
        for many, holds in zip(self.many, self.holds):
            rows += [(length, first, base, each, place) for length, each, place, first in holds]
            base += int(many)
        return np.array(sorted(rows), "i8").reshape(-1, 5)


def pack(pieces: DataFrame, limits=(CAPACITY, CAPACITY, CAPACITY**2), weights=(1.0, 1.0, 1.0), rule="norm", order=("doc_id", "piece")) -> DataFrame:
    """``pieces`` (with a ``length``) and for each row its sequence_id and offset.

    ``pieces`` is read three times, so it should be a table. ``order`` names columns that tell rows apart; rows that
    repeat get places of their own. Packing is complete: no row is left out, no capacity is exceeded, and the rows of a
    sequence lie gapless from 0. Only the histogram of lengths (at most ``limits[0]`` rows) reaches the driver.
    """
    counts = pieces.groupBy("length").count()
    plan = Plan({r["length"]: r["count"] for r in counts.collect()}, limits, weights, rule)
    found = plan.lookup()
    spread = F.broadcast(counts.select("length", F.ceil(F.sqrt("count")).alias("_groups")))  # a row per length
    dealt = pieces.join(spread, "length").withColumn("_group", F.expr(f"pmod(xxhash64({', '.join(order)}), _groups)"))
    sizes = dealt.groupBy("length", "_group").agg(F.count("*").alias("_size"))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "_group", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_group").orderBy(*order)
    numbered = dealt.withColumn("_number", F.row_number().over(within) - 1).join(firsts, ["length", "_group"])
    numbered = numbered.select(*pieces.columns, (F.col("_first") + F.col("_number")).alias("_item"))
    width = 1 << 40  # items of one length

    def look_up(it):
        keys = found[:, 0] * width + found[:, 1]
        for batch in it:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            item = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            row = found[np.searchsorted(keys, length * width + item, side="right") - 1]
            turn, copy = np.divmod(item - row[:, 1], row[:, 3])
            columns = [*batch.columns[:-1], pa.array(row[:, 2] + turn), pa.array(row[:, 4] + copy * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.mapInArrow(look_up, f"{fields}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity=CAPACITY, **options) -> DataFrame:
    """Tokenise, cut and pack ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = settle(token_pieces(docs, tokenizer, capacity), "token-pieces")
    return pack(pieces, (capacity, capacity, capacity**2), **options)

"""Trie of conversation prefixes in minimal-perfect-hash node tables.

A node is a distinct sequence of first turns. Its digest is the sum, in four 32-bit lanes, of a hash of (place, role,
text) over its turns: prefixes of one conversation are running sums, which are taken in segments of ``SEGMENT`` turns
and carried on, so that a conversation of any length is no single group.

Shards are hashed sets of (conversation, segment) of about ``SHARD_ROWS`` turns. A task enumerates the distinct digests
of its shard, gives each a slot by a minimal perfect hash that verifies the digest it holds, scatters counts into flat
arrays by slot and accumulates them through the array of parent slots, deepest nodes first. This is done twice:

1. Conversations are scattered at the last turn of each of their segments. The sums are a shard's members of each node;
   an aggregation by digest makes them the trie's, and each node gets its least member.
2. What a node adds to its subtrees (a leaf, saved tokens) is scattered once, in the shard of its least member, which has
   all of the node's ancestors. What later segments add enters at the last turn of the earlier ones. An aggregation by
   digest adds the shards up.

So a first turn that a third of all conversations share is one row of each shard, never a group in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from excerpta.llm.common import batches, settle

SEGMENT = 1024
SHARD_ROWS = 200_000
FRAGMENT_IDS = 4096
LANE = 1 << 32
NODES = "hi long, lo long, parent_hi long, parent_lo long, depth long, mark long, last_bytes long, n_convs long, n_ends long, conv_id long"
SUMS = "hi long, lo long, n_leaves long, saved_tokens long"


def placed_turns(conversations: DataFrame, key="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """conv_id, place (from 1), content (SHA-256 of role and text), mark (a second hash of them) and last_bytes (of the
    text) of each turn.

    Turns are ordered by ``turn`` (null first), then role, then the text's SHA-256; null role or text is empty. Rows without
    conv_id belong to no conversation and are left out. Rows are range-partitioned in that order, and a conversation that
    spans partitions is numbered by the counts of the partitions before: no window holds a whole conversation.
    """
    spoken, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = conversations.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv_id"),
        F.col(turn).alias("_turn"),
        spoken.alias("_role"),
        F.sha2(said, 256).alias("_text"),
        F.sha2(F.concat(F.octet_length(spoken).cast("string"), F.lit(":"), spoken, said), 256).alias("content"),
        F.xxhash64(spoken, said).alias("mark"),
        F.octet_length(said).cast("long").alias("last_bytes"),
    )
    order = [F.col("conv_id"), F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = settle(dealt.drop("_turn", "_role", "_text"), "trie-turns").withColumn("_part", F.shiftright("_at", 33))
    runs = dealt.groupBy("conv_id", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.col("_at") - F.col("_first") + F.col("_before") + 1
    numbered = dealt.join(runs, ["conv_id", "_part"]).select("conv_id", place.alias("place"), "content", "mark", "last_bytes")
    return settle(numbered, "trie-placed")


def with_shared_openings(turns: DataFrame, openings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``h`` turns are replaced by those of another conversation.

    ``turns`` is a table of :func:`placed_turns`; ``openings`` has conv_id, source_id and h for each conversation. All
    turns of a shorter source are taken, none of a missing one. Returns the new turns and (conv_id, length).
    """
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    sources = lengths.select(F.col("conv_id").alias("source_id"), F.col("n").alias("source_n"))
    convs = openings.join(lengths, "conv_id").join(sources, "source_id", "left")
    kept = F.least("h", F.coalesce("source_n", F.lit(0)))
    convs = settle(convs.select("conv_id", "source_id", "h", kept.alias("kept"), (kept + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-convs")
    rest = [c for c in turns.columns if c not in ("conv_id", "place")]
    own = turns.join(convs.drop("source_id", "length"), "conv_id").where("place > h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("kept")).alias("place"), *rest)
    first = turns.withColumnRenamed("conv_id", "source_id").join(convs.where("kept > 0").drop("length"), "source_id").where("place <= kept")
    return own.union(first.select("conv_id", "place", *rest)), convs.select("conv_id", "length")


def prefix_rows(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each prefix of each conversation, the empty one included: conv_id, depth, digest, parent's digest,
    mark, last_bytes, segment, and whether the conversation ends there."""
    digest = F.sha2(F.concat(F.col("place").cast("string"), F.lit(":"), F.col("content")), 256)
    lanes = [f"_e{k}" for k in range(4)]
    rows = turns.withColumn("_digest", digest).select(
        "conv_id", "place", "mark", "last_bytes",
        F.expr(f"(place - 1) div {SEGMENT}").alias("segment"),
        *[F.conv(F.substring("_digest", 8 * k + 1, 8), 16, 10).cast("long").alias(lane) for k, lane in enumerate(lanes)],
    )
    rows = settle(rows, "trie-elements")
    totals = rows.groupBy("conv_id", "segment").agg(*[F.sum(e).alias(e) for e in lanes])
    earlier = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("conv_id", "segment", *[(F.sum(e).over(earlier) % LANE).alias(f"{e}_carry") for e in lanes]).where("segment > 0")
    within = Window.partitionBy("conv_id", "segment").orderBy("place")
    summed = rows.select("*", *[F.sum(e).over(within).alias(f"{e}_sum") for e in lanes]).join(carry, ["conv_id", "segment"], "left")
    lane = lambda e: (F.coalesce(f"{e}_carry", F.lit(0)) + F.col(f"{e}_sum")) % LANE
    before = lambda e: (F.coalesce(f"{e}_carry", F.lit(0)) + F.col(f"{e}_sum") - F.col(e)) % LANE
    pair = lambda f, a, b: F.shiftleft(f(a), 32).bitwiseOR(f(b))
    nodes = summed.select(
        "conv_id", F.col("place").alias("depth"), "mark", "last_bytes", "segment",
        pair(lane, *lanes[:2]).alias("hi"), pair(lane, *lanes[2:]).alias("lo"),
        pair(before, *lanes[:2]).alias("parent_hi"), pair(before, *lanes[2:]).alias("parent_lo"),
    )
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", *[zero.alias(c) for c in nodes.columns[1:]])
    ended = nodes.union(roots).join(convs, "conv_id")
    return ended.select(*nodes.columns, (F.col("depth") == F.col("length")).alias("ends"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class SlotTable:
    """Minimal perfect hash of distinct 128-bit digests; ``slots`` is -1 for a digest that the table does not hold.

    Level by level, digests that are alone in their cell of a bit array twice their number get the next slots; the others
    go on to the next level.
    """

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        order = np.lexsort((lo, hi))
        hi, lo = hi[order], lo[order]
        new = np.ones(len(hi), bool)
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        left_hi, left_lo = hi[new], lo[new]
        self.levels = []
        self.hi, self.lo = np.empty(len(left_hi), "u8"), np.empty(len(left_hi), "u8")
        given = 0
        while len(left_hi):
            size = 2 * len(left_hi)
            cell = self._cells(left_hi, left_lo, len(self.levels), size)
            alone = np.bincount(cell, minlength=size) == 1
            slot = np.where(alone, given + np.cumsum(alone) - 1, -1)
            put = alone[cell]
            self.hi[slot[cell[put]]], self.lo[slot[cell[put]]] = left_hi[put], left_lo[put]
            self.levels.append(slot)
            given += int(alone.sum())
            left_hi, left_lo = left_hi[~put], left_lo[~put]

    def __len__(self):
        return len(self.hi)

    @staticmethod
    def _cells(hi, lo, level, size):
        return (_mix(_mix(hi + np.uint64(level)) ^ lo) % np.uint64(size)).astype("i8")

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        found = np.full(len(hi), -1, "i8")
        for level, slot in enumerate(self.levels):
            open_ = np.flatnonzero(found < 0)
            if not len(open_):
                break
            found[open_] = slot[self._cells(hi[open_], lo[open_], level, len(slot))]
        held = found >= 0
        held[held] = (self.hi[found[held]] == hi[held]) & (self.lo[found[held]] == lo[held])
        return np.where(held, found, -1)


class NodeTable:
    """The local trie of a shard: digests, parents' slots and other facts by slot."""

    def __init__(self, rows: dict[str, np.ndarray]):
        self.table = table = SlotTable(rows["hi"].view("u8"), rows["lo"].view("u8"))
        self.slot = slot = table.slots(rows["hi"].view("u8"), rows["lo"].view("u8"))
        self.facts = {}
        for name in ("parent_hi", "parent_lo", "depth", "mark", "last_bytes"):
            fact = self.facts[name] = np.zeros(len(table), "i8")
            fact[slot] = rows[name]
            if (fact[slot] != rows[name]).any():
                raise ValueError("two prefixes share a digest")
        self.parent = table.slots(self.facts["parent_hi"].view("u8"), self.facts["parent_lo"].view("u8"))
        depth = self.facts["depth"]
        # The first turn of a later segment has its parent in another group, which may be in this shard by chance.
        self.parent[(depth == 0) | ((depth > 1) & ((depth - 1) % SEGMENT == 0))] = -1
        level = np.where(depth == 0, 0, (depth - 1) % SEGMENT + 1)
        order = np.argsort(level, kind="stable")
        bounds = np.searchsorted(level[order], np.arange(SEGMENT + 2))
        self.levels = [order[a:b] for a, b in zip(bounds, bounds[1:]) if a < b][::-1]

    def accumulate(self, values: np.ndarray, join=np.add) -> np.ndarray:
        for nodes in self.levels:
            nodes = nodes[self.parent[nodes] >= 0]
            join.at(values, self.parent[nodes], values[nodes])
        return values


def _columns(batches_in) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(list(batches_in))
    return {n: table.column(n).to_numpy() for n in table.column_names}


def _count_members(it):
    batches_in = [b for b in it if b.num_rows]
    if not batches_in:
        return
    rows = _columns(batches_in)
    nodes = NodeTable(rows)
    deepest = rows["ends"] | ((rows["depth"] > 0) & (rows["depth"] % SEGMENT == 0))
    members, ends = np.zeros(len(nodes.table), "i8"), np.zeros(len(nodes.table), "i8")
    least = np.full(len(nodes.table), np.iinfo("i8").max)
    np.add.at(members, nodes.slot[deepest], 1)
    np.add.at(ends, nodes.slot[rows["ends"]], 1)
    np.minimum.at(least, nodes.slot[deepest], rows["conv_id"][deepest])
    nodes.accumulate(members)
    nodes.accumulate(least, np.minimum)
    facts = [nodes.facts[n] for n in ("parent_hi", "parent_lo", "depth", "mark", "last_bytes")]
    out = [nodes.table.hi.view("i8"), nodes.table.lo.view("i8"), *facts, members, ends, least]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=[f.split()[0] for f in NODES.split(", ")])


def _sum_subtrees(it):
    batches_in = [b for b in it if b.num_rows]
    if not batches_in:
        return
    rows = _columns(batches_in)
    path = rows["kind"] == 0
    nodes = NodeTable({n: c[path] for n, c in rows.items()})
    given = nodes.table.slots(rows["hi"][~path].view("u8"), rows["lo"][~path].view("u8"))
    sums = []
    for name in ("n_leaves", "saved_tokens"):
        values = np.zeros(len(nodes.table), "i8")
        np.add.at(values, given, rows[name][~path])
        sums.append(nodes.accumulate(values))
    some = np.flatnonzero((sums[0] > 0) | (sums[1] > 0))
    out = [nodes.table.hi.view("i8"), nodes.table.lo.view("i8"), *sums]
    yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in out], names=[f.split()[0] for f in SUMS.split(", ")])


def ended_digests(rows: DataFrame) -> DataFrame:
    """hi, lo, ends_sha256 of the nodes where conversations end: of their ids in ascending order, comma-joined.

    Ids are range-partitioned by (node, id), so a node where very many end is spread; only strings of up to ``FRAGMENT_IDS``
    ids meet, in order, in the task that hashes the node, which holds one at a time.
    """
    order = ["hi", "lo", "conv_id"]
    dealt = rows.where("ends").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)

    def join_ids(it):
        def fragments():
            node, held = None, []
            for batch in it:
                for hi, lo, conv in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    if (hi, lo) != node or len(held) == FRAGMENT_IDS:
                        if held:
                            yield *node, held[0], ",".join(map(str, held))
                        node, held = (hi, lo), []
                    held.append(conv)
            if held:
                yield *node, held[0], ",".join(map(str, held))

        return batches(fragments(), pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]), 256)

    def hash_ids(it):
        def digests():
            node, digest = None, None
            for batch in it:
                for hi, lo, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                    if (hi, lo) != node:
                        if node:
                            yield *node, digest.hexdigest()
                        node, digest = (hi, lo), hashlib.sha256(ids.as_py().encode())
                    else:
                        digest.update(b"," + ids.as_py().encode())
            if node:
                yield *node, digest.hexdigest()

        return batches(digests(), pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("ends_sha256", pa.string())]))

    joined = dealt.mapInArrow(join_ids, "hi long, lo long, first long, ids string")
    return joined.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "first").mapInArrow(hash_ids, "hi long, lo long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, digest and parent_digest (hex).

    ``turns`` has conv_id, place, content, mark and last_bytes as :func:`placed_turns` gives them, places being 1 to the
    ``length`` that ``convs`` (conv_id, length) says. The root is the empty prefix, of which all of ``convs`` are members,
    turnless ones too; without conversations there is no node. Repeated turns and conversations with equal turns are
    counted as they are; a place that repeats within a conversation is not allowed.
    """
    rows = settle(prefix_rows(turns, convs), "trie-rows")
    spark = rows.sparkSession
    shards = max(-(-rows.count() // SHARD_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    shard = F.expr(f"cast(pmod(xxhash64(conv_id, segment), {shards}) as int)")

    facts = ["hi", "lo", "parent_hi", "parent_lo", "depth", "mark", "last_bytes"]
    counted = rows.select("conv_id", *facts, "ends", shard.alias("_shard")).repartitionById(shards, F.col("_shard")).drop("_shard")
    counted = counted.mapInArrow(_count_members, NODES).groupBy("hi", "lo").agg(
        *[F.min(c).alias(c) for c in facts[2:]],
        F.max(F.struct(*facts[2:])).alias("_most"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_ends")],
        F.min("conv_id").alias("conv_id"),
    )
    same = F.struct(*facts[2:]) == F.col("_most")
    verified = F.when(same, F.col("n_convs")).otherwise(F.raise_error(F.lit("two prefixes share a digest")))
    nodes = settle(counted.select(*facts, verified.alias("n_convs"), "n_ends", "conv_id"), "trie-nodes")

    # A node is childless if all of its members end there.
    adds = nodes.select(
        "conv_id", F.expr(f"greatest(depth - 1, 0) div {SEGMENT}").alias("segment"), "hi", "lo",
        (F.col("n_ends") == F.col("n_convs")).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("last_bytes")).alias("saved_tokens"),
    )
    later = adds.where("segment > 0").groupBy("conv_id", "segment").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    joints = rows.where(f"depth > 0 and depth % {SEGMENT} = 0").select("conv_id", "segment", "hi", "lo", zero.alias("n_leaves"), zero.alias("saved_tokens"))
    joints = joints.union(later.select("conv_id", "segment", none, none, "n_leaves", "saved_tokens"))
    deeper = Window.partitionBy("conv_id").orderBy(-F.col("segment")).rangeBetween(Window.unboundedPreceding, -1)
    enter = [F.coalesce(F.sum(c).over(deeper), F.lit(0)).alias(c) for c in ("n_leaves", "saved_tokens")]
    carried = joints.select("conv_id", "segment", "hi", "lo", *enter).where("hi is not null")
    adds = adds.union(carried).where("n_leaves > 0 or saved_tokens > 0")
    path = rows.select("conv_id", "segment", *facts, zero.alias("n_leaves"), zero.alias("saved_tokens"), F.lit(0).alias("kind"))
    adds = adds.select("conv_id", "segment", "hi", "lo", *[zero.alias(c) for c in facts[2:]], "n_leaves", "saved_tokens", F.lit(1).alias("kind"))
    both = path.union(adds).withColumn("_shard", shard).drop("conv_id", "segment").repartitionById(shards, F.col("_shard")).drop("_shard")
    sums = both.mapInArrow(_sum_subtrees, SUMS)

    empty = hashlib.sha256(b"").hexdigest()
    some = lambda df, **given: df.select("hi", "lo", *[given.get(c, F.lit(None).cast(t)).alias(c) for c, t in (("n_children", "long"), ("n_leaves", "long"), ("saved_tokens", "long"), ("ends_sha256", "string"))])
    children = nodes.where("depth > 0").select(F.col("parent_hi").alias("hi"), F.col("parent_lo").alias("lo"))
    parts = some(children, n_children=F.lit(1).cast("long"))
    parts = parts.union(some(sums, n_leaves=F.col("n_leaves"), saved_tokens=F.col("saved_tokens")))
    parts = parts.union(some(ended_digests(rows), ends_sha256=F.col("ends_sha256")))
    parts = parts.groupBy("hi", "lo").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")], F.coalesce(F.max("ends_sha256"), F.lit(empty)).alias("ends_sha256"))
    parents = nodes.select(F.col("hi").alias("parent_hi"), F.col("lo").alias("parent_lo"), F.col("conv_id").alias("parent_conv_id"), F.lit(True).alias("inner"))
    whole = nodes.withColumn("inner", F.col("depth") > 0).join(parts, ["hi", "lo"]).join(parents, ["parent_hi", "parent_lo", "inner"], "left")
    hex_ = lambda a, b: F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
        hex_("hi", "lo").alias("digest"), F.when(F.col("depth") > 0, hex_("parent_hi", "parent_lo")).alias("parent_digest"),
    )

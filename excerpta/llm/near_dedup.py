"""Near-duplicate components by a multi-index Hamming join of MinHash signatures.

1. ``sketches`` reads each text once: its set of word shingles (64-bit hashes), a signature of ``SYMBOLS`` b-bit MinHash
   values, and a parity sketch of the set. Documents with one shingle set are one representative.
2. ``chunk_keys`` splits a signature into ``CHUNKS`` chunks. Two signatures that differ in at most ``DISTANCE`` symbols
   have, by the pigeonhole principle, a chunk with at most ``DISTANCE // CHUNKS`` = 1 error. Leaving out each symbol of a
   chunk in turn enumerates these errors: every pair within the distance shares a key. A pair of similarity s differs in
   SYMBOLS * (1 - s) symbols on average; at 0.8, more than DISTANCE differ with probability 1e-4.
3. Star links: within a key each member is paired with the key's least member only, so pairs grow with members, never with
   their square. Confirmed links give components. A second round takes the greatest member.
4. Only keys that still hold several components are compared pair by pair, in tasks of two blocks of bounded size, and
   only across components. Parity sketches bound the true set difference from below, so a pair is dropped there
   only if it cannot be a link; what is emitted is confirmed like the star links.
5. Links are confirmed on the full shingle sets of both texts. Components grow from confirmed links by alternating
   large-star and small-star steps, which work on links alone and keep hot nodes split.

Nothing is capped or sampled; links, sets and components never reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from excerpta.llm.common import batches, in_small_batches, settle

SYMBOLS = 64
CHUNKS = 13
DISTANCE = 2 * CHUNKS - 1
BLOCK = 512
BROADCAST_IDS = 200_000
CACHE_WORDS = 200_000
SKETCHED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("signature", pa.binary()), ("parity", pa.binary())])
SETS = pa.schema([("rep", pa.int64()), ("shingles", pa.binary())])


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Shingle sets of texts: distinct hashes of ``width`` consecutive words, sorted."""

    def __init__(self, width: int):
        self.width = width
        self.hashes: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Words are runs of anything but ASCII white space, A-Z lower-cased. Fewer words than ``width`` are one
        shingle; no words give the empty set."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if len(self.hashes) > CACHE_WORDS:
            self.hashes.clear()
        hashes = self.hashes
        for word in set(words).difference(hashes):
            hashes[word] = xxhash.xxh3_64_intdigest(word)
        codes = np.array([hashes[w] for w in words], np.uint64)
        size = min(self.width, len(codes))
        if not size:
            return codes
        count = len(codes) - size + 1
        mixed = np.full(count, size, np.uint64)
        for k in range(size):
            mixed = _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + count])
        return np.unique(mixed)


def multipliers() -> np.ndarray:
    """Odd multipliers of the permutations, from a fixed rule."""
    return _mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64)) | np.uint64(1)


def signature(shingles: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """16 bits of the least value of each permuted set."""
    least = np.empty(SYMBOLS, np.uint64)
    for k in range(SYMBOLS):
        least[k] = (shingles * odd[k]).min()
    return (_mix(least) >> np.uint64(48)).astype("<u2")


def parity(shingles: np.ndarray) -> np.ndarray:
    """One bit per bucket: whether an odd number of shingles falls in it. Two sets' sketches differ in no more bits than
    the sets differ in elements; twice as many bits as elements keep that bound sharp."""
    bits = 512
    while bits < 2 * len(shingles):
        bits *= 2
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype("i8"), minlength=bits) & 1
    return np.packbits(odd.astype("u1"), bitorder="little")


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch that ``size`` bytes would have given."""
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def may_link(n_left, n_right, difference, percent):
    """Whether sets of these sizes, differing in at least ``difference`` elements, can reach the similarity."""
    total = n_left + n_right
    # Intersection (total - d) / 2, union (total + d) / 2.
    return (100 * (total - difference) >= percent * (total + difference)) & (100 * np.minimum(n_left, n_right) >= percent * np.maximum(n_left, n_right))


def sketches(docs: DataFrame, width: int, key="doc_id", text="text") -> DataFrame:
    """doc_id, n_shingles, set_id, signature and parity of each row; empty sets have no signature."""

    def run(it):
        shingler, odd = Shingler(width), multipliers()

        def rows():
            for batch in it:
                for doc, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    found = shingler(content.as_py())
                    if len(found):
                        yield doc, len(found), xxhash.xxh3_128_digest(found.tobytes()), signature(found, odd).tobytes(), parity(found).tobytes()
                    else:
                        yield doc, 0, None, None, None

        return batches(rows(), SKETCHED, 1024)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return in_small_batches(rows).mapInArrow(run, "doc_id long, n_shingles long, set_id binary, signature binary, parity binary")


def chunk_bounds() -> np.ndarray:
    return np.linspace(0, SYMBOLS, CHUNKS + 1).round().astype(int)


def first_shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of each pair of signatures, the symbol left out in the first of their shared keys."""
    errors = left != right
    bounds = chunk_bounds()
    found = np.full(len(errors), -1)
    for a, b in list(zip(bounds, bounds[1:]))[::-1]:
        part = errors[:, a:b]
        found = np.where(part.sum(1) <= 1, a + part.argmax(1), found)
    return found


def chunk_keys(reps: DataFrame) -> DataFrame:
    """(key, left_out, rep): for each chunk and each of its symbols, a hash of the chunk's other symbols."""

    def run(it):
        bounds = chunk_bounds()
        for batch in it:
            if not batch.num_rows:
                continue
            reps = batch.column(0).to_numpy(zero_copy_only=False)
            symbols = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, SYMBOLS).astype(np.uint64)
            keys = []
            for chunk, (a, b) in enumerate(zip(bounds, bounds[1:])):
                for left_out in range(a, b):
                    key = np.full(len(reps), chunk * SYMBOLS + left_out, np.uint64)
                    for k in range(a, b):
                        if k != left_out:
                            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + symbols[:, k])
                    keys.append(key.view("i8"))
            left_out = np.repeat(np.arange(SYMBOLS, dtype="i2"), len(reps))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(left_out), pa.array(np.tile(reps, len(keys)))], names=["key", "left_out", "rep"]
            )

    return reps.select("rep", "signature").mapInArrow(run, "key long, left_out short, rep long")


def _plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and parity sketches allow a link."""
    side = reps.select("rep", "n_shingles", "parity")
    joined = pairs.join(side.toDF("a", "n_a", "p_a"), "a").join(side.toDF("b", "n_b", "p_b"), "b")

    def run(it):
        for batch in it:
            a, b, n_a, p_a, n_b, p_b = (batch.column(k) for k in range(6))
            n_a, n_b = n_a.to_numpy(zero_copy_only=False), n_b.to_numpy(zero_copy_only=False)
            differ = np.zeros(batch.num_rows, "i8")
            for k, (x, y) in enumerate(zip(p_a, p_b)):
                x, y = np.frombuffer(x.as_buffer(), "u1"), np.frombuffer(y.as_buffer(), "u1")
                size = min(len(x), len(y))
                differ[k] = np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()
            keep = pa.array(may_link(n_a, n_b, differ, percent))
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    sized = joined.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return sized.select("a", "b", "n_a", "p_a", "n_b", "p_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int, key: str, text: str) -> DataFrame:
    """The pairs that are links: 100 * intersection >= percent * union of the full sets. ``pairs`` is a table."""
    ids = settle(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "near-ids")
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)  # at most BROADCAST_IDS numbers; beyond, a join by shuffle
    rows = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text")).join(ids, "rep", "left_semi")

    def read(it):
        shingler = Shingler(width)
        return batches(((r, shingler(t.as_py()).tobytes()) for b in it for r, t in zip(b.column(0).to_pylist(), b.column(1))), SETS, 256)

    sets = settle(in_small_batches(rows).mapInArrow(read, "rep long, shingles binary").dropDuplicates(["rep"]), "near-sets")

    def compare(it):
        for batch in it:
            a, b, left, right = (batch.column(k) for k in range(4))
            keep = []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    joined = pairs.join(sets.toDF("a", "s_a"), "a").join(sets.toDF("b", "s_b"), "b")
    return joined.select("a", "b", "s_a", "s_b").mapInArrow(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each node of ``links`` (a, b), root being the least node it reaches.

    Large-star and small-star steps alternate until nothing changes. Each finds the least neighbour by an aggregate with
    map-side combining and joins it back on the node; only a count and a checksum of the links reach the driver.
    """
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    checksum = ("count(*) as n", "sum(cast(xxhash64(a, b) as decimal(38, 0))) as s")
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    now, before = edges.selectExpr(*checksum).first(), None
    while now != before:
        around = edges.select(F.explode(F.array(pair("a", "b"), pair("b", "a"))).alias("e")).select("e.*")
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array(pair("a", "m"), pair("b", "m"))).alias("e")).select("e.*")
        edges = settle(small.where("a <> b").distinct(), "star")
        now, before = edges.selectExpr(*checksum).first(), now
    return edges.toDF("node", "root").union(edges.select("b", "b").distinct())


def block_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different roots within a key that the parity sketches allow.

    ``members`` has key, left_out, members (their number), rep, root, n_shingles, parity and signature. A key's members are
    dealt to blocks of about ``BLOCK``; a task meets two blocks at a time. Of the keys that a pair shares only the first
    emits it.
    """
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.expr("pmod(xxhash64(rep), blocks)").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    kept = ["block", "rep", "root", "n_shingles", "parity", "signature", "left_out"]
    met = dealt.select("key", *kept, other.alias("other"))
    met = met.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *kept)

    def run(it):
        held, name = [], None
        for batch in it:
            names = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(3, 10))))
            for own, row in zip(names, rows):
                if own != name:
                    if len(held) > 1:
                        yield from met_pairs(held, percent, name[1] != name[2])
                    held, name = [], own
                held.append(row)
        if len(held) > 1:
            yield from met_pairs(held, percent, name[1] != name[2])

    return met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def met_pairs(rows: list[tuple], percent: int, across: bool):
    """Allowed pairs among rows (block, rep, root, size, parity, signature, left out); ``across`` asks for different blocks."""
    block, rep, root, size = (np.array([r[k] for r in rows]) for k in range(4))
    width = np.array([len(r[4]) for r in rows])
    signatures = np.frombuffer(b"".join([r[5] for r in rows]), "<u2").reshape(-1, SYMBOLS)
    for w in np.unique(width):
        wide = np.flatnonzero(width >= w)
        sketch = np.stack([folded(np.frombuffer(rows[k][4], "u1"), w) for k in wide]).view("u8")
        for at in np.flatnonzero(width[wide] == w):
            x = wide[at]
            ok = (root[wide] != root[x]) & ((width[wide] > w) | (wide > x))
            if across:
                ok &= block[wide] != block[x]
            ok = np.flatnonzero(ok & may_link(size[wide], size[x], 0, percent))
            if not len(ok):
                continue
            differ = np.bitwise_count(sketch[ok] ^ sketch[at]).sum(1, dtype="i8")
            y = wide[ok[may_link(size[wide[ok]], size[x], differ, percent)]]
            y = y[first_shared(signatures[y], signatures[x][None]) == rows[x][6]]
            if len(y):
                other = np.full(len(y), rep[x])
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(rep[y], other)), pa.array(np.minimum(rep[y], other))], names=["a", "b"])


def near_dedup(docs: DataFrame, width=5, percent=80, key="doc_id", text="text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if their sets of ``width``-word shingles reach ``percent`` / 100 Jaccard similarity; a
    component's id is its least doc_id, and the document with that id is the one kept. A null or wordless text has the
    empty set and is linked with nothing; so is a row without id, whose component_id is null and which is kept. Rows with
    equal sets are always linked. Rows that repeat an id and have different texts are different documents of one label:
    each is linked by its own text, and each whose id is the component's is kept. An empty table gives no rows; other
    columns are ignored.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return _near_dedup(rows, width, percent)
    # Rows get numbers that follow their ids, so that a component's least row has its least id.
    order = [F.col("doc_id"), F.xxhash64("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions("doc_id").withColumn("_row", F.monotonically_increasing_id())
    placed = settle(placed, "near-rows").withColumn("_node", F.when(F.col("doc_id").isNotNull(), F.col("_row")))
    found = _near_dedup(placed.select(F.col("_node").alias("doc_id"), "text"), width, percent)
    numbered = found.where("doc_id is not null").select(F.col("doc_id").alias("_node"), "n_shingles", F.col("component_id").alias("_root"))
    labels = placed.where("doc_id is not null").select("doc_id", "_node")
    roots = numbered.select(F.col("_root")).distinct().join(labels.select(F.col("_node").alias("_root"), F.col("doc_id").alias("component_id")), "_root")
    with_id = labels.join(numbered, "_node").join(roots, "_root")
    with_id = with_id.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    return with_id.union(found.where("doc_id is null"))


def _near_dedup(docs: DataFrame, width: int, percent: int, key="doc_id", text="text") -> DataFrame:
    """:func:`near_dedup` of rows whose ids are different or null."""
    found = settle(sketches(docs, width, key, text), "near-sketches")
    least = F.min(F.struct("doc_id", "n_shingles", "signature", "parity")).alias("r")
    some = found.where("doc_id is not null and n_shingles > 0").groupBy("set_id").agg(least)
    reps = settle(some.select("set_id", F.col("r.doc_id").alias("rep"), "r.n_shingles", "r.signature", "r.parity"), "near-reps")

    keys = settle(chunk_keys(reps), "near-keys")
    stars = keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("members"))
    members = settle(keys.join(stars.where("low <> high"), "key"), "near-members")
    ends = F.explode(F.array("low", "high")).alias("end")
    paired = members.select("rep", ends).where("rep <> end")
    paired = paired.select(F.greatest("rep", "end").alias("a"), F.least("rep", "end").alias("b")).distinct()
    near = settle(_plausible(paired, reps, percent), "near-pairs")
    links = settle(confirmed(near, docs, width, percent, key, text), "near-links")
    roots = settle(components(links), "near-roots")

    # Of up to three members, all pairs are star pairs.
    large = members.where("members > 3").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    large = large.select("key", "left_out", "members", "rep", F.coalesce("root", "rep").alias("root"))
    split = large.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("key")
    rest = large.join(split, "key").join(reps.select("rep", "n_shingles", "parity", "signature"), "rep")
    crossed = settle(block_pairs(rest, percent), "near-crossed")
    more = confirmed(crossed, docs, width, percent, key, text)
    roots = components(roots.toDF("a", "b").union(more))

    of_set = reps.select("set_id", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    of_set = of_set.select("set_id", F.coalesce("root", "rep").alias("root"))
    return found.select("doc_id", "n_shingles", "set_id").join(of_set, "set_id", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("root", "doc_id"), F.lit(True)).alias("kept"),
    )

"""Prefix tries against plain dictionaries of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from excerpta.llm import prefix_trie, queries


def brute(convs):
    """Node facts by prefix of {id: [(role, text)]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, total = [], {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        below = [total[q] for q in children[p]]
        total[p] = (sum(n for n, _ in below) or 1, saved + sum(s for _, s in below))
        digest = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        parent = min(members[p[:-1]]) if p else None
        out.append((min(members[p]), len(p), parent, len(members[p]), len(children[p]), *total[p], digest))
    return sorted(out, key=repr)


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5 if c >= 0 else c + -c % 5, [])[:h] + own[h:]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int").repartition(3)


def query(spark, rows, tmp_path):
    table(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return sorted((tuple(r) for r in queries.op12_prefix_trie(spark, str(tmp_path)).collect()), key=repr)


@pytest.mark.parametrize("segment, rows_of_shard", [(1024, 200_000), (3, 10)])
def test_trie_query_against_brute_force(spark, tmp_path, monkeypatch, segment, rows_of_shard):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", rows_of_shard)
    monkeypatch.setattr(prefix_trie, "FRAGMENT_IDS", 3)
    rng = random.Random(3)
    convs = {}
    for c in [*range(-7, 40), 101, 102, 1003]:
        size = rng.choice([0, 1, 2, 5, 9, 14]) if c != 12 else 40
        convs[c] = [(rng.choice(["user", ""]), rng.choice(["a", "é" * 40, ""])) for _ in range(size)]
    convs = {c: t for c, t in convs.items() if t}
    rows = [(c, None if n == 0 else n, r or None, t or None, 1) for c, turns in convs.items() for n, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    assert query(spark, rows, tmp_path) == brute(rebuilt(convs))


def test_trie_of_copies_ties_and_rows_without_id(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FRAGMENT_IDS", 4)
    rows = [(5 * c, n, "user", "hot " * 30, 1) for c in range(60) for n in range(2)]
    rows += [(None, 1, "user", "no id", 1), (300, 1, "a", "tie", 1), (300, 1, "b", "tie", 1), (300, 1, "a", "tie", 1)]
    convs = {5 * c: [("user", "hot " * 30)] * 2 for c in range(60)} | {300: [("a", "tie"), ("a", "tie"), ("b", "tie")]}
    got = query(spark, rows, tmp_path)
    assert got == brute(rebuilt(convs)) and len(got) == 6
    assert query(spark, [], tmp_path) == [] and query(spark, [(None, 1, "user", "x", 1)], tmp_path) == []
    # Conversation 7 keeps none of its turns, as its source is missing.
    assert zlib.crc32(b"7") % 9 >= 1 and query(spark, [(7, 0, "user", "x", 1)], tmp_path) == brute({7: []})


def test_slots_are_minimal_perfect_and_verified():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(0, 2**63, 5000, dtype="u8"), rng.integers(0, 4, 5000, dtype="u8")
    hi, lo = np.concatenate([hi, hi[:100]]), np.concatenate([lo, lo[:100]])
    found = prefix_trie.SlotTable(hi, lo)
    slots = found.slots(hi, lo)
    assert len(found) == 5000 and sorted(set(slots)) == list(range(5000)) and (slots[:100] == slots[-100:]).all()
    assert (found.slots(hi, lo + np.uint64(9)) == -1).all() and len(prefix_trie.SlotTable(hi[:0], lo[:0])) == 0


def test_prefixes_that_share_a_digest_are_refused():
    names = ("hi", "lo", "parent_hi", "parent_lo", "depth", "mark", "last_bytes")
    rows = {n: np.array([1, 1]) for n in names}
    prefix_trie.NodeTable(rows)
    with pytest.raises(ValueError):
        prefix_trie.NodeTable(rows | {"mark": np.array([1, 2])})

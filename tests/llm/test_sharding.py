"""Histogram sort against a sorted list cut at the nearest row boundaries."""

import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from excerpta.llm import queries, sharding
from tests.llm import helpers


def cut(sizes, shards):
    """Shard of each row of a sorted list: each splitter is the row boundary nearest to its target, the lower of two."""
    bounds = [0]
    for s in sizes:
        bounds.append(bounds[-1] + s)
    total = bounds[-1]
    firsts = [min(range(len(bounds)), key=lambda k: (abs(bounds[k] - total * j / shards), k)) for j in range(1, shards)]
    return [sum(f <= n for f in firsts) for n in range(len(sizes))]


def placed(docs, **options):
    keys = sharding.keyed(docs).select("row.doc_id", "row.text", *sharding.KEYS, "_size").collect()
    keys.sort(key=lambda r: (r["_k1"], r["_k2"], r["_k3"]))
    got = sharding.histogram_sort(docs, **options).select("row.doc_id", "row.text", "size", "shard", "slot").collect()
    return keys, sorted(got, key=lambda r: (r.shard, r.slot))


@pytest.mark.parametrize("probes", [(4096, 8192), (3, 8)])
def test_shards_of_documents_are_cut_at_the_nearest_rows(spark, sf, monkeypatch, probes):
    monkeypatch.setattr(sharding, "FIRST_PROBES", probes[0])
    monkeypatch.setattr(sharding, "PROBES", probes[1])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    keys, got = placed(docs, shards=16, tolerance=0)
    assert [r.doc_id for r in got] == [r.doc_id for r in keys]
    assert [r.shard for r in got] == cut([r["_size"] for r in keys], 16)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(s == list(range(len(s))) for s in slots.values())


def test_hot_text_repeated_rows_and_ranges_within_shards(spark):
    rows = [(n, "hot " * 5) for n in range(300)] + [(7, "same row")] * 300 + [(None, None)] * 40 + [(n, f"text {n}") for n in range(260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keys, got = placed(docs, shards=5, range_bytes=300, tolerance=0)
    assert len(got) == 900 and helpers.copies((r.doc_id, r.text) for r in got) == helpers.copies(rows)
    size = defaultdict(int)
    for r in got:
        assert r.size == len(r.text or "") + 1
        size[r.shard] += r.size
    assert max(size.values()) - min(size.values()) <= 2 * max(r.size for r in got) and len(size) == 5
    for shard in size:
        assert [r.slot for r in got if r.shard == shard] == list(range(sum(r.shard == shard for r in got)))
    runs = [a.text for a, b in zip(got, got[1:] + [None]) if b is None or a.text != b.text]
    assert len(runs) == len(set(runs))  # copies are neighbours


def test_sharding_edges(spark, tmp_path):
    edges = helpers.edge_table(spark).withColumn("shard", F.lit("x")).withColumn("slot", F.lit(0.5))
    got = sharding.histogram_sort(edges, shards=4)
    rows = got.select("row.doc_id", "row.text", "row.keep_id", "size", "shard", "slot").collect()
    assert helpers.copies((r.doc_id, r.text) for r in rows) == helpers.copies(helpers.EDGES)
    assert all(r.size == len((r.text or "").encode()) + 1 and r.keep_id == "keep" for r in rows)
    sharding.write_shards(got, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == len(rows) and {r[0] for r in back.select("shard").distinct().collect()} <= set(range(4))
    assert sharding.histogram_sort(helpers.empty_table(spark)).collect() == []
    one = sharding.histogram_sort(edges.limit(1), shards=16).collect()
    assert len(one) == 1 and one[0].slot == 0
    with pytest.raises(ValueError):
        sharding.histogram_sort(edges, shards=0)


def test_sharding_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op11_histogram_sort(spark, sf)
    plan = got._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExistingRDD"))
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert all(r.size == len((docs[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((docs[r.doc_id] or "").encode()) for r in rows)

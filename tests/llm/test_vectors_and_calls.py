"""Top-k search, tool calls and the pipeline."""

import json
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from excerpta.llm import queries, tool_calls, topk
from tests.llm import helpers


def brute(rows, k, every):
    import math

    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and len(v) == 3]
    out = set()
    for q, v in {i: min(x for j, x in good if j == i) for i, _ in good if i % every == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)}
    return out


@pytest.mark.parametrize("bins", [1024, 5])
def test_topk_with_ties_and_bad_vectors(spark, monkeypatch, bins):
    monkeypatch.setattr(topk, "BINS", bins)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 30)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = random.Random(6)
    rows = [(n, [rng.choice([-1.0, 0.0, 0.5, 0.51]) for _ in range(3)]) for n in range(150)]
    rows += [(200 + n, [0.5, 0.5, 0.5]) for n in range(60)] + [(10, rows[10][1]), (7, rows[7][1])]
    rows += [(None, [1.0] * 3), (300, None), (310, [1.0, None, 1.0]), (320, [float("nan"), 1.0, 1.0]), (330, [float("inf")] * 3), (340, []), (350, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(3)
    got = [tuple(r) for r in topk.nearest(df, F.col("vec_id") % 10 == 0, k=7).collect()]
    assert len(got) == len(set(got)) or bins  # repeated candidates take a rank each
    assert {(q, n, i, s) for q, n, i, s in got} == brute(rows, 7, 10)


def test_topk_meets_vectors_of_the_same_length(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 4)
    rows = [(n, [1.0 * (n % 7)] * (3 if n % 3 else 2)) for n in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = [tuple(r) for r in topk.nearest(df, F.col("vec_id") % 10 == 0, k=5).collect()]
    want = set()
    for q, v in rows[::10]:
        scored = sorted((-sum(64 * a * 64 * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:5]
        want |= {(q, n, i, -int(s)) for n, (s, i) in enumerate(scored, 1)}
    assert len(got) == 20 and set(got) == want


def test_topk_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.nearest(df, F.col("vec_id") == 0, k=20).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.nearest(df.limit(0), F.col("vec_id") == 0, k=20).collect() == []


CALLS = "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>, status string"
SCHEMAS = {"add": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "maximum": 9}, "b": {"type": "array", "items": {"type": "string"}}}}}


def linked(spark, calls, results):
    c = spark.createDataFrame([(*row, "x") for row in calls], CALLS)
    r = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string")
    return {(x.conv_id, x.call_id): x for x in tool_calls.link_tool_calls(c, r, SCHEMAS).collect()}


def test_tool_calls_are_linked_ordered_and_checked(spark):
    got = linked(
        spark,
        [
            (1, "b", 5, "add", '{"b": ["x"], "a": 1.0}', ["a"]), (1, "a", 1, "add", '{"a": 10}', None), (1, "a", 1, "add", '{"a": 10}', None),
            (2, "late", 1, "add", '{"a": 2, "c": 0}', ["early"]), (2, "early", 4, "add", "{", ["nowhere"]), (2, "last", 9, "add", '{"b": [1]}', ["late"]),
            (3, "x", 1, "add", '{"a": 1}', ["y"]), (3, "y", 2, "nope", "{}", ["x"]), (3, "z", 3, "add", '{"a": NaN}', ["y"]),
            (None, "n", 1, "add", "{}", None), (4, None, 1, "add", "{}", None), (5, "q", None, "add", None, None),
        ],
        [(1, "b", 8, "later"), (1, "b", 7, "é\n"), (9, "gone", 1, None), (2, "early", 5, "ok"), (None, "n", 2, "z")],
    )
    assert set(got) == {(1, "a"), (1, "b"), (2, "late"), (2, "early"), (2, "last"), (3, "x"), (3, "y"), (3, "z"), (5, "q"), (9, "gone")}
    assert [got[1, c].position for c in "ab"] == [0, 1] and [got[2, c].position for c in ("early", "late", "last")] == [0, 1, 2]
    assert {got[3, c].status for c in "xyz"} == {"cyclic"} and got[3, "x"].position is None
    assert got[1, "b"].status == "linked" and got[1, "b"].result_turn == 7 and got[1, "b"].valid
    assert got[1, "b"].message == '{"arguments":{"a":1.0,"b":["x"]},"id":"b","name":"add","result":"é\\n","status":"linked"}'
    assert got[1, "a"].status == "unanswered" and got[1, "a"].faults == "a is out of range"
    assert got[2, "late"].faults == "c is unknown" and got[2, "early"].faults == "arguments are no JSON"
    assert got[2, "last"].faults == "a is missing; b[0] is no string" and got[3, "y"].faults == "the tool is unknown"
    assert got[9, "gone"].status == "orphan" and got[9, "gone"].valid is None and got[5, "q"].position == 0
    assert all(json.loads(r.message)["id"] == c for (_, c), r in got.items())
    assert linked(spark, [], []) == {}


@pytest.mark.parametrize("limit", [100_000, 3])
def test_tool_calls_in_any_order_of_turns(spark, monkeypatch, limit):
    monkeypatch.setattr(tool_calls, "SORTED_ROWS", limit)
    rng = random.Random(5)
    calls = []
    for conv in range(12):
        names = [f"c{n}" for n in range(rng.randint(1, 7))]
        for turn, name in enumerate(names):
            calls.append((conv, name, turn, "add", '{"a": 1}', rng.sample(names, rng.randint(0, min(2, len(names) - 1))) + ["nowhere"]))
    got = linked(spark, calls, [])
    for conv in range(12):
        own = {c[1]: (c[2], [n for n in c[5] if n != "nowhere"]) for c in calls if c[0] == conv}
        placed, order = [], {}
        bent = any(own[n][0] >= turn for turn, needs in own.values() for n in needs)
        level = 0
        while now := [c for c in own if c not in order and all(n in order for n in own[c][1])]:
            order |= {c: level for c in now}
            level += 1
        placed = sorted(order, key=lambda c: (order[c] if bent else 0, own[c][0]))
        assert {c: got[conv, c].position for c in own} == {c: placed.index(c) if c in placed else None for c in own}
        assert all((got[conv, c].status == "cyclic") == (c not in placed) for c in own)


def test_tool_calls_with_lone_surrogates(spark):
    got = linked(spark, [(1, "s", 1, "add", '{"a": 1, "b": ["\\ud800"], "\\udfff": 2}', None)], [(1, "s", 2, "ok")])[1, "s"]
    assert got.faults == "\\udfff is unknown" and json.loads(got.message)["arguments"] == {"a": 1, "b": ["\ud800"], "\udfff": 2}


def test_pipeline_stages_on_edge_tables(spark):
    for docs in (helpers.edge_table(spark), helpers.empty_table(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "nowhere")
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "nowhere").count() >= docs.count()


def test_pipeline_decides_by_row(spark):
    a, b, c, d = (" ".join(f"{w}{n}" for n in range(60)) for w in "abcd")
    near = lambda t: t + " more"
    rows = [(5, a), (5, b), (3, b), (7, c), (7, c), (7, c), (None, a), (None, d), (None, d), (8, near(a)), (8, "alone"), (None, near(c)), (2, "x y"), (2, "x  y")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    stages = dict(corpus_pipeline.STAGES)
    one = queries_settled(stages["exact_dedup"](spark, docs, "nowhere"))
    got = helpers.copies((r.doc_id, " ".join(r.text.split())) for r in one.collect())
    assert got == helpers.copies([(5, a), (3, b), (7, c), (None, d), (8, near(a)), (8, "alone"), (None, near(c)), (2, "x y")])
    two = stages["minhash_near_dedup"](spark, one, "nowhere")
    assert two.columns == docs.columns
    got = helpers.copies((r.doc_id, " ".join(r.text.split())) for r in two.collect())
    assert got == helpers.copies([(5, a), (3, b), (7, c), (None, d), (8, "alone"), (2, "x y")])


def test_pipeline_keeps_and_drops_what_it_should(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = queries_settled(stage(spark, docs, sf))
        after = {r.doc_id: r for r in out.collect()}
        texts = {i: r.text for i, r in before.items()}
        if name == "language_id":
            assert all(any(c.isalpha() for c in (texts[i] or "")) for i in after)
            assert len(after) >= 0.98 * sum(any(c.isalpha() for c in (t or "")) for t in texts.values())
        elif name == "exact_dedup":
            normal = lambda t: " ".join(t.split(" "))
            assert {normal(t) for t in texts.values()} >= {normal(r.text) for r in after.values()}
            assert len({r.text for r in after.values()}) == len(after)
        elif name == "minhash_near_dedup":
            assert set(after) == {i for i, root in helpers.linked(texts, 5).items() if i == root}
        else:
            assert set(after) == set(before)
            for i, r in after.items():
                spans = helpers.base_spans(texts[i])
                assert not helpers.base_spans(r.text) and (spans or r.n_chars == before[i].n_chars)
        docs, before = out, after
    packed = corpus_pipeline.STAGES[4][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == set(before)


def queries_settled(df):
    from excerpta.llm.common import settle

    return settle(df, "stage")


def test_run_equals_its_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert set(queries.QUERIES) >= {"op2_exact_topk"}

"""Operators on small fixtures, against plain Python or stated results."""

import random
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from excerpta.functions import classify, identity, text as tx, vectors as vec
from excerpta.operators import audit, chunking, evaluate, members, navigation, objects, rerank, vectors
from excerpta.plans import versions
from excerpta.schemas import asset_rows, chunk_rows, document_rows
from excerpta.sources import metrics, uploads
from excerpta.streaming import connection
from tests import offline


def prepared(spark, texts):
    rows = [(f"{i}.md", t) for i, t in enumerate(texts)]
    return chunking.markdown_documents(spark.createDataFrame(rows, "source_name string, content_text string"))


def expected_chunks(body):
    """The stated chunking rules, line by line, for plain text with headings."""
    import re

    out, room, path, start, last, parts = [], None, [], 0, 0, []

    def close():
        nonlocal parts
        if parts:
            out.append(("\n".join(parts), start, last, list(shown)))
        parts = []

    shown = []
    for number, raw in enumerate(body.splitlines(), 1):
        mark = re.match(r"(#{1,6})\s+(.+?)\s*$", raw)
        if mark:
            close()
            title = " ".join(mark.group(2).split()) or "Untitled section"
            path = path[: len(mark.group(1)) - 1] + [title]
            shown, start, parts, last = path, number, [title], number
            continue
        line = re.sub(r"[\t ]+", " ", raw).strip()
        if len(line) > 1200:
            close()
            shown = path
            for at in range(0, len(line), 1200):
                if line[at:at + 1200].strip():
                    out.append((line[at:at + 1200].strip(), number, number, list(path)))
        elif line:
            if parts and len("\n".join(parts)) + 1 + len(line) > 1200:
                close()
            if not parts:
                start, shown = number, path
            parts.append(line)
            last = number
    close()
    return out


def test_chunking_equals_the_line_by_line_rules(spark):
    source = random.Random(7)
    pieces = ["# One", "## Two  ", "#### Deep\tname", "#no heading", "#   ", "", "  ", "word " * 30, "x" * 1200, "y" * 1201,
              ("z " * 900) + "end", "a\tb  c", "é" * 700, "tail\x0bbroken line", "####### seven"]
    texts = ["\n".join(source.choice(pieces) for _ in range(source.randint(1, 25))) for _ in range(60)]
    made = prepared(spark, texts)
    rows = chunking.explode_chunks(made, "source_name").orderBy("source_name", "ordinal").collect()
    got = {}
    for row in rows:
        got.setdefault(row["source_name"], []).append(
            (row["chunk_text"], row["source_line_start"], row["source_line_end"], list(row["heading_path"]))
        )
    for i, body in enumerate(texts):
        assert got.get(f"{i}.md", []) == expected_chunks(body), body


def test_titles_and_refusals(spark):
    rows = prepared(spark, ["text only", "## Sub\n# Main  title\n", " \n--\n", "\n"]).collect()
    by = {r["source_name"]: (r["title"], r["import_status"]) for r in rows}
    assert by == {"0.md": ("0", "ok"), "1.md": ("Main title", "ok"), "2.md": ("2", "no_text"), "3.md": ("3", "no_text")}


def test_pdf_pages(spark):
    rows = [("p.pdf", "ab" * 32, 10, ["page one text", "", "x" * 1300], "Title")]
    made = chunking.pdf_documents(
        spark.createDataFrame(rows, "source_name string, source_sha256 string, byte_size long, units array<string>, pdf_title string")
    )
    chunks = chunking.explode_chunks(made).orderBy("ordinal").collect()
    assert [(c["ordinal"], c["pdf_page_start"], c["anchor_label"], len(c["chunk_text"])) for c in chunks] == [
        (1, 1, "PDF page 1", 13), (2, 3, "PDF page 3", 1200), (3, 3, "PDF page 3", 100),
    ]
    assert made.first()["title"] == "Title"


def test_running_offset_over_blocks(spark):
    rows = [("hot", i, i % 3) for i in range(500)] + [("cold", i, 1) for i in range(5)]
    frame = spark.createDataFrame(rows, "k string, p long, n int")
    got = {(r["k"], r["p"]): r["_offset"] for r in chunking.running_offset(frame, "k", "p", "n", block=16).collect()}
    total = 0
    for i in range(500):
        assert got[("hot", i)] == total
        total += i % 3
    assert got[("cold", 4)] == 4


def test_json_strings_equal_python(spark):
    samples = ['a"b\\c/é\n\t', "".join(map(chr, range(40))), "配 ", ""]
    frame = spark.createDataFrame([(s,) for s in samples], "s string")
    assert [r[0] for r in frame.select(identity.json_string("s")).collect()] == [identity.canonical_json(s) for s in samples]


@pytest.mark.parametrize("size", [1, 7, 3000])
def test_corpus_digest_is_one_tree_at_every_size(spark, size):
    import hashlib

    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    # Ids with few leading digits put many members in one leaf.
    rows = [(f"doc_{i % 5:06x}{sha(str(i))[:18]}", f"{i}.md", "s" * 64) for i in range(size)]
    frame = spark.createDataFrame(rows, "document_id string, source_name string, source_sha256 string")
    leaves, nodes = {}, {}
    for d, n, s in sorted(rows):
        leaves.setdefault(d[4:10], []).append({"document_id": d, "source_name": n, "source_sha256": s})
    for leaf in sorted(leaves):
        nodes.setdefault(leaf[:3], []).append(sha(identity.canonical_json(leaves[leaf])))
    want = sha("".join(sha("".join(nodes[n])) for n in sorted(nodes)))
    got = identity.corpus_digest(frame).first()
    assert (got["members"], got["corpus_sha256"]) == (size, want)


def test_sections_recur_and_budget(spark):
    made = prepared(spark, ["# A\none\n# B\n" + "w" * 1000 + "\n" + "v" * 900 + "\n# A\nthree"])
    chunks = chunking.explode_chunks(made).withColumn("material_type", F.lit("markdown"))
    rows = navigation.toc(chunks, F.lit("l"), F.lit("s"), 2).orderBy("section_no").collect()
    assert [r["heading_path"] for r in rows] == [["A"], ["B"]] and rows[0]["truncated"]
    assert len({r["section_id"] for r in navigation.sections(chunks, F.lit("l"), F.lit("s")).collect()}) == 3
    read = navigation.read_section(chunks, 1100, ).orderBy("ordinal").collect()
    assert [(r["section_no"], r["taken_chars"]) for r in read] == [(1, 5), (2, 1002), (2, 98), (3, 7)]


def test_difference_needs_unique_names(spark):
    schema = "document_id string, source_name string"
    base = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z"), ("d", "z")], schema)
    now = spark.createDataFrame([("a", "x"), ("b2", "y"), ("c2", "z"), ("e", "w")], schema)
    got = sorted((r["change"], r["document_id"] or "", r["base_document_id"] or "") for r in members.difference(now, base).collect())
    assert got == [
        ("added", "c2", ""), ("added", "e", ""), ("inherited", "a", "a"), ("removed", "", "c"), ("removed", "", "d"),
        ("replaced", "b2", "b"),
    ]
    counts = members.difference_counts(members.difference(now, base)).first().asDict()
    assert counts == {"added": 2, "inherited": 1, "replaced": 1, "removed": 2}


def test_created_flag_goes_to_the_first_reference(spark):
    refs = spark.createDataFrame(
        [("d1", "source", "s1", 5), ("d2", "source", "s1", 5), ("d3", "source", "s2", 7)],
        "document_id string, kind string, sha256 string, byte_size long",
    )
    flags = {r["document_id"]: r["created_in_snapshot"] for r in objects.mark_created(refs).collect()}
    assert flags == {"d1": True, "d2": False, "d3": True}
    known = refs.filter("document_id = 'd3'")
    stats = objects.storage_stats(objects.mark_created(refs, known)).first().asDict()
    assert stats == {"object_references": 3, "new_objects": 1, "reused_objects": 2, "logical_object_bytes": 17,
                     "new_object_bytes": 5, "reused_object_bytes": 12}


def test_object_layers_change_only_downstream(spark):
    made = prepared(spark, ["# A\ntext"])
    plain = {r["kind"]: r["sha256"] for r in objects.object_payloads(made).collect()}
    own = objects.STEPS["text/markdown"]
    layers = lambda **new: {
        r["kind"]: r["sha256"] for r in objects.object_payloads(made, steps={"text/markdown": {**own, **new}}).collect()
    }
    changed, again = layers(chunker="another"), layers(parser="another")
    assert plain["source"] == changed["source"] and plain["parsed"] == changed["parsed"] and plain["chunks"] != changed["chunks"]
    assert plain["source"] == again["source"] and plain["parsed"] != again["parsed"] and plain["chunks"] != again["chunks"]
    pdf = made.withColumn("media_type", F.lit("application/pdf"))
    other = {r["kind"]: r["payload"].decode() for r in objects.object_payloads(pdf).collect()}
    assert "pdf text layer" in other["parsed"] and "excerpta pages" in other["chunks"]


FAULTS = {
    "chunk_id_forged": ("chunk", "chunk_id", "concat('chunk_', repeat('0', 24))"),
    "chunk_blank": ("chunk", "chunk_text", "' '"),
    "chunk_too_long": ("chunk", "chunk_text", "repeat('x', 1201)"),
    "chunk_anchor_label": ("chunk", "anchor_label", "'elsewhere'"),
    "chunk_anchor_range": ("chunk", "source_line_start", "0"),
    "chunk_ordinal_gap": ("chunk", "ordinal", "ordinal + 1"),
    "chunk_owner_differs": ("chunk", "document_id", "'doc_x'"),
    "chunk_promoted": ("chunk", "fulltext_verified", "true"),
    "chunk_heading_path_invalid": ("chunk", "heading_path", "array(cast(null as string))"),
    "chunk_without_asset": ("chunk", "asset_id", "'asset_x'"),
    "document_source_type": ("document", "source_type", "'remote'"),
    "document_material_type": ("document", "material_type", "'other'"),
    "document_topics_invalid": ("document", "topics", "array(cast(null as string))"),
    "document_promoted": ("document", "formula_verified", "true"),
    "document_without_asset": ("asset", "document_id", "'doc_x'"),
}


def test_audit_names_each_fault(spark):
    made = prepared(spark, ["# A\ntext", "plain"]).cache()
    tables = {"document": document_rows(made), "asset": asset_rows(made), "chunk": chunk_rows(made)}
    assert audit.audit(*tables.values()).filter("violations > 0").count() == 0
    for check, (table, column, value) in FAULTS.items():
        broken = {**tables, table: tables[table].withColumn(column, F.expr(value))}
        found = {r["check"] for r in audit.audit(*broken.values()).filter("violations > 0").collect()}
        assert check in found, (check, found)


def test_serialized_columns(spark):
    rows = [('["a", "b"]', '{"k": "v"}'), ('["a", 1]', '{"k": 1}'), ("[", "[]"), ("{}", "nope")]
    frame = spark.createDataFrame(rows, "topics string, identifiers string")
    got = {r["check"]: r["violations"] for r in audit.serialized_rules(frame, lists=["topics"], maps=["identifiers"]).collect()}
    assert got == {"topics_not_string_list": 3, "identifiers_not_string_map": 3}


def test_catalog_rules(spark):
    def name(i):
        return f"20240101T00000000000{i}Z-{'0' * 12}-{'0' * 8}"

    schema = "position int, snapshot_id string, manifest_sha256 string, base_snapshot_id string"
    pointers = "current_snapshot_id string, last_successful_snapshot_id string"
    good = [(1, name(1), "a" * 64, None), (2, name(2), "b" * 64, name(1))]
    sound = audit.catalog_rules(spark.createDataFrame(good, schema), spark.createDataFrame([(name(1), name(2))], pointers))
    assert sound.filter("violations > 0").count() == 0
    bad = [(1, name(1), "a", name(2)), (2, name(2), "b" * 64, None), (3, name(2), "b" * 64, None)]
    found = audit.catalog_rules(spark.createDataFrame(bad, schema), spark.createDataFrame([("x", name(1))], pointers))
    assert {r["check"] for r in found.filter("violations > 0").collect()} == {
        "manifest_digest_format", "snapshot_repeated", "base_not_earlier", "current_unknown", "last_successful_wrong",
    }


def test_vectors(spark):
    profile = offline.profile()
    frame = spark.createDataFrame([(1, "text é"), (2, 'q"\n')], "i int, chunk_text string")
    got = {r["i"]: r["v"] for r in frame.select("i", vec.vector_object_id(profile, "chunk_text").alias("v")).collect()}
    import hashlib

    for i, body in ((1, "text é"), (2, 'q"\n')):
        want = hashlib.sha256(identity.canonical_json({"profile": profile, "text": body}).encode()).hexdigest()
        assert got[i] == "vec_" + want
    wide = spark.createDataFrame(
        [(1, [1e200, 0.0]), (2, [0.0, 0.0]), (3, [1e-200, 1e-200]), (4, [-1.0, 0.0]), (5, [2.0, 0.0])], "k int, v array<double>"
    )
    query = spark.createDataFrame([([3e150, 0.0],)], "q array<double>")
    best = [(r["k"], round(r["score"], 9)) for r in vectors.nearest(wide, query, 5, key="k", vector="v", query_vector="q").collect()]
    assert best == [(1, 1.0), (5, 1.0), (3, round(0.5 ** 0.5, 9)), (2, 0.0), (4, -1.0)]
    checks = wide.select(vec.is_valid_vector("v", 2)).distinct().collect()
    assert [r[0] for r in checks] == [True]


def test_candidate_budget(spark):
    rows = [(i, f"c{i}", 1.0, "x" * 700) for i in range(1, 13)]
    frame = spark.createDataFrame(rows, "rank int, chunk_id string, score double, chunk_text string")
    got = [r["candidate_chars"] for r in rerank.candidates(frame).orderBy("rank").collect()]
    assert got == [600] * 6 + [400]


def test_metrics_with_empty_denominators(spark):
    schema = ("case_id string, mode string, library_id string, snapshot_id string, expected_document_id string, "
              "target_chunk_id string, known_limitation boolean, traced boolean")
    cases = spark.createDataFrame([("1", "bm25", "l", "s", "d1", "c1", False, True), ("2", "bm25", "l", "s", "d2", "c2", True, False)], schema)
    results = spark.createDataFrame([("1", 1, "dx", "cx", ""), ("1", 2, "d1", "c1", "")], "case_id string, rank int, document_id string, chunk_id string, anchor_label string")
    owners = spark.createDataFrame([("l", "s", "d1"), ("l", "s", "dx")], "library_id string, snapshot_id string, document_id string")
    row = evaluate.metrics(evaluate.judge(cases, results, owners)).first().asDict()
    assert (row["positive_hit_at_k"], row["mrr"], row["applicable_positive_hit_at_k"]) == (0.5, 0.25, 1.0)
    assert row["true_empty_accuracy"] == 1.0 and row["traceability_coverage"] == 1.0 and row["contract_passed_case_count"] == 2


def test_markers(spark):
    docs = spark.createDataFrame([(1, "xx alpha beta gamma yy"), (2, "alpha beta gammas"), (3, "beta")], "k int, t string")
    items = spark.createDataFrame([("a", "alpha beta gamma"), ("b", "no such marker")], "i string, m string")
    found = evaluate.find_markers(items, docs, item="i", marker="m", key="k", text="t").collect()
    assert [tuple(r) for r in found] == [("a", 1)]
    # Markers without a word are compared with the texts themselves, block by block.
    docs = docs.union(spark.createDataFrame([(4, "a -- b ?!"), (0, None), (5, "-- ?!")], "k int, t string"))
    items = items.union(spark.createDataFrame([("c", "--"), ("d", "?!"), ("e", "--"), ("f", "@@"), ("g", None)], "i string, m string"))
    for block in (1000, 1):
        evaluate.WORDLESS_BLOCK = block
        found = evaluate.find_markers(items, docs, item="i", marker="m", key="k", text="t").collect()
        assert sorted(tuple(r) for r in found) == [("a", 1), ("c", 4), ("d", 4), ("e", 4)]
    evaluate.WORDLESS_BLOCK = 1000


def test_sets_are_reconciled_in_buckets(spark):
    left = spark.range(1000).selectExpr("id % 900 as k")
    right = spark.range(900).selectExpr("case when id in (5, 700) then 5 else id end as k").union(spark.createDataFrame([(5000,), (None,)], "k long"))
    for buckets in (1, 64):
        found = {r["k"]: (r["n_left"], r["n_right"]) for r in vectors.set_differences(left, right, "k", buckets=buckets).collect()}
        assert found == {**{k: (2, 1) for k in range(100) if k != 5}, 700: (1, 0), 5000: (0, 1), None: (0, 1)}


def test_vector_codec_by_batch(spark):
    rows = [(1, [1.5, -2.25]), (2, None), (3, []), (4, [float("inf"), 1e-310, -0.0]), (5, [1.0])]
    df = spark.createDataFrame(rows, "k int, v array<double>").repartition(2)
    got = {r["k"]: (r["p"], r["w"]) for r in df.withColumn("p", vec.encode_vector("v")).withColumn("w", vec.decode_vector("p")).collect()}
    assert got == {k: (None if v is None else struct.pack(f">{len(v)}d", *v), v) for k, v in rows}
    with pytest.raises(Exception, match="whole number of doubles"):
        spark.createDataFrame([(b"1234567",)], "p binary").select(vec.decode_vector("p")).collect()


def test_uploads(spark):
    rows = [("A.md", 5), ("a.MD", 5), ("bad/name.md", 5), ("x.txt", 5), ("big.pdf", 11 * 2**20), ("é.md", 1), ("é.md", 1)]
    row = uploads.batch_faults(spark.createDataFrame(rows, "name string, byte_size long")).first().asDict()
    assert (row["files"], row["colliding_names"], row["invalid_names"], row["oversize_files"]) == (7, 4, 2, 1)


def test_metric_lines(spark):
    lines = ["# HELP x", f"{metrics.LAST_POLL} 12.5", f'{metrics.LAST_POLL}{{a="b"}} 1e3', f"{metrics.LAST_POLL} NaN", "other 9e9", "broken"]
    frame = spark.createDataFrame([(line,) for line in lines], "value string")
    assert metrics.latest(frame).first()["latest"] == 1000.0
    assert metrics.samples(frame).count() == 3


LOG = [
    ("a", 1, '{"msg": "poll failed; backing off"}'),
    ("a", 2, '{"level": "ERROR"}'),
    ("a", 3, '{"msg": "poller recovered; polling operational"}'),
    ("b", 1, '{"status_code": 401}'),
    ("b", 2, '{"msg": "poll failed; backing off"}'),
    ("c", 1, "not json"),
    ("c", 2, '{"msg": "health server error"}'),
]


def test_connection_log(spark, tmp_path):
    frame = spark.createDataFrame(LOG, "connection_id string, line_no int, line string")
    got = {r["connection_id"]: (r["state"], r["failure"]) for r in connection.connection_states(frame).collect()}
    want = {"a": ("not_ready", None), "b": ("error", "auth_failed"), "c": ("error", "transport_failed")}
    assert got == want
    frame.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "log"))
    query = (
        connection.stream_connection_states(stream).writeStream.outputMode("update").format("memory").queryName("states")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert {r["connection_id"]: (r["state"], r["failure"]) for r in spark.table("states").collect()} == want


def test_provider_codes(spark):
    rows = [(401, 1), (429, 1), (404, 1), (503, 1), (None, 0), (None, 1)]
    got = [r[0] for r in spark.createDataFrame(rows, "s int, n int").select(classify.provider_code("s", "n")).collect()]
    assert got == ["authentication_failed", "rate_limited", "model_unavailable", "provider_unavailable",
                   "credential_unavailable", "connection_failed"]
    body = spark.createDataFrame([('{"usage": {"prompt_tokens": 3, "total_tokens": -1}}',)], "b string")
    assert body.select(classify.usage("b").alias("u")).select("u.*").first().asDict() == {
        "prompt_tokens": 3, "completion_tokens": None, "total_tokens": None,
    }


@pytest.mark.parametrize("name, stem", [("a.b.md", "a.b"), (".md", ".md"), ("plain", "plain")])
def test_file_stem(spark, name, stem):
    assert spark.range(1).select(tx.file_stem(F.lit(name))).first()[0] == stem


def test_markers_of_any_length(spark):
    texts = {1: "the quick brown fox jumps", 2: "a quick brown-fox", 3: "xquickbrownx", 4: "one quick brown fo", 5: "!!!"}
    markers = {10: "quick brown fox", 11: "ick bro", 12: "brown", 13: "uickb", 14: "fo", 15: "absent", 16: "no such words here", 17: "!!!", 18: ""}
    items = spark.createDataFrame(list(markers.items()), "i int, m string")
    docs = spark.createDataFrame(list(texts.items()), "k int, t string")
    got = dict(map(tuple, evaluate.find_markers(items, docs, item="i", marker="m", key="k", text="t").collect()))
    assert got == {i: min(k for k, t in texts.items() if m in t) for i, m in markers.items() if m and any(m in t for t in texts.values())}


def test_refused_queries_keep_a_status(spark):
    from excerpta.functions import query as q

    rows = [(1, "plain words"), (2, "x" * 401), (3, " \n"), (4, "?!"), (5, "bell \x07"), (6, None)]
    frame = spark.createDataFrame(rows, "i int, t string")
    assert [r[1] for r in frame.select("i", q.query_status("t")).orderBy("i").collect()] == [
        "asked", "refused", "refused", "empty", "refused", "refused",
    ]


def test_all_versions_are_audited_in_one_pass(spark, sf):
    documents, assets, chunks = versions._tables(spark, sf)
    first, second, *_ = [r["document_id"] for r in documents.select("document_id").orderBy("document_id").collect()]
    sizes = {r["document_id"]: r["count"] for r in chunks.groupBy("document_id").count().collect()}
    catalog = [("good", 2, sizes[first] + sizes[second]), ("torn", 2, sizes[first]), ("empty", 0, 0), ("gone", 1, 1), ("late", 1, sizes[second])]
    held = [("good", first), ("good", second), ("torn", first), ("torn", "doc_unknown"), ("late", second), ("unlisted", "doc_unknown")]
    members_ = spark.createDataFrame(held, "snapshot_id string, document_id string")
    listed = spark.createDataFrame(catalog, "snapshot_id string, documents long, chunks long")
    blank = F.when(F.col("document_id") == second, " ").otherwise(F.col("chunk_text"))

    def found(chunks, documents=documents, assets=assets):
        rows = audit.version_rules(listed, members_, documents, assets, chunks).collect()
        return {(r["snapshot_id"], r["check"]): r["violations"] for r in rows}

    sound = {(name, "sound"): 0 for name in ("good", "empty", "late")}
    faults = {("torn", "member_without_document"): 1, ("gone", "documents"): 1, ("gone", "chunks"): 1}
    assert found(chunks) == sound | faults
    n = sizes[second]
    shared = {(name, check): n for name in ("good", "late") for check in ("chunk_blank", "chunk_id_forged")}
    assert found(chunks.withColumn("chunk_text", blank)) == {("empty", "sound"): 0} | faults | shared
    twice = found(chunks, documents.unionByName(documents.filter(F.col("document_id") == first)))
    assert twice[("good", "document_repeated")] == 1 and twice[("late", "sound")] == 0
    bare = found(chunks.limit(0), documents.limit(0), assets.limit(0))
    assert bare[("good", "member_without_document")] == 2 and bare[("good", "chunks")] == 1 and bare[("empty", "sound")] == 0


def test_scoped_targets_cut_every_file_once(spark, sf):
    """Cases and chunks read files that were cut before they meet: no part of the plan cuts them again."""
    from excerpta.plans import semantic

    plan = semantic.scoped_targets(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan


def test_scoped_targets_pass_over_files_without_a_line(spark, tmp_path):
    """Files without text or of blank lines alone have no marker; the others keep their targets, as the SQL has them."""
    from excerpta.plans import semantic

    last = "This line stands last and is much longer than any heading of a file."
    texts = ["", None, "\n\n", "\n \t\n\n", f"{last[::-1]}\n{last}\n\n", "word " * 600]
    rows = [(at, text, "en", "web", 1) for at, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {tuple(row) for row in semantic.scoped_targets(spark, str(tmp_path)).collect()}
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        assert found == set(con.execute(semantic.ORACLES["eval_scoped_targets"]).fetchall())
    assert {case for case, _ in found} == {4, 5}

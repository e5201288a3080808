"""Snapshots, tools, vectors and the three-step search over real files."""

import pytest
from pyspark.sql import functions as F

from excerpta import tools as tool_module
from tests import offline
from excerpta.enhanced import EnhancedSearch, SearchPlan
from excerpta.errors import EnhancedSearchError, ImportPolicyError, LibraryRegistryError, SearchInputError, SnapshotError, VectorError
from excerpta.functions import vectors as vec
from excerpta.library import Library
from excerpta.registry import LibraryRegistry
from excerpta.tools import EvidenceTools, call_tool
from excerpta.vector_store import VectorStore

FILES = {
    "entropy.md": "# Information Measures\n\n## Entropy\n\nShannon entropy quantifies uncertainty in a probability distribution.\n",
    "grid.md": "# 配电网证据\n\n## 谐波监测\n\n配电网 谐波 监测 使用 电压 频谱 识别 非线性 负载。\n",
    "identifier.md": "# Calibration Record\n\n## Reference\n\nThe observation was found during review under identifier GRID-CAL-2048.\n",
    "distant-terms.md": "# Distant Terms\n\nNEBULA appears in an astronomy note. The code was NOT assigned. A sample was FOUND much later under row 999.\n",
    "tie-a.md": "# Equal Rank\n\ncalibrationmarker balanced evidence sentence\n",
    "tie-b.md": "# Equal Rank\n\ncalibrationmarker balanced evidence sentence\n",
}


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("world")
    paths = []
    for name, text in FILES.items():
        (root / name).write_text(text, encoding="utf-8")
        paths.append(str(root / name))
    registry = LibraryRegistry(spark, str(root / "app"))
    record = registry.create("First")
    library = registry.library(record["library_id"])
    first = library.build(paths)
    return {"root": root, "registry": registry, "library": library, "id": record["library_id"], "first": first,
            "tools": EvidenceTools(registry)}


def search(world, query, snapshot=None, **options):
    return world["tools"].search_documents(world["id"], snapshot or world["first"]["snapshot_id"], query, **options)


def test_question_finds_one_anchored_chunk(world):
    found = search(world, "What is Shannon entropy?")
    assert found["found"] and len(found["results"]) == 1
    hit = found["results"][0]
    assert hit["source_name"] == "entropy.md"
    assert hit["heading_path"] == ["Information Measures", "Entropy"]
    assert (hit["source_line_start"], hit["source_line_end"]) == (3, 5)
    assert hit["anchor_label"] == "Markdown lines 3-5 · Information Measures / Entropy"
    assert hit["pdf_page_start"] is None and hit["score"] < 0
    assert search(world, "Shannon,,, entropy!!!")["results"] == found["results"]


def test_cjk_ties_and_identifiers(world):
    assert search(world, "配电网 谐波 监测")["results"][0]["source_name"] == "grid.md"
    empty = search(world, "配电网谐波监测")
    assert empty["found"] is False and empty["input_hint"]
    assert search(world, "quasarxylophone")["results"] == []
    assert search(world, "PHANTOM-ALPHA-FOUND-777")["found"] is False
    assert search(world, "NEBULA-NOT-FOUND-999")["found"] is False
    assert search(world, "GRID-CAL-2048")["results"][0]["source_name"] == "identifier.md"
    ties = search(world, "calibrationmarker", top_k=10)["results"]
    assert len(ties) == 2 and ties[0]["score"] == ties[1]["score"]
    assert [t["chunk_id"] for t in ties] == sorted(t["chunk_id"] for t in ties)


def test_excerpts_toc_sections_and_metadata(world):
    tools, lib, snap = world["tools"], world["id"], world["first"]["snapshot_id"]
    hit = search(world, "Shannon entropy")["results"][0]
    doc = hit["document_id"]
    toc = tools.get_document_toc(lib, snap, doc)
    assert [i["heading_path"] for i in toc["items"]] == [["Information Measures"], ["Information Measures", "Entropy"]]
    assert toc["title"] == "Information Measures" and toc["truncated"] is False
    assert tools.get_document_toc(lib, snap, doc, max_items=1)["truncated"] is True
    read = tools.read_document_section(lib, snap, doc, toc["items"][1]["section_id"], max_chars=20)
    assert read["returned_chars"] == 20 and read["truncated"] and read["results"][0]["excerpt"] == "Entropy\nShannon entr"
    whole = tools.get_excerpt(lib, snap, doc, hit["chunk_id"])
    assert whole["truncated"] is False and whole["result"]["excerpt"].startswith("Entropy\nShannon")
    ids = [i["first_chunk_id"] for i in toc["items"]][::-1]
    assert [r["chunk_id"] for r in tools.get_multiple_excerpts(lib, snap, doc, ids)["results"]] == ids
    about = tools.get_document_metadata(lib, snap, doc)["document"]
    assert about["assets"][0]["chunk_count"] == 2 and about["identifiers"] == {} and about["language"] == "und"
    inside = tools.find_in_document(lib, snap, doc, "entropy")
    assert inside["found"] and inside["results"][0]["score"] == search(world, "entropy")["results"][0]["score"]
    assert tools.find_in_document(lib, snap, doc, "calibrationmarker")["found"] is False


def test_refused_requests(world):
    tools, lib, snap = world["tools"], world["id"], world["first"]["snapshot_id"]
    hit = search(world, "Shannon entropy")["results"][0]
    other = search(world, "GRID-CAL-2048")["results"][0]
    bad = [
        lambda: search(world, "x" * 401),
        lambda: search(world, "x" + " " * 400),
        lambda: search(world, 7),
        lambda: search(world, "a", top_k=0),
        lambda: search(world, "a", top_k=11),
        lambda: search(world, "a", top_k=True),
        lambda: search(world, "a", excerpt_chars=1201),
        lambda: search(world, "a", mode="other"),
        lambda: tools.get_excerpt(lib, snap, hit["document_id"], other["chunk_id"]),
        lambda: tools.get_excerpt(lib, snap, hit["document_id"], hit["chunk_id"], max_chars=0),
        lambda: tools.get_excerpt(lib, snap, hit["document_id"] + "0", hit["chunk_id"]),
        lambda: tools.get_multiple_excerpts(lib, snap, hit["document_id"], []),
        lambda: tools.get_multiple_excerpts(lib, snap, hit["document_id"], [hit["chunk_id"]] * 2),
        lambda: tools.get_document_toc(lib, snap, hit["document_id"], max_items=101),
        lambda: tools.find_in_document(lib, snap, "doc_" + "0" * 24, "entropy"),
        lambda: tools.read_document_section(lib, snap, hit["document_id"], "sec_" + "0" * 24),
        lambda: tools.retrieval_status(snapshot_id=snap),
    ]
    for request in bad:
        with pytest.raises(SearchInputError):
            request()
    assert call_tool(tools, "nothing")["error"]["code"] == "UNKNOWN_TOOL"
    assert call_tool(tools, "retrieval_status", {"x": 1})["error"]["code"] == "INVALID_INPUT"
    assert call_tool(tools, "get_excerpt", {})["error"]["code"] == "INVALID_INPUT"
    gone = {"library_id": lib, "snapshot_id": "20240101T000000000000Z-" + "0" * 12 + "-" + "0" * 8, "query": "a"}
    assert call_tool(tools, "search_documents", gone)["error"]["code"] == "SNAPSHOT"
    assert call_tool(tools, "search_documents", {**gone, "mode": "enhanced"})["error"]["code"] == "ENHANCED_UNAVAILABLE"
    assert set(tool_module.tool_schemas()) == set(tool_module.ARGUMENTS)


def _write(root, name, word):
    path = root / name
    path.write_text(f"# {word}\n\n{word} text\n", encoding="utf-8")
    return str(path)


def test_incremental_snapshots_pointers_and_differences(spark, tmp_path):
    registry = LibraryRegistry(spark, str(tmp_path / "app"))
    library = registry.library(registry.create("L")["library_id"])
    tools = EvidenceTools(registry)
    a, b, c = (_write(tmp_path, f"{n}.md", w) for n, w in (("A", "alphaunique"), ("B", "bravounique"), ("C", "charlieunique")))
    one = library.build([a, b])
    two = library.build([c], base_snapshot_id=one["snapshot_id"])
    assert {k: two["storage"][k] for k in ("object_references", "new_objects", "reused_objects")} == {
        "object_references": 9, "new_objects": 3, "reused_objects": 6,
    }
    ids = {r["source_name"]: r["document_id"] for r in library.snapshot_members(two["snapshot_id"]).collect()}
    _write(tmp_path, "B.md", "bravoreplacement")
    three = library.build([], base_snapshot_id=two["snapshot_id"], replacements={ids["B.md"]: b}, remove_document_ids=[ids["A.md"]])
    names = {r["source_name"] for r in library.snapshot_members(three["snapshot_id"]).collect()}
    assert names == {"B.md", "C.md"}
    status = library.catalog_status()
    assert status["current_snapshot_id"] == one["snapshot_id"] and status["last_successful_snapshot_id"] == three["snapshot_id"]
    changes = {(r["change"], r["source_name"]) for r in library.difference(three["snapshot_id"]).collect()}
    assert changes == {("inherited", "C.md"), ("replaced", "B.md"), ("removed", "A.md")}
    lib = library.library_id
    found = {s["snapshot_id"]: tools.search_documents(lib, s["snapshot_id"], "bravounique")["found"] for s in (one, two, three)}
    assert list(found.values()) == [True, True, False]
    assert tools.search_documents(lib, three["snapshot_id"], "bravoreplacement")["found"]
    assert tools.search_documents(lib, three["snapshot_id"], "alphaunique")["found"] is False
    library.activate(two["snapshot_id"])
    status = library.catalog_status()
    assert status["current_snapshot_id"] == two["snapshot_id"] and status["last_successful_snapshot_id"] == three["snapshot_id"]
    listed = library.list_snapshots()
    assert [s["snapshot_id"] for s in listed] == [three["snapshot_id"], two["snapshot_id"], one["snapshot_id"]]
    assert [s["current"] for s in listed] == [False, True, False]

    before = library.catalog()
    for request in (
        dict(sources=[a], base_snapshot_id=one["snapshot_id"]),
        dict(sources=[], remove_document_ids=[ids["A.md"]]),
        dict(sources=[], base_snapshot_id=three["snapshot_id"], remove_document_ids=[ids["A.md"]]),
        dict(sources=[], base_snapshot_id=one["snapshot_id"], remove_document_ids=[ids["A.md"]] * 2),
        dict(sources=[], base_snapshot_id=one["snapshot_id"], remove_document_ids=[ids["A.md"], ids["B.md"]]),
    ):
        with pytest.raises(ImportPolicyError):
            library.build(**request)
    assert library.catalog() == before


def test_refused_files(spark, tmp_path):
    registry = LibraryRegistry(spark, str(tmp_path / "app"))
    library = registry.library(registry.create("L")["library_id"])
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe text")
    (tmp_path / "repl.md").write_text("a � b", encoding="utf-8")
    (tmp_path / "blank.md").write_text(" \n\n", encoding="utf-8")
    (tmp_path / "x.txt").write_text("text", encoding="utf-8")
    for name in ("bad.md", "repl.md", "blank.md", "x.txt"):
        with pytest.raises(ImportPolicyError):
            library.build([str(tmp_path / name)])
    assert library.catalog()["snapshots"] == []


def test_tampering_is_found(spark, tmp_path):
    registry = LibraryRegistry(spark, str(tmp_path / "app"))
    library = registry.library(registry.create("L")["library_id"], verify_once=False)
    one = library.build([_write(tmp_path, "A.md", "alphaunique")])
    library.verify(one["snapshot_id"])
    path = library.folder.path("tables", "chunk", f"segment={one['snapshot_id']}")
    rows = spark.read.parquet(path).withColumn("chunk_text", F.concat("chunk_text", F.lit("!"))).collect()
    schema = spark.read.parquet(path).schema
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)
    with pytest.raises(SnapshotError, match="chunk_id_forged"):
        library.verify(one["snapshot_id"])
    assert library.list_snapshots()[0]["verified"] is False


def test_rebuild_is_deterministic(spark, tmp_path):
    registry = LibraryRegistry(spark, str(tmp_path / "app"))
    library = registry.library(registry.create("L")["library_id"])
    path = _write(tmp_path, "A.md", "alphaunique")
    one, two = library.build([path]), library.build([path])
    assert one["snapshot_id"] != two["snapshot_id"] and one["corpus_sha256"] == two["corpus_sha256"]
    prints = [library.manifest(s["snapshot_id"])["fingerprints"]["chunk"] for s in (one, two)]
    assert prints[0] == prints[1]


def test_registry(spark, tmp_path):
    registry = LibraryRegistry(spark, str(tmp_path / "app"))
    a, b = registry.create(" One "), registry.create("Two", "about")
    assert a["name"] == "One" and a["selected"] and not b["selected"]
    registry.select(b["library_id"])
    registry.rename(a["library_id"], "Uno")
    assert [r["name"] for r in registry.list_libraries()] == ["Uno", "Two"]
    with pytest.raises(LibraryRegistryError):
        registry.delete(b["library_id"], "two")
    assert registry.delete(b["library_id"], "Two")["selected_library_id"] == a["library_id"]
    with pytest.raises(LibraryRegistryError):
        registry.library_path(b["library_id"])


class Script:
    simulated = True

    def __init__(self, rewrite="Shannon entropy", vector=None, answer=None):
        self.values = {"query_rewrite": rewrite, "vector_recall": vector, "candidate_rerank": answer}
        self.seen = []

    def invoke(self, *, role, provider, model_id, payload):
        self.seen.append((role, payload))
        value = self.values[role]
        if isinstance(value, Exception):
            raise value
        return value(payload) if callable(value) else value


def test_vectors_and_enhanced_search(world, tmp_path):
    library, snap = world["library"], world["first"]["snapshot_id"]
    store, profile = VectorStore(library), offline.profile()
    assert store.preview(snap, profile)["planned_calls"] == 1
    assert store.readiness(profile) == {snap: "missing"}
    built = store.build(snap, profile, offline.Embedder())
    # Nine chunks; the two files of equal text share one input.
    assert built["statistics"]["vector_references"] == 9 and built["statistics"]["unique_inputs"] == 8
    assert built["statistics"]["deduplicated_vector_bytes"] == 64
    assert store.build(snap, profile, offline.Embedder())["already_exists"]
    assert store.readiness(profile) == {snap: "ready"}
    assert store.readiness(offline.profile(input_role="other")) == {snap: "mismatch"}
    assert {r["vector_status"] for r in store.document_readiness(snap, profile).collect()} == {"ready"}
    assert {r["vector_status"] for r in store.document_readiness(snap, offline.profile(dimensions=9)).collect()} == {"mismatch"}

    hit = search(world, "Shannon entropy")["results"][0]
    text = library.table(snap, "chunk").filter(F.col("chunk_id") == hit["chunk_id"]).first()["chunk_text"]
    vector = offline.Embedder()([text], profile)[0]
    models = {"query_rewrite": "r", "vector_recall": profile["model_id"], "candidate_rerank": "k"}
    config = SearchPlan(profile["provider"], models, profile, candidates=5)
    for wrong in ({"candidates": 11}, {"candidates": True}, {"else": 1}):
        with pytest.raises(ValueError):
            SearchPlan(profile["provider"], models, profile, **wrong)
    with pytest.raises(ValueError):
        SearchPlan("another", models, profile)

    def first_two(payload):
        return [{"chunk_id": c["chunk_id"], "score": i} for i, c in enumerate(payload["candidates"][:2])]

    script = Script(vector=vector, answer=first_two)
    found = EnhancedSearch(config, script).search(library, snap, "Where?")
    assert [role for role, _ in script.seen] == ["query_rewrite", "vector_recall", "candidate_rerank"]
    assert len(script.seen[2][1]["candidates"]) == 5
    assert found["results"][1]["chunk_id"] == hit["chunk_id"] and found["results"][1]["vector_score"] == pytest.approx(1.0)
    assert found["audit"]["call_count"] == 3 and "Where?" not in str(found["audit"])
    assert EnhancedSearch(config, Script(vector=vector, answer=[])).search(library, snap, "Where?")["found"] is False
    broken = [
        (Script(rewrite=RuntimeError("x")), 1),
        (Script(rewrite=""), 1),
        (Script(rewrite="x" * 401), 1),
        (Script(vector=vector[:-1]), 2),
        (Script(vector=[True] * 8), 2),
        (Script(vector=[float("nan")] * 8), 2),
        (Script(vector=[0.0] * 8), 2),
        (Script(vector=vector, answer=[{"chunk_id": "chunk_x", "score": 1}]), 3),
        (Script(vector=vector, answer=lambda p: [{"chunk_id": p["candidates"][0]["chunk_id"], "score": float("inf")}]), 3),
        (Script(vector=vector, answer=lambda p: [{"chunk_id": p["candidates"][0]["chunk_id"], "score": 1}] * 2), 3),
    ]
    for script, calls in broken:
        with pytest.raises(EnhancedSearchError) as caught:
            EnhancedSearch(config, script).search(library, snap, "Where?")
        assert caught.value.audit["call_count"] == calls
    with pytest.raises(EnhancedSearchError) as caught:
        EnhancedSearch(config, Script()).search(library, snap, " ")
    assert caught.value.audit["call_count"] == 0

    class Short(offline.Embedder):
        def __call__(self, texts, profile):
            return [v[:-1] for v in super().__call__(texts, profile)]

    with pytest.raises(VectorError):
        store.build(snap, offline.profile(dimensions=4), Short())
    assert store.readiness(offline.profile(dimensions=4)) == {snap: "mismatch"}


def test_profile_rules():
    base = offline.profile()
    ids = {vec.profile_id({**base, **change}) for change in (
        {}, {"provider": "offline-x"}, {"model_id": "m"}, {"model_revision": "2"}, {"dimensions": 9}, {"input_role": "query"},
        {"instruction": ""}, {"preprocessing": {**base["preprocessing"], "version": 2}},
    )}
    assert len(ids) == 8
    steps = base["preprocessing"]
    for fine in ("tokenizer", "max_tokens", "secretary"):
        assert vec.checked_profile({**base, "preprocessing": {**steps, "config": {fine: "x"}}})
    assert vec.checked_profile({**base, "provider": "p" * 500})
    for change in ({"model_revision": "Latest"}, {"dimensions": True}, {"dimensions": 0}, {"extra": 1}, {"provider": " x"},
                   {"preprocessing": {**steps, "config": {"a": [{"Api-Key": "x"}]}}}, {"preprocessing": {**steps, "config": {"user_token": 1}}},
                   {"preprocessing": {"version": 1}}, {"preprocessing": 3}):
        with pytest.raises(VectorError):
            vec.checked_profile({**base, **change})


def test_interleaved_catalog_changes_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from excerpta.library import Library

    record = lambda n: {"snapshot_id": f"20260101T{n:012d}Z-{'a' * 12}-{'b' * 8}", "manifest_sha256": "c" * 64, "base_snapshot_id": None}

    def add(n):
        library = Library(spark, str(tmp_path))
        library._change_catalog(lambda c: {
            **c, "snapshots": [*c["snapshots"], record(n)], "last_successful_snapshot_id": record(n)["snapshot_id"],
            "current_snapshot_id": c["current_snapshot_id"] or record(n)["snapshot_id"],
        })

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(add, range(8)))
    catalog = Library(spark, str(tmp_path)).catalog()
    assert sorted(r["snapshot_id"] for r in catalog["snapshots"]) == [record(n)["snapshot_id"] for n in range(8)] and catalog["revision"] == 8


@pytest.mark.parametrize("table, change", [
    ("posting", "position + 1 as position"), ("length", "length + 1 as length"),
])
def test_tampered_index_is_refused(spark, tmp_path, table, change):
    from excerpta.library import Library

    source = tmp_path / "a.md"
    source.write_text("# Title\nsome words to index\n")
    root = str(tmp_path / "library")
    library = Library(spark, root)
    snap = library.build([str(source)])["snapshot_id"]
    assert library.verify(snap)["verified"]
    path = f"{root}/tables/{table}/segment={snap}"
    held = spark.read.parquet(path)
    name = change.split()[0]
    rows, schema = held.selectExpr(*[change if c == name else c for c in held.columns]).collect(), held.schema
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)
    with pytest.raises(SnapshotError, match="content_fingerprint"):
        library.verify(snap)  # the same session has verified it, but the files have changed


def test_source_rows_and_what_the_audit_counts_again(spark, tmp_path):
    library = Library(spark, str(tmp_path / "library"))
    snap = library.build([_write(tmp_path, "A.md", "alphaunique")])["snapshot_id"]
    row = library.sources(snap).first().asDict(recursive=True)
    assert row["source_name"] == "A.md" and row["fulltext_verification"] == row["formula_verification"] == "unverified"
    assert set(row["objects"]) == {"source", "parsed", "chunks"} and row["objects"]["source"]["path"] == row["stored_path"]
    manifest = library.manifest(snap)
    for changed, name in (
        ({"counts": {**manifest["counts"], "chunks": 9}}, "chunks"), ({"storage": {**manifest["storage"], "new_objects": 9}}, "storage_statistics"),
        ({"corpus_sha256": "0" * 64}, "corpus_sha256"),
    ):
        with pytest.raises(SnapshotError, match=name):
            library._audit(snap, {**manifest, **changed})
    library.folder.write_text("x", "snapshots", snap, "stray.txt")
    with pytest.raises(SnapshotError, match="folder_entries"):
        library.verify(snap)


def test_changed_chunks_differ_from_their_objects(spark, tmp_path):
    from excerpta.library import Library

    source = tmp_path / "a.md"
    source.write_text("# Title\nsome words\n# Other\nmore words\n")
    library = Library(spark, str(tmp_path / "library"))
    snap = library.build([str(source)])["snapshot_id"]
    manifest, held = library.manifest(snap), library.members(snap)
    tables = [library.table_from(manifest, held, n) for n in ("document", "asset", "chunk")]
    rules = {r["check"]: r["violations"] for f in library._binding_rules(manifest, held, *tables) for r in f.collect()}
    assert rules["chunk_differs_from_object"] == 0
    shorter = tables[2].withColumn("chunk_text", F.expr("substring(chunk_text, 2)"))
    rules = {r["check"]: r["violations"] for f in library._binding_rules(manifest, held, *tables[:2], shorter) for r in f.collect()}
    assert rules["chunk_differs_from_object"] == 2


def test_another_chunker_reuses_parsed_layers_and_other_media_types(spark, tmp_path, monkeypatch):
    from excerpta.operators import layers, objects
    from excerpta.sources import files

    paths = []
    for name in ("entropy.md", "grid.md", "tie-a.md", "tie-b.md"):
        (tmp_path / name).write_text(FILES[name], encoding="utf-8")
        paths.append(str(tmp_path / name))
    first_library = Library(spark, str(tmp_path / "library"))
    first = first_library.build(paths)
    own = objects.STEPS["text/markdown"]
    cut = {**objects.STEPS, "text/markdown": {**own, "chunker": "revised"}}
    other = {**objects.STEPS, "application/pdf": {"parser": "revised", "chunker": "revised"}}

    def refs(library, snapshot):
        rows = spark.read.parquet(library.folder.path("snapshots", snapshot, "object_ref")).collect()
        return {(r["document_id"], r["kind"]): (r["sha256"], r["created_in_snapshot"]) for r in rows}

    before = refs(first_library, first["snapshot_id"])
    with monkeypatch.context() as patch:
        patch.setattr(files, "prepare", None)  # no source is parsed again
        library = Library(spark, str(tmp_path / "library"), steps=cut)
        gone = next(d for d, _ in before)
        second = library.build(base_snapshot_id=first["snapshot_id"], remove_document_ids=[gone])
        after = refs(library, second["snapshot_id"])
        assert set(after) == {k for k in before if k[0] != gone} and second["counts"]["documents"] == 3
        for (document, kind), (digest, created) in after.items():
            assert (digest != before[document, kind][0]) == (kind == "chunks") and not (created and kind != "chunks")
        assert library.manifest(second["snapshot_id"])["segments"] == [second["snapshot_id"]]
        # Steps of a media type that no document has change nothing: rows stay in their segments.
        third = Library(spark, str(tmp_path / "library"), steps={**cut, **{"application/pdf": other["application/pdf"]}})
        kept = third.build(base_snapshot_id=second["snapshot_id"])
        assert third.manifest(kept["snapshot_id"])["segments"] == [second["snapshot_id"]]
        # And the first chunker's layers are still known.
        back = first_library.build(base_snapshot_id=second["snapshot_id"])
        assert {k: v[0] for k, v in refs(first_library, back["snapshot_id"]).items()} == {k: before[k][0] for k in after}
    assert spark.read.schema(layers.MEMO).parquet(str(tmp_path / "library" / "layers")).filter("kind = 'parsed'").count() > 0
    parser = Library(spark, str(tmp_path / "library"), steps={**objects.STEPS, "text/markdown": {**own, "parser": "revised"}})
    fourth = parser.build(base_snapshot_id=first["snapshot_id"])
    changed = refs(parser, fourth["snapshot_id"])
    assert all((changed[k][0] == before[k][0]) == (k[1] == "source") for k in before)


def test_small_change_audits_the_new_segment_only(spark, tmp_path, monkeypatch):
    paths = [_write(tmp_path, f"{n}.md", w) for n, w in (("A", "alphaunique"), ("B", "bravounique"), ("C", "charlieunique"))]
    root = str(tmp_path / "library")
    one = Library(spark, root).build(paths[:2])
    audited = []
    rules = Library._segment_rules
    monkeypatch.setattr(Library, "_segment_rules", lambda self, todo, *rest: audited.append(sorted(todo)) or rules(self, todo, *rest))
    library = Library(spark, root)  # another session: nothing of the base has been seen
    gone = library.members(one["snapshot_id"]).filter("source_name = 'A.md'").first()["document_id"]
    two = library.build(paths[2:], base_snapshot_id=one["snapshot_id"], remove_document_ids=[gone])
    assert audited == [[two["snapshot_id"]]]
    manifest = library.manifest(two["snapshot_id"])
    refs = library.folder.path("snapshots", two["snapshot_id"], "object_ref")
    assert manifest["fingerprints"] == library._fingerprints(manifest, library.members(two["snapshot_id"]), refs)
    assert manifest["fingerprints"]["document"]["rows"] == 2 and not manifest["whole_segments"]
    # Opening both audits the base's segment once; the new one has been audited by its build.
    assert all(s["verified"] for s in library.list_snapshots())
    assert audited[1:] == [[one["snapshot_id"]]]
    # A base whose files have other sizes is audited before it is built on, and refused.
    path = library.folder.path("tables", "chunk", f"segment={one['snapshot_id']}")
    held = spark.read.parquet(path)
    rows = held.withColumn("chunk_text", F.concat("chunk_text", F.lit("!" * 99))).collect()
    spark.createDataFrame(rows, held.schema).write.mode("overwrite").parquet(path)
    with pytest.raises(SnapshotError, match="chunk_id_forged"):
        library.build(paths[2:], base_snapshot_id=one["snapshot_id"])


def test_a_dead_writer_leaves_the_catalog_usable(spark, tmp_path, monkeypatch):
    from excerpta.storage import Folder, Revisions

    folder = Folder(spark, str(tmp_path))
    value = Revisions(folder, "value", lambda: {"items": []})
    add = lambda n: lambda v: {**v, "items": [*v["items"], n]}
    assert value.read() == {"items": [], "revision": 0}
    value.change(add(1))
    # A writer dies before its file has its name: its text lies beside, and the next writer takes the revision.
    (tmp_path / "value" / ".2.json-dead").write_text("{")
    assert value.change(add(2)) == {"items": [1, 2], "revision": 2} == value.read()
    assert folder.write_new("x", "value", "2.json") is False and value.read()["items"] == [1, 2]
    # Another writer makes revision 3 while this one is at it: both changes stay.
    def slow(v):
        if v["items"] == [1, 2]:
            Revisions(folder, "value", dict).change(add(3))
        return add(4)(v)

    assert value.change(slow)["items"] == [1, 2, 3, 4]
    monkeypatch.setattr("excerpta.storage.KEPT_REVISIONS", 3)
    for n in range(5, 9):
        value.change(add(n))
    assert value.read()["items"] == list(range(1, 9)) and not (tmp_path / "value" / "2.json").exists()


def test_vector_artifacts_are_reconciled_with_their_catalog(spark, tmp_path):
    library = Library(spark, str(tmp_path / "library"))
    one = library.build([_write(tmp_path, "A.md", "alphaunique")])["snapshot_id"]
    store, profile = VectorStore(library), offline.profile()
    late = VectorStore(library)  # two builds at once: the second one publishes nothing
    assert store.states().collect() == []
    assert store.build(one, profile, offline.Embedder())["new_objects"] == 1
    record = store.catalog()["artifacts"][0]
    with pytest.raises(VectorError):
        late._with_record(late.catalog(), record)
    other = store.build(one, offline.profile(dimensions=4), offline.Embedder())
    assert {r["profile_id"] for r in store.catalog()["artifacts"]} == {record["profile_id"], other["profile_id"]}
    assert {r["state"] for r in store.states().collect()} == {"present"} and store.states().count() == 4
    stray = library.folder.path("vectors", "objects", "artifact=stray")
    spark.range(3).write.parquet(stray)
    spark.range(9).write.mode("append").parquet(library.folder.path("vectors", "mappings", f"artifact={record['artifact_id']}"))
    library.folder.remove("vectors", "objects", f"artifact={other['artifact_id']}")
    states = {(r["artifact_id"], r["part"]): r["state"] for r in store.states().collect()}
    assert states == {
        (record["artifact_id"], "objects"): "present", (record["artifact_id"], "mappings"): "altered",
        (other["artifact_id"], "objects"): "missing", (other["artifact_id"], "mappings"): "present", ("stray", "objects"): "unlisted",
    }
    for artifact, problem in ((record, "mappings altered"), (other, "objects missing")):
        with pytest.raises(VectorError, match=problem):
            store.verify(one, artifact["profile_id"])


def test_only_regular_files_that_stay_as_they_are(spark, tmp_path, monkeypatch):
    from excerpta.sources import files

    library = Library(spark, str(tmp_path / "library"))
    plain = _write(tmp_path, "A%20 b+.md", "alphaunique")
    (tmp_path / "link.md").symlink_to(plain)
    (tmp_path / "folder.md").mkdir()
    for path, reason in (("link.md", "symbolic link"), ("folder.md", "regular file"), ("absent.md", "no such file")):
        with pytest.raises(ImportPolicyError, match=reason):
            library.build([plain, str(tmp_path / path)])
    built = library.build([plain])
    assert library.snapshot_members(built["snapshot_id"]).first()["source_name"] == "A%20 b+.md"
    read = files.read_files

    def changing(*given):
        frame = read(*given)
        with open(plain, "a") as file:
            file.write("one more line\n")
        return frame

    monkeypatch.setattr(files, "read_files", changing)
    with pytest.raises(ImportPolicyError, match="changed while it was read"):
        library.build([plain])
    assert [s["snapshot_id"] for s in library.catalog()["snapshots"]] == [built["snapshot_id"]]

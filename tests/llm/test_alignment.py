"""Alignment against the definition: token by token, link by link."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from excerpta.llm import alignment, queries
from excerpta.llm.packing import byte_alphabet
from tests.llm import helpers

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    library, model, alphabet = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_alphabet()
    library.encode_special_tokens = True

    def piece(n):
        p = model.id_to_piece(n)
        return bytes([int(p[3:5], 16)]) if model.is_byte(n) else p.replace("▁", " ").encode()

    def sides(text):
        if not text:
            return None
        a = [(n, bytes(alphabet[c] for c in library.id_to_token(n))) for n in library.encode(" " + text, add_special_tokens=False).ids]
        b = [(n, piece(n)) for n in model.encode(text)]
        return (a, b) if all(b"".join(t for _, t in s) == b" " + text.encode() for s in (a, b)) else None

    def spans(side):
        out, at = [], 0
        for n, t in side:
            out.append((n, at, at + len(t)))
            at += len(t)
        return out

    parsed, counts = {}, Counter()
    for _, text in rows:
        if text not in parsed:
            found = sides(text)
            links, groups = [], []
            if found:
                a, b = map(spans, found)
                j = 0
                for n, s, e in a:
                    while j and b[j - 1][2] > s:
                        j -= 1
                    while j < len(b) and b[j][1] < e:
                        if b[j][2] > s:
                            links.append((n, b[j][0]))
                        j += 1
                ends = sorted({e for *_, e in a} & {e for *_, e in b})
                for low, high in zip([0, *ends], ends):
                    groups.append("|".join(",".join(str(n) for n, s, e in side if low < e <= high) for side in (a, b)))
            parsed[text] = (len(found[0]), len(found[1]), len(groups), links, ";".join(groups)) if found else (0, 0, 0, [], "")
        counts.update(parsed[text][3])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for i, text in rows:
        n_a, n_b, n_groups, links, groups = parsed[text]
        out.append((i, n_a, n_b, n_groups, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), groups))
    return helpers.copies(out)


TEXTS = [
    (1, "plain words"), (2, "plain words"), (3, "<|endoftext|> and <s> </s> <unk> <0x41>"), (4, "a▁b"), (5, " lead  and\n\ttrail "),
    (6, "日本語 и русский 🙂🙂 ﬁ ½"), (7, "\u0000x"), (8, "naïvé é"), (None, "no id"), (9, "x"), (9, "x"), (10, "1234567890" * 40),
]


@pytest.mark.parametrize("block", [None, 20])
def test_alignment_of_texts(spark, sf, block, monkeypatch):
    monkeypatch.setattr(alignment, "HELD_PAIRS", 500)
    some = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 900").select("doc_id", "text").limit(40).collect()
    rows = TEXTS + helpers.EDGES[:6] + helpers.EDGES[8:10] + [tuple(r) for r in some]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("copies", F.lit("x")).withColumn("groups", F.lit(1)).repartition(3)
    got = alignment.cross_tokenizer_alignment(docs, A, B, spelled=True, block_pairs=block).collect()
    assert helpers.copies(tuple(r) for r in got) == brute(rows)


def test_alignment_edges_and_digests(spark):
    assert alignment.cross_tokenizer_alignment(helpers.empty_table(spark), A, B).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    assert helpers.copies(tuple(r) for r in alignment.cross_tokenizer_alignment(nothing, A, B).collect()) == helpers.copies((n, 0, 0, 0, 0, 0, 0, "") for n in (1, 2, 3))
    long = " " * 1_100_000 + "x"
    one = alignment.cross_tokenizer_alignment(spark.createDataFrame([(1, "ab cd"), (2, long)], "doc_id long, text string"), A, B).collect()
    spelled = alignment.cross_tokenizer_alignment(spark.createDataFrame([(1, "ab cd"), (2, long)], "doc_id long, text string"), A, B, spelled=True).collect()
    assert {r.doc_id: r.groups for r in one} == {r.doc_id: hashlib.sha256(r.groups.encode()).hexdigest() for r in spelled} and min(r.n_a for r in one) > 0


def test_alignment_query(spark, sf):
    got = queries.op13_tokenizer_alignment(spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = got.collect()
    assert len(rows) == 200 and all(r.n_links == r.n_a + r.n_b - r.n_groups and r.n_best <= r.n_links <= r.count_sum for r in rows)

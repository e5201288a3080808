"""Alignment of two tokenizers over a corpus, each distinct text once.

1. Rows meet by their full text: copies are folded map-side, so a text leaves a task once however often it occurs there.
2. A task tokenises and aligns each distinct text: token ends of both sides are byte offsets; common ends cut groups, and
   between two neighbouring ends of either side lies exactly one link. Its measures and its distinct linked id pairs with
   their numbers (compressed) are written once.
3. Pair counts are sums of these numbers times the text's copies, combined in the task before the shuffle. There are at
   most as many pairs as the vocabularies' product, whatever the corpus.
4. Texts look their pairs up in blocks of at most ``BLOCK_PAIRS`` counts, which are broadcast one after another; no text
   is tokenised, and no pair of a text shuffled, a second time.
5. Measures are joined to the rows by the text's digest. Adaptive execution splits the join where one text is hot.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from excerpta.llm.common import batches, per_worker, settle
from excerpta.llm.packing import SPLIT, byte_alphabet

BLOCK_PAIRS = 1 << 22
HELD_PAIRS = 1 << 20
MEASURES = ("n_a", "n_b", "n_groups", "n_links")


class ByteLevel:
    """Side A: ids of space + text by a byte-level BPE file; strings of special tokens are plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.path = path
        special = {t["content"] for t in content["added_tokens"]}
        alphabet = byte_alphabet()
        vocabulary = content["model"]["vocab"]
        ranks = {bytes(alphabet[c] for c in t): n for t, n in vocabulary.items() if t not in special}
        self.size = 1 + max([*vocabulary.values(), *(t["id"] for t in content["added_tokens"])])
        self.bytes = [b""] * self.size
        for token, n in ranks.items():
            self.bytes[n] = token
        self.bpe = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        try:
            return self.bpe.encode(" " + text, disallowed_special=())  # there are no special tokens
        except ValueError:  # tiktoken gives up on white-space runs of about a million characters
            return per_worker(("plain tokenizers", self.path), self._library).encode(" " + text, add_special_tokens=False).ids

    def _library(self):
        library = Tokenizer.from_file(self.path)
        library.encode_special_tokens = True
        return library


class Pieces:
    """Side B: ids of a text by a sentencepiece model, which adds the space itself."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.bytes = [self._bytes(n) for n in range(self.size)]

    def _bytes(self, n: int) -> bytes:
        piece = self.model.id_to_piece(n)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(n) else piece.replace("▁", " ").encode()

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text)


class Aligner:
    """Aligns texts by two tokenizers; ``pairs`` are ``a * (ids of B) + b``."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.width_a, self.width_b = (np.array([len(t) for t in side.bytes]) for side in (self.a, self.b))
        self.kind = pair_kind(self.a.size * self.b.size)
        spelled = [f"{n}{mark}" for side, marks in ((self.a, ",|"), (self.b, ",;")) for mark in marks for n in range(side.size)]
        self.spelled = np.array([s.encode() for s in spelled])

    def tokens(self, text: str):
        """Ids of both sides, or None where a side's bytes are not those of space + text."""
        content = b" " + text.encode("utf-8")
        sides = []
        for side in (self.a, self.b):
            ids = side.ids(text)
            if b"".join(map(side.bytes.__getitem__, ids)) != content:
                return None
            sides.append(np.array(ids, "i8"))
        return sides

    def align(self, text: str):
        """(n_a, n_b, n_groups, n_links), the groups' spelling and the distinct pairs with their numbers."""
        found = self.tokens(text) if text else None
        if found is None:
            return (0, 0, 0, 0), b"", None, None
        a, b = found
        end_a, end_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])
        ends = np.union1d(end_a, end_b)
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        pairs, numbers = np.unique(a[at_a] * self.b.size + b[at_b], return_counts=True)
        both = (end_a[at_a] == ends) & (end_b[at_b] == ends)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[at_a[both]] = last_b[at_b[both]] = True
        return (len(a), len(b), int(both.sum()), len(ends)), self._spell(a, b, last_a, last_b), pairs, numbers

    def _spell(self, a, b, last_a, last_b) -> bytes:
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        stop_a = np.flatnonzero(last_a) + 1
        start_b = np.concatenate([[0], np.flatnonzero(last_b)[:-1] + 1])
        order = np.empty(len(a) + len(b), "i8")
        order[np.arange(len(a)) + start_b[group_a]] = a + self.a.size * last_a
        order[np.arange(len(b)) + stop_a[group_b]] = 2 * self.a.size + b + self.b.size * last_b
        return self.spelled[order].tobytes().replace(b"\0", b"")[:-1]


def pair_kind(pairs: int) -> str:
    return "<u4" if pairs <= 1 << 32 else "<u8"


def _packed(pairs: np.ndarray, numbers: np.ndarray, kind: str) -> bytes:
    steps = np.diff(pairs, prepend=0).astype(kind)
    return zstandard.compress(steps.tobytes() + numbers.astype("<u4").tobytes(), 1)


def _unpacked(content: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    content = zstandard.decompress(content)
    n = len(content) // (np.dtype(kind).itemsize + 4)
    steps = np.frombuffer(content, kind, n)
    return np.cumsum(steps, dtype="i8"), np.frombuffer(content, "<u4", offset=steps.nbytes).astype("i8")


def aligned_texts(docs: DataFrame, path_a: str, path_b: str, text="text", spelled=False) -> DataFrame:
    """One row per distinct text that is neither null nor empty: text_key (its SHA-256), copies, n_a, n_b, n_groups,
    n_links, groups (their SHA-256, or the spelling itself), pairs (packed; null without tokens)."""
    fields = [("text_key", pa.string()), ("copies", pa.int64()), *((m, pa.int64()) for m in MEASURES), ("groups", pa.string()), ("pairs", pa.binary())]

    def run(it):
        aligner = per_worker(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))

        def rows():
            for batch in it:
                for content, key, copies in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
                    measures, groups, pairs, numbers = aligner.align(content.as_py())
                    if pairs is None:
                        yield key.as_py(), copies, *measures, "", None
                    else:
                        groups = groups.decode() if spelled else hashlib.sha256(groups).hexdigest()
                        yield key.as_py(), copies, *measures, groups, _packed(pairs, numbers, aligner.kind)

        return batches(rows(), pa.schema(fields), 64 if spelled else 1024)

    whole = docs.select(F.col(text).alias("text")).where("text <> ''")
    distinct = whole.groupBy("text").agg(F.count("*").alias("copies")).select("text", F.sha2("text", 256).alias("text_key"), "copies")
    longs = ", ".join(f"{m} long" for m in MEASURES)
    return distinct.mapInArrow(run, f"text_key string, copies long, {longs}, groups string, pairs binary")


def pair_counts(texts: DataFrame, kind: str, size_b: int) -> DataFrame:
    """pair, n (links of all rows that hold it), best (whether no pair of its B id has more)."""

    def run(it):
        held = [np.empty(0, "i8")], [np.empty(0, "i8")]

        def fold():
            pairs, place = np.unique(np.concatenate(held[0]), return_inverse=True)
            numbers = np.zeros(len(pairs), "i8")
            np.add.at(numbers, place, np.concatenate(held[1]))
            return pairs, numbers

        size = 0
        for batch in it:
            for content, copies in zip(batch.column(0), batch.column(1).to_pylist()):
                pairs, numbers = _unpacked(content.as_buffer(), kind)
                held[0].append(pairs)
                held[1].append(numbers * copies)
                size += len(pairs)
                if size > HELD_PAIRS:
                    pairs, numbers = fold()
                    if len(pairs) > HELD_PAIRS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(numbers)], names=["pair", "n"])
                        pairs, numbers = pairs[:0], numbers[:0]
                    held, size = ([pairs], [numbers]), len(pairs)
        pairs, numbers = fold()
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(numbers)], names=["pair", "n"])

    parts = texts.where("pairs is not null").select("pairs", "copies").mapInArrow(run, "pair long, n long")
    counts = parts.groupBy("pair").agg(F.sum("n").alias("n"))
    of_b = Window.partitionBy(F.col("pair") % size_b)  # at most as many rows as A has ids
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(of_b)).alias("best"))


def link_sums(texts: DataFrame, counts: DataFrame, kind: str, block_pairs=None) -> DataFrame:
    """text_key, n_best and count_sum of each text with tokens. ``texts`` and ``counts`` are tables.

    Each block of at most about ``block_pairs`` counts is one broadcast and one pass over the texts' packed pairs.
    """
    blocks = max(1, -(-counts.count() // (block_pairs or BLOCK_PAIRS)))
    sc = texts.sparkSession.sparkContext
    parts = None
    for block in range(blocks):
        own = counts.where(F.expr(f"pmod(xxhash64(pair), {blocks}) = {block}")).toArrow()
        pair, n, best = (own.column(k).to_numpy() for k in range(3))
        order = np.argsort(pair)
        shared = sc.broadcast((pair[order], n[order], best[order].astype("i8")))

        def run(it, shared=shared):
            pair, n, best = shared.value

            def rows():
                for batch in it:
                    for key, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                        pairs, numbers = _unpacked(content.as_buffer(), kind)
                        at = np.minimum(np.searchsorted(pair, pairs), max(0, len(pair) - 1))
                        here = pair[at] == pairs if len(pair) else np.zeros(len(pairs), bool)
                        at, numbers = at[here], numbers[here]
                        yield key, int((numbers * best[at]).sum()), sum(map(int.__mul__, numbers.tolist(), n[at].tolist()))

            return batches(rows(), pa.schema([("text_key", pa.string()), ("n_best", pa.int64()), ("count_sum", pa.int64())]))

        found = texts.where("pairs is not null").select("text_key", "pairs").mapInArrow(run, "text_key string, n_best long, count_sum long")
        parts = found if parts is None else parts.union(found)
    return parts if blocks == 1 else parts.groupBy("text_key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def cross_tokenizer_alignment(docs: DataFrame, path_a: str, path_b: str, key="doc_id", text="text", spelled=False, block_pairs=None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``groups`` is the SHA-256 of the spelled groups ("a1,a2|b1;a3|b2,b3"), or with ``spelled`` the spelling. Texts that are
    null or empty, or whose tokens of either side do not join to space + text, have no tokens: zeros and ''. Repeated rows
    repeat and count as often as they occur; a null id stays null; an empty table gives no rows; other columns, whatever
    their names, are ignored. Both paths must exist on every machine.
    """
    aligner = per_worker(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))
    kind, size_b = aligner.kind, aligner.b.size
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    texts = settle(aligned_texts(rows, path_a, path_b, spelled=spelled), "aligned-texts")
    counts = settle(pair_counts(texts, kind, size_b), "pair-counts")
    sums = link_sums(texts, counts, kind, block_pairs)
    measured = texts.drop("pairs", "copies").join(sums, "text_key", "left")
    keyed = rows.select("doc_id", F.sha2("text", 256).alias("text_key"))
    joined = keyed.join(measured, "text_key", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("doc_id", *map(number, (*MEASURES, "n_best", "count_sum")), F.coalesce("groups", F.lit("")).alias("groups"))

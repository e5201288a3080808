"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie. A node stands for the characters read since the last piece was settled. Where a character does
not go on, the pieces that greedy matching would cut off the front are popped and reading goes on from the failure link,
the node of what is left. How many pieces are popped is computed once per node, when the trie is built, so a word's
length in pieces takes one step per character and no piece is ever built.

The vocabulary here marks the end of a word: a piece that ends a word is another piece than the same letters inside one.
Words come from the tokenizer file's own normalisation and pattern.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from excerpta.llm.bpe import TrieWalk
from excerpta.llm.common import batches, per_worker, text_runs

RUN_CHARS = 8 << 20
CACHE_WORDS = 400_000
LAST = 0x10000  # added to a word's last character: with the end mark it is another symbol than without
COUNTED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("longest_word", pa.int64())])


class LongestMatch:
    """``pieces(word)`` for words spelled in the vocabulary's symbols."""

    def __init__(self, vocabulary):
        self.child: list[dict[str, int]] = [{}]
        whole = {0}
        for piece in vocabulary:
            node = 0
            for c in piece:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                node = self.child[node][c]
            whole.add(node)
        self.fail = [-1] * len(self.child)
        self.popped = [0] * len(self.child)
        level = [(0, c, v) for c, v in self.child[0].items()]
        while level:  # breadth first: links go to shorter strings
            for parent, c, node in level:
                if node in whole:
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                at, popped = self.fail[parent], self.popped[parent]
                while at >= 0 and c not in self.child[at]:
                    popped += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.child[at][c], popped
            level = [(v, c, w) for _, _, v in level for c, w in self.child[v].items()]

    def pieces(self, word: str) -> int:
        """Number of pieces; 1 (one unknown piece) for a word that greedy matching cannot cut."""
        child, fail, popped = self.child, self.fail, self.popped
        node = count = 0
        for c in word:
            while (after := child[node].get(c)) is None:
                count += popped[node]
                node = fail[node] if node else -1
                if node < 0:
                    return 1
            node = after
        while node > 0:
            count += popped[node]
            node = fail[node]
        return 1 if node < 0 else count


def closed(spelled: str) -> str:
    """A spelling that ends a word."""
    return spelled[:-1] + chr(ord(spelled[-1]) + LAST)


class Counter:
    def __init__(self, path: str):
        self.walk = TrieWalk(path)
        end = self.walk.file.end
        self.match = LongestMatch(closed(t.removesuffix(end)) if t.endswith(end) else t for t in self.walk.file.vocabulary)
        self.known: dict[str, int] = {}

    def counted(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(words, pieces, pieces of the longest word) of each text."""
        split = [self.walk.split(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        characters, special = self.walk.file.characters, self.walk.file.special
        for word in set().union(*split).difference(self.known):
            spelled = "".join([characters[b] for b in word.encode("utf-8", "surrogatepass")])
            self.known[word] = 1 if word in special else self.match.pieces(closed(spelled))
        found = [[self.known[w] for w in words] for words in split]
        return [(len(f), sum(f), max(f, default=0)) for f in found]


def token_counts(docs: DataFrame, path: str, key="doc_id", text="text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_tokens, longest_word (most pieces of one word).

    A null, empty or wordless text counts 0; special tokens count 1; repeated rows give equal rows.
    """

    def run(it):
        counter = per_worker(("pieces", path), lambda: Counter(path))

        def rows():
            for batch in it:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in text_runs(texts, RUN_CHARS):
                    yield from ((i, *c) for i, c in zip(ids[a:b], counter.counted(texts[a:b])))

        return batches(rows(), COUNTED)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long, longest_word long")

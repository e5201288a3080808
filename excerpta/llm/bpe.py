"""BPE encoding and decoding by walking the trie of distinct words.

In BPE the last token of a prefix determines its whole encoding: if ``t`` is the last token of the prefix ``w``, the
other tokens are the encoding of ``w`` without ``t``. And ``t`` is the one suffix of ``w`` in the vocabulary that
stays apart from the token before it, that is, for which encoding the two tokens' symbols gives the two tokens again.
So a trie node needs only its last token, found from its ancestors' tokens, and words that share a prefix share the
nodes on it.

Each task takes the distinct words of a run of texts that it has not met lately, sorts them, and walks the trie depth
first: the path to the current node is a stack, and the next word starts at the node where it leaves the last one. The
trie itself is never held. A word's ids and pieces are kept as ready strings, so texts are encoded by one look-up per
word. Texts never leave their row; there is no shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from excerpta.llm.common import batches, per_worker, text_runs

RUN_CHARS = 8 << 20
CACHE_WORDS = 400_000
CACHE_PAIRS = 400_000
CODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.string())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class TokenizerFile:
    """What a tokenizer file of this kind says: words are split by a pattern after NFC, folded white space and lower
    case; a word's UTF-8 bytes are written as characters, the last with the end mark; no decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        kinds = [n["type"] for n in content["normalizer"]["normalizers"]]
        split, level = content["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or content["decoder"] or level["type"] != "ByteLevel":
            raise ValueError(f"{path} is a tokenizer of another kind")
        self.end = model["end_of_word_suffix"] or ""
        self.vocabulary = model["vocab"]
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.pattern = split["pattern"]["Regex"]
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        others = [b for b in range(256) if b not in set(printable)]
        self.characters = {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


def unassigned() -> re.Pattern:
    """Characters without a category in Python's Unicode version; the tokenizers library may know a newer one."""
    points = [c for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn"]
    bounds = [0, *(n for n in range(1, len(points)) if points[n] != points[n - 1] + 1), len(points)]
    return re.compile("[" + "".join(f"{chr(points[a])}-{chr(points[b - 1])}" for a, b in zip(bounds, bounds[1:])) + "]")


class TrieWalk:
    """Encodes words of one tokenizer file; ``encode`` takes a set, ``known`` holds (ids, pieces) by word."""

    def __init__(self, path: str):
        self.file = file = TokenizerFile(path)
        # Tokens that merges build; any other string of the vocabulary never comes out of BPE.
        made = {a + b for a, b in file.ranks} | {c + e for c in file.characters.values() for e in ("", file.end)}
        self.tokens = {t: i for t, i in file.vocabulary.items() if t in made}
        bodies = {t.removesuffix(file.end) if file.end else t for t in self.tokens}
        self.starts = {b[:n] for b in bodies for n in range(1, len(b) + 1)}
        self.apart: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[str, str]] = {}
        self.words = regex.compile(file.pattern).findall
        self.unassigned = unassigned()
        self.library = Tokenizer.from_file(path)
        special = "|".join(map(regex.escape, sorted(file.special, key=len, reverse=True)))
        self.special = regex.compile(f"({special})") if special else None

    def _symbols(self, token: str) -> list[str]:
        body = token.removesuffix(self.file.end) if self.file.end else token
        symbols = list(body)
        if len(body) < len(token):
            symbols[-1] += self.file.end
        return symbols

    def _merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE: the pair of lowest rank first, the leftmost of those."""
        while len(symbols) > 1:
            pairs = [(self.file.ranks.get(p), at) for at, p in enumerate(zip(symbols, symbols[1:]))]
            rank, at = min(((r, at) for r, at in pairs if r is not None), default=(None, 0))
            if rank is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _stays_apart(self, left: str, right: str) -> bool:
        pair = (left, right)
        found = self.apart.get(pair)
        if found is None:
            if len(self.apart) >= CACHE_PAIRS:
                self.apart.clear()
            found = self.apart[pair] = self._merged(self._symbols(left) + self._symbols(right)) == [left, right]
        return found

    def _last(self, path: str, first: int, depth: int, tail: str, stack: list[str]) -> str:
        """Last token of the first ``depth`` symbols of ``path``; no token that ends there begins before ``first``, and
        ``tail`` is the end mark at a word's end."""
        tokens, apart = self.tokens, self.apart
        for at in range(first, depth):
            token = path[at:depth] + tail
            if token in tokens and (not at or (a if (a := apart.get((stack[at], token))) is not None else self._stays_apart(stack[at], token))):
                return token
        raise ValueError(f"no token ends {path[:depth]!r}")

    def encode(self, words: set[str]) -> None:
        characters, end, starts, ids = self.file.characters, self.file.end, self.starts, self.tokens
        paths = sorted(("".join([characters[b] for b in w.encode("utf-8", "surrogatepass")]), w) for w in words)
        path = ""
        stack = [""]  # by depth: the last token of the first symbols of the path
        first = [0]  # and where the longest suffix begins that some token begins with
        for spelled, word in paths:
            shared = 0
            for a, b in zip(path, spelled):
                if a != b:
                    break
                shared += 1
            path, size = spelled, len(spelled)
            del stack[shared + 1 :], first[shared + 1 :]
            for depth in range(len(stack), size + 1):
                at = first[-1]
                while spelled[at:depth] not in starts:
                    at += 1
                first.append(at)
                if depth < size:
                    stack.append(self._last(spelled, at, depth, "", stack))
            tokens = [self._last(spelled, first[size], size, end, stack)]
            del first[size:]
            at = size - len(tokens[0]) + len(end)
            while at:
                tokens.append(stack[at])
                at -= len(stack[at])
            tokens.reverse()
            self.known[word] = (" ".join([str(ids[t]) for t in tokens]), " ".join(tokens))

    def split(self, text: str) -> list[str]:
        """Words and special tokens of a text in order. A special token is recognised before normalising."""
        if self.special is None or not self.special.search(text):
            return self._words(text)
        parts = self.special.split(text)
        return [w for n, part in enumerate(parts) for w in ([part] if n % 2 else self._words(part))]

    def _words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.unassigned.search(text):
                return self._new_characters(text)
        return self.words(self._normal(text))

    def _new_characters(self, text: str) -> list[str]:
        """The words of a text with characters newer than Python's Unicode version, as the library splits them."""
        byte = {c: b for b, c in self.file.characters.items()}
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes([byte[c] for c in word]).decode() for word, _ in split]

    @staticmethod
    def _normal(text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # Lower case character by character: no other form of sigma at a word's end.
        return "σ".join([part.lower() for part in text.split("Σ")]) if "Σ" in text else text.lower()

    def coded(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(tokens, ids joined by a space, decoded text) of each text."""
        split = [self.split(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = set().union(*split).difference(self.known)
        for token in new & self.file.special.keys():
            self.known[token] = (str(self.file.special[token]), token)
        self.encode(new - self.file.special.keys())
        out = []
        for words in split:
            ids, pieces = zip(*map(self.known.__getitem__, words)) if words else ((), ())
            ids = " ".join(ids)
            out.append((ids.count(" ") + 1 if ids else 0, ids, " ".join(pieces)))
        return out


def _coded(docs, path, key, text, shape, arrow, schema):
    def run(it):
        walk = per_worker(("bpe", path), lambda: TrieWalk(path))

        def rows():
            for batch in it:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in text_runs(texts, RUN_CHARS):
                    yield from (shape(i, c) for i, c in zip(ids[a:b], walk.coded(texts[a:b])))

        return batches(rows(), arrow, 512)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, key="doc_id", text="text") -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by one space), decoded (the vocabulary strings joined by one space, which
    is what a tokenizer without a decoder gives). A null text is empty and has no tokens; repeated rows repeat."""
    return _coded(docs, path, key, text, lambda i, c: (i, *c), CODED, "doc_id long, n_tokens long, ids string, decoded string")


def encode_digests(docs: DataFrame, path: str, key="doc_id", text="text") -> DataFrame:
    """Like :func:`encode`, with SHA-256 digests in place of the long strings."""

    def shape(i, c):
        return (i, c[0], *(hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest() for s in c[1:]))

    return _coded(docs, path, key, text, shape, DIGESTS, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

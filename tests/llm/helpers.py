"""Plain reference computations for the operators' tests."""

import re
from collections import Counter

EDGES = [
    (None, "no id"), (1, None), (2, ""), (3, " \n\t "), (4, "a  b"), (5, "a b"), (6, "a\tb"), (6, "a b"), (7, "a b"),
    (8, "A b"), (9, "word " * 30_000), (10, "word " * 30_000), (11, "é" * 5_000), (12, "x"), (13, "x"), (14, "\u0000"),
]


def edge_table(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, "en", None, 1, "keep", True, 3) for i, t in EDGES]
    schema = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, kept boolean, found int"
    return spark.createDataFrame(rows, schema)


def empty_table(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def shingles(text, width):
    words = (text or "").encode().lower().split()
    size = min(width, len(words))
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) if size else frozenset()


def linked(texts, width, percent=80):
    """Least id reachable, by id, from all pairs."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + n % 2) for n, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def base_places(text, phrases):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = []
    for label, wordings in phrases.items():
        for wording in wordings:
            parts = wording.split()
            out += [(n, label) for n in range(len(words)) if words[n : n + len(parts)] == parts]
    return len(words), sorted(out)


def greedy_pieces(word, vocabulary, end):
    """Longest match first; the end mark belongs to the last character."""
    at = count = 0
    while at < len(word):
        for stop in range(len(word), at, -1):
            piece = word[at:stop] + (end if stop == len(word) else "")
            if piece in vocabulary:
                break
        else:
            return 1
        at, count = stop, count + 1
    return count


def copies(rows):
    return Counter(rows)

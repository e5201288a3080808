"""Text expressions: line splitting, cleaning, headings and index tokens, all JVM-side columns."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce
from operator import and_, or_

from pyspark import SparkContext
from pyspark.sql import Column, functions as F

# --- fixed values -----------------------------------------------------------------------------
MAX_CHUNK_CHARS = 1200
MAX_TITLE_CHARS = 500
UNTITLED_SECTION = "Untitled section"
UNTITLED_DOCUMENT = "Untitled document"
# Characters Python's str.isspace() accepts, as a regex class body (Java and RE2 syntax).
SPACE = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACES = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
# Line boundaries of str.splitlines() once CR and CRLF have become LF.
LINE_BREAK = r"[\x{0a}-\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
RARE_BREAKS = "\r\v\f\x1c\x1d\x1e\x85\u2028\u2029"
HEADING = rf"^(#{{1,6}})[{SPACE}]+(.+?)[{SPACE}]*$"
# The full-text index knows the characters of this Unicode version; its token characters are letters, numbers, private use
# and whatever was not assigned then.
INDEX_UNICODE = "6.1"
TOKEN = r"\p{L}\p{N}\p{Co}\p{Cn}"
# As Unicode sets: later symbols and marks, and letters that became marks (token characters); capitals without lower case then.
LATER_SYMBOLS = f"[[[:^L:]&[:^N:]&[:^Cn:]&[:^age={INDEX_UNICODE}:]][\\u1885\\u1886]]"
LATER_CAPITALS = f"[[[:Lu:]&[:^age={INDEX_UNICODE}:]][[:Lu:]&[:Cherokee:]]]"
# Separators of the index that are letters or unassigned today: vowel signs that became letters, and noncharacters.
SEPARATORS = "".join(map(chr, (*range(0x19B0, 0x19C1), 0x19C8, 0x19C9, 0x1CF2, 0x1CF3, 0xFFFE, 0xFFFF)))
# Case folds beyond simple lower-casing.
FOLD_FROM = "µſςϐϑϕϖϰϱϵẛι"
FOLD_TO = "μsσβθφπκρεsι"
# Combining marks the tokenizer skips inside a word.
SKIPPED_MARKS = (
    "̛̀́̂̃̄̆̇̈̉̊̋̌̏̑"
    "̧̨̣̤̥̦̭̮̰̱"
)
# ----------------------------------------------------------------------------------------------


def _accent_table() -> tuple[str, str]:
    """Lower-case letters that decompose into one ASCII letter and one mark, with that letter."""
    accented, plain = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        if letter == letter.lower() and len(parts) == 2 and "a" <= parts[0] <= "z":
            accented.append(letter)
            plain.append(parts[0])
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _accent_table()


@cache
def code_ranges(unicode_set: str) -> tuple[tuple[int, int], ...]:
    """Code point ranges of a Unicode set."""
    found = SparkContext.getOrCreate()._jvm.com.ibm.icu.text.UnicodeSet(unicode_set)
    return tuple((found.getRangeStart(i), found.getRangeEnd(i)) for i in range(found.getRangeCount()))


def _class_of(unicode_set: str) -> str:
    """The same as a regex class that ends at once for all characters below its first."""
    ranges = code_ranges(unicode_set)
    body = "".join(rf"\x{{{first:x}}}-\x{{{last:x}}}" for first, last in ranges)
    return rf"[[^\x{{0}}-\x{{{ranges[0][0] - 1:x}}}]&&[{body}]]"


def token_class() -> str:
    """Body of the regex class of token characters."""
    return TOKEN + _class_of(LATER_SYMBOLS)


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalize_newlines(text) -> Column:
    return F.regexp_replace(_col(text), r"\r\n?", "\n")


def split_lines(text) -> Column:
    """Lines by every Unicode boundary; texts that only use LF take the plain single-character split."""
    text = _col(text)
    unusual = reduce(or_, (text.contains(mark) for mark in RARE_BREAKS))
    return F.when(unusual, F.split(normalize_newlines(text), LINE_BREAK, -1)).otherwise(F.split(text, "\n", -1))


def strip(text) -> Column:
    """Unicode-aware trim on both ends."""
    return F.btrim(_col(text), F.lit(SPACES))


def collapse_line(text) -> Column:
    """Runs of spaces and tabs become one space, then trim; clean lines skip the regex."""
    text = _col(text)
    untidy = text.contains("\t") | text.contains("  ")
    return strip(F.when(untidy, F.regexp_replace(text, r"[\t ]+", " ")).otherwise(text))


def clean_title(text, fallback) -> Column:
    fallback = F.lit(fallback) if isinstance(fallback, str) else fallback
    visible = F.regexp_replace(F.coalesce(_col(text), fallback), r"\p{C}", " ")
    cleaned = strip(F.regexp_replace(visible, rf"[{SPACE}]+", " "))
    return F.substring(F.when(cleaned == "", fallback).otherwise(cleaned), 1, MAX_TITLE_CHARS)


def file_stem(name) -> Column:
    """File name without its last suffix; a leading dot is not a suffix."""
    return F.regexp_replace(_col(name), r"(?<=.)\.[^.]+$", "")


def visible_chars(text) -> Column:
    """Count of letters and numbers."""
    return F.length(F.regexp_replace(_col(text), r"[^\p{L}\p{N}]", ""))


def fold(text) -> Column:
    """Case-folded text without diacritics; the table lookup only runs on non-ASCII rows.

    Capitals that the index does not know keep their case.
    """
    text = _col(text)
    capital = _class_of(LATER_CAPITALS)
    parts = F.split(text, rf"(?={capital})|(?<={capital})")
    kept = F.array_join(F.transform(parts, lambda part: F.when(part.rlike(rf"^{capital}"), part).otherwise(F.lower(part))), "")
    lowered = F.when(text.rlike(capital), kept).otherwise(F.lower(text))
    table = F.translate(lowered, ACCENTED + FOLD_FROM + SEPARATORS + SKIPPED_MARKS, PLAIN + FOLD_TO + " " * len(SEPARATORS))
    return F.when(text.rlike(r"[^\x00-\x7f]"), table).otherwise(F.lower(text))


def index_tokens(text) -> Column:
    """Words of the full-text index, in order."""
    return F.regexp_extract_all(fold(text), F.lit(f"[{token_class()}]+"), F.lit(0))


def count_tokens(folded: Column) -> Column:
    return F.regexp_count(folded, F.lit(f"[{token_class()}]+")).cast("long")


def count_phrase(folded: Column, words) -> Column:
    """Start positions of the word sequence in already folded text (overlaps count).

    A plain substring test on every word comes first; only rows that pass it pay for the regex.
    """
    first, *rest = words
    token = token_class()
    follow = "".join(rf"(?:(?![{token}])(?s:.))+{word}" for word in rest)
    counted = F.regexp_count(folded, F.lit(rf"(?<![{token}]){first}(?={follow}(?![{token}]))"))
    present = reduce(and_, (folded.contains(word) for word in words))
    return F.when(present, counted).otherwise(0).cast("long")


def contiguous_cjk(text) -> Column:
    """Two or more adjacent CJK characters: the index has no word segmentation for them."""
    return _col(text).rlike(CONTIGUOUS_CJK)


CONTIGUOUS_CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ac00}-\x{d7af}]{2,}"


def excerpt(text, limit) -> Column:
    return F.substring(_col(text), 1, limit)


def is_truncated(text, limit) -> Column:
    return F.length(_col(text)) > limit

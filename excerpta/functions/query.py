"""Query text rules: validation and translation into phrases, for one string or for a column."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

from excerpta.errors import SearchInputError
from excerpta.functions import text as tx

# --- fixed values -----------------------------------------------------------------------------
MAX_QUERY_CHARS = 400
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of",
    "on", "or", "that", "the", "this", "to", "was", "what", "when", "where", "which", "who", "why",
    "with",
)
# Word characters of a query (letters, numbers, underscore) and the hyphenated identifier form.
WORD = r"[\p{L}\p{N}_]+"
IDENTIFIER = r"^[\p{L}\p{N}_]+(-[\p{L}\p{N}_]+)+$"
# ----------------------------------------------------------------------------------------------


def bounded_int(value, name, maximum):
    if type(value) is not int or not 1 <= value <= maximum:
        raise SearchInputError(f"{name} must be an integer from 1 to {maximum}")
    return value


def checked_query(query):
    """Collapse white space and enforce 1-400 visible characters."""
    if not isinstance(query, str):
        raise SearchInputError("query must be text")
    query = " ".join(query.split())
    if not 1 <= len(query) <= MAX_QUERY_CHARS:
        raise SearchInputError(f"query must have 1-{MAX_QUERY_CHARS} characters")
    if any(unicodedata.category(char)[0] == "C" for char in query):
        raise SearchInputError("query must not contain control characters")
    return query


def _fold_word(word):
    """Index words inside one query word; an underscore separates, so this may be several."""
    table = str.maketrans(tx.ACCENTED + tx.FOLD_FROM + tx.SEPARATORS, tx.PLAIN + tx.FOLD_TO + " " * len(tx.SEPARATORS), tx.SKIPPED_MARKS)
    lowered = word.lower()
    if any(char.isupper() and ord(char) > 0x24F for char in word):  # capitals that the index does not know keep their case
        later = tx.code_ranges(tx.LATER_CAPITALS)
        lowered = "".join(c if any(a <= ord(c) <= b for a, b in later) else c.lower() for c in word)
    folded = lowered.translate(table)
    kept = (c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) in ("Co", "Cn") else " " for c in folded)
    return "".join(kept).split()


def phrases(query):
    """Phrases of a validated query as lists of index words; empty when nothing can match.

    A hyphenated identifier with a digit is one phrase. Otherwise every word is its own phrase,
    stop words are dropped unless nothing else is left, and a repeated word counts again.
    """
    words = re.findall(r"\w+", query)
    if re.fullmatch(r"\w+(?:-\w+)+", query) and any(c.isdigit() for c in query):
        groups = [words]
    else:
        groups = [[word] for word in words if word.casefold() not in STOPWORDS] or [[word] for word in words]
    found = ([part for word in group for part in _fold_word(word)] for group in groups)
    return [phrase for phrase in found if phrase]


def checked_query_column(query) -> Column:
    """Column form of ``checked_query``: the normalized text, or null where it would be refused."""
    query = F.col(query) if isinstance(query, str) else query
    normal = tx.strip(F.regexp_replace(query, rf"[{tx.SPACE}]+", " "))
    valid = F.length(normal).between(1, MAX_QUERY_CHARS) & ~normal.rlike(r"\p{C}")
    return F.when(valid, normal)


def query_status(query) -> Column:
    """``refused`` for a query that ``checked_query`` would refuse, ``empty`` for one without a word, else ``asked``."""
    normal = checked_query_column(query)
    return F.when(normal.isNull(), "refused").when(~normal.rlike(WORD), "empty").otherwise("asked")


def query_words(queries: DataFrame, query_id: str, query: str) -> DataFrame:
    """``(query_id, phrase, offset, words, term)`` for a whole table of queries.

    ``phrase`` numbers the phrases of a query in order, ``offset`` the word inside its phrase and
    ``words`` the phrase length. Refused queries and those without words yield no row: ``query_status`` tells them.
    """
    normal = checked_query_column(query)
    words = F.regexp_extract_all("_q", F.lit(WORD), F.lit(0))
    content = F.filter("_words", lambda word: ~F.lower(word).isin(*STOPWORDS))
    groups = F.when(
        F.col("_q").rlike(IDENTIFIER) & F.col("_q").rlike(r"\p{Nd}"), F.array(F.concat_ws(" ", "_words"))
    ).otherwise(F.when(F.size("_content") > 0, F.col("_content")).otherwise(F.col("_words")))
    return (
        queries.select(F.col(query_id), normal.alias("_q"))
        .filter(F.col("_q").isNotNull())
        .withColumn("_words", words)
        .withColumn("_content", content)
        .select(query_id, F.posexplode(groups).alias("phrase", "_group"))
        .withColumn("_terms", tx.index_tokens("_group"))
        .select(
            query_id,
            "phrase",
            F.size("_terms").alias("words"),
            F.posexplode("_terms").alias("offset", "term"),
        )
    )

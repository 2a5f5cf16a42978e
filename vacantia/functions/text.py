"""String building blocks shared by the other column functions."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0   　"


def quote(text):
    """Escape a literal for use inside a Java regex."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def alternation(phrases):
    """One regex group that matches any of ``phrases``.

    Shared prefixes are factored out, so a position in the text is rejected after one
    or two characters instead of after trying a hundred alternatives.
    """
    trie = {}
    for phrase in phrases:
        node = trie
        for ch in phrase:
            node = node.setdefault(ch, {})
        node[""] = {}

    def emit(node):
        tails = [quote(ch) + emit(child) for ch, child in node.items() if ch]
        if not tails:
            return ""
        body = tails[0] if len(tails) == 1 and "" not in node else "(?:" + "|".join(tails) + ")"
        return body + "?" if "" in node else body

    return "(?:" + emit(trie) + ")"


def has_phrase(col, phrases):
    """True where any phrase occurs in ``col`` between word boundaries, in any case."""
    return col.rlike(r"(?iU)\b" + alternation(phrases) + r"\b")


def has_any(col, words):
    """True where any of ``words`` is a substring of ``col`` (case matters)."""
    return col.rlike(alternation(words))


def strip(col):
    return F.btrim(col, F.lit(WHITESPACE))


def squeeze(col):
    """Trim and collapse runs of whitespace to one space."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def non_empty(col):
    return F.when(col != "", col)


def first_non_empty(*cols):
    return F.coalesce(*[non_empty(c) for c in cols])


def lookup(mapping, key):
    """Value of a fixed mapping for ``key``; null when absent.

    The mapping travels as one text that Spark folds to a constant, so that big tables
    do not swell the plan.
    """
    text = ",".join(f"{k}:{v}" for k, v in mapping.items())
    return F.try_element_at(F.str_to_map(F.lit(text), F.lit(","), F.lit(":")), key)


def is_one_of(values, col):
    """Membership in a fixed list, also as one constant."""
    return F.array_contains(F.split(F.lit("|".join(values)), r"\|"), col)


def title_case(col):
    """Capital after every non-letter, the rest lower case."""
    words = F.regexp_extract_all(F.lower(col), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(words, _capital), "")


def word_capitals(col):
    """Capital at each word start; other letters stay as they are."""
    words = F.regexp_extract_all(col, F.lit(r"(\w+|\W+)"), F.lit(1))
    return F.array_join(F.transform(words, _capital), "")


def _capital(word):
    return F.concat(F.upper(F.left(word, F.lit(1))), F.substring(word, 2, 1 << 30))


def percent_decode(col):
    return F.coalesce(F.try_url_decode(F.replace(col, F.lit("+"), F.lit("%2B"))), col)


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def bind(value, body):
    """``body(value)`` with ``value`` computed once, also where Spark inlines the column."""
    return F.get(F.transform(F.array(value), body), F.lit(0))

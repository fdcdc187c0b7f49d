"""Text functions as Column expressions: analysis, scrubbing, small helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the analyzer drops. Fixed values.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by",
    "for", "if", "in", "into", "is", "it", "its", "no", "not",
    "of", "on", "or", "such", "that", "the", "their", "then",
    "there", "these", "they", "this", "to", "was", "will", "with",
)

#: Personal data and secrets, and their marks, in the order of replacement. Fixed values.
SCRUB_RULES = (
    (r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[REDACTED_EMAIL]"),
    (r"\b(AKIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}\b", "[REDACTED_AWS_KEY_ID]"),
    (r"(?i)(?:aws_secret_access_key|secret_key|aws_secret)\s*[:=]\s*['\"]?([A-Za-z0-9/+=]{40})['\"]?", "[REDACTED_AWS_SECRET]"),
    (r"(?i)(password|passwd|secret|api_key|apikey|token|private_key)\s*[:=]\s*[\"']?([A-Za-z0-9_\-\.\~]{10,100})[\"']?", "$1:[REDACTED_SECRET]"),
    (r"(?s)-----BEGIN [A-Z ]+ PRIVATE KEY-----[\s\S]+?-----END [A-Z ]+ PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
    (r"\b(?:\+\d{1,3}[- ]?)?\(?\d{3}\)?[- ]?\d{3}[- ]?\d{4}\b", "[REDACTED_PHONE]"),
    (r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{1,4}\b", "[REDACTED_CC]"),
)

#: Stemming: a word with the suffix and longer than so many letters loses so many, and
#: with the mark also one of two equal consonants at its new end; the first rule that
#: fits counts, words of up to three letters stay. Fixed values.
STEM_RULES = (
    ("sses", 3, 2, False), ("ies", 3, 2, False), ("ied", 3, 2, False),
    ("edness", 8, 6, True), ("ingly", 7, 5, True), ("edly", 6, 4, True),
    ("ness", 5, 4, False), ("ment", 5, 4, False), ("tion", 5, 4, False), ("able", 5, 4, False), ("ible", 5, 4, False),
    ("ing", 5, 3, True), ("ful", 4, 3, False), ("ous", 4, 3, False), ("ive", 4, 3, False),
    ("ly", 4, 2, False), ("ed", 4, 2, True), ("er", 4, 2, True),
    ("ss", 3, 0, False), ("s", 3, 1, False),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row.

    Catalyst may put an expression into every place that refers to it, also into
    a lambda that runs for each element; a lambda's own variable can't be inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-case runs of letters and digits of two characters or more, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(*stop_words))


def stem(word: Column) -> Column:
    """A word without its suffix, by the first of the rules that fits."""
    result = word
    for suffix, longer, cut, single in reversed(STEM_RULES):
        short = F.left(word, F.length(word) - cut)
        if single:
            end = F.right(short, F.lit(1))
            doubled = (end == F.substring(short, -2, 1)) & (F.length(short) >= 2) & ~end.isin(*"aeiou")
            short = F.when(doubled, F.left(short, F.length(short) - 1)).otherwise(short)
        result = F.when(word.endswith(suffix) & (F.length(word) > longer), short).otherwise(result)
    return F.when(F.length(word) <= 3, word).otherwise(result)


def stems(text: Column) -> Column:
    return F.transform(tokens(text), stem)


def single_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def estimated_tokens(text: Column) -> Column:
    return F.floor((F.length(text) + 3) / 4).cast("long")


def scrubbed(text: Column) -> Column:
    for pattern, mark in SCRUB_RULES:
        text = F.regexp_replace(text, pattern, mark)
    return text


def markdown_title(text: Column, fallback: Column) -> Column:
    """The first heading of level one."""
    found = F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1)
    return F.when(found != "", F.trim(found)).otherwise(fallback)


def html_text(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags, the plain way."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return single_spaced(bare)


def content_tags(identifier: Column, text: Column, most_content: int = 5, most: int = 10) -> Column:
    """Parts of a path longer than two characters, then the longest words of the text's head."""
    path = F.filter(F.split(F.lower(identifier), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 2)
    words = F.array_distinct(F.filter(F.split(F.lower(F.left(text, F.lit(500))), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 4))
    longest = F.transform(F.sort_array(F.transform(words, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda s: s["t"])
    return F.slice(F.array_distinct(F.concat(path, F.slice(longest, 1, most_content))), 1, most)


def parsed_long(text: Column, default: int) -> Column:
    return F.coalesce(F.trim(text).try_cast("long"), F.lit(default))


def parsed_double(text: Column, default: float) -> Column:
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(default))

"""Text predicates and measures as column expressions, and parsers of query strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PATTERN = 500
#: A border of a word of ASCII letters, digits and underscores, as ``\b`` is in SQL; Java's ``\b`` counts letters beyond ASCII as parts of words.
BORDER = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def bordered(pattern: str) -> str:
    """The pattern with each ``\b`` between ASCII words."""
    return pattern.replace(r"\b", BORDER)


def parse_exclusions(search: str) -> tuple[str, list[str], list[str]]:
    """(what is left, excluded words, excluded phrases) of a search with ``-word`` and ``-"phrase"``."""
    phrases = [m.lower() for m in re.findall(r'(?:^|\s)-"([^"]+)"', search)]
    rest = re.sub(r'(?:^|\s)-"[^"]+"', " ", search)
    words = [m.lower() for m in re.findall(r"(?:^|\s)-(\w[\w-]*)", rest)]
    rest = re.sub(r"(?:^|\s)-\w[\w-]*", " ", rest)
    return " ".join(rest.split()), words, phrases


def excluded(text: Column, words: list[str], phrases: list[str]) -> Column:
    """True where the text has an excluded word, at word boundaries, or an excluded phrase anywhere."""
    hit = F.lit(False)
    for w in words:
        hit = hit | text.rlike(bordered(rf"(?i)\b{re.escape(w)}\b"))
    for p in phrases:
        hit = hit | F.lower(text).contains(p)
    return hit


def contains(text: Column, needle: str) -> Column:
    return F.lower(text).contains(needle.lower())


def fuzzy(text: Column, needle: str, threshold: float = 0.7) -> Column:
    """Substring, or an edit distance of at most (1 - threshold) of the longer string."""
    low = F.lower(text)
    most = F.floor(F.greatest(F.length(text), F.lit(len(needle))) * F.lit(round(1 - threshold, 6)))
    return low.contains(needle.lower()) | (F.levenshtein(low, F.lit(needle.lower())) <= most)


def _within(term: str, most: int):
    return lambda word: F.levenshtein(word, F.lit(term)) <= most


def fuzzy_terms(text: Column, search: str) -> Column:
    """Every term is near some word: distance 1 up to three letters, else three tenths of the term; single letters must be equal."""
    words = F.split(F.lower(text), r"\s+")
    all_terms = F.lit(True)
    for term in search.lower().split():
        most = 0 if len(term) == 1 else 1 if len(term) <= 3 else max(1, int(0.3 * len(term)))
        all_terms = all_terms & F.exists(words, _within(term, most))
    return all_terms


def safe_pattern(pattern: str) -> bool:
    """False for a pattern that is too long, invalid, or repeats a repetition (exponential to match)."""
    if len(pattern) > MAX_PATTERN or re.search(r"\([^()]*[+*][^()]*\)[+*{]", pattern) or re.search(r"\\\d", pattern):
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def regex(text: Column, pattern: str) -> Column:
    """Case-insensitive match in the first 10,000 characters; an unsafe pattern is searched as plain text."""
    return F.substring(text, 1, 10_000).rlike(f"(?i){pattern}") if safe_pattern(pattern) else contains(text, pattern)


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(F.lower(a), F.lower(b)) / longest)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def snippet(text: Column, most: int = 150) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most - 3), F.lit("...")))


def text_key(text: Column) -> Column:
    return F.substring(F.sha2(F.lower(F.trim(text)), 256), 1, 16)


def fts_terms(search: str, stop_words: frozenset[str]) -> list[str]:
    """Lower-case terms of a search: letters and digits only, two or more long, no stop words."""
    return [t for t in re.sub(r"[^A-Za-z0-9\s]", " ", search).lower().split() if len(t) >= 2 and t not in stop_words]


def on_path(path: Column, globs: tuple[str, ...]) -> Column:
    """Whether a path matches a glob (* and ?, letter case aside), or has the glob without its wildcards in it."""
    out = F.lit(False)
    for glob in globs:
        pattern = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)
        rest = re.sub(r"[*?]", "", glob)
        out = out | path.rlike(f"(?i)^{pattern}$") | (F.contains(path, F.lit(rest)) if rest else F.lit(False))
    return out


def iso_date(value: Column) -> Column:
    """A date, or a date and time to the second or millisecond; null for null."""
    return value.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d{3})?Z?)?$")


def _quoted(doubled: Column, when: Column) -> Column:
    return F.when(when, F.concat(F.lit('"'), doubled, F.lit('"'))).otherwise(doubled)


def as_phrase(said: Column) -> Column:
    """A search text as one phrase if it has blanks or operator signs."""
    doubled = F.replace(said, F.lit('"'), F.lit('""'))
    return _quoted(doubled, doubled.rlike(r"[\s+\-|*()]"))


def without_operators(said: Column) -> Column:
    """A search text whose operator words are read as words; blank texts stay as they are."""
    doubled = F.replace(said, F.lit('"'), F.lit('""'))
    return F.when(F.trim(said) == "", said).otherwise(_quoted(doubled, doubled.rlike(bordered(r"(?i)\b(AND|OR|NOT|NEAR(?:/\d+)?)\b"))))


def plain_tokens(said: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(said, '["*]', ""), "[^a-zA-Z0-9]+", " "))

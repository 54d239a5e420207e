"""Text expressions: trimming, word sets, similarity. All stay in the JVM."""

from __future__ import annotations

import re
from hashlib import blake2b

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a line's content.
STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being",
    "to", "and", "or", "but", "of", "in", "on", "at", "by", "for",
    "with", "as", "from", "that", "this", "it", "its", "also", "need",
    "we", "our", "us", "i", "my", "me", "he", "she", "they", "them",
    "their", "his", "her", "has", "have", "had", "do", "does", "did",
    "not", "no", "so", "if", "then", "than", "can", "will", "would",
]


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def word_set(line: Column) -> Column:
    """Distinct lower-case words of two characters or more that aren't stop words, as
    64-bit hashes: sets of numbers are compared several times as fast as sets of strings."""
    words = F.split(F.lower(line), r"(?U)\s+")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    said = F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))
    return F.array_distinct(F.transform(said, lambda w: F.xxhash64(w)))


_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ENDS = re.compile(rf"\A{_BLANKS.pattern}|{_BLANKS.pattern}\Z")
_STOP = frozenset(STOP_WORDS)


def stripped_words(raw: str) -> tuple[str, set[int]]:
    """strip() and word_set() of one line, for code that holds state between lines. The
    hashes are other ones: they are only compared with each other."""
    line = _ENDS.sub("", raw)
    said = {w for w in _BLANKS.split(line.lower()) if len(w) > 1} - _STOP
    return line, {int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for w in said}


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values: both empty 1, one empty 0."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / F.nullif(union, F.lit(0)))


def similar(a: Column, b: Column, least: float) -> Column:
    """jaccard(a, b) >= least; sizes alone settle most pairs."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return (small >= F.lit(least) * large) & (jaccard(a, b) >= F.lit(least))

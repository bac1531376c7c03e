"""Column functions over text: words, inline markup, paths, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words that carry no topic.
STOPWORDS = """how do i what the a an is are to in for my on of and with can you does when where which
that this it be use using need""".split()
# The domain's own name, left out by the split and the evaluation only.
DOMAIN_WORDS = ["ros", "ros2"]

EDGES = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, EDGES, "")


def normalize(c: Column) -> Column:
    """Lower case, only letters a-z, digits and spaces; everything else is deleted."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""))


def words(c: Column) -> Column:
    return F.filter(F.split(c, " +"), lambda w: w != "")


def content_words(c: Column, stopwords: list[str] = STOPWORDS, glue: bool = True) -> Column:
    """Distinct words but the stopwords. ``glue``: other characters are deleted, which joins what they
    parted; else they count as spaces."""
    clean = normalize(c) if glue else F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " ")
    return F.array_except(F.array_distinct(words(clean)), F.array(*map(F.lit, stopwords)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def covered(part: Column, whole: Column) -> Column:
    """Share of ``part``'s elements that ``whole`` has; 0 of none."""
    return F.when(F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(part)).otherwise(0.0)


def top_dir(path: Column) -> Column:
    """First component of a path with either separator."""
    return F.split(path, r"[\\/]")[0]


def page_url(path: Column, base: str) -> Column:
    return F.concat(F.lit(base), F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"(?<=[^/])\.[^./]+$", ""), F.lit(".html"))


# Fixed patterns of inline markup, in the order they are resolved, with what stays.
INLINE = [
    (r"`([^`<]+?)\s*<([^>]+)>`__?", "$1 ($2)"),
    (r":\w+:`([^`<]+?)\s*<[^>]+>`", "$1"),
    (r":\w+:`([^`]+)`", "$1"),
    (r"``([^`]+)``", "`$1`"),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"(?<!\*)\*([^*\n]+)\*(?!\*)", "$1"),
    (r"(?m)^\.\.\s+_[^:]+:\s*$", ""),
    (r"\|([^|]+)\|", "$1"),
]


# What Python's classes and line ends are called in the JVM's patterns, where they are narrower by default.
JVM_CLASSES = {r"\w": r"[\p{L}\p{N}_]", r"\s": r"[\p{IsWhite_Space}\x1c-\x1f]", "(?m)": "(?dm)"}


def clean_inline(c: Column) -> Column:
    """A line's words without its inline markup."""
    for pattern, kept in INLINE:
        for own, jvm in JVM_CLASSES.items():
            pattern = pattern.replace(own, jvm)
        c = F.regexp_replace(c, pattern, kept)
    return c


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")


def tokens(c: Column, counter: Callable[[Column], Column] | None = None) -> Column:
    """Token count: a quarter of the characters, one at least; or the caller's own counter."""
    return counter(c) if counter else F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))

"""Column helpers for text keys, widths, bigrams and repetition (all JVM side)."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# white space in the Unicode sense; the flag is much faster than a class listing the characters
WS = r"(?U)\s"


def squeeze(text: Column) -> Column:
    """Runs of white space become one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def compact(text: Column) -> Column:
    """All white space removed."""
    return F.regexp_replace(text, WS + "+", "")


def word_key(text: Column) -> Column:
    """Lower case letters and digits only: the key for 'same words'."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


@F.pandas_udf(T.StringType())
def nfkc_key(text: pd.Series) -> pd.Series:
    """Compatibility-folded lower-case key (no built-in Unicode normaliser exists)."""
    import unicodedata

    def one(value):
        return None if value is None else unicodedata.normalize("NFKC", value).casefold()

    return text.map(one)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-block ratio of two strings; the argument order matters."""
    from difflib import SequenceMatcher

    return pd.Series([
        1.0 if not a and not b else SequenceMatcher(None, a or "", b or "", autojunk=False).ratio() for a, b in zip(left, right)
    ])


@F.pandas_udf(T.ArrayType(T.StringType()))
def pack_words(text: pd.Series, limit: pd.Series) -> pd.Series:
    """Words packed greedily into pieces of at most ``limit`` characters."""
    def one(value, size):
        made, line = [], ""
        for word in value.split(" "):
            if line and len(line) + 1 + len(word) > size:
                made.append(line)
                line = word
            else:
                line = f"{line} {word}" if line else word
        return [*made, line]

    return pd.Series([one(v or "", n) for v, n in zip(text, limit)])


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it.

    Inside a lambda an expression is evaluated per element; a bound variable is not.
    """
    return F.get(F.transform(F.array(value), body), 0)


def bigrams(text: Column) -> Column:
    """Distinct character pairs; a text shorter than two stands for itself."""
    def pairs(t: Column) -> Column:
        spots = F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1)))
        return F.when(F.length(t) < 2, F.array(t)).otherwise(F.array_distinct(F.transform(spots, lambda i: t.substr(i, F.lit(2)))))

    return bind(text, pairs)


def jaccard(left: Column, right: Column) -> Column:
    """Share of common bigrams of two texts."""
    both = F.struct(bigrams(left).alias("a"), bigrams(right).alias("b"))
    return bind(both, lambda p: F.size(F.array_intersect(p["a"], p["b"])).cast("double") / F.size(F.array_union(p["a"], p["b"])))


def similarity(kind: str, left: Column, right: Column) -> Column:
    """``bigram`` stays in the JVM; ``sequence`` is the Arrow-batched ratio."""
    if kind == "bigram":
        return jaccard(left, right)
    if kind == "sequence":
        return sequence_ratio(left, right)
    raise ValueError(f"unknown similarity {kind!r}")


@functools.cache
def wide_class() -> str:
    """A character class of all code points whose East Asian width is wide, full or ambiguous."""
    import unicodedata

    ends, inside = [], False
    for i in range(0x80, 0x110000):
        wide = not 0xD800 <= i < 0xE000 and unicodedata.east_asian_width(chr(i)) in "WFA"
        if wide != inside:
            ends.append(i if wide else i - 1)
            inside = wide
    ends += [0x10FFFF] if inside else []
    return "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in zip(ends[::2], ends[1::2], strict=True)) + "]"


def display_width(text: Column) -> Column:
    """Wide, full-width and ambiguous characters count one, other visible characters half."""
    solid = compact(text)
    # plain characters are taken out first: the class is long
    wide = F.regexp_count(F.regexp_replace(solid, r"[\x00-\x7F]+", ""), F.lit(wide_class()))
    return wide + (F.length(solid) - wide) * F.lit(0.5)


# fixed values: one to three characters repeated at least four more times
RUNAWAY = r"(.{1,3})\1{4,}"


def has_runaway(text: Column) -> Column:
    return F.coalesce(compact(text).rlike(RUNAWAY), F.lit(False))


def squash_runaway(text: Column) -> Column:
    """Five or more copies of a short unit become one copy and an ellipsis."""
    return F.regexp_replace(text, r"(.{1,4}?)\1{4,}", "$1…")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def cps(text: Column, start_ms: Column, end_ms: Column) -> Column:
    """Visible characters per second; null when the duration is not positive."""
    return F.when(end_ms > start_ms, F.length(compact(text)) * F.lit(1000.0) / (end_ms - start_ms))


def reading_ms(text: Column) -> Column:
    """Comfortable reading time: 0.8 s plus a second per seven characters, 1 to 8 s."""
    chars = F.length(compact(text))
    return F.least(F.lit(8000), F.greatest(F.lit(1000), F.floor(chars * 1000 / 7) + 800)).cast("long")


def multiset_equal(left: Column, right: Column) -> Column:
    """Two arrays hold the same items equally often."""
    return F.coalesce(F.array_sort(left) == F.array_sort(right), F.lit(False))


def multiset_covers(have: Column, need: Column) -> Column:
    """Every item of ``need`` occurs in ``have`` at least as often."""
    def times(arr: Column, item: Column) -> Column:
        return F.size(F.filter(arr, lambda y: y == item))

    both = F.struct(have.alias("have"), need.alias("need"))
    return bind(both, lambda p: F.forall(F.array_distinct(p["need"]), lambda x: times(p["have"], x) >= times(p["need"], x)))


def stable_id(*parts: Column) -> Column:
    return F.concat_ws(":", *[p.cast("string") for p in parts])

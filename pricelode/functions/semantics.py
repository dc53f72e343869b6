"""Rules for missing values, rounding and text that all jobs share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word border that, unlike Java's, sees ASCII only.
BORDER_LEFT, BORDER_RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def first_nonzero(*columns: Column) -> Column:
    """The first value that is neither null nor 0."""
    return F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in columns])


def first_present(*columns: Column) -> Column:
    """The first value that is not null; if that is 0, nothing."""
    return F.nullif(F.coalesce(*columns), F.lit(0.0))


def half_up(c: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    k = 10.0**digits
    return F.floor(c * k + 0.5) / k


def filled(c: Column) -> Column:
    """Empty text is missing."""
    return F.nullif(c, F.lit(""))


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def epoch(c: Column) -> Column:
    """Seconds or, above 1e11, milliseconds since 1970."""
    return F.when(c > 100_000_000_000, F.timestamp_millis(c)).otherwise(F.timestamp_seconds(c))


def matched(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without a match."""
    return filled(F.regexp_extract(text, pattern, group))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once. Where a body names a long expression many times over, and is
    itself the value of the next, the expression would otherwise be copied into itself again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))

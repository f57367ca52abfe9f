"""Scalar functions over text and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate_text(c: Column, most: int, suffix: str = "\n... (output truncated)") -> Column:
    """At most ``most`` characters, the suffix included where text is cut."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - len(suffix)), F.lit(suffix)))


def cap_text(c: Column, most: int, suffix: str = "\n// ... truncated") -> Column:
    """The first ``most`` characters, and the suffix after them where text is cut."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most), F.lit(suffix)))


def relative_age(date: Column, as_of: Column) -> Column:
    """How long ago in words; whole days of 24 hours."""
    days = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(date.cast("timestamp"))) / F.lit(86_400_000_000)).cast("long")
    ago = lambda unit, n: F.concat(F.floor(days / n).cast("string"), F.lit(f" {unit} ago"))
    return (
        F.when(days == 0, "today")
        .when(days == 1, "yesterday")
        .when(days < 7, ago("days", 1))
        .when(days < 30, ago("weeks", 7))
        .otherwise(ago("months", 30))
    )


def commit_summary(message: Column) -> Column:
    """The first line, at most 100 characters."""
    return F.substring(F.get(F.split(message, "\n"), F.lit(0)), 1, 100)


def list_to_text(c: Column, default: str = "") -> Column:
    """An array's items on lines of their own; null gives the default."""
    return F.coalesce(F.array_join(c, "\n"), F.lit(default))


def qualified_name(contract: Column, function: Column) -> Column:
    return F.concat_ws(".", contract, function)


def flow_text(path: Column) -> Column:
    return F.array_join(path, " -> ")


def contains_any(c: Column, words) -> Column:
    """Whether the lower-cased text holds any of the words, as one alternation."""
    return F.lower(c).rlike("|".join("\\Q" + w + "\\E" for w in words))

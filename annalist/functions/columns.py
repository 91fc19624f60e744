"""Small building blocks shared by the text expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text_array(values: Iterable[str]) -> Column:
    """A literal ``array<string>``, typed even when empty."""
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """Regex group, or null when the pattern does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once.

    An expression mentioned inside a lambda is evaluated for every element; bound this
    way it is a variable there.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_of(items: Column) -> Column:
    """First element, null for an empty array."""
    return F.get(items, F.lit(0))


def share(part: Column, whole: Column, empty: float | None = None) -> Column:
    """``part / whole`` as a double, ``empty`` when ``whole`` is zero."""
    return F.when(whole == 0, F.lit(empty).cast("double")).otherwise(
        part.cast("double") / whole.cast("double")
    )


def any_term(text: Column, terms: Iterable[str]) -> Column:
    """Does the text contain any of the terms?"""
    condition = F.lit(False)
    for term in terms:
        condition = condition | text.contains(F.lit(term))
    return condition


def count_terms(text: Column, terms: Iterable[str]) -> Column:
    """How many of the terms the text contains."""
    total = F.lit(0)
    for term in terms:
        total = total + text.contains(F.lit(term)).cast("int")
    return total


#: White space stripped from both ends of texts, the Chinese full-width blank included.
BLANKS = " \t\n\r\u000b\u000c\u00a0\u3000"


def trimmed(text: Column) -> Column:
    """Strip white space at both ends."""
    return F.btrim(text, F.lit(BLANKS))

"""Years, months and places read from free text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import lexicons as lx
from .columns import all_matches, as_col, first_of, found, text_array


def to_arabic(text: Column) -> Column:
    return F.translate(text, lx.CHINESE_DIGITS, lx.ARABIC_DIGITS)


def extract_year(text: Column | str, strict: bool = False) -> Column:
    """First pattern that matches anywhere wins; two digits get a century.

    ``strict`` keeps the historical defects: a spelled-out year is read by its last
    two numerals, and years written with the round zero are missed. Otherwise
    spelled-out years are read in full.
    """
    text = as_col(text)

    def century(two: Column) -> Column:
        return F.concat(F.when(two.cast("int") > 50, F.lit("19")).otherwise(F.lit("20")), two)

    four = found(text, r"([0-9]{4})\s*年")
    two = found(text, r"([0-9]{2})\s*年")
    numerals = "零一二三四五六七八九"
    if strict:
        spelled = F.coalesce(
            found(text, f"一九([{numerals}]{{2}})年"), found(text, f"二[零〇]([{numerals}]{{2}})年")
        )
        spelled = century(to_arabic(spelled))
    else:
        spelled = to_arabic(found(text, "([一二][零〇○一二三四五六七八九]{3})年"))
    return F.coalesce(four, century(two), spelled, found(text, "([0-9]{4})"))


def extract_month(text: Column | str) -> Column:
    """Digits before the month sign, else the numerals one to twelve."""
    text = as_col(text)
    months = F.create_map(*[F.lit(x) for pair in lx.CHINESE_MONTHS.items() for x in pair])
    return F.coalesce(
        found(text, r"([0-9]{1,2})\s*月"), months[found(text, "([一二三四五六七八九十]+)月")]
    )


def extract_location(
    text: Column | str,
    gazetteer: Sequence[str] = tuple(lx.CITIES),
    home_words: Sequence[str] = tuple(lx.HOME_WORDS),
) -> Column:
    """First city in gazetteer order that is not a place of departure, else a phrase."""
    text = as_col(text)
    cities = text_array(gazetteer)
    present = F.filter(cities, lambda c: text.contains(c))
    arrived = F.filter(
        present, lambda c: ~F.rlike(text, F.concat(F.lit("从"), c, F.lit("(?:来|出发|离开)")))
    )
    phrase = found(text, r"(?:在|到|来到|去|前往|抵达|位于)\s*([^\s,，。！？\n]{2,6}(?:省|市|区|镇|村)?)")
    usable = F.when(~phrase.rlike("|".join(home_words)), phrase)
    district = F.when(usable.endswith("区"), first_of(present))
    return F.coalesce(first_of(arrived), district, usable)


def extract_years(text: Column | str) -> Column:
    """All years as four digits, distinct, in order of appearance."""
    matches = F.transform(all_matches(as_col(text), lx.YEAR_PATTERN), to_arabic)
    return F.array_distinct(matches)


def years_in_range(text: Column | str, low: int = 1000, high: int = 2100) -> Column:
    """Distinct four-digit numbers that can be years."""
    numbers = F.transform(all_matches(as_col(text), "[0-9]{4}"), lambda y: y.cast("int"))
    return F.array_distinct(F.filter(numbers, lambda y: y.between(low, high)))


def temporal_label(years: Column | str) -> Column:
    """``1972`` or ``1972-1977``; empty without years."""
    numbers = F.transform(as_col(years), lambda y: y.cast("int"))
    low, high = F.array_min(numbers), F.array_max(numbers)
    return (
        F.when(low.isNull(), F.lit(""))
        .when(low == high, low.cast("string"))
        .otherwise(F.concat_ws("-", low.cast("string"), high.cast("string")))
    )


def year_span(years: Column | str) -> Column:
    """Distance between the latest and the earliest year, null without years."""
    numbers = F.transform(as_col(years), lambda y: y.cast("int"))
    return F.array_max(numbers) - F.array_min(numbers)


def split_reason(text: Column | str, position: Column | str) -> Column:
    """Why a segment starts where it starts."""
    text = as_col(text)
    return (
        F.when(as_col(position) == 0, "document_start")
        .when(text.rlike(lx.LEADING_YEAR_PATTERN), "temporal_boundary")
        .when(text.rlike("(?m)\\A" + lx.HEADING_PATTERN[1:]), "chapter_heading")
        .otherwise("paragraph_break")
    )

"""Row filters of the retrieval and quality operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicons as lx
from ..functions.columns import any_term, as_col, share
from ..functions.text import keyword_set, normalize_text


def drop_stop_entities(entities: DataFrame, title: str = "title", stop: Sequence[str] = tuple(lx.STOP_ENTITIES)) -> DataFrame:
    """Remove generic titles (a fixed short list, pushed into the scan)."""
    return entities.where(~F.coalesce(F.col(title).isin(list(stop)), F.lit(False)))


def drop_blocked(df: DataFrame, text: Column | str, blocklist: Sequence[str], upper: bool = False) -> DataFrame:
    """Remove rows whose text holds any blocked term."""
    text = as_col(text)
    if upper:
        text, blocklist = F.upper(text), [b.upper() for b in blocklist]
    return df.where(~F.coalesce(any_term(text, blocklist), F.lit(False)))


def long_enough(df: DataFrame, text: str = "text", minimum: int = 50) -> DataFrame:
    return df.where(F.length(text) >= minimum)


def year_in_head(text: Column | str, year: Column, head: int = 300) -> Column:
    """The year followed by a blank or the year sign near the start of the text."""
    lead = F.left(as_col(text), F.lit(head))
    return F.rlike(lead, F.concat(year, F.lit(r"[\s年]")))


def place_matches(
    text: Column | str,
    place: Column,
    nearby: Sequence[str] = tuple(lx.NEARBY_CITIES),
    regions: Sequence[str] = tuple(lx.REGIONS),
) -> Column:
    """The place itself, a neighbouring city, or a region; false without a place."""
    text = as_col(text)
    return F.coalesce(
        (place != "") & (text.contains(place) | any_term(text, [*nearby, *regions])), F.lit(False)
    )


def significant_overlap(snippet: Column | str, flat_text: Column, threshold: float = 0.8) -> Column:
    """More than the threshold share of the snippet's keywords occur in the text."""
    words = keyword_set(snippet, 3)
    hits = F.size(F.filter(words, lambda w: flat_text.contains(normalize_text(w))))
    return (F.size(words) > 0) & (share(hits, F.size(words), 0.0) > threshold)


def is_fact_candidate(candidate: Column, markers: Sequence[str] = tuple(lx.FACT_MARKERS)) -> Column:
    return (F.length(candidate) >= 3) | any_term(candidate, markers)


def corpus_filter(df: DataFrame, term: str, columns: Sequence[str], ignore_case: bool = False) -> DataFrame:
    """Rows where any of the columns contains the term."""
    needle = F.lit(term.lower() if ignore_case else term)
    condition = F.lit(False)
    for name in columns:
        value = F.lower(name) if ignore_case else F.col(name)
        condition = condition | F.coalesce(value.contains(needle), F.lit(False))
    return df.where(condition)


def remove_verified(findings: DataFrame, verified: DataFrame, keys: Sequence[str], text: str, fact: str) -> DataFrame:
    """Drop findings that contain, or are contained in, a verified fact of the same key.

    A pair overlaps in that sense only if the shorter one lies inside the longer one, so
    both directions run as gram joins within the key; findings without a hit remain.
    """
    from .matching import contains_join

    keys = list(keys)
    # JSON keeps null and empty keys apart; the wide digest stands for the finding itself.
    scoped = F.to_json(F.struct(*keys))
    identity = F.sha2(F.to_json(F.struct(*keys, F.col(text).alias("_text"))), 256)
    f = findings.select(identity.alias("_fid"), scoped.alias("_key"), F.col(text).alias("_f"))
    f = f.dropDuplicates(["_fid"])
    v = verified.select(scoped.alias("_key"), F.col(fact).alias("_v")).where(F.col("_v") != "").distinct()
    holds = contains_join(f.select("_fid", "_f"), v, "_fid", "_f", "_v")
    hit_a = f.join(holds, "_fid").join(v, ["_key", "_v"], "left_semi").select("_fid")
    vid = v.withColumn("_vid", F.sha2(F.to_json(F.struct("_key", "_v")), 256))
    inside = contains_join(vid.select("_vid", "_v"), f, "_vid", "_v", "_f")
    hit_b = (
        inside.join(vid.select("_vid", "_key"), "_vid").join(f, ["_key", "_f"]).select("_fid")
    )
    hits = hit_a.unionByName(hit_b).distinct()
    return (
        findings.withColumn("_fid", identity)
        .join(hits, "_fid", "left_anti")
        .drop("_fid")
    )

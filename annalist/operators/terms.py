"""Term tables: tokens, TF-IDF, key phrases, aliases, query expansion."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import lexicons as lx
from ..functions.columns import all_matches, as_col, let, text_array
from ..functions.text import lexicon_hits

#: Runs of letters of the Latin scripts, or of Chinese characters.
WORD_PATTERN = "[A-Za-zÀ-ÖØ-öø-ÿ]+|[一-龥]+"


def tokens(text: Column | str, pattern: str = WORD_PATTERN, min_len: int = 2, stop: Sequence[str] = ()) -> Column:
    """Lower-cased words in order, short ones and stop words removed."""
    if re.fullmatch(r"\[[^\]\[]+\]\+", pattern) and min_len > 0:
        # Runs of one class: the pattern itself leaves out the short ones.
        kept = all_matches(F.lower(as_col(text)), f"{pattern[:-1]}{{{min_len},}}")
    else:
        kept = F.filter(all_matches(F.lower(as_col(text)), pattern), lambda w: F.length(w) >= min_len)
    if not stop:
        return kept
    stops = text_array(stop)
    return F.filter(kept, lambda w: ~F.array_contains(stops, w))


def counted(values: Column) -> Column:
    """Distinct values of an array with their number and first place: ``array<struct<value, count, first>>``."""

    def runs(ordered: Column) -> Column:
        at = F.filter(
            F.sequence(F.lit(0), F.greatest(F.size(ordered), F.lit(1)) - 1),
            lambda i: (i < F.size(ordered)) & ((i == 0) | (F.get(ordered, i)["value"] != F.get(ordered, i - 1)["value"])))
        return let(at, lambda starts: F.transform(starts, lambda i, j: F.struct(
            F.get(ordered, i)["value"].alias("value"), (F.coalesce(F.get(starts, j + 1), F.size(ordered)) - i).cast("long").alias("count"),
            F.get(ordered, i)["first"].alias("first"))))

    return let(F.sort_array(F.transform(values, lambda v, i: F.struct(v.alias("value"), i.alias("first")))), runs)


def by_repeat(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose keys no other row has, and the others, None if there are none."""
    repeated = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    if repeated.isEmpty():
        return df, None
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return df.join(repeated, same, "left_anti"), df.join(repeated, same, "left_semi")


def term_counts(df: DataFrame, doc_id: str, words: Column) -> DataFrame:
    """``(doc_id, term, tf)``; counts combine before the shuffle."""
    return (
        df.select(doc_id, F.explode(words).alias("term"))
        .groupBy(doc_id, "term")
        .agg(F.count("*").alias("tf"))
    )


def document_frequencies(df: DataFrame, words: Column, vocabulary: DataFrame | None = None) -> DataFrame:
    """``(term, df)``: number of rows whose words hold the term.

    Words are made distinct inside the row, so only one combined count per term is
    shuffled. A ``vocabulary(term)`` restricts the count to the terms that are asked for.
    """
    # The outer form keeps the optimizer from repeating the word split in a size filter.
    rows = df.select(F.explode_outer(F.array_distinct(words)).alias("term")).where(F.col("term").isNotNull())
    if vocabulary is not None:
        rows = rows.join(vocabulary.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("term").agg(F.count("*").alias("df"))


def tfidf(df: DataFrame, doc_id: str, words: Column, n_documents: Column | int, k: int = 15, frequencies: DataFrame | None = None) -> DataFrame:
    """Top terms per document by ``tf/len * ln((N+1)/(df+1))``, ties by term.

    The frequency table has one row per term, so a term held by every document skews
    only the counts side, which adaptive execution splits. ``frequencies(term, df)`` may
    come from another corpus; terms it lacks then count as unseen.
    """
    n_documents = F.lit(n_documents) if isinstance(n_documents, int) else n_documents
    # The outer form keeps the optimizer from repeating the word split in a size filter.
    single, repeated = by_repeat(df, [doc_id])
    counts = (
        single.select(doc_id, words.alias("_w"))
        .select(doc_id, F.size("_w").alias("_len"), F.explode_outer(counted(F.col("_w"))).alias("_c"))
        .where(F.col("_c").isNotNull())
        .select(doc_id, F.col("_c.value").alias("term"), "_len", F.col("_c.count").alias("tf"))
    )
    if repeated is not None:
        exploded = (
            repeated.select(doc_id, words.alias("_w"))
            .select(doc_id, F.size("_w").alias("_len"), F.explode_outer("_w").alias("term"))
            .where(F.col("term").isNotNull())
        )
        # The length depends on the document alone; as a key it needs neither a join nor a merge.
        counts = counts.unionByName(exploded.groupBy(doc_id, "term", "_len").agg(F.count("*").alias("tf")))
    if frequencies is None:
        joined = counts.join(document_frequencies(df, words), "term")
    else:
        joined = counts.join(frequencies, "term", "left").fillna(0, ["df"])
    weighted = joined.withColumn(
        "weight", F.col("tf") / F.col("_len") * F.ln((n_documents + 1) / (F.col("df") + 1))
    )
    order = Window.partitionBy(doc_id).orderBy(F.desc(F.round("weight", 9)), "term")
    return (
        weighted.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(doc_id, "rank", "term", "tf", "df", "weight")
    )


def keywords(
    df: DataFrame, top_terms: DataFrame, doc_id: str, text: str,
    stop: Sequence[str] = tuple(lx.KEYWORD_STOP_WORDS), events: Sequence[str] = tuple(lx.EVENT_TERMS), k: int = 10,
) -> DataFrame:
    """Ranked terms without stop words and numbers, then event terms in the text; first k."""
    ranked = (
        top_terms.where(~F.col("term").isin(list(stop)) & (F.length("term") >= 2) & ~F.col("term").rlike("^[0-9]+$"))
        .groupBy(doc_id)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "term")))["term"].alias("_ranked"))
    )
    allowed = [e for e in events if e not in set(stop)]
    # Looked for before the join, the text is not shuffled unless it is asked for.
    merged = F.concat(F.coalesce("_ranked", text_array([])), F.col("_hits"))
    return df.withColumn("_hits", lexicon_hits(text, allowed)).join(ranked, doc_id, "left").select(
        *df.columns, F.slice(F.array_distinct(merged), 1, k).alias("keywords")
    )


def bigrams(words: Column, joiner: str = "") -> Column:
    """Adjacent pairs of an array, joined."""
    return let(
        words,
        lambda ws: F.transform(
            F.slice(ws, 2, F.greatest(F.size(ws), F.lit(1))), lambda w, i: F.concat(F.get(ws, i), F.lit(joiner), w)
        ),
    )


def phrase_candidates(words: Column, joiner: str = "") -> Column:
    """Single words and adjacent pairs; nothing for fewer than two words."""
    return let(
        words, lambda ws: F.when(F.size(ws) >= 2, F.concat(ws, bigrams(ws, joiner))).otherwise(text_array([]))
    )


def char_phrase_candidates(text: Column | str) -> Column:
    """Three- and two-character windows over the Chinese characters of a text."""
    clean = F.regexp_replace(as_col(text), "[^一-龥]", "")
    skip = text_array(["的是", "了的", "在了", "是的", "和的", "不是"])
    both = F.concat(all_matches(clean, "(?=(.{3}))", 1), all_matches(clean, "(?=(.{2}))", 1))
    kept = F.filter(both, lambda g: ~F.array_contains(skip, g))
    return F.when(F.length(clean) >= 4, kept).otherwise(text_array([]))


def key_phrases(df: DataFrame, keys: Sequence[str], candidates: Column, n: int = 8, min_count: int = 2) -> DataFrame:
    """Most frequent repeated phrases per row key: ``(*keys, rank, phrase, count)``.

    Equal counts are ordered by first appearance. Rows whose keys are their own are counted in place, others by a shuffle.
    """
    keys = list(keys)
    single, repeated = by_repeat(df, keys)
    often = F.transform(
        F.filter(counted(candidates), lambda c: c["count"] >= min_count),
        lambda c: F.struct((-c["count"]).alias("loss"), c["first"].alias("first"), c["value"].alias("phrase")))
    top = single.select(*keys, F.posexplode(F.slice(F.sort_array(often), 1, n)).alias("_at", "_c")).select(
        *keys, (F.col("_at") + 1).alias("rank"), F.col("_c.phrase").alias("phrase"), (-F.col("_c.loss")).alias("count"))
    return top if repeated is None else top.unionByName(_shuffled_phrases(repeated, keys, candidates, n, min_count))


def _shuffled_phrases(df: DataFrame, keys: list[str], candidates: Column, n: int, min_count: int) -> DataFrame:
    exploded = df.select(*keys, F.posexplode(candidates).alias("_pos", "phrase"))
    counted = exploded.groupBy(*keys, "phrase").agg(F.count("*").alias("count"), F.min("_pos").alias("_first"))
    order = Window.partitionBy(*keys).orderBy(F.desc("count"), "_first")
    return (
        counted.where(F.col("count") >= min_count)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .select(*keys, "rank", "phrase", "count")
    )


def alias_table(spark: SparkSession, aliases: dict[str, str] | None = None) -> DataFrame:
    """Two-way alias pairs ``(term, alias)`` of a fixed map."""
    aliases = lx.TERM_ALIASES if aliases is None else aliases
    rows = [(a, b) for a, b in aliases.items()] + [(b, a) for a, b in aliases.items()]
    return spark.createDataFrame(rows, "term string, alias string")


def name_variants(name: Column | str, groups: dict[str, list[str]] | None = None) -> Column:
    """Distinct lower-cased spellings of a name: itself and its alias group."""
    name = F.lower(as_col(name))
    groups = lx.NAME_VARIANTS if groups is None else groups
    flat: dict[str, list[str]] = {}
    for members in groups.values():
        lowered = list(dict.fromkeys(m.lower() for m in members))
        for member in lowered:
            flat.setdefault(member, lowered)
    if not flat:
        return F.array(name)
    table = F.create_map(*[x for k, v in flat.items() for x in (F.lit(k), text_array(v))])
    return F.array_distinct(F.concat(F.array(name), F.coalesce(table[name], text_array([]))))


def canonical_name(name: Column | str, groups: dict[str, list[str]] | None = None) -> Column:
    """One id per name: the smallest spelling of its alias group."""
    return F.array_min(name_variants(name, groups))


def translate_alias(term: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """The other script's spelling of a term, null when unknown."""
    aliases = lx.TERM_ALIASES if aliases is None else aliases
    if not aliases:
        return F.lit(None).cast("string")
    term = as_col(term)
    there = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    back = F.create_map(*[F.lit(x) for a, b in aliases.items() for x in (b, a)])
    return F.coalesce(there[term], back[F.upper(term)])


def expand_terms(
    queries: DataFrame, place_weight: int = 20, aliases: dict[str, str] | None = None,
    alias_is_place: bool = True, n_keywords: int = 5, always_topics: bool = False,
) -> DataFrame:
    """Weighted search terms ``(query_id, term, weight, kind)`` of each query.

    Year 30, neighbour years 10, place and its alias ``place_weight``, topics 15. A
    topic that repeats the year or the place counts as that kind, unless ``always_topics``.
    """
    aliases = lx.ENTITY_PLACE_ALIASES if aliases is None else aliases
    year, place = F.col("year"), F.col("location")
    number = F.expr("try_cast(year AS INT)")
    alias = F.lit(None).cast("string")
    if aliases:
        alias = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])[place]

    def entry(term: Column, weight: int, kind: Column | str) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(term.alias("term"), F.lit(weight).alias("weight"), kind.alias("kind"))

    topics = F.filter(
        F.slice(F.coalesce("keywords", text_array([])), 1, n_keywords), lambda k: F.length(k) >= 2
    )
    same_place = [place, *([alias] if alias_is_place else [])]

    def topic_kind(k: Column) -> Column:
        if always_topics:
            return F.lit("topic")
        is_place = F.lit(False)
        for other in same_place:
            is_place = is_place | F.coalesce(
                (F.upper(k) == F.upper(other)) if alias_is_place else (k == other), F.lit(False)
            )
        return (
            F.when(F.coalesce(k == year, F.lit(False)), "year").when(is_place, "place").otherwise("topic")
        )

    entries = F.concat(
        F.array(
            entry(year, 30, "year"),
            entry((number - 1).cast("string"), 10, "near_year"),
            entry((number + 1).cast("string"), 10, "near_year"),
            entry(place, place_weight, "place"),
            entry(alias, place_weight, "place" if alias_is_place else "alias"),
        ),
        F.transform(topics, lambda k: entry(k, 15, topic_kind(k))),
    )
    present = F.filter(entries, lambda e: F.coalesce(e["term"] != "", F.lit(False)))
    return queries.select("query_id", F.inline(present))

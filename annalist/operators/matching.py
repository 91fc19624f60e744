"""Substring joins: which texts contain which terms.

``text contains term`` has no join key of its own. It becomes an equi-join on character grams: each term is filed under
one anchor, that of its grams which the texts hold least often, and any text that contains the term holds the anchor,
too. Texts are cut into the grams at all their places, met with the anchors, and the candidates verified. Terms
are tiered by length. The anchors are broadcast while their size, which is
measured, allows it, and shuffled beyond; there is no other difference. A few terms are looked for one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import let
from ..session import cut_lineage

#: Length of a term from which on it uses grams of a length, longest first. Fewer lengths mean fewer places to look at.
TIERS = {24: 12, 4: 4, 2: 2, 1: 1}
#: Beyond so many terms, grams of four are shared by too many of them: numbered names have but 10 000 ends of four digits.
MANY_TERMS, FINE_TIERS = 20_000, {12: 12, 8: 8, 4: 4, 2: 2, 1: 1}
#: Terms shorter than this are looked for in the surroundings of their anchor, others in the whole text.
MARGIN = 24
#: The tier of long terms with words between blanks: any text that contains the term has these words between blanks, too.
WORDS = 0
#: Beyond this many bytes of terms the anchors are shuffled instead of broadcast.
MAX_BROADCAST_BYTES = 32 << 20
#: Up to so many terms, and bytes of them, are looked for one by one in each text, which costs less than its grams.
FEW_TERMS, FEW_BYTES = 100, 16 << 10
#: Characters of the beginnings of anchors, by which places are left out before they are shuffled.
HEAD = 4
#: Share of texts read to find out which grams are common.
STATISTICS_FRACTION = 0.02
#: Characters of the pieces that places are counted in: finding a character walks from the start of its piece.
PIECE, LONG_PIECE = 64, 2048


def grams(text: Column, lengths: list[int]) -> Column:
    """Distinct character windows of the given lengths of a short text."""
    windows = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths]
    return F.array_distinct(F.concat(*windows) if len(windows) > 1 else windows[0])


def places(texts: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """``(*keep, _piece, _gram)`` for every place of ``_text`` and every length, compiled into one pass; ``_piece`` is what
    surrounds the place.

    Texts are cut into pieces in two steps, so that the work stays in proportion to the text. An inner explode would make
    each list of places once more, to drop rows without any.
    """
    cut = texts.select(*keep, F.col("_text").alias("_piece"), F.lit(0).alias("_skip"), F.length("_text").alias("_own"))
    for size in (LONG_PIECE, PIECE):
        starts = F.sequence(F.lit(1), F.greatest(F.col("_own"), F.lit(1)), F.lit(size))
        cut = cut.select(*keep, "_piece", "_skip", "_own", F.explode_outer(starts).alias("_at"))
        begin = F.greatest(F.col("_skip") + F.col("_at") - MARGIN, F.lit(1))
        cut = cut.select(
            *keep, F.substring(F.col("_piece"), begin, F.lit(size + 2 * MARGIN)).alias("_piece"),
            (F.col("_skip") + F.col("_at") - begin).alias("_skip"), F.least(F.col("_own") - F.col("_at") + 1, F.lit(size)).alias("_own"))
    cut = cut.select(*keep, "_piece", F.explode_outer(F.sequence(F.col("_skip") + 1, F.col("_skip") + F.greatest(F.col("_own"), F.lit(1)))).alias("_at"))
    found = [F.substring(F.col("_piece"), F.col("_at"), F.lit(n)) for n in lengths]
    return cut.select(*keep, "_piece", (F.explode(F.array(*found)) if len(found) > 1 else found[0]).alias("_gram"))


def inner_words(term: Column) -> Column:
    """Words of a term with blanks of the term on both sides."""
    parts = F.split(term, " ")
    return F.array_remove(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), "")


def anchor_places(texts: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """``places`` of the given lengths, with the words between blanks where the tier of words is among them."""
    chars = [n for n in lengths if n != WORDS]
    parts = [places(texts, chars, keep)] if chars else []
    if WORDS in lengths:
        parts.append(texts.select(*keep, F.lit("").alias("_piece"), F.explode_outer(F.split("_text", " ")).alias("_gram")).where(F.col("_gram").isNotNull()))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def few_terms(terms: DataFrame, term_col: str) -> list[str] | None:
    """The distinct non-empty terms, if they are few."""
    listed = [r[0] for r in terms.where(F.length(term_col) > 0).select(term_col).distinct().limit(FEW_TERMS + 1).collect()]
    return sorted(listed) if len(listed) <= FEW_TERMS and sum(len(t.encode()) for t in listed) <= FEW_BYTES else None


def found_terms(text: Column, terms: list[str]) -> Column:
    """Those of a few terms that a text contains, as an array."""
    if not terms:
        return F.array().cast("array<string>")
    return let(text, lambda bound: F.array_compact(F.array(*[F.when(bound.contains(F.lit(t)), F.lit(t)) for t in terms])))


def contains_join(
    texts: DataFrame, terms: DataFrame, text_id: str, text_col: str, term_col: str, max_broadcast: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Distinct pairs ``(text_id, term)`` where the text contains the non-empty term.

    ``text_id`` must be unique. Every pair is found, whatever the number of terms and
    however common they are.
    """
    few = few_terms(terms, term_col)
    if few is not None:
        # An inner explode would look for the terms once more, to drop rows without any.
        return texts.select(text_id, F.explode_outer(found_terms(F.col(text_col), few)).alias(term_col)).where(F.col(term_col).isNotNull())
    # The number, the size check and the match read the terms: compute them once.
    listed = cut_lineage(terms.select(F.col(term_col).alias("_term")).where(F.length("_term") > 0).distinct())
    length = F.length("_term")
    tier = F.lit(None).cast("int")
    for least, n in reversed((FINE_TIERS if listed.count() > MANY_TERMS else TIERS).items()):
        tier = F.when(length >= least, F.lit(n)).otherwise(tier)
    tier = F.when((length > MARGIN) & (F.size(inner_words(F.col("_term"))) > 0), F.lit(WORDS)).otherwise(tier)
    tiered = listed.withColumn("_n", tier)
    inner = ~F.contains("_term", F.lit(" "))
    sizes = tiered.groupBy("_n", inner.alias("_inner")).agg(F.sum(F.octet_length("_term") + 64).alias("bytes")).collect()
    narrow = texts.select(F.col(text_id).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    lengths = sorted({r["_n"] for r in sizes})
    if not sizes:
        matched = narrow.where(F.lit(False)).select("_id", F.lit("").alias("_term"))
    elif sum(r["bytes"] for r in sizes) <= max_broadcast:
        parts = []
        for match, holds, flag in ((_match_in_words, inner, True), (_match_in_place, ~inner, False)):
            own = sorted(r["_n"] for r in sizes if r["_inner"] == flag)
            if own:
                parts.append(match(narrow, tiered.where(holds), own))
        matched = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    else:
        matched = _match_by_shuffle(narrow, choose_anchors(narrow, tiered, lengths), lengths, MAX_BROADCAST_BYTES)
    return matched.select(F.col("_id").alias(text_id), F.col("_term").alias(term_col))


def choose_anchors(texts: DataFrame, terms: DataFrame, lengths: list[int]) -> DataFrame:
    """The gram of each term ``(_term, _n)`` that a sample of the texts holds least often.

    The sample only decides how many candidates are verified, never the result.
    """
    own = F.lit(None).cast("array<string>")
    for n in lengths:
        pieces = inner_words(F.col("_term")) if n == WORDS else grams(F.col("_term"), [n])
        own = F.when(F.col("_n") == n, pieces).otherwise(own)
    exploded = terms.select("_term", F.explode(own).alias("_gram"))
    if WORDS not in lengths and max(lengths) < 3:
        return exploded
    seen = (
        anchor_places(texts.sample(STATISTICS_FRACTION, seed=7), lengths, [])
        .join(exploded.select("_gram").distinct(), "_gram", "left_semi")
        .groupBy("_gram")
        .agg(F.count("*").alias("_seen"))
    )
    rank = F.struct(F.coalesce("_seen", F.lit(0)).alias("seen"), F.xxhash64("_gram").alias("hash"), F.col("_gram").alias("gram"))
    ranked = exploded.join(seen, "_gram", "left").select("_term", rank.alias("_rank"))
    return ranked.groupBy("_term").agg(F.min("_rank")["gram"].alias("_gram"))


def _match_in_words(texts: DataFrame, terms: DataFrame, lengths: list[int]) -> DataFrame:
    """Terms without a blank lie within a word: each distinct word is looked at once, then texts meet the words that hold terms."""
    words = texts.select("_id", F.explode_outer(F.array_distinct(F.split("_text", " "))).alias("_word")).where(F.length("_word") > 0)
    distinct = cut_lineage(words.select("_word").distinct()).select(F.col("_word").alias("_id"), F.col("_word").alias("_text"))
    held = cut_lineage(_match_in_place(distinct, terms, lengths).withColumnRenamed("_id", "_word"))
    size = held.agg(F.sum(F.octet_length("_word") + F.octet_length("_term") + 64)).first()[0] or 0
    return words.join(F.broadcast(held) if size <= MAX_BROADCAST_BYTES else held, "_word").select("_id", "_term").distinct()


def _match_in_place(texts: DataFrame, terms: DataFrame, lengths: list[int]) -> DataFrame:
    """Probe a broadcast anchor table at every place of the texts; only what is found is shuffled."""
    anchors = choose_anchors(texts, terms, lengths)
    met = anchor_places(texts.withColumn("_whole", F.col("_text")), lengths, ["_id", "_whole"]).join(F.broadcast(anchors), "_gram")
    near = F.length("_term") <= MARGIN
    return met.where((near & F.contains("_piece", "_term")) | (~near & F.contains("_whole", "_term"))).select("_id", "_term").distinct()


def _match_by_shuffle(texts: DataFrame, anchors: DataFrame, lengths: list[int], max_heads: int) -> DataFrame:
    """Shuffle narrow (id, gram) rows to the anchors, then fetch candidate texts.

    Of the places only those that begin like some anchor are shuffled, where the beginnings can be broadcast.
    """
    anchors = cut_lineage(anchors)
    head = lambda: F.substring("_gram", 1, HEAD)
    heads = cut_lineage(anchors.select(head().alias("_head")).distinct())
    found = anchor_places(texts, lengths, ["_id"]).select("_id", "_gram")
    if (heads.agg(F.sum(F.octet_length("_head") + 64)).first()[0] or 0) <= max_heads:
        found = found.join(F.broadcast(heads), head() == F.col("_head"), "left_semi")
    candidates = found.distinct().join(anchors, "_gram").select("_id", "_term").distinct()
    return (
        candidates.join(texts, "_id").where(F.contains("_text", "_term")).select("_id", "_term")
    )

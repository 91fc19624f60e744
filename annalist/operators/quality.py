"""Text-quality metrics on (source, produced) pairs and on chapters of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicons as lx
from ..functions.columns import as_col, all_matches, count_terms, let, share, text_array, trimmed
from ..functions.dates import years_in_range
from ..functions.text import char_ngrams, concept_preserved, normalize_text, split_sentences


def temporal_coherence(produced: Column | str, source: Column | str) -> Column:
    """Share of the produced years found in the source; 1 without years."""
    mine = years_in_range(produced)
    return share(F.size(F.array_intersect(mine, years_in_range(source))), F.size(mine), 1.0)


def fallback_concepts(source: Column | str, pattern: str = "[一-龥]{2,4}", k: int = 20) -> Column:
    """Concepts without a tagger: the first distinct runs of a pattern."""
    return F.slice(F.array_distinct(all_matches(as_col(source), pattern)), 1, k)


def topic_coherence(produced: Column | str, concepts: Column | str) -> Column:
    """Share of source concepts preserved; 0.5 without concepts."""
    produced, concepts = as_col(produced), as_col(concepts)
    kept = let(
        normalize_text(produced),
        lambda flat: F.size(F.filter(concepts, lambda c: concept_preserved(c, produced, flat))),
    )
    return share(kept, F.size(concepts), 0.5)


def length_score(
    n: Column | str, low: Column | int = 150, high: Column | int = 600, best_low: Column | int = 200, best_high: Column | int = 500,
) -> Column:
    """1 inside the best range, falling to 0.7 at the bounds, 0.3 outside."""
    n = as_col(n)
    low, high, best_low, best_high = (F.lit(x) if isinstance(x, int) else x for x in (low, high, best_low, best_high))
    rising = 0.7 + 0.3 * (n - low) / F.nullif(best_low - low, F.lit(0))
    falling = 0.7 + 0.3 * (high - n) / F.nullif(high - best_high, F.lit(0))
    return (
        F.when(n.between(best_low, best_high), 1.0)
        .when(n.between(low, high), F.when(n < best_low, rising).otherwise(falling))
        .otherwise(0.3)
    )


def document_length_score(n: Column | str) -> Column:
    """Length score of a whole document; the best range follows its length up to 12 000."""
    n = as_col(n)
    return length_score(n, 400, 50000, 800, F.greatest(F.lit(800), F.least(n, F.lit(12000))))


def adaptive_bounds(source_len: Column | str, lo: Column | str, hi: Column | str, expansion: bool = True) -> Column:
    """Length bounds ``struct<low,high,best_low,best_high>`` from source length and hint."""
    m, lo, hi = as_col(source_len), as_col(lo), as_col(hi)
    if expansion:
        bounds = (
            F.greatest(F.lit(50), m), F.greatest(hi * 3, m * 8), F.greatest(m * 2, lo), F.greatest(m * 5, hi),
        )
    else:
        margin = F.greatest(F.lit(80), F.floor((hi - lo) / 2))
        bounds = (
            F.greatest(F.lit(50), lo - margin), F.least(F.lit(20000), hi + margin * 2),
            F.greatest(F.lit(50), lo), F.greatest(lo + 1, hi),
        )
    names = ("low", "high", "best_low", "best_high")
    return F.struct(*[b.cast("int").alias(n) for b, n in zip(bounds, names)])


def transition_usage(text: Column | str, words: Sequence[str] = tuple(lx.TRANSITION_WORDS)) -> Column:
    used = count_terms(as_col(text), words)
    return F.when(used >= 2, 1.0).when(used == 1, 0.7).otherwise(0.4)


def descriptive_richness(text: Column | str, patterns: Sequence[str] = tuple(lx.RICHNESS_PATTERNS)) -> Column:
    """Share of the pattern groups that match."""
    text = as_col(text)
    matched = F.lit(0)
    for pattern in patterns:
        matched = matched + text.rlike(pattern).cast("int")
    return matched / F.lit(float(len(patterns)))


def utilization(n_used: Column | str) -> Column:
    n = as_col(n_used)
    return F.when(n >= 4, 1.0).when(n == 3, 0.8).when(n == 2, 0.7).when(n == 1, 0.5).otherwise(0.0)


def information_gain(n_used: Column | str) -> Column:
    n = as_col(n_used)
    return F.when(n >= 3, 1.0).when(n == 2, 0.7).when(n == 1, 0.4).otherwise(0.0)


def expansion_grounding(n_grounded: Column | str, n_facts: Column | str) -> Column:
    return share(as_col(n_grounded), as_col(n_facts), 1.0)


def hallucination_score(n_unsupported: Column | str, n_facts: Column | str) -> Column:
    """One minus the unsupported share; 1 without facts."""
    return 1 - share(as_col(n_unsupported), as_col(n_facts), 0.0)


def merge_compliance(rule_score: Column, judge_score: Column, rule_issues: Column, judge_issues: Column) -> Column:
    """The lower score and the ordered distinct issues of both judges."""
    issues = F.array_distinct(F.concat(rule_issues, F.coalesce(judge_issues, text_array([]))))
    return F.struct(
        F.least(rule_score, judge_score).alias("score"), F.filter(issues, lambda i: i != "").alias("issues")
    )


def simple_accuracy(produced: Column, entities: Column, year: Column, location: Column) -> Column:
    """Base 5, up to 3 for retrieved names, 1 each for year and place."""
    used = F.size(F.filter(F.slice(entities, 1, 5), lambda e: (e != "") & produced.contains(e)))
    score = 5.0 + F.least(used, F.lit(3))
    for value in (year, location):
        score = score + F.coalesce((value != "") & produced.contains(value), F.lit(False)).cast("int")
    return F.least(score, F.lit(10.0))


def simple_relevance(produced: Column, source: Column, keywords: Column) -> Column:
    """Base 5, up to 2 for shared characters, up to 3 for keywords."""
    shared = F.size(F.array_intersect(characters(source), characters(produced)))
    hits = F.size(F.filter(keywords, lambda k: produced.contains(k)))
    score = 5.0 + F.when(shared > 10, 2).when(shared > 5, 1).otherwise(0) + F.least(hits, F.lit(3))
    return F.least(score, F.lit(10.0))


def characters(text: Column) -> Column:
    """Distinct characters of a text."""
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def simple_literary(produced: Column, words: Sequence[str] = tuple(lx.SIMPLE_TRANSITION_WORDS)) -> Column:
    """Base 5, up to 2 for length, 1 for one to three paragraphs, up to 2 for transitions."""
    n = F.length(produced)
    score = 5.0 + F.when(n.between(200, 500), 2).when(n.between(100, 800), 1).otherwise(0)
    score = score + paragraph_count(produced).between(1, 3).cast("int")
    score = score + F.least(count_terms(produced, words), F.lit(2))
    return F.least(score, F.lit(10.0))


def paragraph_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda p: trimmed(p) != ""))


def simple_overall(accuracy: Column, relevance: Column, literary: Column) -> Column:
    return F.round(accuracy * 0.4 + relevance * 0.3 + literary * 0.3, 2)


def suggestions(accuracy: Column, relevance: Column, literary: Column) -> Column:
    """Names of the dimensions below 7."""
    return F.array_compact(
        F.array(
            F.when(accuracy < 7, F.lit("accuracy")),
            F.when(relevance < 7, F.lit("relevance")),
            F.when(literary < 7, F.lit("literary")),
        )
    )


def entity_coverage(produced: Column, entities: Column, minimum: int | None = 2) -> Column:
    """Names used over the required number, or over all names without a minimum."""
    used = F.size(F.filter(entities, lambda e: produced.contains(e)))
    total = F.size(entities)
    if minimum is None:
        return share(used, total, 0.0)
    return F.least(share(used, F.least(F.lit(minimum), total), 0.0), F.lit(1.0))


def tolerant_coherence(produced: Column, reference_year: Column, tolerance: int = 10) -> Column:
    """Share of years near the reference; 0.5 without reference, 0.3 without years."""
    reference = F.expr("NULL").cast("int") if reference_year is None else F.regexp_replace(reference_year, "年", "")
    number = F.when(F.rlike(reference, F.lit("^[0-9]+$")), reference.cast("int"))
    years = years_in_range(produced)
    near = F.filter(years, lambda y: F.abs(y - number) <= tolerance)
    return (
        F.when(number.isNull(), 0.5).when(F.size(years) == 0, 0.3).otherwise(share(F.size(near), F.size(years), 0.3))
    )


def keyword_overlap(produced: Column, source: Column, keywords: Column) -> Column:
    """Share of keywords present, or the Jaccard index of characters without keywords."""
    hits = F.size(F.filter(keywords, lambda k: produced.contains(k)))
    a, b = characters(source), characters(produced)
    jaccard = share(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)), 0.0)
    return F.when(F.size(F.coalesce(keywords, text_array([]))) > 0, share(hits, F.size(keywords), 0.0)).otherwise(jaccard)


def paragraph_structure(text: Column, relaxed: bool = False, relaxed_max: int = 48) -> Column:
    n = paragraph_count(text)
    if relaxed:
        return F.when(n == 0, 0.0).when(n <= relaxed_max, 1.0).otherwise(0.75)
    return F.when(n == 0, 0.0).when(n <= 3, 1.0).otherwise(0.6)


def bigram_cosine(pairs: DataFrame, key: str, left: str, right: str, pattern: str = "[一-龥]") -> DataFrame:
    """Cosine of character-bigram counts of two texts per row: ``(key, cosine)``.

    Counts of both sides meet in one aggregate on (key, gram); no gram join is needed.
    """

    def windows(text: str) -> Column:
        chars = F.array_join(all_matches(F.col(text), pattern), "")
        return all_matches(chars, "(?s)(?=(.{2}))", 1)

    sides = F.concat(
        F.transform(windows(left), lambda g: F.struct(g.alias("gram"), F.lit(0).alias("side"))),
        F.transform(windows(right), lambda g: F.struct(g.alias("gram"), F.lit(1).alias("side"))),
    )
    counts = (
        pairs.select(key, F.inline(sides))
        .groupBy(key, "gram")
        .agg(F.count_if(F.col("side") == 0).alias("_a"), F.count_if(F.col("side") == 1).alias("_b"))
    )
    sums = counts.groupBy(key).agg(
        F.sum(F.col("_a") * F.col("_b")).alias("_dot"),
        F.sum(F.col("_a") * F.col("_a")).alias("_aa"),
        F.sum(F.col("_b") * F.col("_b")).alias("_bb"),
    )
    cosine = F.when((F.col("_aa") > 0) & (F.col("_bb") > 0), F.col("_dot") / (F.sqrt("_aa") * F.sqrt("_bb")))
    return pairs.select(key).join(sums.select(key, cosine.alias("_c")), key, "left").select(
        key, F.coalesce("_c", F.lit(0.0)).alias("cosine")
    )


def rag_coverage(produced: Column, retrieved: Column, extracted: Column, k: int = 15) -> Column:
    """Share of the first k retrieved names in the text, and names only the text has."""
    names = F.slice(F.filter(retrieved, lambda n: n != ""), 1, k)
    used = F.filter(names, lambda n: produced.contains(n))
    return F.struct(
        share(F.size(used), F.size(names), 0.0).alias("coverage"), used.alias("used"),
        F.array_except(extracted, names).alias("text_only"),
    )


def token_coverage(produced_tokens: Column, evidence_tokens: Column) -> Column:
    """Share of distinct produced tokens found in the evidence; 0 without tokens."""
    mine = F.array_distinct(produced_tokens)
    return share(F.size(F.array_intersect(mine, evidence_tokens)), F.size(mine), 0.0)


def adjacent_overlaps(chapters: DataFrame, doc_id: str, idx: str, text: str, n: int = 6, samples: int = 0) -> DataFrame:
    """Gram overlap of each chapter with the next: ``(doc_id, idx, ratio)``.

    ``idx`` must be consecutive within a document. Neighbours meet by an equi-join on
    (document, index), so a document with very many chapters spreads over all tasks,
    which a window per document would not do. ``ratio`` is null if either side is empty.
    """
    texts = chapters.select(doc_id, F.col(idx).alias("_i"), F.regexp_replace(text, r"\s+", "").alias("_t"))
    # One shuffle: each chapter also goes to its predecessor's key. Texts travel, not their
    # grams, which are several times larger.
    sent = texts.select(
        doc_id,
        F.explode(F.array(F.struct(F.col("_i").alias("at"), F.lit(0).alias("role")), F.struct((F.col("_i") - 1).alias("at"), F.lit(1).alias("role")))).alias("_s"),
        "_t",
    )
    met = sent.groupBy(doc_id, F.col("_s.at").alias(idx)).agg(
        F.any_value(F.when(F.col("_s.role") == 0, F.col("_t")), True).alias("_ta"),
        F.any_value(F.when(F.col("_s.role") == 1, F.col("_t")), True).alias("_tb"),
    )
    met = met.where(F.col("_ta").isNotNull() & F.col("_tb").isNotNull()).select(
        doc_id, idx, char_ngrams("_ta", n).alias("_a"), char_ngrams("_tb", n).alias("_b")
    )
    common = F.array_intersect("_a", "_b")
    result = [
        doc_id, idx,
        share(F.size(common), F.least(F.size("_a"), F.size("_b"))).alias("ratio"),
    ]
    if samples:
        result.append(F.slice(F.array_sort(common), 1, samples).alias("samples"))
    return met.select(*result)


def repetition(chapters: DataFrame, doc_id: str, idx: str, text: str, n: int = 6) -> DataFrame:
    """One minus the mean adjacent overlap per document; 1 with fewer than two chapters."""
    pairs = adjacent_overlaps(chapters, doc_id, idx, text, n).groupBy(doc_id).agg(F.avg("ratio").alias("_mean"))
    return chapters.select(doc_id).distinct().join(pairs, doc_id, "left").select(
        doc_id, F.greatest(F.lit(0.0), 1 - F.coalesce("_mean", F.lit(0.0))).alias("repetition_score")
    )


def style_consistency(chapters: DataFrame, doc_id: str, text: str, terminators: str = "。！？") -> DataFrame:
    """Evenness of the mean sentence length across chapters."""
    lengths = F.transform(split_sentences(text, terminators), F.length)
    mean = share(F.aggregate(lengths, F.lit(0), lambda a, x: a + x), F.size(lengths))
    stats = chapters.select(doc_id, mean.alias("_m")).groupBy(doc_id).agg(
        F.count("_m").alias("_n"), F.avg("_m").alias("_avg"), F.stddev_pop("_m").alias("_sd")
    )
    cv = F.when(F.col("_avg") > 0, F.col("_sd") / F.col("_avg")).otherwise(0.0)
    return stats.select(
        doc_id,
        F.when((F.col("_n") < 2) | (cv <= 0.2), 1.0)
        .when(cv >= 0.6, 0.3)
        .otherwise(1.0 - (cv - 0.2) / 0.4 * 0.7)
        .alias("style_score"),
    )


def summary_ratio(chapters: DataFrame, doc_id: str, text: str, pattern: str = lx.SUMMARY_METRIC_PATTERN, terminators: str = "。！？") -> DataFrame:
    """``max(0, 1 - 5 * share of summarising sentences)``; 1 without sentences."""
    sentences = split_sentences(text, terminators)
    counted = chapters.select(
        doc_id, F.size(sentences).alias("_n"), F.size(F.filter(sentences, lambda s: s.rlike(pattern))).alias("_s")
    )
    sums = counted.groupBy(doc_id).agg(F.sum("_n").alias("n_sentences"), F.sum("_s").alias("n_summary"))
    ratio = share(F.col("n_summary"), F.col("n_sentences"), 0.0)
    return sums.select(doc_id, "n_sentences", "n_summary", F.greatest(F.lit(0.0), 1 - 5 * ratio).alias("summary_score"))


def summary_share(text: Column | str, pattern: str = lx.SUMMARY_GATE_PATTERN, terminators: str = "。！？") -> Column:
    """Share of summarising sentences in one text; 0 without sentences."""
    sentences = split_sentences(text, terminators)
    return share(F.size(F.filter(sentences, lambda s: s.rlike(pattern))), F.size(sentences), 0.0)


def boilerplate_count(text: Column | str, pattern: str = lx.BOILERPLATE_PATTERN) -> Column:
    return F.regexp_count(as_col(text), F.lit(pattern))


def epilogue_sentence(text: Column | str, pattern: str = lx.EPILOGUE_PATTERN, tail: int = 3, terminators: str = "。！？") -> Column:
    """First of the last sentences that matches, cut at 60 characters; null if none does."""
    sentences = split_sentences(text, terminators)
    last = F.slice(sentences, F.greatest(F.lit(1), F.size(sentences) - tail + 1), F.lit(tail))
    return F.left(F.get(F.filter(last, lambda s: s.rlike(pattern)), F.lit(0)), F.lit(60))


def evaluate_pairs(
    df: DataFrame, unit_id: str, source: str, produced: str, concepts: Column, hint: Column | None = None,
    n_used: Column | None = None, n_unsupported: Column | None = None, n_facts: Column | None = None,
    transitions: Sequence[str] = tuple(lx.TRANSITION_WORDS), richness: Sequence[str] = tuple(lx.RICHNESS_PATTERNS),
) -> DataFrame:
    """All metrics of each pair in one pass, as long rows ``(unit_id, name, value, max_value)``.

    Metrics on novel content appear only where their inputs are given.
    """
    text = F.col(produced)
    if hint is None:
        length = length_score(F.length(text))
    else:
        b = adaptive_bounds(F.length(source), hint["lo"], hint["hi"])
        length = length_score(F.length(text), b["low"], b["high"], b["best_low"], b["best_high"])
    values = {
        "temporal_coherence": temporal_coherence(text, source),
        "topic_coherence": topic_coherence(text, concepts),
        "length_score": length,
        "transition_usage": transition_usage(text, transitions),
        "descriptive_richness": descriptive_richness(text, richness),
    }
    if n_used is not None:
        values["rag_utilization"] = utilization(n_used)
    if n_facts is not None and n_unsupported is not None:
        values["hallucination"] = hallucination_score(n_unsupported, n_facts)
    rows = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value"), F.lit(1.0).alias("max_value")) for n, v in values.items()])
    return df.select(unit_id, F.inline(rows))

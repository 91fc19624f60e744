"""Expressions on structured values: queries, verdicts, judgements, budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import lexicons as lx
from .columns import all_matches, any_term, as_col, found, text_array, trimmed


def context_to_query(year: Column, location: Column, keywords: Column, text: Column) -> Column:
    """Year, place and three keywords as a search string, else the start of the text."""
    lead = F.filter(F.slice(F.coalesce(keywords, text_array([])), 1, 3), lambda k: k != "")
    query = F.concat_ws(
        " ",
        F.when(year != "", F.concat(year, F.lit("年"))),
        F.when(location != "", location),
        F.when(F.size(lead) > 0, F.array_join(lead, " ")),
    )
    return F.coalesce(F.when(query != "", query), F.left(text, F.lit(100)))


def build_vector_query(year: Column, location: Column, keywords: Column, text: Column) -> Column:
    """The lines sent to an embedder: year, place, eight keywords, full text."""
    lead = F.filter(F.slice(F.coalesce(keywords, text_array([])), 1, 8), lambda k: k != "")
    parts = F.concat(F.array(year, location), lead, F.array(trimmed(text)))
    return trimmed(F.array_join(F.filter(parts, lambda p: F.coalesce(p != "", F.lit(False))), "\n"))


def normalize_verdict(verdict: Column | str) -> Column:
    """SUPPORTED, NOT_SUPPORTED or UNSURE from a free-form answer."""
    flat = F.upper(trimmed(as_col(verdict)))
    return (
        F.when(flat.contains("SUPPORTED") & ~flat.contains("NOT"), "SUPPORTED")
        .when(flat.contains("NOT"), "NOT_SUPPORTED")
        .otherwise("UNSURE")
    )


def judge_scores(text: Column | str) -> Column:
    """``array<struct<entity,score>>`` of a judge's answer, scores held to 0..3.

    The widest brace block is parsed; an answer without one gives an empty array.
    """
    body = F.regexp_extract(as_col(text), r"(?s)\{.*\}", 0)
    schema = "scores array<struct<entity:string,score:double>>"
    scores = F.from_json(F.when(body != "", body), schema)["scores"]
    scores = F.filter(scores, lambda s: s["entity"].isNotNull())
    held = F.transform(
        scores,
        lambda s: F.struct(
            s["entity"].alias("entity"),
            F.least(F.greatest(F.coalesce(s["score"], F.lit(0.0)), F.lit(0.0)), F.lit(3.0)).alias("score"),
        ),
    )
    return F.coalesce(held, F.array().cast("array<struct<entity:string,score:double>>"))


def unfenced(text: Column | str) -> Column:
    """An answer without the code fence around it."""
    return F.regexp_replace(trimmed(as_col(text)), r"(?s)^```[^\n]*\n(.*?)\n?```$", "$1")


def batch_verdicts(text: Column | str) -> Column:
    """``array<struct<position,content,verdict>>`` of an answer on many facts, verdicts as written or from a truth value.

    The widest brace block is parsed, fenced or not; its ``results`` may hold items of any shape, and one that is no
    object keeps its place without content. An answer that does not parse gives an empty array.
    """
    body = F.regexp_extract(unfenced(text), r"(?s)\{.*\}", 0)
    items = F.try_variant_get(F.try_parse_json(F.when(body != "", body)), "$.results", "array<variant>")

    def row(item: Column, place: Column) -> Column:
        truth = F.lower(F.try_variant_get(item, "$.supported", "string"))
        verdict = F.coalesce(
            F.try_variant_get(item, "$.verdict", "string"), F.when(truth == "true", "SUPPORTED").when(truth == "false", "NOT_SUPPORTED"))
        content = F.coalesce(trimmed(F.try_variant_get(item, "$.fact", "string")), F.lit(""))
        return F.struct(place.alias("position"), content.alias("content"), F.coalesce(verdict, F.lit("UNSURE")).alias("verdict"))

    return F.coalesce(F.transform(items, row), F.array().cast("array<struct<position:int,content:string,verdict:string>>"))


def judged_score(scores: Column, name: Column) -> Column:
    """Score of a name: exact entry (last one wins), else the first nested entry, else 0."""
    exact = F.filter(scores, lambda s: s["entity"] == name)
    nested = F.filter(scores, lambda s: name.contains(s["entity"]) | s["entity"].contains(name))
    return F.coalesce(
        F.try_element_at(exact, F.lit(-1))["score"], F.get(nested, F.lit(0))["score"], F.lit(0.0)
    )


def parse_length_range(hint: Column | str) -> Column:
    """``struct<lo,hi>`` of a length hint such as ``400-800``."""
    hint = as_col(hint)
    pair = r"([0-9]+)\s*[-–~至]\s*([0-9]+)"
    a, b = found(hint, pair, 1).cast("int"), found(hint, pair, 2).cast("int")
    one = found(hint, "([0-9]+)").cast("int")
    single = F.when(one.isNotNull(), F.greatest(F.lit(50), one - 50))
    low = F.coalesce(F.least(a, b), single, F.lit(200))
    high = F.coalesce(F.greatest(a, b), one + 200, F.lit(500))
    return F.struct(low.alias("lo"), high.alias("hi"))


def clamp_range(a: Column | str, b: Column | str) -> Column:
    """Ordered and bounded generation range as ``struct<lo,hi>``."""
    a, b = as_col(a), as_col(b)
    low = F.greatest(F.lit(80), F.least(a, b))
    high = F.least(F.greatest(low + 50, F.greatest(a, b)), F.lit(50000))
    return F.struct(low.cast("int").alias("lo"), high.cast("int").alias("hi"))


def categorize(
    text: Column | str,
    rules: Sequence[tuple[str, Sequence[str]]] = tuple(lx.CATEGORY_RULES),
    default: str = lx.CATEGORY_DEFAULT,
) -> Column:
    """First category with a keyword in the text."""
    text = as_col(text)
    result = F.lit(default)
    for name, words in reversed(list(rules)):
        result = F.when(any_term(text, words), F.lit(name)).otherwise(result)
    return result


def _whole(value: Column) -> Column:
    return F.floor(value).cast("int")


def budget_from_range(low: Column | str, high: Column | str) -> Column:
    """Length hint, token limit and target for an explicit character range."""
    low = F.greatest(F.lit(50), as_col(low).cast("int"))
    high = F.greatest(low + 1, as_col(high).cast("int"))
    tokens = F.least(F.lit(8000), F.greatest(F.lit(256), _whole(high * F.lit(2.2))))
    return _budget(low, high, tokens, _whole((low + high) / 2))


def _budget(low: Column, high: Column, tokens: Column, target: Column) -> Column:
    hint = F.concat(low.cast("string"), F.lit("-"), high.cast("string"), F.lit("字"))
    return F.struct(
        low.alias("low"), high.alias("high"), hint.alias("length_hint"),
        tokens.alias("max_tokens"), target.alias("target_chars"),
    )


def _lookup(values: dict[str, float], bucket: Column) -> Column:
    table = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(table[bucket], F.lit(values[lx.DEFAULT_BUCKET]))


def length_budget(n_chars: Column | str, bucket: Column | str, n_segments: Column | str) -> Column:
    """Budget of one segment; a document of one segment gets the bucket's total."""
    n_chars, bucket, n_segments = as_col(n_chars), as_col(bucket), as_col(n_segments)
    center = F.greatest(
        F.lit(150),
        _whole(F.greatest(F.lit(80), n_chars).cast("double") * _lookup(lx.BUCKET_EXPANSION, bucket)),
    )
    low = F.greatest(F.lit(100), _whole(center * F.lit(0.85)))
    high = F.greatest(low + 50, _whole(center * F.lit(1.15)))
    tokens = F.least(F.lit(8000), F.greatest(F.lit(512), _whole(high * F.lit(2.2))))

    only = F.greatest(F.lit(80), _lookup(lx.BUCKET_TOTALS, bucket).cast("int"))
    only_low = F.greatest(F.lit(50), _whole(only * F.lit(0.85)))
    only_high = F.greatest(only_low + 10, _whole(only * F.lit(1.15)))
    only_tokens = F.least(F.lit(8000), F.greatest(F.lit(256), _whole(only_high * F.lit(2.2))))
    return F.when(n_segments == 1, _budget(only_low, only_high, only_tokens, only)).otherwise(
        _budget(low, high, tokens, center)
    )


def fallback_config(bucket: Column | str) -> Column:
    """Length hint and token limit of a named bucket."""
    bucket = as_col(bucket)
    hints = F.create_map(*[x for k, v in lx.BUCKET_HINTS.items() for x in (F.lit(k), F.lit(v[0]))])
    tokens = {k: v[1] for k, v in lx.BUCKET_HINTS.items()}
    return F.struct(
        F.coalesce(hints[bucket], F.lit(lx.BUCKET_HINTS[lx.DEFAULT_BUCKET][0])).alias("length_hint"),
        _lookup(tokens, bucket).cast("int").alias("max_tokens"),
    )


def long_form_timeouts(n_chapters: Column | str) -> Column:
    """Time limits in seconds for generating and evaluating a text of n chapters."""
    n = F.greatest(F.lit(1), as_col(n_chapters))
    return F.struct((60.0 + 120.0 * n).alias("generate"), (120.0 + 30.0 * n).alias("evaluate"))


def extraction_records(text: Column | str) -> Column:
    """Records of an extraction answer as ``array<array<string>>``: kind first, then fields."""
    body = F.regexp_replace(as_col(text), r"<\|COMPLETE\|>", "")
    records = F.transform(F.split(body, "##"), lambda r: found(trimmed(r), r"(?s)^\((.*)\)$"))
    records = F.filter(records, lambda r: r.isNotNull())
    return F.transform(
        records,
        lambda r: F.transform(
            F.split(r, r"<\|>"), lambda f: F.regexp_replace(trimmed(f), '^"|"$', "")
        ),
    )


def compliance_score(text: Column | str) -> Column:
    """10 minus 5 for an identity number, 3 for a phone, 2 for an address; at least 0."""
    text = as_col(text)
    return F.greatest(
        F.lit(0.0),
        F.lit(10.0)
        - 5.0 * text.rlike(lx.ID_NUMBER_PATTERN).cast("int")
        - 3.0 * text.rlike(lx.PHONE_PATTERN).cast("int")
        - 2.0 * text.rlike(lx.EMAIL_PATTERN).cast("int"),
    )


def compliance_issues(text: Column | str) -> Column:
    """Names of the personal-data rules that fire."""
    text = as_col(text)
    flags = F.array(
        F.when(text.rlike(lx.ID_NUMBER_PATTERN), F.lit("id_number")),
        F.when(text.rlike(lx.PHONE_PATTERN), F.lit("phone")),
        F.when(text.rlike(lx.EMAIL_PATTERN), F.lit("email")),
    )
    return F.filter(flags, lambda f: f.isNotNull())


def verifiable_sentence(
    sentence: Column,
    facts: str = lx.VERIFIABLE_PATTERN,
    narrative: str = lx.PURE_NARRATIVE_PATTERN,
) -> Column:
    """Long enough, with a checkable marker, and not pure description."""
    return (F.length(sentence) >= 6) & sentence.rlike(facts) & ~sentence.rlike(narrative)

"""Text expressions: cleaning, splitting, matching and shortening."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

from . import lexicons as lx
from .columns import all_matches, as_col, first_of, found, let, share, text_array, trimmed

CJK = "一-龥"


def normalize_text(text: Column | str) -> Column:
    """Only Chinese characters, Latin letters and digits, upper-cased."""
    return F.upper(F.regexp_replace(as_col(text), f"[^{CJK}a-zA-Z0-9]", ""))


def keyword_set(text: Column | str, min_len: int = 2) -> Column:
    """Chinese runs, Latin words of three letters or more, and full years."""
    text = as_col(text)
    chinese = F.filter(all_matches(text, f"[{CJK}]{{2,10}}"), lambda w: F.length(w) >= min_len)
    latin = F.transform(all_matches(text, "[A-Za-z]{3,}"), F.upper)
    years = all_matches(text, "(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])")
    return F.array_distinct(F.concat(chinese, latin, years))


def split_sentences(text: Column | str, terminators: str = "。！？", keep: bool = False) -> Column:
    """Non-blank trimmed sentences; ``keep`` leaves the terminator at the end."""
    pattern = f"(?<=[{terminators}])" if keep else f"[{terminators}]"
    pieces = F.transform(F.split(as_col(text), pattern), trimmed)
    return F.filter(pieces, lambda s: s != "")


def char_ngrams(text: Column | str, n: int) -> Column:
    """Distinct character n-grams after dropping white space.

    A zero-width look-ahead yields every window in one linear pass, where
    ``substring`` at each position would rescan the text from its start.
    """
    clean = F.regexp_replace(as_col(text), r"\s+", "")
    return F.array_distinct(all_matches(clean, f"(?s)(?=(.{{{n}}}))", 1))


def lexicon_hits(text: Column | str, lexicon: Iterable[str]) -> Column:
    """Terms of a short lexicon contained in the text, in lexicon order."""
    text = as_col(text)
    return F.filter(text_array(dict.fromkeys(lexicon)), lambda term: text.contains(term))


def regex_mentions(text: Column | str, pattern: str) -> Column:
    """Ordered distinct matches of a pattern."""
    return F.array_distinct(all_matches(as_col(text), pattern))


def rule_entities(
    text: Column | str,
    surnames: str = lx.SURNAMES,
    titles: str = lx.NAME_TITLES,
    given_names: Sequence[str] = tuple(lx.GIVEN_NAMES),
    lexicon: Sequence[str] = tuple(lx.FIGURES + lx.RULE_PLACES + lx.RULE_ORGANISATIONS),
) -> Column:
    """People, places and organisations named by four groups of rules."""

    def found_in(text: Column) -> Column:
        # The looks ahead change no match: they spare most places the long class of surnames.
        groups = [
            all_matches(text, f"老[{surnames}]"),
            all_matches(text, f"(?U)(?=.{{1,3}}(?:{titles}))[{surnames}]\\w{{0,2}}(?:{titles})"),
        ]
        for name in given_names:
            alone = text_array([name])
            full = let(all_matches(text, f"(?=.{name})[{surnames}]{name}"), lambda found: F.when(F.size(found) > 0, found).otherwise(alone))
            groups.append(F.when(text.contains(F.lit(name)), full).otherwise(text_array([])))
        groups.append(lexicon_hits(text, lexicon))
        return F.array_distinct(F.concat(*groups))

    return let(as_col(text), found_in)


def stringify(value: Column | str, kind: str = "string") -> Column:
    """Any value as one line of text; ``kind`` is string, array or map."""
    value = as_col(value)
    if kind == "string":
        line = trimmed(F.regexp_replace(value.cast("string"), r"\s+", " "))
        return F.coalesce(line, F.lit(""))
    items = F.map_values(value) if kind == "map" else value
    items = F.filter(F.transform(items, lambda v: stringify(v)), lambda v: v != "")
    return F.coalesce(F.array_join(items, " " if kind == "map" else "、"), F.lit(""))


def record_to_text(fields: dict[str, Column], labels: dict[str, str] | None = None) -> Column:
    """Labelled lines of a record; blank and missing fields are skipped."""
    labels = labels or lx.RECORD_FIELDS
    lines = [
        F.when(fields[name] != "", F.concat(F.lit(f"{label}: "), fields[name]))
        for name, label in labels.items()
        if name in fields
    ]
    return trimmed(F.concat_ws("\n", *lines))


def localize_name(name: Column | str, description: Column | str) -> Column:
    """Chinese name of a Latin-script entity, looked up in its description."""
    name, head = as_col(name), F.left(F.coalesce(as_col(description), F.lit("")), F.lit(300))
    return F.when(name.rlike("[一-鿿]") | (name == ""), name).otherwise(
        F.coalesce(
            found(head, f"[（(]([{CJK}]{{2,10}})[）)]"),
            found(head, f"(?:also|commonly)\\s+known\\s+as\\s+[\"']?([{CJK}]{{2,10}})"),
            found(head, f"^([{CJK}]{{2,10}})"),
            name,
        )
    )


def last_end(text: Column, separator: str, kept: int | None = None) -> Column:
    """Offset just after the last separator (``kept`` of its characters), 0 if absent."""
    size = len(separator)
    back = F.locate(separator[::-1], F.reverse(text))
    start = F.length(text) - back - size + 1
    return F.when(back > 0, start + (size if kept is None else kept)).otherwise(F.lit(0))


def truncate_at_boundary(text: Column | str, max_chars: int = 200) -> Column:
    """Cut after the last sentence end that keeps enough text, else hard cut."""
    text = F.coalesce(as_col(text), F.lit(""))
    window = F.left(text, F.lit(max_chars))
    floor = max(24, max_chars // 5)
    ends = []
    for separator in ("。", "！", "？", ". ", ".\n", "\n\n", "\n"):
        kept = 1 if separator == ". " else len(separator)
        end = last_end(window, separator, kept)
        ends.append(F.when(end - kept >= floor, end).otherwise(F.lit(0)))
    best = F.greatest(*ends)
    return (
        F.when(F.length(text) <= max_chars, text)
        .when(best > 0, F.regexp_replace(F.left(text, best), r"\s+$", ""))
        .otherwise(F.concat(F.regexp_replace(window, r"\s+$", ""), F.lit("…")))
    )


def truncate(text: Column | str, n: int = 100) -> Column:
    text = F.coalesce(as_col(text), F.lit(""))
    return F.when(F.length(text) <= n, text).otherwise(
        F.concat(F.left(text, F.lit(n - 1)), F.lit("…"))
    )


def brief(text: Column | str, max_len: int = 60, terminators: str = "。！？", joiner: str = "。") -> Column:
    """First sentence, with the second when the first is short, capped."""
    text = trimmed(as_col(text))
    sentences = split_sentences(text, terminators)
    first, second = first_of(sentences), F.get(sentences, F.lit(1))
    lead = F.when(
        (F.length(first) < 20) & second.isNotNull(), F.concat(first, F.lit(joiner), second)
    ).otherwise(first)
    return (
        F.when(first.isNull(), F.left(text, F.lit(max_len)))
        .when(F.length(lead) > max_len, F.concat(F.left(lead, F.lit(max_len)), F.lit("…")))
        .otherwise(lead)
    )


def highlight_terms(text: Column | str, names: Column | str, mark: str = "**") -> Column:
    """Mark each name, longest first; names nested in a marked name merge."""
    text, names = as_col(text), as_col(names)
    longest_first = F.array_sort(
        F.array_distinct(F.filter(names, lambda n: F.length(n) >= 2)),
        lambda a, b: F.length(b) - F.length(a),
    )
    double = mark + mark

    def mark_name(acc: Column, name: Column) -> Column:
        once = F.replace(acc, name, F.concat(F.lit(mark), name, F.lit(mark)))
        return F.replace(
            once,
            F.concat(F.lit(double), name, F.lit(double)),
            F.concat(F.lit(mark), name, F.lit(mark)),
        )

    return F.replace(F.aggregate(longest_first, text, mark_name), F.lit(double), F.lit(mark))


def strip_list_markers(text: Column | str) -> Column:
    """Lines of a bulleted or numbered list, markers removed, short lines dropped."""
    lines = F.transform(F.split(trimmed(as_col(text)), "\n"), trimmed)
    lines = F.transform(lines, lambda s: F.regexp_replace(s, r"^[-*•]\s*", ""))
    lines = F.transform(lines, lambda s: F.regexp_replace(s, r"^[0-9]+\.\s*", ""))
    return F.filter(lines, lambda s: F.length(s) > 3)


def mention_match(
    name: Column | str,
    text: Column | str,
    spellings: dict[str, list[str]] | None = None,
    any_trigram: bool = False,
    flat_text: Column | None = None,
) -> Column:
    """Is the name mentioned, from strict containment to prefix and trigram tests?

    Pass ``flat_text`` when many names are tested against one text.
    """
    name, text = as_col(name), as_col(text)
    spellings = lx.PLACE_SPELLINGS if spellings is None else spellings
    if flat_text is None:
        return let(
            normalize_text(text), lambda flat: mention_match(name, text, spellings, any_trigram, flat)
        )
    flat_name = normalize_text(name)
    runs = all_matches(name, f"[{CJK}]{{2,}}")
    rule = flat_text.contains(flat_name)
    rule = rule | F.exists(runs, lambda run: text.contains(run))
    rule = rule | ((F.length(flat_name) >= 4) & flat_text.contains(F.left(flat_name, F.lit(4))))
    rule = rule | _spelling_match(name, text, flat_text, spellings)
    if any_trigram:
        grams = all_matches(flat_name, "(?=(.{3}))", 1)
        rule = rule | F.exists(grams, lambda gram: flat_text.contains(gram))
    return F.coalesce((name != "") & (text != "") & rule, F.lit(False))


def _spelling_match(name: Column, text: Column, flat_text: Column, spellings: dict[str, list[str]]) -> Column:
    """Either script's spelling of a place stands for the other one."""
    if not spellings:
        return F.lit(False)
    local_of = {s.lower(): local for local, names in spellings.items() for s in names}
    to_local = F.create_map(*[F.lit(x) for pair in local_of.items() for x in pair])
    to_latin = F.create_map(
        *[x for local, names in spellings.items() for x in (F.lit(local), text_array(n.upper() for n in names))]
    )
    lowered = trimmed(F.lower(name))
    candidates = F.concat(F.array(lowered), all_matches(F.lower(name), "[a-z]+"))
    by_latin = F.exists(candidates, lambda c: F.coalesce(text.contains(to_local[c]), F.lit(False)))
    by_local = F.exists(
        F.coalesce(to_latin[name], text_array([])), lambda s: flat_text.contains(s)
    )
    return by_latin | by_local


def novel_mention(name: Column | str, text: Column | str) -> Column:
    """Mention test of the novelty split: containment, a shared keyword, a prefix."""
    name, text = as_col(name), as_col(text)
    flat_name, flat_text = normalize_text(name), normalize_text(text)
    return F.coalesce(
        (name != "")
        & (
            flat_text.contains(flat_name)
            | F.arrays_overlap(keyword_set(name), keyword_set(text))
            | ((F.length(flat_name) >= 4) & flat_text.contains(F.left(flat_name, F.lit(4))))
        ),
        F.lit(False),
    )


def concept_preserved(concept: Column, text: Column, flat_text: Column) -> Column:
    """Whole concept after normalisation, or any two-character piece of it."""
    pieces = all_matches(concept, "(?s)(?=(.{2}))", 1)
    return flat_text.contains(normalize_text(concept)) | (
        (F.length(concept) >= 2) & F.exists(pieces, lambda p: text.contains(p))
    )


def evidence_parts(source: Column) -> Column:
    """What the grounding test needs of a source text: normalised, and its 3-grams."""
    flat = normalize_text(source)
    return F.struct(flat.alias("flat"), char_ngrams(flat, 3).alias("grams"))


def grounded(fact: Column, source: Column, threshold: float = 0.6, parts: Column | None = None) -> Column:
    """Is a fact supported by a source text: contained, overlapping, or half its words?

    Pass ``parts`` when many facts are tested against one source.
    """
    if parts is None:
        return let(evidence_parts(source), lambda p: grounded(fact, source, threshold, p))
    flat_fact, flat_source = normalize_text(fact), parts["flat"]
    fact_grams = char_ngrams(flat_fact, 3)
    overlap = share(F.size(F.array_intersect(fact_grams, parts["grams"])), F.size(fact_grams), 0.0)
    words = all_matches(fact, f"[{CJK}]{{2,}}")
    present = F.size(F.filter(words, lambda w: source.contains(w)))
    return F.coalesce(
        (fact != "")
        & (
            flat_source.contains(flat_fact)
            | (overlap >= threshold)
            | ((F.size(words) >= 2) & (share(present, F.size(words), 0.0) >= 0.5))
        ),
        F.lit(False),
    )


def local_names(flat: Column, spellings: dict[str, list[str]]) -> Column:
    """Local names of the places that a cleaned name, or a Latin word of it, is a spelling of."""
    local_of = {s.lower(): local for local, names in spellings.items() for s in names}
    to_local = F.create_map(*[F.lit(x) for pair in local_of.items() for x in pair])
    words = F.concat(F.array(flat), all_matches(flat, "[a-z]+"))
    return F.filter(F.transform(words, lambda w: to_local[w]), lambda w: w.isNotNull())


def names_match(left: Column | str, right: Column | str, spellings: dict[str, list[str]] | None = None) -> Column:
    """Two entity names denote one thing: equal, nested, spelled differently, same start."""
    left, right = as_col(left), as_col(right)
    a, b = F.lower(normalize_text(left)), F.lower(normalize_text(right))
    spellings = lx.PLACE_SPELLINGS if spellings is None else spellings
    rule = a.contains(b) | b.contains(a)
    rule = rule | ((F.length(a) >= 4) & (F.length(b) >= 4) & (F.left(a, F.lit(4)) == F.left(b, F.lit(4))))
    if spellings:
        rule = rule | F.exists(local_names(a, spellings), lambda x: right.contains(x) | x.contains(right))
        rule = rule | F.exists(local_names(b, spellings), lambda x: left.contains(x) | x.contains(left))
    return F.coalesce((left != "") & (right != "") & rule, F.lit(False))


def decompose_facts(text: Column | str, terminators: str = "。！？.!?\n;；", whole_if_none: bool = True) -> Column:
    """Sentences of five characters or more, none nested in an earlier one."""
    text = as_col(text)
    sentences = F.filter(
        split_sentences(text, terminators),
        lambda s: (F.length(s) >= 5) & s.rlike(r"(?U)[\p{Alnum}]"),
    )
    facts = F.aggregate(
        F.array_distinct(sentences),
        text_array([]),
        lambda kept, s: F.when(
            F.exists(kept, lambda k: k.contains(s) | s.contains(k)), kept
        ).otherwise(F.array_append(kept, s)),
    )
    if not whole_if_none:
        return facts
    whole = F.array(trimmed(text))
    return let(facts, lambda kept: F.when((F.size(kept) == 0) & (trimmed(text) != ""), whole).otherwise(kept))


def rule_supported(fact: Column, source: Column, stop_words: Sequence[str] = tuple(lx.FACT_STOP_WORDS)) -> Column:
    """At least half of the meaningful tokens of a fact occur in the source."""
    tokens = all_matches(fact, "[一-鿿]{2,}|[A-Za-z]+[0-9]+|[0-9]+")
    stop = text_array(stop_words)
    meaningful = F.filter(tokens, lambda t: ~F.array_contains(stop, t))
    matched = F.size(F.filter(meaningful, lambda t: source.contains(t)))
    return share(matched, F.size(meaningful), 0.0) >= 0.5

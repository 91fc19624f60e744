"""What retrieved evidence adds to a text, and how a produced text uses it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicons as lx
from ..functions.columns import all_matches, any_term, as_col, let, text_array
from ..functions.text import (
    CJK, evidence_parts, grounded, keyword_set, localize_name, mention_match, names_match, normalize_text, truncate_at_boundary,
)
from .dedup import fuzzy_groups
from .filters import significant_overlap
from .retrieval import top_k


def prepare_queries(queries: DataFrame) -> DataFrame:
    """Normalised text and keywords of each query, computed once."""
    return queries.select(
        "query_id", normalize_text("text").alias("_flat"), keyword_set("text").alias("_words")
    )


def _mentioned(name: Column) -> Column:
    flat = normalize_text(name)
    return F.coalesce(
        (name != "")
        & (
            F.col("_flat").contains(flat)
            | F.arrays_overlap(keyword_set(name), F.col("_words"))
            | ((F.length(flat) >= 4) & F.col("_flat").contains(F.left(flat, F.lit(4))))
        ),
        F.lit(False),
    )


def split_entities(queries: DataFrame, entities: DataFrame, name: str = "title") -> DataFrame:
    """Add ``is_novel``: true where the query text does not mention the entity."""
    joined = entities.where(F.col(name) != "").join(prepare_queries(queries), "query_id")
    return joined.withColumn("is_novel", ~_mentioned(F.col(name))).drop("_flat", "_words")


def split_relationships(queries: DataFrame, relationships: DataFrame) -> DataFrame:
    """Add ``is_novel``: neither end mentioned and no query keyword in the description."""
    joined = relationships.join(prepare_queries(queries), "query_id")
    described = F.exists("_words", lambda w: F.coalesce(F.col("description").contains(w), F.lit(False)))
    aligned = _mentioned(F.col("source")) | _mentioned(F.col("target")) | described
    return joined.withColumn("is_novel", ~aligned).drop("_flat", "_words")


def novel_snippets(
    queries: DataFrame, communities: DataFrame | None = None, units: DataFrame | None = None,
    n_communities: int = 5, n_units: int = 10, minimum: int = 50, cut: int = 400,
) -> DataFrame:
    """New background texts ``(query_id, kind, rank, snippet)`` that do not repeat the query."""
    parts = []
    if communities is not None:
        parts.append(communities.where(F.col("rank") <= n_communities).select("query_id", F.lit("community").alias("kind"), "rank", F.col("summary").alias("_s")))
    if units is not None:
        parts.append(units.where(F.col("rank") <= n_units).select("query_id", F.lit("text_unit").alias("kind"), "rank", F.col("text").alias("_s")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    joined = rows.where(F.length("_s") > minimum).join(prepare_queries(queries), "query_id")
    return joined.where(~significant_overlap("_s", F.col("_flat"))).select(
        "query_id", "kind", "rank", F.left("_s", F.lit(cut)).alias("snippet")
    )


def novel_counts(items: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Number of new items per query and kind as columns."""
    return items.groupBy("query_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])


def novel_context(
    entities: DataFrame, relationships: DataFrame, snippets: DataFrame,
    n_entities: int = 8, n_relationships: int = 5, n_snippets: int = 8, cut: int = 200,
) -> DataFrame:
    """Short localised lines of new knowledge: ``(query_id, kind, position, line)``."""
    e = top_k(entities.where("is_novel"), ["query_id"], [F.col("rank")], n_entities, "position").select(
        "query_id", F.lit("entity").alias("kind"), "position",
        F.concat(localize_name("title", "description"), F.lit(": "), truncate_at_boundary("description", cut)).alias("line"),
    )
    r = top_k(relationships.where("is_novel"), ["query_id"], [F.col("rank")], n_relationships, "position").select(
        "query_id", F.lit("relationship").alias("kind"), "position",
        F.concat(
            localize_name("source", "description"), F.lit(" -> "), localize_name("target", "description"), F.lit(": "),
            truncate_at_boundary("description", cut),
        ).alias("line"),
    )
    s = top_k(snippets, ["query_id"], [F.col("kind"), F.col("rank")], n_snippets, "position").select(
        "query_id", F.lit("snippet").alias("kind"), "position", truncate_at_boundary("snippet", cut).alias("line")
    )
    return e.unionByName(r).unionByName(s)


def evidence_text(entities: DataFrame, relationships: DataFrame, snippets: DataFrame) -> DataFrame:
    """All new evidence of a query as one string; the inputs are capped result lists."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = (
        entities.where("is_novel").select("query_id", F.lit(0).alias("o"), "rank", F.concat_ws(" ", blank("title"), blank("description")).alias("t"))
        .unionByName(
            relationships.where("is_novel").select("query_id", F.lit(1).alias("o"), "rank", F.concat_ws(" ", blank("source"), blank("target"), blank("description")).alias("t"))
        )
        .unionByName(snippets.select("query_id", F.when(F.col("kind") == "community", 2).otherwise(3).alias("o"), "rank", F.col("snippet").alias("t")))
    )
    return rows.groupBy("query_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("o", "rank", "t")))["t"], " ").alias("evidence")
    )


def used_entities(produced: Column, available: Column, spellings: dict[str, list[str]] | None = None) -> Column:
    """Available names mentioned in the produced text, one per fuzzy group."""
    used = let(
        normalize_text(produced),
        lambda flat: F.filter(available, lambda n: mention_match(n, produced, spellings, True, flat)),
    )
    return fuzzy_groups(used, spellings)


def fact_candidates(produced: Column, source: Column, pattern: str = f"[{CJK}]{{3,10}}", k: int = 50) -> Column:
    """Runs of the produced text that the source does not have, in order, first k."""
    fresh = F.array_except(F.array_distinct(all_matches(produced, pattern)), all_matches(source, pattern))
    return F.slice(fresh, 1, k)


def compound_facts(produced: Column, source: Column) -> Column:
    """Dated events, both ends of plain statements, and years the source lacks."""
    event = f"([0-9]{{4}})年(?:的)?([{CJK}]{{2,8}}(?:会议|全会|政策|制度|特区|开放))"
    years, events = all_matches(produced, event, 1), all_matches(produced, event, 2)
    dated = F.flatten(
        F.transform(
            F.arrays_zip(events.alias("e"), years.alias("y")),
            lambda p: F.when(source.contains(p["e"]), text_array([])).otherwise(F.array(p["e"], p["y"])),
        )
    )
    relation = f"([{CJK}]{{2,6}})(?:是|为|推动|确立|建立|创办)([{CJK}]{{2,6}})"
    ends = F.flatten(
        F.transform(
            F.arrays_zip(all_matches(produced, relation, 1).alias("a"), all_matches(produced, relation, 2).alias("b")),
            lambda p: F.array(p["a"], p["b"]),
        )
    )
    ends = F.filter(ends, lambda x: ~source.contains(x) & ~any_term(x, lx.RELATION_STOP_WORDS))
    full_year = "(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])"
    new_years = F.array_except(all_matches(produced, full_year), all_matches(source, full_year))
    return F.concat(dated, ends, new_years)


def new_facts(produced: Column, source: Column, k: int = 30) -> Column:
    """Candidates that pass the rules, then compound facts; ordered distinct, first k."""
    kept = F.filter(fact_candidates(produced, source), lambda c: (F.length(c) >= 3) | any_term(c, lx.FACT_MARKERS))
    return F.slice(F.array_distinct(F.concat(kept, compound_facts(produced, source))), 1, k)


def fact_grounding(
    facts: Column | str, source: Column | str, evidence: Column | str, available: Column | str,
    spellings: dict[str, list[str]] | None = None,
) -> Column:
    """``struct<grounded, unsupported>`` lists: matched by name or evidence; in neither nor the source.

    A number is in the source if it stands there by itself, not as part of a longer one, as ``new_facts`` reads years.
    """
    facts, source, evidence, available = (as_col(c) for c in (facts, source, evidence, available))

    def supported(f: Column, parts: Column) -> Column:
        return F.exists(available, lambda n: names_match(f, n, spellings)) | grounded(f, evidence, parts=parts)

    ok = let(evidence_parts(evidence), lambda parts: F.filter(facts, lambda f: supported(f, parts)))
    told = lambda f, numbers: F.when(f.rlike("^[0-9]+$"), F.array_contains(numbers, f)).otherwise(source.contains(f))
    bad = lambda kept: let(all_matches(source, "[0-9]+"), lambda numbers: F.filter(F.array_except(facts, kept), lambda f: ~told(f, numbers)))
    return let(ok, lambda kept: F.struct(kept.alias("grounded"), bad(kept).alias("unsupported")))

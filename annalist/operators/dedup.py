"""First-wins de-duplication by key, by containment and by fuzzy groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import text_array
from ..functions.text import names_match
from ..session import cut_lineage


def dedup_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Keep the first row of each key. An aggregate, so duplicates collapse before the shuffle.

    ``order`` columns must sort ascending; negate a score to prefer high ones.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    position = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), position).alias("_kept"))
    return kept.select(*keys, "_kept.*").select(*df.columns)


def _fold(names: Column, kept: Column, k: int) -> Column:
    """Greedy pass: a name joins unless it contains, or lies in, a kept one."""
    return F.aggregate(
        names,
        kept,
        lambda acc, n: F.when(
            (F.size(acc) >= k) | F.exists(acc, lambda x: x["name"].contains(n["name"]) | n["name"].contains(x["name"])),
            acc,
        ).otherwise(F.array_append(acc, n)),
    )


def greedy_dedup(
    df: DataFrame, group: str, name: str, score: str, tie: str, k: int = 10, batch: int = 256
) -> DataFrame:
    """Exact greedy containment de-duplication, best ``k`` names per group.

    Reads a group best-first in batches of bounded size: fold the best ``batch``
    candidates, and only for groups still short of ``k`` names drop what the kept names
    exclude and read on. Each round settles a group or adds names to it.
    """
    df = cut_lineage(df)
    ranked = df.select(
        F.col(group).alias("_g"), F.lower(F.col(name)).alias("_name"),
        F.struct((-F.col(score)).alias("neg"), F.col(tie).alias("tie")).alias("_at"),
    )
    pool = ranked.groupBy("_g", "_name").agg(F.min("_at").alias("_at"))
    kept = None
    while True:
        order = Window.partitionBy("_g").orderBy("_at")
        # One row more than is read tells whether the group goes on.
        top = pool.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= batch + 1)
        gathered = top.groupBy("_g").agg(
            F.array_sort(F.collect_list(F.struct(F.col("_r").alias("r"), F.col("_name").alias("name"), F.col("_at").alias("at")))).alias("_batch"),
        )
        items = F.transform(F.slice("_batch", 1, batch), lambda b: F.struct(b["name"].alias("name"), b["at"].alias("at")))
        more = F.size("_batch") > batch
        if kept is None:
            start = F.array().cast(_kept_type(pool))
            state = gathered.select("_g", _fold(items, start, k).alias("_kept"), more.alias("_more"))
        else:
            state = kept.join(gathered, "_g", "left").select(
                "_g",
                F.when(F.col("_batch").isNull(), F.col("_kept")).otherwise(_fold(items, F.col("_kept"), k)).alias("_kept"),
                F.coalesce(more, F.lit(False)).alias("_more"),
            )
        state = state.withColumn("_open", (F.size("_kept") < k) & F.col("_more"))
        state = cut_lineage(state.select("_g", "_kept", "_open"))
        kept = state.select("_g", "_kept")
        if state.where("_open").isEmpty():
            break
        blocked = F.exists("_kept", lambda x: x["name"].contains(F.col("_name")) | F.col("_name").contains(x["name"]))
        pool = cut_lineage(
            pool.join(state.where("_open").select("_g", "_kept"), "_g").where(~blocked).select("_g", "_name", "_at")
        )
    picked = kept.select("_g", F.posexplode("_kept").alias("_pos", "_k")).select(
        F.col("_g").alias(group), (F.col("_pos") + 1).alias("rank"), F.col("_k.at.tie").alias(tie)
    )
    return picked.join(df, [group, tie])


def _kept_type(pool: DataFrame) -> str:
    at = pool.schema["_at"].dataType.simpleString()
    return f"array<struct<name:string,at:{at}>>"


def fuzzy_groups(names: Column, spellings: dict[str, list[str]] | None = None) -> Column:
    """Representatives of a short name list grouped by fuzzy match, in order.

    Meant for lists bounded by a retrieval cap. A group is represented by its first
    Chinese name, else its first name.
    """
    empty = F.array().cast("array<array<string>>")

    def place(groups: Column, n: Column) -> Column:
        matching = F.transform(
            groups, lambda g: F.exists(g, lambda member: names_match(n, member, spellings))
        )
        at = F.array_position(matching, F.lit(True))
        return F.when(at == 0, F.array_append(groups, F.array(n))).otherwise(
            F.transform(groups, lambda g, i: F.when(i + 1 == at, F.array_append(g, n)).otherwise(g))
        )

    groups = F.aggregate(F.coalesce(names, text_array([])), empty, place)
    return F.transform(
        groups,
        lambda g: F.coalesce(F.get(F.filter(g, lambda n: n.rlike("[一-鿿]")), F.lit(0)), F.get(g, F.lit(0))),
    )

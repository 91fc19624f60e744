"""Ordered running sums that never gather one key in one task.

A window partitioned by the key alone would hand a hot key to a single task, and an
unpartitioned one the whole table. Here rows are first cut into ranges of the order
column, sums run inside (key, range), and the few range totals carry over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of one range of the order, about.
RANGE_ROWS = 250_000
#: Rows of the sample for each range that cut points are taken from.
SAMPLE_ROWS = 32
#: Parts that the rows of one key are dealt into where a limit is applied.
SALTS = 64


def range_bounds(df: DataFrame, order_cols: Sequence[str], ranges: int) -> list:
    """At most ``ranges - 1`` cut points: every n-th row of a sorted sample of the order columns.

    The sample holds the rows with the smallest hashes, so it is the same each time.
    """
    if ranges <= 1:
        return []
    rows = df.select(*order_cols)
    sample = rows.orderBy(F.xxhash64(*order_cols)).limit(ranges * SAMPLE_ROWS).orderBy(*order_cols).collect()
    cuts = [tuple(sample[i]) for i in range(SAMPLE_ROWS, len(sample), SAMPLE_ROWS)]
    return list(dict.fromkeys(cuts))


def range_of(df: DataFrame, order_cols: Sequence[str], bounds: list) -> Column:
    """Number of the range a row falls into: how many bounds lie below it, by binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    kinds = {c: df.schema[c].dataType for c in order_cols}
    row = F.struct(*[F.col(c).alias(c) for c in order_cols])
    table = F.array(*[F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order_cols, b)]) for b in bounds])
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]

    def search(at: Column, step: Column) -> Column:
        ahead = at + step
        return F.when((ahead <= len(bounds)) & (row > F.get(table, ahead - 1)), ahead).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), search)


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order_cols: Sequence[str],
    sums: dict[str, str],
    ranges: int | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Add running sums per key; ``sums`` maps new columns to the columns they add up.

    Keys and order columns may be of any sortable type, and a null key is a key. Rows that tie in all order
    columns are ordered by a hash of the row, so a key with a single order value is split, too.
    """
    keys = list(keys)
    ranges = ranges or -(-df.count() // RANGE_ROWS)
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    tied = df.withColumn("_tie", F.xxhash64(*hashed))
    order = [*order_cols, "_tie"]
    cut = tied.withColumn("_range", range_of(tied, order, range_bounds(tied, order, ranges)))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    before = (
        Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = cut.groupBy(*keys, "_range").agg(
        *[F.sum(source).alias(f"_total_{name}") for name, source in sums.items()]
    )
    carried = totals.select(
        *keys,
        "_range",
        *[
            F.coalesce(F.sum(f"_total_{name}").over(before), F.lit(0)).alias(f"_carry_{name}")
            for name in sums
        ],
    )
    local = cut.select(
        "*",
        *[F.coalesce(F.sum(source).over(inside), F.lit(0)).alias(f"_local_{name}") for name, source in sums.items()],
    )
    named = carried.select(*[F.col(c).alias(f"_k_{c}") for c in [*keys, "_range"]], *[f"_carry_{name}" for name in sums])
    same = F.lit(True)
    for c in [*keys, "_range"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    joined = local.join(named, same, "left")
    plain = [c for c in df.columns if c not in sums]
    return joined.select(
        *plain,
        *[(F.col(f"_local_{name}") + F.col(f"_carry_{name}")).alias(name) for name in sums],
    )


def running_index(df: DataFrame, order_cols: Sequence[str], name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Dense zero-based row number in order, per key or over the whole table."""
    counted = df.withColumn("_one", F.lit(1).cast("long"))
    return running_sums(counted, keys, order_cols, {name: "_one"}, inclusive=False).drop("_one")


def running_averages(
    df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], value: str, name: str = "running_avg"
) -> DataFrame:
    """Average of all values up to and including each row; nulls do not count."""
    prepared = df.withColumn("_n", F.col(value).isNotNull().cast("long")).withColumn(
        "_v", F.coalesce(F.col(value), F.lit(0))
    )
    summed = running_sums(prepared, keys, order_cols, {"_rn": "_n", "_rv": "_v"})
    return summed.withColumn(name, F.when(F.col("_rn") > 0, F.col("_rv").cast("double") / F.col("_rn"))).drop(
        "_n", "_v", "_rn", "_rv"
    )


def progress(df: DataFrame, order_cols: Sequence[str], done: str, elapsed: str, total: Column) -> DataFrame:
    """Completed count, elapsed time and estimated remaining time after each batch."""
    summed = running_sums(df, [], order_cols, {"completed": done, "elapsed_total": elapsed})
    remaining = F.greatest(F.lit(0), total - F.col("completed"))
    return summed.withColumn(
        "eta", F.when(F.col("completed") > 0, F.col("elapsed_total") / F.col("completed") * remaining)
    )


def leading_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, name: str = "rank") -> DataFrame:
    """First rows of each key with their rank. Salted parts of a key are limited first, so no task sorts a whole hot key."""
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    salted = Window.partitionBy(*keys, "_salt").orderBy(*order)
    some = df.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(SALTS)).cast("int")).withColumn(name, F.row_number().over(salted))
    window = Window.partitionBy(*keys).orderBy(*order)
    return some.where(F.col(name) <= limit).drop("_salt").withColumn(name, F.row_number().over(window)).where(F.col(name) <= limit)


def within_budget(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], length: Column, budget: int, name: str = "used_chars"
) -> DataFrame:
    """Leading rows of each key whose lengths, plus one for each joint, fit the budget.

    Every row costs at least one, so no more than ``budget + 1`` rows of a key can ever fit. The limit is applied
    in salted parts of a key first, so one task never sorts a whole hot key.
    """
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    part = F.pmod(F.xxhash64(*hashed), F.lit(SALTS)).cast("int")
    salted = Window.partitionBy(*keys, "_salt").orderBy(*order)
    window = Window.partitionBy(*keys).orderBy(*order)
    some = df.withColumn("_salt", part).withColumn("_row", F.row_number().over(salted)).where(F.col("_row") <= budget + 1)
    cut = some.drop("_salt").withColumn("_row", F.row_number().over(window)).where(F.col("_row") <= budget + 1)
    running = Window.partitionBy(*keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumn(name, F.sum((length + 1).cast("long")).over(running) - 1)
    return summed.where(F.col(name) <= budget).drop("_row")

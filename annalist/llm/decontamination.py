"""Benchmark passages inside documents, by a prefix-filtered set join in DataFrame operations alone.

An item is cut into windows of consecutive words; a document contains a window only if it contains every shingle of
it. For containment of the whole window one shingle, the rarest in the global order, is the necessary prefix. So each
window is filed under its rarest shingle, counted over all documents, and meets only the places of documents where that
shingle stands. The place of the shingle in the window says where the window would have to begin: what would begin
before the document or end behind it is dropped by position and length, the rest is compared word by word.

Documents are cut into words once and written with a row number, so repeated rows and ids stay apart and a lost
executor costs its tasks only. The table of windows is broadcast in slices of a checked size; a large benchmark
takes several slices, each joined with all documents. Windows whose rarest shingle occurs nowhere are in no slice.

Defined cases: null or empty texts have no words, are not hit and not contaminated; items without words or without an id
take no part; repeated items count once; documents with equal ids or texts are judged row by row; other columns of
the inputs are not read. Empty tables give empty results or documents without hits.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, functions as F

from .common import shared_folder

#: What separates words: all ASCII characters but digits and lower-case letters.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Bytes of windows in one broadcast slice.
SLICE_BYTES = 32 << 20

#: Item ids that one entry of a window holds, about.
ENTRY_ITEMS = 10_000


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; other letters stay as they are."""
    plain = F.length(text) == F.octet_length(text)
    lower = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(F.coalesce(lower, F.lit("")), BREAKS), "")


def shingle_at(text_words: Column, at: Column, width: int) -> Column:
    """Key of the shingle that begins at a place; equal shingles have equal keys, a comparison of words follows."""
    return F.xxhash64(*[F.get(text_words, at + i) for i in range(width)])


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """``(window, item_ids)``: distinct windows, whole items where they are shorter, with the items that hold them."""
    cut = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words"))
    cut = cut.where(F.col("item_id").isNotNull() & (F.size("words") > 0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    windows = cut.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, size))).alias("window"))
    parts = max(1, math.ceil(cut.count() / ENTRY_ITEMS))
    return windows.groupBy("window", F.pmod(F.xxhash64("item_id"), F.lit(parts)).alias("_part")).agg(
        F.collect_set("item_id").alias("item_ids")).drop("_part")


def slices(table: DataFrame, bytes_each: Column, key: str) -> list[DataFrame]:
    """The rows of a table in slices that are small enough to broadcast."""
    total = table.agg(F.sum(bytes_each)).first()[0] or 0
    n = math.ceil(total / SLICE_BYTES)
    return [table.where(F.pmod(F.col(key), F.lit(n)) == i) if n > 1 else table for i in range(n)]


def shingle_counts(documents: DataFrame, wanted: DataFrame, width: int) -> DataFrame | None:
    """``(key, n)``: how often each wanted shingle stands in the documents."""
    places = documents.select("words", F.posexplode("words").alias("at", "_w")).select(
        shingle_at(F.col("words"), F.col("at"), width).alias("key"))
    counts = None
    for part in slices(wanted, F.lit(16), "key"):
        found = places.join(F.broadcast(part), "key").groupBy("key").agg(F.count("*").alias("n"))
        counts = found if counts is None else counts.unionByName(found)
    return counts


def window_index(documents: DataFrame, windows: DataFrame, width: int) -> DataFrame | None:
    """``(key, entries)``: windows by their rarest shingle; entries hold its place in the window, the window, the items."""
    starts = F.sequence(F.lit(0), F.size("window") - width)
    keyed = windows.withColumn("grams", F.transform(starts, lambda s: F.struct(shingle_at(F.col("window"), s, width).alias("key"), s.alias("lead"))))
    wanted = keyed.select(F.explode("grams.key").alias("key")).distinct()
    counts = shingle_counts(documents, wanted, width)
    if counts is None:
        return None
    rated = keyed.select("window", "item_ids", F.inline("grams")).join(counts, "key", "left")
    # A window with a shingle that occurs nowhere has it as its rarest and is not looked for.
    rarest = rated.groupBy("window", "item_ids").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "lead")).alias("g"))
    return rarest.where("g.n > 0").groupBy("g.key").agg(
        F.collect_list(F.struct("g.lead", "window", "item_ids")).alias("entries"))


def occurrences(documents: DataFrame, index: DataFrame, width: int) -> DataFrame:
    """``(row_id, spans)``: occurrences of windows around each place of a document with a window's shingle, or none.

    Rows without any are dropped after they are gathered: a filter here would become part of the join's condition, and a
    lambda there keeps the places of a document from being compiled into the join, which then copies its words for each.
    """
    places = documents.select("row_id", "words", F.posexplode("words").alias("at", "_w")).withColumn(
        "key", shingle_at(F.col("words"), F.col("at"), width))
    met = places.join(F.broadcast(index), "key")

    def holds(entry: Column) -> Column:
        begin, length = F.col("at") - entry["lead"], F.size(entry["window"])
        inside = (begin >= 0) & (begin + length <= F.size("words"))
        return inside & (F.slice("words", begin + 1, length) == entry["window"])

    span = lambda e: F.struct((F.col("at") - e["lead"]).alias("start"), F.size(e["window"]).alias("length"), e["item_ids"].alias("item_ids"))
    return met.select("row_id", F.transform(F.filter("entries", holds), span).alias("spans"))


def covered(spans: Column) -> Column:
    """Number of places inside any span, spans in order of their starts."""
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def add(s: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        fresh = F.greatest(end - F.greatest(x["start"], s["end"]), F.lit(0))
        return F.struct((s["n"] + fresh).alias("n"), F.greatest(end, s["end"]).alias("end"))

    return F.aggregate(spans, state, add)["n"]


def contamination(documents: DataFrame, items: DataFrame, size: int = 10, width: int = 2) -> DataFrame:
    """``(doc_id, n_words, n_hit, item_ids, spans, contaminated)`` of every document.

    ``size``: words of a window; ``width``: words of a shingle (a shorter window is filed under its first words).
    ``spans(start, length)`` are the occurrences of windows by word number, ``item_ids`` the sorted items they belong to.
    """
    spark = documents.sparkSession
    place = shared_folder(spark, "decontamination")
    cut = documents.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", words(F.col("text")).alias("words"))
    cut.write.parquet(f"{place}/words")
    cut = spark.read.parquet(f"{place}/words")
    item_windows(items, size).write.parquet(f"{place}/windows")
    windows = spark.read.parquet(f"{place}/windows")

    found = None
    for n in sorted({min(row[0], width) for row in windows.select(F.size("window")).distinct().collect()}):
        same = windows.where(F.size("window") >= n if n == width else F.size("window") == n)
        index = window_index(cut, same, n)
        if index is None:
            continue
        index.write.parquet(f"{place}/index-{n}")
        index = spark.read.parquet(f"{place}/index-{n}")
        held = F.aggregate("entries", F.lit(0), lambda s, e: s + F.length(F.array_join(e["window"], " ")) * 2 + F.size(e["item_ids"]) * 24 + 64)
        for part in slices(index, held, "key"):
            rows = occurrences(cut, part, n)
            found = rows if found is None else found.unionByName(rows)

    base = cut.select("row_id", "doc_id", F.size("words").cast("long").alias("n_words"))
    if found is None:
        spans, ids = F.array().cast("array<struct<start:int,length:int>>"), F.array().cast("array<string>")
        hits = base.withColumn("spans", spans).withColumn("item_ids", ids)
    else:
        gathered = found.groupBy("row_id").agg(F.flatten(F.collect_list("spans")).alias("hits")).select(
            "row_id",
            F.array_sort(F.array_distinct(F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["length"].alias("length"))))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten("hits.item_ids"))).alias("item_ids"),
        )
        hits = base.join(gathered, "row_id", "left").select(
            "doc_id", "n_words", F.coalesce("spans", F.array()).alias("spans"), F.coalesce("item_ids", F.array()).alias("item_ids"))
    hits = hits.select("doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), "item_ids", "spans")
    return hits.withColumn("contaminated", F.col("n_hit") > 0)

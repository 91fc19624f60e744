"""Phrase collocations: exact n-gram counts from bidirectional FM-indexes over word ids.

Every task cuts its documents into shards of one language, a sequence of word ids with a break between pieces. Two
Burrows-Wheeler transforms are kept per shard, of the sequence and of its reverse, sorted by as many words as the
longest phrase has. A phrase is an interval in both: one step extends the intervals of all phrases by every word before
(or after) them and gives the counts of the longer phrases. Only phrases whose first and last part are frequent over
all shards are followed: the extensions to the left of the frequent phrases meet those to their right.

Counts of shards are summed by key, the id of the first part and the last word: exact, no hashing. Keys travel packed in
arrays by (language, bucket), with buckets in number to the words of the language, and come back to the shards as
places and ids of what is frequent. No task sees more than a shard or a bucket; the text is read once.

Defined cases: a null text has no words; a null language is ``und``; rows are counted as often as they stand in
the table; other columns are not read; ties of scores fall to the more frequent, then to the smaller phrase in bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import make_known, shared_folder
from .merkle import numbered
from .warc import _file_system, open_output

#: Words of a shard, apart from what its last document has beyond them.
SHARD_WORDS = 2_000_000

#: Words of a language for each bucket of keys.
BUCKET_WORDS = 1_000_000

BREAK = b"\xff"

#: A-Z in lower case, ends of pieces as a byte that no UTF-8 text holds.
FOLDED = bytes(255 if chr(b) in ".,;:!?\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


# --- shards --------------------------------------------------------------------------------

class Draft:
    """Word ids of one language's texts, as they come; id 0 is the break."""

    class Ids(dict):
        def __missing__(self, word: bytes) -> int:
            self[word] = len(self)
            return self[word]

    def __init__(self) -> None:
        self.ids, self.parts, self.size = Draft.Ids({BREAK: 0}), [], 0

    def add(self, text: bytes) -> None:
        tokens = text.translate(FOLDED).replace(BREAK, b" \xff ").split()
        self.parts.append(np.fromiter(map(self.ids.__getitem__, tokens), np.int32, len(tokens)))
        self.parts.append(np.zeros(1, np.int32))
        self.size += len(tokens)

    def row(self, shard: str, lang: str, file: str) -> pa.RecordBatch:
        """Write the ids, return the shard's row."""
        ids = np.concatenate([np.zeros(1, np.int32), *self.parts])
        save(file, ids)
        counts = np.bincount(ids, minlength=len(self.ids))
        words = pa.array(list(self.ids)[1:], pa.binary()).cast(pa.string())
        lists = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), x) for x in (words, pa.array(counts[1:], pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([lang]), pa.array([file]), *lists], ["shard", "lang", "file", "words", "counts"])


def save(file: str, array: np.ndarray) -> None:
    with open_output(file) as out:
        np.lib.format.write_array(out, array, allow_pickle=False)


def load(file: str) -> np.ndarray:
    system, path = _file_system(file)
    with system.open_input_stream(path, compression=None) as source:
        return np.lib.format.read_array(source, allow_pickle=False)


def write_shards(documents: DataFrame, folder: str, shard_words: int) -> DataFrame:
    """``(shard, lang, file, words, counts)``: shards with their vocabularies; the ids are in files."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drafts: dict[str, Draft] = {}

        def done(lang: str) -> pa.RecordBatch:
            # The name is new for every attempt; the written table names those that count.
            shard = uuid.uuid4().hex
            return drafts.pop(lang).row(shard, lang, f"{folder}/ids/{shard}.npy")

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                draft = drafts.setdefault(lang, Draft())
                draft.add(text.as_py())
                if draft.size >= shard_words:
                    yield done(lang)
                elif sum(d.size for d in drafts.values()) >= 2 * shard_words:
                    yield done(max(drafts, key=lambda x: drafts[x].size))
        for lang in list(drafts):
            yield done(lang)

    rows = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    rows.mapInArrow(cut, "shard string, lang string, file string, words array<string>, counts array<long>").write.parquet(f"{folder}/shards")
    return documents.sparkSession.read.parquet(f"{folder}/shards")


# --- index ---------------------------------------------------------------------------------

def ranks(ids: np.ndarray, depth: int) -> np.ndarray:
    """Keys that order the places of a circular sequence by the next ``depth`` ids."""
    keys, known = ids.astype(np.int64), 1
    while known < depth:
        step = min(known, depth - known)
        bits = int(keys.max()).bit_length()
        if 2 * bits > 62:
            keys = np.unique(keys, return_inverse=True)[1].reshape(-1)
            bits = int(keys.max()).bit_length()
        keys = (keys << bits) | np.roll(keys, -step)
        known += step
    return keys


class Index:
    """FM-index of a circular id sequence in both directions, exact for phrases of up to ``depth`` words.

    Suffixes that agree in ``depth`` ids may stand in any order. Interval counts of shorter phrases, and of phrases made
    longer by one word up to ``depth``, do not depend on it.
    """

    def __init__(self, before: np.ndarray, after: np.ndarray) -> None:
        """``before``: the id before each suffix in order; ``after``: the same for the reversed sequence."""
        self.before, self.after = before, after
        self.counts = np.bincount(before)
        self.first = np.cumsum(self.counts) - self.counts
        self._steps = [self._mapping(before), self._mapping(after)]

    @classmethod
    def of(cls, ids: np.ndarray, depth: int) -> Index:
        def transform(sequence: np.ndarray) -> np.ndarray:
            return np.roll(sequence, 1)[np.argsort(ranks(sequence, depth))]

        small = np.uint16 if int(ids.max(initial=0)) < 1 << 16 else np.int32
        ids = ids.astype(small)
        return cls(transform(ids), transform(ids[::-1]))

    @staticmethod
    def _mapping(transform: np.ndarray) -> np.ndarray:
        """For each place the rank of the suffix that begins one id earlier."""
        steps = np.empty(len(transform), np.int32)
        steps[np.argsort(transform, kind="stable")] = np.arange(len(transform), dtype=np.int32)
        return steps

    def words(self) -> Phrases:
        """All words as intervals."""
        ids = np.flatnonzero(self.counts)
        ids = ids[ids > 0]
        return Phrases(self.first[ids], self.first[ids], self.counts[ids], ids, np.arange(len(ids)))

    def left(self, phrases: Phrases) -> Phrases:
        """All phrases by one word before them."""
        lo, shift, size, word, source = self._extend(self.before, self._steps[0], phrases.lo, phrases.size)
        return Phrases(lo, phrases.reverse_lo[source] + shift, size, word, source)

    def right(self, phrases: Phrases) -> Phrases:
        """All phrases by one word after them."""
        lo, shift, size, word, source = self._extend(self.after, self._steps[1], phrases.reverse_lo, phrases.size)
        return Phrases(phrases.lo[source] + shift, lo, size, word, source)

    @staticmethod
    def _extend(transform: np.ndarray, steps: np.ndarray, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each interval and each id in it: where the longer phrase's interval begins, how many ids of the interval are
        smaller, the longer phrase's count, the id, and the interval's number. Breaks extend nothing."""
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        if not total:
            none = np.empty(0, np.int64)
            return none, none, none, none, none
        source = np.repeat(np.arange(len(size)), size)
        at = np.arange(total) + np.repeat(lo - (ends - size), size)
        bits = max(1, int(transform.max()).bit_length())
        keys = (source << bits) | transform[at].astype(np.int64)
        order = np.argsort(keys)
        keys = keys[order]
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        new_lo = np.minimum.reduceat(steps[at[order]], begins).astype(np.int64)
        count = np.diff(np.append(begins, total))
        word, source = keys[begins] & ((1 << bits) - 1), keys[begins] >> bits
        shift = begins - (ends - size)[source]
        kept = word > 0
        return new_lo[kept], shift[kept], count[kept], word[kept], source[kept]


class Phrases:
    """Phrases of one length: their intervals, the word that made each, and which phrase it was made from."""

    def __init__(self, lo: np.ndarray, reverse_lo: np.ndarray, size: np.ndarray, word: np.ndarray, source: np.ndarray) -> None:
        self.lo, self.reverse_lo, self.size, self.word, self.source = lo, reverse_lo, size, word, source

    def take(self, which: np.ndarray) -> Phrases:
        return Phrases(self.lo[which], self.reverse_lo[which], self.size[which], self.word[which], self.source[which])


def longer(index: Index, phrases: Phrases, ids: np.ndarray) -> tuple[Phrases, np.ndarray, np.ndarray]:
    """Phrases longer by a word whose first and last part are among those given, with the id of the first part and
    the last word. ``ids``: global ids of the given phrases."""
    to_left, to_right = index.left(phrases), index.right(phrases)
    a, b = np.argsort(to_left.lo), np.argsort(to_right.lo)
    _, in_left, in_right = np.intersect1d(to_left.lo[a], to_right.lo[b], assume_unique=True, return_indices=True)
    made = to_right.take(b[in_right])
    return made, ids[made.source], made.word


# --- levels --------------------------------------------------------------------------------

KEYS = "lang string, bucket long, shard string, first binary, last binary, n binary"


def packed(shard: str, lang: str, buckets: int, first: np.ndarray, last: np.ndarray, n: np.ndarray) -> list[dict]:
    """Keys with counts in one row per bucket, each in the order given."""
    bucket = bucket_of(first, last, buckets)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = []
    for b in range(buckets):
        which = order[bounds[b]:bounds[b + 1]]
        if len(which):
            rows.append({"lang": lang, "bucket": b, "shard": shard, "first": first[which].astype(np.int64).tobytes(),
                         "last": last[which].astype(np.int32).tobytes(), "n": n[which].astype(np.int32).tobytes()})
    return rows


def bucket_of(first: np.ndarray, last: np.ndarray, buckets: int) -> np.ndarray:
    mixed = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + last.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def table_of(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


KEYS_ARROW = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("shard", pa.string()), ("first", pa.binary()), ("last", pa.binary()), ("n", pa.binary())])
SUMS = "lang string, bucket long, shard string, at binary, ids binary, first binary, last binary, f binary"
SUMS_ARROW = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("shard", pa.string()), ("at", pa.binary()), ("ids", pa.binary()), ("first", pa.binary()), ("last", pa.binary()), ("f", pa.binary())])


def summed(keys: DataFrame, least: int, place: str) -> DataFrame:
    """Frequent keys over all shards: per bucket one row without a shard that holds them (ids, first, last, f), and for each
    shard one that tells which of its keys they are (places in its packed row, ids)."""

    def total(table: pa.Table) -> pa.Table:
        lang, bucket = table["lang"][0].as_py(), table["bucket"][0].as_py()
        shards = table["shard"].to_pylist()
        column = lambda name, kind: [np.frombuffer(x, kind) for x in table[name].to_pylist()]
        firsts = column("first", np.int64)
        sizes = [len(x) for x in firsts]
        first, last, n = np.concatenate(firsts), np.concatenate(column("last", np.int32)), np.concatenate(column("n", np.int32))
        order = np.lexsort((last, first))
        first, last = first[order], last[order]
        begins = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (last[1:] != last[:-1])]))
        f = np.add.reduceat(n[order].astype(np.int64), begins)
        frequent = f >= least
        ids = (bucket << 32) + np.arange(int(frequent.sum()), dtype=np.int64)
        head = begins[frequent]
        rows = [{"lang": lang, "bucket": bucket, "shard": None, "ids": ids.tobytes(), "first": first[head].tobytes(), "last": last[head].tobytes(), "f": f[frequent].tobytes()}]
        # The id of each key that came in, -1 where it is not frequent, back in the order of the shards' rows.
        per_run = np.full(len(begins), -1, np.int64)
        per_run[frequent] = ids
        per_key = np.empty(len(order), np.int64)
        per_key[order] = np.repeat(per_run, np.diff(np.append(begins, len(order))))
        start = 0
        for shard, size in zip(shards, sizes):
            own = per_key[start:start + size]
            at = np.flatnonzero(own >= 0)
            rows.append({"lang": lang, "bucket": bucket, "shard": shard, "at": at.astype(np.int32).tobytes(), "ids": own[at].tobytes()})
            start += size
        return table_of(rows, SUMS_ARROW)

    keys.groupBy("lang", "bucket").applyInArrow(total, SUMS).write.parquet(place)
    return keys.sparkSession.read.parquet(place)


def first_level(shards: DataFrame, frequent: DataFrame, folder: str, depth: int, n_shards: int) -> DataFrame:
    """Build each shard's index over its frequent words; keys of its phrases of two words.

    ``shards(shard, lang, file, buckets)``, ``frequent(shard, id, word_id)``.
    """

    def build(words: pa.Table, row: pa.Table) -> pa.Table:
        if not row.num_rows or not words.num_rows:
            return table_of([], KEYS_ARROW)
        shard, lang, file, buckets = (row[c][0].as_py() for c in ("shard", "lang", "file", "buckets"))
        own, known = words["id"].to_numpy(), words["word_id"].to_numpy()
        own, known = own[np.argsort(known)], np.sort(known)
        ids = load(file)
        renamed = np.zeros(int(max(ids.max(), own.max())) + 1, np.int32)
        renamed[own] = np.arange(1, len(own) + 1)
        ids = renamed[ids]
        ids = ids[(ids > 0) | (np.roll(ids, 1) > 0) | (np.arange(len(ids)) == 0)]  # one break is as good as many
        index = Index.of(ids, depth)
        for name, array in (("before", index.before), ("after", index.after), ("words", known)):
            save(f"{folder}/index/{shard}-{name}.npy", array)
        pairs, first, last = longer(index, index.words(), known)
        return table_of(packed(shard, lang, buckets, first, known[last - 1], pairs.size), KEYS_ARROW)

    sides = frequent.repartition(n_shards, "shard").groupBy("shard").cogroup(shards.repartition(n_shards, "shard").groupBy("shard"))
    return sides.applyInArrow(build, KEYS)


def next_level(sums: DataFrame, shards: DataFrame, folder: str, length: int, n_shards: int) -> DataFrame:
    """Keys of the phrases of ``length`` words whose parts are frequent, given the sums of all lengths below."""

    def extend(given: pa.Table, row: pa.Table) -> pa.Table:
        if not row.num_rows or not given.num_rows:
            return table_of([], KEYS_ARROW)
        shard, lang, buckets = (row[c][0].as_py() for c in ("shard", "lang", "buckets"))
        before, after, known = (load(f"{folder}/index/{shard}-{name}.npy") for name in ("before", "after", "words"))
        index = Index(before, after)
        phrases, ids = index.words(), known
        for level in range(2, length):
            made, first, last = longer(index, phrases, ids)
            rows = [x for x in given.to_pylist() if x["length"] == level]
            # The places count within what this shard had sent to the bucket.
            bucket = bucket_of(first, known[last - 1], buckets)
            order = np.argsort(bucket, kind="stable")
            begins = np.searchsorted(bucket[order], np.arange(buckets))
            at = [order[begins[x["bucket"]] + np.frombuffer(x["at"], np.int32)] for x in rows]
            which = np.concatenate([np.empty(0, np.int64), *at])
            ids = np.concatenate([np.empty(0, np.int64), *[np.frombuffer(x["ids"], np.int64) for x in rows]])
            sort = np.argsort(which)
            phrases, ids = made.take(which[sort]), ids[sort]
        made, first, last = longer(index, phrases, ids)
        return table_of(packed(shard, lang, buckets, first, known[last - 1], made.size), KEYS_ARROW)

    own = sums.where("shard IS NOT NULL").select("shard", "length", "bucket", "at", "ids")
    sides = own.repartition(n_shards, "shard").groupBy("shard").cogroup(shards.repartition(n_shards, "shard").groupBy("shard"))
    return sides.applyInArrow(extend, KEYS)


def unpacked(sums: DataFrame) -> DataFrame:
    """``(lang, id, first, last, f)``: one row per frequent key."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                arrays = [np.frombuffer(row[c], k) for c, k in (("ids", np.int64), ("first", np.int64), ("last", np.int32), ("f", np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["lang"]] * len(arrays[0]), pa.string()), *[pa.array(a.astype(np.int64)) for a in arrays]], ["lang", "id", "first", "last", "f"])

    return sums.where("shard IS NULL").select("lang", "ids", "first", "last", "f").mapInArrow(rows, "lang string, id long, first long, last long, f long")


def frequent_phrases(documents: DataFrame, least: int = 30, longest: int = 4, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, words, f)`` of all phrases of up to ``longest`` words that occur at least ``least`` times in a language,
    and ``(lang, n)``, the words of each language."""
    spark = documents.sparkSession
    make_known(spark)
    folder = shared_folder(spark, "phrases")
    shards = write_shards(documents, folder, shard_words)
    n_shards = max(1, shards.count())
    vocabulary = shards.select("shard", "lang", F.inline(F.arrays_zip("words", "counts"))).select("shard", "lang", F.col("words").alias("word"), F.col("counts").alias("n"))
    totals = shards.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    counted = vocabulary.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    known = numbered(counted, "lang", ["word"], f"{folder}/counted").select("lang", "word", "f", F.col("pos").alias("word_id"))
    known.write.parquet(f"{folder}/words")
    known = spark.read.parquet(f"{folder}/words")

    buckets = F.ceil(F.col("n") / BUCKET_WORDS).cast("int")
    small = shards.select("shard", "lang", "file").join(totals, "lang").select("shard", "lang", "file", F.greatest(buckets, F.lit(1)).alias("buckets"))
    small.write.parquet(f"{folder}/manifest")
    small = spark.read.parquet(f"{folder}/manifest")
    own = shards.select("shard", "lang", F.posexplode("words").alias("id", "word")).join(known, ["lang", "word"]).select(
        "shard", (F.col("id") + 1).alias("id"), "word_id")

    named = known.select("lang", F.col("word_id").alias("id"), F.col("word").alias("phrase"), "f")
    words = named.select("lang", F.col("id").alias("last"), F.col("phrase").alias("_word"))
    phrases, sums = named.withColumn("length", F.lit(1)), None
    for length in range(2, longest + 1):
        keys = first_level(small, own, folder, longest, n_shards) if length == 2 else next_level(sums, small, folder, length, n_shards)
        level = summed(keys, least, f"{folder}/sums-{length}").withColumn("length", F.lit(length))
        sums = level if sums is None else sums.unionByName(level)
        made = unpacked(level).join(named.select("lang", F.col("id").alias("first"), F.col("phrase").alias("_head")), ["lang", "first"]).join(words, ["lang", "last"])
        made.select("lang", "id", F.concat_ws(" ", "_head", "_word").alias("phrase"), "f").write.parquet(f"{folder}/named-{length}")
        named = spark.read.parquet(f"{folder}/named-{length}")
        phrases = phrases.unionByName(named.withColumn("length", F.lit(length)))
    return phrases.select("lang", "phrase", F.col("length").alias("words"), "f"), totals


# --- collocations --------------------------------------------------------------------------

def exact(value: Column) -> Column:
    return value.cast("decimal(19,0)")


def collocations(documents: DataFrame, least: int = 30, longest: int = 4, limit: int = 2000, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The first ``limit`` collocations of each language: ``(lang, rank, phrase, a, l, r, n, score)``.

    A phrase that occurs ``a`` times is cut where ``floor(2000000 * a / (l + r))`` is lowest, ``l`` and ``r`` being the
    counts of its parts. It is left out if a longer one that holds it occurs at least 0.8 times as often.
    """
    phrases, totals = frequent_phrases(documents, least, longest, shard_words)
    candidates = phrases.where("words > 1").withColumn("_w", F.split("phrase", " "))
    part = lambda first, size: F.array_join(F.slice("_w", first, size), " ")
    counts = phrases.select("lang", "phrase", "f")

    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "_w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("_left"), part(F.col("k") + 1, F.size("_w")).alias("_right"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("_left"), F.col("f").alias("l")), ["lang", "_left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("_right"), F.col("f").alias("r")), ["lang", "_right"])
    score = F.expr("(2000000BD * CAST(a AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_s"))

    sizes = F.sequence(F.lit(2), F.col("words") - 1)
    inner = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice("_w", i, n), " "))))
    within = candidates.where("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f")
    held = within.groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    kept = scored.join(held, ["lang", "phrase"], "left").where(
        F.col("_longer").isNull() | (exact(F.col("_longer")) * 100 < exact(F.col("a")) * 80))
    best = Window.partitionBy("lang").orderBy(F.desc("_s.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("_s.l").alias("l"), F.col("_s.r").alias("r"), "n", F.col("_s.score").alias("score"))

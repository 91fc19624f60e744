"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A signature has so many symbols of 16 bits as the similarity asks for, cut into chunks. Two signatures that differ in at
most ``distance`` slots agree in some chunk up to ``errors`` symbols (pigeonhole), so each document is filed
under every chunk with every allowed choice of ignored symbols, and every pair within the distance meets in a
bucket. Inside buckets signatures are compared, and the documents found close form coarse clusters; links are
confirmed on full shingle sets inside these. Tasks emit spanning forests, never all pairs, and documents with equal
sets are represented by one of them. Large buckets and clusters are cut into blocks that meet in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import connected_components
from ..session import cut_lineage
from .common import prepare, shared_folder, words_of

WIDTH = 5
CHUNK_SLOTS = 4


@dataclass(frozen=True)
class Layout:
    """Length of signatures and the distance up to which they meet."""

    slots: int
    distance: int

    @property
    def errors(self) -> int:
        """Symbols of a chunk that may differ."""
        return self.distance // (self.slots // CHUNK_SLOTS)

    def agreeing(self) -> list[list[int]]:
        """For each key, the slots that have to agree."""
        return [
            [first + i for i in range(CHUNK_SLOTS) if i not in ignored]
            for first in range(0, self.slots, CHUNK_SLOTS) for ignored in combinations(range(CHUNK_SLOTS), self.errors)
        ]


#: At a similarity of 0.85 more slots differ in about one pair of 70 000.
CLOSE = Layout(28, 13)
#: At a similarity of 0.80 more slots differ in about one pair of 118 000.
WIDE = Layout(44, 21)


def layout_of(percent: int) -> Layout:
    """The shortest signature that is laid out for a similarity."""
    return CLOSE if percent >= 85 else WIDE


#: Rows of a block of a bucket, and of a cluster.
BUCKET_BLOCK, CLUSTER_BLOCK = 2048, 512
#: Tables of at most so many rows of three numbers are sent to every task; larger ones are shuffled.
BROADCAST_ROWS = 500_000
#: Words whose hashes a worker remembers.
REMEMBERED = 600_000

SIGNED = "doc_id long, n_shingles long, digest_a long, digest_b long, signature binary, keys array<long>"
_SIGNED = pa.schema([
    ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest_a", pa.int64()), ("digest_b", pa.int64()),
    ("signature", pa.binary()), ("keys", pa.list_(pa.int64())),
])
_LINK = pa.schema([("source", pa.int64()), ("target", pa.int64())])


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _word_hashes() -> dict[bytes, int]:
    return {}


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of a shorter text, the hash of its whole sequence."""
    words = words_of(text) if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    known = _word_hashes()
    found = list(map(known.get, words))
    if None in found:
        if len(known) > REMEMBERED:
            known.clear()
        for i, word in enumerate(words):
            if found[i] is None:
                found[i] = known[word] = xxhash.xxh64_intdigest(word)
    h = np.array(found, dtype=np.uint64)
    n = min(width, len(h))
    with np.errstate(over="ignore"):
        rolled = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            rolled = mix(rolled) * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return np.unique(mix(rolled))


_FACTORS = mix(np.arange(1, WIDE.slots + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = mix(np.arange(101, WIDE.slots + 101, dtype=np.uint64))


def signature(hashes: np.ndarray, slots: int) -> np.ndarray:
    """16 bits of the smallest of the hashes under each of the linear maps; the hashes are scrambled already."""
    out = np.empty(slots, dtype=np.uint16)
    for slot in range(slots):
        out[slot] = int((hashes * _FACTORS[slot] + _SHIFTS[slot]).min()) >> 20 & 0xFFFF
    return out


def bucket_keys(signatures: np.ndarray, layout: Layout) -> np.ndarray:
    """One key per row of signatures and choice of agreeing slots; equal keys of two documents mean equal slots."""
    with np.errstate(over="ignore"):
        out = []
        for number, slots in enumerate(layout.agreeing()):
            key = np.full(len(signatures), number + 1, dtype=np.uint64)
            for slot in slots:
                key = mix(key) + signatures[:, slot].astype(np.uint64)
            out.append(mix(key))
    return np.stack(out, axis=1).view(np.int64)


def sign(documents: DataFrame, layout: Layout, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: size and digest of its shingle set, its signature and bucket keys (none for empty sets)."""
    prepare(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = shingles(body)
                if not len(found):
                    rows.append((key, 0, 0, 0, None, None))
                    continue
                digest = xxhash.xxh3_128_intdigest(found.tobytes())
                a, b = np.array([digest >> 64, digest & (1 << 64) - 1], dtype=np.uint64).view(np.int64).tolist()
                rows.append((key, len(found), a, b, signature(found, layout.slots), None))
            signed = [i for i, r in enumerate(rows) if r[4] is not None]
            if signed:
                for i, keys in zip(signed, bucket_keys(np.stack([rows[i][4] for i in signed]), layout)):
                    rows[i] = (*rows[i][:4], rows[i][4].tobytes(), keys.tolist())
            yield _batch(rows, _SIGNED)

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, SIGNED)


def close_pairs(buckets: np.ndarray, signatures: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of one bucket within the distance; ``buckets`` is sorted."""
    left, right = [], []
    rows, lag = np.arange(len(buckets)), 1
    while len(rows):
        rows = rows[rows + lag < len(buckets)]
        rows = rows[buckets[rows] == buckets[rows + lag]]
        near = np.count_nonzero(signatures[rows] != signatures[rows + lag], axis=1) <= distance
        left.append(rows[near])
        right.append(rows[near] + lag)
        lag += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n nodes, the smallest node of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def coarse_links(signed: DataFrame, layout: Layout) -> DataFrame:
    """Spanning links ``(source, target)`` of the documents whose signatures are within the distance.

    ``signed(doc_id, signature, keys)``: one row per different set.
    """
    filed = signed.select("doc_id", "signature", F.explode("keys").alias("bucket"))
    hot = cut_lineage(filed.groupBy("bucket").agg(F.count("*").alias("_n")).where(F.col("_n") > BUCKET_BLOCK))
    blocks = F.ceil(F.col("_n") / BUCKET_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    other = F.explode(F.when(F.col("_n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1)))
    few = hot.count() <= BROADCAST_ROWS
    dealt = filed.join(F.broadcast(hot) if few else hot, "bucket", "left").withColumn("_own", F.coalesce(own, F.lit(0))).withColumn("_other", other)
    pair = F.xxhash64("bucket", F.least("_own", "_other"), F.greatest("_own", "_other"))
    rows = dealt.select(F.when(F.col("_n").isNull(), F.col("bucket")).otherwise(pair).alias("bucket"), "doc_id", "signature")
    prepare(signed.sparkSession, 20_000)
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "doc_id")

    def link(buckets: np.ndarray, docs: np.ndarray, signatures: np.ndarray) -> pa.RecordBatch:
        root = forest(len(docs), *close_pairs(buckets, signatures, layout.distance))
        moved = np.flatnonzero(root != np.arange(len(docs)))
        links = np.unique(np.stack([docs[root[moved]], docs[moved]], axis=1), axis=0) if len(moved) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0], pa.int64()), pa.array(links[:, 1], pa.int64())], schema=_LINK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, layout.slots), np.uint16))
        for batch in batches:
            if not batch.num_rows:
                continue
            new = (
                batch.column("bucket").to_numpy(), batch.column("doc_id").to_numpy(),
                np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint16).reshape(-1, layout.slots),
            )
            held = tuple(np.concatenate(both) for both in zip(held, new))
            whole = int(np.searchsorted(held[0], held[0][-1], side="left"))  # the last bucket may go on
            if whole:
                yield link(*(part[:whole] for part in held))
                held = tuple(part[whole:] for part in held)
        if len(held[0]):
            yield link(*held)

    return rows.mapInArrow(run, "source long, target long").distinct()


def exact_links(groups: DataFrame, percent: int = 85) -> DataFrame:
    """Spanning links of the documents of each ``group`` whose sets reach the similarity.

    ``groups(group, doc_id, shingles binary, probe boolean)``: only pairs with a probe among them are compared. Groups
    are bounded by the caller.
    """
    rows = groups.repartition("group").sortWithinPartitions("group", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, docs, sets, probes = None, [], [], []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for group, doc, data, probe in zip(*(batch.column(c).to_pylist() for c in ("group", "doc_id", "shingles", "probe"))):
                if group != current:
                    out += linked(docs, sets, probes, percent)
                    current, docs, sets, probes = group, [], [], []
                docs.append(doc)
                sets.append(np.frombuffer(data, dtype=np.uint64))
                probes.append(probe)
            yield _batch(out, _LINK)
        yield _batch(linked(docs, sets, probes, percent), _LINK)

    return rows.mapInArrow(run, "source long, target long").distinct()


def linked(docs: list[int], sets: list[np.ndarray], probes: list[bool], percent: int) -> list[tuple[int, int]]:
    """Links from the first document of each component of one group to its others."""
    if len(docs) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(docs)), sizes)
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(term, kind="stable")
    by_term, start = owner[order], np.concatenate([[0], np.cumsum(np.bincount(term))])
    ends = np.cumsum(sizes)
    left, right = [], []
    for i in np.flatnonzero(probes):
        mine = term[ends[i] - sizes[i] : ends[i]]
        width = start[mine + 1] - start[mine]
        at = np.repeat(start[mine] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        common = np.bincount(by_term[at], minlength=len(docs))
        near = np.flatnonzero(100 * common >= percent * (sizes + sizes[i] - common))
        near = near[(near != i) & (common[near] > 0)]
        left.append(np.full(len(near), i))
        right.append(near)
    if not left:
        return []
    root = forest(len(docs), np.concatenate(left), np.concatenate(right))
    return [(docs[root[i]], docs[i]) for i in np.flatnonzero(root != np.arange(len(docs))) if docs[root[i]] != docs[i]]


def with_sets(documents: DataFrame, members: DataFrame, rows: int, doc_id: str, text: str) -> DataFrame:
    """``members`` (doc_id and further columns) with the shingle set of each, from the texts."""
    prepare(documents.sparkSession)
    texts = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    joined = texts.join(F.broadcast(members) if rows <= BROADCAST_ROWS else members, "doc_id")

    @F.arrow_udf("binary")
    def run(bodies: pa.Array) -> pa.Array:
        return pa.array([shingles(b).tobytes() for b in bodies.to_pylist()], pa.binary())

    return joined.withColumn("shingles", run("text")).drop("text")


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row.

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets of ``WIDTH``-word shingles; signatures
    and distance follow from that and are laid out for 80 percent and more. Texts without words (and null texts) are linked with nothing.
    ``component_id`` is the smallest id reachable. Rows with the same id count as one document; a row without an
    id has neither component nor verdict. Other columns are ignored.
    """
    spark = documents.sparkSession
    folder = shared_folder(spark, "signatures")
    layout = layout_of(percent)
    sign(documents, layout, doc_id, text).write.option("compression", "zstd").parquet(folder)
    signed = spark.read.schema(SIGNED).parquet(folder)
    real = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    digest = ["digest_a", "digest_b"]
    classes = cut_lineage(real.groupBy(*digest).agg(F.min("doc_id").alias("first")))
    firsts = real.join(classes, digest).where(F.col("doc_id") == F.col("first")).dropDuplicates(["doc_id", *digest])
    coarse = cut_lineage(connected_components(coarse_links(firsts, layout)))
    sizes = coarse.groupBy("component").agg(F.count("*").alias("n"))
    placed = cut_lineage(coarse.join(sizes, "component").select(
        F.col("node").alias("doc_id"), "component", F.ceil(F.col("n") / CLUSTER_BLOCK).cast("int").alias("blocks")
    ).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")))
    n_placed = placed.count()
    # Each block is compared in itself and with the first document of its cluster.
    everywhere = F.explode(F.when(F.col("doc_id") == F.col("component"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block")))
    sets = with_sets(documents, placed.withColumn("block", everywhere), n_placed * 2, doc_id, text)
    links = cut_lineage(exact_links(sets.select(
        F.xxhash64("component", "block").alias("group"), "doc_id", "shingles", F.lit(True).alias("probe")
    ), percent))
    large = placed.where("blocks > 1")
    if large.head(1):
        found = cut_lineage(connected_components(links.unionByName(
            large.select(F.col("doc_id").alias("source"), F.col("doc_id").alias("target")))))
        head = found.select(F.col("node").alias("component"), F.col("component").alias("_head"))
        state = large.join(found.select(F.col("node").alias("doc_id"), F.col("component").alias("_own")), "doc_id").join(head, "component")
        # Documents not yet with the first one meet all documents of the other blocks.
        state = cut_lineage(state.withColumn("probe", F.col("_own") != F.col("_head")))
        asking = state.where("probe").select("component", F.col("block").alias("_asks")).distinct()
        others = state.withColumn("probe", F.lit(False)).join(asking, "component").where("_asks != block").select(
            "component", "doc_id", "probe", "_asks", F.col("block").alias("_asked"))
        askers = state.where("probe").withColumn("_asked", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("_asked != block").select(
            "component", "doc_id", "probe", F.col("block").alias("_asks"), "_asked")
        members = cut_lineage(askers.unionByName(others))
        crossed = with_sets(documents, members, members.count(), doc_id, text)
        links = links.unionByName(cut_lineage(exact_links(crossed.select(
            F.xxhash64("component", "_asks", "_asked").alias("group"), "doc_id", "shingles", "probe"
        ), percent)))
    # Documents of one id with different sets are one node, as are those of one set.
    components = connected_components(links)
    named = classes.join(components.select(F.col("node").alias("first"), "component"), "first", "left")
    labels = real.select("doc_id", *digest).distinct().join(named, digest).select(
        "doc_id", F.coalesce("component", "first").alias("component")
    )
    labels = labels.groupBy("doc_id").agg(F.min("component").alias("component"))
    result = signed.select("doc_id", "n_shingles").join(labels, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return result.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

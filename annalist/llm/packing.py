"""Lexical retrieval packing: windows filled with a seed document and its nearest unused neighbours by BM25.

Documents become token ids once. Whole windows of a long document are sequences of their own; its rest and all
shorter documents are indexed. The index is sharded: documents are dealt out in the order of a hash signature of
their token pairs (copies lie together, and the id settles the rest, so a group of copies of any size is split
evenly), and each block of ``shard_docs`` documents is one inverted index. Token statistics cover all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import prepare, shared_folder
from .subwords import coder, id_type, pieces_of

#: Parameters of BM25.
K1, B = 1.2, 0.75

TOKENS = "doc_id long, n_ids long, signature long, full_crcs array<long>, rest binary, is_total boolean, frequencies array<int>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_TOKENS = pa.schema([
    ("doc_id", pa.int64()), ("n_ids", pa.int64()), ("signature", pa.int64()), ("full_crcs", pa.list_(pa.int64())),
    ("rest", pa.binary()), ("is_total", pa.bool_()), ("frequencies", pa.list_(pa.int32())),
])
_PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def crc(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def signature(ids: np.ndarray) -> int:
    """Smallest hash of the pairs of neighbouring ids: equal for copies, likely equal for near copies."""
    pairs = ids[:-1].astype(np.uint64) << np.uint64(32) | ids[1:].astype(np.uint64) if len(ids) > 1 else ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (pairs ^ (pairs >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return int((mixed ^ (mixed >> np.uint64(32))).min() >> np.uint64(1))


def tokenize(documents: DataFrame, tokenizer: str, window: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document, and one row of token statistics per task (``is_total``)."""
    prepare(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer)
        frequencies = np.zeros(max(code.size, end_id + 1), dtype=np.int32)
        end = np.array([end_id], dtype=code.dtype)
        total = 0
        for batch in batches:
            rows = []
            bodies = code.encode(batch.column("text").to_pylist())
            for key, body in zip(batch.column("doc_id").to_pylist(), bodies):
                ids = np.concatenate([body, end])
                total += len(ids)
                frequencies[np.unique(ids)] += 1
                cut = len(ids) - len(ids) % window
                crcs = [crc(ids[i : i + window]) for i in range(0, cut, window)]
                rows.append((key, len(ids), signature(ids), crcs, ids[cut:].tobytes(), False, None))
            yield _table(rows, _TOKENS)
        yield _table([(None, total, 0, None, None, True, frequencies.tolist())], _TOKENS)

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, TOKENS)


@dataclass
class Corpus:
    """Inverse document frequencies by token id (none for tokens in most documents), and the mean length."""

    idf: np.ndarray
    mean_length: float


def corpus_statistics(tokens: DataFrame, n_documents: int, size: int) -> Corpus:
    """Statistics of all documents; the table that reaches the driver has one row per token of the vocabulary."""
    totals = tokens.where("is_total")
    length = totals.agg(F.sum("n_ids")).first()[0] or 0
    counts = totals.select(F.posexplode("frequencies").alias("id", "n")).where("n > 0").groupBy("id").agg(F.sum("n").alias("n"))
    frequency = np.zeros(size)
    found = counts.toPandas()
    frequency[found["id"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.float64)
    idf = np.log((n_documents - frequency + 0.5) / (frequency + 0.5))
    return Corpus(np.maximum(np.where(frequency > 0, idf, 0.0), 0.0), length / max(1, n_documents))


def pack(
    documents: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, shard_docs: int = 1024, min_piece: int = 16,
    doc_id: str = "doc_id", text: str = "text", partition_tokens: int = 4_000_000,
) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``: one row per piece of a document.

    A document is its token ids and ``end_id`` (null and empty texts: that id alone). A neighbour that does not fit
    is passed over; the last gap of a window, if it has ``min_piece`` places or more, takes the beginning of the
    best neighbour left, whose remainder stays in the index. What a shard has left for its last window is cut into
    sequences whose lengths are powers of two. Repeated rows are documents of their own; other columns are ignored.
    """
    spark = documents.sparkSession
    folder = shared_folder(spark, "packing")
    tokenize(documents, tokenizer, window, end_id, doc_id, text).write.option("compression", "zstd").parquet(folder)
    tokens = spark.read.schema(TOKENS).parquet(folder)
    rows = tokens.where("NOT is_total").drop("is_total", "frequencies")
    n = rows.count()
    size = max(len(pieces_of(tokenizer)), end_id + 1)
    corpus = corpus_statistics(tokens, n, size)
    parts = max(1, min(n, -(-int(corpus.mean_length * n) // partition_tokens)))
    shards = rows.repartitionByRange(parts, "signature", "doc_id").sortWithinPartitions("signature", "doc_id", "n_ids")
    dtype = id_type(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = _Numbers(TaskContext.get().partitionId() << 40)
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_ids", "full_crcs", "rest")))
            while len(held) >= shard_docs:
                block, held = held[:shard_docs], held[shard_docs:]
                yield _table(pack_block(block, corpus, dtype, window, min_piece, sequences), _PIECES)
        if held:
            yield _table(pack_block(held, corpus, dtype, window, min_piece, sequences), _PIECES)

    return shards.mapInArrow(run, PIECES)


class _Numbers:
    def __init__(self, first: int) -> None:
        self.next = first

    def take(self) -> int:
        self.next += 1
        return self.next - 1


class ShardIndex:
    """Postings of one shard, by token: documents and their BM25 weights."""

    def __init__(self, texts: list[np.ndarray], corpus: Corpus) -> None:
        self.n = len(texts)
        self.terms: list[np.ndarray] = []
        weights = []
        for ids in texts:
            terms, counts = np.unique(ids, return_counts=True)
            idf = corpus.idf[terms]
            terms, counts, idf = terms[idf > 0], counts[idf > 0], idf[idf > 0]
            self.terms.append(terms)
            weights.append(idf * counts * (K1 + 1) / (counts + K1 * (1 - B + B * len(ids) / max(corpus.mean_length, 1.0))))
        term = np.concatenate(self.terms) if self.terms else np.zeros(0, np.int64)
        order = np.argsort(term, kind="stable")
        self.weights = np.concatenate(weights)[order] if weights else np.zeros(0)
        self.docs = np.repeat(np.arange(self.n), [len(t) for t in self.terms])[order]
        self.starts = np.searchsorted(term[order], np.arange(len(corpus.idf) + 1))

    def scores(self, doc: int) -> np.ndarray:
        """BM25 score of every document of the shard for the terms of one of them."""
        terms = self.terms[doc].astype(np.int64)
        first, size = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(terms) else np.zeros(0, np.int64)
        return np.bincount(self.docs[at], weights=self.weights[at], minlength=self.n).astype(np.float64)


def pack_block(rows: list[tuple], corpus: Corpus, dtype: np.dtype, window: int, min_piece: int, sequences: _Numbers) -> list[tuple]:
    """Pieces of one shard. Rows are ``(doc_id, n_ids, crcs of whole windows, ids of the rest)``."""
    pieces: list[tuple] = []
    rests, owners = [], []
    for doc, n_ids, crcs, rest in rows:
        for i, value in enumerate(crcs):
            pieces.append((doc, i * window, window, value, n_ids, sequences.take(), 0))
        ids = np.frombuffer(rest, dtype=dtype)
        if len(ids):
            rests.append(ids)
            owners.append((doc, n_ids, len(crcs) * window))
    index = ShardIndex(rests, corpus)
    length = np.array([len(r) for r in rests], dtype=np.int64)
    used = np.zeros(len(rests), dtype=np.int64)  # ids of each document that have a place

    def place(doc: int, n: int, sequence: int, offset: int) -> None:
        ids = rests[doc][used[doc] : used[doc] + n]
        name, n_ids, base = owners[doc]
        pieces.append((name, base + int(used[doc]), n, crc(ids), n_ids, sequence, offset))
        used[doc] += n

    for seed in np.argsort(-length, kind="stable"):
        left = length - used
        if not left[seed]:
            continue
        if left.sum() < window:
            break
        ranked = _ranking(index.scores(seed), left, seed)
        room, sequence = window, sequences.take()
        while True:
            ranked = ranked[used[ranked] < length[ranked]]
            left = length[ranked] - used[ranked]
            fits = np.flatnonzero(left <= room)
            if not len(ranked) or not room:
                break
            if len(fits):
                doc, n = int(ranked[fits[0]]), int(left[fits[0]])
            elif room >= min_piece:
                doc, n = int(ranked[0]), room
            else:
                break
            place(doc, n, sequence, window - room)
            room -= n
    _last_window(length, used, place, sequences)
    return pieces


def _ranking(scores: np.ndarray, left: np.ndarray, seed: int) -> np.ndarray:
    """Unused documents: the seed, then by falling score; those without a common term come last, longest first."""
    scores = scores.copy()
    scores[seed] = np.inf
    order = np.lexsort((np.arange(len(scores)), np.where(scores > 0, 0, -left), -scores))
    return order[left[order] > 0]


def _last_window(length: np.ndarray, used: np.ndarray, place, sequences: _Numbers) -> None:
    """What is left, less than a window, in sequences whose lengths are powers of two."""
    total = int((length - used).sum())
    docs = iter(np.flatnonzero(used < length).tolist())
    doc = next(docs, None)
    while total:
        room = size = 1 << (total.bit_length() - 1)
        sequence = sequences.take()
        while room:
            if used[doc] == length[doc]:
                doc = next(docs)
            n = int(min(room, length[doc] - used[doc]))
            place(doc, n, sequence, size - room)
            room -= n
        total -= size


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

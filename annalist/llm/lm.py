"""Language-model scores of texts: smoothed word counts as a base, and a causal self-attention model on subword ids.

Word counts cover all training documents. The most frequent words, a bounded number, are looked up in every task; only
the rest of a document's words is joined with the counts. The attention model predicts the class of the next subword, and
a subword has its share of the counts of its class. Its tables of neighbouring classes are counted, and its weights
trained, on all training documents: shards are trained in numpy in parallel, and parameters averaged after each round. Long
texts are cut into overlapping windows, in which each subword is scored once, with masked attention over a batch of windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import prepare, shared_folder
from .subwords import coder, id_type, pieces_of

#: Frequent words that every task knows, at most.
FREQUENT = 100_000
#: Words that a task gathers before it counts them and hands the counts on, and words encoded in one string.
COUNTED, STRING_WORDS = 4_000_000, 500
#: Steps of the attention model, at least (small tables are passed several times), and windows of each of its steps.
STEPS, STEP_WINDOWS = 400, 96
#: Windows that a task trains on between two averages, about, and averages of one pass, at most.
SHARD_WINDOWS, ROUNDS = 9600, 8
#: Windows of a row of class streams: longer texts are dealt out in pieces.
PIECE_WINDOWS = 64
#: Classes of subwords lie in groups; half of the groups hold subwords that begin a word. In either half all classes but
#: those of the last group hold one frequent subword each, the last group the others by their letters, and the end.
GROUPS, MEMBERS = 32, 32
CLASSES = GROUPS * MEMBERS
#: Width of the model and of its hidden layer; window and overlap.
WIDTH, HIDDEN, WINDOW, OVERLAP = 16, 32, 64, 16
SMOOTHING = 0.1


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in one row, as ``words_of`` gives them, and where those of each text end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # blanks at either end leave an empty one
    offsets = lists.offsets.to_numpy()
    ends = np.append(0, np.cumsum(real, dtype=np.int64))[offsets[1:] - offsets[0]]
    return words.filter(pa.array(real, pa.bool_())).cast(pa.binary()), ends


def word_counts(documents: DataFrame) -> DataFrame:
    """``(word binary, c)`` over ``documents(text)``; texts are split where they lie and counted before the shuffle."""
    prepare(documents.sparkSession)
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def counted(held: list[pa.Array]) -> pa.RecordBatch:
        found = pa.chunked_array(held, pa.binary()).combine_chunks().value_counts()
        return pa.RecordBatch.from_arrays([found.field(0), found.field(1)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        for batch in batches:
            held.append(split_words(batch.column("text"))[0])
            if sum(map(len, held)) > COUNTED:
                yield counted(held)
                held = []
        yield counted(held)

    return documents.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def model_text(words: list[bytes]) -> str:
    """What the attention model reads: the words, each after a blank."""
    return (b" " + b" ".join(words)).decode("utf-8", "surrogatepass") if words else ""


def encode_words(words: list[bytes], tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of words, each by itself, in one row, and how many each word has.

    Many words are encoded in one string: no piece crosses the blank before a word. Words that hold other blanks go alone.
    """
    code, starts = coder(tokenizer), begins_of(tokenizer)
    texts = []
    for at in range(0, len(words), STRING_WORDS):
        some = words[at : at + STRING_WORDS]
        text = model_text(some)
        texts += [text] if len(text.split()) == len(some) else [model_text([w]) for w in some]
    if not texts:
        return np.zeros(0, dtype=code.dtype), np.zeros(0, dtype=np.int64)
    ids = np.concatenate(code.encode(texts))
    first = np.flatnonzero(starts[ids])
    if len(first) != len(words) or first[0] != 0:
        raise ValueError("a word without a beginning")
    return ids, np.diff(first, append=len(ids))


@lru_cache(maxsize=2)
def begins_of(tokenizer: str) -> np.ndarray:
    """Whether a subword id, or the end after the last id, begins a word."""
    return np.array([p.startswith("Ġ") for p in pieces_of(tokenizer)] + [True])


def subword_counts(words: DataFrame, tokenizer: str) -> np.ndarray:
    """Counts of subword ids over all training documents, from the word counts; one row per id reaches the driver."""
    prepare(words.sparkSession, 10_000)
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pieces_of(tokenizer)), dtype=np.int64)
        for batch in batches:
            ids, lengths = encode_words(batch.column("word").to_pylist(), tokenizer)
            weights = np.repeat(batch.column("c").to_numpy(), lengths)
            total += np.bincount(ids, weights=weights, minlength=len(total)).astype(np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], schema=schema)

    rows = words.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(pieces_of(tokenizer)), dtype=np.float64)
    counts[rows["id"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.float64)
    return counts


@lru_cache(maxsize=1)
def _lexicon(frequent: tuple[bytes, ...], tokenizer: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The frequent words, their subword ids in one row, and how many each has; once per worker."""
    return pa.array(frequent, pa.binary()), *encode_words(list(frequent), tokenizer)


_ENCODED = pa.schema([
    ("doc_id", pa.int64()), ("key", pa.int64()), ("n_ids", pa.int64()), ("words", pa.binary()), ("rare", pa.list_(pa.binary())), ("rare_ids", pa.binary()),
])
ENCODED = "doc_id long, key long, n_ids long, words binary, rare array<binary>, rare_ids binary"


def encode_documents(documents: DataFrame, tokenizer: str, frequent: tuple[bytes, ...] = ()) -> DataFrame:
    """``(doc_id, key, n_ids, words, rare, rare_ids)`` of ``documents(doc_id, text)``, written once for training and scoring.

    ``words``: the place of each word in ``frequent``, four bytes, -1 for the words listed in ``rare``, whose subword ids
    follow each other in ``rare_ids``. ``n_ids`` counts the ids of all words. Frequent words are looked up; of the others,
    each distinct one is encoded once a batch.
    """
    spark = documents.sparkSession
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, _, known_lengths = _lexicon(frequent, tokenizer)
        for batch in batches:
            words, ends = split_words(batch.column("text"))
            place = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy().astype(np.int32)
            others = np.flatnonzero(place < 0)
            rare = words.take(pa.array(others))
            distinct = rare.dictionary_encode()
            ids, lengths = encode_words(distinct.dictionary.to_pylist(), tokenizer)
            spot = distinct.indices.to_numpy()
            size = np.append(known_lengths, 0)[place]
            size[others] = lengths[spot]
            rare_ends = np.append(0, np.searchsorted(others, ends))
            id_ends = np.append(0, np.cumsum(lengths[spot]))[rare_ends[1:]]
            cut = lambda row, ends: pa.array([row[a:b].tobytes() for a, b in zip([0, *ends.tolist()], ends.tolist())], pa.binary())
            columns = [
                batch.column("doc_id"), batch.column("key"), pa.array(np.diff(np.append(0, np.cumsum(size))[ends], prepend=0), pa.int64()),
                cut(place, ends), pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), rare), cut(_gather(ids, lengths, spot), id_ends),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_ENCODED)

    folder = shared_folder(spark, "encoded")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), "text")
    rows.mapInArrow(run, ENCODED).write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(ENCODED).parquet(folder)


def _gather(ids: np.ndarray, lengths: np.ndarray, spot: np.ndarray) -> np.ndarray:
    """The ids of the words at the given spots, in one row."""
    size = lengths[spot]
    ends = np.cumsum(size)
    return ids[np.repeat((np.cumsum(lengths) - lengths)[spot] - ends + size, size) + np.arange(size.sum())]


def ids_of(batch: pa.RecordBatch, frequent: tuple[bytes, ...], tokenizer: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each encoded document, its subword ids and the places of its words."""
    _, known_ids, known_lengths = _lexicon(frequent, tokenizer)
    places = [np.frombuffer(x, dtype=np.int32) for x in batch.column("words").to_pylist()]
    ids = np.frombuffer(b"".join(batch.column("rare_ids").to_pylist()), dtype=id_type(tokenizer))
    lengths = np.diff(np.flatnonzero(begins_of(tokenizer)[ids]), append=len(ids))
    spot = np.concatenate(places).astype(np.int64) if places else np.zeros(0, dtype=np.int64)
    spot[spot < 0] = len(known_lengths) + np.arange(len(lengths))
    ids = _gather(np.concatenate([known_ids, ids]), np.concatenate([known_lengths, lengths]), spot)
    return np.split(ids, np.cumsum(batch.column("n_ids").to_numpy())[:-1]), places


@dataclass
class Classes:
    """The class of each subword id (the last id is the end of a text), its log share of its class, and whether it
    begins a word; the end does.
    """

    of: np.ndarray
    log_share: np.ndarray
    begins: np.ndarray

    @property
    def end(self) -> int:
        return len(self.of) - 1


def make_classes(counts: np.ndarray, pieces: list[str]) -> Classes:
    """Classes of the ids of a byte-level vocabulary, by their counts."""
    begins = np.array([p.startswith("Ġ") for p in pieces] + [True])
    of = np.empty(len(counts) + 1, dtype=np.int64)
    half = CLASSES // 2
    for kind, base in ((True, 0), (False, half)):
        last = base + half - MEMBERS
        mine = np.flatnonzero(begins[:-1] == kind)
        for i in mine:
            of[i] = last + ord(pieces[i].lstrip("Ġ").lower()[:1] or " ") % (MEMBERS - 1)
        frequent = mine[np.argsort(-counts[mine], kind="stable")][: half - MEMBERS]
        of[frequent] = base + np.arange(len(frequent))
    of[-1] = half - 1
    smoothed = np.append(counts + SMOOTHING, 1.0)
    totals = np.bincount(of, weights=smoothed, minlength=CLASSES)
    return Classes(of, np.log(smoothed / totals[of]), begins)


@lru_cache(maxsize=None)
def _mask(n: int, first: int) -> np.ndarray:
    """Added to scores: no position attends to later ones."""
    later = np.arange(n)[None, :] > np.arange(first, n)[:, None]
    return np.where(later, np.float32(-1e9), np.float32(0)).astype(np.float32)


#: Windows whose weights of attention are worked on at a time.
CACHED_WINDOWS = 32
#: Scores of attention are cut here, so that their exponentials stay finite.
LARGEST = np.float32(40)
#: Parts of the model that are trained.
TRAINED = ("e", "p", "q", "k", "v", "o", "h", "g", "u", "m")


@dataclass
class Attention:
    """One block of causal self-attention with a residual and a hidden layer.

    ``u`` leads to groups and ``m`` to the members of each group; ``bu`` and ``bm`` are added by the class before.
    """

    e: np.ndarray
    p: np.ndarray
    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    o: np.ndarray
    h: np.ndarray
    g: np.ndarray
    u: np.ndarray
    m: np.ndarray
    bu: np.ndarray
    bm: np.ndarray

    @classmethod
    def fresh(cls, pairs: np.ndarray, seed: int = 11) -> Attention:
        """Random weights, and tables from counts of neighbouring classes."""
        random = np.random.default_rng(seed)
        w = lambda *shape: (random.standard_normal(shape) / np.sqrt(WIDTH)).astype(np.float32)
        share = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 0.5 * CLASSES)
        joint = ((pairs + 20 * share) / (pairs.sum(axis=1, keepdims=True) + 20)).reshape(CLASSES, GROUPS, MEMBERS)
        return cls(w(CLASSES, WIDTH) * 3, w(WINDOW, WIDTH), w(WIDTH, WIDTH), w(WIDTH, WIDTH), w(WIDTH, WIDTH), w(WIDTH, WIDTH) * 0.5,
                   w(WIDTH, HIDDEN), w(HIDDEN, WIDTH) * 0.5, w(WIDTH, GROUPS) * 0.1, w(GROUPS, WIDTH, MEMBERS) * 0.1,
                   np.log(joint.sum(axis=2)).astype(np.float32), np.log(joint).astype(np.float32))

    def attend(self, a: np.ndarray, first: int, keep: bool = False) -> tuple:
        """What the positions from ``first`` on gather from those up to themselves; ``a``: one window per row.

        The values end in a one, so that a product with the weights gives their sum, too. Queries are taken in two halves,
        the first of which meets no later keys, and few windows at a time, whose weights stay in the cache.
        """
        n, t, _ = a.shape
        qkv = np.ones((n, t, 3 * WIDTH + 1), dtype=a.dtype)
        into = np.concatenate([self.q * a.dtype.type(1 / np.sqrt(WIDTH)), self.k, self.v], axis=1)
        np.matmul(a.reshape(-1, WIDTH), into, out=qkv.reshape(-1, 3 * WIDTH + 1)[:, : 3 * WIDTH])
        q, k, v = qkv[:, first:, :WIDTH], qkv[..., WIDTH : 2 * WIDTH], qkv[..., 2 * WIDTH :]
        large = np.einsum("nti,nti->nt", q, q).max() * np.einsum("nti,nti->nt", k, k).max() > LARGEST**2
        sums, kept = np.empty((n, t - first, WIDTH + 1), dtype=a.dtype), []
        middle = (first + t) // 2
        for low, high in ((first, middle), (middle, t)):
            at = slice(low - first, high - first)
            for some in (slice(i, i + CACHED_WINDOWS) for i in range(0, n, CACHED_WINDOWS) if low < high):
                s = q[some, at] @ k[some, :high].transpose(0, 2, 1)
                if large:
                    np.minimum(s, LARGEST, out=s)
                s += _mask(high, low)
                np.exp(s, out=s)
                np.matmul(s, v[some, :high], out=sums[some, at])
                if keep:
                    kept.append((some, low, high, s))
        inverse = 1 / sums[..., WIDTH:]
        return into, q, k, v, kept, inverse, sums[..., :WIDTH] * inverse

    def gradients(self, x: np.ndarray, target: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the real positions, and its gradients."""
        n, t = x.shape
        before, wanted = x.ravel(), target.ravel()
        rows = np.arange(len(before))
        weight = (real.ravel() / max(1, real.sum())).astype(self.e.dtype)
        a = np.take(self.e, x, axis=0)
        a += self.p[:t]
        into, q, k, v, kept, inverse, c = self.attend(a, 0, keep=True)
        a, c = a.reshape(-1, WIDTH), c.reshape(-1, WIDTH)
        r = a + c @ self.o
        z = r @ self.h
        np.maximum(z, 0, out=z)
        y = r + z @ self.g

        def choice(logits: np.ndarray, hit: np.ndarray, weight: np.ndarray) -> float:
            """The loss; the logits become its gradient."""
            _exponentials(logits)
            total = logits @ np.ones(logits.shape[1], dtype=logits.dtype)
            flat, hit = logits.reshape(-1), rows * logits.shape[1] + hit
            loss = -float(np.log(flat[hit] / total + 1e-12) @ weight)
            logits *= (weight / total)[:, None]
            flat[hit] -= weight
            return loss

        group, member = wanted // MEMBERS, wanted % MEMBERS
        d = y @ self.u
        d += np.take(self.bu, before, axis=0)
        loss = choice(d, group, weight)
        out = {"u": y.T @ d, "m": np.empty_like(self.m)}
        dy = d @ self.u.T
        # Members: rows in the order of their groups, so that a group is one product.
        order, edges = _by_group(group)
        y = np.take(y, order, axis=0)
        d = np.take(self.bm.reshape(-1, MEMBERS), (before * GROUPS + group)[order], axis=0)
        for i, part in enumerate(edges):
            d[part] += y[part] @ self.m[i]
        loss += choice(d, member[order], weight[order])
        more = np.empty_like(dy)
        for i, part in enumerate(edges):
            np.matmul(y[part].T, d[part], out=out["m"][i])
            np.matmul(d[part], self.m[i].T, out=more[part])
        dy[order] += more
        out["g"] = z.T @ dy
        dz = dy @ self.g.T
        dz *= z > 0
        out["h"] = r.T @ dz
        dr = dy + dz @ self.h.T
        out["o"] = c.T @ dr
        # Attention: the gradient of a weight is its product with the value, less the mean of these products.
        dc = np.empty((n, t, WIDTH + 1), dtype=a.dtype)
        np.multiply((dr @ self.o.T).reshape(n, t, WIDTH), inverse, out=dc[..., :WIDTH])
        np.negative(np.einsum("nti,nti->nt", dc[..., :WIDTH], c.reshape(n, t, WIDTH)), out=dc[..., WIDTH])
        dqkv = np.zeros((n, t, 3 * WIDTH), dtype=a.dtype)
        dq, dk, dv = dqkv[..., :WIDTH], dqkv[..., WIDTH : 2 * WIDTH], dqkv[..., 2 * WIDTH :]
        for some, low, high, s in kept:
            dv[some, :high] += s.transpose(0, 2, 1) @ dc[some, low:high, :WIDTH]
            s *= dc[some, low:high] @ v[some, :high].transpose(0, 2, 1)
            np.matmul(s, k[some, :high], out=dq[some, low:high])
            dk[some, :high] += s.transpose(0, 2, 1) @ q[some, low:high]
        dqkv = dqkv.reshape(-1, 3 * WIDTH)
        for name, d in zip("qkv", np.split(a.T @ dqkv, 3, axis=1)):
            out[name] = d
        out["q"] = out["q"] * a.dtype.type(1 / np.sqrt(WIDTH))
        da = dqkv @ into.T
        da += dr
        out["p"] = np.zeros_like(self.p)
        out["p"][:t] = da.reshape(n, t, WIDTH).sum(axis=0)
        order = np.argsort(before.astype(np.int16), kind="stable")
        at = before[order]
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        out["e"] = np.zeros_like(self.e)
        out["e"][at[starts]] = np.add.reduceat(np.take(da, order, axis=0), starts, axis=0)
        return loss, out

    def logs(self, x: np.ndarray, target: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """For the positions from ``first`` on, in one row: log probability of the target class, and of any class that
        begins a word.
        """
        a = np.take(self.e, x, axis=0)
        a += self.p[: x.shape[1]]
        y = np.ascontiguousarray(a[:, first:]).reshape(-1, WIDTH)
        y += self.attend(a, first)[-1].reshape(-1, WIDTH) @ self.o
        z = y @ self.h
        np.maximum(z, 0, out=z)
        y += z @ self.g
        before, wanted = x[:, first:].ravel(), target[:, first:].ravel()
        group, member = wanted // MEMBERS, wanted % MEMBERS
        at = np.arange(len(before))
        logits = y @ self.u
        logits += np.take(self.bu, before, axis=0)
        gain = logits.reshape(-1)[at * GROUPS + group]
        gain -= _exponentials(logits)
        halves = logits @ np.repeat(np.eye(2, dtype=y.dtype), GROUPS // 2, axis=0)
        every = np.log(halves.sum(axis=1))
        gain -= every
        order, edges = _by_group(group)
        y = np.take(y, order, axis=0)
        logits = np.take(self.bm.reshape(-1, MEMBERS), (before * GROUPS + group)[order], axis=0)
        for i, part in enumerate(edges):
            logits[part] += y[part] @ self.m[i]
        hit = logits.reshape(-1)[at * MEMBERS + member[order]]
        hit -= _exponentials(logits)
        hit -= np.log(logits @ np.ones(MEMBERS, dtype=y.dtype))
        gain[order] += hit
        return gain, np.log(halves[:, 0]) - every


def _exponentials(logits: np.ndarray) -> np.ndarray | float:
    """Exponentials in place, and what was taken from each row before so that they are finite: nothing, mostly."""
    top = 0.0
    if max(logits.max(), -logits.min()) > 80:
        top = logits.max(axis=1)
        logits -= top[:, None]
    np.exp(logits, out=logits)
    return top


def _by_group(group: np.ndarray) -> tuple[np.ndarray, list[slice]]:
    """An order of rows by their groups, and the part of it that each group is."""
    order = np.argsort(group.astype(np.int8), kind="stable")
    edges = np.append(0, np.cumsum(np.bincount(group, minlength=GROUPS))).tolist()
    return order, [slice(a, b) for a, b in zip(edges, edges[1:])]


def windows(n: int) -> list[tuple[int, int]]:
    """``(start, first scored position in the window)`` of the windows over n positions: each is scored once."""
    out = [(0, 0)]
    while out[-1][0] + WINDOW < n:
        out.append((out[-1][0] + WINDOW - OVERLAP, OVERLAP))
    return out


def train(texts: list[np.ndarray], classes: Classes, steps: int = STEPS, seed: int = 5) -> Attention:
    """The model after the given id sequences alone; the tables start from counts of neighbouring classes."""
    streams = [classes.of[np.concatenate([[classes.end], ids, [classes.end]])] for ids in texts]
    pairs = np.zeros(CLASSES * CLASSES)
    for s in streams:
        np.add.at(pairs, s[:-1] * CLASSES + s[1:], 1.0)
    model = Attention.fresh(pairs.reshape(CLASSES, CLASSES))
    improve(model, streams, steps, seed=seed)
    return model


def improve(model: Attention, streams: list[np.ndarray], steps: int, begin: float = 0.0, end: float = 1.0, seed: int = 5) -> None:
    """Adam on the windows of class sequences, each window once before any comes again.

    ``begin`` and ``end``: the part of the whole training that these steps are; the pace falls over the whole.
    """
    cut = [s[w : w + WINDOW + 1] for s in streams for w in range(0, len(s) - 1, WINDOW)]
    if not cut:
        return
    sizes = np.array([len(c) - 1 for c in cut])
    table = np.zeros((len(cut), WINDOW + 1), dtype=np.int16)
    for row, c in zip(table, cut):
        row[: len(c)] = c
    random = np.random.default_rng(seed)
    # All weights in one row: a step is a few operations on it.
    weights = np.concatenate([getattr(model, k).ravel() for k in TRAINED])
    at = 0
    for k in TRAINED:
        part = getattr(model, k)
        setattr(model, k, weights[at : at + part.size].reshape(part.shape))
        at += part.size
    m, s = np.zeros_like(weights), np.zeros_like(weights)
    order = np.zeros(0, dtype=np.int64)
    for step in range(1, steps + 1):
        while len(order) < STEP_WINDOWS:
            order = np.concatenate([order, random.permutation(len(cut))])
        chosen, order = order[:STEP_WINDOWS], order[STEP_WINDOWS:]
        width = int(sizes[chosen].max())
        both = table[chosen, : width + 1].astype(np.int64)
        real = np.arange(width) < sizes[chosen][:, None]
        _, gradients = model.gradients(both[:, :-1], both[:, 1:], real)
        pace = 0.01 * min(1.0, step / 20) * (1 - 0.9 * (begin + (end - begin) * step / steps))
        d = np.concatenate([gradients[k].ravel() for k in TRAINED])
        m += 0.1 * (d - m)
        s += 0.01 * (d * d - s)
        weights -= pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)


#: Windows of one matrix product, and the weight of the word counts in the mixture.
BATCH_WINDOWS, WORD_WEIGHT = 256, 0.2


def score_texts(model: Attention, classes: Classes, texts: list[np.ndarray], words: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each id sequence and its end.

    ``words``: for each text, log10 of the counted share of each word and of the end (-inf for words not known).
    A word's probability is a mixture of this share and of what the attention model gives its subwords, including
    that the word ends there; so both are distributions over words.
    """
    if not texts:
        return np.zeros(0)
    spelled, first_word = spell_texts(model, classes, texts)
    counted = np.concatenate(words) * np.log(10)
    if len(spelled) != len(counted):
        raise ValueError("a word without a beginning")
    return np.add.reduceat(mixture(counted, spelled), first_word) / np.log(10)


def mixture(counted: np.ndarray, spelled: np.ndarray) -> np.ndarray:
    return np.logaddexp(np.log(WORD_WEIGHT) + counted, np.log(1 - WORD_WEIGHT) + spelled)


def spell_texts(model: Attention, classes: Classes, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What the attention model gives each word and end, as natural logarithms in one row, and where each text begins."""
    sizes = np.array([len(ids) + 1 for ids in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    ids = np.full(int(ends[-1]), classes.end, dtype=np.int64)
    for i, t in enumerate(texts):
        ids[ends[i] - sizes[i] : ends[i] - 1] = t
    target = classes.of[ids]
    source = np.empty_like(target)
    source[1:] = target[:-1]
    source[ends - sizes] = classes.of[classes.end]
    gain, begins = _attention_logs(model, classes, source, target, ends, sizes)
    gain += classes.log_share[ids]
    starts = np.flatnonzero(classes.begins[ids])
    if starts[0] != 0:
        raise ValueError("a word without a beginning")
    spelled = np.add.reduceat(gain, starts) - begins[starts]
    last = ids[starts] == classes.end
    spelled[:-1][~last[:-1]] += begins[starts[1:]][~last[:-1]]
    return spelled, np.searchsorted(starts, ends - sizes)


def _attention_logs(model, classes: Classes, source, target, ends, sizes) -> tuple[np.ndarray, np.ndarray]:
    """Per position, the log probability of its class and of any class that begins a word."""
    gain, begins = np.zeros(len(target)), np.zeros(len(target))
    begin, step = ends - sizes, WINDOW - OVERLAP
    more = np.maximum(0, -(-(sizes - WINDOW) // step))  # windows after the first of each text
    nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    later = np.stack([np.repeat(begin, more) + nth * step, np.repeat(ends, more)], axis=1)
    for first, mine in ((0, np.stack([begin, ends], axis=1)), (OVERLAP, later)):
        mine = mine[np.argsort(np.minimum(WINDOW, mine[:, 1] - mine[:, 0]), kind="stable")]
        for at in range(0, len(mine), BATCH_WINDOWS):
            start, end = mine[at : at + BATCH_WINDOWS].T
            width = int(min(WINDOW, (end - start).max()))
            where = start[:, None] + np.arange(width)
            real = (where < end[:, None])[:, first:].ravel()
            where = np.minimum(where, len(target) - 1)
            place = where[:, first:].ravel()[real]
            found, any_begin = model.logs(source[where], target[where], first)
            gain[place], begins[place] = found[real], any_begin[real]
    return gain, begins


def class_streams(encoded: DataFrame, classes: Classes, tokenizer: str, frequent: tuple[bytes, ...] = ()) -> DataFrame:
    """``(key long, piece long, stream binary)``: the classes of each text between two ends, two bytes each.

    The pieces of a text overlap in one class, so that each pair of neighbours lies in one piece.
    """
    prepare(encoded.sparkSession)
    schema = pa.schema([("key", pa.int64()), ("piece", pa.int64()), ("stream", pa.binary())])
    step, of = PIECE_WINDOWS * WINDOW, classes.of.astype(np.int16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, ids in zip(batch.column("key").to_pylist(), ids_of(batch, frequent, tokenizer)[0]):
                stream = np.concatenate([of[-1:], of[ids], of[-1:]])
                rows += [(key, at // step, stream[at : at + step + 1].tobytes()) for at in range(0, len(stream) - 1, step)]
            columns = list(zip(*rows)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return encoded.select("key", "n_ids", "words", "rare_ids").mapInArrow(run, "key long, piece long, stream binary")


def class_pairs(streams: DataFrame) -> np.ndarray:
    """Counts of neighbouring classes; tasks add up, and one row per pair reaches the driver."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, dtype=np.int64)
        for batch in batches:
            parts = [np.frombuffer(x, dtype=np.int16).astype(np.int64) for x in batch.column("stream").to_pylist()]
            if parts:
                total += np.bincount(np.concatenate([p[:-1] * CLASSES + p[1:] for p in parts]), minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], schema=schema)

    rows = streams.select("stream").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    pairs = np.zeros(CLASSES * CLASSES)
    pairs[rows["pair"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.float64)
    return pairs.reshape(CLASSES, CLASSES)


def train_round(streams: DataFrame, model: Attention, shards: int, passes: int, begin: float, end: float) -> Attention:
    """The average of copies of the model, each trained on one ``shard`` of ``streams(shard, key, piece, stream)``,
    weighted by windows. What reaches the driver is summed in a bounded number of groups before.
    """
    # The session's context must not travel with the functions.
    start = list(vars(model).values())

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def trained(shard: int, held: list[bytes]) -> pd.DataFrame:
            copy = Attention(*(x.copy() for x in start))
            parts = [np.frombuffer(x, dtype=np.int16).astype(np.int64) for x in held]
            n = sum(-(-(len(x) - 1) // WINDOW) for x in parts)
            improve(copy, parts, -(-passes * n // STEP_WINDOWS), begin, end, seed=5 + shard)
            weights = np.concatenate([getattr(copy, k).ravel() for k in TRAINED]).astype(np.float64) * n
            return pd.DataFrame({"shard": [shard], "n": [n], "weights": [weights.tobytes()]})

        current, held = None, []
        for batch in batches:
            for shard, stream in zip(batch["shard"].tolist(), batch["stream"]):
                if shard != current and held:
                    yield trained(current, held)
                    held = []
                current = shard
                held.append(stream)
        if held:
            yield trained(current, held)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, None
        for batch in batches:
            for more, weights in zip(batch["n"].tolist(), batch["weights"]):
                weights = np.frombuffer(weights, dtype=np.float64)
                n, total = n + more, weights.copy() if total is None else total + weights
        if n:
            yield pd.DataFrame({"n": [n], "weights": [total.tobytes()]})

    dealt = streams.repartition(2 * shards, "shard").sortWithinPartitions("shard", "key", "piece", "stream")
    copies = dealt.select("shard", "stream").mapInPandas(learn, "shard long, n long, weights binary")
    groups = copies.withColumn("group", F.pmod("shard", F.lit(16))).repartition(16, "group").sortWithinPartitions("shard")
    rows = sorted((r["n"], bytes(r["weights"])) for r in groups.mapInPandas(add, "n long, weights binary").collect())
    if rows:
        mean = sum(np.frombuffer(w, dtype=np.float64) for _, w in rows) / sum(n for n, _ in rows)
        at = 0
        for k in TRAINED:
            part = getattr(model, k)
            part[...] = mean[at : at + part.size].reshape(part.shape)
            at += part.size
    return model


def fit_attention(training: DataFrame, counts: np.ndarray, tokenizer: str, frequent: tuple[bytes, ...] = ()) -> tuple[Attention, Classes]:
    """The model after all documents ``(doc_id, text)``, or after what ``encode_documents`` gives of them and ``frequent``.

    One pass over all windows, more while that makes fewer than ``STEPS`` steps. Rounds and shards are dealt by
    hashes of ids and texts; the number of shards grows with the windows. Each round reads its own streams only.
    """
    spark = training.sparkSession
    classes = make_classes(counts, pieces_of(tokenizer))
    encoded = training if "rare_ids" in training.columns else encode_documents(training, tokenizer, frequent)
    n = encoded.agg(F.coalesce(F.sum(F.ceil((F.col("n_ids") + 1) / WINDOW)), F.lit(0)).cast("long")).first()[0]
    if not n:
        return Attention.fresh(np.zeros((CLASSES, CLASSES))), classes
    cells = -(-n // SHARD_WINDOWS)
    rounds = min(ROUNDS, cells)
    shards = -(-cells // rounds)
    passes = -(-STEPS * STEP_WINDOWS // n)
    folder = shared_folder(spark, "streams")
    cell = F.pmod(F.xxhash64("key", "piece"), F.lit(rounds * shards))
    dealt = class_streams(encoded, classes, tokenizer, frequent).withColumn("shard", F.pmod(cell, F.lit(shards))).withColumn("round", (cell / shards).cast("int"))
    dealt.write.option("compression", "zstd").partitionBy("round").parquet(folder)
    streams = spark.read.schema("key long, piece long, stream binary, shard long, round int").parquet(folder)
    model = Attention.fresh(class_pairs(streams))
    for i in range(rounds):
        model = train_round(streams.where(F.col("round") == i), model, shards, passes, i / rounds, (i + 1) / rounds)
    return model, classes


_SCORED = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()),
    ("score", pa.float64()), ("rare", pa.list_(pa.struct([("word", pa.binary()), ("spelled", pa.list_(pa.float64()))]))),
])
SCORED = "row long, doc_id long, n_tokens long, known long, base double, score double, rare array<struct<word:binary,spelled:array<double>>>"


def _by_document(rare: pa.ListArray, spelled: np.ndarray) -> pa.Array:
    """For each document, each of its rare words once, with what the model gives at each of its places."""
    words, offsets = rare.flatten(), rare.offsets.to_numpy()
    document = np.repeat(np.arange(len(rare)), np.diff(offsets))
    word = words.dictionary_encode().indices.to_numpy()
    order = np.lexsort((word, document))
    document, word = document[order], word[order]
    first = np.flatnonzero((np.diff(document, prepend=-1) != 0) | (np.diff(word, prepend=-1) != 0))
    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(spelled[order], pa.float64()))
    entries = pa.StructArray.from_arrays([words.take(pa.array(order[first])), places], fields=list(_SCORED.field("rare").type.value_type))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(document[first], np.arange(len(rare) + 1)), pa.int32()), entries)


def score(documents: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per row.

    Learnt from the documents that are not held out; words and the end of each text are the tokens of the base.
    Every counted word has its counted share in the mixture: that of rare words is joined, as is their base.
    Null and empty texts have one token, their end. A row without an id is scored and not learnt from.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    training = rows.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counted = cut_lineage(word_counts(training))
    n_words, n_distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_ends = training.count()
    n, v = n_words + n_ends, n_distinct + (n_ends > 0)
    below = np.log10(n + SMOOTHING * (v + 1))
    # The most frequent words, a bounded number.
    frequent = counted.orderBy(F.desc("c"), "word").limit(FREQUENT).toPandas()
    words = tuple(map(bytes, frequent["word"]))
    encoded = encode_documents(rows, tokenizer, words)
    learnt = encoded.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    model, classes = fit_attention(learnt, subword_counts(counted, tokenizer), tokenizer, words)
    # Rare words, at place -1, have none yet.
    logs = np.append(np.log10(frequent["c"].to_numpy(dtype=np.float64) + SMOOTHING) - below, np.nan)
    end_log = float(np.log10(n_ends + SMOOTHING) - below)
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, places = ids_of(batch, words, tokenizer)
            spelled, first_word = spell_texts(model, classes, ids)
            sizes = np.array([len(x) + 1 for x in places])
            if len(spelled) != sizes.sum():
                raise ValueError("a word without a beginning")
            counted = np.concatenate([x for p in places for x in (logs[p], [end_log])])
            met = ~np.isnan(counted)
            others = spelled[~met]
            counted[~met] = 0
            both = mixture(counted * np.log(10), spelled) / np.log(10)
            both[~met] = 0
            rare = _by_document(batch.column("rare"), others)
            total = lambda values: np.add.reduceat(values, first_word)
            known = total(met.astype(np.int64)) - 1 + (n_ends > 0)
            columns = [np.arange(number, number + len(sizes)), batch.column("doc_id"), sizes, known, total(counted), total(both), rare]
            number += len(sizes)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _SCORED)], schema=_SCORED)

    folder = shared_folder(spark, "scored")
    encoded.select("doc_id", "n_ids", "words", "rare", "rare_ids").mapInArrow(run, SCORED).write.option("compression", "zstd").parquet(folder)
    scored = spark.read.schema(SCORED).parquet(folder)
    rare = scored.select("row", F.inline("rare")).join(counted, "word", "left")
    c, n_met = F.coalesce("c", F.lit(0)), F.size("spelled")
    share = F.log10(c + SMOOTHING) - F.lit(float(below))

    def mixed(spelled: Column) -> Column:
        """What ``mixture`` gives for one word; words that were never counted have no share."""
        x, y = share * float(np.log(10)) + float(np.log(WORD_WEIGHT)), spelled + float(np.log(1 - WORD_WEIGHT))
        both = F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y)))
        return F.when(c > 0, both).otherwise(y) / float(np.log(10))

    sums = rare.groupBy("row").agg(
        F.sum(n_met * share).alias("_base"), F.sum(F.when(c > 0, n_met).otherwise(0)).alias("_known"),
        F.sum(F.aggregate("spelled", F.lit(0.0), lambda a, x: a + mixed(x))).alias("_score"),
    )
    return scored.drop("rare").join(sums, "row", "left").select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(True)).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("_score", F.lit(0.0))).alias("score"),
    )

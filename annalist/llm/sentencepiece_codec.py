"""SentencePiece encoding and decoding with the tokenizers library.

The model file is parsed as protobuf wire data; its normaliser, white-space marker, scores or merges and byte
fallback are rebuilt as a tokenizers pipeline. Batches are encoded by several threads, and the ids can be compared
with those of the sentencepiece library row by row.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import prepare

#: Words that one worker process remembers; a full table is emptied, which only costs time.
REMEMBERED = 1_000_000
#: Words that are encoded in one string.
STRING_WORDS = 500

#: The marker that stands for a blank.
MARK = "▁"

# Types of pieces and models in the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class ModelFile:
    """What a model file says; defaults are those of the format."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    unk_id: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    space_as_suffix: bool = False


def wire_fields(data: bytes) -> Iterator[tuple[int, object]]:
    """``(number, value)`` of a protobuf message; values are ints, floats (32 bit) or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 1:
            at += 8
            yield key >> 3, data[at - 8 : at]
        elif kind == 2:
            size = varint()
            at += size
            yield key >> 3, data[at - size : at]
        elif kind == 5:
            at += 4
            yield key >> 3, struct.unpack("<f", data[at - 4 : at])[0]
        else:
            raise ValueError(f"wire type {kind}")


def parse_model(data: bytes) -> ModelFile:
    model = ModelFile()
    for number, value in wire_fields(data):
        if number == 1:
            piece = dict(wire_fields(value))
            model.pieces.append((piece.get(1, b"").decode(), float(piece.get(2, 0.0)), piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(wire_fields(value))
            model.model_type = trainer.get(3, UNIGRAM)
            model.unk_id = trainer.get(40, 0)
            model.byte_fallback = bool(trainer.get(35, 0))
            model.space_as_suffix = bool(trainer.get(24, 0))
        elif number == 3:
            normalizer = dict(wire_fields(value))
            model.charsmap = normalizer.get(2, b"")
            model.add_dummy_prefix = bool(normalizer.get(3, 1))
            model.remove_extra_whitespaces = bool(normalizer.get(4, 1))
            model.escape_whitespaces = bool(normalizer.get(5, 1))
    return model


def merges_of(model: ModelFile) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, best score first; pieces that texts cannot hold take no part."""
    usable = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, i in usable.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in usable and right in usable:
                found.append((-model.pieces[i][1], i, usable[left], usable[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def build_tokenizer(model: ModelFile):
    """The tokenizers pipeline of a model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.model_type == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    elif model.model_type == BPE:
        core = models.BPE(
            {p: i for i, (p, _, _) in enumerate(model.pieces)}, merges_of(model), unk_token=model.pieces[model.unk_id][0],
            fuse_unk=True, byte_fallback=model.byte_fallback,
        )
    else:
        raise ValueError("only unigram and BPE models are supported")
    if model.space_as_suffix or not model.escape_whitespaces:
        raise ValueError("models that mark white space as a suffix or not at all are not supported")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ +| +$"), "")]
    steps += [normalizers.Replace(" ", MARK)]
    if model.add_dummy_prefix:
        steps += [normalizers.Prepend(MARK)]
    tokenizer.normalizer = normalizers.Sequence(steps)
    inside = any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED))
    if not inside:
        # No piece goes on after a marker within it, so no merge crosses the place before one: words can be cached.
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), behavior="isolated")
    tokenizer.decoder = decoders.Sequence(
        [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + ([decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else [])
    )
    users = [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER_DEFINED]
    if users:
        tokenizer.add_tokens(users)
    return tokenizer


class Codec:
    """Encoding and decoding of batches."""

    def __init__(self, path: str, threads: int = 2) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        self.path, self.threads = path, threads
        with open(path, "rb") as file:
            self.model = parse_model(file.read())
        self.tokenizer = build_tokenizer(self.model)
        self._reference = None
        # Words between single blanks can be encoded apart if no piece crosses a marker and each gets a marker.
        self.by_words = (
            self.tokenizer.pre_tokenizer is not None and self.model.add_dummy_prefix and not self.model.charsmap
            and not self.model.remove_extra_whitespaces and all(kind != USER_DEFINED for *_, kind in self.model.pieces)
        )
        # Ids of pieces that begin with a marker: in words without one, only the first piece does.
        self.starts = np.array([p.startswith(MARK) for p, *_ in self.model.pieces])
        self.known: dict[str, bytes] = {}
        self.lossy: set[str] = set()  # known words that decoding does not give back

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Where the model allows it, each distinct word of the batch is encoded once."""
        if not self.by_words:
            return self._whole(texts)
        words = [t.split(" ") for t in texts]
        direct = [i for i, ws in enumerate(words) if "" in ws]
        every = set().union(*words) - {""}
        missing = [w for w in every if w not in self.known]
        if len(missing) + len(self.known) > REMEMBERED:
            self.known.clear()
            missing = every
        self.lossy.update(self._learn([w for w in missing if MARK not in w]))
        marked = [w for w in missing if MARK in w]
        coded = self._whole(marked)
        self.known.update(zip(marked, (ids.tobytes() for ids in coded)))
        self.lossy |= {w for w, b in zip(marked, self.decode(coded)) if w != b}
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, ws)), dtype=np.int32) if "" not in ws else None for ws in words]
        for i, ids in zip(direct, self._whole([texts[i] for i in direct])):
            out[i] = ids
        return out

    def _learn(self, words: list[str]) -> list[str]:
        """Remember the ids of words without markers; returns the words that decoding does not give back.

        Many words are encoded and decoded in one string, whose ids are cut before each piece that begins with a marker:
        every word begins with one. If the pieces of a string are not as many as its words, these are encoded one by one.
        """
        groups = [words[i:i + STRING_WORDS] for i in range(0, len(words), STRING_WORDS)]
        strings = [" ".join(g) for g in groups]
        coded = self._whole(strings)
        lossy = []
        for group, string, ids, back in zip(groups, strings, coded, self.decode(coded)):
            at = np.flatnonzero(self.starts[ids])
            if len(at) == len(group) and at[0] == 0:
                data, ends = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
                own = [data[a:b] for a, b in zip(ends, ends[1:])]
            else:
                own, back = [i.tobytes() for i in self._whole(group)], None
            self.known.update(zip(group, own))
            if back != string:
                again = self.decode([np.frombuffer(i, dtype=np.int32) for i in own])
                lossy += [w for w, b in zip(group, again) if w != b]
        return lossy

    def round_trips(self, texts: list[str], ids: list) -> list[bool]:
        """Whether decoding the ids of each text gives it back.

        Words that were encoded apart are decoded apart, too: blanks between them decode to blanks, and no bytes of a
        character go from one word to the next.
        """
        words = [t.split(" ") for t in texts]
        apart = [self.by_words and "" not in ws for ws in words]
        whole = iter(self.decode([i for i, a in zip(ids, apart) if not a]))
        return [self.lossy.isdisjoint(ws) if a else next(whole) == t for t, ws, a in zip(texts, words, apart)]

    def decode(self, ids: list) -> list[str]:
        return self.tokenizer.decode_batch([list(map(int, i)) if not isinstance(i, np.ndarray) else i.tolist() for i in ids], skip_special_tokens=False)

    def reference(self, texts: list[str]) -> list[list[int]]:
        """Ids by the sentencepiece library."""
        if self._reference is None:
            import sentencepiece

            self._reference = sentencepiece.SentencePieceProcessor(model_file=self.path)
        return self._reference.encode(texts, num_threads=self.threads)


@lru_cache(maxsize=2)
def codec(path: str, threads: int) -> Codec:
    """One codec per worker process."""
    return Codec(path, threads)


def encode(documents: DataFrame, model_path: str, text: str = "text", verify: bool = True, threads: int = 2) -> DataFrame:
    """All rows and columns with ``ids``, ``n_ids``, ``parity`` and ``round_trip``.

    ``parity``: the ids equal those of the sentencepiece library (null unless ``verify``). ``round_trip``: decoding
    gives the text back. A null text has null results; an empty one has no ids. Columns of these names are replaced.
    """
    prepare(documents.sparkSession)
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("parity", pa.bool_()), ("round_trip", pa.bool_())])

    @F.arrow_udf("struct<ids:array<int>,parity:boolean,round_trip:boolean>")
    def run(texts: pa.Array) -> pa.Array:
        code = codec(model_path, threads)
        bodies = [t or "" for t in texts.to_pylist()]
        ids = code.encode(bodies)
        parity = [np.array_equal(a, b) for a, b in zip(ids, code.reference(bodies))] if verify else [None] * len(ids)
        back = code.round_trips(bodies, ids)
        gone = texts.is_null().to_pylist()
        keep = lambda values, type_: pa.array([None if g else v for g, v in zip(gone, values)], type_)
        parts = [keep(ids, kind[0].type), keep(parity, pa.bool_()), keep(back, pa.bool_())]
        return pa.StructArray.from_arrays(parts, fields=list(kind))

    coded = documents.withColumn("_coded", run(F.col(text).cast("string")))
    return coded.withColumns({
        "ids": F.col("_coded.ids"), "n_ids": F.when(F.col("_coded.ids").isNotNull(), F.size("_coded.ids")).cast("long"), "parity": F.col("_coded.parity"),
        "round_trip": F.col("_coded.round_trip"),
    }).drop("_coded")


def decode(rows: DataFrame, model_path: str, ids: str = "ids", output: str = "text", threads: int = 2) -> DataFrame:
    """All rows and columns with the text of their ids in ``output``; null ids give null."""
    prepare(rows.sparkSession)

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        values = lists.to_pylist()
        texts = codec(model_path, threads).decode([v or [] for v in values])
        return pa.array([None if v is None else t for v, t in zip(values, texts)], pa.string())

    return rows.withColumn(output, run(F.col(ids)))

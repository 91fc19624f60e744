"""Toxicity severity by cumulative-link ordinal regression on sparse word features.

One weight vector is shared by all ordered thresholds: P(grade >= k) = logistic(w.x - threshold[k]). The model is
fitted by accelerated proximal gradients (L1 penalty) on a bounded sample of graded documents; scoring runs over
all documents where they lie.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import prepare

LETTERS = re.compile(r"[^\W\d_]+")

#: Lengths of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6, 7)


def features(words: set[str]) -> set[str]:
    """Whole words, and beginnings of longer words marked by a hyphen."""
    return words | {w[:n] + "-" for w in words for n in BEGINNINGS if len(w) > n}


@dataclass
class OrdinalModel:
    """Weights of words, the increasing thresholds, the grade that each step leads to, and from which expected grade on a
    text is rejected."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)
    grades: list[int] = field(default_factory=lambda: [0])
    rejected_from: float = 0.4

    def probabilities(self, text: str | None) -> np.ndarray:
        """P(grade >= g) for every grade but the lowest."""
        known = self.weights.keys() & features(set(LETTERS.findall((text or "").lower())))
        latent = sum(self.weights[w] for w in sorted(known))
        return 1.0 / (1.0 + np.exp(np.clip(np.array(self.thresholds) - latent, -60, 60)))

    def severity(self, text: str | None) -> tuple[float, int]:
        """Expected grade and most probable grade."""
        above = self.probabilities(text)
        steps = np.diff(self.grades)
        each = np.concatenate([[1.0], above]) - np.concatenate([above, [0.0]])
        return float(self.grades[0] + (above * steps).sum()), int(self.grades[int(np.argmax(each))])


def sample_graded(documents: DataFrame, grades: DataFrame, bound: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """At most ``bound`` distinct graded texts: ``(_id, words, grade, weight)``.

    ``grades(id, grade)``: null ids and grades do not count; of repeated ids and of copies the highest grade holds, and a
    text is there once. Each grade has an equal part of the bound, and what rarer grades leave of theirs, in order
    of a hash; ``weight`` is the number of texts of the grade over those chosen.
    """
    graded = (
        grades.where(F.col(id_col).isNotNull() & F.col("grade").isNotNull())
        .groupBy(F.col(id_col).alias("_id")).agg(F.max("grade").cast("long").alias("grade"))
    )
    texts = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.coalesce(text, F.lit("")).alias("_text"))
    digest = [F.xxhash64("_text").alias("_a"), F.xxhash64(F.reverse("_text"), F.length("_text")).alias("_b")]
    distinct = cut_lineage(
        texts.select("_id", *digest).join(graded, "_id").groupBy("_a", "_b").agg(F.max("grade").alias("grade"), F.min("_id").alias("_id"))
    )
    sizes = sorted((n, g) for g, n in distinct.groupBy("grade").count().collect())
    chosen, left = distinct.limit(0).withColumn("weight", F.lit(1.0)), bound
    for i, (n, grade) in enumerate(sizes):
        mine = min(n, left // (len(sizes) - i))
        left -= mine
        if mine:
            part = distinct.where(F.col("grade") == grade).orderBy(F.xxhash64("_a", "_b"), "_a", "_b").limit(mine)
            chosen = chosen.unionByName(part.withColumn("weight", F.lit(n / mine)))
    words = F.regexp_extract_all(F.lower("_text"), F.lit(r"(\p{L}+)"), F.lit(1))
    # The chosen texts are bounded by the parameter, so their ids and digests may travel to every task.
    found = texts.select("*", *digest).join(F.broadcast(chosen), ["_id", "_a", "_b"]).dropDuplicates(["_a", "_b"])
    return found.select("_id", "_a", F.array_distinct(words).alias("words"), "grade", "weight")


def fit(
    documents: DataFrame, grades: DataFrame, bound: int = 8000, id_col: str = "doc_id", text: str = "text",
    min_documents: int = 5, max_share: float = 1.0, penalty: float = 0.003, rounds: int = 120, clean_lost: float = 0.01,
) -> OrdinalModel:
    """Fit on at most ``bound`` distinct graded texts, in one task.

    A text is rejected from the lowest expected grade that costs at most ``clean_lost`` of the texts of grade 0, each judged
    by a model that has not seen it.

    Words in fewer than ``min_documents``, in more than ``max_share`` or in all of them are no features; near copies
    may share most of their words, so that by default the penalty decides. Without graded
    documents, or with a single grade, the model says that grade (0 without any) for every text.
    """
    prepare(documents.sparkSession)

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample, levels, weights = FeatureRows(), [], []
        for batch in batches:
            levels += batch["grade"].tolist()
            weights += batch["weight"].tolist()
            for words in batch["words"]:
                sample.add(words)
        graded, options = np.array(levels, dtype=np.int64), (min_documents, max_share, penalty, rounds)
        model = fit_sample(sample, graded, *options, np.array(weights))
        model.rejected_from = lowest_rejection(held_out(sample, graded, np.array(weights), *options), graded, np.array(weights), clean_lost, model.rejected_from)
        yield pd.DataFrame(
            [("grade", "", float(g)) for g in model.grades] + [("threshold", "", t) for t in model.thresholds] + [("rejected", "", model.rejected_from)]
            + [("weight", w, x) for w, x in model.weights.items()], columns=["kind", "name", "value"],
        )

    sample = sample_graded(documents, grades, bound, id_col, text).repartition(1).sortWithinPartitions("_id", "_a")
    rows = sample.mapInPandas(train, "kind string, name string, value double").collect()
    of = lambda kind: [r["value"] for r in rows if r["kind"] == kind]
    return OrdinalModel(
        {r["name"]: r["value"] for r in rows if r["kind"] == "weight"}, of("threshold"), [int(g) for g in of("grade")] or [0],
        *of("rejected"),
    )


class FeatureRows:
    """Numbered features of documents, one after the other."""

    def __init__(self, documents: list | None = None) -> None:
        self.number: dict[str, int] = {}
        self.columns, self.sizes = array("i"), array("i")
        for words in documents or ():
            self.add(words)

    def add(self, words) -> None:
        found = sorted(features(set(words)))
        self.columns.extend([self.number.setdefault(f, len(self.number)) for f in found])
        self.sizes.append(len(found))


    def some(self, which: np.ndarray) -> FeatureRows:
        """The rows that a mask picks, with the same numbers of features."""
        part, sizes = FeatureRows(), np.array(self.sizes, dtype=np.int32)
        columns = np.frombuffer(self.columns, dtype=np.int32) if self.columns else np.zeros(0, np.int32)
        part.number = self.number
        part.columns, part.sizes = array("i", columns[np.repeat(which, sizes)].tobytes()), array("i", sizes[which].tobytes())
        return part

    def severity(self, model: OrdinalModel) -> np.ndarray:
        """Expected grade of every row."""
        weights = np.zeros(len(self.number))
        for name, value in model.weights.items():
            weights[self.number[name]] = value
        columns = np.frombuffer(self.columns, dtype=np.int32) if self.columns else np.zeros(0, np.int32)
        latent = np.bincount(np.repeat(np.arange(len(self.sizes)), self.sizes), weights=weights[columns], minlength=len(self.sizes))
        above = 1.0 / (1.0 + np.exp(np.clip(np.array(model.thresholds)[None, :] - latent[:, None], -60, 60)))
        return model.grades[0] + above @ np.diff(model.grades)


#: Parts of the sample that are judged by models fitted on the others.
FOLDS = 3


def held_out(sample: FeatureRows, grades: np.ndarray, weights: np.ndarray, *options) -> np.ndarray:
    """Expected grade of every row by a model fitted on the other parts of the sample."""
    part = np.random.default_rng(0).permutation(len(grades)) % FOLDS
    expected = np.zeros(len(grades))
    for p in range(FOLDS):
        if (part == p).any():
            model = fit_sample(sample.some(part != p), grades[part != p], *options, weights[part != p])
            expected[part == p] = sample.some(part == p).severity(model)
    return expected


def lowest_rejection(expected: np.ndarray, grades: np.ndarray, weights: np.ndarray, clean_lost: float, otherwise: float) -> float:
    """The lowest bound that at most the given share of the weight of grade 0 reaches; ``otherwise`` where one side is missing."""
    clean = grades == 0
    if clean.all() or not clean.any():
        return otherwise
    order = np.argsort(-expected[clean])
    values, lost = expected[clean][order], np.cumsum(weights[clean][order]) / weights[clean].sum()
    first_kept = values[np.searchsorted(lost, clean_lost, side="right")] if lost[-1] > clean_lost else 0.0
    higher = expected[expected > first_kept]
    return float((first_kept + higher.min()) / 2) if len(higher) else otherwise


def fit_sample(sample: FeatureRows, grades: np.ndarray, min_documents: int = 5, max_share: float = 1.0, penalty: float = 0.003, rounds: int = 120, weights: np.ndarray | None = None) -> OrdinalModel:
    """``weights``: of the documents, 1 by default; thresholds and losses are those of the weighted sample."""
    levels = sorted(set(grades.tolist()))
    if len(levels) < 2:
        return OrdinalModel(grades=levels or [0])
    n = len(grades)
    y = np.searchsorted(levels, grades)
    heavy = np.ones(n) if weights is None else weights * (n / weights.sum())
    columns = np.frombuffer(sample.columns, dtype=np.int32) if sample.columns else np.zeros(0, np.int32)
    counts = np.bincount(columns, minlength=len(sample.number))
    fit_for = (counts >= min_documents) & (counts <= max_share * n) & (counts < n)
    kept = fit_for[columns]
    rows = np.repeat(np.arange(n), np.array(sample.sizes))[kept]
    columns = (np.cumsum(fit_for) - 1)[columns[kept]]
    names = [name for name, i in sample.number.items() if fit_for[i]]
    share = counts[fit_for] / n
    scale = 1.0 / np.sqrt(share * (1.0 - share))
    thresholds = np.array([np.log(heavy[y < k].sum() / heavy[y >= k].sum()) for k in range(1, len(levels))])
    w = np.zeros(len(names))
    values = scale[columns]

    def latent(v: np.ndarray) -> np.ndarray:
        return np.bincount(rows, weights=values * v[columns], minlength=n)

    def gradients(v: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # d log P(y) / d latent, for the difference of two logistic curves, is 1 - F(upper) - F(lower).
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        z = latent(v)
        with np.errstate(over="ignore"):
            low, high = (1.0 / (1.0 + np.exp(edges[y + i] - z)) for i in (0, 1))
        slope = -(1.0 - high - low) * heavy / n
        inside = np.maximum(low - high, 1e-12)
        dlow, dhigh = heavy * low * (1 - low) / inside, heavy * high * (1 - high) / inside
        per_cut = np.array([dlow[y == k].sum() - dhigh[y == k - 1].sum() for k in range(1, len(levels))]) / n
        return np.bincount(columns, weights=values * slope[rows], minlength=len(names)), per_cut

    step = _safe_step(rows, columns, values, n, len(names), heavy)
    seen_w, seen_t, momentum = w, thresholds, 1.0
    for _ in range(rounds):
        gw, gt = gradients(seen_w, seen_t)
        moved = seen_w - step * gw
        new_w = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0.0)
        new_t = np.maximum.accumulate(seen_t - min(step, 2.0) * gt + 1e-9 * np.arange(len(thresholds)))
        following = (1.0 + np.sqrt(1.0 + 4.0 * momentum**2)) / 2.0
        pace = (momentum - 1.0) / following
        seen_w, seen_t = new_w + pace * (new_w - w), np.maximum.accumulate(new_t + pace * (new_t - thresholds))
        w, thresholds, momentum = new_w, new_t, following
    return OrdinalModel(
        {str(names[i]): float(w[i] * scale[i]) for i in np.flatnonzero(w)}, [float(t) for t in thresholds], levels
    )


def _safe_step(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int, width: int, heavy: np.ndarray) -> float:
    """One over a bound of the curvature: half the largest squared singular value over n, by power iteration."""
    v = np.ones(max(1, width)) / np.sqrt(max(1, width))
    largest = 1.0
    for _ in range(20):
        z = np.bincount(rows, weights=values * v[columns], minlength=n)
        v = np.bincount(columns, weights=values * (heavy * z)[rows], minlength=width)
        largest = float(np.linalg.norm(v))
        if largest == 0:
            return 1.0
        v = v / largest
    return 1.0 / (0.5 * (1.0 + 1.1 * largest / n))


def severity(model: OrdinalModel, text: Column) -> Column:
    """``struct(expected_severity, grade)`` of a text; null and empty texts count as texts without known words."""
    return _scorer(model)(text)


def _scorer(model: OrdinalModel):
    @F.pandas_udf("expected_severity double, grade int")
    def score(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.severity(t) for t in texts], columns=["expected_severity", "grade"]).astype({"grade": "int32"})

    return score


def score(documents: DataFrame, model: OrdinalModel, text: str = "text", threshold: float | None = None) -> DataFrame:
    """All columns and rows, with ``expected_severity``, ``grade`` and ``toxic`` (expected severity reaches the threshold, by
    default the model's).

    Columns of these names are replaced.
    """
    prepare(documents.sparkSession)
    scored = documents.withColumn("_severity", severity(model, F.col(text)))
    return scored.withColumns({
        "expected_severity": F.col("_severity.expected_severity"), "grade": F.col("_severity.grade"),
        "toxic": F.col("_severity.expected_severity") >= (model.rejected_from if threshold is None else threshold),
    }).drop("_severity")

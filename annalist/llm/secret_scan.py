"""Secret scans: wide candidate rules, then a random forest that removes false positives.

Scanning finds candidates with their neighbouring words in one pass over the texts. The forest is fitted in one
task on a bounded sample of labelled findings and scores every candidate by its length, character transitions,
dictionary coverage, path and neighbouring words.
"""

from __future__ import annotations

import bisect
import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import prepare

# Key names, published token shapes, placeholders, words that go with harmless digests.
KEY = re.compile(r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|credential|api[_-]?key|access[_-]?key|auth)[\"'\]]?\s*$")
VALUE = re.compile(r"\s*[\"']?([^\s\"'`<>,;]{6,})")
PROVIDERS = re.compile(
    r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}"
    r"|sk-[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})(?![A-Za-z0-9])"
)
HINTS = ("AKIA", "gh", "xox", "AIza", "sk-", "eyJ")
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", re.S)
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
PLACEHOLDERS = ("changeme", "example", "your_token_here", "xxxxxxxxxxxx", "<redacted>", "placeholder1", "test1234", "none_none")
DIGEST_WORDS = ("commit", "sha1", "md5", "checksum", "revision", "etag", "uuid", "build")
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "credential", "key", "auth", "bearer")
QUIET_PATHS = ("test", "example", "sample", "mock", "fixture", "doc", "lock", "min.js", "vendor")

FINDING = pa.schema([
    ("doc_id", pa.int64()), ("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()),
    ("value", pa.string()), ("before", pa.string()), ("after", pa.string()),
])
FINDINGS = "doc_id long, path string, start long, end long, kind string, value string, before string, after string"
#: Characters kept on either side of a candidate for its neighbouring words.
CONTEXT = 80


def candidates(text: str | None) -> list[tuple[int, int, str]]:
    """Non-overlapping ``(start, end, kind)`` of one text, in order. Kinds that say more win."""
    if not text:
        return []
    found = []
    if "-----BEGIN " in text:
        found += [(m.start(), m.end(), "pem") for m in PEM.finditer(text)]
    if any(h in text for h in HINTS):
        found += [(m.start(), m.end(), "provider") for m in PROVIDERS.finditer(text)]
    for m in re.finditer("[:=]", text):
        if KEY.search(text, max(0, m.start() - 24), m.start()) and (v := VALUE.match(text, m.end())):
            found.append((v.start(1), v.end(1), "assignment"))
    found += [(m.start(), m.end(), "run") for m in RUN.finditer(text)]
    kept: list[tuple[int, int, str]] = []
    for kind in ("pem", "provider", "assignment", "run"):
        for f in sorted(f for f in found if f[2] == kind):
            i = bisect.bisect_left(kept, f)
            if (i == 0 or kept[i - 1][1] <= f[0]) and (i == len(kept) or kept[i][0] >= f[1]):
                kept.insert(i, f)
    return kept


def scan(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """All candidates of all texts with their surroundings. Null and empty texts have none; repeated rows repeat theirs."""
    prepare(documents.sparkSession)
    where = F.col(path).cast("string") if path else F.lit("")
    rows = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(where, F.lit("")).alias("path"), F.col(text).cast("string").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, place, body in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "path", "text"))):
                found += [(key, place, s, e, kind, *surroundings(body, s, e)) for s, e, kind in candidates(body)]
            columns = list(zip(*found)) or [()] * len(FINDING)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FINDING)], schema=FINDING)

    return rows.mapInArrow(run, FINDINGS)


def surroundings(text: str, start: int, end: int) -> tuple[str, str, str]:
    """The candidate and the text on its left and right."""
    return text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]


def words_near(before: str, after: str) -> tuple[list[str], list[str]]:
    """The last three words before and the first two after a candidate."""
    letters = re.compile(r"[^\W\d_]+")
    return letters.findall(before.lower())[-3:], letters.findall(after.lower())[:2]


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


@dataclass
class SecretModel:
    """Dictionary, character transitions and the trees; without trees every candidate is kept."""

    words: frozenset[str] = frozenset()
    transitions: dict[str, float] = field(default_factory=dict)
    trees: list[list[tuple]] = field(default_factory=list)

    def features(self, path: str, kind: str, value: str, before: str, after: str) -> list[float]:
        n = max(1, len(value))
        lower = value.lower()
        pairs = [self.transitions.get(lower[i : i + 2], -9.0) for i in range(n - 1)]
        switches = sum(_kind(a) != _kind(b) for a, b in zip(value, value[1:]))
        parts = re.findall(r"[^\W\d_]+", lower)
        covered = sum(len(p) for p in parts if p in self.words)
        counts = Counter(value)
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
        left, right = words_near(before, after)
        near = left + right
        return [
            float(len(value)), sum(pairs) / max(1, len(pairs)), switches / n, covered / n, entropy,
            sum(c.isdigit() for c in value) / n, float(re.fullmatch("[0-9a-fA-F]+", value) is not None),
            float(any(q in path.lower() for q in QUIET_PATHS)), float(any(s in w for w in left for s in SECRET_WORDS)),
            float(any(w in DIGEST_WORDS or w == "sha" for w in left)), float(sum(w in self.words for w in near)),
            float(kind == "provider"), float(kind == "pem"), float(kind == "assignment"), len(counts) / n,
        ]

    def score(self, rows: list[tuple]) -> np.ndarray:
        """Share of trees, weighted by leaves, that call each ``(path, kind, value, before, after)`` a secret."""
        if not self.trees or not rows:
            return np.ones(len(rows))
        x = np.array([self.features(*r) for r in rows])
        return np.mean([_descend(tree, x) for tree in self.trees], axis=0)


def _descend(tree: list[tuple], x: np.ndarray) -> np.ndarray:
    column, cut, left, right, value = (np.array(c) for c in zip(*tree))
    at = np.zeros(len(x), dtype=np.int64)
    while (inner := column[at] >= 0).any():
        go_left = x[np.arange(len(x)), np.maximum(column[at], 0)] <= cut[at]
        at = np.where(inner, np.where(go_left, left[at], right[at]), at)
    return value[at]


def grow_forest(x: np.ndarray, y: np.ndarray, n_trees: int = 25, depth: int = 8, seed: int = 7) -> list[list[tuple]]:
    """Trees on bootstrap samples, each split on the best of sqrt(features) random columns by Gini impurity."""
    random = np.random.default_rng(seed)
    tries = max(1, round(math.sqrt(x.shape[1])))

    def split(rows: np.ndarray, level: int, nodes: list[tuple]) -> int:
        at, share = len(nodes), float(y[rows].mean())
        nodes.append((-1, 0.0, 0, 0, share))
        if level == depth or share in (0.0, 1.0) or len(rows) < 4:
            return at
        best, tried = (math.inf, -1, 0.0), 0
        for column in random.permutation(x.shape[1]):
            if tried == tries:
                break
            values = x[rows, column]
            order = np.argsort(values, kind="stable")
            v, hits = values[order], np.cumsum(y[rows][order])
            cuts = np.flatnonzero(v[1:] > v[:-1])
            if not len(cuts):
                continue  # a constant column is no try
            tried += 1
            n_left = cuts + 1.0
            n_right = len(rows) - n_left
            a, b = hits[cuts], hits[-1] - hits[cuts]
            impurity = a * (1 - a / n_left) + b * (1 - b / n_right)
            k = int(np.argmin(impurity))
            if impurity[k] < best[0]:
                best = (float(impurity[k]), int(column), float((v[cuts[k]] + v[cuts[k] + 1]) / 2))
        if best[1] < 0:
            return at
        below = x[rows, best[1]] <= best[2]
        left = split(rows[below], level + 1, nodes)
        right = split(rows[~below], level + 1, nodes)
        nodes[at] = (best[1], best[2], left, right, share)
        return at

    trees = []
    for _ in range(n_trees):
        nodes: list[tuple] = []
        split(random.integers(0, len(y), len(y)), 0, nodes)
        trees.append(nodes)
    return trees


def audited(findings: DataFrame) -> DataFrame:
    """Labelled findings by the rules an auditor would apply: published shapes, and keys with values that are random enough.

    Each finding with a key also appears with a placeholder as its value, and each hexadecimal one as a digest of
    something harmless; both are labelled 0.
    """
    value = F.col("value")
    random = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 7)
    secret = F.col("kind").isin("provider", "pem") | ((F.col("kind") == "assignment") & random & (F.length(value) >= 8))
    labelled = findings.withColumn("label", secret.cast("int"))
    pick = lambda options, salt: F.get(F.array(*map(F.lit, options)), F.pmod(F.xxhash64("value", F.lit(salt)), F.lit(len(options))).cast("int"))
    keyed = labelled.where((F.col("kind") == "assignment") & (F.col("label") == 1))
    placeholders = keyed.withColumn("value", pick(PLACEHOLDERS, 1)).withColumn("label", F.lit(0))
    digests = keyed.where(value.rlike("^[0-9a-f]{32,}$")).withColumn("before", F.concat(pick(DIGEST_WORDS, 2), F.lit(" "))).withColumn(
        "kind", F.lit("run")).withColumn("label", F.lit(0))
    return labelled.unionByName(placeholders).unionByName(digests)


def fit(labelled: DataFrame, bound: int = 6000) -> SecretModel:
    """Fit on at most ``bound`` labelled findings, half of either label, in order of a hash; in one task.

    ``labelled``: columns of ``FINDINGS`` and ``label`` (0 or 1; null does not count). Without both labels there
    is no forest, and every candidate is kept.
    """
    prepare(labelled.sparkSession)
    key = F.xxhash64("value", "before", "doc_id", "start")
    usable = labelled.where(F.col("label").isNotNull() & F.col("value").isNotNull()).withColumn("_h", key)
    halves = [usable.where(F.col("label") == k).orderBy("_h", "doc_id", "start", "value").limit(bound // 2) for k in (0, 1)]

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        rows = pd.concat(parts).sort_values(["_h", "label", "value"], kind="stable") if parts else pd.DataFrame()
        model = fit_rows(rows)
        yield pd.DataFrame({"model": [pickle.dumps((model.words, model.transitions, model.trees))]})

    model = halves[0].unionByName(halves[1]).repartition(1).mapInPandas(train, "model binary").collect()
    return SecretModel(*pickle.loads(bytes(model[0]["model"]))) if model else SecretModel()


def fit_rows(rows: pd.DataFrame) -> SecretModel:
    if not len(rows) or rows["label"].nunique() < 2:
        return SecretModel()
    context = Counter(w for b, a in zip(rows["before"], rows["after"]) for w in re.findall(r"[^\W\d_]+", f"{b[1:]} {a[:-1]}".lower()))
    words = frozenset(w for w, n in context.items() if n >= 3 and len(w) > 2)
    pairs, firsts = Counter(), Counter()
    for w, n in context.items():
        for a, b in zip(w, w[1:]):
            pairs[a + b] += n
            firsts[a] += n
    model = SecretModel(words, {p: math.log(n / firsts[p[0]]) for p, n in pairs.items()})
    x = np.array([model.features(*r) for r in rows[["path", "kind", "value", "before", "after"]].itertuples(index=False)])
    model.trees = grow_forest(x, rows["label"].to_numpy(dtype=np.float64))
    return model


def classify(findings: DataFrame, model: SecretModel, threshold: float = 0.5) -> DataFrame:
    """Findings with ``score`` and ``is_secret``."""
    @F.pandas_udf("double")
    def score(path: pd.Series, kind: pd.Series, value: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series(model.score(list(zip(path, kind, value, before, after))))

    scored = findings.withColumn("score", score("path", "kind", "value", "before", "after"))
    return scored.withColumn("is_secret", F.col("score") >= threshold)


def redact(documents: DataFrame, model: SecretModel, text: str = "text", path: str | None = "source", mask: str = "[SECRET]", threshold: float = 0.5) -> DataFrame:
    """The same rows and columns with every secret of the text replaced by ``mask``; null texts stay null."""
    prepare(documents.sparkSession)

    @F.pandas_udf("string")
    def clean(bodies: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([redact_text(b, p or "", model, mask, threshold) for b, p in zip(bodies, places)], dtype=object)

    where = F.col(path).cast("string") if path else F.lit("")
    return documents.withColumn(text, clean(F.col(text), F.coalesce(where, F.lit(""))))


def redact_text(text: str | None, path: str, model: SecretModel, mask: str, threshold: float) -> str | None:
    spans = candidates(text)
    if not spans:
        return text
    scores = model.score([(path, kind, *surroundings(text, s, e)) for s, e, kind in spans])
    out, at = [], 0
    for (s, e, _), p in zip(spans, scores):
        if p >= threshold:
            out += [text[at:s], mask]
            at = e
    return "".join(out) + text[at:]

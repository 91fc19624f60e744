"""Benchmark runs: jobs, resuming, summaries of recorded details."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

PLAIN_VECTOR_MODE = "plain_vector_rag"


def retrieval_modes(mode: str, compare_plain: bool, graph_label: str = "graph", plain_label: str = "plain_vector") -> list[tuple[str, str]]:
    """The modes of a run: the chosen one, or graph and plain vectors side by side."""
    if not compare_plain:
        return [(mode, plain_label if mode == PLAIN_VECTOR_MODE else f"{graph_label}:{mode}")]
    graph = "hybrid" if mode == PLAIN_VECTOR_MODE else mode
    return [(graph, f"{graph_label}:{graph}"), (PLAIN_VECTOR_MODE, plain_label)]


def jobs(segments: DataFrame, modes: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per segment and mode; the mode list is a parameter, so no join is needed."""
    listed = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(label).alias("label")) for m, label in modes])
    return segments.select("*", F.inline(listed))


def resume_jobs(all_jobs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jobs without a recorded result."""
    return all_jobs.join(done.select(*keys).distinct(), list(keys), "left_anti")

"""Merkle manifest of a dataset, with proofs folded from retained hash states.

Every row is a leaf. Per group the leaves, in order of their ids, are hashed in runs of eight to a subroot; the
subroots, in order of their groups, are hashed alike to the root. The hash of a parent takes its children one after the
other; before each child the state reached so far is copied and kept with the parent. To fold another value of a
child into the root, the state kept for its slot is resumed with the replacement and the siblings to its right; what
stands to the left is not hashed again.

Leaves are placed by a range-partitioned sort and numbered from the row counts of partitions, so that one group may
hold any share of the rows. The tree is then cut into subtrees of ``arity ** depth`` nodes, each built by one task;
its top is a node of the tier above, which is cut alike. Paths go down tier by tier: a subtree gets the siblings above
its top, builds the states of these parents once, and folds all its rows. A hash state cannot leave its process, so a
task takes the states again from left siblings, once per subtree and not per row. Only digests are shuffled, never texts.

Defined cases: null fields are hashed as ``-``; rows without an id come first in their group; rows with equal ids are
ordered by their leaves, equal rows are leaves of their own; a missing group is one of its own and comes first; other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import string
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import make_known, shared_folder

ARITY = 8

#: Levels of the tree that one task builds: subtrees of 4096 nodes.
DEPTH = 4

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(replaced: dict[str, Column] | None = None) -> Column:
    """Digest of a row's fields, some of them replaced."""
    replaced = replaced or {}
    return F.sha2(F.concat(*[field(replaced.get(name, F.col(name))) for name in FIELDS]), 256)


# --- one subtree, inside a task ------------------------------------------------------------

class Subtree:
    """A tree over consecutive nodes. ``states[level][parent][slot]`` is the copied hash state before that slot."""

    def __init__(self, digests: list[str], levels: int | None, arity: int = ARITY) -> None:
        """``levels``: how often the nodes are hashed in runs; None until one remains."""
        self.arity, self.rows, self.states = arity, [digests], []
        while len(self.rows[-1]) > 1 if levels is None else len(self.states) < levels:
            parents, kept = [], []
            for start in range(0, len(self.rows[-1]), arity):
                state, before = hashlib.sha256(), []
                for child in self.rows[-1][start:start + arity]:
                    before.append(state.copy())
                    state.update(child.encode())
                parents.append(state.hexdigest())
                kept.append(before)
            self.rows.append(parents)
            self.states.append(kept)

    def path(self, at: int) -> list[tuple[str, str]]:
        """Left and right siblings of a node and of its ancestors, each joined."""
        steps = []
        for nodes in self.rows[:-1]:
            first = at - at % self.arity
            steps.append(("".join(nodes[first:at]), "".join(nodes[at + 1:first + self.arity])))
            at //= self.arity
        return steps

    def fold(self, at: int, digest: str) -> str:
        """The top after another value of a node."""
        for nodes, kept in zip(self.rows, self.states):
            parent, slot = divmod(at, self.arity)
            digest = resumed(kept[parent][slot], digest, "".join(nodes[at + 1:(parent + 1) * self.arity]))
            at = parent
        return digest


def resumed(state, digest: str, right: str) -> str:
    """Digest of a parent from the state kept before a slot, the slot's value, and what stands to its right."""
    state = state.copy()
    state.update((digest + right).encode())
    return state.hexdigest()


def states_of(path: list[tuple[str, str]]) -> list:
    """States before the path's slots, with right siblings: hashed once, resumed for every row below."""
    return [(hashlib.sha256(left.encode()), right) for left, right in path]


# --- places --------------------------------------------------------------------------------

def numbered(rows: DataFrame, group: str, order: list[str], place: str) -> DataFrame:
    """``rows`` with ``pos``, the row's number in its group from 0, and ``n``, the group's size. Written to ``place``.

    Rows are sorted by range partitions; their numbers inside a partition and the partitions' counts give the places,
    so no window over a group is needed. The written table keeps them when a task is repeated.
    """
    spark = rows.sparkSession
    sorted_rows = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    sorted_rows.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i")).write.parquet(place)
    rows = spark.read.parquet(place)
    # One row per partition and group; a group's rows lie in consecutive partitions.
    counts = rows.groupBy(group, "_p").agg(F.count("*").alias("_c"), F.min("_i").alias("_first"))
    before = Window.partitionBy(group).orderBy("_p")
    starts = counts.select(
        group, "_p", "_first", (F.sum("_c").over(before) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy(group)).alias("n"))
    kept = [c for c in rows.columns if c not in ("_p", "_i")]
    return rows.join(starts, [group, "_p"]).select(*kept, (F.col("_before") + F.col("_i") - F.col("_first")).alias("pos"), "n")


PATH = "array<struct<left:string,right:string>>"


@dataclass(frozen=True)
class Cut:
    """How trees are cut into subtrees; this is what tasks know of a tree."""

    depth: int = DEPTH
    arity: int = ARITY

    @property
    def size(self) -> int:
        return self.arity ** self.depth

    def block(self) -> Column:
        return F.floor(F.col("pos") / self.size).cast("long")

    def tree(self, rows: pd.DataFrame) -> Subtree:
        """The tree of one subtree's rows. A group that fits one subtree ends at one node; in a larger one every subtree
        has its full height."""
        return Subtree(list(rows["digest"]), None if int(rows["n"].iloc[0]) <= self.size else self.depth, self.arity)

    def below(self, rows: pd.DataFrame, above: pd.DataFrame) -> tuple[pd.DataFrame, Subtree, list[tuple[str, str]]]:
        """Rows of one subtree in order, its tree, and the path from its top."""
        rows = rows.sort_values("pos").reset_index(drop=True)
        return rows, self.tree(rows), [(s["left"], s["right"]) for s in above["path"].iloc[0]]


class Tree:
    """Tiers of subtrees over numbered nodes ``(group, pos, n, digest)``; every tier is written to the shared folder."""

    def __init__(self, nodes: DataFrame, folder: str, cut: Cut) -> None:
        self.cut, self.tiers = cut, [nodes]
        most = nodes.agg(F.max("n")).first()[0] or 0
        while most > 1:
            self.tiers.append(self._above(self.tiers[-1], f"{folder}/tier-{len(self.tiers)}"))
            most = -(-most // cut.size)
        self.tops = self.tiers[-1].select("group", "digest")

    def _above(self, nodes: DataFrame, place: str) -> DataFrame:
        cut = self.cut

        def top(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("pos")
            n = -(-int(rows["n"].iloc[0]) // cut.size)
            return pd.DataFrame({"group": rows["group"].iloc[:1], "pos": rows["block"].iloc[:1], "n": [n], "digest": cut.tree(rows).rows[-1]})

        blocks = nodes.select("group", "pos", "n", "digest", cut.block().alias("block")).groupBy("group", "block")
        blocks.applyInPandas(top, "group string, pos long, n long, digest string").write.parquet(place)
        return nodes.sparkSession.read.parquet(place)

    def paths(self, tops: DataFrame) -> DataFrame:
        """``(group, block, path, ...)`` of the lowest tier's subtrees: siblings from above each subtree's top to the
        root. ``tops(group, path, ...)`` holds what stands above the groups' tops; its other columns are carried down.
        """
        paths = tops.withColumn("block", F.lit(0).cast("long"))
        for tier in reversed(self.tiers[1:-1]):
            paths = self.descend(tier, paths, ["group", "pos"]).withColumnRenamed("pos", "block")
        return paths

    def descend(self, nodes: DataFrame, paths: DataFrame, keep: list[str]) -> DataFrame:
        """Nodes of a tier with their whole paths, given those of their subtrees, and what else ``paths`` carries."""
        others = [c for c in paths.columns if c not in ("group", "block", "path")]
        columns, cut = [*keep, "path", *others], self.cut
        kinds = dict(nodes.dtypes) | {"path": PATH} | {c: k for c, k in paths.dtypes if c in others}

        def down(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):
                return pd.DataFrame(columns=columns)
            rows, tree, rest = cut.below(rows, above)
            steps = [[{"left": a, "right": b} for a, b in tree.path(at) + rest] for at in range(len(rows))]
            return rows[keep].assign(path=steps, **{c: above[c].iloc[0] for c in others})[columns]

        return self.met(nodes, paths).applyInPandas(down, ", ".join(f"`{c}` {kinds[c]}" for c in columns))

    def met(self, nodes: DataFrame, paths: DataFrame):
        """Nodes grouped by subtree, with the row that holds the path above it."""
        paths = paths.select(*[F.col(c).alias(c) for c in paths.columns])  # both sides may come from the same table
        return nodes.withColumn("block", self.cut.block()).groupBy("group", "block").cogroup(paths.groupBy("group", "block"))


def verify(leaves: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``leaves(doc_id, lang, leaf, changed)`` with ``subroot, root, proof_sha256, folded_root, verified``.

    ``changed`` is the leaf to fold into the tree instead of ``leaf``, null where the row is as it was. ``verified`` says
    whether the fold gives the root. ``proof_sha256`` is the digest of all siblings on the way to the root.
    """
    spark = leaves.sparkSession
    make_known(spark)
    folder = shared_folder(spark, "merkle")
    # A missing group sorts before all others, an empty one included.
    group = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    rows = leaves.select("doc_id", group.alias("group"), F.col("leaf").alias("digest"), "changed")
    rows.write.parquet(f"{folder}/leaves")
    rows = numbered(spark.read.parquet(f"{folder}/leaves"), "group", ["doc_id", "digest"], f"{folder}/placed")

    cut = Cut(depth)
    tree = Tree(rows, f"{folder}/groups", cut)
    named = tree.tops.select(F.lit("").alias("group"), F.col("group").alias("name"), "digest")
    groups = numbered(named, "group", ["name"], f"{folder}/tops")
    crown = Tree(groups, f"{folder}/crown", cut)
    roots = crown.tops.select("group", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    tops = crown.descend(groups, crown.paths(roots), ["name", "digest"]).select(
        F.col("name").alias("group"), F.col("digest").alias("subroot"), "root", "path")

    out = "doc_id " + dict(leaves.dtypes)["doc_id"] + ", leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def prove(key: tuple, docs: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame(columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
        docs, subtree, rest = cut.below(docs, above)
        kept, tail = states_of(rest), "".join(a + b for a, b in rest)
        subroot, root = above["subroot"].iloc[0], above["root"].iloc[0]
        proofs, folded = [], []
        for at, (leaf, changed) in enumerate(zip(docs["digest"], docs["changed"])):
            siblings = "".join(a + b for a, b in subtree.path(at)) + tail
            proofs.append(hashlib.sha256(siblings.encode()).hexdigest())
            digest = subtree.fold(at, changed if isinstance(changed, str) else leaf)
            for state, right in kept:
                digest = resumed(state, digest, right)
            folded.append(digest)
        return pd.DataFrame({
            "doc_id": docs["doc_id"], "leaf": docs["digest"], "subroot": subroot, "root": root,
            "proof_sha256": proofs, "folded_root": folded, "verified": [x == root for x in folded]})

    return tree.met(rows, tree.paths(tops)).applyInPandas(prove, out)


def tampered_leaves(documents: DataFrame) -> DataFrame:
    """``(doc_id, lang, leaf, changed)``: leaves of all rows; where 3 divides the checksum of the id, also the leaf with A-Z
    of the text in lower case."""
    text = F.col("text")
    plain = F.length(text) == F.octet_length(text)
    lower = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return documents.select("doc_id", "lang", leaf_digest().alias("leaf"), F.when(hit, leaf_digest({"text": lower})).alias("changed"))

"""Communities of bounded size by modularity, with connected members.

Louvain-style moves in rounds of joins. Every round carries out a set of changes that do not touch each other, so each
brings exactly the gain it was chosen for and modularity rises from round to round: groups merge in pairs, single nodes
change to a neighbouring group, and groups that a leaving node has torn apart are split again. Rounds end when no change
gains anything. Nodes are numbered, merged groups become the nodes of a smaller graph, and a round of moves computes
gains only where a group has changed, so late rounds are small. All are joins and aggregates by node or group.

A gain depends on the ties between two groups alone. So groups are dealt anew in every round into blocks with a bounded
number of ties, and a task changes the groups of its block until none of their changes gains, instead of one round of
joins for each; ties between blocks wait for another deal. A round of joins follows where blocks find nothing more.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import table_cutter
from .graph import connected_components, spanning_links

#: Gains below this are rounding.
LEAST_GAIN = 1e-12

#: How often a round picks changes among those left by what it has picked.
PASSES = 3

#: Ties that meet in one block, and the best share of more pairs than that which a round of merges looks at first.
BLOCK_TIES, FIRST_SHARE = 1_500_000, 0.25


def communities(edges: DataFrame, max_size: int = 10) -> DataFrame:
    """``(node, component, community)``: connected groups of at most ``max_size`` nodes of the edges ``(source, target,
    weight)``, which no merge of two groups and no move of a node between two groups improves.

    Edges between the same nodes add up; loops add nothing but their node. Ties of gains are settled by hashes.
    The community is named after its component and its smallest node.
    """
    cut = table_cutter(edges.sparkSession, "communities")
    pairs = edges.select(F.greatest("source", "target").alias("_a"), F.least("source", "target").alias("_b"), F.col("weight").cast("double").alias("weight"))
    pairs = cut(pairs.groupBy("_a", "_b").agg(F.sum("weight").alias("w")))
    # Numbers ascend with the names, so the smallest number is that of the smallest name.
    names = cut(pairs.select(F.explode(F.array("_a", "_b")).alias("name")).distinct().orderBy("name").select("name", F.monotonically_increasing_id().alias("node")))
    of = lambda side: names.select(F.col("name").alias(f"_{side}"), F.col("node").alias(side))
    numbered = cut(pairs.join(of("a"), "_a").join(of("b"), "_b").select("a", "b", "w"))
    ties = numbered.where("a <> b AND w > 0")
    components = cut(connected_components(spanning_links(numbered, "a", "b")))
    strength = ties.select(F.explode(F.array("a", "b")).alias("node"), "w").groupBy("node").agg(F.sum("w").alias("k"))
    groups = cut(components.join(strength, "node", "left").select("node", F.coalesce("k", F.lit(0.0)).alias("k"), F.col("node").alias("group")))
    total = ties.agg(F.sum("w")).first()[0] or 0.0
    settled = None
    while total:
        groups = _merge_all(ties, groups, total, max_size, cut)
        groups, left, settled = _move_all(ties, groups, total, max_size, cut, settled)
        if left is None:
            break
        groups = _split_torn(ties, groups, left, cut)
    smallest = groups.groupBy("group").agg(F.min("node").alias("_first"))
    found = components.join(groups.join(smallest, "group"), "node").select("node", "component", "_first")
    named = lambda number, name: names.select(F.col("node").alias(number), F.col("name").alias(name))
    return found.join(named("node", "_node"), "node").join(named("component", "_component"), "component").join(named("_first", "_name"), "_first").select(
        F.col("_node").alias("node"), F.col("_component").alias("component"),
        F.concat_ws("#", F.col("_component").cast("string"), F.col("_name").cast("string")).alias("community"))


def modularity(edges: DataFrame, members: DataFrame, node: str = "node", group: str = "community") -> DataFrame:
    """One row ``(modularity)``: the share of weight inside groups less what random ties of equal strength would give."""
    pairs = edges.where("source <> target").select("source", "target", F.col("weight").cast("double").alias("w"))
    of = lambda side: members.select(F.col(node).alias(side), F.col(group).alias(f"_g_{side}"))
    named = pairs.join(of("source"), "source").join(of("target"), "target")
    ends = named.select("w", F.explode(F.array(F.struct(F.col("_g_source").alias("g"), (F.col("_g_source") == F.col("_g_target")).alias("inner")),
                                               F.struct(F.col("_g_target").alias("g"), F.lit(False).alias("inner")))).alias("e"))
    sums = ends.groupBy("e.g").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("e.inner"), F.col("w")).otherwise(0.0)).alias("inside"))
    return sums.agg(F.sum("k").alias("_k"), F.sum("inside").alias("_in"), F.sum(F.col("k") * F.col("k")).alias("_sq")).select(
        F.when(F.col("_k") > 0, 2 * F.col("_in") / F.col("_k") - F.col("_sq") / (F.col("_k") * F.col("_k"))).alias("modularity"))


def _sizes(groups: DataFrame, name: str) -> DataFrame:
    """Number of nodes and strength of every group."""
    return groups.groupBy(F.col("group").alias(name)).agg(F.count("*").alias(f"n_{name}"), F.sum("k").alias(f"k_{name}"))


def _named(ties: DataFrame, groups: DataFrame) -> DataFrame:
    of = lambda side: groups.select(F.col("node").alias(side), F.col("group").alias(f"g{side}"), F.col("k").alias(f"k{side}"))
    return ties.join(of("a"), "a").join(of("b"), "b")


def _apart(gains: DataFrame, sides: tuple[str, str], cut) -> DataFrame | None:
    """Changes that share no group, best first: those that are the best of both their groups, then of what these leave.

    None if there is no change. Equal gains are settled by a hash that both groups of a change share.
    """
    kept = [c for c in gains.columns if c != "gain"]
    # One number of fixed width per change, gain before hash: its maximum is taken without sorting.
    part = lambda value: value.cast("decimal(18,0)")
    key = part(F.least(F.col("gain"), F.lit(0.999)) * F.lit(1e18)) * F.lit(10**18).cast("decimal(19,0)") + part(F.pmod(F.xxhash64(*sides, *kept), F.lit(10**18)))
    gains = cut(gains.select(*kept, key.alias("_key"), F.monotonically_increasing_id().alias("_id")))
    chosen, open_ = None, gains
    for _ in range(PASSES):
        best = open_.select("_key", "_id", F.explode(F.array(*sides)).alias("_at")).groupBy("_at").agg(F.max_by("_id", "_key").alias("_id"))
        agreed = best.groupBy("_id").agg(F.count("*").alias("_n")).where("_n = 2").select("_id")
        agreed = cut(gains.join(agreed, "_id", "left_semi").select(*kept))
        if agreed.isEmpty():
            break
        chosen = agreed if chosen is None else chosen.unionByName(agreed)
        taken = agreed.select(F.explode(F.array(*sides)).alias("_taken"))
        for side in sides:
            open_ = open_.join(taken.withColumnRenamed("_taken", side), side, "left_anti")
    return chosen


def _blocks(n: int) -> int:
    """Blocks of groups, so that of ``n`` ties those inside a block are about as many as may meet in a task."""
    return max(1, int(np.ceil(np.sqrt(n / BLOCK_TIES))))


def _inside(pairs: DataFrame, x: str, y: str, blocks: int, deal: int) -> DataFrame:
    """Pairs with both groups in one block, with its number ``_block``."""
    of = lambda side: F.pmod(F.xxhash64(side, F.lit(deal)), F.lit(blocks)).cast("int")
    return pairs.withColumn("_block", of(x)).where(F.col("_block") == of(y))


def _best_of_both(x: np.ndarray, y: np.ndarray, gain: np.ndarray, mark: np.ndarray, n: int) -> np.ndarray:
    """Places of the changes that are the best of both their groups, equal gains by their marks."""
    rank = np.empty(len(gain), np.int64)
    rank[np.lexsort((mark, gain))] = np.arange(len(gain))
    best = np.full(n, -1)
    np.maximum.at(best, x, rank)
    np.maximum.at(best, y, rank)
    return np.flatnonzero((best[x] == rank) & (best[y] == rank))


def _mark(*numbers: np.ndarray) -> np.ndarray:
    mark = np.zeros(len(numbers[0]), np.uint64)
    for part in numbers:
        mark = (mark ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mark ^= mark >> np.uint64(29)
    return mark


def _summed(keys: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, weights=w, minlength=len(found))


def _block_merges(total: float, max_size: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Merge the groups of a block until no merge of its pairs gains: ``(group, into, n, k_into)`` of all groups that change."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["x", "y"])
        codes, names = pd.factorize(np.concatenate([rows["x"], rows["y"]]), sort=True)
        x, y = np.split(codes, 2)
        n, k = np.zeros(len(names), np.int64), np.zeros(len(names))
        for side, at in (("x", x), ("y", y)):
            n[at], k[at] = rows[f"n_{side}"], rows[f"k_{side}"]
        w, into = rows["w"].to_numpy(np.float64), np.arange(len(names))
        while len(w):
            gain = w / total - k[x] * k[y] / (2 * total * total)
            good = np.flatnonzero(gain > LEAST_GAIN)
            picked = good[_best_of_both(x[good], y[good], gain[good], _mark(names[x[good]], names[y[good]]), len(names))]
            if not len(picked):
                break
            now = np.arange(len(names))
            now[x[picked]] = y[picked]
            n[y[picked]] += n[x[picked]]
            k[y[picked]] += k[x[picked]]
            into, x, y = now[into], now[x], now[y]
            fits = (x != y) & (n[x] + n[y] <= max_size)
            keys, w = _summed(np.maximum(x, y)[fits] * len(names) + np.minimum(x, y)[fits], w[fits])
            x, y = np.divmod(keys, len(names))
        grown = np.flatnonzero(np.bincount(into, minlength=len(names))[into] > 1)
        return pd.DataFrame({"group": names[grown], "into": names[into[grown]], "n": n[into[grown]], "k_into": k[into[grown]]})

    return merge


def _block_moves(total: float, max_size: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Move nodes between the groups of a block until no move gains: ``(node, own, to)`` of the nodes that end in another group."""

    def move(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["a", "b"])
        codes, nodes = pd.factorize(np.concatenate([rows["a"], rows["b"]]), sort=True)
        group_codes, names = pd.factorize(np.concatenate([rows["ga"], rows["gb"]]), sort=True)
        group, k = np.zeros(len(nodes), np.int64), np.zeros(len(nodes))
        group[codes], k[codes] = group_codes, np.concatenate([rows["ka"], rows["kb"]])
        first, many = group.copy(), len(names)
        size, strength = np.bincount(group, minlength=many), np.bincount(group, weights=k, minlength=many)
        a, b = np.split(codes, 2)
        w, real = rows["w"].to_numpy(np.float64), a != b  # the others only name a node
        source, target, w = np.concatenate([a[real], b[real]]), np.concatenate([b[real], a[real]]), np.tile(w[real], 2)
        inner, changed = np.zeros(len(nodes)), np.ones(many, dtype=bool)
        node, to, gain = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        while True:
            # As between the rounds of joins, gains are computed anew only where one of the two groups has changed.
            near = changed[group[source]] | changed[group[target]]
            keys, sums = _summed(source[near] * many + group[target[near]], w[near])
            at, toward = np.divmod(keys, many)
            own = group[at] == toward
            inner[changed[group]] = 0.0
            inner[at[own]] = sums[own]
            at, toward, sums = at[~own], toward[~own], sums[~own]
            new = (sums - inner[at]) / total - k[at] * (strength[toward] - strength[group[at]] + k[at]) / (2 * total * total)
            good = (new > LEAST_GAIN) & (size[toward] < max_size)
            kept = ~(changed[group[node]] | changed[to])
            node, to, gain = (np.concatenate(c) for c in ((node[kept], at[good]), (to[kept], toward[good]), (gain[kept], new[good])))
            picked = _best_of_both(group[node], to, gain, _mark(nodes[node], names[to]), many)
            if not len(picked):
                break
            changed = np.zeros(many, dtype=bool)
            who, before, after = node[picked], group[node[picked]], to[picked]
            changed[before] = changed[after] = True
            gone = np.isin(node, who)
            node, to, gain = node[~gone], to[~gone], gain[~gone]
            group[who] = after
            for sums, each in ((size, 1), (strength, k[who])):
                sums[before] -= each
                sums[after] += each
        moved = np.flatnonzero(group != first)
        return pd.DataFrame({"node": nodes[moved], "own": names[first[moved]], "to": names[group[moved]]})

    return move


def _merge_all(ties: DataFrame, groups: DataFrame, total: float, max_size: int, cut) -> DataFrame:
    """Merge pairs of groups, until no merge gains. Groups only grow: pairs that are too large leave for good."""
    growing = groups.join(_sizes(groups, "group").where(F.col("n_group") < max_size).select("group"), "group", "left_semi")
    crossing = _named(ties, growing).where("ga <> gb").groupBy(F.greatest("ga", "gb").alias("x"), F.least("ga", "gb").alias("y")).agg(F.sum("w").alias("w"))
    fits = F.col("n_x") + F.col("n_y") <= max_size
    sizes = cut(_sizes(groups, "x"))
    other = sizes.select(F.col("x").alias("y"), F.col("n_x").alias("n_y"), F.col("k_x").alias("k_y"))
    open_ = cut(crossing.join(sizes, "x").join(other, "y").where(fits))
    gain = F.col("w") / total - F.col("k_x") * F.col("k_y") / (2 * total * total)
    kind, share, deal = groups.schema["group"].dataType.simpleString(), FIRST_SHARE, 0
    while True:
        n = open_.count()
        # A merge that gains by a part of the ties of its groups gains by all of them: strong pairs may go first.
        part, whole = open_, n <= BLOCK_TIES
        if not whole:
            least = open_.select(gain.alias("gain")).approxQuantile("gain", [1 - share], 0.01)[0]
            part = open_.where(gain >= least)
        inside = _inside(part, "x", "y", 1 if whole else _blocks(int(n * share)), deal)
        merged = cut(inside.groupBy("_block").applyInPandas(_block_merges(total, max_size), f"group {kind}, into {kind}, n long, k_into double"))
        if merged.isEmpty() and whole:
            return groups
        if merged.isEmpty():
            chosen = _apart(open_.withColumn("gain", gain).where(F.col("gain") > LEAST_GAIN).drop("w"), ("x", "y"), cut)
            if chosen is None:
                return groups
            merged = chosen.select(F.explode(F.array("x", "y")).alias("group"), F.col("y").alias("into"),
                                   (F.col("n_x") + F.col("n_y")).alias("n"), (F.col("k_x") + F.col("k_y")).alias("k_into"))
        groups = cut(groups.join(merged.select("group", "into"), "group", "left").select("node", "k", F.coalesce("into", "group").alias("group")))
        if whole:
            return groups
        share, deal = min(1.0, 2 * share), deal + 1
        ends = []
        for side in ("x", "y"):
            now = merged.select(F.col("group").alias(side), F.col("into").alias("_g"), F.col("n").alias("_n"), F.col("k_into").alias("_k"))
            open_ = open_.join(now, side, "left").withColumn(f"_{side}", F.struct(
                F.coalesce("_g", side).alias("g"), F.coalesce("_n", f"n_{side}").alias("n"), F.coalesce("_k", f"k_{side}").alias("k"))).drop("_g", "_n", "_k")
            ends.append(F.col(f"_{side}"))
        higher = F.when(ends[0]["g"] > ends[1]["g"], ends[0]).otherwise(ends[1])
        lower = F.when(ends[0]["g"] > ends[1]["g"], ends[1]).otherwise(ends[0])
        told = open_.where(ends[0]["g"] != ends[1]["g"]).select(higher.alias("h"), lower.alias("l"), "w").select(
            F.col("h.g").alias("x"), F.col("l.g").alias("y"), "w", F.col("h.n").alias("n_x"), F.col("h.k").alias("k_x"), F.col("l.n").alias("n_y"), F.col("l.k").alias("k_y"))
        of_both = [F.max(c).alias(c) for c in ("n_x", "k_x", "n_y", "k_y")]
        open_ = cut(told.where(fits).groupBy("x", "y").agg(F.sum("w").alias("w"), *of_both))


def _move_all(
    ties: DataFrame, groups: DataFrame, total: float, max_size: int, cut, settled: tuple[DataFrame, DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame | None, tuple[DataFrame, DataFrame]]:
    """Move nodes to neighbouring groups, until no move gains.

    Returns the groups, those of them that a node has left or joined (None if none), and what the next call may build on: the groups
    and the nodes' ties inside them. A gain depends on two groups alone: after the first round, and after a call on groups
    that were settled before, gains are computed anew only where one of the two has changed.
    """
    left, inner, gains, hot, changed, deal = None, None, None, None, None, 0
    kind = groups.schema["node"].dataType.simpleString()
    n_ties, n_nodes = ties.count(), groups.count()

    def in_blocks(members: DataFrame, blocks: int) -> DataFrame:
        nonlocal deal
        # Loops name the nodes, so that a block knows the whole size of its groups.
        loops = members.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("w"))
        inside = _inside(_named(ties.unionByName(loops), members), "ga", "gb", blocks, deal)
        deal += 1
        return cut(inside.groupBy("_block").applyInPandas(_block_moves(total, max_size), f"node {kind}, own {kind}, to {kind}"))

    def applied(chosen: DataFrame) -> DataFrame:
        return cut(groups.join(chosen.select("node", F.col("to").alias("_into")), "node", "left").select("node", "k", F.coalesce("_into", "group").alias("group")))

    touched = lambda chosen: chosen.select(F.explode(F.array("own", "to")).alias("group")).distinct()
    if settled is None and _blocks(n_ties) > 1:
        # Most moves are found without looking at all gains, in blocks of all groups, as long as these find many.
        most, now = 0, 1
        while now > most / 3:
            chosen = in_blocks(groups, _blocks(n_ties))
            now = chosen.count()
            if now:
                left = touched(chosen) if left is None else left.unionByName(touched(chosen))
                groups, most = applied(chosen), max(most, now)
    if settled is not None:
        before, inner = settled
        renamed = before.select("node", F.col("group").alias("_before")).join(groups, "node").where("_before <> group")
        hot = cut(groups.join(renamed.select(F.explode(F.array("_before", "group")).alias("group")), "group", "left_semi").select("node"))
    while True:
        near = ties
        if hot is not None:
            for side in ("a", "b"):
                near = near.join(hot.select(F.col("node").alias(side), F.lit(True).alias(f"_{side}")), side, "left")
            near = near.where("_a OR _b").drop("_a", "_b")
        named = _named(near, groups)
        toward = named.select(F.col("a").alias("node"), F.col("ga").alias("own"), F.col("ka").alias("k"), F.col("gb").alias("to"), "w").unionByName(
            named.select(F.col("b").alias("node"), F.col("gb").alias("own"), F.col("kb").alias("k"), F.col("ga").alias("to"), "w"))
        sums = cut(toward.groupBy("node", "own", "k", "to").agg(F.sum("w").alias("w")))
        fresh = sums.where("own = to").select("node", F.col("w").alias("w_own"))
        inner = fresh if inner is None else cut(inner.join(hot, "node", "left_anti").unionByName(fresh))
        outer = sums.where("own <> to").join(inner, "node", "left").join(_sizes(groups, "to"), "to").where(F.col("n_to") < max_size).join(_sizes(groups, "own"), "own")
        gain = (F.col("w") - F.coalesce("w_own", F.lit(0.0))) / total - F.col("k") * (F.col("k_to") - F.col("k_own") + F.col("k")) / (2 * total * total)
        found = outer.select("node", "own", "to", gain.alias("gain")).where(F.col("gain") > LEAST_GAIN)
        if gains is not None:
            for side in ("own", "to"):
                gains = gains.join(changed.withColumnRenamed("group", side), side, "left_anti")
            found = found.unionByName(gains)
        gains = cut(found)
        if gains.isEmpty():
            return groups, left, (groups, inner)
        members = cut(groups.join(touched(gains), "group", "left_semi"))
        chosen = in_blocks(members, _blocks(int(n_ties * (members.count() / n_nodes) ** 2)))
        if chosen.isEmpty():
            chosen = _apart(gains, ("own", "to"), cut)
        changed = touched(chosen)
        left = changed if left is None else left.unionByName(changed)
        groups = applied(chosen)
        hot = cut(groups.join(changed, "group", "left_semi").select("node"))


def _split_torn(ties: DataFrame, groups: DataFrame, left: DataFrame, cut) -> DataFrame:
    """Make a group of each connected part of the groups that a node has left; every group is named after its smallest node."""
    kind = groups.schema["node"].dataType.simpleString()
    members = cut(groups.join(left.distinct(), "group", "left_semi").select("node", "k", "group"))
    inner = _named(ties, members).where("ga = gb").select(F.col("ga").alias("group"), "a", "b")
    alone = members.select("group", F.col("node").alias("a"), F.col("node").alias("b"))

    def parts(rows: pd.DataFrame) -> pd.DataFrame:
        lowest = {n: n for n in rows["a"]} | {n: n for n in rows["b"]}
        changed = True
        while changed:
            changed = False
            for a, b in zip(rows["a"], rows["b"]):
                low = min(lowest[a], lowest[b])
                changed |= lowest[a] != low or lowest[b] != low
                lowest[a] = lowest[b] = low
        return pd.DataFrame({"node": list(lowest), "part": list(lowest.values())})

    found = inner.unionByName(alone).groupBy("group").applyInPandas(parts, f"node {kind}, part {kind}")
    split = cut(groups.join(found, "node", "left").select("node", "k", "group", F.coalesce("part", F.lit(-1)).alias("part")))
    smallest = split.groupBy("group", "part").agg(F.min("node").alias("_first"))
    return cut(split.join(smallest, ["group", "part"]).select("node", "k", F.col("_first").alias("group")))

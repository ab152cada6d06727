"""Undirected graphs as edge tables ``(src, dst)`` with ``src < dst``.

Searches run from all roots at once, one level per round. A round is a join of
the last level with the edges; it is written out before the next one starts.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from reviewmine.operators.overlap import overlapping_pairs
from reviewmine.sources.shared import attach, materialize

BATCH_CELLS = 2_000_000_000  # (root, node) cells searched at a time
MUCH = 1_000_000_000  # nodes times edges from which dense components are searched in place
DENSE = 5120  # nodes of such a component at most; a task holds some matrices of so many rows and columns
SMALL, SPARSE = 512, 50  # nodes for which any component counts as dense, and squared nodes to an edge for which a larger one does
ROOTS, BLOCK, STRIP = 1024, 128, 512  # roots of a task, roots searched at a time, columns multiplied at a time
LARGE = 1e200  # path counts above are scaled down, where only their ratios matter


def co_review_graph(pairs: DataFrame, threshold: int) -> DataFrame:
    """Edges ``(src, dst)`` between users with at least ``threshold`` businesses in common."""
    return overlapping_pairs(pairs, threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def arcs(edges: DataFrame) -> DataFrame:
    """Both directions of every edge: ``(node, next)``."""
    there = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    return there.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("next")))


def degrees(edges: DataFrame) -> DataFrame:
    """Nodes with an edge, and how many they have."""
    return arcs(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def _levels(roots: DataFrame, steps: DataFrame) -> list[DataFrame]:
    """Breadth-first levels ``(root, node, sigma)``; ``sigma`` counts the shortest paths to the node.

    A step from one level leads to the next, the same or the previous level, so
    only those two have to be excluded.
    """
    one = F.lit(1).cast("decimal(38,0)")  # path counts are whole numbers; one of 39 digits fails the job
    start = roots.select(F.col("node").alias("root"), "node", one.alias("sigma"))
    levels = [materialize(start)]
    while True:
        reached = levels[-1].join(steps, "node").groupBy("root", "next").agg(F.sum("sigma").cast("decimal(38,0)").alias("sigma"))
        level, n, _ = _new_level(reached, levels)
        if not n:
            return levels
        levels.append(level)


def _new_level(reached: DataFrame, levels: list[DataFrame]) -> tuple[DataFrame, int, float | None]:
    """What is reached and not on the last two levels, the number of its rows and their largest path count."""
    near = reduce(DataFrame.unionByName, [level.select("root", "node") for level in levels[-2:]])
    fresh = reached.withColumnRenamed("next", "node").join(near, ["root", "node"], "left_anti")
    level, seen = counted(fresh, F.max(F.col("sigma").cast("double")).alias("most"))
    return level, seen["n"], seen["most"]


def counted(df: DataFrame, *more: Column) -> tuple[DataFrame, dict]:
    """The written table, and its number of rows ``n`` (and other aggregates) as seen by the writing job."""
    seen = Observation()
    table = materialize(df.observe(seen, F.count(F.lit(1)).alias("n"), *more))
    return table, seen.get


def _batches(nodes: DataFrame, count: int) -> list[DataFrame]:
    """All nodes as roots, in hashed batches when all cells at once would be too many."""
    n = max(1, -(-count * count // BATCH_CELLS))
    return [nodes.where(F.pmod(F.xxhash64("node"), F.lit(n)) == i) if n > 1 else nodes for i in range(n)]


def shortest_paths(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``(root, node, level, sigma)`` for what the roots reach, each root itself at level 0.

    ``roots`` has a column ``node``; without it, the smallest node of each component is one.
    """
    if roots is None:
        labels = connected_components(edges)
        roots = materialize(labels.select(F.col("component").alias("node")).distinct())
    levels = _levels(roots, arcs(edges))
    found = [level.withColumn("level", F.lit(i)) for i, level in enumerate(levels)]
    return reduce(DataFrame.unionByName, found).select("root", "node", "level", "sigma")


def edge_betweenness(edges: DataFrame) -> DataFrame:
    """``(src, dst, betweenness)``: over all pairs of nodes, the share of their shortest paths using the edge."""
    return searched(edges)[0]


def searched(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Betweenness ``(src, dst, betweenness)``, and the smallest node of each one's component: ``(node, component)``.

    Leaves are peeled off first, round by round, each adding its weight (the
    nodes it stands for) to its neighbour. All paths from a peeled node's side
    to the other side use its edge, so that edge scores one weight times the
    other. Only the rest, where every node is on the way between others, is
    searched, with the weights of both ends of each pair.
    """
    core, weights, rounds = _peeled(materialize(edges.select("src", "dst")))
    scores, known = _search(core, weights)
    for gone in reversed(rounds):
        above = known.select(F.col("node").alias("parent"), "label", "total")
        part = materialize(gone.join(above, "parent").select("node", "parent", "weight", "label", "total"))
        value = F.col("weight") * (F.col("total") - F.col("weight"))
        scores = scores.unionByName(part.select(*_edge("node", "parent"), value.alias("betweenness")))
        known = known.unionByName(part.select("node", "label", "total"))
    if not rounds:  # labels are smallest nodes, unless smaller ones have been peeled off
        return scores, known.select("node", F.col("label").alias("component"))
    names = known.groupBy("label").agg(F.min("node").alias("component"))
    return scores, attach(known, names, "label").select("node", "component")


def _peeled(edges: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The edges between nodes that are no leaves, all nodes left as ``(node, weight)``, and what each round has peeled.

    A round gives ``(node, parent, weight)``. There are at most half as many
    rounds as the longest path has edges.
    """
    left, rounds = edges, []
    weights = degrees(left).select("node", F.lit(1.0).alias("weight"))
    while True:
        leaves = arcs(left).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("next").alias("parent")).where("n = 1")
        # of two leaves that have only each other, the larger one goes
        twins = leaves.select(F.col("node").alias("parent"), F.lit(True).alias("twin"))
        gone = leaves.join(twins, "parent", "left").where(F.col("twin").isNull() | (F.col("node") > F.col("parent")))
        gone, seen = counted(gone.join(weights, "node").select("node", "parent", "weight"))
        if not seen["n"]:
            return left, weights, rounds
        rounds.append(gone)
        kept = weights.join(gone.select("node"), "node", "left_anti")
        moved = kept.unionByName(gone.select(F.col("parent").alias("node"), "weight"))
        weights = materialize(moved.groupBy("node").agg(F.sum("weight").alias("weight")))
        left = materialize(left.join(gone.select(*_edge("node", "parent")), ["src", "dst"], "left_anti"))


def _search(edges: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Betweenness of edges between weighted nodes, and ``(node, label, total)``: each one's component and its weight.

    From the deepest level up, every node passes its weight plus what it got
    from below to its parents, split by their path counts.
    """
    alone = weights.join(edges.select(F.explode(F.array("src", "dst")).alias("node")), "node", "left_anti")
    alone = alone.select("node", F.col("node").alias("label"), F.col("weight").alias("total"))
    if edges.isEmpty():
        return edges.select("src", "dst", F.lit(0.0).alias("betweenness")), alone
    nodes, seen = counted(arcs(edges).select("node").distinct().join(weights, "node"))
    scores, known = [], [alone]
    if seen["n"] * edges.count() > MUCH:
        found, labels, edges, nodes = _search_dense(edges, nodes)
        scores, known = [found], [alone, labels]
        nodes, seen = counted(nodes)
        if not seen["n"]:
            return found.select("src", "dst", (F.col("flow") / 2).alias("betweenness")), reduce(DataFrame.unionByName, known)
    steps = arcs(edges).join(nodes.toDF("next", "next_weight"), "next").select("node", "next", "next_weight")
    steps = materialize(steps)
    batches = _batches(nodes, seen["n"])
    for roots in batches:
        levels = _weighted_levels(roots, steps)
        whole = reduce(DataFrame.unionByName, [level.select("root", "node", "weight") for level in levels])
        whole = whole.groupBy("root").agg(F.min("node").alias("label"), F.sum("weight").alias("total"))
        known.append(whole.withColumnRenamed("root", "node") if len(batches) == 1 else materialize(whole.withColumnRenamed("root", "node")))
        below, flows = None, []
        for parents, level in zip(levels[-2::-1], levels[:0:-1], strict=True):
            credit: Column = F.col("weight")
            if below is not None:
                got = below.groupBy("root", F.col("parent").alias("node")).agg(F.sum("flow").alias("got"))
                level = level.join(got, ["root", "node"], "left")
                credit = credit + F.coalesce("got", F.lit(0.0))
            up = level.select("root", "node", (credit / F.col("paths")).alias("share"))
            up = up.join(steps.select("node", F.col("next").alias("parent")), "node")
            above = parents.select("root", F.col("node").alias("parent"), "sigma", "root_weight")
            flow = up.join(above, ["root", "parent"]).withColumn("flow", F.col("share") * F.col("sigma"))
            below = materialize(flow.select("root", "node", "parent", "flow", "root_weight"))
            sums = F.sum(F.col("flow") * F.col("root_weight")).alias("flow")
            flows.append(below.groupBy(*_edge("node", "parent")).agg(sums))
        summed = reduce(DataFrame.unionByName, flows).groupBy("src", "dst").agg(F.sum("flow").alias("flow"))
        # a batch leaves one sum per edge, so the plan does not grow with the number of levels of all batches
        scores.append(summed if len(batches) == 1 else materialize(summed))
    total = reduce(DataFrame.unionByName, scores).groupBy("src", "dst").agg((F.sum("flow") / 2).alias("betweenness"))
    return total, reduce(DataFrame.unionByName, known)


def _search_dense(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What ``_search`` finds in dense components ``(src, dst, flow)`` and ``(node, label, total)``, and the edges and nodes of the others.

    In a dense component a level is reached over many edges at once, so a task multiplies the levels of a block of
    roots by the component's matrix, where a join makes a row for each step.
    """
    labels = materialize(connected_components(edges).toDF("node", "component"))
    owned = materialize(attach(edges, labels.withColumnRenamed("node", "src"), "src").select("component", "src", "dst"))
    members = materialize(nodes.join(labels, "node").select("component", "node", "weight"))
    size = owned.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    size = size.join(members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total")), "component")
    dense = (F.col("n") <= SMALL) | ((F.col("n") <= DENSE) & (F.col("m") * SPARSE >= F.col("n") * F.col("n")))
    size = materialize(size.where(dense).select("component", "total", F.ceil(F.col("n") / ROOTS).cast("int").alias("parts")))
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    weightless = owned.select("component", "src", "dst", F.lit(None).cast("double").alias("weight"))
    rows = weightless.unionByName(members.select("component", F.col("node").alias("src"), F.lit(None).cast(nodes.schema["node"].dataType).alias("dst"), "weight"))
    rows = attach(rows, size, "component").select("component", part, "src", "dst", "weight")
    kind = nodes.schema["node"].dataType.simpleString()
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(tasks, "component", "part").groupBy("component", "part")
    found = found.applyInArrow(lambda key, rows: _flows(rows, key[1].as_py()), f"src {kind}, dst {kind}, flow double")
    found = materialize(found.groupBy("src", "dst").agg(F.sum("flow").alias("flow")))
    known = materialize(members.join(size, "component").select("node", F.col("component").alias("label"), "total"))
    edges = materialize(owned.join(size, "component", "left_anti").select("src", "dst"))
    return found, known, edges, members.join(size, "component", "left_anti").select("node", "weight")


def _flows(rows: pa.Table, part: int) -> pa.Table:
    """Flow over the edges of a component from one part of its nodes: rows ``(src, dst)``, and ``(src, weight)`` of its nodes."""
    is_node = pc.is_valid(rows.column("weight"))
    own = rows.filter(is_node).sort_by("src")
    ends = rows.filter(pc.invert(is_node)).select(["src", "dst"])
    nodes, weight = own.column("src").combine_chunks(), own.column("weight").to_numpy()
    src, dst = (pc.index_in(ends.column(c), nodes).to_numpy() for c in ("src", "dst"))
    near = np.zeros((len(nodes), len(nodes)), np.uint8)
    near[src, dst] = near[dst, src] = 1
    total = np.zeros(near.shape)
    for start in range(part * ROOTS, min((part + 1) * ROOTS, len(nodes)), BLOCK):
        _add_flows(total, near, weight, np.arange(start, min(start + BLOCK, (part + 1) * ROOTS, len(nodes))))
    return ends.append_column("flow", pa.array(total[src, dst] + total[dst, src]))


def _add_flows(total: np.ndarray, near: np.ndarray, weight: np.ndarray, roots: np.ndarray) -> None:
    """Add the flow from each node to its parents, over all roots of a block and times their weights."""
    strips = [slice(at, at + STRIP) for at in range(0, len(near), STRIP)]

    def times(level: np.ndarray) -> np.ndarray:
        return np.hstack([level @ near[:, strip].astype(float) for strip in strips])

    shape = len(roots), len(near)
    sigma, depth = np.zeros(shape), np.full(shape, -1, np.int32)
    sigma[np.arange(len(roots)), roots], depth[np.arange(len(roots)), roots] = 1.0, 0
    paths, level, deepest = sigma.copy(), sigma, 0
    while True:
        level = times(level)
        level[depth >= 0] = 0.0
        new = level > 0
        if not new.any():
            break
        deepest += 1
        depth[new], paths[new] = deepest, level[new]
        most = level.max(axis=1, keepdims=True)
        level = level / np.where(most > LARGE, most, 1.0)
        sigma = np.where(new, level, sigma)
    got = np.zeros(shape)
    for at in range(deepest, 0, -1):
        share = np.divide(weight + got, paths, out=np.zeros(shape), where=depth == at)
        above = np.where(depth == at - 1, sigma, 0.0)
        got += times(share) * above
        share *= weight[roots][:, None]
        for strip in strips:
            total[:, strip] += share.T @ above[:, strip]


def _weighted_levels(roots: DataFrame, steps: DataFrame) -> list[DataFrame]:
    """Levels ``(root, root_weight, node, weight, sigma, paths)`` from roots ``(node, weight)``.

    Only ratios of path counts are needed. ``paths`` is the sum over a node's
    parents of their ``sigma``, and so is ``sigma``, unless the counts of a
    level have grown out of range and are divided by the largest one of their root.
    """
    start = roots.select(
        F.col("node").alias("root"), F.col("weight").alias("root_weight"), "node", "weight", F.lit(1.0).alias("sigma"), F.lit(1.0).alias("paths")
    )
    levels = [start]
    while True:
        met = levels[-1].select("root", "root_weight", "node", "sigma").join(steps, "node")
        reached = met.groupBy("root", "next").agg(
            F.max("root_weight").alias("root_weight"), F.max("next_weight").alias("weight"), F.sum("sigma").alias("sigma")
        )
        level, n, most = _new_level(reached.withColumn("paths", F.col("sigma")), levels)
        if not n:
            return levels
        if most > LARGE:
            largest = level.groupBy("root").agg(F.max("sigma").alias("largest"))
            level = attach(level, largest, "root").withColumn("sigma", F.col("sigma") / F.col("largest")).drop("largest")
            level = materialize(level)
        levels.append(level)


def _edge(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")]


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for all nodes with an edge; a component is named by its smallest node.

    Alternates two steps until nothing changes: every node links its larger
    neighbours to the smallest node it sees, then all its smaller ones. The
    number of rounds grows with the logarithm of the size, not the diameter.
    """
    links = materialize(edges.where("src <> dst").select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct())
    state = _state(links)
    while True:
        ends = arcs(links.select(F.col("lo").alias("src"), F.col("hi").alias("dst")))
        lowest = materialize(ends.groupBy("node").agg(F.min("next").alias("low")))
        large = (
            ends.where(F.col("next") > F.col("node"))
            .join(lowest, "node")
            .select(F.col("next").alias("hi"), F.least("low", "node").alias("lo"))
            .distinct()
        )
        large = materialize(large)
        lowest = materialize(large.groupBy("hi").agg(F.min("lo").alias("low")))
        small = large.join(lowest, "hi").where(F.col("lo") != F.col("low"))
        small = small.select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
        links = materialize(small.unionByName(lowest.select("hi", F.col("low").alias("lo"))).distinct())
        before, state = state, _state(links)
        if state == before:
            break
    leaves = links.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    centres = links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return leaves.unionByName(centres)


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def community_scores(edges: DataFrame, communities: DataFrame, total_edges: int) -> DataFrame:
    """The part of the modularity each community contributes: ``(community, score)``.

    Inner edges and summed degrees per community give the same value as the sum
    over all pairs of its nodes, without the pairs.
    """
    ends = edges.join(communities.toDF("src", "community"), "src").join(communities.toDF("dst", "other"), "dst")
    inner = ends.where(F.col("community") == F.col("other")).groupBy("community").agg(F.count(F.lit(1)).alias("inner"))
    reach = degrees(edges).join(communities, "node").groupBy("community").agg(F.sum("degree").alias("reach"))
    share = F.coalesce("inner", F.lit(0)) / total_edges - F.pow(F.col("reach") / (2 * total_edges), 2)
    return reach.join(inner, "community", "left").select("community", share.alias("score"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Modularity of ``(node, community)`` against the degrees and edge count of the given graph."""
    total = edges.count()
    return community_scores(edges, communities.toDF("node", "community"), total).agg(F.sum("score").alias("q"))

"""Connected components by contraction, as joins and partial aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import Scratch, broadcast_if_small
from ._memory import lean

#: Edges that one task joins by itself: 32 MB, and about 200 MB while it works.
TASK_EDGES = 2_000_000


def _leasts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges, ascending, and for each the least node it is connected to."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while (label[x] != label[y]).any():
        least = np.minimum(label[x], label[y])
        for end in (x, y):
            np.minimum.at(label, label[end].copy(), least)
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of one star for each set of nodes that the given edges connect: (node, the least node of the set)."""
    nodes, leasts = _leasts(a, b)
    other = nodes != leasts
    return nodes[other], leasts[other]


def _in_one_task(edges: DataFrame) -> DataFrame:
    """node, parent, its component's least node, for edges (a, b) of longs that were counted and found few."""

    def join(stream):
        none = np.zeros(0, np.int64)
        held = [(none, none)] + [tuple(np.asarray(c, np.int64) for c in batch.columns) for batch in stream]
        nodes, leasts = _leasts(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(leasts)], ["node", "parent"])

    return edges.coalesce(1).mapInArrow(lean(join), "node long, parent long")


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (one of its nodes, always the same one) for every node of the edges. Loops and repeated edges do no harm.

    Edges of longs that were counted and are at most TASK_EDGES, at the start or after some rounds, are joined in one task; else
    in each round every node takes as parent the node of least hash among itself and its
    neighbours, and then the parent's parent; edges are renamed by parents, and those that became loops go. As hashes are
    in random order, rounds grow with the logarithm of a path's length and each has a fraction of the edges of the last. Parents
    are aggregated on the map side, so a hub is one row a task; joins are broadcast where the nodes were counted and
    found few, else they have two plain exchanges, which AQE splits at hubs. Rounds are written to the shared folder; ids are not null.
    """
    left = scratch.cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")), "edges")
    rounds: list[DataFrame] = []
    while (count := left.count()) or not rounds:
        if count <= TASK_EDGES and all(kind == "bigint" for _, kind in left.dtypes):
            rounds.append(scratch.cut(_in_one_task(left), "parents"))
            break
        both = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        rank = lambda x: F.struct(F.xxhash64(x, F.lit(len(rounds))).alias("hash"), x.alias("parent"))
        nearest = both.groupBy(F.col("e.a").alias("node")).agg(F.min(rank(F.col("e.b"))).alias("least"))
        near = scratch.cut(nearest.select("node", F.least("least", rank(F.col("node")))["parent"].alias("parent")), "near")
        parents = scratch.cut(
            near.join(broadcast_if_small(near.select(F.col("node").alias("parent"), F.col("parent").alias("further"))), "parent").select("node", F.col("further").alias("parent")), "parents"
        )
        scratch.drop(near)
        rounds.append(parents)
        of = lambda end: broadcast_if_small(parents.select(F.col("node").alias(end), F.col("parent").alias(f"{end}_parent")))
        renamed = left.filter("a <> b").join(of("a"), "a").join(of("b"), "b").filter("a_parent <> b_parent")
        fewer = scratch.cut(renamed.select(F.least("a_parent", "b_parent").alias("a"), F.greatest("a_parent", "b_parent").alias("b")).distinct(), "edges")
        scratch.drop(left)
        left = fewer
    scratch.drop(left)
    named = rounds[0].select("node", F.col("parent").alias("component"))
    if len(rounds) == 1:
        return named
    for parents in rounds[1:]:
        further = broadcast_if_small(parents.select(F.col("node").alias("component"), "parent"))
        named = named.join(further, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
    out = scratch.cut(named, "components")
    scratch.drop(*rounds)
    return out

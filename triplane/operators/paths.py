"""Reachability over edges [s, v] with set semantics: it ends on cycles, and every pair comes once.

The fixpoint is semi-naive: each round joins only the pairs that are new. A round's pairs are
checkpointed, which cuts the lineage and survives the loss of executors. Hierarchies of at most SMALL
edges, as those of classes and places mostly are, take one job instead: at most SMALL + 1 edges come to
the driver, which decides by that whether it follows them itself.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import numbers_frame, use_checkpoints

#: Edges and pairs up to which the driver follows a hierarchy itself.
SMALL, SMALL_PAIRS = 20_000, 200_000


def _steps(edges: DataFrame) -> dict | None:
    """The successors of each node, if the edges are few; None otherwise."""
    rows = edges.limit(SMALL + 1).collect()
    if len(rows) > SMALL:
        return None
    steps = defaultdict(set)
    for a, b in rows:
        steps[a].add(b)
    return steps


def _follow(steps: dict, starts) -> set:
    reached, new = set(), set(starts)
    while new:
        new = set().union(*(steps.get(n, ()) for n in new)) - reached
        reached |= new
    return reached


def reach_few(edges: DataFrame, starts: list[int], backward: bool = False, zero: bool = False) -> list[int] | None:
    """The nodes reached from given ones, if the edges are few; None otherwise."""
    near, far = ("v", "s") if backward else ("s", "v")
    steps = _steps(edges.filter(F.col("s").isNotNull() & F.col("v").isNotNull()).select(near, far))
    if steps is None:
        return None
    return sorted(_follow(steps, starts) | (set(starts) if zero else set()))


def reach(edges: DataFrame, seeds: DataFrame, backward: bool = False, zero: bool = False) -> DataFrame:
    """[n]: the nodes reached from seeds [n] in one or more steps, with zero=True the seeds too.

    Null ends are no nodes. The rounds are as many as the longest shortest path from a seed.
    """
    use_checkpoints(edges.sparkSession)
    near, far = ("v", "s") if backward else ("s", "v")
    steps = edges.filter(F.col("s").isNotNull() & F.col("v").isNotNull()).select(F.col(near).alias("a"), F.col(far).alias("b"))
    seeds = seeds.select("n").distinct()
    spark = edges.sparkSession
    if (few := _steps(steps)) is not None:
        starts = seeds.limit(SMALL + 1).collect()
        if len(starts) <= SMALL:
            known = _follow(few, (r.n for r in starts))
            return numbers_frame(spark, n=sorted(known | {r.n for r in starts} if zero else known))
    new = steps.join(seeds, F.col("a") == F.col("n"), "left_semi").select(F.col("b").alias("n")).distinct().checkpoint()
    reached = new
    while not new.isEmpty():
        found = steps.join(new, F.col("a") == F.col("n"), "left_semi").select(F.col("b").alias("n")).distinct()
        new = found.join(reached, "n", "left_anti").checkpoint()
        reached = reached.union(new)
    return reached.union(seeds).distinct() if zero else reached


def closure(edges: DataFrame, zero: bool = False, starts: DataFrame | None = None) -> DataFrame:
    """[s, v]: all pairs of which the second is reached from the first; with zero=True every node also with itself.

    starts [n], distinct: only pairs from these nodes are followed. The few edges of a small hierarchy are
    followed from all of its nodes all the same, which costs less than the join.
    """
    use_checkpoints(edges.sparkSession)
    edges = edges.filter(F.col("s").isNotNull() & F.col("v").isNotNull()).select("s", "v").distinct()
    if (few := _steps(edges)) is not None:
        found, nodes = [], {*few, *(b for x in few.values() for b in x)}
        for n in sorted(nodes):
            found += [(n, b) for b in (_follow(few, [n]) | ({n} if zero else set()))]
            if len(found) > SMALL_PAIRS:
                break
        else:
            return numbers_frame(edges.sparkSession, s=[a for a, _ in found], v=[b for _, b in found])
    edges = edges.checkpoint()
    steps = edges.select(F.col("s").alias("v"), F.col("v").alias("t"))
    new = edges if starts is None else edges.join(starts.select(F.col("n").alias("s")), "s", "left_semi").checkpoint()
    pairs = new
    while not new.isEmpty():
        found = new.join(steps, "v").select("s", F.col("t").alias("v")).distinct()
        new = found.join(pairs, ["s", "v"], "left_anti").checkpoint()
        pairs = pairs.union(new)
    if zero:
        nodes = edges.select("s").union(edges.select("v")).distinct()
        pairs = pairs.union(nodes.select("s", F.col("s").alias("v"))).distinct()
    return pairs

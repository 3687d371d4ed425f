"""Connected components of a graph given by its links: alternating large-star and small-star steps, each two aggregations and a join.

Links are reduced to forests by task first. Up to SHARE links, before that or after, are what one task reduces anyway: it
tells the components then, without rounds.

The joins bring a node's links to its least neighbour. Of a node with more than HUB links these stay where they are, and the
least neighbours of such nodes (there are fewer than twice the links over HUB) are sent to all tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, written

#: Links of a node over which they stay where they are; links that one task reduces to a forest.
HUB, SHARE = 200_000, 200_000


def forest(links: DataFrame) -> DataFrame:
    """Of each task's links those that join what its earlier ones leave apart: the same components with at most a link for each node and task."""

    def kept(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        for batch in batches:
            keep = []
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = root(u), root(v)
                keep.append(a != b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return links.mapInArrow(kept, "u long, v long")


def settled(links: DataFrame) -> DataFrame:
    """node, component of links that all are in one partition."""

    def told(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([root(x) for x in list(parent)], pa.int64())], names=["node", "component"])

    return links.mapInArrow(told, "node long, component long")


def _least(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")


def _with_least(rows: DataFrame, least: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """Each link u, v with the least neighbour m of u."""
    if hubs is None:
        return rows.join(least.select("u", "m"), "u")
    few = F.broadcast(hubs)
    return rows.join(few, "u", "left_anti").join(least.select("u", "m"), "u").unionByName(rows.join(few, "u"))


def _hubs(least: DataFrame, n_links: int) -> DataFrame | None:
    """u, m of the nodes of more than HUB links; none where there are too few links for one."""
    if n_links <= HUB:
        return None
    found = cut(least.where(F.col("n") > HUB).select("u", "m"))
    return found if found.take(1) else None


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component: the smallest node that can be reached, for every node of links (u, v: long) but those that are the smallest themselves. Rounds needed grow with the logarithm of the longest chain."""
    edges = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v"), "links")
    before, n = None, edges.count()
    if n > SHARE:
        edges = written(forest(edges.distinct().coalesce(n // SHARE)), "forest")
        n = edges.count()
    if n <= SHARE:
        return written(settled(edges.coalesce(1)), "components")
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both)
        large = _with_least(both, least, _hubs(least, n)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        if n > HUB:
            large = cut(large)
        # Every link now leads from a node to a smaller one; bring each node and its smaller neighbours to the least of them.
        least = _least(large)
        small = _with_least(large, least, _hubs(least, n)).select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        edges = cut(small.select(F.col("a").alias("u"), F.col("b").alias("v")))
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before, n = state, state[0]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))

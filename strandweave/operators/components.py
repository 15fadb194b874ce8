"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.plans.shared import stored

#: Neighbours that never make a vertex a hub, and edges in all that any task may gather.
HUB, FEW = 256, 10_000
#: Edges in all that one task unites where the caller allows it; more go through rounds.
ONE_TASK = 100_000


def _smallest(near: DataFrame) -> DataFrame:
    """near(x, y) -> (x, m, n): the least of x and its neighbours, and how many these are."""
    return near.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n")).select("x", F.least("x", "m").alias("m"), "n")


def _with_least(near: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """near(x, y) with the m of its x. Rows of an x with over `hub` of them stay where they are: there are few such x (at
    most the rows / hub), so theirs are broadcast, and no task gathers the neighbours of a hub. With `hub` 0 there is none."""
    if not hub:
        return near.join(least.select("x", "m"), "x")
    least = stored(least, "least")  # read three times
    hubs = least.filter(F.col("n") > hub).select("x", F.col("m").alias("hub_m"))
    marked = near.join(F.broadcast(hubs), "x", "left")
    rest = marked.filter("hub_m IS NULL").select("x", "y").join(least.filter(F.col("n") <= hub).select("x", "m"), "x")
    return marked.filter("hub_m IS NOT NULL").select("x", "y", F.col("hub_m").alias("m")).unionByName(rest)


def _large_star(edges: DataFrame, hub: int) -> DataFrame:
    near = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    linked = _with_least(near, _smallest(near), hub).filter(F.col("y") > F.col("x"))
    return linked.select(F.col("m").alias("u"), F.col("y").alias("v")).distinct()


def _small_star(edges: DataFrame, hub: int) -> DataFrame:
    near = edges.select(F.col("v").alias("x"), F.col("u").alias("y"))  # u < v: the smaller neighbours of v
    linked = _with_least(near, _smallest(near), hub).select(F.col("m").alias("u"), F.col("y").alias("v"))
    return linked.unionByName(_smallest(near).select(F.col("m").alias("u"), F.col("x").alias("v"))).filter("u < v").distinct()


def _unite(frames):
    """(id, component) of the vertices of all edges(u, v) of one task."""
    frames = [f for f in frames if len(f)]
    if not frames:
        return
    edges = pd.concat(frames)
    ids, codes = np.unique(np.concatenate([edges["u"].to_numpy(), edges["v"].to_numpy()]), return_inverse=True)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for a, b in zip(codes[: len(edges)].tolist(), codes[len(edges) :].tolist()):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    yield pd.DataFrame({"id": ids, "component": ids[[find(i) for i in range(len(ids))]]})


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", gather: bool = False) -> DataFrame:
    """(id, component) for every vertex of an edge; the component is its smallest id. Ids may be longs or strings.

    Each round costs two joins over the edges, which never grow in number; after O(log^2) rounds every edge leads to
    its component's smallest id. A vertex with more than its part of all edges (twice the edges by the number of shuffle
    partitions) is a hub, whose neighbours no task gathers. Loops keep their vertex; edges with a null end are dropped; no edges give no rows.
    With `gather`, a graph of up to ONE_TASK edges in all, of long or string ids, is united in one task.
    """
    ends = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).dropna()
    ends = stored(ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "cc")
    kind = dict(ends.dtypes)["u"]
    if gather and kind in ("int", "bigint", "string") and ends.count() <= ONE_TASK:
        return ends.coalesce(1).mapInPandas(_unite, f"id {kind}, component {kind}")
    alone = ends.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    stars, before = ends.filter("u < v"), None
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, hub = now, max(HUB, 2 * now[0] // tasks) if now[0] > FEW else 0
        large = _large_star(stars, hub)
        stars = stored(_small_star(stored(large, "large") if hub else large, hub), "cc")
    found = stars.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("component"))
    return alone.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))

"""Trees too large for a task: walks around them, distances, extremes over subtrees, branch lengths and blocks.

All trees of a forest are handled at once, in as many rounds as doubling needs. No step gathers a tree or the neighbours of
a vertex: rows are sorted over all tasks, joined on keys that occur once, or dealt by blocks of the walk. Tables with a
row a tree are broadcast: the callers send trees of more than a fixed number of edges here, so there are few of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from strandweave.plans.shared import numbered, running_sums, stored

from .components import connected_components
from .graph import labelled_forest

#: Places of a walk that one task searches for extremes.
BLOCK = 1 << 14
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def tour(forest: DataFrame) -> DataFrame:
    """(tree, a, b, m, left, back): both directions of every edge of forest(u, v, m, tree) as the steps of a walk around
    their tree; how many steps are left from each to the walk's end, and from the step that goes the other way.

    Behind (x, y) comes (y, z), z being y's neighbour after x in cyclic order. The walk is broken before one step of each
    tree and numbered by pointer doubling: in round i every step knows how far the end is, or the step 2**i on.
    """
    both = forest.select("tree", F.col("u").alias("a"), F.col("v").alias("b"), "m").unionByName(forest.select("tree", F.col("v").alias("a"), F.col("u").alias("b"), "m"))
    steps = stored(numbered(both, [F.col("a"), F.col("b")], "id"), "steps")  # a vertex's steps have consecutive ids
    turns = steps.groupBy("a").agg(F.min("id").alias("first"), F.max("id").alias("id")).select("id", "first")
    around = steps.join(turns, "id", "left").select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("id").alias("twin"), F.coalesce("first", F.col("id") + 1).alias("next"))
    starts = steps.groupBy("tree").agg(F.min("id").alias("next")).select("next", F.lit(True).alias("end"))
    linked = steps.join(around, ["a", "b"]).join(starts, "next", "left").select("tree", "a", "b", "m", "id", "twin", F.when(F.col("end").isNull(), F.col("next")).alias("next"))
    linked = stored(linked, "linked")
    now = stored(linked.select("id", "next", F.lit(1).cast("long").alias("left")), "ranks")
    while not now.filter("next IS NOT NULL").isEmpty():
        on = now.select(F.col("id").alias("next"), F.col("next").alias("far"), F.col("left").alias("more"))
        moved = now.filter("next IS NOT NULL").join(on, "next").select("id", F.col("far").alias("next"), (F.col("left") + F.col("more")).alias("left"))
        now = stored(now.filter("next IS NULL").unionByName(moved), "ranks")
    ranks = now.select("id", "left")
    other = ranks.select(F.col("id").alias("twin"), F.col("left").alias("back"))
    return stored(linked.join(ranks, "id").join(other, "twin").select("tree", "a", "b", "m", "left", "back"), "tour")


def rooted(tour: DataFrame, starts: DataFrame) -> DataFrame:
    """(tree, id, parent, m, gap, hops, since, until) of every vertex, for a root a tree in starts(tree, id).

    gap and hops are the distance from the root by weight and by edges, m the weight of the edge to the parent; since and
    until are the places of the walk, begun at the root, where the vertex is entered and left, each held by one vertex
    alone: a vertex below lies between. The trees' walks follow each other, so places are told apart over all of them.
    """
    begin = tour.join(F.broadcast(starts.select("tree", F.col("id").alias("a"))), ["tree", "a"]).groupBy("tree").agg(F.max("left").alias("begin"))
    sizes = tour.groupBy("tree").agg((F.count("*")).alias("n"))
    before = F.coalesce(F.sum(F.col("n") + 2).over(W.Window.orderBy("tree").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    trees = stored(sizes.join(begin, "tree").withColumn("zero", before), "roots")
    place = lambda left: F.col("zero") + 1 + F.pmod(F.col("begin") - F.col(left), F.col("n"))
    walk = tour.join(F.broadcast(trees), "tree").select("tree", "a", "b", "m", place("left").alias("at"), place("back").alias("other"))
    down = F.col("at") < F.col("other")
    walk = walk.withColumns({"by": F.when(down, F.col("m").cast("long")).otherwise(-F.col("m").cast("long")), "one": F.when(down, 1).otherwise(-1).cast("long")})
    # Every walk ends where it began, so sums over all walks in line are sums over each.
    walk = running_sums(walk, ["at"], {"gap": "by", "hops": "one"}).filter(down)
    seen = walk.select("tree", F.col("b").alias("id"), F.col("a").alias("parent"), "m", "gap", "hops", F.col("at").alias("since"), F.col("other").alias("until"))
    zero, kinds = F.lit(0).cast("long"), dict(seen.dtypes)
    roots = starts.select("tree", "id").join(F.broadcast(trees), "tree").select(
        "tree", "id", F.lit(None).cast(kinds["parent"]).alias("parent"), F.lit(None).cast(kinds["m"]).alias("m"), zero.alias("gap"), zero.alias("hops"), F.col("zero").alias("since"), (F.col("zero") + F.col("n") + 1).alias("until")
    )
    return stored(seen.unionByName(roots), "rooted")


def farthest(seen: DataFrame, by: str = "gap") -> DataFrame:
    """(tree, id): the vertex of each tree that is farthest from its root, the smallest of several."""
    best = F.min(F.struct((-F.col(by)).alias("g"), "id")).alias("x")
    return stored(seen.groupBy("tree").agg(best).select("tree", F.col("x")["id"].alias("id")), "farthest")


def first_roots(tour: DataFrame) -> DataFrame:
    """(tree, id): the smallest vertex of every tree."""
    return stored(tour.groupBy("tree").agg(F.min("a").alias("id")), "first")


def far_paths(forest: DataFrame) -> DataFrame:
    """(tree, pos, elem): the path of every tree from the smallest of the vertices farthest, by weight, from the one that
    is farthest from the tree's smallest vertex, back to it; told from the latter's end."""
    steps = tour(forest)
    seen = rooted(steps, farthest(rooted(steps, first_roots(steps))))
    # On the path to the other end lie the vertices that the walk has entered by then and not left.
    end = seen.join(F.broadcast(farthest(seen)), ["tree", "id"]).select("tree", F.col("since").alias("here"))
    on = seen.join(F.broadcast(end), "tree").filter((F.col("since") <= F.col("here")) & (F.col("until") > F.col("here")))
    return on.select("tree", F.col("hops").cast("int").alias("pos"), F.col("id").alias("elem"))


def extremes(values: DataFrame, spans: DataFrame) -> DataFrame:
    """(since, until, low, high): the least low and the greatest high of values(place, low, high) in each distinct span of
    spans(since, until), both ends included, if there is any value.

    Blocks of the line are searched in a task each, for the ends of the spans that lie in them; the whole blocks between
    are a shorter line, of a value a block, that is searched in the same way. Spans must be nested or apart, as subtrees
    are, so that at most as many ends meet in a block as it has places (or two a span that begins there).
    """
    block = lambda c: F.floor(F.col(c) / BLOCK)
    values, spans = stored(values.withColumn("block", block("place")), "values"), stored(spans.select("since", "until").distinct(), "spans")
    first, last = block("since"), block("until")
    part = lambda at, start, end: F.struct(at.alias("block"), start.cast("long").alias("start"), end.cast("long").alias("end"))
    inner = F.when(first == last, F.array(part(first, F.col("since"), F.col("until")))).otherwise(F.array(part(first, F.col("since"), (first + 1) * BLOCK - 1), part(last, last * BLOCK, F.col("until"))))
    ends = spans.select("since", "until", F.explode(inner).alias("p")).select("since", "until", "p.*")

    def search(key, here, asked):
        zero = key[0] * BLOCK
        low, high = np.full(BLOCK, _MOST), np.full(BLOCK, _LEAST)
        low[here["place"] - zero], high[here["place"] - zero] = here["low"], here["high"]
        lows, highs = [low], [high]
        while 2 << len(lows) - 1 <= BLOCK:  # the extremes of 2, 4, 8, ... places from each on
            half = 1 << len(lows) - 1
            lows.append(np.minimum(lows[-1][:-half], lows[-1][half:]))
            highs.append(np.maximum(highs[-1][:-half], highs[-1][half:]))
        a, z = (asked["start"] - zero).to_numpy(), (asked["end"] - zero).to_numpy()
        k = np.frexp(z - a + 1)[1] - 1
        out_low, out_high = np.empty(len(a), np.int64), np.empty(len(a), np.int64)
        for level in np.unique(k):
            s = k == level
            other = z[s] - (1 << level) + 1
            out_low[s], out_high[s] = np.minimum(lows[level][a[s]], lows[level][other]), np.maximum(highs[level][a[s]], highs[level][other])
        found = pd.DataFrame({"since": asked["since"], "until": asked["until"], "low": out_low, "high": out_high})
        return found[out_low <= out_high]

    found = ends.groupBy("block").cogroup(values.select("block", "place", "low", "high").groupBy("block"))
    found = found.applyInPandas(lambda key, asked, here: search(key, here, asked), "since long, until long, low long, high long")
    wide = stored(spans.filter(last - first > 1).select("since", "until", (first + 1).alias("from"), (last - 1).alias("to")), "wide")
    if not wide.isEmpty():
        blocks = values.groupBy(F.col("block").alias("place")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
        between = extremes(blocks, wide.select(F.col("from").alias("since"), F.col("to").alias("until")))
        between = between.withColumnsRenamed({"since": "from", "until": "to"})
        found = found.unionByName(wide.join(between, ["from", "to"]).select("since", "until", "low", "high"))
    return found.groupBy("since", "until").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def branch_lengths(forest: DataFrame) -> DataFrame:
    """(u, v, m, tree, lu, lv): lu, the vertices on the longest path that starts with u, away from v; lv for the other end.

    Trees are rooted at one end of a longest path by edges. Below a vertex the greatest depth counts; above, a longest path
    away from the subtree ends at an end of that path: at the root, or at the far end where that is not in the subtree.
    """
    steps = tour(forest)
    ends = farthest(rooted(steps, first_roots(steps)), "hops")
    seen = rooted(steps, ends)
    far = farthest(seen, "hops")
    back = rooted(steps, far).select("id", F.col("hops").alias("over"))
    there = seen.join(F.broadcast(far), ["tree", "id"]).select("tree", F.col("since").alias("here"))
    deepest = extremes(seen.select(F.col("since").alias("place"), F.col("hops").alias("low"), F.col("hops").alias("high")), seen).select("since", F.col("high").alias("deep"))
    rows = seen.filter("parent IS NOT NULL").join(deepest, "since").join(back, "id").join(F.broadcast(there), "tree")
    within = (F.col("since") <= F.col("here")) & (F.col("until") > F.col("here"))
    down = F.col("deep") - F.col("hops") + 1
    up = F.when(within, F.col("hops")).otherwise(F.greatest("hops", "over"))
    first = F.col("id") < F.col("parent")
    return rows.select(
        F.least("id", "parent").alias("u"), F.greatest("id", "parent").alias("v"), "m", "tree",
        F.when(first, down).otherwise(up).cast("int").alias("lu"), F.when(first, up).otherwise(down).cast("int").alias("lv"),
    )


def blocks(edges: DataFrame) -> DataFrame:
    """(u, v, m, block): the biconnected component of every edge of edges(u, v, m); it is named by its smallest member among
    the lower ends of the spanning forest's edges.

    In a spanning tree, edges to the parent belong together where another edge joins two subtrees, or leaves the subtree
    of the lower end for a place outside that of the upper one; components of that relation are the blocks.
    """
    forest = stored(labelled_forest(edges), "forest")
    steps = tour(forest)
    seen = rooted(steps, first_roots(steps))
    places = seen.select("id", "since", "until")
    at = lambda c: places.select(F.col("id").alias(c), F.col("since").alias(f"s{c}"), F.col("until").alias(f"e{c}"))
    placed = edges.join(forest.select("u", "v", F.lit(True).alias("inside")), ["u", "v"], "left").join(at("u"), "u").join(at("v"), "v")
    placed = stored(placed.select("u", "v", "m", F.coalesce("inside", F.lit(False)).alias("inside"), "su", "eu", "sv", "ev"), "placed")
    beyond = placed.filter("NOT inside")
    touch = beyond.select(F.col("su").alias("since"), F.col("sv").alias("to")).unionByName(beyond.select(F.col("sv").alias("since"), F.col("su").alias("to")))
    reach = touch.groupBy("since").agg(F.min("to").alias("least"), F.max("to").alias("most"))
    own = seen.join(reach, "since", "left").select(F.col("since").alias("place"), F.least("since", "least").alias("low"), F.greatest("since", "most").alias("high"))
    span = extremes(own, seen).select("since", "low", "high")
    # The upper end of an edge of the tree: where its subtree lies, and whether it has a parent itself.
    upper = seen.select(F.col("id").alias("parent"), F.col("since").alias("ps"), F.col("until").alias("pe"), F.col("parent").isNotNull().alias("inner"))
    leaves = seen.join(span, "since").join(upper, "parent").filter(F.col("inner") & ((F.col("low") < F.col("ps")) | (F.col("high") > F.col("pe"))))
    apart = F.greatest("su", "sv") > F.when(F.col("su") < F.col("sv"), F.col("eu")).otherwise(F.col("ev"))
    together = leaves.select(F.col("parent").alias("u"), F.col("id").alias("v")).unionByName(beyond.filter(apart).select("u", "v"))
    named = connected_components(together, gather=True)
    lower = placed.withColumn("id", F.when(F.col("su") < F.col("sv"), F.col("v")).otherwise(F.col("u")))
    return lower.join(named, "id", "left").select("u", "v", "m", F.coalesce("component", "id").alias("block"))


def block_cut_vertices(named: DataFrame) -> DataFrame:
    """(id): vertices whose edges lie in two blocks or more, for the edges with their blocks that blocks() gives."""
    ends = named.select("block", F.explode(F.array("u", "v")).alias("id")).distinct()
    return ends.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")

"""Communities in neighbour graphs that are too large for a task: each step of a strategy for all such graphs at once.

A graph is member(g, ego, v), its vertices, and links(g, v, w), its edges with v < w; g is a number. Communities become
graphs of their own for the next step, and may share vertices. What a step deals into bins is folded a bin a task.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from strandweave.plans.shared import numbered, stored

from . import tours
from .components import connected_components
from .overlap import triangles

#: Vertices of a graph that are dealt into one bin, about.
BIN = 50


def _node(v: str) -> Column:
    return F.struct("g", F.col(v).alias("v"))


def _as_edges(links: DataFrame) -> DataFrame:
    return links.select(_node("v").alias("u"), _node("w").alias("v"), F.lit(1).cast("long").alias("m"))


def renumbered(member: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """member(label, g, ego, v) as graphs of their own, a new g a label, with the links of the old graph among each."""
    member = stored(member, "member")
    named = numbered(member.select("label").distinct(), [F.col("label")], "to")
    member = stored(member.join(named, "label").select(F.col("to").alias("g"), F.col("g").alias("old"), "ego", "v").distinct(), "member")
    a, b = member.select("g", "old", "v"), member.select("g", F.col("v").alias("w"))
    inner = links.withColumnRenamed("g", "old").join(a, ["old", "v"]).join(b, ["g", "w"]).select("g", "v", "w")
    return member.drop("old"), stored(inner, "links")


def by_components(member: DataFrame, links: DataFrame, whole: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Components by `links`; the communities keep all links of `whole` (where that is given) among them."""
    named = connected_components(_as_edges(links)).select(F.col("id")["g"].alias("g"), F.col("id")["v"].alias("v"), F.col("component")["v"].alias("least"))
    label = F.struct("g", F.coalesce("least", "v").alias("v")).alias("label")
    return renumbered(member.join(named, ["g", "v"], "left").select(label, "g", "ego", "v"), links if whole is None else whole)


def without_cuts(member: DataFrame, links: DataFrame, whole: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Components that are left without the cut vertices."""
    cuts = tours.block_cut_vertices(tours.blocks(_as_edges(links))).select(F.col("id")["g"].alias("g"), F.col("id")["v"].alias("v"))
    cuts = stored(cuts, "cuts")
    kept = links.join(cuts, ["g", "v"], "left_anti").join(cuts.withColumnRenamed("v", "w"), ["g", "w"], "left_anti").select("g", "v", "w")
    return by_components(member.join(cuts, ["g", "v"], "left_anti"), stored(kept, "kept"), links if whole is None else whole)


def by_blocks(member: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Biconnected components without the cut vertices; vertices without an edge are in none."""
    named = stored(tours.blocks(_as_edges(links)), "blocks")
    cuts = tours.block_cut_vertices(named)
    inside = named.select(F.col("block").alias("label"), F.explode(F.array("u", "v")).alias("id")).distinct().join(cuts, "id", "left_anti")
    rows = inside.select("label", F.col("id")["g"].alias("g"), F.col("id")["v"].alias("v")).join(member, ["g", "v"])
    return renumbered(rows.select("label", "g", "ego", "v"), links)


def well_linked(member: DataFrame, links: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Edges with fewer than `least` common neighbours go, then cut vertices."""
    corners = triangles(_as_edges(links)).select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("a").alias("x"), F.col("c").alias("y")), F.struct(F.col("b").alias("x"), F.col("c").alias("y")))).alias("e"))
    ends = corners.select(F.least("e.x", "e.y").alias("x"), F.greatest("e.x", "e.y").alias("y")).groupBy("x", "y").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return without_cuts(member, stored(ends.select(F.col("x")["g"].alias("g"), F.col("x")["v"].alias("v"), F.col("y")["v"].alias("w")), "well"), links)


def percolated(member: DataFrame, links: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Unions of k-cliques (k 3 or 4) that share k - 1 vertices, step by step: a clique links its faces, and components of
    faces are communities."""
    corner = triangles(_as_edges(links)).select(F.array_sort(F.array("a", "b", "c")).alias("x"))
    cliques = corner
    if k == 4:
        # A triangle and a vertex above its last that closes a triangle with each of its sides.
        flat = stored(corner.select(F.col("x")[0].alias("a"), F.col("x")[1].alias("b"), F.col("x")[2].alias("c")), "flat")
        met = flat.join(flat.withColumnRenamed("c", "d"), ["a", "b"]).filter("c < d")
        met = met.join(flat.select("a", F.col("b").alias("c"), F.col("c").alias("d")), ["a", "c", "d"], "left_semi")
        cliques = met.select(F.array("a", "b", "c", "d").alias("x"))
    cliques = stored(cliques, "cliques")
    faces = F.array(*(F.array(*(F.col("x")[j] for j in range(k) if j != i)) for i in range(k)))
    linked = cliques.select(faces.alias("f")).select(F.explode(F.sequence(F.lit(1), F.lit(k - 1))).alias("i"), "f").select(F.col("f")[0].alias("u"), F.col("f")[F.col("i")].alias("v"))
    named = connected_components(linked).select(F.col("component").alias("label"), F.explode("id").alias("id")).distinct()
    rows = named.select("label", F.col("id")["g"].alias("g"), F.col("id")["v"].alias("v")).join(member, ["g", "v"])
    return renumbered(rows.select("label", "g", "ego", "v"), links)


def dealt(member: DataFrame, bins: Callable[[Column], Column]) -> DataFrame:
    """member(g, ego, v) with `bin`: each graph's vertices are dealt out, in an order that the ego fixes, to bins(n) bins, n
    being their number. Graphs are sorted over all tasks, so none is gathered."""
    keyed = member.withColumn("crc", F.crc32(F.concat_ws("/", F.col("ego").cast("string"), F.col("v").cast("string")).cast("binary")))
    places = stored(numbered(keyed, [F.col("g"), F.col("crc"), F.col("v")], "at"), "places")
    sizes = places.groupBy("g").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    return stored(places.join(sizes, "g").select("g", "ego", "v", ((F.col("at") - F.col("first")) % bins(F.col("n"))).alias("bin")), "dealt")


def binned(member: DataFrame, links: DataFrame, fold: Callable[[dict], list[set]], more_than: int = 20) -> tuple[DataFrame, DataFrame]:
    """Vertices are dealt into bins in an order that the ego fixes, fold(graph) splits each bin's graph, and groups with more
    than `more_than` edges between them become one, transitively."""
    spread = dealt(member, lambda n: 1 + F.floor(n / BIN))
    a, b = spread.select("g", "bin", "v"), spread.select("g", "bin", F.col("v").alias("w"))
    inner = links.join(a, ["g", "v"]).join(b, ["g", "bin", "w"]).select("g", "bin", "v", "w")
    rows = spread.select("g", "bin", "v", F.lit(None).cast(links.schema["w"].dataType).alias("w")).unionByName(inner)

    def split(key, group):
        g: dict = {}
        for v, w in zip(group["v"], group["w"]):
            g.setdefault(v, set())
            if not pd.isna(w):
                g[v].add(w)
                g.setdefault(w, set()).add(v)
        return pd.DataFrame([(*key, i, v) for i, c in enumerate(fold(g)) for v in c], columns=["g", "bin", "i", "v"])

    kind = dict(links.dtypes)["v"]
    parts = rows.groupBy("g", "bin").applyInPandas(split, f"g long, bin long, i int, v {kind}").join(member, ["g", "v"])
    parts = stored(parts.select(F.struct("g", "bin", "i").alias("part"), "g", "ego", "v"), "parts")
    # A link counts for a pair of groups that each hold one end alone, and against a pair that both hold both ends.
    held = parts.groupBy("g", "v").agg(F.collect_set("part").alias("in"))  # a bin's groups at most
    met = links.join(held.withColumnRenamed("in", "iv"), ["g", "v"]).join(held.select("g", F.col("v").alias("w"), F.col("in").alias("iw")), ["g", "w"])
    pair = lambda x, y: F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v"))
    common = F.array_intersect("iv", "iw")
    across = met.select(F.explode(F.array_except("iv", "iw")).alias("x"), F.array_except("iw", "iv").alias("ys")).select("x", F.explode("ys").alias("y")).select(pair(F.col("x"), F.col("y")).alias("p"), F.lit(1).alias("n"))
    both = met.select(common.alias("c")).filter(F.size("c") > 1).select(F.explode("c").alias("x"), "c").select("x", F.explode("c").alias("y")).filter("x < y").select(pair(F.col("x"), F.col("y")).alias("p"), F.lit(-1).alias("n"))
    near = across.unionByName(both).groupBy("p").agg(F.sum("n").alias("n")).filter(F.col("n") > more_than).select("p.u", "p.v")
    named = connected_components(near).withColumnRenamed("id", "part")
    return renumbered(parts.join(named, "part", "left").select(F.coalesce("component", "part").alias("label"), "g", "ego", "v"), links)


def numbered_molecules(member: DataFrame) -> DataFrame:
    """(u, nbr, mid): communities of two or more by falling size (ties: smallest member); of several, a vertex is in the last."""
    sizes = member.groupBy("ego", "g").agg(F.count("*").alias("n"), F.min("v").alias("least")).filter("n > 1")
    mid = F.row_number().over(W.Window.partitionBy("ego").orderBy(F.desc("n"), "least", "g")) - 1
    rows = member.join(sizes.select("g", mid.alias("mid")), "g")
    return rows.groupBy(F.col("ego").alias("u"), F.col("v").alias("nbr")).agg(F.max("mid").cast("int").alias("mid"))

"""Backbones of spanning trees: branch lengths, pruning, junctions, diameters, bridges, cut vertices.

Trees (or components) of up to FOLD edges are folded in a task each, by the kernels in the first half of this file. Larger
ones go through DataFrame rounds that give the same rows: messages along edges (as many rounds as the least length asked
for) where only short branches matter, and else the walks of tours.py.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.plans.shared import numbered, stored

from . import tours
from .communities import components, cut_vertices, within
from .components import connected_components
from .graph import bridges, chimera, hops, labelled_forest, path_edges, without

#: Edges of a tree that one task folds.
FOLD = 100_000

Tree = dict  # vertex -> {neighbour: weight}


def tree_of(group: pd.DataFrame) -> Tree:
    t: Tree = {}
    for u, v, m in group[["u", "v", "m"]].itertuples(index=False):
        t.setdefault(u, {})[v] = m
        t.setdefault(v, {})[u] = m
    return t


def downward(t: Tree, root) -> list[tuple]:
    """(vertex, parent) from the root outward, neighbours in order."""
    out = [(root, None)]
    for u, parent in out:
        out += [(v, u) for v in sorted(t[u]) if v != parent]
    return out


def branch_lengths(t: Tree) -> dict[tuple, int]:
    """(u, v) -> vertices on the longest path that starts with v, away from u; for both directions of every edge."""
    length: dict = {}
    for root in map(min, components({u: set(vs) for u, vs in t.items()})):
        order = downward(t, root)
        for v, u in reversed(order):
            if u is not None:
                length[u, v] = 1 + max((length[v, w] for w in t[v] if w != u), default=0)
        for v, u in order:
            if u is not None:
                length[v, u] = 1 + max((length[u, w] for w in t[u] if w != v), default=0)
    return length


def prune(t: Tree, least: int) -> Tree:
    """Cuts branches shorter than `least` at vertices of degree 3 or more, until there are none."""
    t = {u: dict(vs) for u, vs in t.items()}
    while True:
        length = branch_lengths(t)
        roots = [(u, v) for u, vs in t.items() if len(vs) >= 3 for v in vs if length[u, v] < least]
        if not roots:
            return t
        for u, v in roots:
            if u in t and v in t.get(u, {}):
                del t[u][v], t[v][u]
        for _, v in roots:
            front = [v] if v in t else []
            while front:
                front += [w for w in t.pop(front.pop(), {}) if w in t]
        t = {u: {v: m for v, m in vs.items() if v in t} for u, vs in t.items()}


def far_path(t: Tree, start) -> list:
    """The path from the smallest of the vertices farthest (by weight) from the one that is farthest from `start`, back to it."""

    def farthest(root):
        gap, parent = {root: 0}, {root: None}
        for v, u in downward(t, root)[1:]:
            gap[v], parent[v] = gap[u] + t[u][v], u
        return min(gap, key=lambda v: (-gap[v], v)), parent

    u, _ = farthest(start)
    v, parent = farthest(u)
    path = [v]
    while parent[path[-1]] is not None:
        path.append(parent[path[-1]])
    return path[::-1]


def junctions_of(t: Tree, least: int) -> set:
    """Vertices whose third longest branch has at least `least` vertices."""
    length = branch_lengths(t)
    return {u for u, vs in t.items() if len(vs) >= 3 and sorted(length[u, v] for v in vs)[-3] >= least}


def backbones_of(t: Tree, least_branch: int, least_junction: int) -> list[list]:
    """Peels paths off a pruned tree: split at junctions, take every piece's diameter, keep those long enough, and go on
    without their vertices until no edge is left."""
    found, t = [], prune(t, least_branch)
    while any(t.values()):
        cut = junctions_of(t, least_junction) if least_junction else set()
        pieces = components({u: {v for v in vs if u not in cut and v not in cut} for u, vs in t.items()})
        paths = [far_path({u: {v: m for v, m in t[u].items() if v in piece and u not in cut and v not in cut} for u in piece}, min(piece)) for piece in pieces]
        found += [p for p in paths if len(p) >= max(1, least_branch)]
        gone = {u for p in paths for u in p}
        t = {u: {v: m for v, m in vs.items() if v not in gone} for u, vs in t.items() if u not in gone}
        t = prune(t, least_branch)
    return found


def bridges_of(t: Tree, length: int) -> set:
    """Vertices of pieces shorter than `length` between junctions, all of degree 2, and both ends of every edge between two junctions."""
    cut = {u for u, vs in t.items() if len(vs) >= 3}
    pieces = components({u: set(vs) - cut for u, vs in t.items() if u not in cut})
    short = {u for p in pieces if len(p) < length and all(len(t[u]) == 2 for u in p) for u in p}
    return short | {u for u in cut if cut & set(t[u])}


def blocks_of(t: Tree) -> dict[tuple, object]:
    """(u, v) -> block of every edge in both directions, by depth-first low points: edges are stacked as they are met, and
    those above a branch that reaches no higher than its start are a block, named by the branch's first vertex."""
    order, low, found = {}, {}, {}
    for root in sorted(t):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        path, held = [(root, None, iter(sorted(t[root])))], []
        while path:
            u, parent, rest = path[-1]
            v = next(rest, None)
            if v is None:
                path.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[u])
                    if low[u] >= order[parent]:
                        while (parent, u) not in found:
                            a, b = held.pop()
                            found[a, b] = found[b, a] = u
            elif v not in order:
                order[v] = low[v] = len(order)
                held.append((u, v))
                path.append((v, u, iter(sorted(t[v]))))
            elif v != parent and order[v] < order[u]:
                held.append((u, v))
                low[u] = min(low[u], order[v])
    return found


def _edge_schema(edges: DataFrame) -> str:
    return ", ".join(f"{c} {dict(edges.dtypes)[c]}" for c in ("u", "v", "m"))


def _per_tree(forest: DataFrame, fold, schema: str) -> DataFrame:
    """Folds one tree of forest(u, v, m, tree) at a time."""
    return forest.groupBy("tree").applyInPandas(fold, schema)


def by_size(forest: DataFrame, small, vast) -> DataFrame:
    """small(trees of up to FOLD edges) and vast(larger trees) together; both give the same for the same trees."""
    forest = stored(forest, "forest")
    large = stored(forest.groupBy("tree").agg(F.count("*").alias("n")).filter(F.col("n") > FOLD).select("tree"), "large")
    if large.isEmpty():
        return small(forest)
    return small(forest.join(large, "tree", "left_anti")).unionByName(vast(stored(forest.join(large, "tree", "left_semi").select(*forest.columns), "vast")))


def branch_reach(forest: DataFrame, most: int) -> DataFrame:
    """forest with lu, the vertices on the longest path that starts with u, away from v, and lv for the other end; both up to `most`.

    Round i: the branch of u (away from v) reaches i where another edge of u leads to a branch that reaches i - 1. Only
    counts of such edges meet at a vertex, so a vertex of many edges is no burden.
    """
    rows = forest.withColumn("lu", F.lit(1)).withColumn("lv", F.lit(1))
    for i in range(2, most + 1):
        # Branches of i - 1: of v as seen from u (an edge that leaves u), and of u as seen from v.
        leaving = F.explode(F.filter(F.array(F.when(F.col("lv") == i - 1, F.col("u")), F.when(F.col("lu") == i - 1, F.col("v"))), lambda x: x.isNotNull())).alias("id")
        n = stored(rows.select(leaving).groupBy("id").agg(F.count("*").alias("n")), "reach-counts")
        if n.isEmpty():
            break
        rows = rows.join(n.select(F.col("id").alias("u"), F.col("n").alias("nu")), "u", "left").join(n.select(F.col("id").alias("v"), F.col("n").alias("nv")), "v", "left")
        more = lambda count, own: F.coalesce(F.col(count), F.lit(0)) > (F.col(own) == i - 1).cast("int")
        rows = rows.withColumns({"lu": F.when(more("nu", "lv"), i).otherwise(F.col("lu")), "lv": F.when(more("nv", "lu"), i).otherwise(F.col("lv"))})
        rows = stored(rows.select(*forest.columns, "lu", "lv"), "reach")
    return rows


def _prune_vast(forest: DataFrame, least: int) -> DataFrame:
    """prune() of forest(u, v, m, tree) by rounds: short branches at vertices of three edges or more are cut off and dropped."""
    while True:
        reach = stored(branch_reach(forest, least), "lengths")
        degree = reach.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("n")).filter("n >= 3").select("id")
        forked = reach.join(degree.select(F.col("id").alias("u"), F.lit(True).alias("fu")), "u", "left").join(degree.select(F.col("id").alias("v"), F.lit(True).alias("fv")), "v", "left")
        low_v, low_u = F.coalesce("fu", F.lit(False)) & (F.col("lv") < least), F.coalesce("fv", F.lit(False)) & (F.col("lu") < least)
        marked = stored(forked.withColumns({"cv": low_v, "cu": low_u}).select(*forest.columns, "cu", "cv"), "marked")
        roots = stored(marked.filter("cv").select(F.col("v").alias("id")).unionByName(marked.filter("cu").select(F.col("u").alias("id"))).distinct(), "roots")
        if roots.isEmpty():
            return forest
        rest = stored(marked.filter("NOT cu AND NOT cv").select(*forest.columns), "rest")
        named = connected_components(rest, gather=True)
        short = named.join(roots, "id", "left_semi").select("component").distinct()
        gone = named.join(short, "component", "left_semi").select("id").unionByName(roots).distinct()
        forest = stored(rest.join(gone.select(F.col("id").alias("u")), "u", "left_anti").select(*forest.columns), "pruned")


def _junctions_vast(forest: DataFrame, least: int) -> DataFrame:
    """(id): vertices with three branches of at least `least` vertices."""
    reach = branch_reach(forest, max(1, least))
    long = F.explode(F.filter(F.array(F.when(F.col("lv") >= least, F.col("u")), F.when(F.col("lu") >= least, F.col("v"))), lambda x: x.isNotNull())).alias("id")
    return reach.select(long).groupBy("id").agg(F.count("*").alias("n")).filter("n >= 3").select("id")


def _backbones_vast(forest: DataFrame, least_branch: int, least_junction: int) -> DataFrame:
    """(head, n, pos, elem) of backbones_of() for every tree: paths are peeled off all trees at once, round after round."""
    keep = max(1, least_branch)
    left, found = stored(_prune_vast(forest, least_branch), "left"), None
    alone = left.select(F.col("u").alias("id")).limit(0)
    while not left.isEmpty():
        cut = stored(_junctions_vast(left, least_junction), "cut") if least_junction else left.select(F.col("u").alias("id")).limit(0)
        vertices = left.select(F.explode(F.array("u", "v")).alias("id")).distinct().unionByName(alone).distinct()
        inside = stored(without(left, cut), "inside")
        named = connected_components(inside, gather=True)
        pieces = inside.join(named.select(F.col("id").alias("u"), F.col("component").alias("tree")), "u").select("u", "v", "m", "tree")
        paths = tours.far_paths(stored(pieces, "pieces"))
        single = vertices.join(named, "id", "left_anti").select(F.col("id").alias("tree"), F.lit(0).alias("pos"), F.col("id").alias("elem"))
        paths = stored(paths.unionByName(single), "paths")
        heads = paths.groupBy("tree").agg(F.min_by("elem", "pos").alias("head"), F.count("*").cast("int").alias("n"))
        kept = paths.join(heads.filter(F.col("n") >= keep), "tree").select("head", "n", F.col("pos").cast("int").alias("pos"), "elem")
        found = kept if found is None else found.unionByName(kept)
        gone = paths.select(F.col("elem").alias("id"))
        rest = stored(left.join(gone.withColumnRenamed("id", "u"), "u", "left_anti").join(gone.withColumnRenamed("id", "v"), "v", "left_anti").select(*left.columns), "rest")
        stay = vertices.join(gone, "id", "left_anti")
        left = stored(_prune_vast(rest, least_branch), "left")
        linked = left.select(F.explode(F.array("u", "v")).alias("id")).distinct()
        dropped = rest.select(F.explode(F.array("u", "v")).alias("id")).distinct().join(linked, "id", "left_anti")
        alone = stored(stay.join(linked, "id", "left_anti").join(dropped, "id", "left_anti"), "alone")
    return found if found is not None else left.select(F.col("u").alias("head"), F.lit(0).alias("n"), F.lit(0).alias("pos"), F.col("u").alias("elem")).limit(0)


def _prune_trees(forest: DataFrame, least_branch: int) -> DataFrame:
    """(u, v, m, tree): a forest without its short branches."""

    def fold(group):
        t = prune(tree_of(group), least_branch)
        return pd.DataFrame([(u, v, m, group["tree"].iloc[0]) for u, vs in t.items() for v, m in vs.items() if u < v], columns=["u", "v", "m", "tree"])

    schema = f"{_edge_schema(forest)}, tree {dict(forest.dtypes)['tree']}"
    return by_size(forest.select("u", "v", "m", "tree"), lambda f: _per_tree(f, fold, schema), lambda f: _prune_vast(f, least_branch).select("u", "v", "m", "tree"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(u, v, m, tree): graph.labelled_forest(edges); components of up to FOLD edges are folded in a task each."""

    def fold(group):
        rows = sorted(group[["u", "v", "m"]].itertuples(index=False, name=None), key=lambda e: (-e[2], e[0], e[1]))
        found = [(u, v, m, name) for name, (t, own) in _kruskal(rows).items() for u, v, m in own if v in t[u]]
        return pd.DataFrame(found, columns=["u", "v", "m", "tree"])

    schema = f"{_edge_schema(edges)}, tree {dict(edges.dtypes)['u']}"
    return by_size(_components_named(edges), lambda f: _per_tree(f, fold, schema), lambda f: labelled_forest(f.select("u", "v", "m")))


def pruned_forest(edges: DataFrame, least_branch: int = 10) -> DataFrame:
    """The maximum spanning forest without its short branches."""
    return _prune_trees(spanning_forest(edges), least_branch).drop("tree")


def _kruskal(edges: list[tuple]) -> dict:
    """smallest vertex -> (tree, edges) of every component; edges(u, v, m) come in the forest's order."""
    root: dict = {}

    def find(u):
        while root.setdefault(u, u) != u:
            root[u] = u = root[root[u]]
        return u

    joined = []
    for u, v, m in edges:
        a, b = find(u), find(v)
        if a != b:
            root[max(a, b)] = min(a, b)
            joined.append((u, v, m))
    found: dict = {}
    for u, v, m in joined:
        t = found.setdefault(find(u), ({}, []))[0]
        t.setdefault(u, {})[v] = m
        t.setdefault(v, {})[u] = m
    for e in edges:
        found[find(e[0])][1].append(e)
    return found


def unbridge(edges: list[tuple], least_branch: int, length: int) -> list[tuple]:
    """(u, v, m, tree, inside) of the edges(u, v, m) that are left, inside being those of the spanning forest: bridges of the
    pruned tree go, component by component, and what is left of a component that had any is looked at again."""
    found, left = [], sorted(edges, key=lambda e: (-e[2], e[0], e[1]))
    while left:
        again = []
        for name, (t, own) in _kruskal(left).items():
            bad = bridges_of(prune(t, least_branch), length)
            if bad:
                again += [e for e in own if e[0] not in bad and e[1] not in bad]
            else:
                found += [(u, v, m, name, v in t[u]) for u, v, m in own]
        left = again
        left.sort(key=lambda e: (-e[2], e[0], e[1]))
    return found


def unbridged(edges: DataFrame, least_branch: int, length: int) -> tuple[DataFrame, DataFrame]:
    """(edges, labelled forest) without bridge vertices, found in the pruned forest again and again until there are none.
    Length 0 removes nothing.

    A component of up to FOLD edges is folded in a task. Of a larger one the forest is kept from round to round: it is cut
    at its bridges, and its pieces are joined by the best edges between them. Components without bridges are done, and
    what falls below FOLD edges is folded, so a round looks only at what the round before has changed and left large.
    """
    if length <= 0:
        return edges, spanning_forest(edges)
    named, forest, found = _components_named(edges), None, None
    schema = f"{_edge_schema(edges)}, tree {dict(named.dtypes)['tree']}, inside boolean"

    def fold(group):
        rows = unbridge(list(group[["u", "v", "m"]].itertuples(index=False, name=None)), least_branch, length)
        return pd.DataFrame(rows, columns=["u", "v", "m", "tree", "inside"])

    while True:
        named = stored(named, "named")
        large = stored(named.groupBy("tree").agg(F.count("*").alias("n")).filter(F.col("n") > FOLD).select("tree"), "large")
        done = large.isEmpty()
        folded = _per_tree(named if done else named.join(large, "tree", "left_anti"), fold, schema)
        found = folded if found is None else found.unionByName(folded)
        if done:
            break
        named = stored(named.join(large, "tree", "left_semi").select("u", "v", "m", "tree"), "named")
        forest = labelled_forest(named) if forest is None else stored(forest.join(large, "tree", "left_semi").select("u", "v", "m", "tree"), "forest")
        bad = stored(bridges(_prune_vast(forest, least_branch), length), "bad")
        member = forest.select(F.explode(F.array("u", "v")).alias("id"), "tree").distinct()
        hurt = stored(member.join(bad, "id", "left_semi").select("tree").distinct(), "hurt")
        calm = named.join(hurt, "tree", "left_anti").join(forest.select("u", "v", F.lit(True).alias("inside")), ["u", "v"], "left")
        found = found.unionByName(calm.select("u", "v", "m", "tree", F.coalesce("inside", F.lit(False)).alias("inside")))
        rest = stored(without(named.join(hurt, "tree", "left_semi"), bad), "rest")
        kept = stored(without(forest.join(hurt, "tree", "left_semi"), bad), "kept")
        pieces = kept.join(connected_components(kept, gather=True).select(F.col("id").alias("u"), F.col("component").alias("tree")), "u").select("u", "v", "m", "tree")
        forest = labelled_forest(rest, stored(pieces, "pieces"))
        named = rest.join(forest.select(F.explode(F.array("u", "v")).alias("u"), "tree").distinct(), "u").select("u", "v", "m", "tree")
    found = stored(found, "unbridged")
    return found.select("u", "v", "m"), found.filter("inside").select("u", "v", "m", "tree")


def remove_bridges(edges: DataFrame, least_branch: int, length: int) -> DataFrame:
    """Edges without bridge vertices, as in unbridged."""
    return unbridged(edges, least_branch, length)[0] if length > 0 else edges


def spanning_tree(edges: DataFrame, least_branch: int = 10, bridge_length: int = 0) -> DataFrame:
    return _prune_trees(unbridged(edges, least_branch, bridge_length)[1], least_branch).drop("tree")


def tree_with_branch_lengths(edges: DataFrame, least_branch: int = 10) -> DataFrame:
    """(u, v, m, l): the pruned forest with the lesser of the two branch lengths at each edge."""

    def fold(group):
        t = tree_of(group)
        length = branch_lengths(t)
        return pd.DataFrame([(u, v, m, min(length[u, v], length[v, u])) for u, vs in t.items() for v, m in vs.items() if u < v], columns=["u", "v", "m", "l"])

    kind = dict(edges.dtypes)["u"]
    pruned = _prune_trees(spanning_forest(edges), least_branch)
    return by_size(pruned, lambda f: _per_tree(f, fold, f"u {kind}, v {kind}, m long, l int"), lambda f: tours.branch_lengths(f).select("u", "v", F.col("m").cast("long").alias("m"), F.least("lu", "lv").alias("l")))


def junctions(edges: DataFrame, least_junction: int, depth: int = 0, least_branch: int = 10) -> DataFrame:
    """(id): junctions of the pruned forest; with depth, also what lies within depth - 1 hops in the forest and one hop on in the graph."""
    forest = stored(_prune_trees(spanning_forest(edges), least_branch), "pruned")
    kind = dict(edges.dtypes)["u"]
    fold = lambda group: pd.DataFrame({"id": list(junctions_of(tree_of(group), least_junction))})
    found = by_size(forest, lambda f: _per_tree(f, fold, f"id {kind}"), lambda f: _junctions_vast(f, least_junction))
    if not depth:
        return found
    near = hops(forest, found.select(F.col("id").alias("seed")), depth - 1).select(F.col("id").alias("seed")).distinct()
    return hops(edges, near, 1).select("id").distinct()


def backbones(edges: DataFrame, least_branch: int = 10, bridge_length: int = 0, least_junction: int = 0) -> DataFrame:
    """(tid, pos, elem): the backbone paths, longest first (ties: smaller first element).

    Paths are numbered by a global sort of their heads.
    """
    forest = unbridged(edges, least_branch, bridge_length)[1]
    kind = dict(edges.dtypes)["u"]

    def fold(group):
        found = backbones_of(tree_of(group), least_branch, least_junction)
        return pd.DataFrame([(p[0], len(p), i, u) for p in found for i, u in enumerate(p)], columns=["head", "n", "pos", "elem"])

    schema = f"head {kind}, n int, pos int, elem {kind}"
    rows = by_size(forest.select("u", "v", "m", "tree"), lambda f: _per_tree(f, fold, schema), lambda f: _backbones_vast(f, least_branch, least_junction))
    rows = stored(rows, "backbones")
    tids = numbered(rows.filter("pos = 0").select("head", "n"), [F.desc("n"), F.col("head")], "at").select("head", (F.col("at") - 1).cast("int").alias("tid"))
    return rows.join(tids, "head").select("tid", "pos", "elem")


def backbones_without_chimera(edges: DataFrame, support: int = 3, distance: int = 2, least_path: int = 200, **options) -> tuple[DataFrame, DataFrame]:
    """(paths, edges) after removing chimeric vertices and their spanners, until none is found."""
    while True:
        paths = stored(backbones(edges, **options), "paths")
        if not support:
            return paths, edges
        weak = stored(chimera(edges, paths, distance, support, least_path), "chimera")
        if weak.isEmpty():
            return paths, edges
        edges = stored(without(edges, weak), "unmixed")


def backbone_graph(edges: DataFrame, support: int = 0, distance: int = 2, least_path: int = 200, **options) -> DataFrame:
    """Edges of the graph whose ends lie on one backbone."""
    paths, kept = backbones_without_chimera(edges, support, distance, least_path, **options)
    return path_edges(kept, paths)


def biconnected_components(edges: DataFrame) -> DataFrame:
    """(u, v, m, block): edges on a common simple cycle share a block; a block is named by some vertex of it."""

    def fold(group):
        found = blocks_of(tree_of(group))
        return pd.DataFrame([(u, v, m, found[u, v]) for u, v, m in group[["u", "v", "m"]].itertuples(index=False)], columns=["u", "v", "m", "block"])

    kind = dict(edges.dtypes)["u"]
    return by_size(_components_named(edges), lambda f: _per_tree(f, fold, f"{_edge_schema(edges)}, block {kind}"), lambda f: tours.blocks(f.select("u", "v", "m")))


def articulation_points(edges: DataFrame) -> DataFrame:
    """(id): vertices that lie in two blocks or more, which connect what falls apart without them."""
    return tours.block_cut_vertices(biconnected_components(edges))


def without_cut_vertices(edges: DataFrame) -> DataFrame:
    """Edges left when every cut vertex of the graph is gone. Small components are folded, larger ones go by their blocks."""

    def fold(group):
        t = tree_of(group)
        g = {u: set(vs) for u, vs in t.items()}
        kept = within(g, set(g) - cut_vertices(g))
        return pd.DataFrame([(u, v, t[u][v]) for u, vs in kept.items() for v in vs if u < v], columns=["u", "v", "m"])

    def vast(named: DataFrame) -> DataFrame:
        return without(named, stored(tours.block_cut_vertices(tours.blocks(named.select("u", "v", "m"))), "cuts"))

    return by_size(_components_named(edges), lambda f: _per_tree(f, fold, _edge_schema(edges)), vast)


def _components_named(edges: DataFrame) -> DataFrame:
    return edges.join(connected_components(edges, gather=True).select(F.col("id").alias("u"), F.col("component").alias("tree")), "u").select("u", "v", "m", "tree")


__all__ = ["articulation_points", "backbones", "backbone_graph", "backbones_without_chimera", "biconnected_components", "bridges_of", "junctions", "pruned_forest", "remove_bridges", "spanning_tree", "tree_with_branch_lengths", "unbridged", "without_cut_vertices"]

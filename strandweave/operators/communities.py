"""Communities in the neighbour graph of every vertex, which split a vertex into molecules."""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from strandweave.plans.shared import numbered, stored

from . import hubs, tours
from .overlap import both_ways, ego_edges, relabel_molecules

#: Rows (neighbours and edges) of a neighbour graph that one task folds.
FOLD = 100_000

Graph = dict  # vertex -> set of neighbours


def within(g: Graph, nodes: set) -> Graph:
    return {u: g[u] & nodes for u in nodes}


def components(g: Graph) -> list[set]:
    left, found = set(g), []
    while left:
        front = [min(left)]
        left.discard(front[0])
        group = set(front)
        while front:
            new = g[front.pop()] & left
            left -= new
            group |= new
            front += new
        found.append(group)
    return found


def cut_vertices(g: Graph) -> set:
    """Vertices whose removal disconnects their component, by depth-first low points (no recursion)."""
    order, low, cuts = {}, {}, set()
    for root in sorted(g):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack, branches = [(root, None, iter(sorted(g[root])))], 0
        while stack:
            u, parent, rest = stack[-1]
            step = next(rest, None)
            if step is None:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[u])
                    if parent != root and low[u] >= order[parent]:
                        cuts.add(parent)
            elif step not in order:
                order[step] = low[step] = len(order)
                branches += u == root
                stack.append((step, u, iter(sorted(g[step]))))
            elif step != parent:
                low[u] = min(low[u], order[step])
        if branches > 1:
            cuts.add(root)
    return cuts


def blocks(g: Graph) -> list[set]:
    """Components that are left without the cut vertices."""
    return components(within(g, set(g) - cut_vertices(g)))


def well_linked(g: Graph, least: int) -> list[set]:
    """Edges with fewer than `least` common neighbours go, then cut vertices; the components."""
    at, bits = bitsets(g)
    return blocks({u: {v for v in vs if (bits[at[u]] & bits[at[v]]).bit_count() >= least} for u, vs in g.items()})


def bitsets(g: Graph) -> tuple[dict, list[int]]:
    """The place of every vertex in order, and the neighbours of the vertex at each place as bits of a number."""
    at = {u: i for i, u in enumerate(sorted(g))}
    return at, [sum(1 << at[v] for v in g[u]) for u in at]


def _places(bits: int):
    """The places of the bits that are set, from the lowest."""
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def clique_percolation(g: Graph, k: int) -> list[set]:
    """Unions of k-cliques that share k - 1 vertices, step by step; they may share vertices."""
    at, bits = bitsets(g)
    names = list(at)
    # A clique, and the vertices above its last that all of it is linked to.
    grown = [((i,), bits[i] >> i + 1 << i + 1) for i in range(len(names))]
    for _ in range(k - 1):
        grown = [((*c, i), more & bits[i] >> i + 1 << i + 1) for c, more in grown for i in _places(more)]
    cliques = [tuple(names[i] for i in c) for c, _ in grown]
    of_face: dict = {}
    root = list(range(len(cliques)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, c in enumerate(cliques):
        for face in combinations(c, k - 1):
            a, b = find(i), find(of_face.setdefault(face, i))
            root[max(a, b)] = min(a, b)
    found: dict = {}
    for i, c in enumerate(cliques):
        found.setdefault(find(i), set()).update(c)
    return list(found.values())


def cosine_split(g: Graph, squared: bool, threshold: float, small: int = 10) -> list[set]:
    """Edges between vertices whose rows of the adjacency matrix (or of its square) have a cosine below `threshold` go;
    the components. Graphs of fewer than `small` vertices stay whole."""
    if len(g) < max(2, small):
        return [set(g)]
    names = sorted(g)
    at = {u: i for i, u in enumerate(names)}
    a = np.zeros((len(names),) * 2)
    for u, vs in g.items():
        a[at[u], [at[v] for v in vs]] = 1
    rows = a @ a if squared else a
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    rows = rows / np.where(norms == 0, 1, norms)
    near = rows @ rows.T >= threshold
    return components({u: {v for v in vs if near[at[u], at[v]]} for u, vs in g.items()})


def bins(nodes: set, seed: str, most: int = 50) -> list[set]:
    """1 + n // most bins of nearly equal size, dealt in an order that the seed fixes."""
    n = 1 + len(nodes) // most
    order = sorted(nodes, key=lambda v: (zlib.crc32(f"{seed}/{v}".encode()), v))
    return [set(order[i::n]) for i in range(n)]


def merge(g: Graph, groups: list[set], more_than: int = 20) -> list[set]:
    """Groups with more than `more_than` edges between them become one, transitively."""
    if len(groups) < 2:
        return groups
    inside = lambda s: sum(len(g[u] & s) for u in s) // 2
    links = {i: set() for i in range(len(groups))}
    for i, j in combinations(range(len(groups)), 2):
        if inside(groups[i] | groups[j]) - inside(groups[i]) - inside(groups[j]) > more_than:
            links[i].add(j)
            links[j].add(i)
    return [set().union(*(groups[i] for i in part)) for part in components(links)]


def louvain(g: Graph) -> list[set]:
    """Communities by greedy modularity: vertices, in order, move to the best neighbouring community until none gains; then
    communities become vertices. Deterministic: ties keep the present or smallest community."""
    if len(g) < 2:
        return []
    weight = {u: dict.fromkeys(vs, 1.0) for u, vs in g.items()}
    loops, members = dict.fromkeys(g, 0.0), {u: {u} for u in g}
    total = sum(len(vs) for vs in g.values()) / 2
    if not total:
        return [{u} for u in sorted(g)]
    while True:
        home = {u: u for u in weight}
        degree = {u: sum(vs.values()) + 2 * loops[u] for u, vs in weight.items()}
        held, moved_any, moving = dict(degree), False, True
        while moving:
            moving = False
            for u in sorted(weight):
                here = home[u]
                held[here] -= degree[u]
                to: dict = {here: 0.0}
                for v, w in weight[u].items():
                    to[home[v]] = to.get(home[v], 0.0) + w
                best = max(sorted(to), key=lambda c: (to[c] - held[c] * degree[u] / (2 * total), c == here))
                held[best] = held.get(best, 0.0) + degree[u]
                home[u] = best
                if best != here:
                    moving = moved_any = True
        if not moved_any:
            return list(members.values())
        new_weight: dict = {c: {} for c in set(home.values())}
        new_loops, new_members = dict.fromkeys(new_weight, 0.0), {c: set() for c in new_weight}
        for u, vs in weight.items():
            c = home[u]
            new_members[c] |= members[u]
            new_loops[c] += loops[u]
            for v, w in vs.items():
                if home[v] == c:
                    new_loops[c] += w / 2
                else:
                    new_weight[c][home[v]] = new_weight[c].get(home[v], 0.0) + w
        weight, loops, members = new_weight, new_loops, new_members


def partition(g: Graph, strategy: str, seed: str = "", square_threshold: float = 0.75, small: int = 10) -> list[set]:
    """Communities of g by the steps of a strategy such as "bc+k3", each refining every community of the one before."""
    steps = {
        "cc": components, "bc": blocks, "bicon": lambda h: [c - cut_vertices(h) for c in biconnected(h)], "cn2": lambda h: well_linked(h, 2), "cn3": lambda h: well_linked(h, 3), "k3": lambda h: clique_percolation(h, 3), "k4": lambda h: clique_percolation(h, 4), "louvain": louvain,
        "cos": lambda h: cosine_split(h, False, 0.4, small), "sqcos": lambda h: cosine_split(h, True, 0.7, small),
        "k3bin": lambda h: merge(h, [c for b in bins(set(h), seed) for c in clique_percolation(within(h, b), 3)]),
        "sqcosbin": lambda h: merge(h, [c for b in bins(set(h), seed) for c in cosine_split(within(h, b), True, square_threshold, small)]),
        "distributed": lambda h: [m for block in blocks(h) for m in merge(within(h, block), [c for b in bins(block, seed) for inner in blocks(within(h, b)) for c in clique_percolation(within(h, inner), 3)])],
    }
    groups = [set(g)]
    for step in strategy.split("+"):
        if step not in steps:
            raise ValueError(f"no such step: {step}")
        groups = [c for group in groups for c in steps[step](within(g, group))]
    return groups


def molecules(edges: DataFrame, strategy: str = "bc+k3", only: DataFrame | None = None, **options) -> DataFrame:
    """(u, nbr, mid): the molecule of u that each of its neighbours belongs to.

    Communities of two or more are numbered by falling size (ties: smallest member); where they share a neighbour the
    later one has it. With only(id), other vertices are not split: all their neighbours are molecule 0.

    A task folds a neighbour graph of up to FOLD rows. A larger one goes through the steps of hubs.py, all such graphs at
    once; only the steps cos, sqcos and louvain need a whole graph in a task.
    """
    near = both_ways(edges).select(F.col("u").alias("ego"), F.col("v").alias("a"), F.lit(None).cast(edges.schema["u"].dataType).alias("b"))
    rows = near.unionByName(ego_edges(edges).select("ego", F.col("v").alias("a"), F.col("w").alias("b")))
    split = F.lit(True)
    if only is not None:
        rows = rows.join(only.select(F.col("id").alias("ego"), F.lit(True).alias("_s")).distinct(), "ego", "left")
        split = F.coalesce("_s", F.lit(False))
    rows = rows.select("ego", "a", "b", split.alias("split"))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        ego, g = group["ego"].iloc[0], {}
        for a, b in zip(group["a"], group["b"]):
            g.setdefault(a, set())
            if not pd.isna(b):
                g[a].add(b)
                g.setdefault(b, set()).add(a)
        found = partition(g, strategy, str(ego), **options) if group["split"].iloc[0] else [set(g)]
        found = sorted((c for c in found if len(c) > 1), key=lambda c: (-len(c), min(c)))
        mids = {v: i for i, c in enumerate(found) for v in c}
        return pd.DataFrame({"u": [ego] * len(mids), "nbr": list(mids), "mid": list(mids.values())})

    kind = dict(edges.dtypes)["u"]
    rows = stored(rows, "egos")
    vast = rows.filter("split").groupBy("ego").agg(F.count("*").alias("n")).filter(F.col("n") > FOLD).select("ego")
    vast = stored(vast, "vast")
    if vast.isEmpty() or not set(strategy.split("+")) <= set(VAST):
        return rows.groupBy("ego").applyInPandas(fold, f"u {kind}, nbr {kind}, mid int")
    small = rows.join(vast, "ego", "left_anti").groupBy("ego").applyInPandas(fold, f"u {kind}, nbr {kind}, mid int")
    return small.unionByName(_vast_molecules(stored(rows.join(vast, "ego", "left_semi"), "hubs"), strategy, **options))


def _vast_molecules(rows: DataFrame, strategy: str, square_threshold: float = 0.75, small: int = 10) -> DataFrame:
    """molecules() of the neighbour graphs in rows(ego, a, b) by the steps of hubs.py."""
    egos = numbered(rows.select("ego").distinct(), [F.col("ego")], "g")
    named = rows.join(egos, "ego")
    member = stored(named.filter("b IS NULL").select("g", "ego", F.col("a").alias("v")), "member")
    links = stored(named.filter("b IS NOT NULL").select("g", F.col("a").alias("v"), F.col("b").alias("w")), "links")
    for step in strategy.split("+"):
        member, links = VAST[step](member, links, square_threshold, small)
    return hubs.numbered_molecules(member)


def _distributed_vast(member: DataFrame, links: DataFrame, *_):
    return hubs.binned(*hubs.without_cuts(member, links), lambda h: [c for inner in blocks(h) for c in clique_percolation(within(h, inner), 3)])


#: The steps of a strategy for neighbour graphs beyond a task.
VAST = {
    "cc": lambda m, e, *_: hubs.by_components(m, e), "bc": lambda m, e, *_: hubs.without_cuts(m, e), "bicon": lambda m, e, *_: hubs.by_blocks(m, e),
    "cn2": lambda m, e, *_: hubs.well_linked(m, e, 2), "cn3": lambda m, e, *_: hubs.well_linked(m, e, 3), "k3": lambda m, e, *_: hubs.percolated(m, e, 3), "k4": lambda m, e, *_: hubs.percolated(m, e, 4),
    "k3bin": lambda m, e, *_: hubs.binned(m, e, lambda h: clique_percolation(h, 3)),
    "sqcosbin": lambda m, e, threshold, small: hubs.binned(m, e, lambda h: cosine_split(h, True, threshold, small)), "distributed": _distributed_vast,
}


def weighted_cosine_split(weight: dict, squared: bool, threshold: float = 0.5, small: int = 10) -> list[set]:
    """As cosine_split, with the edges' weights in the matrix; a graph of fewer than `small` vertices keeps all its edges."""
    names = sorted(weight)
    at = {u: i for i, u in enumerate(names)}
    a = np.zeros((len(names),) * 2)
    for u, vs in weight.items():
        a[at[u], [at[v] for v in vs]] = list(vs.values())
    rows = a @ a if squared else a
    dots = rows @ rows.T  # of whole numbers, so that a cosine just at the threshold is found to be
    near = (dots**2 >= threshold**2 * np.outer(np.diag(dots), np.diag(dots))) | (len(names) < small)
    return components({u: {v for v in vs if near[at[u], at[v]]} for u, vs in weight.items()})


def refined(weight: dict, steps: list[str]) -> list[set]:
    """Communities of two or more of a weighted graph: those of the first step, each refined by the steps that follow."""
    if not steps:
        return [set(weight)]
    g = {u: set(vs) for u, vs in weight.items()}
    if steps[0] == "bc":
        cuts = cut_vertices(g)
        found = [c - cuts for c in biconnected(g)]
    elif steps[0] in ("cos", "coss", "cosq"):
        found = weighted_cosine_split(weight, steps[0] == "cosq")
    else:
        raise ValueError(f"no such step: {steps[0]}")
    return [c for f in found if len(f) > 1 for c in refined({u: {v: m for v, m in weight[u].items() if v in f} for u in f}, steps[1:])]


def binned_molecules(edges: DataFrame, strategy: str = "bc+cosq") -> DataFrame:
    """(u, nbr, mid): every vertex's neighbours are first dealt into bins of 50 at most, of nearly equal size; each bin's
    weighted graph is refined by the steps in turn (bc: biconnected components without cut vertices; cos, coss, cosq: cosine of the
    rows of the matrix, or of its square). Communities of two or more are numbered by bin, then by falling size.

    A bin is a task's work whatever the degree, so there are no hubs here. Bins are dealt by a hash of the two names.
    """
    near = both_ways(edges).select(F.col("u").alias("g"), F.col("u").alias("ego"), F.col("v"))
    spread = hubs.dealt(near, lambda n: F.ceil(n / hubs.BIN))
    a, b = spread.select("ego", "bin", "v"), spread.select("ego", "bin", F.col("v").alias("w"))
    inner = ego_edges(edges).join(a, ["ego", "v"]).join(b, ["ego", "bin", "w"]).select("ego", "bin", "v", "w", "m")
    steps = strategy.split("+")

    def fold(key, group):
        weight: dict = {}
        for v, w, m in zip(group["v"], group["w"], group["m"]):
            weight.setdefault(v, {})[w] = m
            weight.setdefault(w, {})[v] = m
        found = sorted(refined(weight, steps), key=lambda c: (-len(c), min(c)))
        return pd.DataFrame([(*key, i, v) for i, c in enumerate(found) for v in c], columns=["ego", "bin", "i", "v"])

    kind = dict(edges.dtypes)["u"]
    rows = stored(inner.groupBy("ego", "bin").applyInPandas(fold, f"ego {kind}, bin long, i int, v {kind}"), "binned")
    mid = F.row_number().over(W.Window.partitionBy("ego").orderBy("bin", "i")) - 1
    names = rows.select("ego", "bin", "i").distinct().withColumn("mid", mid.cast("int"))
    return rows.join(names, ["ego", "bin", "i"]).select(F.col("ego").alias("u"), F.col("v").alias("nbr"), "mid")


def molecule_graph(edges: DataFrame, strategy: str = "bc+k3", only: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) after splitting: ids are u_mid; molecules without an edge are gone."""
    found = relabel_molecules(edges, molecules(edges, strategy, only, **options))
    return found.select(F.explode(F.array("u", "v")).alias("id")).distinct(), found


def count_molecules(edges: DataFrame, least: int = 4) -> DataFrame:
    """(id, mol): biconnected components of at least `least` vertices in every vertex's neighbour graph; graphs of more than
    FOLD edges are cut into blocks all at once."""
    rows = stored(ego_edges(edges).select("ego", "v", "w"), "egos")
    vast = stored(rows.groupBy("ego").agg(F.count("*").alias("n")).filter(F.col("n") > FOLD).select("ego"), "vast")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        g: Graph = {}
        for a, b in zip(group["v"], group["w"]):
            g.setdefault(a, set()).add(b)
            g.setdefault(b, set()).add(a)
        return pd.DataFrame({"id": group["ego"].iloc[:1], "mol": [sum(len(c) >= least for c in biconnected(g))]})

    kind = dict(edges.dtypes)["u"]
    if vast.isEmpty():
        counted = rows.groupBy("ego").applyInPandas(fold, f"id {kind}, mol long")
    else:
        counted = rows.join(vast, "ego", "left_anti").groupBy("ego").applyInPandas(fold, f"id {kind}, mol long")
        node = lambda c: F.struct("ego", F.col(c).alias("v"))
        named = tours.blocks(stored(rows.join(vast, "ego", "left_semi").select(node("v").alias("u"), node("w").alias("v"), F.lit(1).cast("long").alias("m")), "hubs"))
        sizes = named.select("block", F.explode(F.array("u", "v")).alias("id")).distinct().groupBy("block", F.col("id")["ego"].alias("id")).agg(F.count("*").alias("n"))
        counted = counted.unionByName(sizes.groupBy("id").agg(F.count_if(F.col("n") >= least).alias("mol")))
    ids = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    return ids.join(counted, "id", "left").select("id", F.coalesce("mol", F.lit(0)).cast("long").alias("mol"))


def biconnected(g: Graph) -> list[set]:
    """Biconnected components, cut vertices in each of theirs: a depth-first search keeps the edges since each branch point."""
    order, low, found = {}, {}, []
    for root in sorted(g):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        walk, edges = [(root, None, iter(sorted(g[root])))], []
        while walk:
            u, parent, rest = walk[-1]
            step = next(rest, None)
            if step is None:
                walk.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[u])
                    if low[u] >= order[parent]:
                        block: set = set()
                        while (parent, u) != (last := edges.pop()):
                            block.update(last)
                        found.append(block | {parent, u})
            elif step not in order:
                order[step] = low[step] = len(order)
                edges.append((u, step))
                walk.append((step, u, iter(sorted(g[step]))))
            elif step != parent and order[step] < order[u]:
                edges.append((u, step))
                low[u] = min(low[u], order[step])
    return found

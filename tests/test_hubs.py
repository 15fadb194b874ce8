"""Neighbour graphs beyond one task, against the folds of one graph a task; triangles and bitsets against plain loops."""

import random
from itertools import combinations

import pytest

from strandweave.operators import communities as com
from strandweave.operators import overlap


def graph_of(seed, n, chance):
    r = random.Random(seed)
    return [(u, v, r.randrange(1, 9)) for u, v in combinations(range(n), 2) if r.random() < chance]


def frame(spark, rows):
    return spark.createDataFrame(rows, "u long, v long, m long").coalesce(2)


def sets_of(edges):
    g = {}
    for u, v, *_ in edges:
        g.setdefault(u, set()).add(v)
        g.setdefault(v, set()).add(u)
    return g


def test_triangles_neighbours_and_ego_edges(spark):
    edges = graph_of(1, 25, 0.3) + [(0, 100 + i, 1) for i in range(30)]  # a hub of many leaves
    edges = sorted({(u, v): m for u, v, m in edges}.items())
    edges = [(u, v, m) for (u, v), m in edges]
    g, weight = sets_of(edges), {(u, v): m for u, v, m in edges}
    want = {c for c in combinations(sorted(g), 3) if all(p in weight for p in combinations(c, 2))}
    rows = overlap.triangles(frame(spark, edges)).collect()
    assert len(rows) == len(want) and {tuple(sorted((r.a, r.b, r.c))) for r in rows} == want
    of = lambda x, y: weight[min(x, y), max(x, y)]
    assert all((r.ab, r.ac, r.bc) == (of(r.a, r.b), of(r.a, r.c), of(r.b, r.c)) for r in rows)
    assert sorted(map(tuple, overlap.common_neighbours(frame(spark, edges)).collect())) == [(u, v, len(g[u] & g[v])) for u, v, _ in edges]
    inner = sorted((e, *p, weight[p]) for c in want for e in c for p in [tuple(sorted(set(c) - {e}))])
    assert sorted(map(tuple, overlap.ego_edges(frame(spark, edges)).collect())) == inner


@pytest.mark.parametrize("seed", range(3))
def test_cliques_by_bits(seed):
    g = sets_of(graph_of(seed, 16, 0.4))
    for k in (3, 4):
        cliques = [set(c) for c in combinations(sorted(g), k) if all(b in g[a] for a, b in combinations(c, 2))]
        root = list(range(len(cliques)))
        for i, j in combinations(range(len(cliques)), 2):
            if len(cliques[i] & cliques[j]) == k - 1:
                root = [root[i] if r == root[j] else r for r in root]
        want = [set().union(*(c for c, r in zip(cliques, root) if r == x)) for x in set(root)]
        assert sorted(map(sorted, com.clique_percolation(g, k))) == sorted(map(sorted, want))
    linked = {u: {v for v in vs if len(g[u] & g[v]) >= 2} for u, vs in g.items()}
    assert sorted(map(sorted, com.well_linked(g, 2))) == sorted(map(sorted, com.blocks(linked)))


def communities_of(rows):
    found = {}
    for r in rows:
        found.setdefault((r.u, r.mid), set()).add(r.nbr)
    return sorted((u, tuple(sorted(c))) for (u, _), c in found.items())


@pytest.mark.parametrize("strategy", ["cn2+k3", "k4+bicon", "distributed+sqcosbin"])
def test_hubs_split_like_folds(spark, monkeypatch, strategy):
    """The hub's neighbour graph goes through rounds, the others are folded; and the same with all folded."""
    r = random.Random(5)
    inner = [e for i in range(3) for e in ((u + 20 * i, v + 20 * i, m) for u, v, m in graph_of(i + 7, 14, 0.45))] + [(3, 24, 1), (25, 45, 2)]
    hub = [(u, 99, r.randrange(1, 5)) for u in sorted({x for e in inner for x in e[:2]})]
    edges = frame(spark, inner + hub)
    folded = com.molecules(edges, strategy, square_threshold=0.5, small=4).collect()
    monkeypatch.setattr(com, "FOLD", 60)
    mixed = com.molecules(edges, strategy, square_threshold=0.5, small=4).collect()
    assert communities_of(mixed) == communities_of(folded) and any(x.u == 99 for x in folded)
    assert sorted((x.u, x.mid) for x in mixed) == sorted((x.u, x.mid) for x in folded)


def test_counting_molecules_of_hubs(spark, monkeypatch):
    inner = graph_of(11, 18, 0.3)
    edges = frame(spark, inner + [(u, 99, 1) for u in range(18)])
    folded = sorted(map(tuple, com.count_molecules(edges).collect()))
    monkeypatch.setattr(com, "FOLD", 20)
    assert sorted(map(tuple, com.count_molecules(edges).collect())) == folded and folded[-1][0] == 99


def plain_binned(edges, steps):
    """binned_molecules() by loops over plain lists and full matrices."""
    import zlib

    weight = {}
    for u, v, m in edges:
        weight.setdefault(u, {})[v] = m
        weight.setdefault(v, {})[u] = m

    def alike(a, b):
        dot = lambda p, q: sum(x * y for x, y in zip(p, q))
        return 4 * dot(a, b) ** 2 >= dot(a, a) * dot(b, b)

    def split(nodes, step):
        links = {(x, y) for x in nodes for y in nodes if y in weight[x]}
        linked = sorted({x for p in links for x in p})
        if step == "bc":
            block = {frozenset(p): i for i, c in enumerate(com.biconnected(sets_of([(x, y) for x, y in links if x < y]))) for p in combinations(sorted(c), 2) if p in links}
            of = {x: {block[frozenset((x, y))] for y in linked if (x, y) in links} for x in linked}
            return [{x for x in linked if of[x] == {i}} for i in set(block.values())]
        rows = [[weight[x].get(y, 0) if y in nodes else 0 for y in linked] for x in linked]
        if step == "cosq":
            rows = [[sum(r[k] * rows[k][j] for k in range(len(rows))) for j in range(len(rows))] for r in rows]
        keep = {(x, y) for (i, x) in enumerate(linked) for (j, y) in enumerate(linked) if (x, y) in links and (len(linked) < 10 or alike(rows[i], rows[j]))}
        return com.components({x: {y for y in linked if (x, y) in keep} for x in linked})

    found = []
    for ego, near in weight.items():
        order = sorted(near, key=lambda v: (zlib.crc32(f"{ego}/{v}".encode()), v))
        n = -(-len(order) // 50)
        for i in range(n):
            groups = [set(order[i::n])]
            for step in steps:
                groups = [c for g in groups for c in split(g, step) if len(c) > 1]
            found += [(ego, tuple(sorted(c))) for c in groups]
    return sorted(found)


@pytest.mark.parametrize("strategy", ["bc+cosq", "coss"])
def test_bins_come_first(spark, strategy):
    edges = graph_of(4, 16, 0.5) + [(u + 100, v + 100, m) for u, v, m in graph_of(6, 60, 0.12)] + [(u, 500, 2) for u in range(100, 160)] + [(u, 500, 7) for u in range(9)]
    rows = com.binned_molecules(frame(spark, edges), strategy).collect()
    assert communities_of(rows) == plain_binned(edges, strategy.split("+"))
    assert all(sorted({r.mid for r in rows if r.u == u}) == list(range(1 + max(r.mid for r in rows if r.u == u))) for u in {r.u for r in rows})

"""Small hand-typed inputs with known results."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from strandweave.functions import scalar as fn
from strandweave.operators import communities as com
from strandweave.operators import graph, incidence, mapping, overlap, reports, scaffold, tours, trees
from strandweave.plans.shared import numbered
from strandweave.sources import sinks, text


def pairs(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_size_bounds_and_whisker(spark):
    rows = [(b, m) for m in range(20) for b in range(2 + (m == 3) * 9)] + [(50, 99)]
    bxmx = pairs(spark, rows, "bx long, mx long")
    assert incidence.drop_singletons(bxmx).filter("mx = 99").isEmpty()
    assert incidence.whisker(bxmx) == 2
    assert incidence.drop_repetitive(bxmx, 4).filter("mx = 3").isEmpty() and not incidence.filter_incidence(bxmx, 2, None, 4).filter("mx = 3").isEmpty()
    assert incidence.bound_sizes(bxmx, 20, 21).select("bx").distinct().count() == 2
    assert incidence.whisker(bxmx.limit(0)) is None and incidence.filter_incidence(bxmx.limit(0)).count() == 0


def test_percentile_edges(spark):
    e = pairs(spark, [(i, i + 1, m) for i, m in enumerate([5, 1, 3, 3, 9])], "u long, v long, m long")
    assert overlap.percentile_threshold(e, 50) == 3 and overlap.filter_percentile(e, 0).count() == 5 and overlap.filter_percentile(e, 90).count() == 1
    with pytest.raises(ValueError):
        overlap.filter_percentile(e, 100)


def random_graph(seed, n, p):
    r = random.Random(seed)
    return [(a, b, r.randrange(1, 9)) for a, b in combinations(range(n), 2) if r.random() < p]


def as_graph(edges):
    g = {}
    for a, b, _ in edges:
        g.setdefault(a, set()).add(b)
        g.setdefault(b, set()).add(a)
    return g


def brute_cuts(g):
    n = len(com.components(g))
    return {u for u in g if len(com.components(com.within(g, set(g) - {u}))) > n - (not g[u])}


@pytest.mark.parametrize("seed", range(12))
def test_cut_vertices_and_cliques(seed):
    g = as_graph(random_graph(seed, 14, 0.16))
    assert com.cut_vertices(g) == brute_cuts(g)
    inside = [c for c in com.biconnected(g)]
    assert sorted(tuple(sorted(e)) for c in inside for e in combinations(sorted(c), 2) if e[1] in g[e[0]]) == sorted((a, b) for a in g for b in g[a] if a < b)
    for k in (3, 4):
        cliques = [set(c) for c in combinations(sorted(g), k) if all(b in g[a] for a, b in combinations(c, 2))]
        merged = [set(c) for c in cliques]
        groups = []
        while cliques:
            group, front = set(), [cliques.pop()]
            while front:
                c = front.pop()
                group |= c
                near = [d for d in cliques if len(c & d) == k - 1]
                cliques = [d for d in cliques if d not in near]
                front += near
            groups.append(group)
        assert sorted(map(sorted, com.clique_percolation(g, k))) == sorted(map(sorted, groups)) and (merged or not groups)


def test_communities():
    two = [(a, b, 1) for a, b in combinations(range(6), 2)] + [(a, b, 1) for a, b in combinations(range(6, 12), 2)] + [(5, 6, 1)]
    g = as_graph(two)
    halves = [set(range(6)), set(range(6, 12))]
    assert sorted(map(sorted, com.louvain(g))) == sorted(map(sorted, halves))
    assert sorted(map(sorted, com.partition(g, "cos"))) == sorted(map(sorted, halves))
    assert sorted(map(sorted, com.partition(g, "cn2"))) == sorted(map(sorted, halves))
    assert com.merge(g, halves, 0) == [set(range(12))] and com.merge(g, halves) == halves
    assert [len(b) for b in com.bins(set(range(120)), "x")] == [40, 40, 40]
    with pytest.raises(ValueError):
        com.partition(g, "none")


def test_molecules_split_a_shared_vertex(spark):
    left, right = [0, 1, 2, 3], [0, 4, 5, 6]
    e = pairs(spark, [(a, b, 100) for side in (left, right) for a, b in combinations(side, 2)], "u long, v long, m long")
    vertices, found = com.molecule_graph(e, "bc")
    assert {r.id for r in vertices.collect() if r.id.startswith("0_")} == {"0_0", "0_1"}
    assert found.count() == e.count()
    only = com.molecules(e, "bc", pairs(spark, [(1,)], "id long"))
    assert only.filter("u = 0").select("mid").distinct().count() == 1
    assert {r.id: r.mol for r in com.count_molecules(pairs(spark, [(a, b, 1) for a, b in combinations(range(6), 2)], "u long, v long, m long")).collect()} == dict.fromkeys(range(6), 1)


def test_end_to_end_backbone(spark):
    """A centre tied to a triangle's corners, all weights alike: the star's diameter from the smallest names."""
    e = pairs(spark, [("A", "B", 100), ("A", "C", 100), ("B", "C", 100), ("A", "I", 100), ("A", "J", 100), ("I", "J", 100)], "u string, v string, m long")
    path = [r.elem for r in trees.backbones(e, 1).orderBy("tid", "pos").collect()]
    assert path[:3] == ["B", "A", "C"]


@pytest.mark.parametrize("seed", range(4))
def test_forest_is_kruskals(spark, seed):
    edges = random_graph(seed, 25, 0.15)
    root = {x: x for e in edges for x in e[:2]}
    kept = set()
    for u, v, m in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        a, b = root[u], root[v]
        if a != b:
            kept.add((u, v, m))
            root = {x: a if r == b else r for x, r in root.items()}
    assert {tuple(r) for r in graph.maximum_spanning_forest(pairs(spark, edges, "u long, v long, m long")).collect()} == kept


def test_tree_kernels():
    t = {}
    for u, v in [(i, i + 1) for i in range(20)] + [(10, 30), (30, 31), (5, 40)]:
        t.setdefault(u, {})[v] = 1
        t.setdefault(v, {})[u] = 1
    length = trees.branch_lengths(t)
    assert length[10, 30] == 2 and length[5, 40] == 1 and length[10, 9] == 10 and length[40, 5] == 16
    pruned = trees.prune(t, 3)
    assert 30 not in pruned and 40 not in pruned and trees.far_path(pruned, 0) == list(range(20, -1, -1))
    assert trees.junctions_of(t, 2) == {10} and trees.junctions_of(t, 1) == {5, 10}
    assert len(trees.backbones_of(t, 3, 0)) == 1


def test_chimera(spark):
    e = pairs(spark, [(i, j, 1) for i, j in combinations(range(5), 2)] + [(i, j, 1) for i, j in combinations(range(6, 11), 2)] + [(4, 5, 1), (5, 6, 1)], "u long, v long, m long")
    paths = pairs(spark, [(0, i, i) for i in range(11)], "tid long, pos int, elem long")
    rows = {r.elem: r for r in graph.chimera_diagnostics(e, paths, 2, 1).collect()}
    assert (rows[5].overlap, rows[5].depth, rows[5].support) == (0, 0, 0)
    assert rows[2].overlap == 4 and rows[2].us == rows[2].ws == 2 and 0 not in rows and 10 not in rows
    pieces = graph.cut_chimera(paths, e, 2, 3, 1).collect()
    assert {r.piece for r in pieces} == {0, 1} and 5 not in {r.elem for r in pieces}


def test_subgraph_rules(spark):
    e = pairs(spark, [(i, i + 1, 1) for i in range(9)] + [(0, 2, 1)], "u long, v long, m long")
    v = overlap.ends(e)
    seed = pairs(spark, [(1,)], "id long")
    assert {tuple(r)[:2] for r in graph.subgraph(v, e, seed, 1)[1].collect()} == {(0, 2)}
    assert {r.id for r in graph.subgraph(v, e, seed, 2, pairs(spark, [(0,)], "id long"))[0].collect()} == {1, 2, 3}
    with pytest.raises(ValueError):
        graph.subgraph(v, e, seed, 21)
    assert [r.id for r in graph.shortest_path(e, 0, 5).orderBy("pos").collect()] == [0, 2, 3, 4, 5]
    assert graph.tiling_graph(e, pairs(spark, [(0, 0, 1), (0, 1, 4)], "tid long, pos int, elem long")).count() == 3
    names = pairs(spark, [("a",), ("b",), ("z",)], "name string")
    assert {r.id for r in graph.seed_vertices(names, pairs(spark, [("a_0",), ("a_1",), ("a_3",), ("b",)], "id string")).collect()} == {"a_0", "a_1", "b"}


def brute_trend(x, eps):
    gaps = [b - a for i, a in enumerate(x) for b in x[i + 1 :]]
    s = sum((g > eps) - (g < -eps) for g in gaps)
    ties = [sum(abs(y - v) < eps for y in x) for v in set(x)]
    n = len(x)
    spread = (n * (n - 1) * (2 * n + 5) - sum(q * (q - 1) * (2 * q + 5) for q in ties)) / 18
    return s, (s - (s > 0) + (s < 0)) / math.sqrt(spread) if spread > 0 and abs(s) > eps else 0.0


@pytest.mark.parametrize("seed", range(6))
def test_mann_kendall(seed):
    import numpy as np

    r = random.Random(seed)
    x = [float(r.randrange(12)) + i * (seed - 2) / 4 for i in range(r.choice([2, 3, 30, 64, 65, 130]))]
    for eps in (1.0, 0.3, 2.0):
        found = mapping.mann_kendall(np.array(x), eps=eps)
        s, z = brute_trend(x, eps)
        assert (found.s, round(found.z, 9)) == (s, round(z, 9))
    up, down = (mapping.mann_kendall(np.array(x), alternative=a) for a in ("up", "down"))
    both = mapping.mann_kendall(np.array(x), alpha=0.1)
    assert up.accepted == (up.z >= 1.6448536269514722) and down.accepted == (down.z <= -1.6448536269514722) and both.accepted == (up.accepted or down.accepted)
    if abs(both.s) > 1:
        assert abs(up.p + down.p - 1) < 1e-12 and abs(both.p - 0.5 * min(up.p, down.p)) < 1e-12
    else:  # no trend that is more than a tie
        assert up.p == down.p == both.p == 0.5
    slope, intercept = np.polyfit(np.arange(len(x)), x, 1)
    assert abs(both.slope - slope) < 1e-9 and abs(both.intercept - intercept) < 1e-9


def test_mann_kendall_of_many_and_of_ties():
    import numpy as np

    rising = mapping.mann_kendall(np.arange(0, 400_000, 2.0))
    assert rising.s == 200_000 * 199_999 // 2 and rising.p < 0.01 and rising.accepted
    assert mapping.mann_kendall(np.zeros(9)).p == 0.5 and mapping.mann_kendall(-np.arange(0, 40, 2.0)).z < 0
    with pytest.raises(ValueError):
        mapping.mann_kendall(np.zeros(3), alternative="sideways")


def test_trend_orients_by_the_path(spark):
    """A query whose markers lie backwards on a path: the trend along the query is sure, the orientation is the path's."""
    queries = pairs(spark, [("q", i, i) for i in range(30)], "qid string, qpos int, mx long")
    for order, sign in ((range(30), "+"), (range(29, -1, -1), "-")):
        index = pairs(spark, [(m, 0, t) for t, m in enumerate(order)], "mx long, tid long, tpos int")
        assert {r.orientation for r in mapping.map_trend(queries, index).collect()} == {sign}


def test_scalar_functions(spark):
    row = spark.range(1).select(
        fn.reverse_complement(F.lit("ACGTNUmk")).alias("rc"), fn.oriented(F.lit("AAC"), F.lit("x-")).alias("o"), fn.unpack_kmer(fn.pack_kmer(F.lit("GATTACA")), 7).alias("k"),
        fn.print_unsigned(fn.parse_unsigned(F.lit("18137412081318970458"))).alias("u"), fn.parse_unsigned(F.lit("18137412081318970458")).alias("s"), fn.unhash_long(fn.hash_long(F.lit(-77))).alias("h"),
        fn.normal_estimate(F.lit(5.0), F.lit(0.5), F.lit(10.0)).alias("n"), fn.valid_pair(F.lit("b"), F.lit("b"), F.lit("r/1"), F.lit("r/2")).alias("p"), fn.plain_elements(F.lit("(a,b)")).alias("e"), fn.minutes(F.lit("1:30:00")).alias("m"), fn.minutes(F.lit("2:30")).alias("m2"),
    ).first()
    assert (row.rc, row.o, row.k, row.u, row.s, row.h, row.p, row.e, row.m, row.m2) == ("mkANACGT", "GTT", "GATTACA", "18137412081318970458", -309331992390581158, -77, True, ["a", "b"], 90.0, 2.5)
    assert math.isclose(row.n, 0.5)


def test_readers_and_writers(spark, tmp_path):
    put = lambda name, body: (tmp_path / name).write_text(body) and str(tmp_path / name)
    fasta = text.read_fasta(spark, put("a.fa", ">one BX:Z:AC-1 x\nACG\nT\n>two\nNN\n>three c\n")).collect()
    assert {(r.name, r.seq, r.bx) for r in fasta} == {("one", "ACGT", "AC-1 x"), ("two", "NN", None), ("three", "", None)}
    fastq = text.read_fastq(spark, put("a.fq", "@r1 BX:Z:B1\nAC\n+\n@@\n@r2#5_6/1\nGG\n+\nII\n@r3\nTT\n+\n")).orderBy("ord").collect()
    assert [(r.name, r.seq, r.bx, r.qual) for r in fastq] == [("r1", "AC", "B1", "@@"), ("r2#5_6/1", "GG", None, "II"), ("r3", "TT", None, None)]
    reads = text.read_fastq(spark, str(tmp_path / "a.fq"))
    assert {r.b for r in reads.select(text.linked_barcode(F.col("name"), F.col("bx"), F.lit(True)).alias("b")).collect()} == {"B1", "5_6", "NA"}
    markers = text.read_markers(spark, put("m.tsv", "a\t1 2:5 2\nb\t18137412081318970458\na 3\nc\n"))
    assert {tuple(r) for r in markers.collect()} == {("a", 1), ("a", 2), ("a", 3), ("b", -309331992390581158)}
    assert {r.value for r in sinks.marker_lines(markers).collect()} == {"a\t1 2 3", "b\t18137412081318970458"}
    lists = text.read_marker_lists(spark, put("l.tsv", "q\t7:10 7:20 8:30\n"))
    assert [(r.qpos, r.mx, r.pos) for r in lists.orderBy("qpos").collect()] == [(0, 7, 10), (1, 7, 20), (2, 8, 30)]
    with pytest.raises(ValueError):
        text.read_marker_lists(spark, put("l2.tsv", "q\t7\nq\t8\n"))
    v, e = text.read_graph(spark, put("g.tsv", "U\tm\na\t3\nb\t4\n\nU\tV\tm\nb\ta\t9\na\tb\t7\n"))
    assert {tuple(r) for r in v.collect()} == {("a", 3, None), ("b", 4, None)} and [tuple(r) for r in e.collect()] == [("a", "b", 7)]
    sinks.write_graph(v.select("id", "m"), e, str(tmp_path / "g_out"))
    v2, e2 = text.read_graph(spark, str(tmp_path / "g_out"))
    assert v2.count() == 2 and e2.count() == 1
    sinks.write_graph(v, e, str(tmp_path / "gv"), "gv")
    v3, e3 = text.read_graphviz(spark, str(tmp_path / "gv"))
    assert {tuple(r) for r in v3.collect()} == {("a", 3), ("b", 4)} and e3.first().m == 7
    paths = text.read_paths(spark, put("p.path", "x y+ (a,b)\n\nz\n"))
    assert {r.value for r in sinks.path_lines(paths).collect()} == {"x y+ (a,b)", "z"}
    bed = text.read_bed(spark, put("x.bed", "t\t1\t2\tq\t5\nNA\tNA\tNA\tNA\tNA\tNA\nt\t1\t2\tq\t5\t-\nq\t9\t0\t3\t+\tt\t8\t4\t5\t6\t7\t1\n"))
    assert {(r.orientation, r.tstart, r.score) for r in bed.collect()} == {(".", 1, 5), ("-", 1, 5), ("+", 4, 6)}
    assert text.read_histogram(spark, put("h", "k f n\n31 1 5\n31 2 7\n")).agg(F.sum("n")).first()[0] == 12
    assert text.read_evidence(spark, put("ev", "a b 1 2 3 4\n")).filter("u = 'b'").first().ht == 3
    assert {tuple(r) for r in text.read_distances(spark, put("d", "contig1 contig2 min avg max\na+ b- 1 2 3\n"), "max").collect()} == {("a", "b", 3), ("b", "a", 3)}
    assert text.read_names(spark, put("n", "a b\nc\n")).count() == 2 and text.read_repeats(spark, put("r", "ACG 3\n")).first().n == 3
    placed = pairs(spark, [(0, 0, "n")], "tid long, after int, id string")
    assert "x (n) y+ (a,b)" in {r.value for r in sinks.fleshed_lines(paths, placed).collect()}


def test_orientation_from_evidence(spark):
    paths = pairs(spark, [(0, 0, "a."), (0, 1, "b+"), (0, 2, "c."), (1, 0, "z.")], "tid long, pos int, elem string")
    evidence = pairs(spark, [("a", "b", 0, 0, 50, 1), ("b", "c", 0, 0, 0, 40)], "u string, v string, hh long, ht long, th long, tt long")
    got = {(r.tid, r.pos): r.elem for r in scaffold.orient_paths(paths, evidence).collect()}
    assert got == {(0, 0): "a+", (0, 1): "b+", (0, 2): "c-", (1, 0): "z+"}


def test_gaps_and_modes(spark):
    seqs = pairs(spark, [("s", "NNACNNNGN"), ("t", "ACGT"), ("u", "")], "name string, seq string")
    assert {(r.name, r.start, r.end) for r in scaffold.gaps(seqs, "N", 2).collect()} == {("s", 0, 2), ("s", 4, 7)}
    hist = pairs(spark, [(1, 90), (2, 20), (3, 30), (4, 50), (5, 40)], "f int, n long")
    assert scaffold.depth_mode(hist).first().mode == 4
    assert scaffold.ngxx(pairs(spark, [(10,), (6,), (4,)], "size long"), 20, 0.5, 0.75, 2.0) == [10, 6, 0]


def kruskal(edges):
    root, kept = {x: x for e in edges for x in e[:2]}, []
    for u, v, m in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        a, b = root[u], root[v]
        if a != b:
            kept.append((u, v, m))
            root = {x: a if r == b else r for x, r in root.items()}
    return kept


def tree(edges):
    t = {}
    for u, v, m in edges:
        t.setdefault(u, {})[v] = m
        t.setdefault(v, {})[u] = m
    return t


@pytest.mark.parametrize("seed", range(2))
def test_bridges_go_until_none_is_left(spark, seed):
    edges = random_graph(seed + 20, 24, 0.12)
    expected = edges
    while bad := trees.bridges_of(trees.prune(tree(kruskal(expected)), 2), 4):
        expected = [e for e in expected if not bad & set(e[:2])]
    assert expected != edges
    got, forest = trees.unbridged(pairs(spark, edges, "u long, v long, m long"), 2, 4)
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)
    assert sorted(tuple(r)[:3] for r in forest.collect()) == sorted(kruskal(expected))
    t = [(u, v, m) for u, vs in trees.prune(tree(kruskal(edges)), 2).items() for v, m in vs.items() if u < v]
    assert {r.id for r in graph.bridges(pairs(spark, t, "u long, v long, m long"), 4).collect()} == trees.bridges_of(tree(t), 4)


def test_bridges_of_nothing(spark):
    none = spark.createDataFrame([], "u string, v string, m long")
    assert trees.remove_bridges(none, 2, 4).isEmpty() and trees.unbridged(none, 2, 0)[1].isEmpty() and trees.backbones(none, 1).isEmpty()


def test_numbering_goes_on_over_tasks(spark):
    rows = numbered(spark.range(1000).repartition(7).withColumn("k", F.col("id") % 10), [F.desc("k"), F.col("id")], "at")
    assert [(r.k, r.id) for r in rows.orderBy("at").collect()] == sorted(((i % 10, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))
    assert rows.agg(F.min("at"), F.max("at"), F.count_distinct("at")).first() == (1, 1000, 1000) and numbered(spark.range(0), [F.col("id")], "at").isEmpty()


def test_split_reads(spark):
    pair = pairs(spark, [(1, "r/1", "r/2", "A", "A"), (2, "s/1", "s/2", "A", "A"), (3, "t", "t", "B", "B"), (4, "u", "u", "A", None), (5, "v", "w", "A", "A"), (6, "x", "x", "A", "A")], "pair long, name1 string, name2 string, bx1 string, bx2 string")
    markers = pairs(spark, [(1, "A", 10), (1, "A", 11), (1, "A", 20), (2, "A", 99), (4, "A", 10), (6, "A", 10), (6, "A", 20)], "pair long, bx string, mx long")
    molecules = pairs(spark, [("A_0", 10), ("A_0", 11), ("A_1", 20)], "id string, mx long")
    assert {r.pair: r.bx for r in overlap.split_reads(pair, markers, molecules).collect()} == {1: "A_0", 2: "A", 6: "A_0"}
    assert {r.pair: r.bx for r in overlap.split_reads(pair, markers, molecules, only_split=False).collect()} == {1: "A_0", 2: "A", 3: "B", 4: None, 5: None, 6: "A_0"}
    with pytest.raises(Exception, match="not those of the pair"):
        overlap.split_reads(pair, pairs(spark, [(1, "Z", 10)], "pair long, bx string, mx long"), molecules).collect()
    assert overlap.split_reads(pair.limit(0), markers, molecules).isEmpty()


def test_chromosomes_and_their_graphviz(spark):
    vertices = pairs(spark, [("a",), ("b",), ("c",), ("d",)], "id string")
    found = scaffold.annotate_chromosomes(vertices, pairs(spark, [("a", "10"), ("b", "9"), ("c", "X"), ("e", "X")], "bx string, chrom string"))
    assert {r.id: (r.chrom, r.hue) for r in found.collect()} == {"a": ("10", 0.333), "b": ("9", 0.0), "c": ("X", 0.667), "d": (None, None)}
    lines = sinks.chromosome_graphviz_lines(found, pairs(spark, [("b", "a", 7)], "u string, v string, m long")).orderBy("part", "value").collect()
    assert [r.value for r in lines[1:]] == ['"a" [label="10" color="0.333,1,1"]', '"b" [label="9" color="0.0,1,1"]', '"c" [label="X" color="0.667,1,1"]', '"d"', '"a" -- "b" [label=7]', "}"]


def test_biconnected_molecules_and_reports(spark):
    cycle = {i: {(i - 1) % 6, (i + 1) % 6} for i in range(6)}
    for cut, leaf in ((0, 6), (3, 7)):
        cycle[cut].add(leaf)
        cycle[leaf] = {cut}
    assert sorted(sorted(c) for c in com.partition(cycle, "bicon") if len(c) > 1) == [[1, 2, 4, 5]]
    a, b = pairs(spark, [("x_y.z", 1)], "name string, n long"), pairs(spark, [("q", 2, 3)], "name string, n long, extra long")
    rows = reports.stack_reports([a, b], drop=["n"]).withColumn("title", reports.picked(reports.readable(F.col("name"), {"y": "Y", ".z": " z"}), "x", "Y z"))
    assert sorted((r.name, r.extra, r.title) for r in rows.collect()) == [("q", 3, ""), ("x_y.z", None, "x Y z")]
    assert spark.range(1).select(reports.percent(F.lit(343), F.lit(2000)).alias("p")).first().p == "17.2%"


def test_vast_trees_give_the_same(spark, monkeypatch):
    """Pruning, junctions and diameters by rounds over all trees at once, against one tree a task."""
    r = random.Random(1)
    edges = [(r.randrange(max(0, i - 4), i), i, r.randrange(1, 9)) for i in range(1, 16)]
    forest = pairs(spark, [(*e, 0) for e in edges], "u long, v long, m long, tree long").coalesce(1)
    t = tree(edges)
    rows = lambda df: sorted(map(tuple, df.collect()))
    pruned = trees.prune(t, 2)
    assert rows(trees._prune_vast(forest, 2).select("u", "v", "m")) == sorted((u, v, m) for u, vs in pruned.items() for v, m in vs.items() if u < v)
    assert {x.id for x in trees._junctions_vast(forest, 2).collect()} == trees.junctions_of(t, 2)
    assert rows(tours.far_paths(forest).select("pos", "elem")) == list(enumerate(trees.far_path(t, 0)))


def test_branches_are_measured_by_messages(spark):
    r = random.Random(9)
    edges = [(r.randrange(max(0, i - 3), i), i, 1) for i in range(1, 30)]
    length = trees.branch_lengths(tree(edges))
    for most in (1, 3, 40):
        rows = trees.branch_reach(pairs(spark, edges, "u long, v long, m long"), most).collect()
        assert all((x.lv, x.lu) == (min(most, length[x.u, x.v]), min(most, length[x.v, x.u])) for x in rows)


@pytest.mark.parametrize("seed", range(2))
def test_shortest_paths_all_at_once(spark, seed):
    edges = random_graph(seed + 40, 25, 0.12)
    g = as_graph(edges)
    tips = [(i, a, b) for i, (a, b) in enumerate([(0, 9), (3, 20), (5, 5), (7, 24), (1, 2)]) if a in g and b in g]
    got = {}
    for x in graph.shortest_paths(pairs(spark, edges, "u long, v long, m long"), pairs(spark, tips, "tid long, a long, b long")).collect():
        got.setdefault(x.tid, {})[x.pos] = x.id
    for tid, a, b in tips:
        gap, parent, front = {a: 0}, {a: None}, [a]
        while front:
            new = {}
            for u in sorted(front):
                for v in g[u]:
                    if v not in gap and v not in new:
                        new[v] = u
            gap.update({v: gap[u] + 1 for v, u in new.items()})
            parent.update(new)
            front = list(new)
        path = [b] if b in gap else []
        while path and parent[path[-1]] is not None:
            path.append(parent[path[-1]])
        assert [got.get(tid, {}).get(i) for i in range(len(path))] == path[::-1] and len(got.get(tid, {})) == len(path)


def test_files_of_paths_markers_and_names(spark, tmp_path):
    (tmp_path / "a").write_text("x y\n\nz\n")
    (tmp_path / "b").write_text("x\n")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    assert sorted(map(tuple, text.read_paths(spark, [b, a]).collect())) == [(0, 0, "x"), (1, 0, "x"), (1, 1, "y"), (3, 0, "z")]
    (tmp_path / "m").write_text("q\t5:1 7\n")
    assert [r.pos for r in text.read_marker_lists(spark, str(tmp_path / "m")).orderBy("qpos").collect()] == [1, None]
    with pytest.raises(Exception, match="without a position"):
        text.read_marker_lists(spark, str(tmp_path / "m"), positions=True).collect()
    (tmp_path / "f").write_text(">n one\nAC\nGT\n>o\nA\n>n\nTT\n")
    (tmp_path / "g").write_text(">o\nCC\n")
    once = lambda *names: {r.name: r.seq for r in text.fasta_dictionary(spark, [str(tmp_path / n) for n in names]).collect()}
    assert once("f", "g") == {"n": "TT", "o": "CC"} and once("g", "f") == {"n": "TT", "o": "A"}


def test_evidence_keeps_paths_without_orientation(spark):
    paths = pairs(spark, [(0, 0, "a."), (0, 1, "b."), (1, 0, "c+")], "tid long, pos int, elem string")
    seqs = pairs(spark, [("a", "AC"), ("b", "G"), ("c", "T")], "name string, seq string")
    none = pairs(spark, [], "u string, v string, hh long, ht long, th long, tt long")
    assert {r.tid: r.seq for r in scaffold.assemble(paths, seqs, 2).collect()} == {1: "T"}
    assert {r.tid: r.seq for r in scaffold.assemble_with_evidence(paths, seqs, none, 2).collect()} == {0: "NNNNN", 1: "T"}


def test_minimizers_take_time_in_proportion(spark):
    """Ten times the length takes about ten times as long, not a hundred times."""
    import time

    took = []
    for n in (3_000, 30_000):
        seq = "".join(random.Random(n).choices("ACGT", k=n))
        frame = pairs(spark, [("s", seq)], "name string, seq string")
        began = time.time()
        rows = frame.select(F.inline(fn.window_minimizers(F.transform(fn.kmers(F.col("seq"), 12), fn.fixed_md5), 10))).collect()
        took.append(time.time() - began)
    assert 3_000 < len(rows) < 12_000 and took[1] < 25 * took[0] + 5


def test_names_lumped_and_numbered(spark):
    rows = pairs(spark, [("a", 1), ("a", 1), ("b", 5), ("c", 1), (None, 9)], "k string, w long")
    assert sorted(str(r.k) for r in reports.lumped(rows, "k", 1).collect()) == ["None", "Other", "Other", "a", "a"]
    assert sorted(str(r.k) for r in reports.lumped(rows, "k", 1, F.col("w")).collect()) == ["None", "Other", "Other", "Other", "b"]
    assert {r.k: r["index"] for r in reports.appearance_index(rows, "k", [-F.col("w"), F.col("k")]).collect()} == {None: 1, "b": 2, "a": 3, "c": 4}


def test_best_edges_by_rounds(spark, monkeypatch):
    frame = pairs(spark, random_graph(3, 18, 0.3), "u long, v long, m long").coalesce(1)
    found = []
    for fold in (1 << 30, 0):
        monkeypatch.setattr(overlap, "FOLD", fold)
        found.append(sorted(map(tuple, overlap.best_edges(frame, 2).collect())))
    assert found[0] == found[1] and found[0]

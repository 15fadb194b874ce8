"""Whole-graph operators as DataFrame loops: spanning forests, breadth-first search, subgraphs, paths and chimera."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.plans.shared import new_path, stored

from .components import connected_components
from .overlap import both_ways, ego_edges, ends, induced


def _contract(left: DataFrame, name: DataFrame) -> DataFrame:
    """Edges (u, v, m, a, b) between the trees a and b, renamed by name(id, tree); edges inside a tree go."""
    left = left.join(name.select(F.col("id").alias("a"), F.col("tree").alias("ta")), "a", "left").join(name.select(F.col("id").alias("b"), F.col("tree").alias("tb")), "b", "left")
    return stored(left.select("u", "v", "m", F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b")).filter("a <> b"), "msf")


def labelled_forest(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(u, v, m, tree): the maximum spanning forest under the total order (m descending, u, v), which makes it unique;
    a tree's name is its smallest vertex.

    Boruvka's rounds: every tree takes its best outgoing edge; trees at least halve, so rounds are logarithmic. Each
    round is one aggregate and some joins over the edges that still cross trees. `known` may hold part of the forest,
    such as what is left of a larger graph's: an edge that is last on no cycle there is so on none here.
    """
    left = edges.select("u", "v", "m", F.col("u").alias("a"), F.col("v").alias("b")).filter("u <> v")
    if known is None:
        forest, left = left.select("u", "v", "m", F.col("a").alias("tree")).limit(0), stored(left, "msf")
    else:
        forest, left = known, _contract(left, known.select(F.explode(F.array("u", "v")).alias("id"), "tree").distinct())
    while True:
        best = F.min(F.struct((-F.col("m")).alias("w"), "u", "v", "a", "b")).alias("best")
        sides = left.select("u", "v", "m", "a", "b", F.explode(F.array("a", "b")).alias("side"))
        chosen = stored(sides.groupBy("side").agg(best).select("best.*").distinct().select("u", "v", (-F.col("w")).alias("m"), "a", "b"), "msf")
        if chosen.isEmpty():
            return forest
        name = stored(connected_components(chosen, "a", "b", gather=True).withColumnRenamed("component", "tree"), "names")
        grown = forest.unionByName(chosen.select("u", "v", "m", F.col("a").alias("tree"))).withColumnRenamed("tree", "id")
        forest = stored(grown.join(name, "id", "left").select("u", "v", "m", F.coalesce("tree", "id").alias("tree")), "forest")
        left = _contract(left, name)


def maximum_spanning_forest(edges: DataFrame) -> DataFrame:
    """The unique maximum spanning forest under the order (m descending, u, v)."""
    return labelled_forest(edges).drop("tree")


def hops(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, id, d): vertices within `depth` hops of each seed of seeds(seed), level by level."""
    near = both_ways(edges).select(F.col("u").alias("id"), F.col("v").alias("next"))
    reached = seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("d"))
    front = reached
    for d in range(1, depth + 1):
        front = front.select("seed", "id").join(near, "id").select("seed", F.col("next").alias("id")).distinct()
        front = stored(front.join(reached.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("d", F.lit(d)), "hops")
        reached = reached.unionByName(front)
    return reached


def subgraph(vertices: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 0, exclude: DataFrame | None = None, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """The graph induced by seeds(id) and everything within `depth` hops, without `exclude(id)`.

    With depth 1, one seed and nothing excluded, the seed itself is left out. Depths outside 0..most are an error.
    """
    if not 0 <= depth <= most:
        raise ValueError(f"the distance must be from 0 to {most}")
    known = vertices.join(seeds.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("seed"))
    ids = hops(edges, known, depth).select("id").distinct()
    if depth == 1 and exclude is None and known.count() == 1:
        ids = ids.join(known.withColumnRenamed("seed", "id"), "id", "left_anti")
    if exclude is not None:
        ids = ids.join(exclude.select("id"), "id", "left_anti")
    return vertices.join(ids, "id", "left_semi"), induced(edges, ids)


def subgraphs(edges: DataFrame, seeds: DataFrame | None, depth: int = 1, exclude_source: bool = False) -> DataFrame:
    """(seed, u, v, m): the induced graph around every seed of seeds(seed), all at once; None takes all vertices of edges u < v.

    Around all vertices, one hop far, the inner edges are those of the triangles, each found once; a row for every edge and
    seed next to one of its ends would be met there from all three corners.
    """
    if seeds is None and depth == 1:
        inner = ego_edges(edges).select(F.col("ego").alias("seed"), F.col("v").alias("u"), F.col("w").alias("v"), "m")
        own = edges.select(F.explode(F.array("u", "v")).alias("seed"), "u", "v", "m")
        return inner if exclude_source else inner.unionByName(own)
    ids = hops(edges, ends(edges).withColumnRenamed("id", "seed") if seeds is None else seeds, depth)
    if exclude_source:
        ids = ids.filter("seed <> id")
    a = ids.select("seed", F.col("id").alias("u"))
    return edges.join(a, "u").join(ids.select("seed", F.col("id").alias("v")), ["seed", "v"]).select("seed", "u", "v", "m")


def seed_vertices(names: DataFrame, vertices: DataFrame) -> DataFrame:
    """(name, id) for each wanted name(name): the vertex of that name, else name_0, name_1, ... while consecutive."""
    exact = names.join(vertices.select("id"), F.col("name") == F.col("id")).select("name", "id")
    base, i = F.regexp_extract("id", r"^(\S+)_(\d+)$", 1), F.try_to_number(F.regexp_extract("id", r"_(\d+)$", 1), F.lit("999999999")).cast("long")
    split = vertices.select("id", base.alias("name"), i.alias("i")).join(names, "name", "left_semi").join(exact.select("name"), "name", "left_anti")
    from pyspark.sql import window as W

    place = F.row_number().over(W.Window.partitionBy("name").orderBy("i")) - 1
    return exact.unionByName(split.withColumn("place", place).filter("i = place").select("name", "id"))


def contiguous_paths(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, component) of the pieces left without vertices of degree 3 or more, and those vertices (id)."""
    degree = both_ways(edges).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree"))
    junctions = degree.filter("degree >= 3").select("id")
    rest = degree.filter("degree < 3").select("id")
    kept = induced(edges, rest)
    named = rest.join(connected_components(kept, gather=True), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    return named, junctions


def bridges(forest: DataFrame, length: int) -> DataFrame:
    """(id): vertices of pieces shorter than `length` whose vertices all have degree 2 in the forest, and both ends of
    every edge that joins two junctions."""
    named, junctions = contiguous_paths(forest)
    degree = both_ways(forest).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree"))
    pieces = named.join(degree, "id").groupBy("component").agg(F.count("*").alias("n"), F.min("degree").alias("low"), F.max("degree").alias("high"))
    short = pieces.filter((F.col("n") < length) & (F.col("low") == 2) & (F.col("high") == 2))
    inside = named.join(short, "component", "left_semi").select("id")
    return inside.unionByName(ends(induced(forest, junctions))).distinct()


def without(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with neither end among ids(id)."""
    some = ids.select("id")
    return edges.join(some.withColumnRenamed("id", "u"), "u", "left_anti").join(some.withColumnRenamed("id", "v"), "v", "left_anti").select("u", "v", "m")


def path_edges(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges of the graph whose ends lie on one path of paths(tid, pos, elem)."""
    a = paths.select("tid", F.col("elem").alias("u"))
    b = paths.select("tid", F.col("elem").alias("v"))
    return edges.join(a, "u").join(b, ["tid", "v"]).select("u", "v", "m").distinct()


def shortest_paths(edges: DataFrame, tips: DataFrame, most: int | None = None) -> DataFrame:
    """(tid, pos, id): a shortest path by hops from a to b for every row of tips(tid, a, b), all searched at once, level by
    level; of several, each vertex is reached from its smallest predecessor. No rows where there is none, or none of up to
    `most` hops if that is given.

    A search ends with its target or when nothing new is reached. Costs what the searches reach: (tid, vertex) once each.
    """
    near = both_ways(edges).select(F.col("u").alias("from"), F.col("v").alias("id"))
    tips = stored(tips.select("tid", "a", "b"), "tips")
    kind = edges.schema["u"].dataType
    path, fields = new_path(edges.sparkSession, "bfs"), ["tid", "id", "parent"]

    def level(d: int, rows: DataFrame) -> DataFrame:
        """Writes the level's rows beside the others': all levels are one table, whatever their number."""
        rows.select(*fields).write.parquet(f"{path}/d={d}")
        return edges.sparkSession.read.parquet(f"{path}/d={d}")

    goal = tips.select("tid", F.col("b").alias("id"))
    now, before, d = level(0, tips.select("tid", F.col("a").alias("id"), F.lit(None).cast(kind).alias("parent"))), None, 0
    front = now.join(tips.filter("a <> b").select("tid"), "tid", "left_semi")
    while most is None or d < most:
        step = front.select("tid", F.col("id").alias("from")).join(near, "from").groupBy("tid", "id").agg(F.min("from").alias("parent"))
        # In an undirected graph a level's neighbours lie in it, in the one before or in the next.
        known = now.select("tid", "id") if before is None else now.select("tid", "id").unionByName(before.select("tid", "id"))
        d += 1
        before, now = now, level(d, step.join(known, ["tid", "id"], "left_anti"))
        if now.isEmpty():
            break
        front = now.join(goal, ["tid", "id"], "left_anti").join(now.join(goal, ["tid", "id"], "left_semi").select("tid"), "tid", "left_anti")
    reached = edges.sparkSession.read.parquet(path).withColumn("d", F.col("d").cast("int"))
    found = new_path(edges.sparkSession, "paths")
    wanted = reached.join(goal, ["tid", "id"], "left_semi")
    for back in range(d, -1, -1):  # along the parents, a level at a time
        here = wanted.filter(F.col("d") == back)
        if back < d:
            asked = edges.sparkSession.read.parquet(f"{found}/d={back + 1}").select("tid", F.col("parent").alias("id"))
            here = here.unionByName(reached.filter(F.col("d") == back).join(asked, ["tid", "id"], "left_semi")).distinct()
        here.select(*fields).write.parquet(f"{found}/d={back}")
    return edges.sparkSession.read.parquet(found).select("tid", F.col("d").cast("int").alias("pos"), "id")


def shortest_path(edges: DataFrame, source, target) -> DataFrame:
    """(pos, id) of a shortest path by hops between two vertices, as in shortest_paths; empty if there is none."""
    kind = edges.schema["u"].dataType.simpleString()
    return shortest_paths(edges, edges.sparkSession.createDataFrame([(0, source, target)], f"tid long, a {kind}, b {kind}")).select("pos", "id")


def tiling_graph(edges: DataFrame, paths: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """Edges induced by the union of the shortest paths, by hops, between the two ends of every path of paths(tid, pos, elem);
    of those of up to `most` hops, if that is given."""
    kept = stored(edges.filter(F.col("m") >= least), "heavy") if least else edges
    tips = paths.groupBy("tid").agg(F.min_by("elem", "pos").alias("a"), F.max_by("elem", "pos").alias("b"))
    there = ends(kept)
    tips = tips.join(there.withColumnRenamed("id", "a"), "a", "left_semi").join(there.withColumnRenamed("id", "b"), "b", "left_semi")
    return induced(kept, shortest_paths(kept, tips, most).select("id").distinct())


def chimera_diagnostics(edges: DataFrame, paths: DataFrame, distance: int = 2, least_path: int = 200, spanners_too: bool = False):
    """(tid, pos, elem, us, ws, overlap, depth, support) for every inner position of paths(tid, pos, elem).

    Within `distance` before (us) and after (ws): overlap counts ends of edges between them; spanners are common
    neighbours of both sides; support adds the lesser number of ends of edges between the other neighbours.
    """
    sizes = paths.groupBy("tid").agg(F.count("*").alias("n")).filter(F.col("n") >= least_path).select("tid")
    p = paths.join(sizes, "tid", "left_semi")
    here = p.select("tid", F.col("pos").alias("at"), F.col("elem").alias("v"))
    steps = F.explode(F.array(*(F.lit(d) for d in range(-distance, distance + 1) if d))).alias("step")
    side = p.select("tid", "elem", "pos", steps).select("tid", (F.col("pos") - F.col("step")).alias("at"), F.col("elem").alias("x"), (F.col("step") > 0).alias("after"))
    window = here.join(side, ["tid", "at"]).select("tid", "at", "v", "x", "after")
    counts = window.groupBy("tid", "at", "v").agg(F.count_if(~F.col("after")).alias("us"), F.count_if("after").alias("ws")).filter("us > 0 AND ws > 0")
    near = both_ways(edges).select(F.col("u").alias("x"), F.col("v").alias("y"))
    key = ["tid", "at"]
    linked = window.join(near, "x")  # neighbours y of every x of the window
    inner = window.select(*key, F.col("x").alias("y"), F.col("after").alias("y_after"))
    crossing = linked.join(inner, [*key, "y"]).filter("after <> y_after")
    overlap = crossing.groupBy(*key).agg(F.count_distinct("x").alias("overlap"))
    outside = linked.filter("y <> v").join(inner.select(*key, "y"), [*key, "y"], "left_anti").groupBy(*key, "y").agg(F.max("after").alias("w"), F.min("after").alias("u"))
    spanners = outside.filter("w AND NOT u")
    only = outside.filter("w = u").select(*key, "y", F.col("w").alias("after"))
    mates = only.select(*key, F.col("y").alias("x"), "after").join(near, "x").join(only.select(*key, "y", F.col("after").alias("y_after")), [*key, "y"]).filter("after <> y_after")
    boundary = mates.groupBy(*key).agg(F.count_distinct(F.when(F.col("after"), F.col("x"))).alias("wb"), F.count_distinct(F.when(~F.col("after"), F.col("x"))).alias("ub"))
    found = counts.join(overlap, key, "left").join(spanners.groupBy(*key).agg(F.count("*").alias("spanners")), key, "left").join(boundary, key, "left").fillna(0, ["overlap", "spanners", "wb", "ub"])
    depth = F.col("overlap") + F.col("spanners")
    rows = found.select("tid", F.col("at").alias("pos"), F.col("v").alias("elem"), "us", "ws", "overlap", depth.alias("depth"), (depth + F.least("wb", "ub")).alias("support"))
    return (rows, spanners.select("tid", F.col("at").alias("pos"), F.col("y").alias("id"))) if spanners_too else rows


def chimera(edges: DataFrame, paths: DataFrame, distance: int = 2, least_support: int = 3, least_path: int = 200) -> DataFrame:
    """(id): path vertices that nothing overlaps and too little supports, and the vertices that span them."""
    rows, spanners = chimera_diagnostics(edges, paths, distance, least_path, spanners_too=True)
    weak = rows.filter((F.col("overlap") == 0) & (F.col("support") < least_support))
    return weak.select(F.col("elem").alias("id")).unionByName(spanners.join(weak.select("tid", "pos"), ["tid", "pos"], "left_semi").select("id")).distinct()


def cut_chimera(paths: DataFrame, edges: DataFrame, distance: int = 2, least_support: int = 3, least_path: int = 200) -> DataFrame:
    """(tid, piece, pos, elem): paths cut at chimeric positions, which go; pieces count from 0 along each path."""
    from pyspark.sql import window as W

    weak = chimera(edges, paths, distance, least_support, least_path).select(F.col("id").alias("elem"), F.lit(True).alias("bad"))
    marked = paths.join(weak, "elem", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    along = W.Window.partitionBy("tid").orderBy("pos")
    starts = ~F.col("bad") & F.coalesce(F.lag("bad").over(along), F.lit(True))
    return marked.withColumn("piece", F.sum(starts.cast("int")).over(along) - 1).filter(~F.col("bad")).select("tid", F.col("piece").cast("int").alias("piece"), "pos", "elem")


def flesh_paths(edges: DataFrame, paths: DataFrame, least_path: int = 1) -> DataFrame:
    """(tid, after, id): where each neighbour off a path goes: behind the position of its heaviest neighbour on it, or one
    earlier when the left neighbour of that position is heavier than the right; at the ends 0 and last - 1."""
    from pyspark.sql import window as W

    sizes = paths.groupBy("tid").agg(F.count("*").alias("n")).filter(F.col("n") >= least_path)
    p = paths.join(sizes, "tid")
    near = both_ways(edges)
    seen = p.select("tid", "pos", "n", F.col("elem").alias("v")).join(near, "v").select("tid", "pos", "n", F.col("u").alias("id"), "m")
    seen = seen.join(p.select("tid", F.col("elem").alias("id")), ["tid", "id"], "left_anti")
    w = W.Window.partitionBy("tid", "id")
    side = w.orderBy("pos").rangeBetween
    seen = seen.withColumn("left", F.coalesce(F.max("m").over(side(-1, -1)), F.lit(0))).withColumn("right", F.coalesce(F.max("m").over(side(1, 1)), F.lit(0)))
    best = seen.withColumn("r", F.row_number().over(w.orderBy(F.desc("m"), "pos"))).filter("r = 1")
    after = F.when(F.col("pos") == 0, 0).when(F.col("pos") == F.col("n") - 1, F.col("pos") - 1).when(F.col("left") > F.col("right"), F.col("pos") - 1).otherwise(F.col("pos"))
    return best.select("tid", after.cast("int").alias("after"), "id")

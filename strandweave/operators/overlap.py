"""The weighted overlap graph of barcodes: edges(u, v, m) with u < v, vertices(id, m)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from strandweave.functions.scalar import valid_pair
from strandweave.plans.shared import MANY, spread, stored

from .components import connected_components
from .incidence import barcode_size, histogram, marker_depth

#: Edges of a component that one task folds.
FOLD = 100_000
#: Barcodes of a marker in one row.
DEPTH = 256
#: Pairs of a barcode that a task holds.
HELD = 1_000_000


def pairs_by_smaller(bxmx: DataFrame, share: int = 1) -> DataFrame:
    """(u, mx, vs): for each barcode u and marker of bxmx, the greater barcodes that hold the marker too, in order, in lists of
    up to DEPTH. All rows of u are in one partition, so counting what `vs` hold by (u, v) shuffles nothing; `share`
    is by how much a partition's rows are to be fewer.

    A list costs a fraction of the pairs in it, and pairs are never rows of a shuffle. A marker's barcodes are dealt into
    blocks in order, so none is gathered whole. The lists still grow with the square of a marker's depth: filter
    repetitive markers first (filter_incidence), whose whisker bounds it.
    """
    at = F.row_number().over(W.Window.partitionBy("mx").orderBy("bx")) - 1
    n = bxmx.count()
    rows = spread(bxmx.dropna(subset=["bx", "mx"]), "mx", n).select("mx", F.col("bx").alias("u"), at.alias("at")).withColumn("block", F.floor(F.col("at") / DEPTH))
    blocks = rows.groupBy("mx", "block").agg(F.array_sort(F.collect_list("u")).alias("vs"))
    lists = rows.join(blocks.withColumnRenamed("block", "other"), "mx").filter(F.col("other") >= F.col("block"))
    after = F.slice("vs", (F.col("at") % DEPTH + 2).cast("int"), DEPTH)
    lists = lists.select("u", "mx", F.when(F.col("other") == F.col("block"), after).otherwise(F.col("vs")).alias("vs"))
    lists = lists.filter(F.size("vs") > 0)
    return lists.repartition(-(-n * share // MANY), "u") if n * share > MANY else lists.repartition("u")


class _Later(NamedTuple):
    """A barcode, as an array of one, and how often each of the greater barcodes v stood in its lists."""

    u: pa.Array
    v: pa.Array
    m: np.ndarray

    def with_more(self, v: pa.Array, m: np.ndarray) -> _Later:
        both = pa.concat_arrays([self.v, v]).dictionary_encode()
        total = np.zeros(len(both.dictionary), np.int64)
        np.add.at(total, both.indices.to_numpy(), np.concatenate([self.m, m]))
        return _Later(self.u, both.dictionary, total)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(u, v, m): how often each v stands in the lists vs of each u, from batches in the order of u. Of the last u of a batch
    only the counts are kept until its next rows come."""
    held: _Later | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        us, vs = batch.column("u").dictionary_encode(), batch.column("vs").flatten().dictionary_encode()
        width, owner = len(vs.dictionary), np.repeat(us.indices.to_numpy(), pc.list_value_length(batch.column("vs")).to_numpy())
        pairs = owner.astype(np.int64) * width + vs.indices.to_numpy()
        if len(us.dictionary) * width <= 8 * len(pairs):
            m = np.bincount(pairs)
            pairs = np.flatnonzero(m)
            m = m[pairs]
        else:
            pairs, m = np.unique(pairs, return_counts=True)
        owner, v = pairs // width, vs.dictionary.take(pa.array(pairs % width))
        first, last = int(np.searchsorted(owner, 1)), int(np.searchsorted(owner, len(us.dictionary) - 1))
        if held is not None and held.u[0] == us.dictionary[0]:
            held = held.with_more(v[:first], m[:first])
            if len(us.dictionary) == 1:
                continue
            low = first
        else:
            low = 0
        if held is not None:
            yield pa.repeat(held.u[0], len(held.m)), held.v, held.m
        yield us.dictionary.take(pa.array(owner[low:last])), v[low:last], m[low:last]
        held = _Later(us.dictionary[-1:], v[last:], m[last:])
    if held is not None:
        yield pa.repeat(held.u[0], len(held.m)), held.v, held.m


def overlap_edges(bxmx: DataFrame, least: int = 10) -> DataFrame:
    """Pairs of barcodes with at least `least` common markers. Rows without a barcode or marker count for nothing.

    A task reads its barcodes' lists in order and counts a batch of them at once, so pairs are never rows of Spark's."""
    kind = bxmx.schema["bx"].dataType

    def count(batches):
        for u, v, m in _counted(batches):
            often = np.flatnonzero(m >= least)
            rows = pa.RecordBatch.from_arrays([u.take(pa.array(often)), v.take(pa.array(often)), pa.array(m[often])], names=["u", "v", "m"])
            yield rows.filter(pc.not_equal(rows["u"], rows["v"]))  # a repeated row pairs a barcode with itself

    schema = T.StructType([T.StructField("u", kind), T.StructField("v", kind), T.StructField("m", T.LongType())])
    return pairs_by_smaller(bxmx).select("u", "vs").sortWithinPartitions("u").mapInArrow(count, schema)


def overlap_graph(bxmx: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges); every barcode is a vertex, linked or not."""
    return barcode_size(bxmx).withColumnRenamed("bx", "id"), overlap_edges(bxmx, least)


def _shared(rows: list[pa.RecordBatch], least: int) -> pa.RecordBatch:
    """(u, v, mxs) of pairs with at least `least` markers, from all rows(u, mx, vs) of some barcodes, which come by u and mx."""
    u, mx, vs = (pa.concat_arrays([b.column(c) for b in rows]) for c in ("u", "mx", "vs"))
    us, later = u.dictionary_encode(), vs.flatten().dictionary_encode()
    width, row = len(later.dictionary), np.repeat(np.arange(len(u)), pc.list_value_length(vs).to_numpy())
    pairs = np.sort((us.indices.to_numpy()[row].astype(np.int64) * width + later.indices.to_numpy()) * len(u) + row)
    pairs, row = pairs // len(u), pairs % len(u)
    starts = np.flatnonzero(np.diff(pairs, prepend=-1))
    n, pairs = np.diff(starts, append=len(pairs)), pairs[starts]
    u, v = us.dictionary.take(pa.array(pairs // width)), later.dictionary.take(pa.array(pairs % width))
    keep = (n >= least) & pc.not_equal(u, v).to_numpy(zero_copy_only=False)  # a repeated row pairs a barcode with itself
    mxs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[keep])]), pa.int32()), mx.take(pa.array(row[np.repeat(keep, n)])))
    return pa.RecordBatch.from_arrays([u.filter(pa.array(keep)), v.filter(pa.array(keep)), mxs], names=["u", "v", "mxs"])


def shared_markers(bxmx: DataFrame, least: int = 1, barcodes: DataFrame | None = None) -> DataFrame:
    """(u, v, mxs): the sorted common markers of each pair with at least max(least, 1); `barcodes(bx)` restricts both ends.

    A task reads its barcodes' lists in order, sorts a batch of them in arrays and keeps the lists of the last barcode until
    its next rows come. Barcodes of more than HELD pairs go by rows of Spark's, which needs no barcode in one task."""
    rows = bxmx if barcodes is None else bxmx.join(barcodes.select("bx"), "bx", "left_semi")
    lists, least = pairs_by_smaller(rows, 8), max(1, least)
    deepest = marker_depth(rows).agg(F.max("depth")).first()[0] or 1
    large = stored(barcode_size(rows).filter(F.col("m") * (deepest - 1) > HELD).select("bx"), "large")  # no other can be heavy

    def gather(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            us = batch.column("u").dictionary_encode()
            last = int(np.searchsorted(us.indices.to_numpy(), len(us.dictionary) - 1))
            if held and (last or held[0].column("u")[0] != us.dictionary[0]):
                yield _shared([*held, batch.slice(0, last)], least)
                held = []
            elif last:
                yield _shared([batch.slice(0, last)], least)
            held.append(batch.slice(last))
        if held:
            yield _shared(held, least)

    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField("u", kinds["bx"]), T.StructField("v", kinds["bx"]), T.StructField("mxs", T.ArrayType(kinds["mx"]))])
    folded = lambda some: some.select("u", "mx", "vs").sortWithinPartitions("u", "mx").mapInArrow(gather, schema)
    if large.isEmpty():
        return folded(lists)
    depth = rows.join(large, "bx", "left_semi").join(marker_depth(rows), "mx")
    heavy = stored(depth.groupBy(F.col("bx").alias("u")).agg(F.sum(F.col("depth") - 1).alias("n")).filter(F.col("n") > HELD).select("u"), "heavy")
    pairs = lists.join(F.broadcast(heavy), "u", "left_semi").select("u", "mx", F.explode("vs").alias("v")).filter("u < v").groupBy("u", "v").agg(F.array_sort(F.collect_list("mx")).alias("mxs"))
    return folded(lists.join(F.broadcast(heavy), "u", "left_anti")).unionByName(pairs.filter(F.size("mxs") >= least))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge seen from both ends: (u, v, m)."""
    return edges.select("u", "v", "m").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "m"))


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, m, degree) of every vertex; 0 where it has no edge."""
    counts = edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return vertices.join(counts, "id", "left").select("id", "m", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def without_isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.join(ends(edges), "id", "left_semi")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids(id)."""
    some = ids.select("id")
    return edges.join(some.withColumnRenamed("id", "u"), "u", "left_semi").join(some.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v", "m")


def filter_edges(vertices: DataFrame, edges: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Edges of at least `least`, and the vertices they touch; 0 changes nothing."""
    if not least:
        return vertices, edges
    kept = edges.filter(F.col("m") >= least)
    return without_isolated(vertices, kept), kept


def percentile_threshold(edges: DataFrame, percent: float) -> int | None:
    """The weight at 0-based rank floor(n * percent / 100) in ascending order; None without edges."""
    if not 0 <= percent < 100:
        raise ValueError("the percentage must be at least 0 and below 100")
    hist = histogram(edges, "m").withColumn("rank", F.floor(F.sum("n").over(W.Window.partitionBy()) * percent / 100))
    return hist.agg(F.min(F.when(F.col("upto") > F.col("rank"), F.col("value")))).first()[0]


def filter_percentile(edges: DataFrame, percent: float) -> DataFrame:
    """Edges at or over the percentile of all weights; 0 keeps all. Vertices are not touched."""
    if not percent:
        return edges
    least = percentile_threshold(edges, percent)
    return edges if least is None else edges.filter(F.col("m") >= least)


def drop_small_components(vertices: DataFrame, edges: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Without components of fewer than `least` vertices; below 2 changes nothing."""
    if least < 2:
        return vertices, edges
    named = component_of(vertices, edges)
    big = named.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    kept = named.join(big, "component", "left_semi").select("id")
    return vertices.join(kept, "id", "left_semi"), induced(edges, kept)


def component_of(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex; an isolated vertex is its own component."""
    return vertices.select("id").join(connected_components(edges, gather=True), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def filter_graph(vertices: DataFrame, edges: DataFrame, least: int = 0, below_molecules: int | None = None, least_component: int = 0) -> tuple[DataFrame, DataFrame]:
    """Edge weights, then vertices with fewer than `below_molecules` in column mol, then component sizes."""
    vertices, edges = filter_edges(vertices, edges, least)
    if below_molecules is not None:
        vertices = vertices.filter(F.col("mol") < below_molecules)
        edges = induced(edges, vertices)
    return drop_small_components(vertices, edges, least_component)


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c, ab, ac, bc): every three vertices with an edge between each two, once, and those edges' weights.

    An edge leads from the end of fewer edges (ties: the smaller) to the other; two edges that leave a vertex make a
    triangle where an edge joins their heads. A vertex leaves at most the square root of twice the edges, so a hub's
    neighbours are not paired with each other.
    """
    count = edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    rows = edges.join(count.select(F.col("id").alias("u"), F.col("n").alias("nu")), "u").join(count.select(F.col("id").alias("v"), F.col("n").alias("nv")), "v")
    ahead = (F.col("nu") < F.col("nv")) | ((F.col("nu") == F.col("nv")) & (F.col("u") < F.col("v")))
    end = lambda x, y: F.when(ahead, F.col(x)).otherwise(F.col(y))
    out = stored(rows.select(end("u", "v").alias("a"), end("v", "u").alias("b"), "m"), "out")
    wedge = out.select("a", "b", F.col("m").alias("ab")).join(out.select("a", F.col("b").alias("c"), F.col("m").alias("ac")), "a").filter("b < c")
    return wedge.join(edges.select(F.least("u", "v").alias("b"), F.greatest("u", "v").alias("c"), F.col("m").alias("bc")), ["b", "c"]).select("a", "b", "c", "ab", "ac", "bc")


def common_neighbours(edges: DataFrame) -> DataFrame:
    """(u, v, m) with m the number of common neighbours of the ends, 0 included."""
    side = lambda x, y: F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v"))
    counts = triangles(edges).select(F.explode(F.array(side("a", "b"), side("a", "c"), side("b", "c"))).alias("e")).groupBy("e.u", "e.v").agg(F.count("*").alias("m"))
    return edges.select("u", "v").join(counts, ["u", "v"], "left").select("u", "v", F.coalesce("m", F.lit(0)).cast("long").alias("m"))


def supported_edges(edges: DataFrame) -> DataFrame:
    """Edges whose ends have a common neighbour."""
    return edges.join(common_neighbours(edges).filter("m > 0").select("u", "v"), ["u", "v"], "left_semi").select("u", "v", "m")


def ego_edges(edges: DataFrame) -> DataFrame:
    """(ego, v, w, m), v < w: the edges among each vertex's neighbours, three rows a triangle."""
    seen = lambda ego, x, y, m: F.struct(F.col(ego).alias("ego"), F.least(x, y).alias("v"), F.greatest(x, y).alias("w"), F.col(m).alias("m"))
    corners = F.array(seen("a", "b", "c", "bc"), seen("b", "a", "c", "ac"), seen("c", "a", "b", "ab"))
    return triangles(edges).select(F.explode(corners).alias("e")).select("e.ego", "e.v", "e.w", "e.m")


def ego_statistics(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, nodes, edges, density) of every vertex's neighbour graph; density 2E / N(N-1), 0 for fewer than two nodes."""
    inner = ego_edges(edges).groupBy(F.col("ego").alias("id")).agg(F.count("*").alias("edges"))
    counts = degrees(vertices, edges).select("id", F.col("degree").alias("nodes")).join(inner, "id", "left")
    n, e = F.col("nodes"), F.coalesce("edges", F.lit(0)).cast("long")
    return counts.select("id", "nodes", e.alias("edges"), F.when(n < 2, 0.0).otherwise(2.0 * e / (n * (n - 1))).alias("density"))


def mutual_best_edges(edges: DataFrame, best: int) -> DataFrame:
    """Edges among the `best` heaviest of both ends (ties: smaller neighbour). Set-based; see best_edges for the sequential rule."""
    rank = F.row_number().over(W.Window.partitionBy("u").orderBy(F.desc("m"), "v"))
    top = both_ways(edges).withColumn("r", rank).filter(F.col("r") <= best)
    pairs = top.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "m").groupBy("u", "v", "m").count()
    return pairs.filter("count = 2").select("u", "v", "m")


def best_edges(edges: DataFrame, best: int) -> DataFrame:
    """Vertices by falling degree (ties: smaller id) keep the `best` heaviest of the edges still left (ties: smaller neighbour).

    A component of up to FOLD edges is folded in one task. In larger ones each round settles the vertices whose neighbours
    that come earlier are settled; no two of these are neighbours.
    """
    if best is None:
        return edges
    named = stored(edges.join(connected_components(edges, gather=True), edges["u"] == F.col("id")).select("u", "v", "m", "component"), "named")
    large = stored(named.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > FOLD).select("component"), "large")

    def fold(group):
        left: dict = {}
        for u, v, m in group[["u", "v", "m"]].itertuples(index=False):
            left.setdefault(u, {})[v] = m
            left.setdefault(v, {})[u] = m
        for u in sorted(left, key=lambda x: (-len(left[x]), x)):
            for v in sorted(left[u], key=lambda x: (-left[u][x], x))[best:]:
                del left[u][v], left[v][u]
        keep = [u in left and v in left[u] for u, v in zip(group["u"], group["v"])]
        return group.loc[keep, ["u", "v", "m"]]

    schema = edges.select("u", "v", "m").schema
    if large.isEmpty():
        return named.groupBy("component").applyInPandas(fold, schema)
    small = named.join(large, "component", "left_anti").groupBy("component").applyInPandas(fold, schema)
    return small.unionByName(_best_edges_by_rounds(named.join(large, "component", "left_semi").select("u", "v", "m"), best))


def _best_edges_by_rounds(edges: DataFrame, best: int) -> DataFrame:
    degree = edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    rows = edges.join(degree.select(F.col("id").alias("u"), F.col("n").alias("nu")), "u").join(degree.select(F.col("id").alias("v"), F.col("n").alias("nv")), "v")
    first = (F.col("nu") > F.col("nv")) | ((F.col("nu") == F.col("nv")) & (F.col("u") < F.col("v")))
    end = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    rows = stored(rows.select(end("u", "v").alias("a"), end("v", "u").alias("b"), "m", F.lit(False).alias("sa"), F.lit(False).alias("sb")), "rounds")
    while not rows.filter("NOT sa OR NOT sb").isEmpty():
        ends_ = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("sa").alias("done"), F.lit(False).alias("waits")), F.struct(F.col("b").alias("id"), F.col("sb").alias("done"), (~F.col("sa")).alias("waits")))).alias("e")
        ready = stored(rows.select(ends_).select("e.*").groupBy("id").agg(F.max("done").alias("done"), F.max("waits").alias("waits")).filter("NOT done AND NOT waits").select("id"), "ready")
        flagged = rows.join(ready.select(F.col("id").alias("a"), F.lit(True).alias("ra")), "a", "left").join(ready.select(F.col("id").alias("b"), F.lit(True).alias("rb")), "b", "left").withColumns({"ra": F.coalesce("ra", F.lit(False)), "rb": F.coalesce("rb", F.lit(False))})
        # Of the two ends of an edge one at most is ready.
        who, other = F.when(F.col("ra"), F.col("a")).otherwise(F.col("b")), F.when(F.col("ra"), F.col("b")).otherwise(F.col("a"))
        asked = flagged.filter("ra OR rb").withColumns({"who": who, "other": other})
        kept = asked.withColumn("r", F.row_number().over(W.Window.partitionBy("who").orderBy(F.desc("m"), "other"))).filter(F.col("r") <= best)
        both = flagged.filter("NOT ra AND NOT rb").unionByName(kept.select(*flagged.columns))
        rows = stored(both.select("a", "b", "m", (F.col("sa") | F.col("ra")).alias("sa"), (F.col("sb") | F.col("rb")).alias("sb")), "rounds")
    return rows.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "m")


def relabel_molecules(edges: DataFrame, molecules: DataFrame) -> DataFrame:
    """edges rewired to molecules(u, nbr, mid): u_mid(u's molecule of v) - v_mid(v's molecule of u); unassigned ends drop the edge."""
    first = molecules.select("u", F.col("nbr").alias("v"), F.col("mid").alias("i"))
    second = molecules.select(F.col("u").alias("v"), F.col("nbr").alias("u"), F.col("mid").alias("j"))
    rows = edges.join(first, ["u", "v"]).join(second, ["u", "v"])
    a, b = F.concat_ws("_", F.col("u").cast("string"), F.col("i").cast("string")), F.concat_ws("_", F.col("v").cast("string"), F.col("j").cast("string"))
    return rows.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), "m")


def split_markers(edges: DataFrame, bxmx: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, mxs) of every molecule bx_i: the markers of its barcode that a neighbour's barcode holds too, sorted; maybe none."""
    bare = lambda c: F.regexp_replace(c, r"_\d+$", "")
    mine = vertices.select("id").join(bxmx.withColumnRenamed("bx", "own"), bare(F.col("id")) == F.col("own")).select("id", "mx")
    near = both_ways(edges).select(F.col("u").alias("id"), bare(F.col("v")).alias("bx"))
    theirs = near.join(bxmx, "bx").select("id", "mx")
    kept = mine.join(theirs, ["id", "mx"], "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("mx")).alias("mxs"))
    return vertices.select("id").join(kept, "id", "left").select("id", F.coalesce("mxs", F.array().cast("array<bigint>")).alias("mxs"))


def split_reads(pairs: DataFrame, markers: DataFrame, molecules: DataFrame, only_split: bool = True) -> DataFrame:
    """Read pairs(pair, name1, name2, bx1, bx2, ...) with `bx`, the molecule they come from.

    Of the molecules(id, mx) of a valid pair's barcode, named barcode_i, it is the one that shares the most markers
    with markers(pair, bx, mx) (ties: smaller i); with none shared the bare barcode. Valid pairs whose barcode has no
    molecules keep it and invalid pairs have null; both are only kept without `only_split`. Markers whose barcode is not
    the pair's are an error.
    """
    base, i = F.regexp_extract("id", r"^(.*)_\d+$", 1), F.regexp_extract("id", r"_(\d+)$", 1).cast("int")
    owned = molecules.select(base.alias("bx1"), i.alias("i"), "mx").distinct()
    rows = pairs.withColumn("bx1", F.col("bx1").cast("string")).withColumn("bx2", F.col("bx2").cast("string"))
    rows = rows.withColumn("_valid", valid_pair(F.col("bx1"), F.col("bx2"), F.col("name1"), F.col("name2")))
    rows = rows.join(owned.select("bx1", F.lit(True).alias("_split")).distinct(), "bx1", "left").withColumn("_split", F.col("_valid") & F.coalesce("_split", F.lit(False)))
    checked = F.when(F.col("bx1") == F.col("bx").cast("string"), F.col("mx")).otherwise(F.raise_error(F.lit("the markers are not those of the pair's barcode")))
    held = rows.filter("_split").select("pair", "bx1").join(markers, "pair").select("pair", "bx1", checked.alias("mx")).distinct()
    counts = held.join(owned, ["bx1", "mx"]).groupBy("pair", "i").agg(F.count("*").alias("n"))
    best = counts.groupBy("pair").agg(F.max_by("i", F.struct("n", -F.col("i"))).alias("_i"))
    rows = rows.join(best, "pair", "left").withColumn("bx", F.when(F.col("_split"), F.concat("bx1", F.coalesce(F.concat(F.lit("_"), F.col("_i").cast("string")), F.lit("")))).when(F.col("_valid"), F.col("bx1")))
    return (rows.filter("_split") if only_split else rows).select(*pairs.columns, "bx")


def edges_beyond(edges: DataFrame, best: int) -> DataFrame:
    """(u, v, m): of every vertex u, its edges behind the `best` heaviest (ties: smaller neighbour); none where there are no more."""
    rank = F.row_number().over(W.Window.partitionBy("u").orderBy(F.desc("m"), "v"))
    return both_ways(edges).withColumn("_r", rank).filter(F.col("_r") > best).select("u", "v", "m")


def largest_component(named: DataFrame) -> DataFrame:
    """(id) of the component of (id, component) with the most vertices (ties: the smaller name)."""
    sizes = named.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return named.join(F.broadcast(sizes.select("component")), "component", "left_semi").select("id")

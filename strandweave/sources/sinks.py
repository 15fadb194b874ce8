"""Writers of the text formats: a row is a line of text, written by Spark; `*_lines` give the lines as (value)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.plans.shared import discard, spread, stored


def write_lines(lines: DataFrame, path: str, **options: str) -> None:
    lines.select("value").write.options(**options).text(path)


def graph_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value) of a graph file: the vertex head, vertices, an empty line, the edge head, edges. Sort by part and value."""
    spark = vertices.sparkSession
    cols = [c for c in ("id", "m", "mol") if c in vertices.columns]
    heads = spark.createDataFrame([(0, "U\t" + "\t".join(cols[1:])), (2, ""), (3, "U\tV\tm")], "part int, value string")
    text = lambda names: F.concat_ws("\t", *(F.col(c).cast("string") for c in names))
    rows = heads.unionByName(vertices.select(F.lit(1).alias("part"), text(cols).alias("value")))
    ordered = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "m")
    return rows.unionByName(ordered.select(F.lit(4).alias("part"), text(["u", "v", "m"]).alias("value")))


def write_graph(vertices: DataFrame, edges: DataFrame, path: str, form: str = "tsv") -> None:
    """Writes a graph as tsv or gv text, in globally sorted parts."""
    if form not in ("tsv", "gv"):
        raise ValueError("the form must be tsv or gv")
    lines = graph_lines(vertices, edges) if form == "tsv" else graphviz_lines(vertices, edges)
    write_lines(lines.orderBy("part", "value"), path)


def graphviz_lines(vertices: DataFrame, edges: DataFrame, hue: Column | None = None) -> DataFrame:
    spark = vertices.sparkSession
    heads = spark.createDataFrame([(0, "strict graph {"), (9, "}")], "part int, value string")
    more = F.format_string(' color="%.3f 1.0 1.0"', hue) if hue is not None else F.lit("")
    rows = vertices.select(F.lit(1).alias("part"), F.concat(F.format_string('"%s" [m=%d', F.col("id").cast("string"), F.col("m").cast("long")), F.coalesce(more, F.lit("")), F.lit("]")).alias("value"))
    links = edges.select(F.lit(2).alias("part"), F.format_string('"%s" -- "%s" [m=%d]', F.col("u").cast("string"), F.col("v").cast("string"), F.col("m").cast("long")).alias("value"))
    return heads.unionByName(rows).unionByName(links)


def chromosome_graphviz_lines(annotated: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value) of a GraphViz file whose vertices annotated(id, chrom, hue) are labelled and coloured by chromosome."""
    spark = annotated.sparkSession
    heads = spark.createDataFrame([(0, "strict graph {\nnode [style=filled width=1 height=1]\nedge [color=lightgrey]"), (9, "}")], "part int, value string")
    name = F.format_string('"%s"', F.col("id").cast("string"))
    look = F.format_string(' [label="%s" color="%s,1,1"]', F.col("chrom"), F.col("hue").cast("string"))
    rows = annotated.select(F.lit(1).alias("part"), F.concat(name, F.when(F.col("chrom").isNotNull(), look).otherwise("")).alias("value"))
    a, b = F.least("u", "v").cast("string"), F.greatest("u", "v").cast("string")
    return heads.unionByName(rows).unionByName(edges.select(F.lit(2).alias("part"), F.format_string('"%s" -- "%s" [label=%d]', a, b, F.col("m").cast("long")).alias("value")))


def marker_lines(bxmx: DataFrame) -> DataFrame:
    """Barcode, tab, its markers as unsigned numbers in order, each once; rows without nulls, repeated ones too.

    Rows are dealt by barcode, about a million a task, and sorted; a barcode's line is put together from them as they pass.
    """
    rows = bxmx.select("bx", F.col("mx").cast("long").alias("mx"))
    dealt = spread(rows.repartition("bx"), "bx", rows.count()).sortWithinPartitions("bx", "mx")
    kind = rows.schema["bx"].dataType.simpleString()
    return dealt.mapInArrow(_marker_lists, f"bx {kind}, mxs string").select(F.concat(F.col("bx").cast("string"), F.lit("\t"), "mxs").alias("value"))


def _marker_lists(batches):
    """(bx, mxs) of sorted rows (bx, mx); the last barcode of a batch may go on in the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        bx = batch.column(0)
        last = int(np.flatnonzero(_changes(bx))[-1])
        if last or (held and held[-1].column(0)[-1] != bx[0]):
            yield _joined([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield _joined(held)


def _changes(values: pa.Array) -> np.ndarray:
    """Where a value is not the one before it; the first is not."""
    return np.concatenate([[True], pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy(zero_copy_only=False)])


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    bx, mx = (pa.concat_arrays([p.column(i) for p in parts]) for i in (0, 1))
    first = _changes(bx)
    kept = first | _changes(mx)
    at = np.flatnonzero(first)
    ends = np.append(np.cumsum(kept)[at] - 1, kept.sum()).astype(np.int32)
    text = mx.filter(pa.array(kept)).view(pa.uint64()).cast(pa.string())
    return pa.RecordBatch.from_arrays([bx.take(pa.array(at)), pc.binary_join(pa.ListArray.from_arrays(ends, text), " ")], names=["bx", "mxs"])


def path_lines(paths: DataFrame) -> DataFrame:
    rows = paths.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("elem").cast("string").alias("e")))).alias("p"))
    return rows.select("tid", F.array_join(F.transform("p", lambda x: x["e"]), " ").alias("value"))


def fleshed_lines(paths: DataFrame, placed: DataFrame) -> DataFrame:
    """Paths with the groups (a,b) of placed(tid, after, id) behind their positions; every element stands once."""
    groups = placed.groupBy("tid", F.col("after").alias("pos")).agg(F.concat(F.lit("("), F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), ","), F.lit(")")).alias("group"))
    rows = paths.join(groups, ["tid", "pos"], "left")
    return path_lines(rows.select("tid", "pos", F.concat_ws(" ", F.col("elem").cast("string"), "group").alias("elem")))


def bed_lines(rows: DataFrame) -> DataFrame:
    """(tid, pos, value) of BED records along paths, as filter_bed or with_boundaries give them: a row of nulls between two paths is
    NA in all six columns. Sort by tid and pos."""
    cells = (F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in ("tname", "tstart", "tend", "qname", "score", "orientation"))
    return rows.select("tid", "pos", F.concat_ws("\t", *cells).alias("value"))


def tab_lines(rows: DataFrame) -> DataFrame:
    """BED, PAF, statistics: all columns apart by tabs."""
    return rows.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in rows.columns)).alias("value"))


def fasta_lines(scaffolds: DataFrame) -> DataFrame:
    """(name, comment, seq) as two-line records."""
    return scaffolds.select(F.concat(F.lit(">"), "name", F.lit(" "), "comment", F.lit("\n"), "seq").alias("value"))


def fastq_lines(reads: DataFrame) -> DataFrame:
    tag = F.when(F.col("bx").isNotNull(), F.concat(F.lit(" BX:Z:"), "bx")).otherwise("")
    return reads.select(F.concat(F.lit("@"), "name", tag, F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))


#: Folders that write_by_seed deals the seeds' folders to. Spark lists the subfolders of a folder in a task each.
GROUPS = 64


def write_by_seed(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """One folder a seed of rows(seed, u, v, m), in one of GROUPS folders by hash, `group=i/seed=x`: as Parquet, or as graph
    text (tsv or gv) whose vertices are the edges' ends, each with its number of edges.

    For text, rows are stored first, since heads, vertices and edges each read them; a task sorts about a million of them."""
    group = F.pmod(F.xxhash64("seed"), F.lit(GROUPS)).cast("int")
    if form == "parquet":
        rows.withColumn("group", group).repartition("seed").write.partitionBy("group", "seed").parquet(path)
        return
    if form not in ("tsv", "gv"):
        raise ValueError("the form must be parquet, tsv or gv")
    rows = stored(rows.select("seed", "u", "v", "m"), "by-seed-rows")
    seeds = rows.select("seed").distinct()
    heads = {"tsv": [(0, "U\tm"), (2, ""), (3, "U\tV\tm")], "gv": [(0, "strict graph {"), (9, "}")]}[form]
    fixed = seeds.select("seed", F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.lit(v).alias("value")) for p, v in heads))).alias("h")).select("seed", "h.*")
    text = {"tsv": ("%s\t%d", "%s\t%s\t%d"), "gv": ('"%s" [m=%d]', '"%s" -- "%s" [m=%d]')}[form]
    ids = rows.select("seed", F.explode(F.array("u", "v")).alias("id")).groupBy("seed", "id").agg(F.count("*").alias("m"))
    vertices = ids.select("seed", F.lit(1).alias("part"), F.format_string(text[0], F.col("id").cast("string"), "m").alias("value"))
    edges = rows.select("seed", F.lit(4).alias("part"), F.format_string(text[1], F.col("u").cast("string"), F.col("v").cast("string"), F.col("m").cast("long")).alias("value"))
    lines = fixed.unionByName(vertices).unionByName(edges)
    lines = spread(lines.withColumn("group", group).repartition("seed"), "seed", rows.count()).sortWithinPartitions("group", "seed", "part", "value")
    lines.select("group", "seed", "value").write.partitionBy("group", "seed").text(path)
    discard(rows)


def graph_statistics(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: vertices, edges, edges a vertex."""
    v, e = vertices.agg(F.count("*").alias("vertices")), edges.agg(F.count("*").alias("edges"))
    both = v.withColumn("k", F.lit(0)).join(e.withColumn("k", F.lit(0)), "k")
    return both.select("vertices", "edges", F.try_divide(F.col("edges"), F.col("vertices")).alias("edges_per_vertex"))

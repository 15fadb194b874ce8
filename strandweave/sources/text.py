"""Readers of the text formats; every one is a DataFrame over Spark's text source, gzip included."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from strandweave.functions.scalar import parse_unsigned
from strandweave.plans.shared import stored


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value): lines with their 0-based number in their file.

    A line's place in its split comes from the scan; the splits' line counts, a row each, give every split its start.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("mid"), "value")
    along = W.Window.partitionBy("file").orderBy("block").rowsBetween(W.Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.min("mid").alias("first"), F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
    return lines.join(F.broadcast(blocks.select("file", "block", "first", "before")), ["file", "block"]).select("file", (F.col("before") + F.col("mid") - F.col("first")).alias("line"), "value")


def _barcode(comment: Column) -> Column:
    return F.when(F.startswith(comment, F.lit("BX:Z:")), F.substring(comment, 6, 1 << 30))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(name, seq, bx): records of any number of lines; the name ends at white space, a comment BX:Z:... is the barcode.

    Records are split at line starts with >, so a file is read by many tasks.
    """
    return _fasta_records(spark.read.option("lineSep", "\n>").text(path))


def _fasta_records(text: DataFrame, *more: Column) -> DataFrame:
    value = F.regexp_replace(F.col("value"), "^>", "")
    head = F.split(value, "\r?\n", 2)
    name = F.split(head[0], r"\s", 2)
    rows = text.select("value", *more).filter(F.length(F.trim("value")) > 0)
    kept = [c for c in rows.columns if c != "value"]
    return rows.select(name[0].alias("name"), F.regexp_replace(F.coalesce(F.get(head, F.lit(1)), F.lit("")), r"\s", "").alias("seq"), _barcode(F.get(name, F.lit(1))).alias("bx"), *kept)


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, ord, name, seq, bx, qual) of four-line records; ord is the record's number in its file. A record cut off at the end of
    the file has a null quality.

    A first pass counts the lines of every part of a file that a task reads, and keeps its outermost three, so that the
    second knows where in a record each part starts: records inside a part never leave their task. Those across parts
    are put together from the outermost lines alone, a few a part.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), "value")
    edges = stored(lines.mapInArrow(_outermost, "file string, block long, n long, at array<long>, values array<string>"), "fastq-parts")
    along = W.Window.partitionBy("file").orderBy("block").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = edges.select("*", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))  # a row a part
    starts = stored(starts, "fastq-starts")
    rows = lines.join(F.broadcast(starts.select("file", "block", "before")), ["file", "block"]).select("file", "block", "before", "value")
    fields = "file string, ord long, head string, seq string, qual string"
    inside = rows.mapInArrow(_whole_records, fields)
    # Lines before a part's first record and from its last, unfinished one on.
    first, last = F.pmod(-F.col("before"), F.lit(4)), F.pmod(F.col("before") + F.col("n"), F.lit(4))
    cut = starts.select("file", "before", "n", first.alias("first"), last.alias("last"), F.explode(F.arrays_zip("at", "values")).alias("x"))
    cut = cut.filter((F.col("x.at") < F.col("first")) | (F.col("x.at") >= F.col("n") - F.col("last")))
    line = F.col("before") + F.col("x.at")
    loose = cut.select("file", F.floor(line / 4).alias("ord"), (line % 4).alias("part"), F.col("x.values").alias("value"))
    across = loose.groupBy("file", "ord").agg(*(F.max(F.when(F.col("part") == i, F.col("value"))).alias(c) for i, c in ((0, "head"), (1, "seq"), (3, "qual"))))
    rows = inside.unionByName(across)
    name = F.split(F.regexp_replace("head", "^@", ""), r"\s", 2)
    whole = F.when(F.length("qual") == F.length("seq"), F.col("qual"))
    return rows.select("file", "ord", name[0].alias("name"), "seq", _barcode(F.get(name, F.lit(1))).alias("bx"), whole.alias("qual"))


def _parts(batch: pa.RecordBatch):
    """(file, block, rows) of each run of rows from one part of a file."""
    file, block = batch.column(0).to_pylist(), batch.column(1).to_numpy()
    cuts = [0, *(i for i in range(1, len(file)) if file[i] != file[i - 1] or block[i] != block[i - 1]), len(file)]
    for a, z in zip(cuts, cuts[1:]):
        yield file[a], int(block[a]), batch.slice(a, z - a)


def _outermost(batches):
    """For each part of a file: its lines' number, and the first and last three lines with their places."""
    seen: dict[tuple, list] = {}
    for batch in batches:
        for file, block, rows in _parts(batch):
            n, low, high = seen.setdefault((file, block), [0, [], []])
            values = rows.column(rows.schema.get_field_index("value"))
            low += [(n + i, values[i].as_py()) for i in range(min(len(values), 3 - len(low)))]
            high += [(n + i, values[i].as_py()) for i in range(max(0, len(values) - 3), len(values))]
            seen[file, block] = [n + len(values), low, high[-3:]]
    rows = [(file, block, n, *zip(*sorted({*low, *high}))) for (file, block), (n, low, high) in seen.items()]
    kinds = pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "n", "at", "values"])


def _whole_records(batches):
    """The records whose four lines are all in one part of a file; its lines come in order."""
    parts: dict[tuple, list] = {}  # lines to skip, number of the next record, lines held over
    for batch in batches:
        before, at = batch.column(2).to_numpy(), 0
        for file, block, rows in _parts(batch):
            start, at, values = int(before[at]), at + rows.num_rows, rows.column(3)
            state = parts.setdefault((file, block), [-start % 4, -(-start // 4), values.slice(0, 0)])
            skip = min(state[0], len(values))
            state[0] -= skip
            values = pa.concat_arrays([state[2], values.slice(skip)])
            n = len(values) // 4
            head, seq, qual = (values.take(pa.array(np.arange(n) * 4 + i)) for i in (0, 1, 3))
            yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array(np.arange(n) + state[1]), head, seq, qual], names=["file", "ord", "head", "seq", "qual"])
            state[1], state[2] = state[1] + n, values.slice(4 * n)


def fasta_dictionary(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(name, seq, bx) with each name once: of records of one name the last counts, by order of the files and within them."""
    given = [path] if isinstance(path, str) else list(path)
    meta = F.col("_metadata")
    rows = None
    for i, p in enumerate(given):
        text = spark.read.option("lineSep", "\n>").text(p)
        part = _fasta_records(text, F.struct(F.lit(i).alias("i"), meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("mid")).alias("at"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("name").agg(F.max_by(F.struct("seq", "bx"), "at").alias("x")).select("name", "x.*")


def linked_barcode(name: Column, bx: Column, fastq: Column) -> Column:
    """The barcode of a linked read: its tag up to a space, else a FASTA record's name, else what stands between # and the last / of the name, else NA."""
    combined = F.regexp_extract(name, "#(.*)/", 1)
    return F.coalesce(F.split(bx, " ", 2)[0], F.when(~fastq, name), F.when(combined != "", combined), F.lit("NA"))


def read_markers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(bx, mx), distinct: barcode, tab, markers; positions behind a colon are dropped, rows without markers too.

    A line is split once and its markers told apart in it; they are shuffled only if a barcode has several lines.
    """
    parts = F.split(F.trim("value"), r"\s+", 2)
    lists = spark.read.text(path).select(parts[0].alias("bx"), F.split(F.get(parts, F.lit(1)), r"\s+").alias("ts"))
    marker = lambda t: parse_unsigned(F.substring_index(t, ":", 1))
    rows = lists.select("bx", F.array_distinct(F.transform(F.filter("ts", lambda t: t != ""), marker)).alias("mxs")).select("bx", F.explode("mxs").alias("mx"))
    return rows if lists.groupBy("bx").count().filter("count > 1").isEmpty() else rows.distinct()


def read_marker_lists(spark: SparkSession, path: str | list[str], positions: bool = False) -> DataFrame:
    """(qid, qpos, mx, pos): ordered markers with repeats; pos is null where the file has none. Repeated ids are an error, and
    with `positions` so is a marker without one, when the rows are read."""
    parts = F.split(F.rtrim("value"), r"\s+", 2)
    lists = spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(parts[0].alias("qid"), F.split(F.get(parts, F.lit(1)), r"\s+").alias("ts"))
    if not lists.groupBy("qid").count().filter("count > 1").isEmpty():
        raise ValueError("an id has two marker lists")
    rows = lists.select("qid", F.posexplode("ts").alias("qpos", "t")).filter("t <> ''")
    pos = F.get(F.split("t", ":"), F.lit(1)).cast("long")
    if positions:
        pos = F.coalesce(pos, F.raise_error(F.concat(F.lit("a marker without a position: "), "t")).cast("long"))
    return rows.select("qid", "qpos", parse_unsigned(F.split("t", ":")[0]).alias("mx"), pos.alias("pos"))


def read_graph(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(vertices(id, m, mol), edges(u, v, m)) of files with a vertex table (U m [mol]), an empty line and an edge table (U V m).

    Of repeated vertices or edges the last line counts. Any other shape is an error when the rows are read. A folder that
    Spark wrote is one file in parts.
    """
    at = F.struct("file", "line").alias("at")
    lines = numbered_lines(spark, path).withColumn("whole", F.regexp_replace("file", "/part-[^/]*$", "/part")).withColumn("at", at)
    edge_head = lines.filter(F.col("value").rlike("^U\tV\t")).groupBy("whole").agg(F.min("at").alias("head"))
    rows = lines.join(F.broadcast(edge_head), "whole", "left").withColumn("c", F.split("value", "\t")).filter("value <> '' AND NOT value RLIKE '^U\t'")
    of_edges = F.coalesce(F.col("at") > F.col("head"), F.lit(False))
    last = lambda key, *cols: F.max_by(F.struct(*cols), F.struct("file", "line")).alias("x")
    # The check names of_edges, so that it stays above the join that decides it.
    check = lambda ok: F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not a graph line: "), "value")))
    v = rows.filter(~of_edges).filter(check(of_edges | F.size("c").isin(2, 3)))
    v = v.groupBy(F.col("c")[0].alias("id")).agg(last("id", F.col("c")[1].cast("long").alias("m"), F.get("c", F.lit(2)).cast("int").alias("mol"))).select("id", "x.*")
    e = rows.filter(of_edges).filter(check(~of_edges | (F.size("c") == 3))).withColumn("a", F.least(F.col("c")[0], F.col("c")[1])).withColumn("b", F.greatest(F.col("c")[0], F.col("c")[1]))
    e = e.groupBy(F.col("a").alias("u"), F.col("b").alias("v")).agg(last("u", F.col("c")[2].cast("long").alias("m"))).select("u", "v", "x.m")
    return v, e


def read_graphviz(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(vertices(id, m), edges(u, v, m)) of lines such as "u" [m=3] and "u" -- "v" [m=2]."""
    text = spark.read.text(path)
    edge, vertex = r'"([^"]+)"\s*--\s*"([^"]+)"\s*\[[^\]]*\bm=(\d+)', r'^\s*"([^"]+)"\s*\[[^\]]*\bm=(\d+)'
    part = lambda r, i: F.regexp_extract("value", r, i)
    e = text.filter(F.col("value").rlike(edge)).select(F.least(part(edge, 1), part(edge, 2)).alias("u"), F.greatest(part(edge, 1), part(edge, 2)).alias("v"), part(edge, 3).cast("long").alias("m"))
    return text.filter(F.col("value").rlike(vertex)).select(part(vertex, 1).alias("id"), part(vertex, 2).cast("long").alias("m")), e


def read_paths(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(tid, pos, elem): a path a line, its elements apart by white space. tid counts the lines, empty ones too, over all files
    in the order given (files of one folder by name), so paths of several files are never one."""
    given = [path] if isinstance(path, str) else list(path)
    lines = reduce(DataFrame.unionByName, (numbered_lines(spark, p).withColumn("given", F.lit(i)) for i, p in enumerate(given)))
    before = F.coalesce(F.sum("n").over(W.Window.orderBy("given", "file").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    files = lines.groupBy("given", "file").agg(F.count("*").alias("n")).select("given", "file", before.alias("before"))  # a row a file
    rows = lines.join(F.broadcast(files), ["given", "file"]).filter(F.length(F.trim("value")) > 0)
    return rows.select((F.col("line") + F.col("before")).alias("tid"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("pos", "elem"))


BED = "tname string, tstart long, tend long, qname string, score long, orientation string"
PAF = "qname string, qlength long, qstart long, qend long, orientation string, tname string, tlength long, tstart long, tend long, score long, length long, mapq long"


def read_bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """BED rows of lines with 5 or 6 columns (no orientation: .) or of PAF lines with 12 or more; others are an error."""
    c = F.split("value", "\t")
    n = F.size(c)
    at = lambda bed, paf: F.when(n >= 12, F.get(c, F.lit(paf))).otherwise(F.get(c, F.lit(bed)))
    ok = F.when((n >= 12) | n.isin(5, 6), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not a BED or PAF line: "), "value")))
    rows = spark.read.text(path).filter(F.length("value") > 0).filter(~F.startswith("value", F.lit("NA\t"))).filter(ok)
    sign = F.when(n >= 12, c[4]).when(n == 6, F.get(c, F.lit(5))).otherwise(".")
    return rows.select(at(0, 5).alias("tname"), at(1, 7).cast("long").alias("tstart"), at(2, 8).cast("long").alias("tend"), at(3, 0).alias("qname"), at(4, 9).cast("long").alias("score"), sign.alias("orientation"))


def read_paf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    c = F.split("value", "\t")
    fields = [x.split() for x in PAF.split(", ")]
    return spark.read.text(path).filter(F.length("value") > 0).select(*(c[i].cast(kind).alias(name) for i, (name, kind) in enumerate(fields)))


def read_names(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(id): the first token of every line."""
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+")[0].alias("id")).filter("id <> ''")


def read_pairs_of_tokens(spark: SparkSession, path: str | list[str], first: str = "bx", second: str = "chrom") -> DataFrame:
    c = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.size(c) == 2).select(c[0].alias(first), c[1].alias(second))


def read_histogram(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(f, n): the second and third field of lines that do not start with k."""
    c = F.split("value", r"\s+")
    return spark.read.text(path).filter(~F.startswith("value", F.lit("k")) & (F.size(c) >= 3)).select(c[1].cast("long").alias("f"), c[2].cast("long").alias("n"))


def read_repeats(spark: SparkSession, path: str | list[str]) -> DataFrame:
    c = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.size(c) == 2).select(c[0].alias("kmer"), c[1].cast("long").alias("n"))


def read_evidence(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(u, v, hh, ht, th, tt), each pair from both ends."""
    c = F.split("value", r"\s+")
    rows = spark.read.text(path).filter(F.size(c) >= 6).select(c[0].alias("u"), c[1].alias("v"), *(c[i + 2].cast("long").alias(n) for i, n in enumerate(("hh", "ht", "th", "tt"))))
    return rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v"), "hh", F.col("th").alias("ht"), F.col("ht").alias("th"), "tt"))


def read_distances(spark: SparkSession, path: str | list[str], which: str = "avg") -> DataFrame:
    """(u, v, d), each pair from both ends, without orientation signs; `which` is min, avg or max."""
    c = F.split("value", r"\s+")
    bare = lambda x: F.regexp_replace(x, "[+-]+$", "")
    rows = spark.read.text(path).filter(~F.startswith("value", F.lit("contig1")) & (F.size(c) >= 5))
    rows = rows.select(bare(c[0]).alias("u"), bare(c[1]).alias("v"), c[{"min": 2, "avg": 3, "max": 4}[which]].cast("double").cast("int").alias("d"))
    return rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v"), "d"))

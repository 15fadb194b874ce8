"""From mapped sequences to ordered, oriented and assembled scaffolds, and their metrics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from strandweave.functions.scalar import natural_key, oriented, significant_link
from strandweave.plans.shared import numbered

from .mapping import large_groups, median_low, values_at


def bed_to_path(bed: DataFrame, least: int = 0) -> DataFrame:
    """(tid, pos, elem): each sequence on the target that holds most of its records (ties: the smaller name), at the lower
    median of its starts, with its commonest orientation (. on a tie), in order of start, orientation and name."""
    rows = bed.filter(F.col("score") >= least).withColumn("t", F.col("tname").cast("string"))
    signs = [F.count_if(F.col("orientation") == s).alias(f"n{i}") for i, s in enumerate("+-.")]
    gathered = lambda some: some.groupBy("qname", "t").agg(F.count("*").alias("n"), median_low(F.array_sort(F.collect_list("tstart"))).alias("start"), *signs)
    large = large_groups(rows, "qname")
    if large is None:
        counts = gathered(rows)
    else:  # sequences of very many records: their medians by chunks
        some = rows.join(F.broadcast(large), "qname", "left_semi")
        medians = values_at(some, ["qname", "t"], "tstart", {"start": lambda n: F.floor((n - 1) / 2)})
        chunked = medians.join(some.groupBy("qname", "t").agg(*signs), ["qname", "t"])
        counts = gathered(rows.join(F.broadcast(large), "qname", "left_anti")).unionByName(chunked)
    best = F.row_number().over(W.Window.partitionBy("qname").orderBy(F.desc("n"), "t"))
    a, b, c = F.col("n0"), F.col("n1"), F.col("n2")
    sign = F.when((a > b) & (a > c), "+").when((b > a) & (b > c), "-").otherwise(".")
    placed = counts.withColumn("_r", best).filter("_r = 1").select("t", "start", sign.alias("sign"), "qname")
    along = W.Window.partitionBy("t").orderBy("start", "sign", "qname")
    return placed.select(F.col("t").alias("tid"), (F.row_number().over(along) - 1).alias("pos"), F.concat("qname", "sign").alias("elem"))


def ngxx(sizes: DataFrame, total: float, *shares: float, column: str = "size") -> list[int]:
    """For each share, the first size, from the largest, at which the running sum reaches total * share; 0 where it never does."""
    counts = sizes.groupBy(F.col(column).alias("size")).agg(F.count("*").alias("n"))
    upto = counts.withColumn("sum", F.sum(F.col("size") * F.col("n")).over(W.Window.orderBy(F.desc("size")).rowsBetween(W.Window.unboundedPreceding, 0)))
    return list(upto.agg(*(F.coalesce(F.max(F.when(F.col("sum") >= total * p, F.col("size"))), F.lit(0)) for p in shares)).first())


def size_metrics(sizes: DataFrame, total: float, column: str = "size") -> DataFrame:
    """One row: max, ng25, ng50, ng75, min, paths, nodes; zeros for no sizes. Runs over distinct sizes only."""
    counts = sizes.groupBy(F.col(column).alias("size")).agg(F.count("*").alias("n"))
    upto = counts.withColumn("sum", F.sum(F.col("size") * F.col("n")).over(W.Window.orderBy(F.desc("size")).rowsBetween(W.Window.unboundedPreceding, 0)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    ng = lambda p: zero(F.max(F.when(F.col("sum") >= total * p, F.col("size"))))
    return upto.agg(zero(F.max("size")).alias("max"), ng(0.25).alias("ng25"), ng(0.5).alias("ng50"), ng(0.75).alias("ng75"), zero(F.min("size")).alias("min"), zero(F.sum("n")).alias("paths"), zero(F.sum(F.col("size") * F.col("n"))).alias("nodes"))


def path_metrics(paths: DataFrame, expected: float, least: int = 0) -> DataFrame:
    return size_metrics(paths.groupBy("tid").agg(F.count("*").alias("size")).filter(F.col("size") >= least), expected)


def paf_metrics(paf: DataFrame, expected: float) -> DataFrame:
    return size_metrics(paf.select((F.col("qend") - F.col("qstart")).alias("size")), expected)


def filter_bed(paths: DataFrame, bed: DataFrame, whole_names: bool = False) -> DataFrame:
    """BED records of path elements, in path order: (tid, pos, tname, tstart, tend, qname, score, orientation).
    Unless `whole_names`, records belong to the element's name up to its first underscore."""
    name = F.col("elem").cast("string")
    key = name if whole_names else F.split(name, "_", 2)[0]
    return paths.withColumn("_k", key).join(bed, F.col("_k") == F.col("qname").cast("string")).select("tid", "pos", *bed.columns)


def missing_elements(paths: DataFrame, bed: DataFrame) -> DataFrame:
    """(elem) without a BED record."""
    key = F.split(F.col("elem").cast("string"), "_", 2)[0]
    return paths.withColumn("_k", key).join(bed.select(F.col("qname").cast("string").alias("_k")), "_k", "left_anti").select("elem").distinct()


def assemble(paths: DataFrame, sequences: DataFrame, gap: int = 100, least: int = 0, distances: DataFrame | None = None, unplaced_too: bool = False) -> DataFrame:
    """(tid, seq, n): the sequences of each path's oriented elements (name and + - or .), joined by gaps of N.

    An unoriented element is as many N as its length. With distances(u, v, d), two oriented neighbours stand d apart,
    or `gap` where none is known. Paths without an oriented element (unless `unplaced_too`), and results shorter than
    `least`, are left out. Names of sequences(name, seq) must be distinct, as fasta_dictionary gives them.
    """
    sign, name = F.right("elem", F.lit(1)), F.expr("substring(elem, 1, length(elem) - 1)")
    rows = paths.select("tid", "pos", "elem", sign.alias("sign"), name.alias("name")).join(sequences.select("name", "seq"), "name")
    along = W.Window.partitionBy("tid").orderBy("pos")
    rows = rows.withColumn("before", F.lag("name").over(along)).withColumn("both", (F.col("sign") != ".") & (F.lag("sign").over(along) != "."))
    if distances is not None:
        known = distances.select("u", "v", "d").unionByName(distances.select(F.col("v").alias("u"), F.col("u").alias("v"), "d"))
        known = known.groupBy(F.col("u").alias("before"), F.col("v").alias("name")).agg(F.max("d").alias("d"))
        rows = rows.join(known, ["before", "name"], "left").withColumn("gap", F.when(F.col("both"), F.coalesce("d", F.lit(gap))).otherwise(gap))
    else:
        rows = rows.withColumn("gap", F.lit(gap))
    piece = F.when(F.col("sign") == ".", F.repeat(F.lit("N"), F.length("seq"))).otherwise(oriented(F.col("seq"), F.col("elem")))
    text = F.when(F.col("before").isNull(), piece).otherwise(F.concat(F.repeat(F.lit("N"), F.greatest(F.col("gap"), F.lit(0)).cast("int")), piece))
    parts = rows.select("tid", "pos", text.alias("text"), (F.col("sign") != ".").alias("placed"))
    joined = parts.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("p"), F.count("*").alias("n"), F.max("placed").alias("placed"))
    joined = joined if unplaced_too else joined.filter("placed")
    return joined.select("tid", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("seq"), "n").filter(F.length("seq") >= least)


def assemble_with_evidence(paths: DataFrame, sequences: DataFrame, pairs: DataFrame, gap: int = 100, least: int = 0, distances: DataFrame | None = None) -> DataFrame:
    """assemble() after orient_paths() by pairs(u, v, hh, ht, th, tt); paths that stay without an oriented element are kept, as N."""
    return assemble(orient_paths(paths, pairs), sequences, gap, least, distances, unplaced_too=True)


def unused_sequences(paths: DataFrame, sequences: DataFrame, least: int = 0) -> DataFrame:
    """Sequences that no path holds oriented, in full."""
    used = paths.filter(F.right("elem", F.lit(1)) != ".").select(F.expr("substring(elem, 1, length(elem) - 1)").alias("name"))
    return sequences.join(used, "name", "left_anti").filter(F.length("seq") >= least)


#: Orientations of a neighbouring pair by the place of its evidence hh, ht, th, tt (fixed values).
PAIRS = ("-+", "--", "++", "+-")


def orient_paths(paths: DataFrame, pairs: DataFrame) -> DataFrame:
    """Gives unoriented elements of paths(tid, pos, elem) an orientation from pairs(u, v, hh, ht, th, tt), where significant.

    One fold a path: an oriented element carries its orientation backward to the unoriented ones just before it and
    forward to those after it, as far as each neighbouring pair has one significant place that agrees. An oriented
    element that disagrees with its significant pair is overwritten. A path of one unoriented element is +.
    """
    mirror = pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "hh", F.col("th").alias("ht"), F.col("ht").alias("th"), "tt")
    links = pairs.select("u", "v", "hh", "ht", "th", "tt").unionByName(mirror).withColumn("place", significant_link([F.col(c) for c in ("hh", "ht", "th", "tt")]))
    links = links.filter("place >= 0").groupBy("u", "v").agg(F.max("place").alias("place"))
    rows = paths.select("tid", "pos", F.expr("substring(elem, 1, length(elem) - 1)").alias("u"), F.right("elem", F.lit(1)).alias("sign"))
    rows = rows.withColumn("v", F.lead("u").over(W.Window.partitionBy("tid").orderBy("pos"))).join(links, ["u", "v"], "left")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        signs, places = list(group["sign"]), [None if pd.isna(p) else PAIRS[int(p)] for p in group["place"]]
        if len(signs) == 1:
            signs = ["+" if signs[0] == "." else signs[0]]
        for i in range(1, len(signs)):  # forward
            if signs[i - 1] != "." and places[i - 1] and places[i - 1][0] == signs[i - 1]:
                signs[i] = places[i - 1][1]
        for i in range(len(signs) - 2, -1, -1):  # backward, over what is still open
            if signs[i] == "." and signs[i + 1] != "." and places[i] and places[i][1] == signs[i + 1]:
                signs[i] = places[i][0]
        return pd.DataFrame({"tid": group["tid"], "pos": group["pos"], "elem": group["u"] + pd.Series(signs, group.index)})

    kinds = dict(paths.dtypes)
    return rows.groupBy("tid").applyInPandas(fold, f"tid {kinds['tid']}, pos {kinds['pos']}, elem string")


def number_scaffolds(assembled: DataFrame, unused: DataFrame) -> DataFrame:
    """(name, comment, seq): paths from the longest, then unused sequences by name, numbered from 0000001."""
    rows = assembled.select(F.lit(0).alias("part"), F.col("tid").cast("string").alias("key"), "seq", "n").unionByName(unused.select(F.lit(1).alias("part"), F.col("name").alias("key"), "seq", F.lit(1).cast("long").alias("n")))
    rows = numbered(rows, [F.col("part"), F.when(F.col("part") == 0, -F.length("seq")).otherwise(0), F.col("key")], "number")
    return rows.select(F.lpad(F.col("number").cast("string"), 7, "0").alias("name"), F.format_string("LN:i:%d xn:i:%d", F.length("seq").cast("long"), F.col("n")).alias("comment"), "seq")


def gaps(sequences: DataFrame, letter: str = "N", least: int = 1) -> DataFrame:
    """(name, start, end, length) of the runs of a letter, 0-based and half open."""
    runs = F.regexp_extract_all(F.col("seq"), F.lit(f"([^{letter}]*)({letter}*)"), F.lit(0))
    # Lengths of the alternating pieces give the starts; only pieces that hold the letter are runs.
    pieces = sequences.select("name", F.posexplode(runs).alias("i", "piece")).filter(F.length("piece") > 0)
    lengths = pieces.select("name", "i", F.length("piece").alias("all"), F.length(F.regexp_extract("piece", f"({letter}*)$", 1)).alias("length"))
    upto = F.sum("all").over(W.Window.partitionBy("name").orderBy("i"))
    return lengths.withColumn("end", upto).filter(F.col("length") >= least).select("name", (F.col("end") - F.col("length")).alias("start"), "end", F.col("length").cast("long").alias("length"))


def scaftigs(sequences: DataFrame) -> DataFrame:
    """(name, part, seq): sequences cut at their runs of N."""
    return sequences.select("name", F.posexplode(F.filter(F.split("seq", "[Nn]+"), lambda s: s != "")).alias("part", "seq"))


def depth_mode(hist: DataFrame) -> DataFrame:
    """One row, mode: of hist(f, n), the position (from 1) of the first maximum from the local minimum on, where counts
    first rise; the first place if they never do. Histograms are small: a row a depth."""
    order = W.Window.orderBy("f")
    rows = hist.select("f", "n", F.row_number().over(order).alias("i"), (F.col("n") > F.lag("n").over(order)).alias("rises"))
    low = rows.agg(F.coalesce(F.min(F.when(F.col("rises"), F.col("i"))) - 1, F.lit(1)).alias("low"))
    tail = rows.crossJoin(F.broadcast(low)).filter("i >= low")  # one row joined to each
    return tail.agg(F.max_by("i", F.struct("n", -F.col("i"))).cast("long").alias("mode"))


def coverage(intervals: DataFrame, name: str = "tname", start: str = "tstart", end: str = "tend") -> DataFrame:
    """(name, covered): length of the union of half-open intervals, by merging islands."""
    along = W.Window.partitionBy(name).orderBy(start, end)
    seen = F.max(end).over(along.rowsBetween(W.Window.unboundedPreceding, -1))
    rows = intervals.withColumn("_new", F.greatest(F.col(start), F.coalesce(seen, F.col(start))))
    return rows.groupBy(F.col(name).alias("name")).agg(F.sum(F.greatest(F.col(end) - F.col("_new"), F.lit(0))).cast("long").alias("covered"))


def compare_molecule_counts(ours: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: barcodes in both, and how many of them are split alike, too little, or too much, by (bx, molecules)."""
    both = ours.join(truth.select("bx", F.col("molecules").alias("true")), "bx")
    return both.agg(F.count("*").alias("both"), F.count_if(F.col("molecules") == F.col("true")).alias("consistent"), F.count_if(F.col("molecules") < F.col("true")).alias("under"), F.count_if(F.col("molecules") > F.col("true")).alias("over"))


def annotate_vertices(vertices: DataFrame, paths: DataFrame, bed: DataFrame) -> DataFrame:
    """(id, qname, hue): the best mapping of each vertex (highest score, ties: smaller name) and its place among all names on a colour circle."""
    at = paths.select(F.col("tid").cast("string").alias("t"), F.col("pos").alias("tstart"), F.col("elem").alias("id"))
    found = bed.withColumn("t", F.col("tname").cast("string")).join(at, ["t", "tstart"])
    best = F.row_number().over(W.Window.partitionBy("id").orderBy(F.desc("score"), "qname"))
    named = found.withColumn("_r", best).filter("_r = 1").select("id", "qname")
    names = numbered(bed.select("qname").distinct(), [F.col("qname")], "at")
    hues = names.select("qname", F.round((F.col("at") - 1) / F.lit(max(names.count(), 1)), 3).alias("hue"))
    return vertices.select("id").join(named, "id", "left").join(hues, "qname", "left").select("id", "qname", "hue")


def annotate_chromosomes(vertices: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """(id, chrom, hue): vertices with their chromosome of chromosomes(bx, chrom) (repeated barcodes: the greatest name) and
    its place among the distinct names, in natural order, on a colour circle. Names are few; they are ranked together."""
    own = chromosomes.groupBy(F.col("bx").alias("id")).agg(F.max("chrom").alias("chrom"))
    names = own.select("chrom").distinct()
    place = F.row_number().over(W.Window.orderBy(*natural_key(F.col("chrom")), "chrom")) - 1
    hues = names.select("chrom", F.round(place / F.count("*").over(W.Window.partitionBy()), 3).alias("hue"))
    return vertices.select("id").join(own, "id", "left").join(hues, "chrom", "left").select("id", "chrom", "hue")


def genome_size(sequences: DataFrame) -> DataFrame:
    """One row, bases: the length of all sequences(name, seq)."""
    return sequences.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("long").alias("bases"))


def repeat_threshold(hist: DataFrame, times: int = 3) -> DataFrame:
    """One row, threshold: `times` the mode of a depth histogram (see depth_mode), above which k-mers count as repeats."""
    return depth_mode(hist).select((times * F.col("mode")).cast("long").alias("threshold"))


def with_index(rows: DataFrame, index: DataFrame, name: str = "name") -> DataFrame:
    """rows(name, ...) with the number that index(name, index) gives their name; names it does not hold are left out."""
    return rows.join(index.select(name, "index"), name)

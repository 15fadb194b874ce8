"""Queries that write a relation in one of the text formats into the shared folder and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions import scalar as fn
from strandweave.operators import graph, scaffold
from strandweave.sources import sinks, text

from .graph_queries import FLESH, thinned
from .inputs import BXMX, GRAPH, PATHS, QUERY, SEQUENCES, customer_markers, edges, ids, nation_paths, sequences, supplied, table
from .mapping_queries import BED, EVIDENCE, WHISKERS, bed, evidence, paf
from .registry import query
from .shared import new_path


def kept(lines: DataFrame, what: str, **options: str) -> str:
    """Writes lines(value) and returns their folder."""
    path = new_path(lines.sparkSession, what)
    sinks.write_lines(lines, path, **options)
    return path


@query(f"WITH {BXMX} SELECT CAST(bx AS VARCHAR) AS bx, mx FROM bxmx")
def markers_file(spark, sf_dir):
    """The lines of the file tell repeated rows apart, so they are shuffled once."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("bx"), F.col("l_partkey").alias("mx")).dropna()
    return text.read_markers(spark, kept(sinks.marker_lines(rows), "markers", compression="gzip"))


@query(f"WITH {QUERY} SELECT CAST(qid AS VARCHAR) AS qid, qpos, mx, CAST(qpos * 10 + mx % 10 AS BIGINT) AS pos FROM qmx")
def marker_lists_file(spark, sf_dir):
    token = F.concat(F.col("mx").cast("string"), F.lit(":"), (F.col("qpos") * 10 + F.col("mx") % 10).cast("string"))
    lists = customer_markers(spark, sf_dir).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("qpos", token.alias("t")))).alias("ts"))
    lines = lists.select(F.concat(F.col("qid").cast("string"), F.lit("\t"), F.array_join(F.transform("ts", lambda x: x["t"]), " ")).alias("value"))
    return text.read_marker_lists(spark, kept(lines, "lists"), positions=True)


def _graph_path(spark, sf_dir, form):
    g = thinned(spark, sf_dir)
    vertices = ids(g).join(supplied(spark, sf_dir).groupBy(F.col("bx").alias("id")).agg(F.count("*").alias("m")), "id")
    path = new_path(spark, form)
    sinks.write_graph(vertices.select(F.col("id").cast("string").alias("id"), "m"), g.select(F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"), "m"), path, form)
    return path


TEXT_EDGES = f"WITH {GRAPH} SELECT least(CAST(u AS VARCHAR), CAST(v AS VARCHAR)) AS u, greatest(CAST(u AS VARCHAR), CAST(v AS VARCHAR)) AS v, m FROM g"
TEXT_VERTICES = f"WITH {GRAPH} SELECT CAST(bx AS VARCHAR) AS id, count(*) AS m FROM bxmx WHERE bx IN (SELECT u FROM s) GROUP BY bx"


@query(TEXT_EDGES)
def graph_file_edges(spark, sf_dir):
    return text.read_graph(spark, _graph_path(spark, sf_dir, "tsv"))[1]


@query(TEXT_VERTICES)
def graph_file_vertices(spark, sf_dir):
    return text.read_graph(spark, _graph_path(spark, sf_dir, "tsv"))[0].select("id", "m")


@query(TEXT_EDGES)
def graphviz_file_edges(spark, sf_dir):
    return text.read_graphviz(spark, _graph_path(spark, sf_dir, "gv"))[1]


@query(TEXT_VERTICES)
def graphviz_file_vertices(spark, sf_dir):
    return text.read_graphviz(spark, _graph_path(spark, sf_dir, "gv"))[0]


@query(f"WITH {PATHS} SELECT dense_rank() OVER (ORDER BY tid) - 1 AS tid, pos, CAST(elem AS VARCHAR) AS elem FROM paths")
def paths_file(spark, sf_dir):
    return text.read_paths(spark, kept(sinks.path_lines(nation_paths(spark, sf_dir)).orderBy("tid"), "paths"))


def _fleshed(spark, sf_dir):
    paths = nation_paths(spark, sf_dir)
    return sinks.fleshed_lines(paths, graph.flesh_paths(edges(spark, sf_dir), paths))


@query(f"""WITH {FLESH}, groups AS (SELECT tid, "after" AS pos, '(' || string_agg(CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)) || ')' AS members FROM placed GROUP BY 1, 2)
    SELECT paths.tid, string_agg(CAST(elem AS VARCHAR) || coalesce(' ' || members, ''), ' ' ORDER BY pos) AS "value" FROM paths LEFT JOIN groups USING (tid, pos) GROUP BY paths.tid""")
def fleshed_paths(spark, sf_dir):
    return _fleshed(spark, sf_dir)


@query(f"WITH {FLESH} SELECT tid, CAST(elem AS VARCHAR) AS elem FROM paths UNION ALL SELECT tid, CAST(id AS VARCHAR) FROM placed")
def unfleshed_elements(spark, sf_dir):
    """The fleshed paths, written, read back as tokens and taken apart into their elements."""
    lines = spark.read.text(kept(_fleshed(spark, sf_dir).select(F.concat_ws("\t", F.col("tid").cast("string"), "value").alias("value")), "fleshed"))
    rows = lines.select(F.split("value", "\t").alias("x")).select(F.col("x")[0].cast("long").alias("tid"), F.explode(F.split(F.col("x")[1], " ")).alias("token"))
    return rows.select("tid", F.explode(fn.plain_elements(F.col("token"))).alias("elem"))


TEXT_BED = "SELECT CAST(tname AS VARCHAR) AS tname, CAST(tstart AS BIGINT) AS tstart, CAST(tend AS BIGINT) AS tend, CAST(qname AS VARCHAR) AS qname, score, orientation FROM"


@query(f"WITH {BED} {TEXT_BED} bed")
def bed_file(spark, sf_dir):
    return text.read_bed(spark, kept(sinks.tab_lines(bed(spark, sf_dir)), "bed", compression="gzip"))


@query(f"WITH {WHISKERS} {TEXT_BED} paf")
def bed_of_paf_file(spark, sf_dir):
    return text.read_bed(spark, kept(sinks.tab_lines(paf(spark, sf_dir)), "paf", compression="gzip"))


@query(f"WITH {WHISKERS} SELECT CAST(qname AS VARCHAR) AS qname, qlength, qstart, qend, orientation, CAST(tname AS VARCHAR) AS tname, tlength, tstart, tend, score, length, mapq FROM paf")
def paf_file(spark, sf_dir):
    records = paf(spark, sf_dir)
    rows, kinds = text.read_paf(spark, kept(sinks.tab_lines(records), "paf", compression="gzip")), dict(records.dtypes)
    return rows.select(*(F.col(c) if c in ("qname", "tname") else F.col(c).cast(kinds[c]) for c in rows.columns))


@query(f"WITH {SEQUENCES} SELECT name, seq, CASE WHEN CAST(name AS BIGINT) % 2 = 0 THEN 'bx' || name ELSE name END AS bx FROM seqs")
def fasta_file(spark, sf_dir):
    """Parts as records, every second with a barcode; a FASTA record without one is its own."""
    comment = F.when(F.col("name").cast("long") % 2 == 0, F.concat(F.lit("BX:Z:bx"), F.col("name"))).otherwise("no tag")
    rows = text.read_fasta(spark, kept(sinks.fasta_lines(sequences(spark, sf_dir).withColumn("comment", comment)), "fasta"))
    return rows.select("name", "seq", text.linked_barcode(F.col("name"), F.col("bx"), F.lit(False)).alias("bx"))


@query(f"WITH {SEQUENCES}, sized AS (SELECT name, seq, p_size FROM seqs JOIN part ON CAST(p_partkey AS VARCHAR) = name) SELECT name, CASE WHEN p_size > 25 THEN seq ELSE reverse(seq) END AS seq FROM sized")
def fasta_names_once(spark, sf_dir):
    """All parts' sequences reversed, and then those of the large parts as they are: of one name the last record counts."""
    rows = sequences(spark, sf_dir).withColumn("comment", F.lit("x"))
    large = table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").cast("string").alias("name"))
    first, second = rows.withColumn("seq", F.reverse("seq")), rows.join(large, "name", "left_semi").select(*rows.columns)
    return text.fasta_dictionary(spark, [kept(sinks.fasta_lines(first), "first"), kept(sinks.fasta_lines(second), "second")]).select("name", "seq")


@query(f"WITH {SEQUENCES} SELECT 'r#' || name || '/1' AS name, seq, CASE WHEN CAST(name AS BIGINT) % 2 = 0 THEN 'bx' || name ELSE name END AS bx, reverse(seq) AS qual FROM seqs")
def fastq_file(spark, sf_dir):
    """Parts as gzipped reads; those without a tag have their barcode in their name."""
    bx = F.when(F.col("name").cast("long") % 2 == 0, F.concat(F.lit("bx"), F.col("name")))
    reads = sequences(spark, sf_dir).select(F.concat(F.lit("r#"), "name", F.lit("/1")).alias("name"), "seq", bx.alias("bx"), F.reverse("seq").alias("qual"))
    rows = text.read_fastq(spark, kept(sinks.fastq_lines(reads), "fastq", compression="gzip"))
    return rows.select("name", "seq", text.linked_barcode(F.col("name"), F.col("bx"), F.lit(True)).alias("bx"), "qual")


@query("SELECT CAST(p_size AS BIGINT) AS f, count(*) AS n FROM part GROUP BY p_size")
def histogram_file(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    lines = rows.select(F.concat_ws("\t", F.lit("32"), F.col("p_size").cast("string"), F.col("n").cast("string")).alias("value"))
    return text.read_histogram(spark, kept(lines.unionByName(spark.createDataFrame([("k\tf\tn",)], "value string")), "histogram"))


@query(f"WITH {SEQUENCES}, k AS (SELECT substr(seq, i, 6) AS kmer FROM seqs, (SELECT unnest(generate_series(1, 27)) AS i)) SELECT kmer, count(*) AS n FROM k GROUP BY kmer")
def repeats_file(spark, sf_dir):
    rows = sequences(spark, sf_dir).select(F.explode(fn.kmers(F.col("seq"), 6)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))
    return text.read_repeats(spark, kept(rows.select(F.concat_ws("\t", "kmer", F.col("n").cast("string")).alias("value")), "repeats"))


@query("SELECT replace(s_name, ' ', '_') AS id FROM supplier")
def names_file(spark, sf_dir):
    name = F.replace("s_name", F.lit(" "), F.lit("_"))
    return text.read_names(spark, kept(table(spark, sf_dir, "supplier").select(F.concat(name, F.lit(" and more")).alias("value")), "names"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS bx, 'chr' || s_nationkey AS chrom FROM supplier")
def chromosomes_file(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit(" chr"), F.col("s_nationkey").cast("string")).alias("value"))
    return text.read_pairs_of_tokens(spark, kept(rows, "chromosomes"))


@query(f"WITH {EVIDENCE} SELECT CAST(u AS VARCHAR) AS u, CAST(v AS VARCHAR) AS v, hh, ht, th, tt FROM pairs UNION ALL SELECT CAST(v AS VARCHAR), CAST(u AS VARCHAR), hh, th, ht, tt FROM pairs")
def evidence_file(spark, sf_dir):
    return text.read_evidence(spark, kept(sinks.tab_lines(evidence(spark, sf_dir).select("u", "v", "hh", "ht", "th", "tt")), "evidence"))


@query(f"WITH {EVIDENCE}, d AS (SELECT CAST(u AS VARCHAR) AS u, CAST(v AS VARCHAR) AS v, CAST(hh + ht + th + tt AS INTEGER) AS d FROM pairs) SELECT * FROM d UNION ALL SELECT v, u, d FROM d")
def distances_file(spark, sf_dir):
    total = F.col("hh") + F.col("ht") + F.col("th") + F.col("tt")
    rows = evidence(spark, sf_dir).select(F.concat(F.col("u").cast("string"), F.lit("+")).alias("u"), F.concat(F.col("v").cast("string"), F.lit("-")).alias("v"), (total - 1).alias("low"), (total + 0.5).alias("mid"), (total + 2).alias("high"))
    return text.read_distances(spark, kept(sinks.tab_lines(rows), "distances"))


@query(f"""WITH {GRAPH}, x AS (SELECT DISTINCT u AS seed, u AS id FROM s UNION SELECT u, v FROM s),
    inside AS (SELECT a.seed, g.u, g.v, g.m FROM g JOIN x a ON a.id = g.u JOIN x b ON b.id = g.v AND b.seed = a.seed), n AS (SELECT seed, u AS id FROM inside UNION ALL SELECT seed, v FROM inside)
    SELECT DISTINCT seed, unnest(['U' || chr(9) || 'm', '', 'U' || chr(9) || 'V' || chr(9) || 'm']) AS "value" FROM inside
    UNION ALL SELECT seed, id || chr(9) || count(*) FROM n GROUP BY seed, id UNION ALL SELECT seed, u || chr(9) || v || chr(9) || m FROM inside""")
def subgraph_files(spark, sf_dir):
    """A graph file for the neighbourhood of every vertex, as lines."""
    g = thinned(spark, sf_dir)
    path = new_path(spark, "by-seed")
    sinks.write_by_seed(graph.subgraphs(g, None, 1), path, "tsv")
    return spark.read.schema("value string, seed long").text(path).select("seed", "value")


@query(f"WITH {GRAPH} SELECT (SELECT count(DISTINCT u) FROM s) AS vertices, (SELECT count(*) FROM g) AS edges, CAST((SELECT count(*) FROM g) AS DOUBLE) / (SELECT nullif(count(DISTINCT u), 0) FROM s) AS edges_per_vertex")
def graph_statistics(spark, sf_dir):
    g = thinned(spark, sf_dir)
    return sinks.graph_statistics(ids(g), g)


@query(f"""WITH {PATHS}, r AS (SELECT n_name AS tname, s_suppkey AS tstart, s_suppkey + 1 AS tend, s_suppkey AS qname, CAST(round(s_acctbal) AS BIGINT) AS score, '.' AS orientation FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal < 5000),
    b AS (SELECT tid, pos, r.* FROM paths JOIN r ON qname = elem)
    SELECT tid, pos, concat_ws(chr(9), tname, tstart, tend, qname, score, orientation) AS "value" FROM b
    UNION ALL SELECT DISTINCT tid, CAST(-1 AS INTEGER), concat_ws(chr(9), 'NA', 'NA', 'NA', 'NA', 'NA', 'NA') FROM b WHERE tid <> 0""")
def bed_with_separators(spark, sf_dir):
    from strandweave.operators import reports

    return sinks.bed_lines(reports.with_boundaries(scaffold.filter_bed(nation_paths(spark, sf_dir), suppliers_as_bed(spark, sf_dir))))


def suppliers_as_bed(spark, sf_dir):
    """A record of every supplier with a balance below 5000."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    rows = table(spark, sf_dir, "supplier").filter("s_acctbal < 5000").join(nations, "s_nationkey")
    return rows.select(F.col("n_name").alias("tname"), F.col("s_suppkey").alias("tstart"), (F.col("s_suppkey") + 1).alias("tend"), F.col("s_suppkey").alias("qname"), F.round("s_acctbal").cast("long").alias("score"), F.lit(".").alias("orientation"))

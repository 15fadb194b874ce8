"""Queries that map customers' marker sequences onto the nations' supplier paths, and assemble scaffolds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from strandweave.functions.scalar import significant_link
from strandweave.operators import mapping, reports, scaffold

from . import pipelines
from .inputs import BXMX, PATHS, QUERY, SEQUENCES, customer_markers, nation_paths, sequences, supplied, table
from .registry import query
from .shared import stored

#: Hits of query markers on path positions, and their score and lower median.
HITS = f"{BXMX}, {PATHS}, {QUERY}, hits AS (SELECT qid, qpos, tid, pos AS tpos FROM qmx JOIN bxmx USING (mx) JOIN paths ON elem = bx)"
SPOTS = f"{HITS}, spots AS (SELECT qid, tid, tpos, count(*) AS score, quantile_disc(qpos, 0.5) AS med FROM hits GROUP BY ALL)"
TURN = "CASE WHEN b IS NOT NULL AND a IS NOT NULL THEN CASE WHEN b = med AND med = a THEN '.' WHEN b <= med AND med <= a THEN '+' WHEN b >= med AND med >= a THEN '-' ELSE '.' END WHEN b IS NOT NULL THEN CASE WHEN b < med THEN '+' WHEN b > med THEN '-' ELSE '.' END WHEN a IS NOT NULL THEN CASE WHEN med < a THEN '+' WHEN med > a THEN '-' ELSE '.' END ELSE '.' END"
BED = f"""{SPOTS}, around AS (SELECT *, max(med) OVER (PARTITION BY qid, tid ORDER BY tpos RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS b, max(med) OVER (PARTITION BY qid, tid ORDER BY tpos RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS a FROM spots),
    bed AS (SELECT tid AS tname, tpos AS tstart, tpos + 1 AS tend, qid AS qname, score, {TURN} AS orientation FROM around WHERE score >= 3)"""
WHISKERS = f"""{HITS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, tid, tpos ORDER BY qpos) - 1 AS r, count(*) OVER (PARTITION BY qid, tid, tpos) AS n FROM hits),
    q AS (SELECT qid, tid, tpos, max(n) AS score, min(qpos) AS q0, max(CASE WHEN r = round_even(0.25 * (n - 1), 0) THEN qpos END) AS q1, max(CASE WHEN r = round_even(0.5 * (n - 1), 0) THEN qpos END) AS med, max(CASE WHEN r = round_even(0.75 * (n - 1), 0) THEN qpos END) AS q3, max(qpos) AS q4 FROM ranked GROUP BY ALL),
    w AS (SELECT *, greatest(q0, CAST(trunc(q1 - 1.5 * (q3 - q1)) AS INTEGER)) AS qstart, least(q4, CAST(trunc(q3 + 1.5 * (q3 - q1)) AS INTEGER)) AS qend, max(med) OVER (PARTITION BY qid, tid ORDER BY tpos RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS b, max(med) OVER (PARTITION BY qid, tid ORDER BY tpos RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS a FROM q),
    ql AS (SELECT qid, count(*) AS qlength FROM qmx GROUP BY qid), tl AS (SELECT tid, count(*) AS tlength FROM paths GROUP BY tid),
    paf AS (SELECT qid AS qname, qlength, qstart, qend, {TURN} AS orientation, tid AS tname, tlength, tpos AS tstart, tpos + 1 AS tend, score, qlength AS length,
            CASE WHEN qend = qstart THEN 0 ELSE CAST(trunc(100.0 * score / (qend - qstart)) AS INTEGER) END AS mapq FROM w JOIN ql USING (qid) JOIN tl USING (tid) WHERE score >= 3)"""


def index(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("bx"), F.col("l_partkey").alias("mx")).dropna()  # the index drops repeats
    return mapping.positional_index(nation_paths(spark, sf_dir), lines, split=True)


def bed(spark, sf_dir):
    return mapping.map_to_bed(customer_markers(spark, sf_dir), index(spark, sf_dir), 3)


def paf(spark, sf_dir):
    return mapping.map_to_paf(customer_markers(spark, sf_dir), index(spark, sf_dir), nation_paths(spark, sf_dir), 3)


@query(f"WITH {BXMX}, {PATHS} SELECT DISTINCT mx, tid, pos AS tpos FROM bxmx JOIN paths ON elem = bx")
def positional_index(spark, sf_dir):
    return index(spark, sf_dir)


@query(f"WITH {BED} SELECT * FROM bed")
def map_bed(spark, sf_dir):
    return bed(spark, sf_dir)


@query(f"""WITH {SPOTS}, around AS (SELECT *, list_sort(list(med) OVER (PARTITION BY qid, tid ORDER BY tpos RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)) AS bl, list_sort(list(med) OVER (PARTITION BY qid, tid ORDER BY tpos RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING)) AS al FROM spots),
    ab AS (SELECT *, bl[CAST(floor((len(bl) - 1) / 2.0) AS INTEGER) + 1] AS b, al[CAST(floor(len(al) / 2.0) AS INTEGER) + 1] AS a FROM around)
    SELECT tid AS tname, tpos AS tstart, tpos + 1 AS tend, qid AS qname, score, {TURN} AS orientation FROM ab WHERE score >= 3""")
def map_bed_wide(spark, sf_dir):
    return mapping.map_to_bed(customer_markers(spark, sf_dir), index(spark, sf_dir), 3, 3)


@query(f"WITH {WHISKERS} SELECT * FROM paf")
def map_paf(spark, sf_dir):
    return paf(spark, sf_dir)


@query()
def map_trend(spark, sf_dir):
    return mapping.map_trend(customer_markers(spark, sf_dir), index(spark, sf_dir), 3)


@query(f"WITH {BED} SELECT * FROM bed QUALIFY row_number() OVER (PARTITION BY tname, tstart, tend ORDER BY score DESC, qname) = 1")
def best_per_position(spark, sf_dir):
    return mapping.best_per_position(bed(spark, sf_dir))


@query(f"WITH {WHISKERS} SELECT qname AS tname, qstart AS tstart, qend AS tend, tname || '_' || tstart AS qname, score, orientation FROM paf")
def paf_to_bed(spark, sf_dir):
    return mapping.paf_to_bed(paf(spark, sf_dir))


@query(f"WITH {WHISKERS}, spot AS (SELECT qid AS qname, qpos AS idx, CAST(qpos * 10 + mx % 10 AS BIGINT) AS pos FROM qmx), last AS (SELECT qname, max(pos) AS l FROM spot GROUP BY qname) SELECT paf.* REPLACE (l AS qlength, a.pos AS qstart, b.pos AS qend) FROM paf JOIN spot a ON a.qname = paf.qname AND a.idx = qstart JOIN spot b ON b.qname = paf.qname AND b.idx = qend JOIN last ON last.qname = paf.qname")
def liftover_paf(spark, sf_dir):
    positions = customer_markers(spark, sf_dir).select("qid", F.col("qpos").alias("idx"), (F.col("qpos") * 10 + F.col("mx") % 10).cast("long").alias("pos"))
    return mapping.liftover(paf(spark, sf_dir), positions)


@query(f"""WITH {WHISKERS}, k AS (SELECT * FROM paf WHERE mapq >= 4 QUALIFY row_number() OVER (PARTITION BY tname, tstart ORDER BY score DESC, qname, qstart, qend) = 1),
    o AS (SELECT *, lag(qstart) OVER p AS ps, lag(qend) OVER p AS pe, lead(qstart) OVER p AS ns, lead(qend) OVER p AS ne FROM k WINDOW p AS (PARTITION BY qname, tname ORDER BY qstart, qend, tstart)),
    t AS (SELECT * FROM o WHERE coalesce(qstart <= pe AND ps <= qend, false) OR coalesce(qstart <= ne AND ns <= qend, false)),
    n AS (SELECT *, CASE WHEN coalesce(greatest(qstart - lag(qend) OVER p, lag(qstart) OVER p - qend, 0) >= 20 OR greatest(tstart - lag(tend) OVER p, lag(tstart) OVER p - tend, 0) >= 10, false) THEN 1 ELSE 0 END AS x FROM t WINDOW p AS (PARTITION BY qname, tname ORDER BY qstart, qend, tstart)),
    c AS (SELECT *, CAST(sum(x) OVER (PARTITION BY qname, tname ORDER BY qstart, qend, tstart) AS BIGINT) AS segment FROM n),
    m AS (SELECT qname, tname, segment, orientation, row_number() OVER (PARTITION BY qname, tname, segment ORDER BY count(*) DESC, orientation) AS k FROM c GROUP BY 1, 2, 3, 4)
    SELECT c.qname, c.tname, c.segment, min(qstart) AS qstart, max(qend) AS qend, min(tstart) AS tstart, max(tend) AS tend, CAST(sum(score) AS BIGINT) AS matches, quantile_disc(mapq, 0.5) AS mapq, count(*) AS n, any_value(m.orientation) AS orientation
    FROM c JOIN m ON m.qname = c.qname AND m.tname = c.tname AND m.segment = c.segment AND m.k = 1 GROUP BY 1, 2, 3""")
def chain(spark, sf_dir):
    return mapping.chain(paf(spark, sf_dir), 0, 4, 20, 10)


METRICS = """up AS (SELECT size, n, sum(size * n) OVER (ORDER BY size DESC ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT size, count(*) AS n FROM sizes GROUP BY size))
    SELECT CAST(coalesce(max(size), 0) AS BIGINT) AS max, CAST(coalesce(max(CASE WHEN s >= 0.25 * {g} THEN size END), 0) AS BIGINT) AS ng25, CAST(coalesce(max(CASE WHEN s >= 0.5 * {g} THEN size END), 0) AS BIGINT) AS ng50, CAST(coalesce(max(CASE WHEN s >= 0.75 * {g} THEN size END), 0) AS BIGINT) AS ng75,
           CAST(coalesce(min(size), 0) AS BIGINT) AS min, CAST(coalesce(sum(n), 0) AS BIGINT) AS paths, CAST(coalesce(sum(size * n), 0) AS BIGINT) AS nodes FROM up"""


@query(f"WITH {PATHS}, sizes AS (SELECT count(*) AS size FROM paths GROUP BY tid HAVING count(*) >= 2), {METRICS.format(g=90)}")
def path_metrics(spark, sf_dir):
    return scaffold.path_metrics(nation_paths(spark, sf_dir), 90, 2)


@query(f"WITH {WHISKERS}, sizes AS (SELECT qend - qstart AS size FROM paf), {METRICS.format(g=20000)}")
def paf_metrics(spark, sf_dir):
    return scaffold.paf_metrics(paf(spark, sf_dir), 20_000)


@query(f"""WITH {BED}, c AS (SELECT qname, CAST(tname AS VARCHAR) AS t, count(*) AS n, quantile_disc(tstart, 0.5) AS start, count(*) FILTER (orientation = '+') AS a, count(*) FILTER (orientation = '-') AS b, count(*) FILTER (orientation = '.') AS d FROM bed GROUP BY 1, 2),
    k AS (SELECT *, CASE WHEN a > b AND a > d THEN '+' WHEN b > a AND b > d THEN '-' ELSE '.' END AS sign FROM c QUALIFY row_number() OVER (PARTITION BY qname ORDER BY n DESC, t) = 1)
    SELECT t AS tid, CAST(row_number() OVER (PARTITION BY t ORDER BY start, sign, qname) - 1 AS INTEGER) AS pos, qname || sign AS elem FROM k""")
def bed_to_path(spark, sf_dir):
    return scaffold.bed_to_path(stored(bed(spark, sf_dir), "bed"))


@query(f"WITH {PATHS}, r AS (SELECT 'bed' AS tname, l_linenumber AS tstart, l_linenumber + 1 AS tend, l_suppkey AS qname, CAST(l_quantity AS BIGINT) AS score, '.' AS orientation FROM lineitem) SELECT tid, pos, r.* FROM paths JOIN r ON qname = elem")
def filter_bed(spark, sf_dir):
    return scaffold.filter_bed(nation_paths(spark, sf_dir), _lines_as_bed(spark, sf_dir))


@query(f"WITH {PATHS} SELECT DISTINCT elem FROM paths WHERE elem NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 5000)")
def missing_elements(spark, sf_dir):
    from .format_queries import suppliers_as_bed

    return scaffold.missing_elements(nation_paths(spark, sf_dir), suppliers_as_bed(spark, sf_dir))


def _lines_as_bed(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.lit("bed").alias("tname"), F.col("l_linenumber").alias("tstart"), (F.col("l_linenumber") + 1).alias("tend"), F.col("l_suppkey").alias("qname"), F.col("l_quantity").cast("long").alias("score"), F.lit(".").alias("orientation"))


#: Suppliers as oriented elements: their key and a sign from it.
SIGNED = f"{PATHS}, {SEQUENCES}, signed AS (SELECT tid, pos, CAST(elem AS VARCHAR) AS name, CASE elem % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END AS sign FROM paths)"
PIECE = "CASE sign WHEN '.' THEN repeat('N', length(seq)) WHEN '+' THEN seq ELSE reverse(translate(seq, 'ACGTN', 'TGCAN')) END"


def signed_paths(spark, sf_dir):
    sign = F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(".")), (F.col("elem") % 3 + 1).cast("int"))
    return nation_paths(spark, sf_dir).select("tid", "pos", F.concat(F.col("elem").cast("string"), sign).alias("elem"))


@query(f"WITH {SIGNED} SELECT tid, string_agg({PIECE}, repeat('N', 10) ORDER BY pos) AS seq, count(*) AS n FROM signed JOIN seqs USING (name) GROUP BY tid HAVING bool_or(sign <> '.')")
def assemble_paths(spark, sf_dir):
    return scaffold.assemble(signed_paths(spark, sf_dir), sequences(spark, sf_dir), 10)


@query(f"""WITH {SIGNED}, d AS (SELECT CAST(elem AS VARCHAR) AS u, CAST(lead(elem) OVER (PARTITION BY tid ORDER BY pos) AS VARCHAR) AS v, CAST(elem % 7 AS INTEGER) AS d FROM paths),
    x AS (SELECT signed.*, seq, lag(name) OVER (PARTITION BY tid ORDER BY pos) AS before, sign <> '.' AND lag(sign) OVER (PARTITION BY tid ORDER BY pos) <> '.' AS b FROM signed JOIN seqs USING (name)),
    y AS (SELECT x.*, CASE WHEN b THEN coalesce(d.d, 10) ELSE 10 END AS gap FROM x LEFT JOIN (SELECT * FROM d JOIN supplier ON s_suppkey = CAST(u AS BIGINT) WHERE s_acctbal >= 2000) d ON d.u = before AND d.v = name)
    SELECT tid, string_agg(CASE WHEN before IS NULL THEN '' ELSE repeat('N', gap) END || {PIECE}, '' ORDER BY pos) AS seq, count(*) AS n FROM y GROUP BY tid HAVING bool_or(sign <> '.')""")
def assemble_with_distances(spark, sf_dir):
    from pyspark.sql import window as W

    along = W.Window.partitionBy("tid").orderBy("pos")
    known = nation_paths(spark, sf_dir).select(F.col("elem").cast("string").alias("u"), F.lead("elem").over(along).cast("string").alias("v"), (F.col("elem") % 7).cast("int").alias("d")).filter("v IS NOT NULL")
    rich = table(spark, sf_dir, "supplier").filter("s_acctbal >= 2000").select(F.col("s_suppkey").cast("string").alias("u"))
    known = known.join(rich, "u", "left_semi")
    return scaffold.assemble(signed_paths(spark, sf_dir), sequences(spark, sf_dir), 10, 0, known)


#: Sequences of a part's size, 32 bases at most.
SIZED = f"{SIGNED}, sized AS (SELECT name, substr(seq, 1, p_size) AS seq FROM seqs JOIN part ON CAST(p_partkey AS VARCHAR) = name)"


def sized_sequences(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), "p_size")
    return sequences(spark, sf_dir).join(sizes, "name").select("name", F.substring("seq", F.lit(1), F.col("p_size").cast("int")).alias("seq"))


@query(f"WITH {SIZED}, a AS (SELECT tid, string_agg({PIECE}, repeat('N', 10) ORDER BY pos) AS seq, count(*) AS n FROM signed JOIN sized USING (name) GROUP BY tid HAVING bool_or(sign <> '.')) SELECT * FROM a WHERE length(seq) >= 120")
def assemble_long_paths(spark, sf_dir):
    return scaffold.assemble(signed_paths(spark, sf_dir), sized_sequences(spark, sf_dir), 10, 120)


@query(f"WITH {SIZED} SELECT name, seq FROM sized WHERE name NOT IN (SELECT name FROM signed WHERE sign <> '.') AND length(seq) >= 20")
def unused_long_sequences(spark, sf_dir):
    return scaffold.unused_sequences(signed_paths(spark, sf_dir), sized_sequences(spark, sf_dir), 20)


@query(f"WITH {SIGNED} SELECT name, seq FROM seqs WHERE name NOT IN (SELECT name FROM signed WHERE sign <> '.')")
def unused_sequences(spark, sf_dir):
    return scaffold.unused_sequences(signed_paths(spark, sf_dir), sequences(spark, sf_dir))


@query(f"""WITH {SIGNED}, a AS (SELECT 0 AS part, CAST(tid AS VARCHAR) AS key, string_agg({PIECE}, repeat('N', 10) ORDER BY pos) AS seq, count(*) AS n FROM signed JOIN seqs USING (name) GROUP BY tid HAVING bool_or(sign <> '.')),
    b AS (SELECT 1 AS part, name AS key, seq, 1 AS n FROM seqs WHERE name NOT IN (SELECT name FROM signed WHERE sign <> '.')), x AS (SELECT * FROM a UNION ALL SELECT * FROM b)
    SELECT lpad(CAST(row_number() OVER (ORDER BY part, CASE WHEN part = 0 THEN -length(seq) ELSE 0 END, key) AS VARCHAR), 7, '0') AS name, 'LN:i:' || length(seq) || ' xn:i:' || n AS comment, seq FROM x""")
def number_scaffolds(spark, sf_dir):
    paths, seqs = signed_paths(spark, sf_dir), sequences(spark, sf_dir)
    return scaffold.number_scaffolds(scaffold.assemble(paths, seqs, 10), scaffold.unused_sequences(paths, seqs))


#: A kind, 0 to 3, of each line of a supplier: by line number, turned by its key, so that one kind stands out; or evenly, in debt.
PAIRS_OF_LINES = """nb AS (SELECT elem AS u, lead(elem) OVER (PARTITION BY tid ORDER BY pos) AS v FROM paths), kinds AS (SELECT u, v, CASE WHEN s_acctbal < 0 THEN l_linenumber % 4 ELSE (least(l_linenumber - 1, 3) + u) % 4 END AS k
    FROM nb JOIN supplier ON s_suppkey = u JOIN lineitem ON l_suppkey = u WHERE v IS NOT NULL),
    pairs AS (SELECT u, v, count(*) FILTER (k = 0) AS hh, count(*) FILTER (k = 1) AS ht, count(*) FILTER (k = 2) AS th, count(*) FILTER (k = 3) AS tt FROM kinds GROUP BY 1, 2)"""
EVIDENCE = f"{PATHS}, {PAIRS_OF_LINES}"


@query(f"""WITH {EVIDENCE}, x AS (SELECT *, list_sort([hh, ht, th, tt], 'DESC') AS o FROM pairs)
    SELECT u, v, CASE WHEN o[1] + o[2] > 0 AND o[1] - (o[1] + o[2]) / 2.0::DOUBLE > 1.6448536269514722::DOUBLE * sqrt((o[1] + o[2]) / 4.0::DOUBLE) THEN CAST(list_position([hh, ht, th, tt], o[1]) AS INTEGER) - 1 ELSE -1 END AS place FROM x""")
def significant_links(spark, sf_dir):
    rows = evidence(spark, sf_dir)
    return rows.select("u", "v", significant_link([F.col(c) for c in ("hh", "ht", "th", "tt")]).alias("place"))


def evidence(spark, sf_dir):
    """(u, v, hh, ht, th, tt) of neighbours in the nations' paths, from the kinds of the first one's lines."""
    along = W.Window.partitionBy("tid").orderBy("pos")
    nb = nation_paths(spark, sf_dir).select(F.col("elem").alias("u"), F.lead("elem").over(along).alias("v")).filter("v IS NOT NULL")
    owners = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("u"), "s_acctbal")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("u"), "l_linenumber")
    kind = F.when(F.col("s_acctbal") < 0, F.col("l_linenumber") % 4).otherwise((F.least(F.col("l_linenumber") - 1, F.lit(3)) + F.col("u")) % 4)
    rows = nb.join(owners, "u").join(lines, "u").withColumn("k", kind)
    return rows.groupBy("u", "v").agg(*(F.count_if(F.col("k") == i).alias(c) for i, c in enumerate(("hh", "ht", "th", "tt"))))


def _named_evidence(spark, sf_dir):
    return evidence(spark, sf_dir).withColumns({"u": F.col("u").cast("string"), "v": F.col("v").cast("string")})


#: oriented(tid, pos, name, sign): signs carried forward, and then backward over what is open, along significant pairs.
ORIENTED = f"""{SIGNED}, {PAIRS_OF_LINES}, ways AS (SELECT CAST(u AS VARCHAR) AS u, CAST(v AS VARCHAR) AS v, hh, ht, th, tt FROM pairs UNION ALL SELECT CAST(v AS VARCHAR), CAST(u AS VARCHAR), hh, th, ht, tt FROM pairs),
    sorted AS (SELECT *, list_sort([hh, ht, th, tt], 'DESC') AS o FROM ways),
    sure AS (SELECT u, v, ['-+', '--', '++', '+-'][max(list_position([hh, ht, th, tt], o[1]))] AS p FROM sorted WHERE o[1] + o[2] > 0 AND o[1] - (o[1] + o[2]) / 2.0::DOUBLE > 1.6448536269514722::DOUBLE * sqrt((o[1] + o[2]) / 4.0::DOUBLE) GROUP BY u, v),
    chain AS (SELECT tid, pos, name, sign, p, n FROM (SELECT *, lead(name) OVER (PARTITION BY tid ORDER BY pos) AS after, count(*) OVER (PARTITION BY tid) AS n FROM signed) LEFT JOIN sure ON u = name AND v = after),
    fwd(tid, pos, sign) AS (SELECT tid, pos, CASE WHEN n = 1 AND sign = '.' THEN '+' ELSE sign END FROM chain WHERE pos = 0
        UNION ALL SELECT c.tid, c.pos, CASE WHEN f.sign <> '.' AND b.p[1] = f.sign THEN b.p[2] ELSE c.sign END FROM fwd f JOIN chain b ON b.tid = f.tid AND b.pos = f.pos JOIN chain c ON c.tid = f.tid AND c.pos = f.pos + 1),
    bwd(tid, pos, sign) AS (SELECT f.tid, f.pos, f.sign FROM fwd f JOIN chain c ON c.tid = f.tid AND c.pos = f.pos WHERE f.pos = c.n - 1
        UNION ALL SELECT f.tid, f.pos, CASE WHEN f.sign = '.' AND b.sign <> '.' AND c.p[2] = b.sign THEN c.p[1] ELSE f.sign END FROM bwd b JOIN fwd f ON f.tid = b.tid AND f.pos = b.pos - 1 JOIN chain c ON c.tid = f.tid AND c.pos = f.pos),
    oriented AS (SELECT bwd.tid, bwd.pos, name, bwd.sign FROM bwd JOIN chain ON chain.tid = bwd.tid AND chain.pos = bwd.pos)"""


@query(f"WITH RECURSIVE {ORIENTED} SELECT tid, pos, name || sign AS elem FROM oriented")
def orient_paths(spark, sf_dir):
    return scaffold.orient_paths(signed_paths(spark, sf_dir), _named_evidence(spark, sf_dir))


@query("""WITH x AS (SELECT l_suppkey AS name, l_partkey AS s, l_partkey + l_linenumber AS e FROM lineitem), y AS (SELECT name, e, greatest(s, coalesce(max(e) OVER (PARTITION BY name ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s)) AS n FROM x)
    SELECT name, CAST(sum(greatest(e - n, 0)) AS BIGINT) AS covered FROM y GROUP BY name""")
def coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tname"), F.col("l_partkey").alias("tstart"), (F.col("l_partkey") + F.col("l_linenumber")).alias("tend"))
    return scaffold.coverage(rows)


@query(f"""WITH {BED}, b AS (SELECT elem AS id, qname FROM bed JOIN paths ON tid = tname AND pos = tstart QUALIFY row_number() OVER (PARTITION BY elem ORDER BY score DESC, qname) = 1),
    h AS (SELECT qname, round((row_number() OVER (ORDER BY qname) - 1) / CAST(count(*) OVER () AS DOUBLE), 3) AS hue FROM (SELECT DISTINCT qname FROM bed))
    SELECT s_suppkey AS id, b.qname, hue FROM supplier LEFT JOIN b ON b.id = s_suppkey LEFT JOIN h ON h.qname = b.qname""")
def annotate_vertices(spark, sf_dir):
    vertices = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return scaffold.annotate_vertices(vertices, nation_paths(spark, sf_dir), stored(bed(spark, sf_dir), "bed"))


CHROMOSOMES = "chroms AS (SELECT s_suppkey AS bx, CASE WHEN s_nationkey % 2 = 0 THEN 'chr' || s_nationkey ELSE n_name END AS chrom FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal >= 0)"


@query(f"""WITH {CHROMOSOMES}, k AS (SELECT DISTINCT chrom, regexp_replace(chrom, '^chr', '') AS bare FROM chroms),
    h AS (SELECT chrom, round((row_number() OVER (ORDER BY NOT regexp_full_match(bare, '[0-9]+'), TRY_CAST(bare AS BIGINT), bare, chrom) - 1) / CAST(count(*) OVER () AS DOUBLE), 3) AS hue FROM k)
    SELECT s_suppkey AS id, chrom, hue FROM supplier LEFT JOIN chroms ON bx = s_suppkey LEFT JOIN h USING (chrom)""")
def annotate_chromosomes(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    name = F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("chr"), F.col("s_nationkey").cast("string"))).otherwise(F.col("n_name"))
    chroms = rows.filter("s_acctbal >= 0").join(nations, "s_nationkey").select(F.col("s_suppkey").alias("bx"), name.alias("chrom"))
    return scaffold.annotate_chromosomes(rows.select(F.col("s_suppkey").alias("id")), chroms)


@query("""SELECT p_brand AS report, count(*) AS n, NULL::BIGINT AS size, 'Maker ' || regexp_extract(p_brand, '[0-9]+') AS title, NULL AS share FROM part GROUP BY p_brand
    UNION ALL SELECT p_type, count(*), sum(p_size), NULL, format('{:.1f}%', ((2000 * count(*) + (SELECT count(*) FROM part)) // (2 * (SELECT count(*) FROM part))) / 10.0) FROM part GROUP BY p_type""")
def stacked_reports(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    title = reports.picked(reports.readable(F.replace("p_brand", F.lit("#"), F.lit("_")), {"Brand-": "Maker "}), "^[A-Za-z]+", "[0-9]+$")
    brands = parts.groupBy("p_brand").agg(F.count("*").alias("n"), F.max("p_size").alias("most")).select(F.col("p_brand").alias("report"), "n", "most", title.alias("title"))
    types = parts.groupBy(F.col("p_type").alias("report")).agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))
    shares = types.withColumn("share", reports.percent(F.col("n"), F.sum("n").over(W.Window.partitionBy())))
    return reports.stack_reports([brands, shares], drop=["most"])


def _map(spark, sf_dir):
    return pipelines.physical_map(supplied(spark, sf_dir), 2, None, branch=2, bridge=3, junction=2)


@query()
def scaffolds(spark, sf_dir):
    """Parts as draft sequences, each with the markers of the customer of its key."""
    markers = customer_markers(spark, sf_dir).withColumn("qid", F.col("qid").cast("string"))
    return pipelines.scaffolds(_map(spark, sf_dir), markers, sequences(spark, sf_dir), 2, 2, 10)


@query()
def map_quality(spark, sf_dir):
    return pipelines.map_quality(_map(spark, sf_dir), customer_markers(spark, sf_dir), 20_000, 3)


@query(f"WITH {BXMX}, {PATHS} SELECT DISTINCT mx, tid, pos AS tpos FROM bxmx JOIN paths ON elem = bx")
def positional_index_by_bare_names(spark, sf_dir):
    """Every supplier stands in its path under its own name, or with one or two numbers behind it, by its place."""
    name = F.col("elem").cast("string")
    more = F.when(F.col("pos") % 3 == 0, name).when(F.col("pos") % 3 == 1, F.concat(name, F.lit("_7"))).otherwise(F.concat(name, F.lit("_7_0")))
    return mapping.positional_index(nation_paths(spark, sf_dir).withColumn("elem", more), supplied(spark, sf_dir))


@query(f"""WITH {BED}, top AS (SELECT qname FROM bed GROUP BY qname ORDER BY count(*) DESC, qname LIMIT 7)
    SELECT tname, tstart, tend, CASE WHEN qname IN (SELECT qname FROM top) THEN CAST(qname AS VARCHAR) ELSE 'Other' END AS qname, score, orientation FROM bed""")
def lumped_names(spark, sf_dir):
    return reports.lumped(stored(bed(spark, sf_dir), "bed"), "qname", 7)


@query(f"""WITH {BED}, w AS (SELECT qname, sum(score) AS w FROM bed GROUP BY qname), top AS (SELECT qname FROM w ORDER BY w DESC, qname LIMIT 26)
    SELECT tname, tstart, tend, CASE WHEN qname IN (SELECT qname FROM top) THEN CAST(qname AS VARCHAR) ELSE 'Other' END AS qname, score, orientation FROM bed""")
def lumped_names_by_score(spark, sf_dir):
    return reports.lumped(stored(bed(spark, sf_dir), "bed"), "qname", 26, F.col("score"))


@query(f"""WITH {PATHS}, r AS (SELECT n_name AS tname, s_suppkey AS tstart, s_suppkey + 1 AS tend, s_suppkey AS qname, CAST(round(s_acctbal) AS BIGINT) AS score, '.' AS orientation FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal < 5000),
    b AS (SELECT tid, pos, r.* FROM paths JOIN r ON qname = elem), t AS (SELECT tid, row_number() OVER (ORDER BY tid) AS n FROM (SELECT DISTINCT tid FROM b WHERE tid <> 0)),
    a AS (SELECT b.*, coalesce(n, 0) AS boundary FROM b LEFT JOIN t USING (tid) UNION ALL SELECT tid, -1, NULL, NULL, NULL, NULL, NULL, NULL, n FROM t),
    f AS (SELECT tname, min(tid * 1000000 + pos) AS o FROM a GROUP BY tname), i AS (SELECT tname, row_number() OVER (ORDER BY o) AS "index" FROM f)
    SELECT a.*, "index" FROM a JOIN i ON i.tname IS NOT DISTINCT FROM a.tname""")
def contig_boundaries(spark, sf_dir):
    from .format_queries import suppliers_as_bed

    rows = reports.with_boundaries(scaffold.filter_bed(nation_paths(spark, sf_dir), suppliers_as_bed(spark, sf_dir)))
    return reports.appearance_index(stored(rows, "boundaries"), "tname", [F.col("tid"), F.col("pos")])


@query(f"""WITH {WHISKERS}, f AS (SELECT qname, row_number() OVER (ORDER BY max(qlength) DESC, qname) AS i FROM paf GROUP BY qname)
    SELECT paf.qname, qstart, tname, tstart, CAST((i + row_number() OVER (PARTITION BY paf.qname ORDER BY qstart, tname, tstart)) % 2 AS INTEGER) AS colour FROM paf JOIN f ON f.qname = paf.qname""")
def alternating_colours(spark, sf_dir):
    rows = reports.appearance_index(stored(paf(spark, sf_dir), "paf"), "qname", [-F.col("qlength"), F.col("qname")])
    return reports.alternating(rows, "qname", F.col("index"), F.col("qstart"), F.col("tname"), F.col("tstart")).select("qname", "qstart", "tname", "tstart", "colour")


@query(f"""WITH {SEQUENCES}, c AS (SELECT name, i, substr(seq, i, 1) AS c FROM (SELECT name, seq, unnest(generate_series(1, length(seq))) AS i FROM seqs)),
    r AS (SELECT name, i, i - row_number() OVER (PARTITION BY name ORDER BY i) AS k FROM c WHERE c = 'N'), g AS (SELECT name, min(i) - 1 AS s, max(i) AS e, count(*) AS n FROM r GROUP BY name, k),
    x AS (SELECT CAST(s_suppkey AS VARCHAR) AS name, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS "index" FROM supplier)
    SELECT name, CAST(s AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end", n AS length, "index" FROM g JOIN x USING (name)""")
def gaps_with_index(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("name"), "s_acctbal", "s_suppkey")
    index = reports.appearance_index(suppliers, "name", [-F.col("s_acctbal"), F.col("s_suppkey")])
    return scaffold.with_index(scaffold.gaps(sequences(spark, sf_dir)), index)


@query(f"""WITH {BXMX}, x AS (SELECT count(*) AS f FROM bxmx GROUP BY mx), h AS (SELECT f, count(*) AS n FROM x GROUP BY f),
    i AS (SELECT f, n, row_number() OVER (ORDER BY f) AS i, n > lag(n) OVER (ORDER BY f) AS rises FROM h), low AS (SELECT coalesce(min(CASE WHEN rises THEN i END) - 1, 1) AS low FROM i),
    m AS (SELECT i AS mode FROM i, low WHERE i >= low ORDER BY n DESC, f LIMIT 1) SELECT 3 * mode AS threshold FROM m""")
def repeat_threshold(spark, sf_dir):
    depth = supplied(spark, sf_dir).groupBy("mx").agg(F.count("*").alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    return scaffold.repeat_threshold(depth)


@query(f"WITH RECURSIVE {ORIENTED} SELECT tid, string_agg({PIECE}, repeat('N', 10) ORDER BY pos) AS seq, count(*) AS n FROM oriented JOIN seqs USING (name) GROUP BY tid")
def assemble_with_evidence(spark, sf_dir):
    return scaffold.assemble_with_evidence(signed_paths(spark, sf_dir), sequences(spark, sf_dir), _named_evidence(spark, sf_dir), 10)

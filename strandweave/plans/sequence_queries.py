"""Queries with sequence functions, sketches and a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandweave.functions import scalar as fn
from strandweave.operators import reports, scaffold
from strandweave.streaming.counts import stream_marker_counts

from .inputs import SEQUENCES, sequences, table
from .registry import query
from .shared import numbered


@query(f"WITH {SEQUENCES} SELECT name, reverse(translate(seq, 'ACGTN', 'TGCAN')) AS rc FROM seqs")
def reverse_complement(spark, sf_dir):
    return sequences(spark, sf_dir).select("name", fn.reverse_complement(F.col("seq")).alias("rc"))


@query(f"""WITH {SEQUENCES}, k AS (SELECT name, substr(seq, i, 12) AS kmer, i FROM seqs, (SELECT unnest(generate_series(1, 21)) AS i)), c AS (SELECT name, i, kmer, unnest(generate_series(1, 12)) AS j FROM k WHERE kmer NOT LIKE '%N%')
    SELECT name, CAST(i - 1 AS INTEGER) AS pos, kmer, CAST(sum((position(substr(kmer, j, 1) IN 'ACGT') - 1) * CAST(pow(4, 12 - j) AS BIGINT)) AS BIGINT) AS code FROM c GROUP BY 1, 2, 3""")
def pack_kmers(spark, sf_dir):
    rows = sequences(spark, sf_dir).select("name", F.posexplode(fn.kmers(F.col("seq"), 12)).alias("pos", "kmer")).filter("NOT contains(kmer, 'N')")
    packed = rows.withColumn("code", fn.pack_kmer(F.col("kmer")))
    return packed.select("name", "pos", fn.unpack_kmer(F.col("code"), 12).alias("kmer"), "code")


@query(f"WITH {SEQUENCES}, k AS (SELECT substr(seq, i, 6) AS kmer FROM seqs, (SELECT unnest(generate_series(1, 27)) AS i)) SELECT kmer, count(*) AS n FROM k GROUP BY kmer HAVING count(*) >= 2")
def count_kmers(spark, sf_dir):
    rows = sequences(spark, sf_dir).select(F.explode(fn.kmers(F.col("seq"), 6)).alias("kmer"))
    return rows.groupBy("kmer").agg(F.count("*").alias("n")).filter("n >= 2")


MINIMIZERS = """k AS (SELECT name, i - 1 AS pos, ('0x' || substr(md5(substr(seq, i, 8)), 1, 15))::BIGINT AS h, substr(seq, i, 8) AS kmer FROM seqs, (SELECT unnest(generate_series(1, 25)) AS i)),
    w AS (SELECT a.name, b.pos, b.h{flag}, row_number() OVER (PARTITION BY a.name, a.pos ORDER BY {order}b.h, b.pos DESC) AS r FROM k a JOIN k b ON b.name = a.name AND b.pos BETWEEN a.pos AND a.pos + 4 WHERE a.pos <= 20)"""


@query(f"WITH {SEQUENCES}, {MINIMIZERS.format(flag='', order='')} SELECT DISTINCT name, CAST(pos AS INTEGER) AS pos, h AS mx FROM w WHERE r = 1")
def window_minimizers(spark, sf_dir):
    hashes = F.transform(fn.kmers(F.col("seq"), 8), fn.fixed_md5)
    return sequences(spark, sf_dir).select("name", F.inline(fn.window_minimizers(hashes, 5)))


@query(f"""WITH {SEQUENCES}, reps AS (SELECT substr(seq, i, 8) AS rep FROM seqs, (SELECT unnest(generate_series(1, 25)) AS i) GROUP BY 1 HAVING count(*) >= 2), {MINIMIZERS.format(flag=", b.kmer IN (SELECT rep FROM reps) AS masked", order="b.kmer IN (SELECT rep FROM reps), ")}
    SELECT DISTINCT name, CAST(pos AS INTEGER) AS pos, h AS mx FROM w WHERE r = 1 AND NOT masked""")
def masked_minimizers(spark, sf_dir):
    rows = sequences(spark, sf_dir).select("name", F.posexplode(fn.kmers(F.col("seq"), 8)).alias("i", "kmer"))
    repeats = rows.groupBy("kmer").agg(F.count("*").alias("n")).filter("n >= 2").select("kmer", F.lit(True).alias("masked"))
    hashes = F.when(F.col("masked").isNull(), fn.fixed_md5(F.col("kmer")))
    lists = rows.join(repeats, "kmer", "left").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("i", hashes.alias("h")))).alias("hs"))
    return lists.select("name", F.inline(fn.window_minimizers(F.transform("hs", lambda x: x["h"]), 5)))


#: Two to the 64th, in numbers of 128 bits.
TOP = "CAST(18446744073709551616 AS HUGEINT)"


def mixed(x: str, table_: str, keys: str) -> str:
    """Common table expressions h0 ... h6 over table_(keys, x): hash_long step by step, then `mix`(keys, hash)."""
    shift = lambda i, n: f"h{i + 1} AS (SELECT {keys}, CAST(xor(CAST(h AS UBIGINT), CAST(h AS UBIGINT) >> {n}) AS HUGEINT) AS h FROM h{i})"
    times = lambda i, f: f"h{i + 1} AS (SELECT {keys}, (h * {f}) % {TOP} AS h FROM h{i})"
    first = f"h0 AS (SELECT {keys}, ((CAST({x} AS HUGEINT) + {TOP}) % {TOP} * 2097151 + {TOP} - 1) % {TOP} AS h FROM {table_})"
    steps = [shift(0, 24), times(1, 265), shift(2, 14), times(3, 21), shift(4, 28), times(5, 2147483649)]
    return ", ".join([first, *steps, f"mix AS (SELECT {keys}, CAST(CASE WHEN h >= {TOP} // 2 THEN h - {TOP} ELSE h END AS BIGINT) AS hash FROM h6)"])


@query(f"WITH {mixed('p_partkey', 'part', 'p_partkey')} SELECT p_partkey AS key, hash, p_partkey AS back FROM mix")
def hashed_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), fn.hash_long(F.col("p_partkey")).alias("hash"))
    return rows.select("key", "hash", fn.unhash_long(F.col("hash")).alias("back"))


@query("""WITH c AS (SELECT page_id, i, substr(html, i, 1) AS c FROM (SELECT page_id, html, unnest(generate_series(1, length(html))) AS i FROM pages)),
    r AS (SELECT page_id, i, i - row_number() OVER (PARTITION BY page_id ORDER BY i) AS k FROM c WHERE c = 'e')
    SELECT CAST(page_id AS VARCHAR) AS name, CAST(min(i) - 1 AS BIGINT) AS "start", CAST(max(i) AS BIGINT) AS "end", count(*) AS length FROM r GROUP BY page_id, k HAVING count(*) >= 2""")
def letter_runs(spark, sf_dir):
    return scaffold.gaps(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("name"), F.col("html").alias("seq")), "e", 2)


@query(f"WITH {SEQUENCES}, p AS (SELECT name, list_filter(string_split_regex(seq, '[Nn]+'), lambda x: x <> '') AS l FROM seqs) SELECT name, CAST(i - 1 AS INTEGER) AS part, l[i] AS seq FROM (SELECT name, l, unnest(generate_series(1, len(l))) AS i FROM p)")
def scaftigs(spark, sf_dir):
    return scaffold.scaftigs(sequences(spark, sf_dir))


@query("""WITH n AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN 'chr' || p_size WHEN p_size % 3 = 1 THEN CAST(p_size AS VARCHAR) ELSE 'chr' || p_brand END AS name FROM part), k AS (SELECT name, regexp_replace(name, '^chr', '') AS b FROM n)
    SELECT name, row_number() OVER (ORDER BY try_cast(b AS BIGINT) IS NULL, try_cast(b AS BIGINT), b, name) AS place FROM k""")
def natural_order(spark, sf_dir):
    size = F.col("p_size")
    names = table(spark, sf_dir, "part").select(F.when(size % 3 == 0, F.concat(F.lit("chr"), size.cast("string"))).when(size % 3 == 1, size.cast("string")).otherwise(F.concat(F.lit("chr"), "p_brand")).alias("name")).distinct()
    return numbered(names.select("name"), [*fn.natural_key(F.col("name")), F.col("name")], "place")


@query("SELECT l_orderkey, l_linenumber, greatest(l_partkey - (l_suppkey + 20), l_suppkey - (l_partkey + 10), 0) AS distance, l_partkey <= l_suppkey + 20 AND l_suppkey <= l_partkey + 10 AS overlap FROM lineitem")
def interval_relations(spark, sf_dir):
    a, b = (F.col("l_partkey"), F.col("l_partkey") + 10), (F.col("l_suppkey"), F.col("l_suppkey") + 20)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fn.interval_distance(*a, *b).alias("distance"), fn.overlaps(*a, *b).alias("overlap"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type")
def streamed_counts(spark, sf_dir):
    return stream_marker_counts(spark, sf_dir, ["user_id", "event_type"])


@query("SELECT time_bucket(INTERVAL 6 hours, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_windows(spark, sf_dir):
    return stream_marker_counts(spark, sf_dir, ["event_type"], "6 hours")


PACKED = """k AS (SELECT name, i - 1 AS pos, substr(seq, i, 8) AS kmer FROM seqs, (SELECT unnest(generate_series(1, 25)) AS i)),
    c AS (SELECT name, pos, kmer, unnest(generate_series(1, 8)) AS j FROM k WHERE kmer NOT LIKE '%N%'),
    code AS (SELECT name, pos, kmer, CAST(sum((position(substr(kmer, j, 1) IN 'ACGT') - 1) * CAST(pow(4, 8 - j) AS BIGINT)) AS BIGINT) AS code FROM c GROUP BY 1, 2, 3)"""


@query(f"WITH {SEQUENCES}, {PACKED}, {mixed('code', 'code', 'name, pos, kmer')} SELECT name, CAST(pos AS INTEGER) AS pos, kmer, hash, kmer AS back FROM mix")
def hashed_kmers(spark, sf_dir):
    rows = sequences(spark, sf_dir).select("name", F.posexplode(fn.kmers(F.col("seq"), 8)).alias("pos", "kmer")).filter("NOT contains(kmer, 'N')")
    rows = rows.withColumn("hash", fn.hash_kmer(F.col("kmer")))
    return rows.withColumn("back", fn.unhash_kmer(F.col("hash"), 8))


@query(f"""WITH {SEQUENCES}, k AS (SELECT name, i - 1 AS pos, substr(seq, i, 8) AS kmer FROM seqs, (SELECT unnest(generate_series(1, 25)) AS i)),
    h AS (SELECT name, pos, ('0x' || substr(md5(kmer), 1, 15))::BIGINT AS o, ('0x' || substr(md5(reverse(kmer)), 1, 15))::BIGINT AS e FROM k),
    w AS (SELECT a.name, b.pos, b.e, row_number() OVER (PARTITION BY a.name, a.pos ORDER BY b.o, b.pos DESC) AS r FROM h a JOIN h b ON b.name = a.name AND b.pos BETWEEN a.pos AND a.pos + 4 WHERE a.pos <= 20)
    SELECT DISTINCT name, CAST(pos AS INTEGER) AS pos, e AS mx FROM w WHERE r = 1""")
def two_hash_minimizers(spark, sf_dir):
    """One hash of a k-mer orders a window, another is given out."""
    found = fn.ordered_minimizers(fn.kmers(F.col("seq"), 8), 5, fn.fixed_md5, lambda k: fn.fixed_md5(F.reverse(k)))
    return sequences(spark, sf_dir).select("name", F.inline(found))


@query(f"WITH {SEQUENCES} SELECT CAST(sum(length(seq)) AS BIGINT) AS bases FROM seqs")
def genome_size(spark, sf_dir):
    return scaffold.genome_size(sequences(spark, sf_dir))


@query("""SELECT event_type AS step, sum(60 * extract(hour FROM ts) + extract(minute FROM ts) + extract(second FROM ts) / 60.0::DOUBLE) AS minutes, max(value) AS most FROM events GROUP BY event_type""")
def run_totals(spark, sf_dir):
    steps = table(spark, sf_dir, "events").select(F.col("event_type").alias("step"), F.date_format("ts", "H:m:s").alias("elapsed"), F.col("value").alias("memory"))
    return reports.run_totals(steps)

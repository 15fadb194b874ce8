"""The subpackage's queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import encode_digests
from .common import table
from .hpyp import score_texts
from .langid import language_predictions
from .merkle import verify_altered
from .mixing import mix_sources
from .multiindex import nearest
from .neardup import near_duplicates
from .pieces import piece_digests
from .resample import resample
from .sharding import shard_by_bytes
from .tokenfile import write_and_read
from .topk import integer_neighbours
from .warc import archive_and_index


def op1_hpyp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integer_neighbours(table(spark, sf_dir, "embeddings"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_index(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_multiindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_predictions(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify_altered(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hpyp": op1_hpyp,
    "op2_sharding": op2_sharding,
    "op3_mixing": op3_mixing,
    "op4_topk": op4_topk,
    "op5_langid": op5_langid,
    "op6_warc": op6_warc,
    "op7_multiindex": op7_multiindex,
    "op8_bpe": op8_bpe,
    "op9_token_output": op9_token_output,
    "op10_neardup": op10_neardup,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_merkle": op12_merkle,
    "op13_resampling": op13_resampling,
}

#: The checksum of a list of bytes by DuckDB: each byte is taken in with its first of eight shifts.
_CRC32 = """xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform({bytes}, lambda b: [CAST(b AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
                lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))))"""
_BYTES = "list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"


def _crc32(text: str) -> str:
    return _CRC32.format(bytes=_BYTES.format(text=text))


def _tree(name: str, leaves: str) -> str:
    """The levels of trees of 16 over `leaves` (tree, place, n, digest), each node's siblings left and right, by level k."""
    return f"""{name}(k, tree, place, n, digest) AS (
            SELECT 0, tree, place, n, digest FROM {leaves} UNION ALL
            SELECT k + 1, tree, place // 16, CAST(ceil(n / 16) AS BIGINT), sha256(string_agg(digest, '' ORDER BY place)) FROM {name} WHERE n > 1 GROUP BY k, tree, place // 16, n
        ), {name}_around AS (
            SELECT a.k, a.tree, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
            FROM {name} a JOIN {name} b ON a.k = b.k AND a.tree = b.tree AND a.place // 16 = b.place // 16 WHERE a.n > 1 GROUP BY 1, 2, 3
        )"""


def _walk(name: str, tree: str, start: str) -> str:
    """From each row of `start` (row, tree, place, digest, proof) upwards to the root of its tree."""
    return f"""{name}(k, row, tree, place, digest, proof) AS (
            SELECT 0, * FROM ({start}) UNION ALL
            SELECT w.k + 1, w.row, w.tree, w.place // 16, sha256(a.l || w.digest || a.r), w.proof || a.l || a.r FROM {name} w JOIN {tree}_around a ON a.k = w.k AND a.tree = w.tree AND a.place = w.place
        ), {name}_end AS (SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY row ORDER BY k DESC) = 1)"""


def _leaf(text: str) -> str:
    part = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    return "sha256(" + " || ".join(map(part, ("doc_id", "source", "lang", "n_chars", text))) + ")"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op2_sharding": f"""
        WITH s AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, CAST({_crc32("coalesce(text, '')")} AS BIGINT) AS text_crc32 FROM documents),
        p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total,
                     row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) AS row FROM s),
        c AS (SELECT *, CAST(least(floor((2 * before + size) * 24 / (2.0::DOUBLE * total)), 23) AS INTEGER) AS shard FROM p)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row - min(row) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM c
    """,
    "op4_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score
        FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
    """,
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        f AS (SELECT page_id, h, CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
               CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM f
    """,
    "op10_neardup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
            FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS (
            SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)
        ), e AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
        reach(id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, e.v FROM reach r JOIN e ON e.u = r.other),
        comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM d JOIN comp ON comp.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
    """,
    "op12_merkle": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN {_crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % 5 = 0 THEN {_leaf(_LOWER.format("text"))} END AS altered FROM documents
        ), leaves AS (
            SELECT *, row_number() OVER () AS row, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n,
                   row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
            FROM d
        ), low_leaves AS (SELECT tree, place, n, leaf AS digest FROM leaves), {_tree("low", "low_leaves")},
        subroots AS (SELECT tree, digest FROM low WHERE n = 1),
        high_leaves AS (SELECT 0 AS tree, tree AS place, (SELECT count(*) FROM subroots) AS n, digest FROM subroots), {_tree("high", "high_leaves")},
        {_walk("first", "low", "SELECT row, tree, place, coalesce(altered, leaf), '' FROM leaves")},
        {_walk("second", "high", "SELECT row, 0, tree, digest, proof FROM first_end")}
        SELECT doc_id, leaf, s.digest AS subroot, root.digest AS root, sha256(e.proof) AS proof_sha256, e.digest AS folded_root, e.digest = root.digest AS verified
        FROM leaves l JOIN second_end e ON e.row = l.row JOIN subroots s ON s.tree = l.tree, (SELECT digest FROM high WHERE n = 1) root
    """,
    "op13_resampling": rf"""
        WITH t AS (
            SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
        ), w AS (
            SELECT side, id, row_number() OVER () AS row, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t
        ), f AS (
            SELECT side, row, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT side, row, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (VALUES (1), (2), (3)) ks(k))
        ), b AS (
            SELECT g, {_crc32("g")} % 10000 AS bucket FROM (SELECT DISTINCT g FROM f)
        ), n AS (
            SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f JOIN b USING (g) GROUP BY bucket
        ), gain AS (
            SELECT bucket, CAST(floor(1000 * ln((t + 1) * CAST(sum(s) OVER () + 10000 AS DOUBLE) / ((s + 1) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM n
        ), of AS (
            SELECT row, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN b USING (g) JOIN gain USING (bucket) WHERE side = 0 GROUP BY row
        ), scored AS (
            SELECT w.id AS doc_id, len(w.w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(w.id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
            FROM w LEFT JOIN of ON of.row = w.row WHERE side = 0
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (words >= 20) OVER () AS able FROM scored
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 5 * able // 100 THEN place END AS "rank" FROM placed
    """,
}

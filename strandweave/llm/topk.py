"""Exact top-k by distributed histogram selection: refine global score histograms, then filter and break ties."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import new_path, stored

#: Queries are taken in blocks of at most this many bytes of vectors, and of a task's work arrays (a query's bins and its
#: scores of a chunk of rows, three of each), so that what is broadcast and what a task holds have fixed bounds.
BLOCK_BYTES, WORK_BYTES = 8 << 20, 64 << 20
#: Bins a pass: an interval of integer scores shrinks by this factor each time.
BINS = 1024
#: Rows scored at once in a task.
CHUNK = 2048


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v): floor(scale * x) of each component as long; rows with a null id, a null vector, or null or non-finite components go."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & finite)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(scale * c.cast("double")).cast("long")).alias("v"))


def _dense(batch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """ids and matrix for each vector length in the batch; vectors of different lengths are never compared."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = {}
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        out[int(n)] = ids[rows], flat[(offsets[rows][:, None] + np.arange(n)).ravel()].reshape(len(rows), n)
    return out


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products: by floating matrix product where every partial sum is exact in a double, else in integers."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    if bound < 2**52:
        return (queries.astype(float) @ rows.T.astype(float)).astype(np.int64)
    return queries @ rows.T


def _chunks(batches, block):
    """(query rows, query ids, candidate ids, scores; own pairs masked) for each chunk of candidates."""
    for batch in batches:
        for n, (ids, rows) in _dense(batch).items():
            if n not in block:
                continue
            at, query_ids, queries = block[n]
            for i in range(0, len(ids), CHUNK):
                yield at, query_ids, ids[i : i + CHUNK], _scores(queries, rows[i : i + CHUNK]), query_ids[:, None] == ids[None, i : i + CHUNK]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Each query's k highest integer inner products among all vectors of other ids, ties to the smaller id.

    Both tables have (id long, v array<long>). For each block of queries, every pass scores all candidates and returns,
    for each query and task, the counts of its highest bins down to k scores (a lower bin cannot hold the global kth);
    their sum locates the kth score's bin, which the next pass divides, until it holds one value. The last pass keeps
    scores above it, and of those equal to it each task's k smallest ids; at most 2k rows a query and task meet.
    Returns query_id, rank (from 1), vec_id, score. Queries with fewer candidates get all. Repeated ids are rows of
    their own as candidates (rows with the query's id never count), and a repeated query is answered once; vectors of
    another length are no candidates; an empty table gives no rows. Each block's answers are written before the next
    block starts, so the plan does not grow with the blocks.
    """
    spark = vectors.sparkSession
    asked = queries.dropDuplicates(["id"]) if queries is not vectors else queries
    width = asked.agg(F.max(F.size("v"))).first()[0] or 0
    per_block = max(1, min(BLOCK_BYTES // (8 * max(width, 1)), WORK_BYTES // (24 * (BINS + CHUNK))))
    blocks = max(1, -(-asked.count() // per_block))
    if blocks == 1:
        return _top_k_block(spark, vectors, asked.collect(), k)
    path = new_path(spark, "top-k")
    for b in range(blocks):  # a block's vectors are bounded by BLOCK_BYTES, hash imbalance aside
        mine = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        _top_k_block(spark, vectors, mine.collect(), k).write.mode("append").parquet(path)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)


def _top_k_block(spark, vectors: DataFrame, asked: list, k: int) -> DataFrame:
    asked = sorted(asked, key=lambda r: r["id"])
    by_size: dict[int, list[int]] = {}
    for i, row in enumerate(asked):
        by_size.setdefault(len(row["v"]), []).append(i)
    ids = np.array([r["id"] for r in asked], np.int64)
    block = spark.sparkContext.broadcast({n: (np.array(at), ids[at], np.array([asked[i]["v"] for i in at], np.int64).reshape(len(at), n)) for n, at in by_size.items()})
    total = len(asked)

    def extent(batches):
        """Least and greatest score and the number of candidates, for each query."""
        low, high, count = np.full(total, 2**62), np.full(total, -(2**62)), np.zeros(total, np.int64)
        for at, _, _, scores, own in _chunks(batches, block.value):
            low[at] = np.minimum(low[at], np.where(own, 2**62, scores).min(1))
            high[at] = np.maximum(high[at], np.where(own, -(2**62), scores).max(1))
            count[at] += (~own).sum(1)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, low[some], high[some], count[some])], names=["q", "low", "high", "n"])

    found = vectors.mapInArrow(extent, "q long, low long, high long, n long").groupBy("q").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect()
    low, high, wanted = np.zeros(total, np.int64), np.full(total, -1, np.int64), np.zeros(total, np.int64)
    for r in found:
        low[r["q"]], high[r["q"]], wanted[r["q"]] = r["low"], r["high"], min(k, r["n"])
    # The wanted-th highest score is in [low, high]; `above` scores are known to be over high.
    above = np.zeros(total, np.int64)
    while (high > low).any():
        step = np.maximum(1, -(-(high - low + 1) // BINS))
        state = spark.sparkContext.broadcast((low, high, step, wanted - above))

        def histogram(batches, state=state):
            low, high, step, need = state.value
            bins = np.zeros((total, BINS), np.int64)
            for at, _, _, scores, own in _chunks(batches, block.value):
                inside = ~own & (scores >= low[at, None]) & (scores <= high[at, None])
                q, c = np.nonzero(inside)
                np.add.at(bins, (at[q], (scores[q, c] - low[at[q]]) // step[at[q]]), 1)
            down = np.cumsum(bins[:, ::-1], 1)[:, ::-1]  # scores in this bin or a higher one
            q, bin_ = np.nonzero((bins > 0) & (down - bins < need[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q, bin_, bins[q, bin_])], names=["q", "bin", "n"])

        summed = vectors.mapInArrow(histogram, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        order = W.Window.partitionBy("q").orderBy(F.desc("bin"))
        need = spark.createDataFrame([(int(q), int(x)) for q, x in enumerate(wanted - above) if x > 0], "q long, need long")
        reach = summed.withColumn("over", F.sum("n").over(order) - F.col("n")).join(F.broadcast(need), "q")
        kth = reach.filter((F.col("over") < F.col("need")) & (F.col("over") + F.col("n") >= F.col("need"))).select("q", "bin", "over").collect()
        low, high, above = low.copy(), high.copy(), above.copy()
        for q, bin_, over in kth:
            start = low[q] + bin_ * step[q]
            low[q], high[q], above[q] = start, min(high[q], start + step[q] - 1), above[q] + over
        state.unpersist()

    def select(batches):
        kept: list[list[tuple[int, int, int]]] = [[] for _ in range(total)]  # (-score, id, score)
        for at, _, cand, scores, own in _chunks(batches, block.value):
            q, c = np.nonzero(~own & (scores >= low[at, None]) & (wanted[at, None] > 0))
            for i, j in zip(q.tolist(), c.tolist()):
                row = kept[at[i]]
                row.append((-int(scores[i, j]), int(cand[j])))
                if len(row) > 8 * k:
                    row.sort()
                    del row[k:]
        rows = [(q, ident, -score) for q, row in enumerate(kept) for score, ident in sorted(row)[:k]]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([int(ids[q]) for q in columns[0]], columns[1], columns[2])], names=["query_id", "vec_id", "score"])

    rank = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    rows = vectors.mapInArrow(select, "query_id long, vec_id long, score long").withColumn("rank", rank)
    return rows.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_neighbours(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """top_k over the quantised vectors, with the rows whose id is divisible by `every` as queries: query_id, rank, vec_id, score.

    Rows with a null id, and vectors null or holding null or non-finite components, take no part; an empty vector is
    compared with empty vectors; other columns are ignored. Repeated rows, ties and empty tables are as in top_k. The
    quantised vectors are stored, since several passes read them.
    """
    rows = stored(quantised(vectors, id_col, vector_col), "quantised")
    return top_k(rows, rows.filter(F.col("id") % every == 0), k)

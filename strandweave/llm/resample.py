"""Importance resampling: documents are drawn by how much more often a target corpus has their word n-grams."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import running, stored

#: What becomes of each byte: A-Z are lower-cased, digits, a-z and all bytes beyond ASCII stay, the others separate words.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Bytes of a text whose words are held at once.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Features:
    """Runs of 1 to `longest` consecutive words, hashed into `buckets`."""

    longest: int = 3
    buckets: int = 10_000

    def of(self, text: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """For each block of the text the number of its words, and the buckets of all runs that end in it.

        A run's checksum is its last word's, started from the checksum of the run before that word.
        """
        blanked, at, before = text.translate(TABLE), 0, []
        while at < len(blanked):
            end = blanked.find(b" ", at + BLOCK)
            end = len(blanked) if end < 0 else end
            fresh = blanked[at:end].split()
            words, at = before + fresh, end
            heads, tails, found = [0] * len(words), words, []
            for n in range(self.longest):
                heads = list(map(crc32, tails, heads))
                found += heads[max(0, len(before) - n) :]
                tails = [b" " + w for w in words[n + 1 :]] if n == 0 else tails[1:]
            before = words[len(words) - self.longest + 1 :] if len(words) >= self.longest else words
            yield len(fresh), np.array(found, np.int64) % self.buckets


def feature_counts(docs: DataFrame, features: Features = Features(), text_col: str = "text") -> DataFrame:
    """How often each bucket occurs in all texts: bucket, n. A task adds up its own texts, so it sends a row a bucket.

    Null and empty texts and texts without words have no features; an empty table gives no rows.
    """

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                for _, buckets in features.of((text.as_py() or "").encode()):
                    total.update(buckets.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["bucket", "n"])

    return docs.select(text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, features: Features = Features(), text_col: str = "text") -> np.ndarray:
    """For each bucket floor(1000 ln(target's share / documents' share)), shares smoothed by one in every bucket.

    The two histograms have a row a bucket (`features.buckets`, whatever the input), and are compared on the driver.
    """
    counts = feature_counts(docs, features, text_col).withColumn("side", F.lit(0)).unionByName(feature_counts(target, features, text_col).withColumn("side", F.lit(1)))
    sides = np.zeros((2, features.buckets), np.int64)
    for row in counts.collect():
        sides[row.side, row.bucket] = row.n
    (s, t), size = sides.tolist(), float(features.buckets)
    all_s, all_t = float(sum(s)), float(sum(t))
    return np.array([math.floor(1000 * math.log((b + 1.0) * (all_s + size) / ((a + 1.0) * (all_t + size)))) for a, b in zip(s, t)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, features: Features = Features(), id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """Adds n_words, n_features, weight (the sum of its features' gains) and score (weight plus seeded Gumbel noise, in
    thousandths), in place of columns so named. A null id is noise of the empty text; no words: no features, weight 0."""
    names = ("n_words", "n_features", "weight", "score")
    kept = docs.drop(*names)
    out = T.StructType([*kept.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a long a bucket

    def noise(key) -> int:
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))

    def run(batches):
        value = shared.value
        for batch in batches:
            made = []
            for key, text in zip(batch.column(batch.schema.get_field_index(id_col)), batch.column(batch.schema.get_field_index(text_col))):
                words = n = weight = 0
                for fresh, buckets in features.of((text.as_py() or "").encode()):
                    words, n, weight = words + fresh, n + len(buckets), weight + int(value[buckets].sum())
                made.append((words, n, weight, weight + noise(key.as_py())))
            columns = zip(*made) if made else [()] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in columns)], names=out.names)

    return kept.mapInArrow(run, out)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, features: Features = Features(), id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """Draws `percent` percent (rounded down) of the documents of at least `least_words` words, without replacement,
    in proportion to exp(weight / 1000): those of the highest scores. Returns id, n_features, weight, score, rank.

    rank counts from 1 in order of score, ties to the smaller id (nulls last), repeated rows in any order; it is null for
    rows that are not drawn. Nulls count as empty texts; texts of any length count whole; an empty table gives no rows, an
    empty target weighs by the documents alone. Other columns are ignored. Texts are read twice and never shuffled;
    scores are sorted over all tasks, and the documents' place comes from a count a task.
    """
    weighed = weigh(docs.select(F.col(id_col), F.col(text_col)), gains(docs, target, features, text_col), features, id_col, text_col, seed)
    rows = stored(weighed.drop(text_col).withColumn("_row", F.monotonically_increasing_id()).withColumn("_one", F.lit(1).cast("long")), "weighed")
    able = rows.filter(F.col("n_words") >= least_words)
    draw = percent * able.count() // 100
    placed = running(able, [F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("_row")], {"_place": "_one"})
    placed = placed.withColumn("rank", F.when(F.col("_place") < draw, F.col("_place") + 1))
    rest = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.drop("_place").unionByName(rest).select(id_col, "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn documents with all their columns, and weight, score and rank. Ids must be unique and not null."""
    ranks = resample(docs, target, id_col=id_col, **options).filter("rank IS NOT NULL").drop("n_features")
    return docs.drop("weight", "score", "rank").join(ranks, id_col)

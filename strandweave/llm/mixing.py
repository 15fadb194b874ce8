"""Mixing sources to target weights by exact subset-sum budget fitting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import WORD, running, stored

#: Seeded order is cut into this many runs of hash values per (source, length); only one run of each is ever ranked.
RUNS = 4096
#: Tokens that whole documents leave for the exact knapsack, which so has the choice between many fills.
WIDTH = 1 << 16
#: Where there are few lengths the knapsack is wider: this many tokens by the number of lengths.
FEW = 1 << 24


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, width: int = WIDTH) -> np.ndarray:
    """How many documents of each length to take so that the lengths add up to `budget` as nearly as possible from below.

    First each length gets its proportional share (so the mix keeps the source's length profile), then whole documents,
    longest first, until about `width` remains, or no more than that and the longest document left; then a bounded
    knapsack finds the best fill of the rest, however long the documents are.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros_like(counts)
    take = np.array([int(n) * budget // total for n in counts], np.int64)
    take = np.minimum(take, counts)
    rest = budget - int((lengths * take).sum())
    width = max(width, FEW // len(lengths))
    for i in np.argsort(-lengths):
        if rest < width:
            break
        if lengths[i]:
            more = min(int(counts[i] - take[i]), max(0, (rest - width // 2) // int(lengths[i])))
            take[i] += more
            rest -= more * int(lengths[i])
    rest = min(rest, int((lengths * (counts - take)).sum()))
    if rest <= 0:
        return take
    cap = rest
    reached, via, parts = np.zeros(cap + 1, bool), np.full(cap + 1, -1, np.int32), []
    reached[0] = True
    for i in np.argsort(-lengths):
        left, size = int(counts[i] - take[i]), int(lengths[i])
        if not size or size > cap:
            continue
        left, chunk = min(left, cap // size), 1
        while left > 0 and not reached[cap]:
            n = min(chunk, left)
            fresh = np.flatnonzero(reached[: cap + 1 - n * size])
            fresh = fresh[~reached[fresh + n * size]] + n * size
            reached[fresh], via[fresh] = True, len(parts)
            parts.append((i, n, n * size))
            left, chunk = left - n, chunk * 2
        if reached[cap]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, n, size = parts[via[at]]
        take[i] += n
        at -= size
    return take


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(key, source_size) -> also target: shares of the total by repeating weights in key order, none above `most` sizes.

    What a full source cannot take is shared again by weight among the rest; each round is one small aggregate.
    """
    ranked = running(sources.withColumn("one", F.lit(1).cast("long")), [F.col("key")], {"rank": "one"})
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.select("key", "source_size", weight.alias("weight"), (most * F.col("source_size")).cast("double").alias("top"))
    total, weights_sum = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level, before = (total or 0) / (weights_sum or 1.0), 0
    while True:
        over = F.col("weight") * level >= F.col("top")
        n, tops, free = ranked.agg(F.count_if(over), F.sum(F.when(over, F.col("top"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == before or not free:
            break
        before, level = n, (total - tops) / free
    return ranked.select("key", "source_size", F.least(F.col("weight") * level, F.col("top")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of each document the mix takes so that each source's words meet its target.

    A source whose target is above its size repeats all its documents; the rest of the target is a subset sum over the
    histogram of exact lengths (fit_budget, one small histogram a source), and of each length the first documents in
    seeded hash order are taken. Only one hash run per (source, length) is ranked, so a hot length never meets in a task.
    Returns id, size, source_size, target, taken. Null text has size 0, null source is one source that comes last, null
    ids take part by size (they are dealt over the runs, so many of them don't meet either); repeated rows are documents
    of their own; a very long text counts whole; empty tables give no rows; other columns are ignored. Reruns agree:
    order is a hash of seed, id and size, and rows equal in all three, or without an id, are interchangeable.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    key = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), size.alias("size"))
    # Rows without an id are interchangeable, so their order may be any: they are dealt over the runs.
    name = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null "), F.monotonically_increasing_id().cast("string")))
    rows = stored(rows.withColumn("order", F.xxhash64(F.lit(seed), name, F.col("size"))), "mix")
    rows = rows.withColumn("run", F.shiftrightunsigned("order", 64 - RUNS.bit_length() + 1).cast("int"))
    runs = rows.groupBy("key", "size", "run").agg(F.count("*").alias("n"))
    sizes = stored(runs.groupBy("key", "size").agg(F.sum("n").alias("n")), "mix-sizes")
    targets = stored(source_targets(sizes.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))), "mix-targets")

    fields = "key string, size long, source_size long, target double, repeats int, extra long"

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        total, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        words = int(round(target))
        repeats = min(most, words // total) if total else 0
        extra = fit_budget(group["size"].to_numpy(), group["n"].to_numpy(), words - repeats * total if repeats < most else 0)
        return group[["key", "size", "source_size", "target"]].assign(repeats=repeats, extra=extra)

    plan = sizes.join(targets, "key").groupBy("key").applyInPandas(fit, fields)
    before = F.coalesce(F.sum("n").over(W.Window.partitionBy("key", "size").orderBy("run").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    quota = F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.col("before")))
    runs = runs.withColumn("before", before).join(plan, ["key", "size"]).withColumn("quota", quota)
    held = rows.join(runs.select("key", "size", "run", "n", "source_size", "target", "repeats", "quota"), ["key", "size", "run"])
    whole = held.withColumn("one", F.when(F.col("quota") == F.col("n"), 1).otherwise(0)).filter((F.col("quota") == F.col("n")) | (F.col("quota") == 0))
    rank = F.row_number().over(W.Window.partitionBy("key", "size", "run").orderBy("order", "id"))
    partly = held.filter((F.col("quota") > 0) & (F.col("quota") < F.col("n"))).withColumn("one", (rank <= F.col("quota")).cast("int"))
    return whole.unionByName(partly).select(
        F.col("id").alias(id_col), "size", "source_size", "target", ((F.col("repeats") + F.col("one")) * F.col("size")).cast("long").alias("taken")
    )

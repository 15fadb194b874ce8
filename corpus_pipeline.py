"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and its result, written and read again, is the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from strandweave.llm.bpe import encode_digests
from strandweave.llm.common import crc_of_id, flagged, stored, table
from strandweave.llm.langid import fit_languages, identify
from strandweave.llm.mixing import mix_sources
from strandweave.llm.neardup import Plan, near_duplicates

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document is rejected when no language is found or the posterior of the best is below this.
LEAST_POSTERIOR = 0.5
#: Near copies of the stage are pairs of similarity 0.80 or more (op10's own contract is 0.85). Such a pair shares none of
#: 30 bands of 4 once in five million times; the floor lies six standard deviations of 120 samples below 0.80.
NEAR = Plan(percent=80, bands=30, rows=4, sketch_floor=0.57)


def _row_key() -> Column:
    """Tells rows apart: the id and a hash of the whole row. Rows equal in all columns share it."""
    return F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64(*COLUMNS).cast("string"))


def _first_of(key: str) -> Column:
    return F.row_number().over(W.Window.partitionBy(key).orderBy(F.xxhash64(*COLUMNS))) == 1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; texts that are null, empty or hold no letter are rejected.

    Learns outside fold 2 of crc32(doc_id) mod 4, as op5 does; a null id counts as the empty text there, and rows with a
    null text or language teach nothing. Texts of any length are judged whole; repeated rows are judged alike and all kept
    or all rejected; ties between languages are one recognised language of a low posterior; an empty table, or one
    without a labelled row, gives no rows; other columns are left out.
    """
    model = fit_languages(docs, crc_of_id("doc_id") % 4 != 2)
    rows = identify(docs.select(*COLUMNS), model, lang_out="_lang", score_out="_score")
    return rows.filter((F.col("_lang") != "und") & (F.col("_score") >= LEAST_POSTERIOR)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component: that with the smallest id, as one row. Rows without an id stay.

    Null and empty texts and such without words are linked with nothing and stay; texts of any length are compared
    whole; of rows that share an id one stays, the first by a hash of the row; an empty table gives no rows; other
    columns are left out.
    """
    marks = stored(near_duplicates(docs, NEAR).filter("doc_id IS NOT NULL"), "marks")
    # Only documents that may go, or have their id twice, are moved; the others stay where they are read.
    care = stored(marks.groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n")).filter("n > 1 OR NOT kept").select("doc_id", "kept"), "care")
    rows = flagged(docs.select(*COLUMNS), "doc_id", care)
    checked = rows.filter("_flag").drop("_flag").join(care, "doc_id", "left").filter(F.coalesce("kept", F.lit(True)))
    once = checked.withColumn("_first", _first_of("doc_id")).filter("_first")
    return rows.filter("NOT _flag").select(*COLUMNS).unionByName(once.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it, so that sources meet their targets; documents not taken go.

    A null text has no words and goes, a null source is a source, and a null id is as good as any; rows equal in all
    columns are taken as one document whose copies add up; ties are broken by a seeded hash; very long documents count
    whole; an empty table gives no rows; other columns are left out.
    """
    keyed = docs.select(*COLUMNS, _row_key().alias("_key"))
    taken = mix_sources(keyed, id_col="_key").filter("taken > 0")
    times = taken.groupBy("_key").agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("_times"))
    rows = keyed.join(times, "_key").withColumn("_first", _first_of("_key")).filter("_first")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_sha256 and decoded_sha256 of every row that is left, each text decoded again.

    A null text counts as empty (no tokens); texts of any length are encoded whole; repeated rows are encoded each;
    null ids and sources stay as they are; an empty table gives no rows; other columns are left out.
    """
    rows = docs.select("doc_id", "text", "source")
    return encode_digests(rows, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("mix", mix), ("bpe", bpe)]

#: The stages hold a trained model and a tokenizer, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the whole documents table; every stage's result is stored for the next one. An empty
    table gives no rows; what becomes of nulls, ties, repeated rows and long texts is each stage's to say."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

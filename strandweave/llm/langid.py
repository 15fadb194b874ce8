"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of_id

#: One odd multiplier for each place in an n-gram (fixed values).
MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def batch_grams(texts: list[str], orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n in `orders`, the text and the bucket of every character n-gram of the lower-cased texts: the places of
    a sparse matrix of texts x buckets, a place as often as it counts."""
    lowered = [x.lower() for x in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(texts)), [len(x) for x in lowered])
    for n in orders:
        size = max(0, len(codes) - n + 1)
        h = np.full(size, n, np.uint32)
        for i in range(n):
            h = (h ^ codes[i : size + i]) * MIX[i]
            h ^= h >> np.uint32(15)
        inside = of[:size] == of[n - 1 :]  # no n-gram reaches into the next text
        yield of[:size][inside], ((h * MIX[3]) >> np.uint32(32 - bits))[inside]


def _chunks(texts: list[str], most: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    """The texts in runs of about `most` characters (a longer text is one alone), with the place of each run's first."""
    at, held = 0, 0
    for i, x in enumerate(texts):
        if held and held + len(x) > most:
            yield at, texts[at:i]
            at, held = i, 0
        held += len(x)
    yield at, texts[at:]


@dataclass
class LanguageModel:
    """log P(bucket | language) as a matrix of buckets x languages, and log priors. Its size is fixed by bits and languages."""

    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray
    orders: tuple[int, ...]
    bits: int

    def scores(self, texts: list[str]) -> np.ndarray:
        """log P(language) + log P(text | language): the texts' sparse counts times the matrix, a language at a time."""
        out = np.repeat(self.log_prior[None, :], len(texts), 0)
        for at, some in _chunks(texts):
            for of, buckets in batch_grams(some, self.orders, self.bits):
                for i in range(len(self.languages)):
                    out[at : at + len(some), i] += np.bincount(of, self.by_language[i][buckets], len(some))
        return out

    @cached_property
    def by_language(self) -> list[np.ndarray]:
        return [np.ascontiguousarray(x) for x in self.log_prob.T]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text (ties: the smaller name) and its posterior; "und" and 0 for no text or no letter."""
        asked = [i for i, x in enumerate(texts) if x and self.languages and (x.isalpha() or any(map(str.isalpha, x)))]
        names, sure = ["und"] * len(texts), np.zeros(len(texts))
        if asked:
            scores = self.scores([texts[i] for i in asked])
            best = scores.argmax(1)
            sure[asked] = 1 / np.exp(scores - scores.max(1, keepdims=True)).sum(1)
            for i, j in zip(asked, best.tolist()):
                names[i] = self.languages[j]
        return names, sure


def fit_languages(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", orders: tuple[int, ...] = (1, 2, 3), bits: int = 15, max_docs: int = 60_000, max_languages: int = 512, smooth: float = 0.5) -> LanguageModel:
    """Learns from rows where `learn` holds and text and language are not null.

    At most about `max_docs` rows are learned from: a documented bound; where more are labelled, each row takes part
    with the chance that fits, by a seeded draw of its own, so null and repeated ids and texts are thinned like others. Each task counts its rows into one matrix and
    sends what is not zero; counts are added by language and bucket, so no task holds more than a row a bucket. More than `max_languages` languages raise an error, since the matrix is broadcast. Rows without a letter
    teach nothing; repeated rows count again; no rows give a model that answers "und".
    """
    rows = docs.filter(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    n = rows.count()
    if n > max_docs:
        rows = rows.filter(F.rand(5) < max_docs / n)
    rows = rows.select(F.col(lang_col).cast("string"), text_col)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                if lang not in sums:
                    if len(sums) == max_languages:
                        raise ValueError(f"more than {max_languages} languages")
                    sums[lang], docs_of[lang] = np.zeros(1 << bits, np.int64), 0
                for _, some in _chunks(texts):
                    for _, buckets in batch_grams(some, orders, bits):
                        sums[lang] += np.bincount(buckets, minlength=1 << bits)
                docs_of[lang] += len(texts)
        for lang, total in sums.items():
            found = np.flatnonzero(total)
            buckets, n = np.append(found, 1 << bits), np.append(total[found], docs_of[lang])  # the last bucket counts rows
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(buckets), pa.array(n)], names=["lang", "bucket", "n"])

    def pack(key, group):
        counts = np.zeros((1 << bits) + 1, np.int64)
        counts[group.column("bucket").to_numpy()] = group.column("n").to_numpy()
        return pa.table({"lang": [key[0].as_py()], "n": [int(counts[-1])], "counts": [counts[:-1].tobytes()]})

    parts = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    summed = parts.groupBy("lang").applyInArrow(pack, "lang string, n long, counts binary")  # a row a bucket
    found = sorted(summed.limit(max_languages + 1).collect())
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    counts = np.array([np.frombuffer(r["counts"], np.int64) for r in found], float).reshape(len(found), 1 << bits) + smooth
    priors = np.array([r["n"] for r in found], float)
    return LanguageModel([r["lang"] for r in found], np.log(priors / priors.sum()) if len(found) else priors, np.log(counts / counts.sum(1, keepdims=True)).T.copy(), orders, bits)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Adds the predicted language and its posterior to every row; only the text is looked at, as a whole.

    Null, empty or letterless text is "und" with score 0; ties go to the smaller name; equal texts get equal answers; an
    empty table gives no rows. All columns are kept; one named like an output is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^bits x languages doubles
    kept = docs.drop(lang_out, score_out)
    out = T.StructType([*kept.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])

    def label(batches):
        for batch in batches:
            names, sure = shared.value.predict(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(sure)], names=out.names)

    return kept.mapInArrow(label, out)


def language_predictions(docs: DataFrame, folds: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns outside the held-out fold of crc32(id) and predicts every row: id, held_out, lang_pred, score.

    A null id counts as the empty text in the fold. Rows with a null text or language teach nothing, and all are
    answered: null, empty or letterless text, and any text where nothing was learned, is "und" with score 0. Texts of
    any length count whole; repeated rows teach and are answered each; ties go to the smaller language; an empty table
    gives no rows; other columns are ignored.
    """
    held_out = crc_of_id(id_col) % folds == held
    model = fit_languages(docs, ~held_out, text_col, lang_col)
    rows = docs.select(F.col(id_col), held_out.alias("held_out"), F.col(text_col))
    return identify(rows, model, text_col).drop(text_col)

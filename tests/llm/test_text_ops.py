import hashlib
import math
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandweave.llm import bpe, tokenfile
from strandweave.llm.common import table
from strandweave.llm.langid import fit_languages, identify, language_predictions

from .helpers import SF, clashing, odd_documents

RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tree():
    return bpe.TreeBPE(RANKS, public_tokenizers.PATTERN, leaf=4)


TEXT = st.text(st.one_of(st.sampled_from(list(" \t\n'strevmld.,!?aZ019é漢 ՘\U00011de0")), st.characters(exclude_categories=["Cs"])), max_size=300)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_tree_encodes_as_the_whole(tree, text):
    ids = tree.encode(text)
    assert ids == tree.core.encode_ordinary(text)
    assert tree.decode(ids) == text.encode()


@settings(max_examples=40, deadline=None)
@given(st.text(st.sampled_from(list("ab' ")), min_size=200, max_size=3000))
def test_long_runs(tree, text):
    assert tree.encode(text) == tree.core.encode_ordinary(text)


def test_other_patterns_have_no_firm_places():
    assert bpe.FIRM_PATTERN == public_tokenizers.PATTERN
    other = bpe.TreeBPE(RANKS, r"[a-z]+ [a-z]+|\s|\S", leaf=4)
    for text in ("some words here and there", "ab cd ef gh 12", "x" * 50):
        assert other.encode(text) == other.core.encode_ordinary(text) and other.decode(other.encode(text)) == text.encode()


def test_most_documents_have_more_than_a_leaf(spark, tree):
    texts = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect() if r.text]
    assert sum(len(x) > bpe.LEAF for x in texts) > len(texts) / 4
    usual = bpe.TreeBPE(RANKS, public_tokenizers.PATTERN)
    assert all(usual.encode(x) == usual.core.encode_ordinary(x) for x in texts)


def test_bpe_digests(spark):
    docs = clashing(odd_documents(spark), "n_tokens", "ids", "decoded")
    whole = bpe.TreeBPE(RANKS, public_tokenizers.PATTERN).core
    for frame in (docs, table(spark, SF, "documents")):
        rows = bpe.encode_digests(frame, RANKS, public_tokenizers.PATTERN).collect()
        assert len(rows) == frame.count()
        for r in rows:
            ids = whole.encode_ordinary(r.text or "")
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    back = bpe.decode_ids(bpe.encode_ids(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back.collect())
    assert bpe.encode_digests(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@lru_cache
def untouched():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


@lru_cache
def coder_of_pieces():
    return tokenfile.PieceEncoder(WORDS)


PIECES = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "don't", "x" * 30, "É", "e\u0301", "\u00a0", "\u3000", "İ", "ß", "×", "12", " ", "\t", "'", "''s", "!?", "\x1c", "\x00", "漢"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=200), st.text(st.sampled_from(list("abThésß×÷'’.,!…́0 19-\t漢<|>")), max_size=60), st.lists(st.sampled_from(PIECES), max_size=12).map("".join)), max_size=5))
def test_pieces_encode_alone(texts):
    coder, whole = coder_of_pieces(), untouched()
    coder.forget()
    for _ in range(2):  # from an empty memory, and from one that knows the pieces
        ids, sizes = coder.encode([x.encode() for x in texts])
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])][: len(texts)] == [whole.encode(x, add_special_tokens=False).ids for x in texts]


def test_pieces_of_long_texts_and_full_memories(monkeypatch):
    monkeypatch.setattr(tokenfile, "TOGETHER", 300)
    monkeypatch.setattr(tokenfile, "PIECES", 40)
    coder, whole = tokenfile.PieceEncoder(WORDS), untouched()
    texts = ["".join(f"word{i} and-{i * 7}, l'été {'y' * (i % 40)} " for i in range(n)) for n in (0, 3, 400)] + ["a" * 5000]
    for _ in range(2):
        ids, sizes = coder.encode([x.encode() for x in texts])
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [whole.encode(x, add_special_tokens=False).ids for x in texts]


def test_equal_hashes_do_not_mix_pieces(monkeypatch):
    monkeypatch.setattr(tokenfile.pd, "factorize", lambda h, real=tokenfile.pd.factorize: real(h % np.uint64(3)))
    coder, whole = tokenfile.PieceEncoder(WORDS), untouched()
    for text in ("some words share, a hash. 42", "others too! words again 7"):
        assert coder.encode([text.encode()])[0].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_a_text(spark, tmp_path):
    t = untouched()
    docs = spark.createDataFrame([(1, "see <|endoftext|> here"), (2, "a<|startoftext|>b <|endoftext|><|endoftext|>"), (3, "after")], "doc_id long, text string")
    tokenfile.write_token_file(docs, str(tmp_path / "added"), WORDS, 2)
    rows = sorted(tokenfile.token_digests(tokenfile.read_token_file(spark, str(tmp_path / "added"))).collect())
    at = 0
    for r, d in zip(rows, sorted(docs.collect())):
        ids = t.encode(d.text, add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        at += len(ids)
    assert rows[0].n_tokens == 4 and rows[0].ids_crc32 == 490378056


@pytest.mark.parametrize("dictionary", [True, False])
def test_token_file_layout(spark, tmp_path, dictionary):
    """Row groups of the asked size, page indexes on every column, and dictionary or delta encoding of the ids."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").coalesce(1)
    path = str(tmp_path / "layout")
    tokenfile.write_token_file(docs, path, WORDS, 2, row_group_bytes=64 << 10, page_bytes=8 << 10, dictionary=dictionary)
    groups = 0
    for file in Path(path).glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            assert meta.row_group(g).total_byte_size < 2 << 20
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                assert column.has_offset_index and column.has_column_index
                if column.path_in_schema.startswith("ids"):
                    assert ("RLE_DICTIONARY" in column.encodings) == dictionary and ("DELTA_BINARY_PACKED" in column.encodings) == (not dictionary)
    assert groups > len(list(Path(path).glob("*.parquet")))
    lengths = spark.read.parquet(path).select("n_tokens")
    assert "ReadSchema: struct<n_tokens:bigint>" in lengths._jdf.queryExecution().toString()


@pytest.mark.parametrize("dictionary", [True, False])
def test_token_file(spark, tmp_path, dictionary):
    t = untouched()
    for i, frame in enumerate((table(spark, SF, "documents"), clashing(odd_documents(spark), "part", "start", "ids", "n_tokens"))):
        path = str(tmp_path / f"t{i}")
        tokenfile.write_token_file(frame, path, WORDS, 2, dictionary=dictionary)
        rows = sorted(tokenfile.token_digests(tokenfile.read_token_file(spark, path)).collect(), key=lambda r: r.start)
        ids = sorted(((r.doc_id if r.doc_id is not None else -1, t.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in frame.collect()), key=lambda x: x[0])
        assert [r.doc_id if r.doc_id is not None else -1 for r in rows] == [x[0] for x in ids]
        at = 0
        for r, (_, x) in zip(rows, ids):
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(x), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x)))
            at += len(x)
        few = tokenfile.read_token_file(spark, path, (), F.col("doc_id") == 7)
        assert {r.start for r in few.collect()} == {r.start for r in rows if r.doc_id == 7}
    tokenfile.write_token_file(frame.limit(0), str(tmp_path / "empty"), WORDS, 2)
    assert tokenfile.read_token_file(spark, str(tmp_path / "empty")).count() == 0


def test_langid_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = language_predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97


def plain_bayes(rows, texts, orders, bits, smooth):
    """Brute force: n-grams hashed one by one with Python's own numbers, counts in dicts, logs summed term by term."""

    def grams(text):
        codes = [ord(c) for c in text.lower()]
        for n in orders:
            for i in range(len(codes) - n + 1):
                h = n
                for c, m in zip(codes[i : i + n], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
                    h = (h ^ c) * m % 2**32
                    h ^= h >> 15
                yield h * 0x27D4EB2F % 2**32 >> (32 - bits)

    counts, docs = defaultdict(Counter), Counter()
    for text, lang in rows:
        counts[lang].update(grams(text))
        docs[lang] += 1
    total = {lang: sum(c.values()) + smooth * 2**bits for lang, c in counts.items()}
    found = []
    for text in texts:
        mine = Counter(grams(text))
        logs = {lang: math.log(docs[lang] / sum(docs.values())) + sum(n * math.log((counts[lang][b] + smooth) / total[lang]) for b, n in mine.items()) for lang in counts}
        best = min(logs, key=lambda lang: (-logs[lang], lang))
        found.append((best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())))
    return found


@pytest.mark.parametrize("bits", [15, 4])
def test_langid_is_naive_bayes(spark, bits):
    docs = table(spark, SF, "documents")
    rows = [r for r in docs.collect() if r.text and any(map(str.isalpha, r.text))]
    model = fit_languages(docs, F.col("doc_id") % 2 == 0, bits=bits)
    texts = [r.text[:300] for r in rows[:60]] + ["İstanbul ﬁ", "x", "été"]
    names, sure = model.predict(texts)
    true = plain_bayes([(r.text, r.lang) for r in docs.collect() if r.text is not None and r.lang is not None and r.doc_id % 2 == 0], texts, (1, 2, 3), bits, 0.5)
    assert names == [x for x, _ in true] and np.allclose(sure, [x for _, x in true], rtol=1e-6)
    assert model.predict(texts[:7] + [None] + texts[7:])[0] == names[:7] + ["und"] + names[7:]


@pytest.mark.parametrize("most", [20, 40, 60, 79])
def test_langid_samples_rows_without_ids(spark, most):
    rows = [(None, f"the words of number {i} are here" if i % 2 else f"les mots du nombre {i} sont ici", "en" if i % 2 else "fr") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_languages(docs, F.lit(True), max_docs=most)
    assert model.languages == ["en", "fr"] and model.predict(["the words are here", "les mots sont ici"])[0] == ["en", "fr"]


def test_langid_odd_rows(spark):
    docs = clashing(odd_documents(spark), "lang_pred", "score", "held_out")
    rows = {r.doc_id: r for r in language_predictions(docs).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (2, 3, 4, 6))
    assert rows[9].lang_pred in ("fr", "en", "de")
    assert language_predictions(docs.limit(0)).collect() == []
    nobody = language_predictions(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nobody} == {"und"}

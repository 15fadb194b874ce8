import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from strandweave.llm.common import table
from strandweave.llm.pieces import CHARSMAP, DUMMY_PREFIX, ESCAPE_SPACE, NO_EXTRA_SPACE, NORMALIZER, CharacterMap, PieceCoder, _fields, decode_pieces, encode_pieces, piece_digests

from .helpers import SF, clashing, odd_documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SIGNS = [" ", "  ", "\n", "\t", "▁", "a", "B", "é", "漢", "字", "😀", "́", "\x00", "<s>", "</s>", "<0x41>", "hello", "world", "the ", "　", "\xa0", "1", "23", ".", "​", "ﬁ", "①", "Å", "ㄱ", "ｶﾞ"]
text_of = st.lists(st.sampled_from(SIGNS), max_size=60).map("".join)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def coder():
    return PieceCoder(MODEL, block=40)


@settings(max_examples=600, deadline=None)
@given(text_of)
def test_ids_and_spans_are_the_library_s(library, coder, text):
    ids, begins, ends = coder.encode(text)
    assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)
    pieces = library.encode(text, return_type="proto").pieces
    assert [(p.begin, p.end) for p in pieces] == list(zip(begins.tolist()[1:-1], ends.tolist()[1:-1]))
    assert coder.decode(ids.tolist()) == library.decode(ids.tolist())


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
def test_compiled_maps_normalise_like_the_library_s(rule):
    """Against the library's own normaliser with its offsets, for each rule that it brings along."""
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = {CHARSMAP: b""}
    for field, value in _fields(theirs.serialized_model_proto()):
        if field == NORMALIZER:
            spec |= dict(_fields(value))
    ours = PieceCoder.__new__(PieceCoder)
    ours.map, ours.own, ours.behind = CharacterMap(spec[CHARSMAP]), None, False
    ours.prefix, ours.tight, ours.escape = (bool(spec.get(k, 1)) for k in (DUMMY_PREFIX, NO_EXTRA_SPACE, ESCAPE_SPACE))

    @settings(max_examples=300, deadline=None)
    @given(text_of.map(lambda t: t.replace("\x00", "")))
    def same(text):
        want, offsets = theirs.normalize(text, with_offsets=True)
        got, origin = ours.normalise(text)
        byte_at = lambda t: np.cumsum([0, *(len(c.encode()) for c in t)])
        assert got == want
        assert origin[byte_at(got)].tolist() == byte_at(text)[offsets].tolist()

    same()


def test_stepwise_and_array_normalisation_agree(coder):
    for text in ("a b  c", " é漢 ", "", "x", "   ", "\n \t"):
        fast, slow = coder.normalise(text), coder._normalise_stepwise(text) if text else ("", np.zeros(1, np.int64))
        assert fast[0] == slow[0] and fast[1].tolist() == slow[1].tolist()


def test_digests_of_whole_tables_and_odd_rows(spark, library):
    for docs in (table(spark, SF, "documents").select("doc_id", "text"), clashing(odd_documents(spark).select("doc_id", "text"), "n_tokens", "ids_sha256", "ids", "begins", "spans_tile")):
        rows = piece_digests(docs, MODEL).collect()
        assert len(rows) == docs.count()
        for r in rows:
            ids = library.encode(r.text or "", add_bos=True, add_eos=True)
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest() and r.spans_tile
        assert piece_digests(docs.limit(0), MODEL).collect() == []


def test_spans_spell_the_text_and_ids_decode(spark, library):
    docs = clashing(odd_documents(spark).select("doc_id", "text"), "decoded", "ends")
    for r in decode_pieces(encode_pieces(docs, MODEL), MODEL).collect():
        raw = (r.text or "").encode()
        assert b"".join(raw[a:b] for a, b in zip(r.begins, r.ends)) == raw
        assert r.decoded == library.decode(r.ids)

"""Byte-level BPE over a balanced tree of text: halves are encoded apart, neighbours joined at their boundary."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters in a leaf of the tree, and in the first window on either side of a boundary.
LEAF, WINDOW = 1024, 24
#: The split pattern that FIRM is proven for (fixed value).
FIRM_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where FIRM_PATTERN always ends a match, whatever stands around: a non-space before a space, and changes between
#: ASCII letters, digits and other ASCII signs, but for an apostrophe before a letter (a contraction may start there).
FIRM = re.compile(r"(?<=\S)(?=[ \t\n\r\f\v])|(?<=[A-Za-z])(?=[0-9!-/:-@\[-`{-~])|(?<=[0-9])(?=[A-Za-z!-/:-@\[-`{-~])|(?<=[!-/:-@\[-`{-~])(?=[0-9])|(?<=[!-&(-/:-@\[-`{-~])(?=[A-Za-z])")


class TreeBPE:
    """Encoder and decoder for a rank file in tiktoken's format and the pattern that splits text before merging.

    With a pattern other than FIRM_PATTERN no place in a text is known to be firm: texts are then encoded whole.
    """

    def __init__(self, rank_file: str, pattern: str, leaf: int = LEAF):
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf = max(2, leaf)
        self.halves = pattern == FIRM_PATTERN
        size = max(ranks.values()) + 1
        self.bytes_of, self.text_of = [b""] * size, [str(i) for i in range(size)]
        for token, i in ranks.items():
            self.bytes_of[i] = token

    def encode(self, text: str) -> list[int]:
        """The ids of the text: encode(a + b) = join(encode(a), encode(b)) for any cut, so halves are encoded apart."""
        if len(text) <= self.leaf or not self.halves:
            return self.core.encode_ordinary(text)
        cut = len(text) // 2
        return self.join(text[:cut], self.encode(text[:cut]), text[cut:], self.encode(text[cut:]))

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """Ids of left + right. The window around the boundary grows until it ends at firm places (or at the ends).

        At a firm place the pattern ends a match in any text, the matches before it never look past it, and those
        after start afresh. So tokens outside the window are the same as in the whole, and never straddle its ends.
        """
        a, b = self._firm_before(left), self._firm_after(right)
        middle = self.core.encode_ordinary(left[a:] + right[:b])
        keep, drop = self._tokens_of(reversed(left_ids), left[a:]), self._tokens_of(right_ids, right[:b])
        return left_ids[: len(left_ids) - keep] + middle + right_ids[drop:]

    @staticmethod
    def _firm_before(text: str) -> int:
        reach = WINDOW
        while reach < len(text):
            if places := [m.start() for m in FIRM.finditer(text, len(text) - reach) if len(text) - reach < m.start() < len(text)]:
                return places[0]
            reach *= 2
        return 0

    @staticmethod
    def _firm_after(text: str) -> int:
        reach = WINDOW
        while reach < len(text):
            if places := [m.start() for m in FIRM.finditer(text, 1, reach + 1) if 0 < m.start() < reach]:
                return places[-1]
            reach *= 2
        return len(text)

    def _tokens_of(self, ids, text: str) -> int:
        """How many of the ids, from the start, spell the text's bytes."""
        left, n = len(text.encode()), 0
        for i in ids:
            if left <= 0:
                break
            left, n = left - len(self.bytes_of[i]), n + 1
        if left:
            raise AssertionError("a token straddles a firm place")
        return n

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids; halves are decoded apart and concatenated, which is exact for any cut."""
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        cut = len(ids) // 2
        return self.decode(ids[:cut]) + self.decode(ids[cut:])


@lru_cache(maxsize=2)
def _coder(rank_file: str, pattern: str, leaf: int) -> TreeBPE:
    return TreeBPE(rank_file, pattern, leaf)


def _with_ids(df: DataFrame, rank_file: str, pattern: str, leaf: int, text_col: str, made: T.StructType, make) -> DataFrame:
    """Adds the columns that make(coder, text, ids) returns; df must not have them."""
    out = T.StructType([*df.schema.fields, *made.fields])
    arrow = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}
    kinds = [arrow.get(f.dataType, pa.list_(pa.int32())) for f in made.fields]

    def run(batches):
        coder = _coder(rank_file, pattern, leaf)
        for batch in batches:
            rows = [make(coder, coder.encode(x.as_py() or "")) for x in batch.column(batch.schema.get_field_index(text_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names=out.names)

    return df.mapInArrow(run, out)


def encode_ids(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", ids_col: str = "ids", leaf: int = LEAF) -> DataFrame:
    """Adds the token ids of the whole text to every row (null text: none). A column named like the output is replaced."""
    return _with_ids(docs.drop(ids_col), rank_file, pattern, leaf, text_col, T.StructType([T.StructField(ids_col, T.ArrayType(T.IntegerType()))]), lambda coder, ids: (ids,))


def encode_digests(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """Encodes every text, decodes the ids again, and adds n_tokens, ids_sha256 and decoded_sha256.

    Null text counts as empty (no tokens); texts of any length are encoded whole; a run without any firm place is
    encoded again at each level of the tree, so it costs a factor of the tree's height. All columns are kept.
    """

    def digests(coder: TreeBPE, ids: list[int]):
        written = ",".join(map(coder.text_of.__getitem__, ids)).encode()
        return len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()

    made = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return _with_ids(docs.drop(*made.names), rank_file, pattern, leaf, text_col, made, digests)


def decode_ids(rows: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids spell (null ids: null)."""
    kept = rows.drop(bytes_col)
    out = T.StructType([*kept.schema.fields, T.StructField(bytes_col, T.BinaryType())])

    def run(batches):
        coder = _coder(rank_file, pattern, LEAF)
        for batch in batches:
            found = [None if x is None else coder.decode(x) for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=out.names)

    return kept.mapInArrow(run, out)

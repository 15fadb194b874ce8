"""Token ids as Parquet list columns: encoding, row groups and page indexes are set so that readers can pick."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fanout, new_path

#: Pieces that a worker remembers with their ids; the memory is emptied when full, so it is bounded and results don't
#: depend on it.
PIECES = 400_000
#: Bytes of text that are cut up together, and pieces that are encoded as one text.
TOGETHER, JOINED = 3 << 20, 200

#: Kinds of bytes: white space, ASCII letters, ASCII digits, ASCII signs, and all else (control codes, the apostrophe,
#: where a contraction may start, and bytes beyond ASCII).
SPACE, LETTER, DIGIT, SIGN, ODD = range(5)
KIND = np.full(256, ODD, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = SPACE
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KIND[0x30:0x3A] = DIGIT
KIND[[b for b in range(0x21, 0x7F) if KIND[b] == ODD and b != 0x27]] = SIGN
#: Second bytes, behind 0xC3, of the letters from U+00C0 to U+00FF (two of that row are signs).
LATIN = np.zeros(256, bool)
LATIN[0x80:0xC0] = True
LATIN[[0x97, 0xB7]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Pieces of up to this many bytes are told apart by their bytes, packed into machine words.
PACKED = 24
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class PieceEncoder:
    """Encodes texts with the tokenizers library, each distinct piece once.

    Texts are cut at spaces and U+0009 to U+000D. A word of ASCII characters without an apostrophe and of Latin-1
    letters is cut further into its runs of letters, its single digits and its runs of signs; any other word, and any
    that holds an added token such as an end marker, is a piece as a whole. Only for tokenizers that drop white space,
    fold ASCII case, cut words in just this way (whatever stands around a piece) and mark the last token of what they
    cut with a suffix: there encode(text) is the concatenation over its pieces, and the ids of many pieces encoded as
    one text fall apart at the marked tokens. `by_piece` false encodes whole texts.
    """

    def __init__(self, file: str, by_piece: bool = True, suffix: str = "</w>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.by_piece = by_piece
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self.forget()

    def forget(self) -> None:
        self.at: dict = {}  # hash of a packed piece, or the bytes of another one -> its place
        self.packed = np.zeros((0, 3), np.uint64)
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each text has."""
        if not self.by_piece:
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch([x.decode() for x in texts], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)
        ids, sizes, some, of, held = [], np.zeros(len(texts), np.int64), [], [], 0

        def flush():
            if some:
                made, counts = self._encode_some(some)
                ids.append(made)
                np.add.at(sizes, of, counts)
                some.clear(), of.clear()

        for i, text in enumerate(texts):
            for part in _at_spaces(text):
                some.append(part)
                of.append(i)
                held += len(part)
                if held >= TOGETHER:
                    flush()
                    held = 0
        flush()
        return np.concatenate([np.zeros(0, np.uint32), *ids]), sizes

    def _encode_some(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.starts) > PIECES:
            self.forget()
        text = b" ".join(texts) + b" " * (PACKED + 1)
        starts, ends, odd = self._cut(text)
        place = self._places(text, starts, ends, odd)
        counts = np.diff(self.starts)[place]
        upto = np.append(0, np.cumsum(counts))
        ids = self.ids[np.arange(upto[-1]) + np.repeat(self.starts[place] - upto[:-1], counts)]
        heads = np.append(0, np.cumsum([len(x) + 1 for x in texts]))
        return ids, np.diff(upto[np.searchsorted(starts, heads)])

    def _cut(self, text: bytes):
        """Starts and ends of the pieces, and whether each is a whole odd word."""
        raw = np.frombuffer(text, np.uint8)
        kind = KIND[raw]
        lead = np.flatnonzero((raw[:-1] == 0xC3) & LATIN[raw[1:]])
        kind[lead] = kind[lead + 1] = LETTER
        if self.added:
            for m in self.added.finditer(text):
                kind[m.start()] = ODD
        filled = kind != SPACE
        edge = np.flatnonzero(np.diff(filled, prepend=False, append=False))
        word_start, word_end = edge[::2], edge[1::2]
        if not len(word_start):
            return word_start, word_end, np.zeros(0, bool)
        # Words with an odd byte are taken whole: all their bytes become odd.
        strange = np.flatnonzero(kind == ODD)
        if len(strange):
            for w in np.unique(np.searchsorted(word_end, strange, "right")).tolist():
                kind[word_start[w] : word_end[w]] = ODD
        begins = filled & ((np.diff(kind, prepend=np.uint8(SPACE)) != 0) | (kind == DIGIT))
        starts = np.flatnonzero(begins)
        # A piece ends where the next begins or its word does.
        ends = np.minimum(np.append(starts[1:], len(raw)), word_end[np.searchsorted(word_end, starts, "right")])
        return starts, ends, kind[starts] == ODD

    def _places(self, text: bytes, starts, ends, odd) -> np.ndarray:
        """The place of each piece in the memory, which learns those that are new."""
        place, sizes = np.zeros(len(starts), np.int64), ends - starts
        short = np.flatnonzero(~odd & (sizes <= PACKED))
        raw = LOWER[np.frombuffer(text, np.uint8)]
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the eight bytes from each place on
        packed = np.empty((len(short), 3), np.uint64)
        for i in range(3):
            packed[:, i] = eight[np.minimum(starts[short] + 8 * i, len(eight) - 1)] & _MASK[np.clip(sizes[short] - 8 * i, 0, 8)]
        with np.errstate(over="ignore"):
            h = packed[:, 0] * np.uint64(0x9E3779B97F4A7C15)
            for i in (1, 2):
                h = ((h ^ (h >> np.uint64(29))) + packed[:, i]) * np.uint64(0xBF58476D1CE4E5B9)
        codes, keys = pd.factorize(h)
        first = np.empty(len(keys), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        distinct = packed[first]
        # Pieces whose hash is another's go by their bytes, so equal hashes cannot mix pieces up.
        clash = (packed != distinct[codes]).any(1)
        known = np.fromiter((self.at.get(k, -1) for k in keys.tolist()), np.int64, len(keys))
        clash |= ((known >= 0) & (self.packed[known] != distinct).any(1))[codes] if len(self.packed) else False
        fresh = np.flatnonzero(known < 0)
        if len(fresh):
            known[fresh] = len(self.starts) - 1 + np.arange(len(fresh))
            self.at.update(zip(keys[fresh].tolist(), known[fresh].tolist()))
            self._learn([bytes(raw[starts[s] : ends[s]]) for s in short[first[fresh]].tolist()], distinct[fresh])
        place[short] = known[codes]
        others = np.concatenate([np.flatnonzero(odd | (sizes > PACKED)), short[clash]])
        words = [text[a:b] for a, b in zip(starts[others].tolist(), ends[others].tolist())]
        new = list(dict.fromkeys(w for w in words if w not in self.at))
        self.at.update(zip(new, range(len(self.starts) - 1, len(self.starts) - 1 + len(new))))
        made = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)]
        self._keep(made, [len(x) for x in made], np.zeros((len(new), 3), np.uint64))
        place[others] = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        return place

    def _learn(self, pieces: list[bytes], packed: np.ndarray) -> None:
        groups = [pieces[i : i + JOINED] for i in range(0, len(pieces), JOINED)]
        made, sizes = [], []
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)):
            made.append(np.array(e.ids, np.uint32))
            ends = np.flatnonzero(self.last[made[-1]])
            if len(ends) != len(group):
                raise AssertionError("a piece was cut further")
            sizes.append(np.diff(ends, prepend=-1))
        self._keep(made, np.concatenate(sizes), packed)

    def _keep(self, made: list[np.ndarray], sizes, packed: np.ndarray) -> None:
        if made:
            self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(sizes))
            self.ids = np.concatenate([self.ids, *made])
            self.packed = np.concatenate([self.packed, packed])


def _at_spaces(text: bytes) -> Iterator[bytes]:
    """The text in parts of about TOGETHER bytes, cut at spaces; a longer run without one stays whole."""
    at = 0
    while len(text) - at > 2 * TOGETHER:
        cut = text.find(b" ", at + TOGETHER)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


@lru_cache(maxsize=2)
def _encoder(file: str, by_piece: bool) -> PieceEncoder:
    """One encoder a worker, so that what a task has learned serves the next."""
    return PieceEncoder(file, by_piece)


def _slices(batch: pa.RecordBatch, most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The batch in slices of rows with about `most` bytes of text (a longer text is one alone)."""
    upto, at = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def write_token_file(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", by_piece: bool = True, row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10, dictionary: bool = True) -> None:
    """Writes one row a document, in ascending id order over the files: id, part, local_start, n_tokens, ids.

    `ids` is a list column, dictionary encoded (or delta encoded, with `dictionary` false); row groups and pages are
    of the given sizes, and ids, starts and lengths carry page indexes, so that a reader can take lengths without
    tokens or a range of documents without the rest. `part` numbers the files in order and local_start counts the
    tokens before the document in its file: starts over all files follow from one small sum a file (read_token_file).
    Null or empty text is just the end id; a text of any length is one row, whole; null ids come first, repeated rows
    (and rows that share an id) are written each; an empty table gives a file without rows; other columns are left out.
    The strings of added tokens in a text become those tokens, as by the library's default.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    order = F.col(id_col).asc_nulls_first(), F.xxhash64("text")  # texts that share an id, or have none, are spread too
    rows = rows.repartitionByRange(fanout(spark), *order).sortWithinPartitions(*order)
    out = T.StructType([rows.schema.fields[0], T.StructField("part", T.IntegerType()), T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def encode(batches):
        coder, start, part = _encoder(tokenizer_file, by_piece), 0, TaskContext.get().partitionId()
        for batch in batches:
            for some in _slices(batch):
                found, sizes = coder.encode(some.column(1).to_pylist())
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                ids = np.full(ends[-1], end_id, np.uint32)
                inner = np.ones(len(ids), bool)
                inner[ends - 1] = False
                ids[inner] = found
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.full(len(sizes), part), pa.int32()), pa.array(start + ends - sizes), pa.array(sizes), lists], names=out.names)
                start += int(ends[-1])

    options = {
        "compression": "zstd", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.write-checksum.enabled": "true",
        "parquet.enable.dictionary": str(dictionary).lower(), "parquet.writer.version": "PARQUET_2_0", "parquet.dictionary.page.size": 1 << 20,
    }
    rows.mapInArrow(encode, out).write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def token_starts(spark, path: str) -> DataFrame:
    """part, part_start: tokens before each file. Reads only the lengths; one row a file comes to the driver."""
    totals = sorted(spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens")).collect())
    starts, at = [], 0
    for part, n in totals:
        starts.append((part, at))
        at += n
    return spark.createDataFrame(starts, "part int, part_start long")


def read_token_file(spark, path: str, columns: tuple[str, ...] = ("ids",), where: Column | None = None) -> DataFrame:
    """Documents of a token file with their start over all files; `where` on ids or lengths skips row groups and pages."""
    rows = spark.read.parquet(path)
    rows = rows if where is None else rows.filter(where)
    id_col = rows.columns[0]
    return rows.join(F.broadcast(token_starts(spark, path)), "part").select(id_col, (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", *columns)


def token_digests(rows: DataFrame) -> DataFrame:
    """Replaces `ids` by ids_crc32, the crc32 of the ids as little-endian unsigned 32-bit integers."""
    kept = [f for f in rows.schema.fields if f.name != "ids"]
    out = T.StructType([*kept, T.StructField("ids_crc32", T.LongType())])

    def digest(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), pa.array(crcs, pa.int64())], names=out.names)

    return rows.mapInArrow(digest, out)


def write_and_read(docs: DataFrame, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the documents' token file into the shared folder and reads it back: id, start, n_tokens, ids_crc32."""
    path = new_path(docs.sparkSession, "tokens")
    write_token_file(docs, path, tokenizer_file, end_id, id_col, text_col)
    return token_digests(read_token_file(docs.sparkSession, path))

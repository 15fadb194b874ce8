"""SentencePiece encoding that keeps, for every piece, the bytes of the original text it stands for."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The sign that stands for a space in pieces (fixed value).
MARK = "▁"
#: Characters that are encoded at once; a longer text is cut before the next mark behind another character.
BLOCK = 1 << 16
_CUT = re.compile(f"(?<=[^{MARK}]){MARK}")
#: Field numbers of the model file and values of its enumerations (fixed values).
PIECE, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_TYPE, USER_DEFINED = 1, 3, 4
MODEL_TYPE, BPE, MARK_BEHIND = 3, 2, 24
CHARSMAP, DUMMY_PREFIX, NO_EXTRA_SPACE, ESCAPE_SPACE = 2, 3, 4, 5


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message; numbers of fixed width come as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(message):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, message[at : at + size]
        at += size


class CharacterMap:
    """The compiled character map of a model: a double-array trie over UTF-8 keys, and the strings they become."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.strings = blob[4 + size :]
        self.dead: set[str] = set()

    def longest(self, text: str, at: int) -> tuple[int, str] | None:
        """The longest key that text[at:] starts with: its length in characters, and what it becomes."""
        head = text[at : at + 2]
        if not self.units or head in self.dead:
            return None
        place, found, n = self._child(0), None, 0
        while at + n < len(text):
            for byte in text[at + n].encode():
                place ^= byte
                if place >= len(self.units) or self.units[place] & 0x800000FF != byte:
                    if n < 2 and not found:
                        if len(self.dead) > 200_000:
                            self.dead.clear()
                        self.dead.add(head)
                    return found and (found[0], self._string(found[1]))
                leaf = self.units[place] >> 8 & 1
                place = self._child(place)
            n += 1
            if leaf:
                found = n, self.units[place] & 0x7FFFFFFF
        return found and (found[0], self._string(found[1]))

    def _child(self, place: int) -> int:
        """Where the children of a unit start: its offset is in its upper bits, coarser where bit 9 is set."""
        unit = self.units[place]
        return place ^ (unit >> 10 << ((unit & 512) >> 6))

    def _string(self, at: int) -> str:
        return self.strings[at : self.strings.index(0, at)].decode()


class PieceCoder:
    """Encodes with a SentencePiece model: the text is normalised here, where alignment is kept, and the library's
    encoder, with its own normalisation turned off, gets the result."""

    def __init__(self, model_file: str, block: int = BLOCK):
        with open(model_file, "rb") as f:
            model = f.read()
        trainer: dict = {}
        # Defaults of the format, which the model's own values replace.
        normal: dict = {CHARSMAP: b"", DUMMY_PREFIX: 1, NO_EXTRA_SPACE: 1, ESCAPE_SPACE: 1}
        own, self.cuts, sizes = [], True, []
        for field, value in _fields(model):
            if field == PIECE:
                piece = dict(_fields(value))
                text = piece[PIECE_TEXT]
                sizes.append(1 if piece.get(PIECE_TYPE) == 6 else len(text))
                if piece.get(PIECE_TYPE) == USER_DEFINED:
                    own.append(text.decode())
                self.cuts &= not _CUT.search(text.decode())
            elif field == TRAINER:
                trainer |= dict(_fields(value))
            elif field == NORMALIZER:
                normal |= dict(_fields(value))
        self.cuts &= trainer.get(MODEL_TYPE, 1) == BPE
        self.block = block
        self.map = CharacterMap(normal[CHARSMAP])
        self.own = re.compile("|".join(map(re.escape, sorted(own, key=len, reverse=True)))) if own else None
        self.prefix, self.tight, self.escape = (bool(normal[k]) for k in (DUMMY_PREFIX, NO_EXTRA_SPACE, ESCAPE_SPACE))
        self.behind = bool(trainer.get(MARK_BEHIND, 0))
        # A field that comes again is merged into the first: these switch the library's normalisation off.
        off = bytes([CHARSMAP << 3 | 2, 0, DUMMY_PREFIX << 3, 0, NO_EXTRA_SPACE << 3, 0, ESCAPE_SPACE << 3, 0])
        self.core = sentencepiece.SentencePieceProcessor(model_proto=model + bytes([NORMALIZER << 3 | 2, len(off)]) + off)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.sizes = np.array(sizes, np.int64)
        self.unknown = self.core.unk_id()

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the byte of the text where its origin starts."""
        if not text:
            return "", np.zeros(1, np.int64)
        if self.map.units or self.own or self.tight or self.behind or not (self.prefix and self.escape):
            return self._normalise_stepwise(text)
        # The common case, in arrays: nothing is mapped, spaces become marks, and a mark comes before all.
        raw = np.frombuffer(text.encode(), np.uint8)
        start = np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, np.arange(len(raw)), 0))
        width = np.where(raw == 0x20, len(MARK.encode()), 1)
        origin = np.concatenate((np.zeros(len(MARK.encode()), np.int64), np.repeat(start, width), [len(raw)]))
        return MARK + text.replace(" ", MARK), origin

    def _normalise_stepwise(self, text: str) -> tuple[str, np.ndarray]:
        """By the longest prefix at each place: a piece that the user defined stays, a key of the map is replaced, any
        other character stays. Spaces are then dropped or marked as the model says."""
        made: list[tuple[str, int]] = []  # a string, and the byte where its origin starts
        at = byte = 0
        while at < len(text):
            if self.own and (kept := self.own.match(text, at)):
                n, string = len(kept[0]), kept[0]
            else:
                n, string = self.map.longest(text, at) or (1, text[at])
            made.append((string, byte))
            byte += len(text[at : at + n].encode())
            at += n
        end = byte
        if self.tight:
            first = next((i for i, (s, _) in enumerate(made) if s != " "), len(made))
            if first == len(made):
                return "", np.zeros(1, np.int64)
            made = made[first:]
            spaced, trimmed = True, []
            for string, origin in made:
                string = string.lstrip(" ") if spaced else string
                if string:
                    spaced = string.endswith(" ")
                trimmed.append((string, origin))
            made = trimmed
        space = MARK if self.escape else " "
        before = [(space, made[0][1])] if self.prefix and not self.behind else []
        signs = before + [(space if c == " " and self.escape else c, origin) for string, origin in made for c in string]
        while self.tight and signs and signs[-1][0] == space:
            end = signs.pop()[1]
        if self.prefix and self.behind:
            signs.append((space, end))
        origin = np.repeat(np.array([o for _, o in signs], np.int64), [len(c.encode()) for c, _ in signs])
        return "".join(c for c, _ in signs), np.append(origin, end)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each piece starts and ends in the text's UTF-8 bytes; a begin and an end id stand around.

        Of the byte pieces of one unknown character the last has its span and the others are empty at its start.
        """
        normal, origin = self.normalise(text)
        ids = np.concatenate([self.core.encode(part, return_type="numpy") for part in self._blocks(normal)]).astype(np.int64)
        sizes = self.sizes[ids]
        if (ids == self.unknown).any():
            sizes = self._unknown_sizes(ids, sizes, normal)
        ends = np.cumsum(sizes)
        begins, ends = origin[ends - sizes], origin[ends]
        last = len(text.encode())
        edge = lambda a, x, z: np.concatenate(([x], a, [z]))
        return edge(ids, self.core.bos_id(), self.core.eos_id()), edge(begins, 0, last), edge(ends, 0, last)

    def _blocks(self, normal: str) -> Iterator[str]:
        """Parts that no piece and so no merge can straddle: no piece has a mark behind another character."""
        at = 0
        while self.cuts and len(normal) - at > self.block and (cut := _CUT.search(normal, at + self.block)):
            yield normal[at : cut.start()]
            at = cut.start()
        yield normal[at:]

    def _unknown_sizes(self, ids: np.ndarray, sizes: np.ndarray, normal: str) -> np.ndarray:
        """Bytes of each piece where the model has no byte pieces: an unknown piece goes on to the next known one."""
        sizes, pieces, raw, at = sizes.copy(), [self.core.id_to_piece(i).encode() for i in ids.tolist()], normal.encode(), 0
        for k, i in enumerate(ids.tolist()):
            if i == self.unknown:
                known = pieces[k + 1] if k + 1 < len(ids) else b""
                upto = raw.find(known, at + 1) if known else len(raw)
                sizes[k] = upto - at
            at += int(sizes[k])
        return sizes

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids)


@lru_cache(maxsize=2)
def _coder(model_file: str, block: int) -> PieceCoder:
    return PieceCoder(model_file, block)


def _with(df: DataFrame, model_file: str, block: int, text_col: str, made: list[tuple[T.StructField, pa.DataType]], make) -> DataFrame:
    """Adds the columns that make(coder, text) returns, in place of any that have their names."""
    kept = df.drop(*(f.name for f, _ in made))
    out = T.StructType([*kept.schema.fields, *(f for f, _ in made)])

    def run(batches):
        coder = _coder(model_file, block)
        for batch in batches:
            rows = [make(coder, x.as_py() or "") for x in batch.column(batch.schema.get_field_index(text_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(made))], names=out.names)

    return kept.mapInArrow(run, out)


def encode_pieces(docs: DataFrame, model_file: str, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Adds ids, begins and ends: the pieces of the whole text with begin and end ids, and their spans of its bytes.

    Null text counts as empty (the begin and end ids alone); texts of any length are encoded whole; repeated rows are
    encoded each; an empty table gives no rows. All other columns are kept, and those named like outputs replaced.
    """
    whole = T.ArrayType(T.IntegerType())
    made = [(T.StructField(n, whole), pa.list_(pa.int32())) for n in ("ids", "begins", "ends")]
    return _with(docs, model_file, block, text_col, made, PieceCoder.encode)


def piece_digests(docs: DataFrame, model_file: str, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Encodes every text, decodes the ids again, and adds n_tokens, ids_sha256 (of the ids as little-endian unsigned
    32-bit integers), decoded_sha256 and spans_tile: whether the spans follow each other from the first byte to the last.

    Nulls, empty and long texts, repeated rows, empty tables and clashing columns are as in encode_pieces.
    """

    def digests(coder: PieceCoder, text: str):
        ids, begins, ends = coder.encode(text)
        tile = bool((begins[1:] == ends[:-1]).all()) and begins[0] == 0 and ends[-1] == len(text.encode())
        decoded = coder.decode(ids.tolist()).encode()
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest(), bool(tile)

    made = [(T.StructField("n_tokens", T.LongType()), pa.int64()), (T.StructField("ids_sha256", T.StringType()), pa.string()), (T.StructField("decoded_sha256", T.StringType()), pa.string()), (T.StructField("spans_tile", T.BooleanType()), pa.bool_())]
    return _with(docs, model_file, block, text_col, made, digests)


def decode_pieces(rows: DataFrame, model_file: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds the text that the ids spell (null ids: null), in place of any column of that name."""
    kept = rows.drop(text_col)
    out = T.StructType([*kept.schema.fields, T.StructField(text_col, T.StringType())])

    def run(batches):
        coder = _coder(model_file, BLOCK)
        for batch in batches:
            found = [None if x is None else coder.decode(x) for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=out.names)

    return kept.mapInArrow(run, out)

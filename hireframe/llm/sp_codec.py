"""SentencePiece encoding and decoding with exact byte offsets.

A text is normalised by longest-prefix matches in the model's compiled character map, and every
normalised byte remembers the source byte it came from.  The normalised text is cut into pieces
by the library; the pieces' lengths then run along the alignment, so each piece is projected to
its span of original bytes.  Decoding returns the text from the ids.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"


class CharsMap:
    """The compiled character map: a double-array trie of source prefixes and their replacements."""

    def __init__(self, blob: bytes):
        self.units, self.texts = (), b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest entry that data[at:] begins with."""
        if not self.units:
            return None
        units, found = self.units, None
        node = units[0] >> 10 << ((units[0] & 0x200) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or (units[node] & 0x800000FF) != data[i]:
                break
            u = units[node]
            node ^= u >> 10 << ((u & 0x200) >> 6)
            if u >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.texts[start:self.texts.index(b"\0", start)])
        return found

    def apply(self, text: str) -> tuple[bytes, np.ndarray]:
        """Replaced bytes, and for each the source byte offset it stands for (plus the end offset)."""
        data = text.encode("utf-8")
        if not self.units:
            return data, np.arange(len(data) + 1, dtype=np.int64)
        out, align, at = bytearray(), [], 0
        while at < len(data):
            hit = self.longest(data, at)
            if hit is None:
                lead = data[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = data[at:at + n]
            else:
                n, new = hit
            out += new
            align += [at] * len(new)
            at += n
        return bytes(out), np.array([*align, len(data)], dtype=np.int64)


class Codec:
    """Encoder and decoder over one model file's bytes."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        self.map = CharsMap(norm.precompiled_charsmap)
        self.dummy, self.squeeze = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        self.sizes = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in proto.pieces], dtype=np.int64)
        self.end = self.sp.eos_id()

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids of every text, without an end id."""
        return [np.array(i, np.int32) for i in self.sp.encode(texts, num_threads=1)]

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes as the pieces see them, and the source offset of each byte (and the end)."""
        data, align = self.map.apply(text)
        raw, space = np.frombuffer(data, np.uint8), SPACE.encode()
        if self.squeeze:  # one space between words, none at either end
            blank = raw == 32
            keep = ~blank | (np.r_[False, ~blank[:-1]] & (np.cumsum(~blank[::-1])[::-1] > 0)) if len(raw) else blank
            raw, align = raw[keep], np.r_[align[:-1][keep], align[-1:]]
            data = raw.tobytes()
        times = np.where(raw == 32, len(space), 1)
        spread = np.r_[np.repeat(align[:-1], times), align[-1:]]
        out = data.replace(b" ", space)
        if self.dummy and data:
            out, spread = space + out, np.r_[np.full(len(space), spread[0]), spread]
        return out, spread

    def spans(self, text: str, ids: list[int] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every piece in the text's UTF-8 bytes.  Exact with byte-fallback models;
        a model with an unknown piece has no length for it, so its spans are refused."""
        out, spread = self.normalise(text)
        ends = np.cumsum(self.sizes[np.asarray(ids, np.int64)])
        if (int(ends[-1]) if len(ends) else 0) != len(out):
            raise ValueError("pieces do not cover the normalised text")
        starts = np.r_[0, ends[:-1]] if len(ends) else ends
        return spread[starts], spread[ends]

    def spans_of(self, texts: list[str], ids: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """``spans`` of many texts; in one pass of array operations where the character map is empty."""
        if self.map.units or self.squeeze or not self.dummy:
            pairs = [self.spans(t, i) for t, i in zip(texts, ids)]
            return [p[0] for p in pairs], [p[1] for p in pairs]
        raw = [b" " + t.encode() if t else b"" for t in texts]
        lens = np.array([len(r) for r in raw], dtype=np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        spread = np.r_[np.repeat(np.arange(len(flat)), np.where(flat == 32, len(SPACE.encode()), 1)), len(flat)]
        counts = np.array([len(i) for i in ids], dtype=np.int64)
        ends = np.cumsum(self.sizes[np.concatenate([*ids, np.zeros(0, np.int32)])])
        if (int(ends[-1]) if len(ends) else 0) != len(spread) - 1:
            raise ValueError("pieces do not cover the normalised text")
        first = np.repeat(np.cumsum(lens) - lens + 1, counts)
        starts = np.maximum(spread[np.r_[0, ends[:-1]]] - first, 0) if len(ends) else ends
        stops = spread[ends] - first
        cuts = np.cumsum(counts)[:-1]
        return np.split(starts, cuts), np.split(stops, cuts)

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


_CODECS: dict[int, Codec] = {}


def codec(model: bytes) -> Codec:
    """One codec per worker process and model."""
    key = hash(model)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def text_slices(batches: Iterator[pa.RecordBatch], text_col: str, size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows with whole texts of about ``size`` bytes together (null texts empty), so that ids
    and spans of a run, not of a whole batch, are in memory."""
    for b in batches:
        col = b.column(b.schema.get_field_index(text_col))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield b.slice(at, end - at), [t or "" for t in col.slice(at, end - at).to_pylist()]
            at = end


def int_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays]).astype(np.int32)))


def encode(docs: DataFrame, model: bytes, text_col: str = "text", spans: bool = True, end_id: bool = True,
           decoded: bool = False) -> DataFrame:
    """All columns of ``docs`` plus ``ids`` array<int> and, if asked, ``starts`` and ``ends``
    array<int> (byte spans of the pieces) and ``decoded`` string (the ids decoded again).

    A null or empty text has no pieces: only the end id.  The end id, if any, is an empty span at
    the end.  Rows are independent: no shuffle; a task holds one run of rows.  Input columns of the
    names that are added are replaced.
    """
    names = ["ids", *(["starts", "ends"] if spans else []), *(["decoded"] if decoded else [])]
    docs = docs.drop(*names)
    kinds = [T.StringType() if n == "decoded" else T.ArrayType(T.IntegerType()) for n in names]
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, names, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b, texts in text_slices(batches, text_col):
            ids = c.ids_of(texts)
            parts = [ids, *(c.spans_of(texts, ids) if spans else [])]
            if end_id:  # an empty span at the end of the text
                size = [len(t.encode()) for t in texts]
                last = [[c.end] * len(texts), size, size]
                parts = [[np.append(x, y) for x, y in zip(p, e)] for p, e in zip(parts, last)]
            arrays = [int_lists(p) for p in parts]
            if decoded:
                arrays.append(pa.array(c.sp.decode([i.tolist() for i in parts[0]]), pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: bytes, out_col: str = "decoded") -> DataFrame:
    """``encoded`` (with a column ids) plus the decoded text; null ids decode to an empty text."""
    encoded = encoded.drop(out_col)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = codec(model).sp
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids")).to_pylist()
            text = pa.array([sp.decode(x) if x else "" for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, text], names=[*b.schema.names, out_col])

    return encoded.mapInArrow(run, schema)

"""Packing documents into sequences by shortest-pack-first over the length histogram.

1. Pieces: a document's ids are cut at multiples of the sequence size.  Full pieces are sequences of
   their own; each document leaves at most one shorter piece.
2. Patterns: the histogram of the shorter lengths (fewer numbers than the sequence size has tokens)
   is packed on the driver, longest lengths first, each onto the shortest packs that it still fits.
   Packs of equal content are one packing pattern with a count, so the work depends on the number of
   lengths and not on the number of documents.
3. Sequences whose filling leaves a wide gap are cut at powers of two, which need no padding.
4. Join: the r-th piece of a length is the r-th slot of that length among the patterns.  Ranks come
   from one distributed sort of (length, piece); the slots are intervals of ranks, a table whose size
   is bounded by the number of lengths, and it is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import byte_bpe
from .common import ordered_running_totals, saved

SIZE = 2048
#: A sequence with a wider gap than this is cut at powers of two.
WIDEST_GAP = 64
#: Ids that are held back in a task before a batch of pieces leaves it.
BATCH_IDS = 1 << 20


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths, count) of the lengths 1..size-1, each used as often as it occurs.

    Lengths are placed from the longest to the shortest.  A length goes to the shortest packs that
    have room for it; if these are more than are needed the rest of them stays as it was.  Only when
    none has room are new packs opened.
    """
    filled: dict[int, list[list]] = {}          # tokens in a pack -> [lengths, count]
    for length in sorted(histogram, reverse=True):
        left, used = histogram[length], min(filled, default=size)
        while left:
            used = min((u for u in filled if used <= u <= size - length), default=None)
            if used is None:
                each = size // length               # one after the other onto the pack just opened, until it is full
                for n, count in ((each, left // each), (left % each, 1)):
                    if n and count:
                        filled.setdefault(n * length, []).append([(length,) * n, count])
                break
            fits = filled[used]
            lengths, count = fits.pop()
            if count > left:
                fits.append([lengths, count - left])
            elif not fits:
                del filled[used]
            n = min(count, left)
            filled.setdefault(used + length, []).append([(*lengths, length), n])
            left -= n
            used = min(used, min(filled))
    return [(lengths, count) for used in sorted(filled, reverse=True) for lengths, count in filled[used]]


def cuts(used: int, size: int = SIZE, gap: int = WIDEST_GAP) -> list[int]:
    """Sizes of the sequences that hold ``used`` tokens: one, or powers of two where the gap is wide."""
    if size - used <= gap:
        return [used]
    return [1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1]


def slots(histogram: dict[int, int], size: int = SIZE, gap: int = WIDEST_GAP) -> tuple[list[tuple], int]:
    """(rows, sequences): a row says that the pieces of ``length`` with ranks ``low <= r < high`` go to
    copy r - low of a pattern, and where: parts of (start in the piece, length, sequence of the copy,
    offset).  Copy c of a pattern takes the sequences base + c * step and on."""
    taken, rows, base = dict.fromkeys(histogram, 0), [], 0
    for lengths, count in patterns(histogram, size):
        ends = np.cumsum(cuts(sum(lengths), size, gap))
        begins, at = np.r_[0, ends[:-1]], 0
        for length in lengths:
            parts = []
            for j in range(len(ends)):
                a, z = max(at, int(begins[j])), min(at + length, int(ends[j]))
                if a < z:
                    parts.append((a - at, z - a, j, a - int(begins[j])))
            rows.append((length, taken[length], taken[length] + count, base, len(ends), parts))
            taken[length] += count
            at += length
        base += count * len(ends)
    return rows, base


_SLOTS = "length int, low long, high long, base long, step int, parts array<struct<skip:int,n:int,j:int,offset:int>>"


def pieces(docs: DataFrame, spec: str, end_id: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece: (id, start, length, doc_tokens, ids as little-endian unsigned 32-bit numbers,
    part, at); part and at number the rows of the written table."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.IntegerType()),
                           T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
                           T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = byte_bpe(spec), TaskContext.get().partitionId(), 0
        rows, held = [], 0

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (
                pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64()))], names=schema.names)

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(encoder.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), size):
                    cut = ids[start: start + size]
                    rows.append((i, start, len(cut), len(ids), cut.tobytes(), part, at))
                    at += 1
                held += len(ids)
                if held >= BATCH_IDS:
                    yield out()
                    rows, held = [], 0
        if rows:
            yield out()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, spec: str, end_id: int = 1, size: int = SIZE, gap: int = WIDEST_GAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: (id_col, start, length, ids, doc_tokens, sequence_id, offset).

    ``ids`` (binary, little-endian unsigned 32-bit) are the document's ids from ``start`` on, the end id
    included.  A null or empty text has the end id alone.  Rows with equal or null ids are packed like any
    others, each row by itself; other columns are ignored.  An empty table gives no rows.  Sequence
    numbers have no gaps; offsets in a sequence run from 0 without gaps.  A text's ids are encoded in one
    task; a length that very many pieces have is ranked by many tasks.
    """
    spark = docs.sparkSession
    cut = saved(pieces(docs, spec, end_id, size, id_col, text_col), "pack-pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``size`` rows
    full = counts.pop(size, 0)
    rows, packed = slots(counts, size, gap)
    rows.append((size, 0, full, packed, 1, [(0, size, 0, 0)]))
    first = dict(zip([*sorted(counts), size], map(int, np.cumsum([0, *[n for _, n in sorted(counts.items())]]))))
    rows = [(length, first[length] + low, first[length] + high, *rest) for length, low, high, *rest in rows]
    # the slots are bounded by the number of different lengths, whatever the number of documents
    table = F.broadcast(spark.createDataFrame(rows, _SLOTS))
    ranked = ordered_running_totals(cut.select("length", "part", "at"), ["length", "part", "at"], [], "pack-ranks")
    placed = (ranked.join(table, "length").where("low <= row_before and row_before < high")
              .select("part", "at", (F.col("base") + (F.col("row_before") - F.col("low")) * F.col("step")).alias("first"), "parts"))
    whole = cut.drop("length").join(placed, ["part", "at"]).select("*", F.explode("parts").alias("p"))
    return whole.select(
        F.col("id").alias(id_col), (F.col("start") + F.col("p.skip")).alias("start"), F.col("p.n").cast("long").alias("length"),
        F.substring(F.col("ids"), F.col("p.skip") * 4 + 1, F.col("p.n") * 4).alias("ids"), "doc_tokens",
        (F.col("first") + F.col("p.j")).alias("sequence_id"), F.col("p.offset").cast("long").alias("offset"))

"""Alignment of two tokenizers' ids over the same texts, counted by inverted pair bitmaps.

Token A and token B of a text are linked when their byte ranges overlap.  Between two neighbouring
token ends (of either tokenizer) lies exactly one such overlap, so a text's links are read off the
sorted union of both sets of ends; positions where both end cut the text into groups.

1. Postings: a task numbers its documents in containers of a bounded number of documents and links.
   For every pair of ids it writes the container's documents as bit planes: plane j is the bitmap of
   the documents in which bit j of the pair's multiplicity is set.  A bitmap is compressed: sorted
   16-bit numbers while that is shorter than one bit per document.
2. Counts: the planes' OR, popcounted, is the pair's number of documents; the popcounts weighted by
   2^j are its number of links.  Containers hold different documents, so sums over them are exact.
3. Scores: each pair's planes, joined with its count, are read back, and the count is added up for
   the documents they name; a task holds the sums of one container at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import byte_bpe
from .common import parallelism, saved

#: Bounds of a container: links held in a task (a document's links stay together) and documents.
LINKS = 3_000_000
DOCS = 1 << 16
#: Pairs up to which the table of counts (25 bytes a row) is broadcast; beyond, postings and counts meet by a shuffle.
MAX_BROADCAST_PAIRS = 1_000_000
#: Room for ids in a pair's number.
WIDTH = 1 << 20


class Pieces:
    """The second tokenizer: a SentencePiece model with its pieces as bytes."""

    def __init__(self, model: bytes):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.pieces = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]


_LOADED: dict[bytes, Pieces] = {}


def piece_model(model: bytes) -> Pieces:
    if model not in _LOADED:
        _LOADED[model] = Pieces(model)
    return _LOADED[model]


def token_ends(ids: np.ndarray, pieces: list[bytes], sizes: np.ndarray, data: bytes) -> np.ndarray | None:
    """Byte ends of the tokens, or None when their bytes are not ``data``."""
    return np.cumsum(sizes[ids]) if b"".join(map(pieces.__getitem__, ids.tolist())) == data else None


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token) of every overlap, and the last A and B token of every group."""
    n = int(ends_a[-1]) + 1
    in_a, in_b = np.zeros(n, bool), np.zeros(n, bool)
    in_a[ends_a], in_b[ends_b] = True, True
    at = np.flatnonzero(in_a | in_b)
    end_a, end_b = in_a[at], in_b[at]
    a, b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
    both = end_a & end_b
    return a, b, a[both], b[both]


def group_text(ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
    """Groups as ``a1,a2|b1;a3|b2,b3``."""
    n_a, n_b = np.diff(np.r_[-1, last_a]), np.diff(np.r_[-1, last_b])
    starts = np.cumsum(n_a + n_b) - (n_a + n_b)
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    order[np.arange(len(ids_a)) + np.repeat(starts - (np.cumsum(n_a) - n_a), n_a)] = ids_a
    order[np.arange(len(ids_b)) + np.repeat(starts + n_a - (np.cumsum(n_b) - n_b), n_b)] = ids_b
    after = np.zeros(len(order), np.int64)
    after[starts + n_a - 1], after[starts + n_a + n_b - 1] = 1, 2
    top = 1 << max(int(order.max()).bit_length(), 1)
    return "".join(map(_numbers(top).__getitem__, (order + after * top).tolist()))[:-1]


_NUMBERS: dict[int, list[str]] = {}


def _numbers(top: int) -> list[str]:
    if top not in _NUMBERS:
        _NUMBERS[top] = [f"{i}{mark}" for mark in ",|;" for i in range(top)]
    return _NUMBERS[top]


def planes(keys: np.ndarray, docs: np.ndarray, times: np.ndarray, width: int):
    """Bit planes of postings sorted by (key, document): (first posting of each key, list offsets of
    its planes, byte offsets, bytes)."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    owner = np.cumsum(np.r_[True, keys[1:] != keys[:-1]]) - 1
    most = np.maximum.reduceat(times, first)
    n_planes = np.frexp(most.astype(np.float64))[1]                  # bit lengths
    lists = np.r_[0, np.cumsum(n_planes)]
    where, which = [], []
    for j in range(int(n_planes.max())):
        hit = np.flatnonzero(times >> j & 1)
        where.append(lists[owner[hit]] + j)
        which.append(hit)
    where, which = np.concatenate(where), np.concatenate(which)
    order = np.argsort(where, kind="stable")                         # documents stay sorted within a plane
    numbers = docs[which[order]].astype("<u2")
    count = np.bincount(where, minlength=lists[-1])
    bitmap = -(-width // 8)
    dense = np.flatnonzero(2 * count >= bitmap)
    sizes = 2 * count
    sizes[dense] = bitmap
    source, target = np.r_[0, np.cumsum(2 * count)], np.r_[0, np.cumsum(sizes)]
    if not len(dense):
        return first, lists, target, numbers.view(np.uint8)
    raw, out, last = numbers.view(np.uint8), np.empty(int(target[-1]), np.uint8), 0
    for p in [*dense.tolist(), len(count)]:
        out[target[last]: target[p]] = raw[source[last]: source[p]]
        if p < len(count):
            bits = np.zeros(8 * bitmap, bool)
            bits[numbers[source[p] // 2: source[p + 1] // 2]] = True
            out[target[p]: target[p + 1]] = np.packbits(bits)
        last = p + 1
    return first, lists, target, out


def read_planes(lists: np.ndarray, offsets: np.ndarray, data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, document, plane) of every bit that is set; ``lists`` cuts the planes by row."""
    sizes, bitmap = np.diff(offsets), -(-width // 8)
    plane_row = np.repeat(np.arange(len(lists) - 1), np.diff(lists))
    plane_no = np.arange(len(sizes)) - np.repeat(lists[:-1] - lists[0], np.diff(lists))
    is_dense = (sizes >= bitmap) & (sizes > 0)
    count = np.where(is_dense, 0, sizes // 2)
    keep = np.repeat(~is_dense, sizes)
    numbers = data[offsets[0]: offsets[-1]][keep].view("<u2").astype(np.int64)
    rows, docs, nos = [np.repeat(plane_row, count)], [numbers], [np.repeat(plane_no, count)]
    for p in np.flatnonzero(is_dense):
        hit = np.flatnonzero(np.unpackbits(data[offsets[p]: offsets[p + 1]]))
        rows.append(np.full(len(hit), plane_row[p]))
        docs.append(hit)
        nos.append(np.full(len(hit), plane_no[p]))
    return np.concatenate(rows), np.concatenate(docs), np.concatenate(nos)


_DOC = [("id", T.LongType(), pa.int64()), ("n_a", T.LongType(), pa.int64()), ("n_b", T.LongType(), pa.int64()), ("n_groups", T.LongType(), pa.int64()),
        ("n_links", T.LongType(), pa.int64()), ("groups", T.StringType(), pa.string())]
_PAIR = [("pair", T.LongType(), pa.int64()), ("docs", T.LongType(), pa.int64()), ("count", T.LongType(), pa.int64()), ("width", T.IntegerType(), pa.int32()),
         ("planes", T.ArrayType(T.BinaryType()), pa.list_(pa.binary()))]
_ROWS = [("container", T.LongType(), pa.int64()), ("ord", T.IntegerType(), pa.int32()), *_DOC, *_PAIR]


def postings(docs: DataFrame, spec: str, model: bytes, id_col: str = "doc_id", text_col: str = "text", digest: bool = False,
             most_links: int = LINKS) -> DataFrame:
    """Two kinds of rows in one written table, so that texts are encoded once: a row per document
    (container, ord, id, n_a, n_b, n_groups, n_links, groups) and a row per container and pair
    (container, pair, docs, count, width, planes).  With ``digest`` the groups are their SHA-256."""
    schema = T.StructType([T.StructField(n, t) for n, t, _ in _ROWS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_codec, b_codec = byte_bpe(spec), piece_model(model)
        a_sizes, b_sizes = (np.array([len(p) for p in c.pieces], np.int64) for c in (a_codec, b_codec))
        container, facts, held, total = TaskContext.get().partitionId() << 32, [], [], 0

        def batch(**cols) -> pa.RecordBatch:
            n = len(next(iter(cols.values())))
            return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c not in cols else cols[c] for c, _, t in _ROWS], names=schema.names)

        def flush() -> Iterator[pa.RecordBatch]:
            width = len(facts)
            cols = list(zip(*facts))
            yield batch(container=pa.array(np.full(width, container)), ord=pa.array(np.arange(width), pa.int32()),
                        **{n: pa.array(c, t) for (n, _, t), c in zip(_DOC, cols)})
            if not total:
                return
            key = np.concatenate(held)
            held.clear()
            key, times = np.unique(key, return_counts=True)
            pair, doc = key >> 16, key & 0xFFFF
            first, lists, offsets, data = planes(pair, doc, times, width)
            values = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
            bits = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), values)
            n_docs = np.diff(np.r_[first, len(pair)])
            whole = batch(container=pa.array(np.full(len(first), container)), pair=pa.array(pair[first]), docs=pa.array(n_docs),
                          count=pa.array(np.add.reduceat(times, first)), width=pa.array(np.full(len(first), width, np.int32)), planes=bits)
            for at in range(0, len(first), 20_000):
                yield whole.slice(at, 20_000)

        for b in batches:
            ids = b.column(0).to_pylist()
            for k, value in enumerate(b.column(1)):
                text = value.as_py()
                data = " ".encode() + (text or "").encode()
                fact = (ids[k], 0, 0, 0, 0, "")
                if text:
                    ta = a_codec.ids(" " + text).astype(np.int64)
                    tb = np.array(b_codec.sp.encode(text, num_threads=1), np.int64)
                    ea, eb = token_ends(ta, a_codec.pieces, a_sizes, data), token_ends(tb, b_codec.pieces, b_sizes, data)
                    if ea is not None and eb is not None:
                        la, lb, ga, gb = links(ea, eb)
                        groups = group_text(ta, tb, ga, gb)
                        if digest:
                            groups = hashlib.sha256(groups.encode()).hexdigest()
                        held.append((ta[la] * WIDTH + tb[lb]) << 16 | len(facts))
                        total += len(la)
                        fact = (ids[k], len(ta), len(tb), len(ga), len(la), groups)
                facts.append(fact)
                if total >= most_links or len(facts) == DOCS:
                    yield from flush()
                    container, facts, held, total = container + 1, [], [], 0
        if facts:
            yield from flush()

    return saved(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema), "align-postings")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, a, b, n_docs, n_links, best) of every id pair; ``best``: no pair of its B id has more links."""
    counts = saved(rows.where("pair is not null").groupBy("pair").agg(F.sum("docs").alias("n_docs"), F.sum("count").alias("n_links")), "align-pairs")
    named = counts.select("pair", F.shiftright("pair", 20).alias("a"), F.col("pair").bitwiseAND(WIDTH - 1).alias("b"), "n_docs", "n_links")
    # one row per id of the second vocabulary
    top = F.broadcast(named.groupBy("b").agg(F.max("n_links").alias("_top")))
    return named.join(top, "b").select("pair", "a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("_top")).alias("best"))


def scores(rows: DataFrame, pairs: DataFrame, max_broadcast: int = MAX_BROADCAST_PAIRS) -> DataFrame:
    """(container, ord, n_best, count_sum) of the documents that hold links."""
    counts = pairs.select("pair", F.col("n_links").alias("links"), F.col("best").cast("int").alias("best"))
    counts = F.broadcast(counts) if pairs.count() <= max_broadcast else counts.hint("merge")
    found = rows.where("pair is not null").select("container", "pair", "width", "planes").join(counts, "pair")
    dealt = found.drop("pair").repartition(parallelism(rows.sparkSession), "container").sortWithinPartitions("container")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, total = None, None, None

        def out() -> pa.RecordBatch:
            n = len(best)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, now, np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array(best), pa.array(total)],
                                              names=["container", "ord", "n_best", "count_sum"])

        for b in batches:
            container = b.column(0).to_numpy()
            cuts = np.r_[0, np.flatnonzero(container[1:] != container[:-1]) + 1, len(container)] if len(container) else [0]
            for x, y in zip(cuts[:-1], cuts[1:]):
                part = b.slice(x, y - x)
                width = part.column(1)[0].as_py()
                if container[x] != now:
                    if now is not None:
                        yield out()
                    now, best, total = container[x], np.zeros(width, np.int64), np.zeros(width, np.int64)
                bits = part.column(2)
                child = bits.values
                at = bits.offsets.to_numpy()
                offsets = np.frombuffer(child.buffers()[1], np.int32)[child.offset + at[0]: child.offset + at[-1] + 1].astype(np.int64)
                raw = child.buffers()[2]
                data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
                row, doc, plane = read_planes(at.astype(np.int64), offsets, data, width)
                times = np.int64(1) << plane
                count, top = part.column(3).to_numpy(), part.column(4).to_numpy()
                np.add.at(total, doc, times * count[row])
                np.add.at(best, doc, times * top[row])
        if now is not None:
            yield out()

    return dealt.mapInArrow(run, "container long, ord int, n_best long, count_sum long")


def align(docs: DataFrame, spec: str, model: bytes, id_col: str = "doc_id", text_col: str = "text", digest: bool = False,
          most_links: int = LINKS) -> DataFrame:
    """One row per row of ``docs``: (id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups).

    A is the byte-level tokenizer ``spec`` on a space and the text, B the SentencePiece ``model`` on the
    text.  ``groups`` is ``a1,a2|b1;...`` (its SHA-256 with ``digest``).  Null and empty texts, and texts
    whose tokens' bytes are not a space and the text, have zeros and empty groups and take no part in the
    counts.  Rows with equal or null ids are counted each by itself; other columns are ignored.  An empty
    table gives no rows.  One text is encoded, and its links held, in one task.
    """
    rows = postings(docs, spec, model, id_col, text_col, digest, most_links)
    found = scores(rows, pair_counts(rows))
    facts = rows.where("pair is null").select("container", "ord", "id", "n_a", "n_b", "n_groups", "n_links", "groups")
    zero = F.lit(0).cast("long")
    return facts.join(found, ["container", "ord"], "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups")

"""Line dedup: repeated runs of lines found by a suffix order over line ids; later copies go.

The corpus is a sequence of line ids (128-bit hashes), one end mark per document.  Prefix doubling
ranks the suffixes by their first 1, 2, 4, ... lines: a rank is the place in sorted order of the
pair (rank at i, rank at i + 2^k).  Only suffixes whose prefix occurs again stay in play, so the
tables shrink to the repeated lines, and pairs are counted before they are sorted.

Suffixes that share their first L lines form one longest-common-prefix interval of depth L; with
2^k <= L < 2^(k+1) its name is (L, rank_k at i, rank_k at i + L - 2^k).  A run counts from
``min_words`` words on.  For each line the shortest run of that many words that starts, and that
ends, there is looked up by its interval; a run whose interval has an earlier member is a later copy.
The union of these shortest runs is exactly the union of all repeated runs with enough words, as
every line of a longer run lies in a shortest run inside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, ordered_running_totals, release, saved

#: Words that a repeated run must have.
MIN_WORDS = 50
_AT = ["did", "dh", "pos"]
#: A null id sorts before all others.
_NO_ID = -(1 << 63)


def _keyed(docs: DataFrame, id_col: str, text_col: str, did: str = "_did", dh: str = "_dh") -> DataFrame:
    return docs.withColumns({did: F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), dh: F.xxhash64(F.col(text_col))})


def line_table(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """One row per line: document (did, dh), pos, line id (h1, h2), and the line counts of the shortest
    run of ``min_words`` words that starts (fwd) and that ends (bwd) at the line, 0 if there is none."""
    names = ["did", "dh", "pos", "h1", "h2", "fwd", "bwd"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            size = 0
            for did, dh, text in zip(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)):
                lines = text.as_py().encode().split(b"\n")
                n = len(lines)
                ids = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), np.int64).reshape(n, 2)
                upto = np.cumsum([0, *[len(x.split()) for x in lines]])
                at = np.arange(n)
                end = np.searchsorted(upto, upto[:-1] + min_words)          # first end with enough words
                start = np.searchsorted(upto, upto[1:] - min_words, "right") - 1  # last start with enough words
                cols = [np.full(n, did), np.full(n, dh), at, ids[:, 0], ids[:, 1],
                        np.where(end <= n, end - at, 0), np.where(start >= 0, at + 1 - start, 0)]
                for o, c in zip(out, cols):
                    o.append(c)
                size += n
                if size >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(np.int64)) for o in out], names=names)
                    out, size = [[] for _ in names], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(np.int64)) for o in out], names=names)

    schema = T.StructType([T.StructField(n, T.LongType()) for n in names])
    rows = _keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text").where("text is not null")
    return rows.select("_did", "_dh", "text").mapInArrow(run, schema)


def _ranked(rows: DataFrame, by: list[str], tag: str) -> DataFrame:
    """``rows`` whose ``by`` occurs at least twice, with ``rank``: the suffixes that sort before."""
    classes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    order = ordered_running_totals(classes, by, ["n"], tag).select(*by, F.col("n_before").alias("rank"))
    out = saved(rows.join(order, by), tag)
    out._llm_under = order
    return out


def repeated_runs(lines: DataFrame) -> DataFrame:
    """(did, dh, start, len) of every shortest run that is a later copy of an equal run.

    "Later": the earliest equal run is in another document (smaller id), or ends before this one starts.
    """
    active = _ranked(lines, ["h1", "h2"], "lines-rank").select(*_AT, "fwd", "bwd", "rank")
    windows = saved(active.where("fwd > 0").select("did", "dh", F.col("pos").alias("start"), F.col("fwd").alias("len"))
                    .unionByName(active.where("bwd > 0").select("did", "dh", (F.col("pos") - F.col("bwd") + 1).alias("start"), F.col("bwd").alias("len")))
                    .distinct(), "lines-windows")
    longest = windows.agg(F.max("len")).first()[0] or 0
    level, step, found = active.select(*_AT, "rank"), 1, []
    while step <= longest:
        w = windows.where((F.col("len") >= step) & (F.col("len") < 2 * step))
        head = level.select("did", "dh", F.col("pos").alias("start"), F.col("rank").alias("ra"))
        tail = level.select("did", "dh", F.col("pos").alias("last"), F.col("rank").alias("rb"))
        named = (w.join(head, ["did", "dh", "start"]).withColumn("last", F.col("start") + F.col("len") - step)
                 .join(tail, ["did", "dh", "last"]).select("did", "dh", "start", "len", "ra", "rb").distinct())
        interval = ["len", "ra", "rb"]
        first = (named.groupBy(*interval).agg(F.min(F.struct("did", "dh", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
        found.append(saved(named.join(first.drop("n"), interval).where(
            "did <> first.did or dh <> first.dh or start >= first.start + len").select("did", "dh", "start", "len"), "lines-copies"))
        if 2 * step > longest:
            break
        nxt = level.select("did", "dh", (F.col("pos") - step).alias("pos"), F.col("rank").alias("r2"))
        pairs = level.select(*_AT, F.col("rank").alias("r1")).join(nxt, _AT)
        level = _ranked(pairs, ["r1", "r2"], "lines-rank").select(*_AT, "rank")
        step *= 2
    out = windows.limit(0)
    for f in found:
        out = out.unionByName(f)
    return out


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text's later copies cut out, plus ``n_lines``, ``n_removed`` and
    ``removed``: the maximal removed runs as (start, end) line numbers.

    Earlier means a smaller id (null first; then the text's hash), then a smaller line number.  A null
    text stays null with 0 lines; an empty text is one empty line.  Rows that agree in id and text are
    one document and fare alike.  A text that loses all lines becomes empty.  Input columns of the three
    added names are replaced.
    """
    docs = docs.drop("n_lines", "n_removed", "removed")
    did, dh, runs_col = (fresh(docs, c) for c in ("_did", "_dh", "_runs"))
    lines = saved(line_table(docs, min_words, id_col, text_col), "lines")
    copies = repeated_runs(lines)
    per_doc = copies.groupBy("did", "dh").agg(F.collect_list(F.struct("start", "len")).alias("_runs"))
    per_doc = saved(per_doc.select(F.col("did").alias(did), F.col("dh").alias(dh), F.col("_runs").alias(runs_col)), "lines-runs")
    release(lines)
    # always a shuffle join: the plan, and so the growth of its work, is the same at every size
    rows = _keyed(docs, id_col, text_col, did, dh).join(per_doc.hint("merge"), [did, dh], "left").drop(did, dh)
    at = docs.columns.index(text_col)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("removed", span)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, n_lines, n_removed, removed = [], [], [], []
            for t, runs in zip(b.column(at), b.column(b.num_columns - 1).to_pylist()):
                t = t.as_py()
                n_lines.append(t.count("\n") + 1 if t is not None else 0)
                if not runs:
                    text.append(t)
                    n_removed.append(0)
                    removed.append([])
                    continue
                parts = t.split("\n")
                edge = np.zeros(len(parts) + 1, np.int64)
                np.add.at(edge, [r["start"] for r in runs], 1)
                np.add.at(edge, [r["start"] + r["len"] for r in runs], -1)
                gone = np.cumsum(edge)[:-1] > 0
                turn = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
                text.append("\n".join([p for p, g in zip(parts, gone) if not g]))
                n_removed.append(int(gone.sum()))
                removed.append([{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2])])
            cols = list(b.columns[:-1])
            cols[at] = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=schema.names)

    return rows.select(*docs.columns, runs_col).mapInArrow(cut, schema)

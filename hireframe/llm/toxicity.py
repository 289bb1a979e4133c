"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams (bytes of "<word>", n = 3..6,
and the whole word), hashed into a table, so an unseen misspelling shares most of its vector with
words that were seen.  A window of words is the mean of its words' vectors; a linear softmax gives
its class.  Table and softmax are trained together by AdaGrad on labelled windows: first every
window has its document's label, then of a toxic document only its most toxic windows do.  A
document's logit is that of its most toxic window (every window of the whole text is looked at), and
a logistic curve fitted on other labelled documents makes it a probability.

The bounded sample is trained on in one task of the cluster; the driver sees the model alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, release, saved
from .hashing import U, Words, mix, text_runs
from .labelled import calibrate, labelled_sample

#: Bounds of the fit: labelled rows of each class, and bytes of their texts (every window of a chosen row's whole
#: text is used; a text of more than a quarter of the bytes is not chosen).
ROWS_PER_CLASS = 4000
BYTES_PER_CLASS = 48 << 20
WINDOW = 8
BUCKETS = 1 << 16
DIM = 8
SIZES = (3, 4, 5, 6)
_STEP = np.random.default_rng(3).integers(1, 1 << 62, max(SIZES), dtype=np.uint64) * U(2) + U(1)


def subwords(words: Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the subwords of the picked words, and where each word's rows start (plus the end)."""
    lens = (words.ends - words.starts)[pick]
    width = lens + 2
    first = np.cumsum(width) - width
    total = int(width.sum())
    own = np.repeat(np.arange(len(pick)), width)
    at = np.arange(total) - first[own]
    raw = np.full(total, ord("<"), np.uint64)
    inside = (at > 0) & (at <= lens[own])
    raw[inside] = words.data[words.starts[pick][own[inside]] + at[inside] - 1]
    raw[at == width[own] - 1] = ord(">")
    owners, rows = [np.arange(len(pick))], [words.hashes[pick] % U(BUCKETS)]
    for n in SIZES:
        ok = np.flatnonzero(at + n <= width[own])
        if not len(ok):
            continue
        h = np.zeros(len(ok), np.uint64)
        for j in range(n):
            h += raw[ok + j] * _STEP[j]
        rows.append(mix(h + U(n)) % U(BUCKETS))
        owners.append(own[ok])
    owner, row = np.concatenate(owners), np.concatenate(rows).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return row[order], np.r_[0, np.cumsum(np.bincount(owner, minlength=len(pick)))]


@dataclass
class Model:
    table: np.ndarray      # BUCKETS x DIM
    weight: np.ndarray     # DIM x 2
    bias: np.ndarray       # 2

    def row_scores(self) -> np.ndarray:
        """Logit share (toxic minus not) of each table row: averaging is linear, so words need only this."""
        return self.table.astype(np.float64) @ (self.weight[:, 1] - self.weight[:, 0]).astype(np.float64)


def _vocabulary(texts: list[str], size: int = 2000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word number of every word of the texts, words per text, and the table rows of each different
    word with their bounds; texts are read in small runs, and a word's rows are made when it is first met."""
    hashes, counts, rows, lens = [], [], [], []
    known = np.zeros(0, np.uint64)
    found = []
    for a in range(0, len(texts), size):
        data = [t.encode().lower() for t in texts[a: a + size]]
        words = Words(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        new, first = np.unique(words.hashes, return_index=True)
        at = np.searchsorted(known, new)
        fresh_ = known[np.minimum(at, max(len(known) - 1, 0))] != new if len(known) else np.ones(len(new), bool)
        r, c = subwords(words, first[fresh_])
        hashes.append(words.hashes), counts.append(words.counts), found.append(new[fresh_]), rows.append(r.astype(np.int32)), lens.append(np.diff(c))
        known = np.union1d(known, new[fresh_])
    every = np.concatenate(found)
    order = np.argsort(every, kind="stable")
    lens, rows = np.concatenate(lens), np.concatenate(rows)
    starts, pick = (np.cumsum(lens) - lens)[order], lens[order]
    out, into = np.empty(len(rows), np.int32), np.cumsum(pick) - pick
    for k in range(0, len(order), 1 << 16):                # by runs of words, so the index arrays stay small
        n = pick[k: k + (1 << 16)]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[into[k]: into[k] + len(at)] = rows[np.repeat(starts[k: k + (1 << 16)], n) + at]
    ids = np.concatenate([np.searchsorted(known, h).astype(np.int32) for h in hashes])
    return ids, np.concatenate(counts), out, np.r_[0, np.cumsum(pick)]


def train(texts: list[str], y: np.ndarray, owner: np.ndarray, epochs: tuple[int, int] = (3, 4), seed: int = 8, batch: int = 256,
          rate: float = 0.1) -> Model:
    """Joint training on windows: ``owner`` names each window's document."""
    rng = np.random.default_rng(seed)
    model = Model((rng.standard_normal((BUCKETS, DIM)) * 0.05).astype(np.float32), np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32))
    model.weight[:] = rng.standard_normal((DIM, 2)) * 0.05
    if not len(texts) or len(np.unique(y)) < 2:
        return model
    ids, counts, rows, cuts = _vocabulary(texts)
    size = np.diff(cuts)
    bounds = np.r_[0, np.cumsum(counts)]
    sums = [np.full_like(p, 1e-8) for p in (model.table, model.weight, model.bias)]
    target = y.copy()
    usable = np.flatnonzero(counts > 0)

    def step(win: np.ndarray, share: np.ndarray) -> None:
        n = counts[win]
        pos = np.repeat(bounds[:-1][win] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        w, back = np.unique(ids[pos], return_inverse=True)
        k = size[w]
        sub = rows[np.repeat(cuts[:-1][w] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
        vec = np.add.reduceat(model.table[sub], np.cumsum(k) - k) / k[:, None]
        bag = np.add.reduceat(vec[back], np.cumsum(n) - n) / n[:, None]
        logit = bag @ model.weight + model.bias
        p = np.exp(logit - logit.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(win)), target[win]] -= 1
        p *= share[win][:, None] / share[win].sum()
        g_bag = (p @ model.weight.T) / n[:, None]
        g_word = np.zeros((len(w), DIM), np.float32)
        owner_of = np.repeat(np.arange(len(win)), n)
        for j in range(DIM):
            g_word[:, j] = np.bincount(back, g_bag[owner_of, j], minlength=len(w))
        g_word /= k[:, None]
        u, inv = np.unique(sub, return_inverse=True)
        src = np.repeat(np.arange(len(w)), k)
        g_row = np.stack([np.bincount(inv, g_word[src, j], minlength=len(u)) for j in range(DIM)], 1).astype(np.float32)
        for part, total, grad, at in ((model.table, sums[0], g_row, u), (model.weight, sums[1], bag.T @ p, slice(None)), (model.bias, sums[2], p.sum(0), slice(None))):
            total[at] += grad ** 2
            part[at] -= rate * grad / np.sqrt(total[at])

    for phase, rounds in enumerate(epochs):
        pool = usable
        if phase:
            # of a toxic document only the most toxic windows stay positive, the others have no label
            s = np.add.reduceat(model.row_scores()[rows], cuts[:-1]) / size
            run = np.r_[0, np.cumsum(s[ids])]
            z = (run[bounds[1:]] - run[bounds[:-1]]) / np.maximum(counts, 1)
            top = np.full(int(owner.max()) + 1, -np.inf)
            np.maximum.at(top, owner[usable], z[usable])
            pool = usable[(y[usable] == 0) | (z[usable] >= top[owner[usable]] - 1e-9)]
        share = np.zeros(len(y), np.float32)
        share[pool] = np.where(y[pool] == 1, 0.5 / max(1, (y[pool] == 1).sum()), 0.5 / max(1, (y[pool] == 0).sum())) * len(pool)
        for _ in range(rounds):
            order = rng.permutation(pool)
            for a in range(0, len(order), batch):
                step(order[a: a + batch], share)
    return model


def trained(windows: DataFrame) -> Model:
    """The model of the windows (id, at, y, words) of a sample that is bounded in rows and bytes, so that
    one task may hold it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("id", pa.int64()), ("at", pa.int64()), ("y", pa.int32()), ("words", pa.string())])
        got = pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, names=kinds.names) for b in batches], kinds)
        got = got.sort_by([("id", "ascending"), ("at", "ascending"), ("words", "ascending")])
        _, owner = np.unique(got.column("id").to_numpy(), return_inverse=True)
        m = train(got.column("words").to_pylist(), got.column("y").to_numpy().astype(np.int64), owner)
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float32).tobytes()]) for x in (m.table, m.weight, m.bias)], names=["table", "weight", "bias"])

    m = windows.repartition(1).mapInArrow(run, "table binary, weight binary, bias binary").first()
    return Model(*[np.frombuffer(m[c], np.float32).reshape(shape) for c, shape in (("table", (BUCKETS, DIM)), ("weight", (DIM, 2)), ("bias", (2,)))])


def window_logits(words: Words, scores: np.ndarray, bias: float, window: int = WINDOW) -> np.ndarray:
    """Largest window logit of each text; a text shorter than a window is one window, an empty one has the bias."""
    _, firsts, ids = np.unique(words.hashes, return_index=True, return_inverse=True)
    out = np.full(len(words.counts), bias)
    if not len(firsts):
        return out
    rows, cuts = subwords(words, firsts)
    s = np.add.reduceat(scores[rows], cuts[:-1]) / np.diff(cuts)
    run = np.r_[0.0, np.cumsum(s[ids])]
    last = np.repeat(words.bounds[1:], words.counts)
    at = np.arange(len(ids))
    long_ = np.repeat(words.counts >= window, words.counts)
    begin = np.where(long_, np.minimum(at, last - window), np.repeat(words.bounds[:-1], words.counts))
    n = np.where(long_, window, np.repeat(words.counts, words.counts))
    mean = (run[begin + n] - run[begin]) / n
    some = words.counts > 0
    out[some] += np.maximum.reduceat(mean, words.bounds[:-1][some])
    return out


def logits(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "z", window: int = WINDOW) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])
    scores, bias = model.row_scores(), float(model.bias[1] - model.bias[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = [window_logits(words, scores, bias, window) for _, _, words in text_runs(b.column(b.schema.get_field_index(text_col)), lower=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([*z, np.zeros(0)]))], names=schema.names)

    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, keep: Column, label_col: str = "toxic", id_col: str = "doc_id",
        text_col: str = "text", rows_per_class: int = ROWS_PER_CLASS, bytes_per_class: int = BYTES_PER_CLASS):
    """(model, curve) from the whole texts of at most ``rows_per_class`` labelled rows and ``bytes_per_class``
    bytes of each class, in a seeded order."""
    sample, counts = labelled_sample(labels, label_col, keep, rows_per_class, id_col)
    texts = saved(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
                  .withColumn("_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
                  .where(F.col("_bytes") <= bytes_per_class // 4), "toxic-sample")
    seeded = Window.partitionBy("y").orderBy(F.xxhash64("id", F.lit(5)), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chosen = texts.select("id", "y", "_bytes").withColumn("_sum", F.sum("_bytes").over(seeded)).where(F.col("_sum") <= bytes_per_class).select("id").distinct()
    texts_of = lambda part: texts.where(F.col("part") == part).join(chosen, "id", "left_semi")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, y in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                words = (t.as_py() or "").split()
                rows += [(i, k // WINDOW, y, " ".join(words[k: k + WINDOW])) for k in range(0, len(words), WINDOW)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(
                (pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["id", "at", "y", "words"])

    model = trained(texts_of(0).select(F.col("id").cast("long"), "text", F.col("y").cast("int"))
                    .mapInArrow(windows, "id long, at long, y int, words string"))
    rest = logits(texts_of(1).select("id", "y", "text"), model).select("id", "z", "y").collect()
    rest.sort(key=lambda r: (r["id"], r["z"]))
    release(texts, sample)
    return model, calibrate(np.array([r["z"] for r in rest]), np.array([r["y"] for r in rest]), counts)


def score(docs: DataFrame, model: Model, curve, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """All columns of ``docs`` plus the probability of label 1 (replacing a column of that name).  Null and empty texts have no window: the bias alone."""
    docs, z = docs.drop(out_col), fresh(docs, "_z")
    slope, offset, scale = curve
    rows = logits(docs, model, text_col, z)
    m = F.least(F.greatest(F.col(z) * (slope / scale) + offset, F.lit(-35.0)), F.lit(35.0))
    return rows.withColumn(out_col, 1 / (1 + F.exp(-m))).drop(z)

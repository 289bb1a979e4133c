"""Quality classifier by compression with dictionaries of good and of bad text.

Two zstandard dictionaries are built from labelled good and bad text.  A text is cut into blocks,
each block is compressed with either dictionary, and the normalised difference of the total sizes
(bad minus good, over their sum) becomes a probability by a logistic curve fitted on other labelled
rows.  Blocks keep the dictionaries' say equal in short and long texts; every byte of a text counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh
from .labelled import calibrate, labelled_sample

#: Bound of the fit: labelled rows of each class (every block of their texts is used).  Bytes of a block and of a dictionary.
ROWS_PER_CLASS = 4000
BLOCK = 2048
DICTIONARY = 65536


def _blocks(text: str) -> list[bytes]:
    data = text.encode("utf-8", "replace")
    return [data[i: i + BLOCK] for i in range(0, len(data), BLOCK)]


class TwoDictionaries:
    """Sizes of a text under the good and the bad dictionary; ``model`` is their bytes."""

    def __init__(self, model: tuple[bytes, bytes]):
        self.tools = []
        for data in model:
            d = zstandard.ZstdCompressionDict(data) if data else None
            self.tools.append(zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=False, write_content_size=False))

    def difference(self, text: str | None) -> float:
        """(bad size - good size) / (bad size + good size); 0 for an empty text."""
        parts = _blocks(text) if text else []
        good, bad = (sum(len(t.compress(p)) for p in parts) for t in self.tools)
        return (bad - good) / (bad + good) if good + bad else 0.0


def differences(docs: DataFrame, model: tuple[bytes, bytes], text_col: str = "text", out_col: str = "z") -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = TwoDictionaries(model)
        for b in batches:
            z = [two.difference(t.as_py()) for t in b.column(b.schema.get_field_index(text_col))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(z, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def build_dictionary(blocks: list[bytes], size: int = DICTIONARY) -> bytes:
    """A zstandard dictionary of the blocks; with too few to train on, none."""
    if sum(map(len, blocks)) < 2 * size:
        size = max(1024, sum(map(len, blocks)) // 8)
    try:
        return zstandard.train_dictionary(size, blocks, level=3, notifications=0, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b""


def fit(docs: DataFrame, labels: DataFrame, keep: Column, label_col: str = "quality", id_col: str = "doc_id",
        text_col: str = "text", rows_per_class: int = ROWS_PER_CLASS):
    """(dictionaries, curve) from the whole texts of at most ``rows_per_class`` labelled rows of each class."""
    sample, counts = labelled_sample(labels, label_col, keep, rows_per_class, id_col)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, y in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                rows += [(i, n, y, part) for n, part in enumerate(_blocks(t.as_py() or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(
                (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["id", "at", "y", "block"])

    rows = (texts.where("part = 0").select(F.col("id").cast("long"), "text", F.col("y").cast("int"))
            .mapInArrow(blocks, "id long, at long, y int, block binary").collect())
    rows.sort(key=lambda r: (r["id"], r["at"], r["block"]))
    model = tuple(build_dictionary([bytes(r["block"]) for r in rows if r["y"] == y]) for y in (1, 0))
    got = differences(texts.where("part = 1").select("id", "y", "text"), model).select("id", "z", "y").collect()
    got.sort(key=lambda r: (r["id"], r["z"]))
    curve = calibrate(np.array([r["z"] for r in got]), np.array([r["y"] for r in got]), counts)
    return model, curve


def score(docs: DataFrame, model, curve, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """All columns of ``docs`` plus the probability of label 1 (replacing a column of that name).  Empty and null texts have difference 0."""
    docs, z = docs.drop(out_col), fresh(docs, "_z")
    slope, offset, scale = curve
    rows = differences(docs, model, text_col, z)
    m = F.least(F.greatest(F.col(z) * (slope / scale) + offset, F.lit(-35.0)), F.lit(35.0))
    return rows.withColumn(out_col, 1 / (1 + F.exp(-m))).drop(z)



"""File sources and sinks.

Text columns may hold newlines and quotes, so CSV is written and read with
``multiLine`` and ``escape='"'``; schemas are always explicit.
"""

from __future__ import annotations

import bz2
import gzip
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import newline_to_space
from ..session import shared_path, ship_code

INDUSTRY_TRAIN_SCHEMA = "uniq_id string, employer_description string, company_name string, industry string"
LANGUAGE_SCHEMA = "labels string, text string"
#: The folder of a null or empty partition value.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
#: Bytes of texts that a task reads before it hands them on.
READ_BYTES = 1 << 22
#: Packed files that Spark's text reader opens by their names.
PACKED = {b".gz": gzip.open, b".bz2": bz2.open}


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Header CSV with multi-line quoted fields."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> str:
    """Persist a DataFrame (parquet by default, CSV with header and escaping)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)
    return path


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder (never a machine-local folder)."""
    return shared_path(spark, "tables", f"{name}-{uuid.uuid4().hex}")


def read_text_postings(spark: SparkSession, path: str) -> DataFrame:
    """One file = one posting; newlines become spaces.

    Returns (file_name, company_name, job_description), company_name being the
    file name without extension and with '_' as space.
    """
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file_name"))
    stem = F.regexp_replace(F.col("file_name"), r"\.[^.]*$", "")
    return raw.select("file_name", F.replace(stem, F.lit("_"), F.lit(" ")).alias("company_name"),
                      newline_to_space("value").alias("job_description"))


def folder_name(value: str | None) -> str:
    """The folder of a partition value, escaped as Spark escapes it."""
    if not value:
        return NULL_FOLDER
    return "".join(f"%{ord(c):02X}" if c < " " or c in "\"#%'*/:=?\\{[]^\x7f" else c for c in value)


def write_text_postings(df: DataFrame, path: str, name_col: str, text_col: str) -> str:
    """One text file for every row, in a folder named by ``name_col`` (the layout :func:`read_posting_folders`
    reads).  Small files are what this format is; tables belong in :func:`write_table`.

    In a shared folder that is mounted on every machine the tasks write the files themselves: Hadoop's
    local file system starts two processes to set permissions for each file, and its commit moves every
    folder on the driver.  A file appears whole under a name given by its task and its number among the
    task's files of that name, so a task that runs again replaces its files.  Other stores get them by
    Spark's writer."""
    rows = df.select(F.col(name_col).cast("string").alias("posting"), F.col(text_col).alias("value"))
    where = urlsplit(path)
    if where.scheme not in ("", "file"):
        rows.write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("posting").text(path)
        return path
    # Spark clears the folder and makes it
    rows.sparkSession.createDataFrame([], "posting string, value string").write.mode("overwrite").partitionBy("posting").text(path)
    base = unquote(where.path) if where.scheme else path

    def run(batches):
        task, seen, n = TaskContext.get(), Counter(), 0
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                folder = f"{base}/posting={folder_name(name)}"
                file = f"part-{task.partitionId():05d}-{seen[name]:03d}.txt"
                seen[name] += 1
                os.makedirs(folder, exist_ok=True)
                hidden = f"{folder}/_{file}.{task.taskAttemptId()}"
                with open(hidden, "wb") as f:
                    f.write((text or b"") + b"\n")
                os.replace(hidden, f"{folder}/{file}")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    ship_code(df.sparkSession)
    rows.select("posting", F.col("value").cast("binary")).mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return path


def posting_of(folder: str) -> str | None:
    """The partition value of a folder's name, as Spark reads it (see :func:`folder_name`)."""
    value = folder.partition("=")[2]
    return None if value == NULL_FOLDER else re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), value)


def _files_below(folder: bytes) -> Iterator[bytes]:
    """Files that Spark reads as data: neither hidden nor empty."""
    for top, folders, names in os.walk(folder):
        hidden = lambda n: n.startswith(b".") or n.startswith(b"_") and b"=" not in n or n.endswith(b"._COPYING_")
        folders[:] = sorted(n for n in folders if not hidden(n))
        for n in sorted(names):
            if not hidden(n) and os.path.getsize(os.path.join(top, n)):
                yield os.path.join(top, n)


def _folder_rows(spark: SparkSession, base: str) -> DataFrame:
    """(posting, value) of the files in the folders ``posting=...`` of ``base``.

    The driver lists nothing: one task streams the folders' names, which are dealt to tasks that list
    each folder and read its files."""
    def folders(_):
        names = (e.name for e in os.scandir(os.fsencode(base)) if e.name.startswith(b"posting=") and e.is_dir())
        while some := list(islice(names, 10_000)):
            yield pa.RecordBatch.from_pydict({"folder": pa.array(some, pa.binary())})

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.binary()))],
                                          names=["posting", "value"])

    def texts(batches):
        rows, held = [], 0
        for b in batches:
            for folder in b.column(0).to_pylist():
                posting = posting_of(folder.decode("utf-8", "replace"))
                for file in _files_below(os.path.join(os.fsencode(base), folder)):
                    with PACKED.get(os.path.splitext(file)[1], open)(file, "rb") as f:
                        rows.append((posting, f.read()))
                    held += len(rows[-1][1])
                    if held > READ_BYTES or len(rows) == 10_000:
                        yield batch(rows)
                        rows, held = [], 0
        yield batch(rows)

    ship_code(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = spark.range(0, 1, 1, 1).mapInArrow(folders, "folder binary").repartition(n, "folder")
    return dealt.mapInArrow(texts, "posting string, value binary").select("posting", F.col("value").cast("string").alias("value"))


def read_posting_folders(spark: SparkSession, path: str) -> DataFrame:
    """S7 with the names in folders: (posting, job_description), one row for every file below ``path``;
    newlines become spaces (F6).  A null name stays null, a null text reads as an empty line.

    In a shared folder that is mounted the tasks list and read the files: Spark's file index holds
    each of them, with its folder's value, in the driver.  Other stores are read by Spark."""
    where = urlsplit(path)
    base = unquote(where.path) if where.scheme else path
    if where.scheme in ("", "file") and os.path.isdir(base):
        raw = _folder_rows(spark, base)
    else:
        raw = spark.read.schema("value string, posting string").text(path, wholetext=True)
    return raw.select("posting", newline_to_space("value").alias("job_description"))


def read_splits(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet",
                schema: str | None = None) -> DataFrame:
    """Read every named split and stack them with a ``partition`` column."""
    out = None
    for name, p in paths.items():
        r = spark.read.format(fmt)
        if schema:
            r = r.schema(schema)
        if fmt == "csv":
            r = r.option("header", True).option("multiLine", True).option("escape", '"')
        df = r.load(p).withColumn("partition", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def save_vocabulary(vocab: DataFrame, path: str) -> str:
    """Write D9 (token, id)."""
    vocab.write.mode("overwrite").parquet(path)
    return path


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Read a saved vocabulary for encoding new text."""
    return spark.read.schema("token string, id int").parquet(path)


def peek(df: DataFrame, n: int = 5) -> DataFrame:
    """The first rows (for display)."""
    return df.limit(n)

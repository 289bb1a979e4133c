import bz2
import gzip
import os

from pyspark.sql import functions as F

from hireframe.plans import catalog
from hireframe.sources import files

from tests.conftest import SF_SMALL

ODD = ["p1", "a/b c", "x=1:2", "50%", "a#b?c", "{x}[y]^", "tab\there", "quo'te\"d", "back\\slash", "é 🙂", "007", " ", "-", "~", "del\x7f"]


def test_folders_are_named_as_spark_names_them(spark, tmp_path):
    rows = spark.createDataFrame([(n, "t") for n in [*ODD, "", None]], "posting string, value string")
    rows.write.partitionBy("posting").text(str(tmp_path / "spark"))
    by_spark = {d for d in os.listdir(tmp_path / "spark") if d.startswith("posting=")}
    assert by_spark == {f"posting={files.folder_name(n)}" for n in [*ODD, "", None]}


def test_every_row_has_a_file_and_old_files_go(spark, tmp_path):
    path = f"file:{tmp_path}/posts"
    old = spark.createDataFrame([("gone", "old")], "posting string, text string")
    files.write_text_postings(old, path, "posting", "text")
    rows = [(n, f"text of {n}\nend") for n in ODD] + [("twice", "same"), ("twice", "same"), ("twice", None)]
    df = spark.createDataFrame(rows, "posting string, text string").repartition(3)
    files.write_text_postings(df, path, "posting", "text")
    got = sorted(map(tuple, files.read_posting_folders(spark, path).collect()))
    assert got == sorted((n, (t or "").replace("\n", " ") + " ") for n, t in rows)
    names = [f for _, _, fs in os.walk(tmp_path / "posts") for f in fs if f.endswith(".txt")]
    assert len(names) == len(rows)


def test_tasks_write_the_files_and_the_driver_moves_none(spark, tmp_path):
    """Files of Hadoop's writer carry a checksum file each; those of the tasks do not."""
    files.write_text_postings(spark.range(20).select(F.col("id").alias("n"), F.lit("x").alias("t")), str(tmp_path / "p"), "n", "t")
    names = [f for d, _, fs in os.walk(tmp_path / "p") for f in fs if "posting=" in d]
    assert len(names) == 20 and not [f for f in names if f.endswith(".crc")]


def test_tasks_list_the_files_and_the_driver_none(spark, tmp_path):
    """A file index holds every file in the driver; without one the plan has no scan of files."""
    path = files.write_text_postings(spark.range(20).select(F.col("id").alias("n"), F.lit("x").alias("t")), str(tmp_path / "p"), "n", "t")
    df = files.read_posting_folders(spark, path)
    assert df.inputFiles() == [] and "FileScan" not in df._jdf.queryExecution().toString()
    assert sorted(map(tuple, df.collect())) == sorted((str(i), "x ") for i in range(20))


def test_folders_are_read_as_spark_reads_them(spark, tmp_path, monkeypatch):
    """Hidden, empty, nested and packed files, bytes that are no text, odd names and no folder at all."""
    monkeypatch.setattr(files, "READ_BYTES", 10)
    for i, name in enumerate([*ODD, None]):
        folder = tmp_path / "p" / f"posting={files.folder_name(name)}"
        (folder / "sub").mkdir(parents=True)
        for file, data in (("a.txt", f"one {i}\ntwo\r\n".encode()), ("_a.txt", b"hidden"), (".a", b"hidden"), ("b._COPYING_", b"hidden"), ("none.txt", b""),
                           ("bytes", b"\xff\xfe \x00 z\n"), ("a.gz", gzip.compress(b"packed\n")), ("a.bz2", bz2.compress(b"packed too"))):
            (folder / file).write_bytes(data)
    (tmp_path / "p" / "_SUCCESS").write_bytes(b"")
    (tmp_path / "p" / "posting=50%zz%4").mkdir()
    (tmp_path / "p" / "posting=50%zz%4" / "x").write_bytes(b"x")
    got = files.read_posting_folders(spark, str(tmp_path / "p")).select("posting", F.hex("job_description")).collect()
    by_spark = spark.read.schema("value string, posting string").text(str(tmp_path / "p"), wholetext=True)
    want = by_spark.select("posting", F.hex(F.replace("value", F.lit("\n"), F.lit(" ")))).collect()
    assert sorted((str(p), h) for p, h in got) == sorted((str(p), h) for p, h in want) and len(got) == 4 * len(ODD) + 5
    (tmp_path / "empty").mkdir()
    assert files.read_posting_folders(spark, str(tmp_path / "empty")).count() == 0


def test_prediction_of_text_files_needs_no_file_index(spark):
    df = catalog.QUERIES["predict_text_files"](spark, SF_SMALL)
    assert not [f for f in df.inputFiles() if "posting_files" in f]
    want = catalog.posting_files(spark, SF_SMALL).select("posting").collect()
    assert sorted(r["posting"] for r in df.collect()) == sorted(r["posting"] for r in want) and want

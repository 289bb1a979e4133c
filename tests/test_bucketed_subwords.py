"""Bucketed tables, truncation by subwords, copies of drawn rows in pieces."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
from hireframe.functions.subwords import first_subwords
from hireframe.operators import sampling
from hireframe.sources import bucketed, postings
from tests.conftest import SF_SMALL

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_join_has_no_exchange(spark):
    df = E.queries()["bucketed_postings"](spark, SF_SMALL)
    plan = _plan(df)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    plain = postings.get_postings(*(E.catalog.fx.job_postings(spark, SF_SMALL), E.catalog.fx.position_characteristics(spark, SF_SMALL)),
                                  institution_name=True)
    assert df.exceptAll(plain).isEmpty() and plain.exceptAll(df).isEmpty()


def test_bucketed_null_repeated_and_empty(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3), ("b", 4)], "k string, n int")
    right = spark.createDataFrame([(None, 7), ("a", 8), ("a", 9)], "k string, m int")
    read = lambda df, name: bucketed.read_bucketed(spark, bucketed.write_bucketed(df, name, "k", 5))
    got = read(left, "left").join(read(right, "right"), "k", "left")
    assert sorted((r.n, r.m) for r in got.where("m is not null").collect()) == [(2, 8), (2, 9), (3, 8), (3, 9)]
    assert sorted(r.n for r in got.where("m is null").collect()) == [1, 4]
    assert read(left.limit(0), "none").count() == 0


@pytest.mark.parametrize("n", [0, 1, 3, 128])
def test_first_subwords_is_the_longest_text_of_n_subwords(spark, n):
    texts = ["", None, "one", "Grüße an alle Äpfel \U0001f600\U0001f600 und mehr", "  blanks   and\n\nlines ", "word " * 300, "x" * 5000, "é" * 9]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.cut for r in df.select("i", first_subwords(F.col("t"), PATH, n).alias("cut")).collect()}
    tokenizer = Tokenizer.from_file(PATH)
    for i, t in enumerate(texts):
        if not t:
            assert got[i] == t
            continue
        code = tokenizer.encode(t, add_special_tokens=False)
        if len(code.ids) <= n:
            assert got[i] == t
            continue
        assert t.startswith(got[i])
        # brute force: the shortest beginning of the text that holds the bytes of its first n subwords
        wanted = sum(len(tokenizer.decode([x]).encode("utf-8", "replace")) if "�" not in tokenizer.decode([x]) else 0 for x in code.ids[:n])
        if t.isascii():
            assert len(got[i]) == wanted
        else:
            assert code.offsets[n - 1][1] <= len(got[i]) if n else got[i] == ""


def test_predict_subwords_follows_the_cut(spark):
    flows, cat = E.catalog.flows, E.catalog
    model = cat.industry_model(spark, SF_SMALL)
    some = cat.unique_postings(spark, SF_SMALL)
    got = {(r.uniq_id, r.company_name): r.prediction for r in E.queries()["predict_subwords"](spark, SF_SMALL).collect()}
    # the same, with the texts cut here one by one
    tokenizer = Tokenizer.from_file(PATH)
    desc = cat.extract_employer_description(some, text_col="job_description", name_col="company_name").select(
        "uniq_id", "company_name", cat.P.default_text("employer_description").alias("d")).collect()
    assert any(len(tokenizer.encode(r.d, add_special_tokens=False).ids) > 128 for r in desc)
    cut = []
    for r in desc:
        code = tokenizer.encode(r.d, add_special_tokens=False)
        cut.append((r.uniq_id, r.company_name, r.d if len(code.ids) <= 128 else r.d[: code.offsets[127][1]]))
    rows = spark.createDataFrame(cut, "uniq_id string, company_name string, d string").withColumn("_toks", cat.T.word_tokens("d"))
    want = {(r.uniq_id, r.company_name): r.prediction
            for r in cat.classify.predict(model, rows, ["uniq_id", "company_name"], tokens_col="_toks").collect()}
    assert got == want and flows.MODEL_MAX_TOKENS == 128


def test_copies_leave_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sampling, "COPIES_PER_PIECE", 4)
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    got = sampling.sample_with_replacement(df, 50, "k", copy_col="copy").collect()
    per = {}
    for r in got:
        per.setdefault(r.k, []).append(r.copy)
    assert len(got) == 50 and all(sorted(v) == list(range(len(v))) for v in per.values()) and max(map(len, per.values())) > 4

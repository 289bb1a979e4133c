import pytest
from pyspark.sql import functions as F

from hireframe.operators import vocabulary as V
from hireframe.operators.extraction import extract_employer_description, pandas_scorer


def docs(spark):
    rows = [(1, "the cat's mat, the end"), (2, None), (3, ""), (4, "éa 漢字 \U0001F642 the"), (5, "word " * 5000), (6, "unseen tokens only zzz"), (7, "\"quoted\" \\ back")]
    return spark.createDataFrame(rows, "k int, text string")


@pytest.mark.parametrize("length", [None, 4])
def test_in_row_equals_the_join(spark, monkeypatch, length):
    df = docs(spark)
    vocab = V.build_vocabulary(df.where("k <> 6"), "k", "text", 50)
    inside = V.encode_tokens(df, "k", "text", vocab, sequence_length=length)
    plan = inside._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    one = sorted(map(tuple, inside.collect()))
    monkeypatch.setattr(V, "MAX_IN_ROW_TOKENS", 0)
    assert sorted(map(tuple, V.encode_tokens(df, "k", "text", vocab, sequence_length=length).collect())) == one
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    assert dict(one)[1][:4] == [ids["the"], ids["cats"], ids["mat"], ids["the"]] and dict(one)[6][:2] == [1, 1]


def test_bounds_of_the_constant(spark):
    vocab = spark.createDataFrame([("a", 2), ("b" * 100, 3)], "token string, id int")
    assert V.in_row_table(vocab) is not None
    assert V.in_row_table(vocab, max_rows=1) is None and V.in_row_table(vocab, max_bytes=100) is None
    words = spark.createDataFrame([(["a", None, "x", "b" * 100],), (None,), ([],)], "w array<string>")
    assert [r[0] for r in words.select(V.token_ids(F.col("w"), V.in_row_table(vocab))).collect()] == [[2, 1, 1, 3], None, []]
    assert [r[0] for r in words.select(V.token_ids(F.col("w"), V.in_row_table(vocab.limit(0)))).collect()] == [[1, 1, 1, 1], None, []]


def test_scorer_keeps_rows_of_one_posting_apart(spark):
    text = "Acme makes tools. We are a company. Our mission is growth. Globex sells. Nothing else."
    rows = [("p1", "acme", text), ("p1", "globex", text), ("p1", "acme", text), ("p2", None, None), ("p3", "x", "")]
    df = spark.createDataFrame(rows, "uniq_id string, company_name string, job_description string")
    scorer = pandas_scorer(lambda sentences, labels: ["who we are" if "We are" in s or "Globex" in s else "other" for s in sentences])
    got = sorted((r.uniq_id, r.company_name or "", r.employer_description, tuple(r.retrieved_by)) for r in extract_employer_description(df, scorer=scorer).collect())
    acme = ("p1", "acme", "Acme makes tools. We are a company. Globex sells.", ("name", "zsc"))
    assert got == [acme, acme, ("p1", "globex", "Globex sells. We are a company.", ("name", "zsc")), ("p2", "", None, ()), ("p3", "x", None, ())]

from pyspark.sql import functions as F

from hireframe.functions.text import (blind_names, pad_ids, split_sentences, word_tokens)
from hireframe.operators.extraction import (extract_employer_description, residual_sentences,
                                            sentences_by_name)


def one(spark, expr, data, schema):
    return spark.createDataFrame(data, schema).select(expr.alias("x")).collect()


def test_sentence_split(spark):
    rows = one(spark, split_sentences("t"), [("Hello world. Second one!  Third?\nFourth",), (None,)], "t string")
    assert rows[0].x == ["Hello world.", "Second one!", "Third?", "Fourth"]
    assert rows[1].x == []


def test_name_case_default_and_compat(spark):
    data = [("Acme hires. Nothing else.", "Acme")]
    df = spark.createDataFrame(data, "t string, n string")
    s = split_sentences("t")
    r = df.select(sentences_by_name(s, F.col("n")).alias("a"),
                  sentences_by_name(s, F.col("n"), compat=True).alias("b")).first()
    assert r.a == "Acme hires."
    assert r.b == ""


def test_empty_name_never_matches_by_default(spark):
    df = spark.createDataFrame([("A. B.", "")], "t string, n string")
    s = split_sentences("t")
    r = df.select(sentences_by_name(s, F.col("n")).alias("a"),
                  sentences_by_name(s, F.col("n"), compat=True).alias("b")).first()
    assert r.a == "" and r.b == "A. B."


def test_blinding_is_case_sensitive(spark):
    df = spark.createDataFrame([("Acme and acme", "acme"), ("x y", ""), ("z", None)], "d string, n string")
    got = [r.x for r in df.select(blind_names("d", "n", "this company").alias("x")).collect()]
    assert got == ["Acme and this company", "x y", "z"]
    ci = df.select(blind_names("d", "n", "this company", case_insensitive=True).alias("x")).first().x
    assert ci == "this company and this company"


def test_residual_drops_all_duplicates(spark):
    df = spark.createDataFrame([(["A.", "B.", "A."], "A.")], "s array<string>, d string")
    r = df.select(residual_sentences(F.col("s"), F.col("d")).alias("x")).first()
    assert r.x == ["B."]


def test_empty_second_pass(spark):
    # name pass finds "Acme hires."; nothing else carries a cue word
    df = spark.createDataFrame([("k", "Acme hires. Blue sky.", "acme")], "k string, t string, n string")
    d = extract_employer_description(df, text_col="t", name_col="n").first()
    c = extract_employer_description(df, text_col="t", name_col="n", compat=True).first()
    assert d.employer_description == "Acme hires."
    assert c.employer_description == "Acme hires. "
    assert d.retrieved_by == ["name"]


def test_empty_description_is_null(spark):
    df = spark.createDataFrame([("k", "Blue sky.", "acme")], "k string, t string, n string")
    assert extract_employer_description(df, text_col="t", name_col="n").first().employer_description is None


def test_cue_pass_appends_in_order(spark):
    df = spark.createDataFrame([("k", "Acme hires. We are a team. Salary is good.", "acme")],
                               "k string, t string, n string")
    r = extract_employer_description(df, text_col="t", name_col="n").first()
    assert r.employer_description == "Acme hires. We are a team."
    assert r.retrieved_by == ["name", "zsc"]


def test_tokens(spark):
    r = one(spark, word_tokens("t"), [("Hello, World! 42 times\tAGAIN",)], "t string")[0]
    assert r.x == ["hello", "world", "times", "again"]


def test_padding(spark):
    rows = spark.createDataFrame([([5, 6],), ([1, 2, 3, 4, 5, 6],)], "a array<int>") \
        .select(pad_ids("a", 4).alias("x")).collect()
    assert [r.x for r in rows] == [[5, 6, 0, 0], [1, 2, 3, 4]]


def test_tokens_split_where_python_splits(spark):
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = [f"ab{b}cd{b}{b}e" for b in blanks] + ["a\u200bb", "x\ufeffy"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", word_tokens("t").alias("x")).collect()
    assert {r.i: r.x for r in rows} == {i: t.split() for i, t in enumerate(texts)}

import math
import re
from collections import Counter

import pytest

from hireframe.functions.text import split_sentences
from hireframe.operators import abbreviations
from pyspark.sql import functions as F

# 400 sentences with plain ends, and two abbreviations that nearly always have their stop
TEXTS = [f"The firm number{i} sells good{i % 7} wares to dr. Muster and z.B. others today. It grows well this year. Today and every year they are open{i}." for i in range(400)]


def brute(texts):
    with_stop, plain = Counter(), Counter()
    for t in texts:
        for w in re.split(r"[ \t\r\n]+", (t or "").lower()):
            w = re.sub("^[(\\[{\"'«„“‘]+|[)\\]}\"'»“”’,;:!?]+$", "", w)
            if any(c.isalpha() for c in w):
                (with_stop if w.endswith(".") else plain)[w.removesuffix(".")] += 1
    n, k = sum(with_stop.values()) + sum(plain.values()), sum(with_stop.values())
    out = {}
    for w, a in with_stop.items():
        b, letters = plain[w], len(w.replace(".", ""))
        like = lambda p: a * math.log(p) + b * math.log(1 - p)
        score = -2 * (like(k / n) - like(0.99)) * math.exp(-letters) * (len(w) - letters + 1) * letters ** -b
        if score >= 0.3:
            out[w] = (a, b, round(score, 6))
    return out


@pytest.fixture(scope="module")
def known(spark):
    return abbreviations.learn_abbreviations(spark.createDataFrame([(t,) for t in TEXTS], "text string"))


def test_learned_scores_are_those_of_the_formula(spark, known):
    got = {r["abbreviation"]: (r["n_stop"], r["n_plain"], round(r["score"], 6)) for r in known.collect()}
    assert got == brute(TEXTS) and {"dr", "z.b"} <= set(got) and "today" not in got


def test_nothing_to_learn(spark):
    for rows in ([], [(None,), ("",)], [("no stop here",)], [("Stop.",)]):
        df = spark.createDataFrame(rows, "text string")
        assert abbreviations.learn_abbreviations(df).count() == 0
        assert abbreviations.sentences_knowing(df.withColumn("k", F.lit(1)), abbreviations.learn_abbreviations(df), "k").count() == len(rows)


@pytest.mark.parametrize("limit", [20_000, 0])          # inside the row, and by join
def test_sentences_do_not_end_at_abbreviations(spark, known, monkeypatch, limit):
    monkeypatch.setattr(abbreviations, "MAX_IN_ROW", limit)
    texts = [(1, "Ask Dr. Muster. He knows (z.B. prices)!  Really?  Yes. Dr."), (2, None), (3, ""), (4, "One￿two. Dr.\nMuster"), (None, "A z.B. b. C.")]
    df = spark.createDataFrame(texts, "k long, text string").withColumn("_known", F.lit("x")).withColumnRenamed("_known", "score")
    got = {r["k"]: r["sentences"] for r in abbreviations.sentences_knowing(df, known, "k").collect()}
    assert got[1] == ["Ask Dr. Muster.", "He knows (z.B. prices)!", "Really?", "Yes.", "Dr."]
    assert got[2] == got[3] == []
    assert got[4] == ["One two.", "Dr. Muster"] and got[None] == ["A z.B. b.", "C."]
    assert len(df.where("k = 1").select(split_sentences("text").alias("s")).first()["s"]) > len(got[1])

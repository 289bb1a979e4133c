from pyspark.sql import functions as F

from hireframe.operators import sentence_model
from hireframe.operators.extraction import extract_employer_description

CUES = {"who we are": ["we"], "address": ["street"]}
TOLD = [f"We build turbines and pumps with care {i}." for i in "abcdefgh"] + [f"Street parking is behind building {i}." for i in "abcdefgh"]


def test_sentences_without_cues_are_labelled_by_what_was_learned(spark):
    told = spark.createDataFrame([(s,) for s in TOLD + TOLD + [None]], "sentence string")
    model = sentence_model.train_sentence_model(told, cues=CUES)
    assert model.labels == ["address", "who we are"]
    assert model.tokens.where("token in ('we', 'street')").count() == 0
    long = spark.createDataFrame([(1, 0, "Turbines and pumps with care."), (1, 1, "Behind building parking."), (1, 2, "Zzz qqq."), (2, 0, "We park behind building."),
                                  (2, 0, "We park behind building."), (None, 0, "")], "_k long, _pos int, sentence string").withColumn("prediction_", F.lit(1))
    got = sorted(((r["_k"] or 0, r["_pos"], r["top_label"]) for r in sentence_model.learned_scorer(model, cues=CUES)(long).collect()))
    assert got == [(0, 0, "other"), (1, 0, "who we are"), (1, 1, "address"), (1, 2, "other"), (2, 0, "who we are"), (2, 0, "who we are")]


def test_extraction_with_the_learned_scorer(spark):
    told = spark.createDataFrame([(s,) for s in TOLD], "sentence string")
    scorer = sentence_model.learned_scorer(sentence_model.train_sentence_model(told, cues=CUES), cues=CUES)
    df = spark.createDataFrame([("p1", "Acme hires. Turbines and pumps with care. Parking is behind building one.", "acme")], "uniq_id string, job_description string, company_name string")
    r = extract_employer_description(df, scorer=scorer).first()
    assert r["employer_description"] == "Acme hires. Turbines and pumps with care." and r["retrieved_by"] == ["name", "zsc"]


def test_without_any_cue_the_table_decides(spark):
    none = spark.createDataFrame([("Nothing here.",)], "sentence string")
    model = sentence_model.train_sentence_model(none, cues=CUES)
    assert model.labels == []
    long = spark.createDataFrame([("a", 0, "We."), ("a", 1, "No.")], "_k string, _pos int, sentence string")
    assert [r["top_label"] for r in sentence_model.learned_scorer(model, cues=CUES)(long).orderBy("_pos").collect()] == ["who we are", "other"]

"""Work that is done once: extraction for all levels, tokens of a sentence, common tokens of a large model."""
import re

from pyspark.sql import functions as F

from hireframe.functions import sizing
from hireframe.functions.text import first_tokens, word_tokens
from hireframe.operators import classify, extraction, sentence_model
from hireframe.plans import catalog, flows


def test_postings_are_extracted_once_for_all_levels(spark, monkeypatch):
    """four levels were four extractions, and the training data was computed for each."""
    calls = []
    real = flows.extract_employer_description
    monkeypatch.setattr(flows, "extract_employer_description", lambda *a, **k: (calls.append(1), real(*a, **k))[1])
    catalog.QUERIES["predict_all_levels"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 2          # the training data and the postings


def test_levels_score_as_each_model_alone(spark):
    docs = spark.createDataFrame([("a", "we build pumps"), ("b", "our bank lends")], "label string, text string")
    model = classify.train_naive_bayes(docs, "label", text_col="text")
    posts = spark.createDataFrame([("p1", "We build pumps. Other.", "x"), ("p1", "We build pumps. Other.", "y"), ("p2", "Our bank lends.", None)],
                                  "uniq_id string, job_description string, company_name string")
    alone = sorted(map(str, flows.classify_postings(model, posts).collect()))
    both = flows.classify_levels({"u": model, "v": model}, posts)
    for level in "uv":
        assert sorted(map(str, both.where(F.col("level") == level).drop("level").collect())) == alone


def test_common_tokens_stay_in_their_task(spark, monkeypatch):
    """above the broadcast limit every (key, token) pair was shuffled and joined."""
    docs = spark.createDataFrame([(i, "en" if i % 2 else "de", f"the dog {'runs' if i % 2 else 'rennt'} rare{chr(97 + i)}x " + "dog " * i) for i in range(12)]
                                 + [(99, "en", None), (98, None, "dog zzz"), (97, "de", "!!")], "id long, lang string, text string")
    model = classify.train_naive_bayes(docs, "lang", text_col="text")
    twice = docs.unionByName(docs.where("id < 3"))
    want = {r["id"]: r["raw"] for r in classify.class_scores(model, twice, "id", text_col="text").collect()}
    monkeypatch.setattr(sizing, "MAX_BROADCAST_BYTES", 6 * (sizing.TOKEN_ROW_BYTES + 16))
    assert not model.broadcastable() and 0 < model.common_tokens().count() < model.vocab_size
    scored = classify.class_scores(model, twice, "id", text_col="text")
    got = scored.collect()
    assert len(got) == 18
    for r in got:
        assert all(abs(x - y) < 1e-9 for x, y in zip(r["raw"], want[r["id"]]))
    monkeypatch.setattr(sizing, "MAX_BROADCAST_BYTES", 0)
    assert model.common_tokens().count() == 0
    for r in classify.class_scores(model, twice, "id", text_col="text").collect():
        assert all(abs(x - y) < 1e-9 for x, y in zip(r["raw"], want[r["id"]]))


def test_a_sentence_is_tokenised_once_for_label_and_model(spark):
    """the cue label tokenised a sentence anew for every label."""
    df = spark.createDataFrame([("We sell.",), (None,), ("Zzz.",)], "sentence string")
    label = extraction.cue_top_label(F.col("sentence"), extraction.candidate_labels())
    plan = df.select(label.alias("l"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"split\(", plan)) == 1
    told = sentence_model.told(df)
    assert len(re.findall(r"split\(", told._jdf.queryExecution().optimizedPlan().toString())) == 1
    assert [tuple(r) for r in told.collect()] == [("We sell.", "who we are", "sell"), (None, "other", ""), ("Zzz.", "other", "zzz")]
    assert sentence_model.told(told).columns == told.columns


def test_sentences_are_tested_for_the_name_once(spark):
    """the name pass and the residual text each tested every sentence."""
    df = spark.createDataFrame([("ACME hires. We build. Other.", "Acme"), ("We build. acme.", ""), ("We build.", None), (None, "x")],
                               "job_description string, company_name string")
    out = extraction.extract_employer_description(df)
    assert len(re.findall(r"contains\(", out._jdf.queryExecution().optimizedPlan().toString(), re.I)) == 1
    assert [r["employer_description"] for r in out.collect()] == ["ACME hires. We build.", "We build.", "We build.", None]


def test_first_tokens_are_those_of_the_whole_text(spark):
    """F8: the whole text was tokenised for its first ids."""
    texts = ["a b c d", "  1 2 -- 3 4 5 6 7 8 9 10 11 12 13 14 x y z", "", None, "!! ??", "one", "A　B\tC\x85D e1f2", " ".join(str(i) for i in range(99)) + " q"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 3, 30):
        rows = df.select(first_tokens("t", n).alias("a"), F.slice(word_tokens("t"), 1, n).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in rows)

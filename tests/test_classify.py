import math

import pytest
from pyspark.sql import functions as F

from hireframe.operators import classify
from hireframe.plans import flows
from hireframe.operators.vocabulary import build_vocabulary, encode_tokens


def test_naive_bayes_matches_brute_force(spark, tmp_path):
    train = [("a", "red red blue"), ("a", "red green"), ("b", "blue blue"), ("b", "green")]
    test = [("t1", "red blue"), ("t2", "purple"), ("t3", "")]
    tr = spark.createDataFrame(train, "label string, text string")
    te = spark.createDataFrame(test, "k string, text string")
    m = classify.train_naive_bayes(tr, "label", text_col="text")
    got = {r.k: r for r in classify.predict(m, te, "k", text_col="text", return_probas=True).collect()}
    # brute force
    vocab = {"red", "blue", "green"}
    counts = {"a": {"red": 3, "blue": 1, "green": 1}, "b": {"blue": 2, "green": 1}}
    n = {"a": 5, "b": 3}
    for k, text in test:
        raw = []
        for lab in ("a", "b"):
            s = math.log(2 / 4)
            for t in text.split():
                if t in vocab:
                    s += math.log((counts[lab].get(t, 0) + 1) / (n[lab] + 3))
            raw.append(s)
        assert all(abs(x - y) < 1e-9 for x, y in zip(got[k].raw_scores, raw))
        best = "a" if round(raw[0], 6) >= round(raw[1], 6) else "b"
        assert got[k].prediction == best
    assert got["t2"].prediction == "a"   # tie on priors -> lowest label
    path = str(tmp_path / "m")
    classify.save_model(m, path, "nace")
    m2 = classify.load_model(spark, path, "nace")
    again = {r.k: r.prediction for r in classify.predict(m2, te, "k", text_col="text").collect()}
    assert again == {k: r.prediction for k, r in got.items()}


def test_vocabulary_ranks_and_unknowns(spark):
    docs = spark.createDataFrame([(1, "b a a"), (2, "c b a d")], "doc_id long, text string")
    v = {r.token: r.id for r in build_vocabulary(docs, "doc_id", "text", 4).collect()}
    assert v == {"<pad>": 0, "<unk>": 1, "a": 2, "b": 3}
    enc = {r.doc_id: r.ids for r in encode_tokens(docs, "doc_id", "text", build_vocabulary(docs, "doc_id", "text", 4),
                                                  sequence_length=5).collect()}
    assert enc == {1: [3, 2, 2, 0, 0], 2: [1, 3, 2, 1, 0]}
    full = {r.token: r.id for r in build_vocabulary(docs, "doc_id", "text", None).collect()}
    assert full == {"<pad>": 0, "<unk>": 1, "a": 2, "b": 3, "c": 4, "d": 5}


def test_vocabulary_sort_path_equals_top_k(spark, monkeypatch):
    from hireframe.functions import ordering
    def word(x):
        return chr(97 + x % 26) * (1 + x // 26)
    docs = spark.createDataFrame([(i, " ".join(word((i * j) % 37) for j in range(1, 30))) for i in range(60)],
                                 "doc_id long, text string")
    a = {r.token: r.id for r in build_vocabulary(docs, "doc_id", "text", 20).collect()}
    monkeypatch.setattr(ordering, "TOP_K_MERGE_ROWS", 0)
    b = {r.token: r.id for r in build_vocabulary(docs, "doc_id", "text", 20).collect()}
    assert a == b and len(a) == 20


def test_detect_language_on_bare_strings(spark):
    tr = spark.createDataFrame([("en", "the cat and the dog"), ("de", "der hund und die katze")],
                               "lang string, text string")
    m = classify.train_naive_bayes(tr, "lang", text_col="text")
    out = classify.detect_language(m, classify.texts_frame(spark, "the dog"), "id", "text", min_score=0.5).first()
    assert out.language == "en"
    low = classify.detect_language(m, classify.texts_frame(spark, ["zzz"]), "id", "text", min_score=0.75).first()
    assert low.language is None


def test_english_vocabulary_fit_on_train(spark):
    from hireframe.plans.flows import english_detection
    rows = [(i, ("the cat sat on the mat" if i % 3 else "le chat est sur le tapis"), "en" if i % 3 else "fr")
            for i in range(60)]
    corpus = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    res = english_detection(corpus, fit_on="train", test_size=0.2)
    ev = {r.partition: r for r in res.evaluation.collect()}
    assert set(ev) == {"test", "validation"} and ev["test"].accuracy == 1.0


def test_scoring_shuffle_path_equals_broadcast(spark, monkeypatch):
    from hireframe.functions import sizing
    tr = spark.createDataFrame([("a", "red red blue the"), ("b", "blue green the the"), ("a", "red the")],
                               "label string, text string")
    te = spark.createDataFrame([("t1", "red the the"), ("t2", "green"), ("t3", "")], "k string, text string")
    m = classify.train_naive_bayes(tr, "label", text_col="text")
    a = {r.k: [round(x, 9) for x in r.raw] for r in classify.class_scores(m, te, "k", text_col="text").collect()}
    monkeypatch.setattr(sizing, "MAX_BROADCAST_ROWS", 0)
    plan = classify.class_scores(m, te, "k", text_col="text")
    b = {r.k: [round(x, 9) for x in r.raw] for r in plan.collect()}
    assert a == b and set(a) == {"t1", "t2", "t3"}


def test_predict_english_on_new_sentences(spark):
    from hireframe.plans.flows import english_detection, predict_english
    rows = [(i, ("the cat sat on the mat" if i % 3 else "le chat est sur le tapis"), "en" if i % 3 else "fr")
            for i in range(60)]
    res = english_detection(spark.createDataFrame(rows, "doc_id long, text string, labels string"), test_size=0.2)
    out = {r.id: r.is_english for r in predict_english(
        res, classify.texts_frame(spark, ["the mat", "le tapis"])).collect()}
    assert out == {0: 1, 1: 0}


def two_levels(spark):
    a = spark.createDataFrame([("x`y", "red red"), ("token", "blue")], "label string, text string")
    b = spark.createDataFrame([("u", "red"), ("v", "blue blue")], "label string, text string")
    return classify.train_naive_bayes(a, "label", text_col="text"), classify.train_naive_bayes(b, "label", text_col="text")


def test_levels_are_saved_side_by_side(spark, tmp_path):
    m1, m2 = two_levels(spark)
    path = str(tmp_path / "levels")
    classify.save_model(m1, path, "nace")
    classify.save_model(m2, path, "macro")
    assert classify.load_model(spark, path, "nace").labels == ["token", "x`y"]
    assert classify.load_model(spark, path, "macro").labels == ["u", "v"]
    with pytest.raises(ValueError, match="pharma"):
        classify.load_model(spark, path, "pharma")


def test_rows_of_one_posting_are_scored_apart(spark, monkeypatch):
    from hireframe.functions import sizing
    m, _ = two_levels(spark)
    rows = [("p1", "acme", "red"), ("p1", "globex", "blue"), ("p2", "acme", "blue"), ("p2", "acme", "blue"), ("p3", None, ""), ("p4", "acme", None)]
    df = spark.createDataFrame(rows, "uniq_id string, company_name string, t string")
    want = None
    for limit in (sizing.MAX_BROADCAST_BYTES, 0):          # broadcast and shuffle path
        monkeypatch.setattr(sizing, "MAX_BROADCAST_BYTES", limit)
        got = classify.predict(m, df, ["uniq_id", "company_name"], text_col="t", return_probas=True).collect()
        key = sorted((r.uniq_id, str(r.company_name), r.prediction, round(r.score, 9)) for r in got)
        alone = {}
        for p, c, t in rows:
            one = spark.createDataFrame([("k", t)], "k string, t string")
            r = classify.predict(m, one, "k", text_col="t", return_probas=True).first()
            alone[(p, str(c))] = (r.prediction, round(r.score, 9))
        assert key == sorted((p, str(c), *alone[(p, str(c))]) for p, c, _ in rows)
        want = want or key
        assert key == want


def test_english_detector_fits_on_train_too(spark):
    rows = [(i, ("the cat sat on the mat" if i % 2 else "die katze sitzt auf der matte") + f" {chr(97 + i % 7)}", "en" if i % 2 else "de") for i in range(80)]
    corpus = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    for fit_on in ("all", "train"):
        res = flows.english_detection(corpus, target_share=0.5, fit_on=fit_on)
        assert min(r.accuracy for r in res.evaluation.collect()) >= 0.9
        assert res.data.count() == 80


def test_text_files_with_and_without_names(spark, tmp_path):
    from hireframe.sources import files
    (tmp_path / "a.txt").write_text("Acme hires. We are a bank.")
    (tmp_path / "b.txt").write_text("We make red red things.")
    m, _ = two_levels(spark)
    posts = files.read_text_postings(spark, str(tmp_path))
    alone = flows.classify_postings(m, posts, "file_name", name_col=None).collect()
    named = flows.classify_postings(m, posts, "file_name").collect()
    assert len(alone) == len(named) == 2 and {r.file_name for r in alone} == {r.file_name for r in named}


def test_level_switches(spark, tmp_path):
    rows = [(f"p{i}", ("red " if i % 2 else "blue ") * 3 + f"c{i % 9}", f"c{i % 9}", "ab"[i % 2]) for i in range(90)]
    train = spark.createDataFrame(rows, "uniq_id string, employer_description string, company_name string, industry string")
    mapping = spark.createDataFrame([("macro", "a", "A")], "level string, industry string, target string")
    one = flows.train_eval_level(train, mapping, "nace", unique_employers=True, split_by="random")
    assert one.data.count() == 9
    plain = flows.train_eval_level(train, mapping, "macro", blind=False, split_by="random", save_path=str(tmp_path / "m"))
    assert plain.data.where("employer_description like '%c3%'").count() > 0
    assert classify.load_model(spark, str(tmp_path / "m"), "macro").labels == ["A", "b"]

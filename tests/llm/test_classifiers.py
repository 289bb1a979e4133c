import numpy as np
import pytest
from pyspark.sql import functions as F

from hireframe.llm import compression_quality, labelled, toxicity
from hireframe.llm.hashing import Words
from hireframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def auc(rows, label):
    s, y = np.array([r["score"] for r in rows]), np.array([r[label] for r in rows])
    return (s[y == 1][:, None] > s[y == 0]).mean() + (s[y == 1][:, None] == s[y == 0]).mean() / 2


@pytest.mark.parametrize("name,label,least", [("op7_compression_quality", "quality", 0.9), ("op8_toxicity", "toxic", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    rows = QUERIES[name](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = rows.where("held_out").join(labels, "doc_id").collect()
    assert auc(held, label) >= least
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in held)


@pytest.mark.parametrize("op,unit", [(toxicity, "trained"), (compression_quality, "build_dictionary")])
def test_the_fit_reads_whole_texts(spark, docs_of, monkeypatch, op, unit):
    rows = [(i, " ".join(f"d{i}w{j:04}" for j in range(2000 if i % 2 else 3))) for i in range(12)]
    labels = spark.createDataFrame([(i, i // 2 % 2) for i, _ in rows], "doc_id long, y int")
    seen, real = [], getattr(op, unit)

    def spy(parts, *args, **kw):
        if op is toxicity:                          # a DataFrame of windows
            seen.extend(r["words"].encode() for r in parts.orderBy("id", "at").collect())
            return real(parts)
        seen.extend(p if isinstance(p, bytes) else p.encode() for p in parts)
        return real(parts, *args, **kw)

    monkeypatch.setattr(op, unit, spy)
    op.fit(docs_of(rows), labels, F.lit(True), label_col="y")
    sample, _ = labelled.labelled_sample(labels, "y", F.lit(True), 4000)
    fitted = {r["id"] for r in sample.where("part = 0").collect()}
    join = b" " if op is toxicity else b""
    text = join.join(seen)
    assert any(i % 2 for i in fitted)
    for i, t in rows:
        assert (t.encode() in text) == (i in fitted)


def test_held_out_toxic_passages_of_long_documents(spark, docs_of):
    rng = np.random.default_rng(12)
    plain = [f"{a}{b}{c}" for a in ("ba", "ke", "lo", "mu") for b in ("nt", "sel", "dor") for c in ("a", "is", "um")]
    rows, y = [], {}
    for i in range(240):
        w = list(rng.choice(plain, 1500))
        y[i] = i % 2
        if y[i]:
            at = int(rng.integers(len(w) - 4))
            w[at: at + 4] = rng.choice(["horrible", "filthy", "despise", "vermin"], 4)
        rows.append((i, " ".join(w)))
    docs, held = docs_of(rows), F.col("doc_id") % 3 == 0
    labels = spark.createDataFrame(list(y.items()), "doc_id long, toxic int")
    model, curve = toxicity.fit(docs, labels, ~held)
    got = [{"score": r["score"], "toxic": y[r["doc_id"]]} for r in toxicity.score(docs.where(held), model, curve).collect()]
    figure = auc(got, "toxic")
    print(f"AUC of long documents: {figure:.3f}")
    assert figure >= 0.95


def test_the_sample_is_bounded_in_bytes(spark, docs_of, monkeypatch):
    rows = [(i, f"word{i} " * (3000 if i == 8 else 10)) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    seen, real = [], toxicity.trained
    monkeypatch.setattr(toxicity, "trained", lambda w: (seen.extend(w.collect()), real(w))[1])
    toxicity.fit(docs_of(rows), labels, F.lit(True), bytes_per_class=4000)
    used = {r["id"] for r in seen}
    assert used and 8 not in used
    for y in (0, 1):
        assert 0 < sum(len(rows[i][1]) for i in used if i % 2 == y) <= 4000
        assert all(sum(len(r["words"].split()) for r in seen if r["id"] == i) == 10 for i in used)      # whole texts


@pytest.mark.parametrize("op", [compression_quality, toxicity])
def test_odd_rows_and_missing_labels(spark, odd_docs, docs_of, op):
    docs = odd_docs(clash=True)
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 0), (7, 1), (9, None), (None, 1), (10, 1), (10, 0), (8, 1)], "doc_id long, y int")
    for some in (labels, labels.limit(0), labels.where("y = 1")):
        model, curve = op.fit(docs, some, F.lit(True), label_col="y")
        rows = op.score(docs, model, curve).collect()
        assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
        assert {r["score"] for r in rows if r["doc_id"] == 1} == {r["score"] for r in rows if r["doc_id"] == 2}   # null as empty
    assert op.score(docs_of([]), model, curve).count() == 0


def test_labels_decide_only_where_they_agree(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(1, 0), (3, 1), (None, 1), (60, None), (61, 7)], "doc_id long, y int")
    sample, counts = labelled.labelled_sample(labels, "y", F.lit(True), 10)
    assert counts == {0: 25, 1: 24} and sample.groupBy("y").count().orderBy("y").collect() == [(0, 10), (1, 10)]
    assert sample.where("id = 1").count() == 0


def test_calibration_recovers_shares():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 4000)
    z = rng.normal(np.where(y == 1, 1, -1), 1)
    curve = labelled.calibrate(z, y, {0: 9000, 1: 1000})
    p = labelled.probability(z, curve)
    w = np.where(y == 1, 0.1, 0.9)
    assert abs(np.average(p, weights=w) - 0.1) < 0.01
    assert labelled.probability(np.zeros(1), labelled.calibrate(np.zeros(0), np.zeros(0), {}))[0] == 0.5


def words(text):
    data = text.encode()
    return Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))


def test_misspellings_share_subwords():
    rows = {}
    for w in ("worthless", "worthlesss", "thermal"):
        rows[w] = set(toxicity.subwords(words(w), np.array([0]))[0].tolist())
    assert len(rows["worthless"] & rows["worthlesss"]) > 15 > len(rows["worthless"] & rows["thermal"])


def test_unseen_misspelling_scores_toxic():
    rng = np.random.default_rng(4)
    plain = [f"{a}{b}" for a in ("ba", "ke", "lo", "mu", "ri") for b in ("nt", "sel", "dor", "vin", "pak")]
    texts, y, owner = [], [], []
    for d in range(300):
        w = list(rng.choice(plain, 8))
        if d % 3 == 0:
            w[int(rng.integers(8))] = str(rng.choice(["horrible", "filthy", "despise"]))
        texts.append(" ".join(w)), y.append(int(d % 3 == 0)), owner.append(d)
    model = toxicity.train(texts, np.array(y), np.array(owner))
    z = [toxicity.window_logits(words(f"bant kesel {w} lodor muvin"), model.row_scores(), 0.0)[0] for w in ("horribble", "filthyy", "ripak", "basel")]
    assert min(z[:2]) > max(z[2:])


def test_window_logit_sees_every_window():
    scores = np.zeros(toxicity.BUCKETS)
    bad = toxicity.subwords(words("zzz"), np.array([0]))[0]
    scores[bad] = 1.0
    for at in (0, 57, 99):
        w = ["aaaa"] * 100
        w[at] = "zzz"
        assert toxicity.window_logits(words(" ".join(w)), scores, 0.0, 10)[0] > 0.09
    assert toxicity.window_logits(words("zzz"), scores, 0.5, 10)[0] == 1.5
    assert toxicity.window_logits(words(""), scores, 0.5, 10).tolist() == [0.5]


def test_blocks_cover_the_whole_text():
    text = "é" * 5000 + "tail"
    assert b"".join(compression_quality._blocks(text)) == text.encode()
    two = compression_quality.TwoDictionaries((b"", b""))
    assert two.difference(text) == 0 and two.difference("") == 0 and two.difference(None) == 0

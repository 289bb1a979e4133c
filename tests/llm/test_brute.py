"""Scores of the classifiers and the whole pipeline against plain loops over texts."""
import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import sentencepiece
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from hireframe.llm import compression_quality, mixing, stages, toxicity
from hireframe.llm.hashing import Words
from hireframe.llm.queries import tokenizer_path
from tests.llm.test_line_dedup import brute as lines_brute
from tests.llm.test_native import targets_brute
from tests.llm.test_pipeline import near_groups

SF = "/root/testdata/sf0.001"


def probability(z, curve):
    slope, offset, scale = curve
    return 1 / (1 + math.exp(-min(max(z * (slope / scale) + offset, -35.0), 35.0)))


def toxic_brute(text, model, known):
    """The largest mean word score over all windows, word by word."""
    scores = model.row_scores()
    marks = []
    for w in (text or "").encode().lower().split():
        if w not in known:
            rows, _ = toxicity.subwords(Words(np.frombuffer(w, np.uint8), np.array([0, len(w)])), np.array([0]))
            known[w] = float(np.mean(scores[rows]))
        marks.append(known[w])
    n = toxicity.WINDOW
    spans = [marks[i: i + n] for i in range(max(1, len(marks) - n + 1))] if marks else []
    return float(model.bias[1] - model.bias[0]) + max((sum(s) / len(s) for s in spans), default=0.0)


def quality_brute(text, dictionaries):
    data = (text or "").encode("utf-8", "replace")
    sizes = []
    for d in dictionaries:
        tool = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_checksum=False, write_content_size=False)
        sizes.append(sum(len(tool.compress(data[a: a + compression_quality.BLOCK])) for a in range(0, len(data), compression_quality.BLOCK)))
    good, bad = sizes
    return (bad - good) / (bad + good) if good + bad else 0.0


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_scores_are_those_of_loops(spark, odd_docs):
    docs, labels = tables(spark)
    docs = docs.unionByName(odd_docs().select(docs.columns))
    model, curve = toxicity.fit(docs, labels, F.lit(True))
    known = {}
    for r in toxicity.score(docs, model, curve).collect():
        assert abs(r["score"] - probability(toxic_brute(r["text"], model, known), curve)) < 1e-6
    both, curve = compression_quality.fit(docs, labels, F.lit(True))
    for r in compression_quality.score(docs, both, curve).collect():
        assert abs(r["score"] - probability(quality_brute(r["text"], both), curve)) < 1e-9


def mix_brute(rows, weights=(5, 2, 1), share=1.5, repeats=2):
    """Copies of each row (doc_id, text, source): the schedule played slot by slot over lists of words."""
    b = mixing.BLOCK_WORDS
    size = {i: len((t or "").encode().split()) for i, t, _ in rows}
    total = defaultdict(int)
    for i, _, s in rows:
        total[s] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    target = targets_brute(total)
    goal = {s: math.floor(target[s] + 0.5) for s in order}
    line = {s: [i for _, i in sorted((hashlib.md5(f"9:{i}:{size[i]}".encode()).hexdigest(), i) for i, _, x in rows if x == s)
                for i in [i] * size[i]] for s in order}
    ends, upto = [], 0
    for s in order:
        upto += goal[s]
        ends.append((s, upto * mixing.ONE // max(1, sum(goal.values()))))
    blocks = {s: -(-total[s] // b) for s in order}
    quota = {s: goal[s] // total[s] * blocks[s] + -(-(goal[s] % total[s]) // b) if goal[s] else 0 for s in order}
    turn, taken = Counter(), Counter()

    def play(s):
        r, turn[s] = turn[s], turn[s] + 1
        if r < quota[s]:
            a = r % blocks[s] * b
            taken.update(line[s][a: min(a + b, a + goal[s] - (r // blocks[s] * total[s] + a))])

    for k in range(round(share * sum(size.values()) / b)):
        play(next(s for s, end in ends if k * mixing.PHI % mixing.ONE < end))
    for s in order:
        while turn[s] < quota[s]:
            play(s)
    return {i: (2 * taken[i] + size[i]) // (2 * size[i]) if size[i] else 0 for i in size}


def test_pipeline_against_loops(spark):
    docs, labels = tables(spark)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    model, curve = toxicity.fit(docs, labels, F.lit(True))
    known = {}
    rows = [r for r in rows if probability(toxic_brute(r[1], model, known), curve) < stages.TOXIC]
    cut = lines_brute([r[:2] for r in rows], 50)
    left = lambda t: bool(t.encode().split())
    rows = [(i, t if t is None else cut[i, t][2], s) for i, t, s in rows if t is None or cut[i, t][1] == 0 or left(cut[i, t][2])]
    low = near_groups([r[:2] for r in rows])
    rows = [r for r in rows if low[r[0]] == r[0]]
    copies = mix_brute(rows)
    tool = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    want = sorted((i, t, tool.encode(t) + [tool.eos_id()]) for i, t, _ in rows for _ in range(copies[i]))
    got = sorted((r["doc_id"], r["text"], list(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect())
    assert got and got == want

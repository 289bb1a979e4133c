"""Quality cascade, sharding and mixing: edge rows, brute force and plans without Python."""
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hireframe.llm import mixing, quality_cascade, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_brute(t):
    t = t or ""
    w = WORD.findall(t)
    seen = Counter(tuple(w[i: i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i: i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark, odd_docs, docs_of):
    extra = docs_of([(20, "p q r s t u v w p q r s t u v w p q r s"), (21, "# a | b\n# a | b\n" * 4), (22, "a b c d e f g h i a b c d e f g h x")])
    df = odd_docs(clash=False).unionByName(extra)
    rows = quality_cascade.quality_filter(df).collect()
    want = sorted(str((r["doc_id"], *base_brute(r["text"]))) for r in df.select("doc_id", "text").collect())
    assert want == sorted(str((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in rows)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_order_changes_nothing_but_the_order(spark, docs_of):
    texts = ["GOOD MORNING " * 20, "plain words here and there " * 3 + " ".join(f"w{i}" for i in range(40)), "!! " * 30, "1 2 3 " * 20 + " ".join(map(str, range(90)))]
    df = docs_of([(i, t) for i, t in enumerate(texts)]).select("doc_id", F.col("text").alias("_text"))
    counts = quality_cascade.base_counts(F.col("_text"))
    rows = df.select("*", *[c.alias(k) for k, c in counts.items()])
    rules = quality_cascade.default_rules(F.col("_text"))
    order = quality_cascade.measured_order(rows, rules)
    assert sorted(x["rule"] for x in order) == sorted(rules) and all(x["seconds"] > 0 for x in order)
    names = list(rules)
    a, b = (rows.select("doc_id", quality_cascade.cascade(rules, o).isNull().alias("k")).orderBy("doc_id").collect() for o in (names, names[::-1]))
    assert a == b
    assert [x["rule"] for x in quality_cascade.measured_order(rows.limit(0), rules)] == names


def test_greedy_order_counts_what_is_left():
    # a rejects 50 rows, b 40 of the same, c 20 others: c comes before b
    outcomes = {(True, True, False): 40, (True, False, False): 10, (False, False, True): 20, (False, False, False): 500}
    got = quality_cascade.greedy_order({"a": 1.0, "b": 1.0, "c": 1.0}, outcomes)
    assert [(x["rule"], x["rejects"]) for x in got] == [("a", 50), ("c", 20), ("b", 0)]
    # a costs so much that b goes first, and a has ten rows left; of rules that reject nothing the cheaper comes first
    got = quality_cascade.greedy_order({"a": 2.0, "b": 1.0, "c": 1.0}, outcomes)
    assert [(x["rule"], x["rejects"]) for x in got] == [("b", 40), ("c", 20), ("a", 10)]
    assert [x["rule"] for x in quality_cascade.greedy_order({"a": 2.0, "b": 1.0}, {(False, False): 3})] == ["b", "a"]


def test_the_cheaper_of_two_like_rules_goes_first(spark, docs_of):
    text = " ".join(f"w{i}" for i in range(3000))
    rows = docs_of([(i, text if i % 4 else "bad " + text) for i in range(200)] + [(900, None), (901, "")]).select("doc_id", F.col("text").alias("_text"))
    words = F.transform(F.split("_text", " "), lambda w: F.sha2(F.sha2(F.sha2(w, 512), 512), 512))
    rules = {"dear": F.array_contains(words, F.sha2(F.sha2(F.sha2(F.lit("bad"), 512), 512), 512)), "cheap": F.col("_text").startswith("bad")}
    order = quality_cascade.measured_order(rows, rules)
    assert [(x["rule"], x["rejects"]) for x in order] == [("cheap", 50), ("dear", 0)]
    assert order[0]["seconds"] < order[1]["seconds"]
    # rows that do not reach the cascade are not counted
    some = quality_cascade.measured_order(rows, rules, prepare=lambda df: df.where("doc_id < 100"))
    assert [(x["rule"], x["rejects"]) for x in some] == [("cheap", 25), ("dear", 0)]


def test_cascade_of_an_empty_table(spark, docs_of):
    out = quality_cascade.quality_filter(docs_of([]))
    assert out.count() == 0 and "kept" in out.columns


def test_cascade_is_native(spark, docs_of):
    for df in (quality_cascade.quality_filter(docs_of([(1, "a b")])), mixing.mix(docs_of([(1, "a b")]))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_shards(spark, odd_docs, docs_of):
    df = odd_docs(clash=True)
    rows = sharding.shard_by_bytes(df, 4).collect()
    assert Counter(str((r["doc_id"], r["size"], r["text_crc32"])) for r in rows) == Counter(
        str((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode()))) for r in df.collect())
    for s in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_by_bytes(docs_of([]), 4).count() == 0


@pytest.mark.parametrize("parts", [1, 6])
def test_shards_are_contiguous_and_balanced(spark, docs_of, parts):
    df = docs_of([(i * 37 % 1000, "x" * (i * 13 % 90)) for i in range(1000)]).repartition(parts)
    rows = sorted(sharding.shard_by_bytes(df, 7).collect(), key=lambda r: r["doc_id"])
    assert [r["shard"] for r in rows] == sorted(r["shard"] for r in rows)
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["size"]
    assert len(size) == 7 and max(size.values()) - min(size.values()) <= 2 * 106
    before, total = 0, sum(size.values())
    for r in rows:
        assert r["shard"] == (2 * before + r["size"]) * 7 // (2 * total)
        before += r["size"]


def targets_brute(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = (budget - sum(target.values())) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            target.update({s: level * w[s] for s in free})
            break
        target.update({s: cap * sizes[s] for s in over})
        free -= over
    return target


def test_mix_targets(spark, docs_of):
    rows = [(i, "w " * (1 + i * 31 % 400), ["a", "b", "c", "d", None][min(4, i % 9)]) for i in range(400)] + [(1000, None, "a"), (1001, "", "e"), (None, "x y", "b")] + [(5, "t t t", "a")] * 3
    df = docs_of(rows, clash=True)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = targets_brute(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    assert {s: abs(taken[s] - want[s]) <= 1 for s in sizes} == dict.fromkeys(sizes, True)
    key = lambda r: str((r["doc_id"], r["source"], r["size"], r["taken"]))
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(df.repartition(5)).collect()))
    whole = mixing.materialise(df, mixing.mix(df))
    assert whole.columns == df.columns and whole.where("text is null or text = ''").count() == 0
    assert mixing.mix(docs_of([])).count() == 0


def test_schedule_is_evenly_spread(spark):
    t = spark.createDataFrame([("a", 600.0), ("b", 300.0), (None, 100.0)], "source string, target double")
    rows = mixing.schedule(t, 5000, chunk=700).collect()
    n = Counter(r["source"] for r in rows)
    assert sum(n.values()) == 5000
    for s, share in (("a", 0.6), ("b", 0.3), (None, 0.1)):
        assert abs(n[s] - share * 5000) <= 4
        assert sorted(r["r"] for r in rows if r["source"] == s) == list(range(n[s]))


def test_slots_order_the_mix(spark, docs_of):
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(1 + i * 31 % 400)), ["a", "b", None][i % 3]) for i in range(300)] + [(900, None, "a"), (901, "", "b")]
    df = docs_of(rows, clash=True)
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    pieces = sorted(mixing.pieces(df).collect(), key=lambda r: r["slot"])
    words, first = Counter(), {}
    for r in pieces:
        assert 0 <= r["start"] < r["end"] <= got[r["doc_id"]]["size"] and r["end"] - r["start"] <= mixing.BLOCK_WORDS
        words[r["doc_id"]] += r["end"] - r["start"]
        first.setdefault(r["doc_id"], r["slot"])
    assert all(words[i] == r["taken"] and first.get(i) == (r["first_slots"] or [None])[0] for i, r in got.items())
    # the slots hold each source's words in the given shares from the beginning on, not one source after the other
    of_slot = {r["slot"]: r["source"] for r in pieces}
    target = {r["source"]: r["target"] for r in got.values()}
    names = [of_slot[k] for k in sorted(of_slot)]
    for upto in (50, 100, len(names) // 2):
        n = Counter(names[:upto])
        for s, t in target.items():
            assert abs(n[s] - upto * t / sum(target.values())) <= 5
    assert len({r["slot"] for r in pieces}) == len({(r["slot"], r["source"], r["block"]) for r in pieces})
    # whole documents come in the order of their passes' first slots
    ids = [r["doc_id"] for r in mixing.materialise(df, mixing.mix(df)).collect()]
    seen, at = Counter(), []
    for i in ids:
        at.append(got[i]["first_slots"][seen[i]])
        seen[i] += 1
    assert at == sorted(at) and max(seen.values()) == 2


def test_first_slots_follow_the_schedule(spark, docs_of, monkeypatch):
    df = docs_of([(i, "w " * (1 + i * 31 % 400), ["a", "b", None][i % 3]) for i in range(300)])
    run = lambda: {r["doc_id"]: (r["taken"], r["first_slots"]) for r in mixing.mix(df).collect()}
    golden = run()
    monkeypatch.setattr(mixing, "PHI", 1)
    other = run()
    assert {i: x[0] for i, x in golden.items()} == {i: x[0] for i, x in other.items()}      # targets alone
    assert sum(golden[i][1] != other[i][1] for i in golden) > 200

import re
from itertools import combinations

import numpy as np
import pytest

from hireframe.llm import hashing
from hireframe.llm import parity_join as P
from hireframe.llm import stages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text, k=4):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i: i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, pct=85):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(sets_of(t))
    low = {i: i for i in sets if i is not None}
    for a, b in combinations(sorted(low), 2):
        if any(x and y and 100 * len(x & y) >= pct * len(x | y) for x in sets[a] for y in sets[b]):
            old, new = max(low[a], low[b]), min(low[a], low[b])
            low = {i: new if c == old else c for i, c in low.items()}
    return low


def check(df, rows):
    got = P.jaccard_components(df).collect()
    low = brute(rows)
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got) == sorted(
        (str(i), len(sets_of(t)), low.get(i)) for i, t in rows)


def test_edits_around_the_threshold(spark, docs_of):
    rng, rows = np.random.default_rng(2), []
    for g in range(6):
        base = [f"g{g}w{i}" for i in rng.integers(0, 40, int(rng.integers(5, 120)))]
        for _ in range(9):
            w = list(base)
            for _ in range(int(rng.integers(0, 1 + len(w) // 25))):
                w[int(rng.integers(len(w)))] = f"x{rng.integers(1000)}"
            rows.append((len(rows), " ".join(w[: len(w) - int(rng.integers(0, 6))])))
    rows += [(100 + i, "shared passage of words that many documents hold " + " ".join(f"u{i}_{j}" for j in range(30))) for i in range(20)]
    check(docs_of(rows).repartition(5), rows)


def test_chain_needs_pairs_beyond_the_star(spark, docs_of):
    # neighbours in the chain are linked, its ends are not
    rows = [(i, " ".join(f"w{j}" for j in range(i * 4, i * 4 + 80))) for i in range(12)]
    assert len(set(brute(rows).values())) == 1
    check(docs_of(rows), rows)


def test_odd_rows(spark, odd_docs):
    df = odd_docs(clash=True)
    check(df, [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


def test_copies_in_a_run_give_no_keys(spark, docs_of):
    """Rows exploded from a run's repeated keys: none for copies, in proportion to the group for near copies."""
    base = [f"w{i}" for i in range(60)]

    def near(i):
        return " ".join([*base[:-1], f"x{i}"])

    def repeated(rows):
        got = P.sketch(docs_of(rows).coalesce(1), 4, 85, "doc_id", "text").collect()
        return sum(len(r["ekeys"]) for r in got), sum(len(r["keys"]) for r in got), [r["same"] for r in got]

    alone = repeated([(0, near(0))])[1]
    for g in (20, 40):
        rows = [(i, near(0).upper() if i % 2 else near(0)) for i in range(g)]
        assert repeated(rows) == (0, alone, [None] + [0] * (g - 1))
    few, many = (repeated([(i, near(i)) for i in range(g)])[0] for g in (20, 40))
    assert few < many < 2.5 * few


def test_copies_with_null_and_repeated_ids(spark, docs_of):
    rng = np.random.default_rng(4)
    base = [[f"g{g}w{i}" for i in range(50)] for g in range(3)]

    def edited(g, p):
        w = list(base[g])
        w[p] = "edited"
        return " ".join(w)

    texts = [" ".join(b) for b in base] + [edited(g, p) for g in range(3) for p in (0, 25)] + ["", "one", "one two"]
    rows = [(None if i % 11 == 0 else int(rng.integers(0, 60)) if i % 5 == 0 else 100 + i, texts[int(rng.integers(len(texts)))]) for i in range(90)]
    rows += [(None, texts[0]), (7, texts[0]), (7, texts[1]), (8, texts[1]), (8, texts[2])]
    for parts in (1, 5):
        check(docs_of(rows).repartition(parts), rows)


def _tables(monkeypatch):
    """(tag, columns, rows) of each table that the join writes."""
    written, saved = [], P.saved

    def seen(df, tag):
        out = saved(df, tag)
        written.append((tag, out.columns, out.count()))
        return out

    monkeypatch.setattr(P, "saved", seen)
    return written


def test_keys_are_not_written(spark, docs_of, monkeypatch):
    """Keys that one document holds take no row of any table, whatever the columns' names."""
    written = _tables(monkeypatch)
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(200))) for i in range(30)]
    n_keys = sum(len(r["keys"]) for r in P.sketch(docs_of(rows), 4, 85, "doc_id", "text").collect())
    check(docs_of(rows), rows)
    assert n_keys > 50 * len(rows)
    assert not [t for t in written if "keys" in t[1] or t[2] > len(rows)]


def test_linked_groups_are_not_held(spark, docs_of, monkeypatch):
    """Near copies of one text share most keys; once they are linked, their members are not written again."""
    written = _tables(monkeypatch)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:-1], f"x{i}"])) for i in range(40)]
    check(docs_of(rows).repartition(4), rows)
    members = next(n for tag, _, n in written if tag == "parity-members")
    assert members > 20 * len(rows)
    assert not [t for t in written if t[2] > 4 * len(rows) and t[0] != "parity-members"]


def test_texts_of_kept_documents_are_not_shuffled(spark, docs_of, monkeypatch):
    rows = [(i, " ".join(f"d{i % 5}w{j}" for j in range(40))) for i in range(12)] + [(None, "no id"), (None, "no id"), (20, None)]
    for most, join in ((P.MAX_BROADCAST_IDS, "BroadcastHashJoin"), (3, "SortMergeJoin")):      # beyond, a shuffle join
        monkeypatch.setattr(P, "MAX_BROADCAST_IDS", most)
        kept = stages.one_of_each_group(spark, docs_of(rows), "")
        plan = kept._jdf.queryExecution().toString()
        assert join in plan and ("Exchange hashpartitioning" in plan) == (join == "SortMergeJoin")
        assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted((str(i), t) for i, t in rows if i is None or i < 5 or i == 20)


def test_no_rows(spark, docs_of):
    assert P.jaccard_components(docs_of([])).count() == 0


@pytest.mark.parametrize("pct", [85, 50])
def test_bands_and_left_out_blocks(pct):
    bands = P.Bands(pct)
    for n in range(1, 400):
        top = n * 100 // pct
        assert bands.of(np.array([top]))[0] - bands.of(np.array([n]))[0] in (0, 1)
    rng = np.random.default_rng(3)
    for _ in range(200):        # every linked pair shares a key, whatever blocks are left out
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = a.copy()
        for _ in range(int(rng.integers(0, 4))):
            b = np.unique(np.r_[b[rng.permutation(len(b))[1:]], rng.integers(0, 1 << 63, 1, dtype=np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both < pct * (len(a) + len(b) - both):
            continue
        keys = []
        for s in (a, b):
            at = np.array([0, len(s)])
            band = bands.of(np.array([len(s)]))
            keys.append({k for d in (0, 1) for k in P.signatures(np.sort(s), at, band + d, bands)[1]})
        assert keys[0] & keys[1]


def test_words_match_the_pattern():
    import pyarrow as pa
    texts = ["a  b\tc\x0bd", None, "", " é x  🙂 ", "\x1c\x1d q", "one"]
    for _, _, w in hashing.text_runs(pa.array(texts), lower=False, chunk=1 << 20):
        assert w.counts.tolist() == [len(WORD.findall(t or "")) for t in texts]
    runs = [w.hashes for _, _, w in hashing.text_runs(pa.array(["x y", "y x", "X Y"]), lower=True, chunk=3)]
    assert len(runs) == 3 and runs[0][0] == runs[1][1] == runs[2][0] and runs[0][1] == runs[1][0]


def test_shared_counts():
    rng = np.random.default_rng(5)
    x, y = ([np.unique(rng.integers(0, 60, int(rng.integers(0, 40)))) for _ in range(n)] for n in (13, 9))
    want = [[len(np.intersect1d(a, b)) for b in y] for a in x]
    assert P.shared_counts(x, y, block=16).astype(int).tolist() == want
    assert P.shared_counts([np.zeros(0, np.int64)], [np.zeros(0, np.int64)]).tolist() == [[0]]


@pytest.mark.parametrize("hot,tile", [(64, 512), (2, 5)])
def test_near_misses_and_hot_shingles(spark, docs_of, monkeypatch, hot, tile):
    # a big group whose pairs lie on both sides of the threshold, settled with and without tiles
    monkeypatch.setattr(P, "HOT", hot)
    monkeypatch.setattr(P, "TILE", tile)
    rng, base = np.random.default_rng(9), [f"w{i}" for i in range(60)]
    rows = []
    for i in range(70):
        w = list(base)
        for p in rng.choice(60, 3 if i % 2 else 1, replace=False):
            w[p] = f"x{i}_{p}"
        rows.append((i, " ".join(w)))
    check(docs_of(rows).repartition(4), rows)


@pytest.mark.parametrize("hot,tile,often", [(2, 5, 400_000), (64, 512, 3)])
def test_two_hot_components_and_a_common_passage(spark, docs_of, monkeypatch, hot, tile, often):
    """A third of the rows in one component, another large one and many single documents share a passage."""
    monkeypatch.setattr(P, "HOT", hot)
    monkeypatch.setattr(P, "TILE", tile)
    monkeypatch.setattr(P, "FREQUENT", often)          # how prefixes are ordered changes no link
    rng = np.random.default_rng(11)
    passage = " ".join(f"common{i}" for i in range(25))
    rows = []
    for i in range(90):
        kind = i % 3
        own = [f"k{kind}w{j}" for j in range(45)] if kind < 2 else [f"s{i}w{j}" for j in range(int(rng.integers(3, 30)))]
        for p in rng.choice(len(own), int(rng.integers(0, 3)), replace=False):
            own[p] = f"x{i}_{p}"
        rows.append((i, " ".join(own) + " " + passage))
    check(docs_of(rows).repartition(4), rows)


def test_groups_that_cross_batches(spark, monkeypatch):
    monkeypatch.setattr(P, "HOT", 6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        rng, rows = np.random.default_rng(1), []
        for g, size in enumerate([1, 2, 6, 7, 30, 1, 5, 3, 12, 2]):
            rows += [(g, 1000 * g + i, int(rng.integers(0, 3)) + 10 * g, 100) for i in range(size)]
        got = P._meetings(spark.createDataFrame(rows, "g long, id long, component long, n long"), 85).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want_hot = {(g, i, c) for g, i, c, _ in rows if sum(r[0] == g for r in rows) > 6}
    want = {(g, min(i, j), max(i, j)) for g, i, c, _ in rows for h, j, d, _ in rows if g == h and i < j and c != d and sum(r[0] == g for r in rows) <= 6}
    assert {(r["g"], r["a"], r["b"]) for r in got if r["hot"]} == want_hot
    assert {(r["g"], r["a"], r["b"]) for r in got if not r["hot"]} == want

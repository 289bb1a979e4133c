"""The stages against brute force, and every oracle SQL of the subpackage."""
import os
import zlib

import duckdb
import pytest

import corpus_pipeline
from hireframe.llm import stages
from hireframe.llm.queries import QUERIES
from hireframe.llm.sqltext import ORACLE
from tests.llm.test_line_dedup import brute as lines_brute
from tests.llm.test_parity_join import brute as groups_brute, sets_of

SF = "/root/testdata/sf0.01"
TABLES = ("documents", "embeddings", "conversations", "labels")


def key(v):
    return "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    cur = con.execute(ORACLE[name])
    cols = [c[0] for c in cur.description]
    want = sorted(tuple(key(v) for _, v in sorted(zip(cols, r))) for r in cur.fetchall())
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(tuple(key(r[c]) for c in sorted(cols)) for r in got.collect()) == want


def test_stages(spark, odd_docs, docs_of):
    passage = "\n".join(f"shared line {i} with some words in it" for i in range(10))
    rows = [(100 + i, f"start {i}\n{passage}\nend {i}", "a") for i in range(4)] + [(200 + i, " ".join(f"n{j}" for j in range(100 - i)), "b") for i in range(4)]
    docs = odd_docs(clash=True).unionByName(docs_of(rows, clash=True))
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    cut = stages.drop_repeated_lines(spark, docs, SF)
    want = lines_brute(texts, 50)
    words = lambda t: bool((t or "").encode().split())
    left = sorted(str((i, want[i, t][2] if t is not None else None)) for i, t in texts if t is None or want[i, t][1] == 0 or words(want[i, t][2]))
    assert cut.columns == docs.columns and sorted(str((r["doc_id"], r["text"])) for r in cut.collect()) == left
    one = stages.one_of_each_group(spark, cut, SF)
    rest = [(r["doc_id"], r["text"]) for r in cut.collect()]
    low = groups_brute(rest)
    assert sorted(str((r["doc_id"], r["text"])) for r in one.collect()) == sorted(str((i, t)) for i, t in rest if i is None or low[i] == i)
    mixed = stages.mix_sources(spark, one, SF)
    assert mixed.columns == docs.columns
    enc = stages.encode_tokens(spark, mixed, SF)
    assert enc.count() == mixed.count() and enc.where("n_tokens <> size(ids)").count() == 0


def near_groups(rows, k=5, pct=80):
    """Smallest id of each group of texts whose k-word shingle sets are linked, by testing all pairs."""
    sets = {i: sets_of(t, k) for i, t in rows}
    low = {i: i for i in sets}
    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= pct * len(x | y) and low[a] != low[b]:
                low = {i: min(low[a], low[b]) if c in (low[a], low[b]) else c for i, c in low.items()}
    return low


def test_near_duplicate_stage_takes_five_words_and_four_fifths(spark, docs_of):
    rows = []
    for g in range(3):
        w = [f"g{g}w{i}" for i in range(400)]
        x = [f"x{g}_{i}" for i in range(40)]
        copies = [w, w[:330], w[:180] + x + w[220:], w[:319], [*w[:100], *x[:9], *w[100:]]]      # 1, .823, .8, .795, .95
        rows += [(100 * g + i, " ".join(c)) for i, c in enumerate(copies)]
        # scattered single words replaced: .834 with 4 words, .796 with 5
        rows.append((100 * g + 50, " ".join(f"y{g}_{i}" if i % 46 == 20 else v for i, v in enumerate(w))))
    rows += [(900, "one two"), (901, "ONE two"), (902, ""), (903, "three")]
    low = near_groups(rows)
    assert low != near_groups(rows, 4, 85) and low[1] == 0 and low[2] == 0 and low[101] == 100
    one = stages.one_of_each_group(spark, docs_of(rows).repartition(3), SF)
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(i for i, _ in rows if low[i] == i)


def test_toxic_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    kept = stages.drop_toxic(spark, docs, "/root/testdata/sf0.1")
    assert kept.columns == docs.columns
    y = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    clean = [i for i in y if y[i] == 0]
    toxic = [i for i in y if y[i] == 1]
    assert sum(i in ids for i in clean) >= 0.98 * len(clean) and sum(i in ids for i in toxic) <= 0.15 * len(toxic)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_of_an_empty_table(spark, docs_of, name, stage):
    docs = docs_of([])
    out = stage(spark, docs, SF)
    assert out.count() == 0 and set(docs.columns) <= set(out.columns)


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    again = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    digest = lambda df: sorted((r["doc_id"], zlib.crc32(r["text"].encode()), r["n_tokens"]) for r in df.collect())
    rows = digest(out)
    assert rows and rows == digest(again)
    assert set(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").columns) <= set(out.columns)

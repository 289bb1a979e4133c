import re
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hireframe.llm import line_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, min_words):
    """Every run of lines with enough words that occurs earlier (and does not overlap that copy) goes."""
    where, out = defaultdict(list), {}
    docs = sorted({(i, t) for i, t in rows if t is not None}, key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    lines = {d: d[1].split("\n") for d in docs}
    for d in docs:
        ls = lines[d]
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                if sum(len(WORD.findall(x)) for x in ls[a:b]) >= min_words:
                    where[tuple(ls[a:b])].append((d, a))
    for d in docs:
        gone = set()
        for run, at in where.items():
            first = at[0]
            gone |= {p for e, a in at if e == d and (first[0] != d or a >= first[1] + len(run)) for p in range(a, a + len(run))}
        out[d] = (len(lines[d]), len(gone), "\n".join(x for i, x in enumerate(lines[d]) if i not in gone))
    return out


def check(spark, docs_of, rows, min_words):
    got = line_dedup.dedup_lines(docs_of(rows), min_words).select("doc_id", "n_lines", "n_removed", "text", "removed").collect()
    want = brute(rows, min_words)
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        if texts[r["doc_id"]] is None:
            assert (r["n_lines"], r["n_removed"], r["text"]) == (0, 0, None)
        else:
            assert (r["n_lines"], r["n_removed"], r["text"]) == want[(r["doc_id"], texts[r["doc_id"]])]
            assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]


def test_runs_of_lines(spark, docs_of):
    passage = "a b c\nd e f\n\ng h i"
    rows = [(1, "x1\n" + passage + "\ny1"), (2, "x2\n" + passage + "\ny2"), (3, "a b c\nd e f\nz"), (4, passage), (5, "x x x\n" * 7), (6, None), (7, ""),
            (8, "q\n" + passage + "\n" + passage)]
    check(spark, docs_of, rows, 6)
    check(spark, docs_of, rows, 9)
    check(spark, docs_of, rows, 1)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["a b", "c", "", "d e f", "g"]), max_size=9), min_size=1, max_size=6), st.integers(1, 6))
def test_random_lines(spark, docs_of, texts, min_words):
    check(spark, docs_of, [(i, "\n".join(t)) for i, t in enumerate(texts)], min_words)


def test_odd_rows(spark, odd_docs):
    got = line_dedup.dedup_lines(odd_docs(clash=True), 20)
    assert {"id", "key", "rank"} <= set(got.columns)
    rows = got.collect()
    assert len(rows) == 12
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["text"] is None and by[2]["text"] == "" and by[2]["n_lines"] == 1
    assert by[5]["n_removed"] == 0 and by[6]["text"] == ""          # the later copy of a long line goes
    assert by[7]["n_lines"] == 31 and by[7]["n_removed"] == 26      # the first four lines have 24 words and stay
    assert by[None]["text"] == "null id text here and more"


def test_no_rows(spark, docs_of):
    assert line_dedup.dedup_lines(docs_of([])).count() == 0


def test_many_copies_in_many_partitions(spark, docs_of):
    text = "\n".join(f"line {i} of the shared passage" for i in range(12))
    df = docs_of([(i, f"own line {i} here\n{text}") for i in range(60)])
    for n in (1, 7):
        rows = line_dedup.dedup_lines(df.repartition(n)).orderBy("doc_id").collect()
        assert rows[0]["n_removed"] == 0 and all(r["text"] == f"own line {r['doc_id']} here" for r in rows[1:])


@pytest.mark.parametrize("n", [0])
def test_word_count_is_bytes_split(n):
    assert [len(x.encode().split()) for x in ["a b", " a\tb\x0bc ", ""]] == [len(WORD.findall(x)) for x in ["a b", " a\tb\x0bc ", ""]]

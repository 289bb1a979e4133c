import pytest
from hypothesis import given
from hypothesis import strategies as st

from hireframe.llm import chat_format as C

TEXT = st.lists(st.sampled_from([*"ab\\<>[]/ \n", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<", "[ROLE]", "[END]", "é", "🙂"]), max_size=12).map("".join)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), TEXT), TEXT), max_size=6))
def test_round_trip(turns):
    text, spans = C.format_turns(turns)
    assert C.read_turns(text) == turns
    assert [C.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_null_role_and_text():
    assert C.read_turns(C.format_turns([(None, None), ("user", None)])[0]) == [("", ""), ("user", "")]


def brute_paths(rows):
    """Paths by walking up from every leaf; cost: sum of the ranks among siblings."""
    nodes = {(t, n): (p, s) for t, n, p, s in rows}
    parent = {k: (p if (k[0], p) in nodes else None) for k, (p, s) in nodes.items()}
    kids = {}
    for (t, n), p in parent.items():
        kids.setdefault((t, p), []).append(n)
    rank = {}
    for (t, p), ns in kids.items():
        for r, n in enumerate(sorted(ns, key=lambda n: (nodes[t, n][1] is None, -(nodes[t, n][1] or 0), n))):
            rank[t, n] = r
    out = {}
    for t, n in nodes:
        if (t, n) in kids:
            continue
        path, at = [], n
        while at is not None and len(path) <= len(nodes):
            path.append(at)
            at = parent[t, at]
        if at is None:
            out.setdefault(t, []).append((sum(rank[t, x] for x in path), n, path[::-1]))
    return {t: [p for _, _, p in sorted(ps)] for t, ps in out.items()}


@pytest.mark.parametrize("k", [None, 2])
def test_trees(spark, k):
    rows = [(1, 1, None, 0.0), (1, 2, 1, 0.1), (1, 3, 1, 0.9), (1, 4, 3, None), (1, 5, 3, 0.5), (1, 6, 3, 0.5), (2, 1, None, 1.0), (2, 9, 77, 1.0),
            (None, 1, None, 1.0), (None, 2, 1, 1.0), (3, 1, 2, 1.0), (3, 2, 1, 1.0), (3, 3, 2, 1.0)] + [(4, i, i - 1 if i else None, 1.0) for i in range(37)]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    got = {}
    for r in C.root_paths(nodes, k).collect():
        got.setdefault((r["tree"], r["path_rank"]), {})[r["pos"]] = r["node"]
    want = {(t, i): dict(enumerate(p)) for t, ps in brute_paths(rows).items() for i, p in enumerate(ps) if k is None or i < k}
    assert got == want and not any(t == 3 for t, _ in got)


def test_conversations_with_nulls_ties_and_clashes(spark):
    rows = [(1, 1, "user", "hi", "x"), (1, 0, "system", None, "x"), (1, 2, "assistant", "</s>", "x"), (1, 2, "assistant", "</s>", "x"), (1, None, None, "last", "x"),
            (None, 0, "assistant", "alone", "x"), (2, 0, "user", "y" * 100_000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree string")
    got = C.format_trees(C.chains(df))
    turns = sorted(C.read_turns(r["formatted"]) for r in got.collect())
    assert turns == sorted([[("system", ""), ("user", "hi"), ("assistant", "</s>"), ("assistant", "</s>"), ("", "last")],
                            [("assistant", "alone")], [("user", "y" * 100_000)]])
    assert C.format_trees(C.chains(df.limit(0))).count() == 0

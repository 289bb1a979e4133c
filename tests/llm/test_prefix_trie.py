import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hireframe.llm import prefix_trie

TALKS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                      T.StructField("text", T.StringType())])


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            text = text or ""
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5(text.encode()).hexdigest(), text))
    own = {c: [(r[2], r[4]) for r in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        full[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    out = []

    def sums(node):
        below = [sums(k) for k in kids[node]]
        leaves = sum(b[0] for b in below) or 1
        saved = sum(b[1] for b in below) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        ends = sorted(c for c in members[node] if full[c] == node)
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids[node]), leaves, saved,
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
        return leaves, saved

    if members:
        sums(())
    return out


def found(spark, rows, block, clash=False):
    df = spark.createDataFrame(rows, TALKS)
    if clash:
        df = df.select("*", *[F.lit("x").alias(c) for c in ("idx", "d1", "pos", "p1", "q1", "n", "start", "depth", "chars", "row_before", "v0")])
    return [tuple(r) for r in prefix_trie.prefix_trie(df, block).collect()]


def order(rows):
    return sorted(rows, key=repr)


def talks():
    """Shared first turns, copies, a conversation that ends inside another's block, long shared runs, turnless rebuilt ones."""
    rows = []
    for c in range(0, 130):
        n = 1 + c * 7 % 11
        for t in range(n):
            text = f"hello {t}" if c % 3 else f"hello {t} {c // 30 if t > 4 else ''}"
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", text))
    rows += [(250, t, "user", "all the same") for t in range(30)] + [(251, t, "user", "all the same") for t in range(30)]
    rows += [(301, 0, None, None), (302, 0, "", ""), (-7, 0, "user", "é🙂"), (-107, None, "user", "null turn first"), (-107, -5, "user", "second")]
    return rows


@pytest.mark.parametrize("block", [1, 4, 7])
def test_against_brute_force(spark, block):
    rows = talks()
    assert order(found(spark, rows, block)) == order(brute(rows))


def test_hot_conversation_and_copies(spark):
    """A third of all conversations equal, and one conversation with a third of all turns."""
    rows = [(c, t, "user", f"copy {t}") for c in range(400, 460) for t in range(6)]
    rows += [(999, t, "user", f"long {t // 2}") for t in range(200)]
    assert order(found(spark, rows, 4)) == order(brute(rows))


def test_odd_rows(spark):
    rows = [(None, 0, "user", "no conversation"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, 0, "user", "z"), (1, None, None, None),
            (2, 5, "user", "x" * 300_000), (100, 1, "user", ""), (103, 1, "user", "")]
    assert order(found(spark, rows, 2, clash=True)) == order(brute(rows))


def test_empty(spark):
    assert found(spark, [], 4) == [] and found(spark, [(None, 0, "user", "x")], 4) == []


def test_end_digest_of_a_hot_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 7)
    ids = spark.range(0, 1000).select(F.lit(5).cast("long").alias("p1"), (F.col("id") % 10 == 3).cast("long").alias("p2"), (F.col("id") - 500).alias("conv_id"))
    got = {r["p2"]: r["ends_sha256"] for r in prefix_trie.end_digests(ids).collect()}
    for k in (0, 1):
        want = ",".join(str(i - 500) for i in range(1000) if (i % 10 == 3) == bool(k))
        assert got[k] == hashlib.sha256(want.encode()).hexdigest()

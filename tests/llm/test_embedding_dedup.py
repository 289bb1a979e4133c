import numpy as np
import pytest

from hireframe.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, grp string"


def brute(rows, cosine):
    ok = [(i, np.asarray(v, np.float32).astype(float), lab, len(v)) for i, v, lab in rows
          if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    near = {i: set() for i, *_ in rows}
    for a in ok:
        for b in ok:
            if a[0] != b[0] and a[2:] == b[2:] and a[1] @ b[1] / (np.linalg.norm(a[1]) * np.linalg.norm(b[1])) >= cosine:
                near[a[0]].add(b[0])
    out = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(near[i]), min(seen, key=lambda x: (x is None, x)))
    return out


@pytest.mark.parametrize("shard", [2000, 60])
def test_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(E, "SHARD", shard)      # 60: several overlapping cells and parts
    rng = np.random.default_rng(1)
    base = rng.standard_normal((12, 16))
    rows = [(i, (base[i % 12] + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.2])).tolist(), int(i % 12 % 2)) for i in range(260)]
    rows += [(300 + i, rows[0][1], 0) for i in range(20)]                      # equal vectors
    rows += [(400, None, 0), (401, [0.0] * 16, 0), (402, [None] * 16, 0), (403, [float("nan")] * 16, 0), (404, rows[0][1], None), (405, [], 0),
             (406, [1.0, 0.0], 0), (407, [float("inf")] + [0.0] * 15, 0)]
    df = spark.createDataFrame([(i, v, lab, "x", "y") for i, v, lab in rows], SCHEMA)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_duplicates(df).collect()}
    want = brute(rows, 0.98)
    assert set(got) == set(want)
    found = sum(g[0] for g in got.values())
    true = sum(w[0] for w in want.values())
    assert found <= true and found >= 0.98 * true
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.98 * len(want)
    assert got[404] == (0, 404) and got[401] == (0, 401)


def test_empty_and_null_id(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert E.near_duplicates(df).count() == 0
    r = E.near_duplicates(spark.createDataFrame([(None, [1.0, 2.0], 1, "x", "y"), (5, [1.0, 2.0], 1, "x", "y")], SCHEMA)).collect()
    assert sorted(map(tuple, r), key=str) == sorted([(None, 0, None, False), (5, 0, 5, True)], key=str)


def test_audit_sees_rare_links_and_says_when_it_sees_none(spark, monkeypatch):
    monkeypatch.setattr(E, "SHARD", 150)        # several parts and chunks
    monkeypatch.setattr(E, "AUDIT", 4)
    rng = np.random.default_rng(6)
    v = rng.standard_normal((1200, 24))
    v[:60] = v[0] + rng.standard_normal((60, 24)) * 0.01           # one large group
    v[60:500:2] = v[61:501:2]                                       # and pairs
    v[60:500:2] *= 1.001
    classes = spark.createDataFrame([(i, "0:24", x.tolist(), 1) for i, x in enumerate(v)], "id long, grp string, v array<double>, copies long")
    true = {i: 59 if i < 60 else 1 if i < 500 else 0 for i in range(1200)}
    lost = {i: n if i < 60 else 0 for i, n in true.items()}         # every link of a pair is lost
    found = lambda got: spark.createDataFrame(list(got.items()), "id long, n long")
    whole = E.audit(classes, found(true), 0.98, every=1)
    assert (whole.by_link, whole.by_vector, whole.linked, whole.least()) == (1, 1, 500, 1)
    some = E.audit(classes, found(lost), 0.98, every=5)
    assert 60 < some.linked < 140 and some.by_link > 0.85 and some.by_vector < 0.25 and some.least() == some.by_vector
    apart = classes.where("id >= 500")
    assert E.audit(apart, found(true), 0.98, every=5).least() is None and E.audit(apart, found(true), 0.98, every=1).least() == 1


def test_shards_are_bounded_by_members_and_queries(spark, monkeypatch):
    monkeypatch.setattr(E, "SHARD", 50)
    # cell 1 owns three vectors, but all 400 of cell 0 are built into it and visit it
    rows = [(i, "0:2", [1.0, i / 1e4], 1, 0, [0, 1], [0, 1]) for i in range(400)]
    rows += [(400 + i, "0:2", [1.0, 0.5 + i / 1e4], 1, 1, [1, 0], [1]) for i in range(3)]
    routed = spark.createDataFrame(rows, "id long, grp string, v array<double>, copies long, owner int, build array<int>, visit array<int>")
    sizes = E.cell_sizes(routed)
    assert {r["cell"]: (r["parts"], r["chunks"]) for r in sizes.collect()} == {0: (9, 8), 1: (9, 9)}
    for dealt, part in ((E.dealt_members(routed, sizes), "part"), (E.dealt_queries(routed, sizes), "chunk")):
        assert max(r["count"] for r in dealt.groupBy("cell", part).count().collect()) <= 2 * 50
    found = E.links(routed, E.build_graph(routed), 0.98, E.BEAM).groupBy("id").sum("n").collect()
    unit = np.array([np.array(r[2]) / np.linalg.norm(r[2]) for r in rows])
    true = int((unit @ unit.T >= 0.98).sum()) - len(rows)
    assert 0.98 * true <= sum(r["sum(n)"] for r in found) <= true

"""Embedding near-dedup with robust-pruned flat graphs.

1. Equal vectors of a label form one class; everything below works on classes.
2. Cells: per label, centres fitted on a bounded sample.  A vector belongs to its nearest cell (its
   owner) and, for building, also to the second nearest, so shards overlap.  Cells with more members
   than the shard size are dealt into parts, and their visiting queries into chunks of that size.
3. Build: in each shard every vector keeps a robust-pruned list of near members and of far ones; the
   lists of a vector from all its shards are united.
4. Search: every vector visits each cell that can own a vector within the radius (the bisecting plane
   towards its own cell is nearer than the radius), starts greedily from the shard's medoid, and
   then expands through all members in range.  Only owned members count, so a link is found once.
5. Verify: every link's cosine is computed in double precision.  Recall is audited against brute
   force on a share of the vectors, by link and by vector; below ``min_recall``, or where the audited
   vectors have no link at all, the search is run again with a wider beam.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, release, saved

#: Bounds of the fit: sampled vectors of a label, centres in all, members of a shard (part of a cell).
SAMPLE_PER_LABEL = 4000
MAX_CENTRES = 4096
#: A search costs little more in a larger shard, but every visit starts anew: 8,000 vectors of 1,000 parts are 64 MB.
SHARD = 8000
#: Near and far neighbours kept of each vector, and the pruning factor.
NEAR, FAR, ALPHA = 24, 12, 1.2
#: Nearest members in whose lists a vector is entered.
BACK = 6
BEAM = 32
#: Of so many vectors one is audited by brute force, but at least ``AUDIT`` (of fewer, all).
AUDIT_EVERY = 50
AUDIT = 20_000


def _unit(rows: list | np.ndarray) -> np.ndarray:
    v = np.stack([np.asarray(x, np.float64) for x in rows]) if len(rows) else np.zeros((0, 1))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def usable(vec: str, label: str):
    c = F.col(vec)
    fine = ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(c, lambda x: x != 0)
    return F.coalesce(F.col(label).isNotNull() & c.isNotNull() & fine, F.lit(False))


def centres(classes: DataFrame, seed: int = 3) -> dict:
    """group -> centre matrix, by a few k-means rounds on a bounded, seeded sample of each group.

    Groups that need one cell only are left out.  One job fits all groups, each in a task of its own;
    at most ``MAX_CENTRES`` centres (of at most half as many groups) reach the driver.
    """
    sizes = classes.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    total = classes.count()
    share = F.floor(F.lit(MAX_CENTRES) * F.col("n") / F.lit(max(1, total)))
    sizes = sizes.select("grp", F.least(F.ceil(F.col("n") / SHARD), share, F.lit(SAMPLE_PER_LABEL // 8)).cast("int").alias("k")).where("k > 1")
    order = Window.partitionBy("grp").orderBy(F.xxhash64("id"), "id")
    some = (classes.select("id", "grp", "v").join(sizes, "grp").withColumn("place", F.row_number().over(order))
            .where(F.col("place") <= SAMPLE_PER_LABEL))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        x, k = _unit(pdf["v"].tolist()), int(pdf["k"].iloc[0])
        c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
        for _ in range(8):
            near = np.argmax(x @ c.T - 0.5 * (c * c).sum(1), axis=1)
            c = np.stack([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "cell": np.arange(len(c), dtype=np.int32), "c": c.tolist()})

    rows = some.groupBy("grp").applyInPandas(fit, "grp string, cell int, c array<double>").collect()
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r["grp"], r["cell"])):
        out.setdefault(r["grp"], []).append(r["c"])
    return {g: np.array(c) for g, c in out.items()}


def route(classes: DataFrame, cells: dict, radius: float) -> DataFrame:
    """classes plus owner (cell), build (cells of the shards to build in) and visit (cells to search)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grp, vecs = b.column(1).to_pylist(), b.column(2).to_pylist()
            owner, build, visit = [], [], []
            for g, v in zip(grp, vecs):
                c = cells.get(g)
                if c is None:
                    owner.append(0), build.append([0]), visit.append([0])
                    continue
                u = np.asarray(v) / np.linalg.norm(v)
                d = ((c - u) ** 2).sum(1)
                o = int(d.argmin())
                gap = np.sqrt(((c - c[o]) ** 2).sum(1))
                reach = (d - d[o]) <= 2 * radius * gap + 1e-9
                owner.append(o), build.append(np.argsort(d, kind="stable")[:2].tolist()), visit.append(np.flatnonzero(reach).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(owner, pa.int32()), pa.array(build, pa.list_(pa.int32())), pa.array(visit, pa.list_(pa.int32()))],
                                             names=[*b.schema.names, "owner", "build", "visit"])

    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*classes.schema.fields, T.StructField("owner", T.IntegerType()), T.StructField("build", ints), T.StructField("visit", ints)])
    return classes.mapInArrow(run, schema)


def prune(x: np.ndarray, point: np.ndarray, pool: np.ndarray, keep: int, alpha: float) -> np.ndarray:
    """Robust pruning, row by row: from ``pool`` (candidates) take the nearest left, drop the
    candidates that are ``alpha`` times nearer to it than to the point, and go on.  -1 fills the rest."""
    rows = x[pool]
    apart = lambda dots: np.sqrt(np.maximum(2 - 2 * dots, 0))  # noqa: E731  (unit vectors)
    d = apart(np.einsum("ijk,ik->ij", rows, x[point]))
    among = apart(rows @ rows.transpose(0, 2, 1))
    alive = pool != point[:, None]
    out = np.full((len(point), keep), -1)
    at = np.arange(len(point))
    for k in range(min(keep, pool.shape[1])):
        first = np.argmin(np.where(alive, d, np.inf), axis=1)
        some = alive[at, first]
        if not some.any():
            break
        out[some, k] = pool[at, first][some]
        alive &= ~((alpha * among[at, first] <= d) & some[:, None])
        alive[at, first] = False
    return out


def build_shard(ids: np.ndarray, x: np.ndarray, seed: int = 5) -> list[np.ndarray]:
    """Neighbour ids of each member: pruned near members (found by blocks) and pruned far ones.  Each
    member also enters the lists of its ``BACK`` nearest, so one at the rim of a dense group is reached."""
    n, rng = len(ids), np.random.default_rng(seed)
    start, end = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, n, 256):
        point = np.arange(a, min(a + 256, n))
        sim = x[point] @ x.T
        k = min(n, 2 * NEAR)
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        far = rng.integers(0, n, (len(point), 2 * FAR))
        lists = np.c_[prune(x, point, near, NEAR, ALPHA), prune(x, point, far, FAR, ALPHA)]
        sim[np.arange(len(point)), point] = -np.inf
        nearest = np.argpartition(-sim, min(BACK, n) - 1, axis=1)[:, :BACK]
        ok = lists >= 0
        start += [np.repeat(point, ok.sum(1)), nearest.ravel()]
        end += [lists[ok], np.repeat(point, nearest.shape[1])]
    edge = np.unique(np.concatenate(start) * n + np.concatenate(end))
    start, end = edge // max(n, 1), edge % max(n, 1)
    keep = start != end
    start, end = start[keep], end[keep]
    return np.split(ids[end], np.cumsum(np.bincount(start, minlength=n))[:-1]) if n else []


def search_shard(x: np.ndarray, ends: np.ndarray, nb: np.ndarray, q: np.ndarray, radius: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) pairs within ``radius``: greedy beam search from the medoid for all queries in
    step, then range expansion from every member in range (or a little beyond) until none is new.

    Member i's neighbours are ``nb[ends[i]:ends[i + 1]]``.  A query keeps the ``beam`` nearest members
    met so far; one without an unexpanded member in its list is finished and takes no further part.
    """
    n, m = len(x), len(q)
    seen, done = np.zeros(m * n, bool), np.zeros(m * n, bool)
    turn = np.zeros(m * n, np.int32)
    in_range, to_expand = [], []

    def measure(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distances of pairs (query * n + member), noted where they are in or near the range."""
        seen[flat] = True
        rows, cols = flat // n, flat % n
        d = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", q[rows], x[cols]), 0))
        in_range.append(flat[d <= radius + 1e-3])
        to_expand.append(flat[d <= 1.5 * radius])
        return rows, cols, d

    def expand(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Measures the neighbours of pairs' members that their query has not met yet, each once."""
        done[flat] = True
        node = flat % n
        many = ends[node + 1] - ends[node]
        at = np.arange(many.sum()) + np.repeat(ends[node] - (np.cumsum(many) - many), many)
        new = np.repeat(flat - node, many) + nb[at]
        new = new[~seen[new]]
        order = np.arange(len(new), dtype=np.int32)
        turn[new] = order
        return measure(new[turn[new] == order])

    width = min(beam, n)
    near_d, near_i, is_open = np.full((m, width), np.inf, np.float32), np.zeros((m, width), np.int64), np.zeros((m, width), bool)
    medoid = int(np.argmax(x @ x.mean(0)))
    near_d[:, 0], near_i[:, 0], is_open[:, 0] = measure(np.arange(m) * n + medoid)[2], medoid, True
    active = np.arange(m)
    for _ in range(4 * beam):
        d = np.where(is_open[active], near_d[active], np.inf)
        best = np.argpartition(d, min(4, width) - 1, axis=1)[:, :4]
        ok = np.isfinite(np.take_along_axis(d, best, 1))
        some = ok.any(1)
        active, best, ok = active[some], best[some], ok[some]
        if not len(active):
            break
        row, slot = np.nonzero(ok)
        qi, place = active[row], best[row, slot]
        is_open[qi, place] = False
        rows, cols, d = expand(qi * n + near_i[qi, place])
        nearer = d < near_d.max(1)[rows]
        rows, cols, d = rows[nearer], cols[nearer], d[nearer]
        if not len(rows):
            continue
        # the new members beside the list of their query; the nearest of both stay
        count = np.bincount(rows, minlength=m)
        hit = np.flatnonzero(count)
        line = np.searchsorted(hit, rows)
        by = np.argsort(line, kind="stable")
        col = np.arange(len(rows)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
        shape = (len(hit), width + int(count.max()))
        all_d, all_i, all_open = np.full(shape, np.inf, np.float32), np.zeros(shape, np.int64), np.zeros(shape, bool)
        all_d[:, :width], all_i[:, :width], all_open[:, :width] = near_d[hit], near_i[hit], is_open[hit]
        all_d[line[by], width + col], all_i[line[by], width + col], all_open[line[by], width + col] = d[by], cols[by], True
        stay = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        near_d[hit], near_i[hit], is_open[hit] = (np.take_along_axis(v, stay, 1) for v in (all_d, all_i, all_open))
    while True:
        flat = np.unique(np.concatenate([np.zeros(0, np.int64), *to_expand]))
        flat = flat[~done[flat]]
        to_expand.clear()
        if not len(flat):
            break
        for a in range(0, len(flat), 20_000):
            expand(flat[a: a + 20_000])
    found = np.sort(np.concatenate(in_range))
    return found // n, found % n


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the links, by repeated minima."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def cell_sizes(routed: DataFrame) -> DataFrame:
    """(grp, cell, parts, chunks) of every cell that owns a vector: its members (owners and second
    nearest) and its visiting queries are dealt into so many parts and chunks of about ``SHARD``."""
    count = lambda c, name: (routed.withColumn("cell", F.explode(c)).groupBy("grp", "cell")
                             .agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias(name)))
    owned = routed.select("grp", F.col("owner").alias("cell")).distinct()
    return owned.join(count("build", "parts"), ["grp", "cell"]).join(count("visit", "chunks"), ["grp", "cell"])


def dealt_members(base: DataFrame, sizes: DataFrame) -> DataFrame:
    """(grp, cell, part, and the columns of ``base``) of the members of each cell: owners, and the
    vectors that were built in as neighbours of owners."""
    return (base.withColumn("cell", F.explode("build")).join(sizes, ["grp", "cell"])
            .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))


def dealt_queries(routed: DataFrame, sizes: DataFrame) -> DataFrame:
    """(grp, cell, chunk, and the columns of ``routed``) of the queries that visit each cell."""
    return (routed.withColumn("cell", F.explode("visit")).join(sizes, ["grp", "cell"])
            .withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")))


def links(routed: DataFrame, graph: DataFrame, cosine: float, beam: int) -> DataFrame:
    """(id, n, root): for every class and shard visited, the copies linked to it there, and a member of
    the same component as found in that shard."""
    radius = float(np.sqrt(2 - 2 * cosine))
    sizes = saved(cell_sizes(routed), "embed-sizes")
    member = (dealt_members(routed.join(graph, "id"), sizes).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
              .select("grp", "cell", "part", "chunk", "id", "v", "copies", (F.col("owner") == F.col("cell")).alias("own"), "nb"))
    asks = (dealt_queries(routed, sizes).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select(*[F.col(c).alias(f"q_{c}") for c in ("grp", "cell", "part", "chunk", "id", "v")]))

    def run(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(members) or not len(queries):
            return pd.DataFrame({"id": [], "n": [], "root": []}).astype("int64")
        members = members.sort_values("id")
        ids, x, raw = members["id"].to_numpy(), _unit(members["v"].tolist()), np.stack([np.asarray(v, np.float64) for v in members["v"]])
        norm = np.linalg.norm(raw, axis=1)
        flat = np.concatenate([np.asarray(v, np.int64) for v in members["nb"]] + [np.zeros(0, np.int64)])
        where = np.searchsorted(ids, flat)
        where = np.where((where < len(ids)) & (ids[np.minimum(where, len(ids) - 1)] == flat), where, -1)
        owner = np.repeat(np.arange(len(ids)), [len(v) for v in members["nb"]])[where >= 0]
        ends, nb = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(ids)))], where[where >= 0]
        x = x.astype(np.float32)
        own, copies = members["own"].to_numpy(bool), members["copies"].to_numpy()
        got_id, got_n, got_root = [], [], []
        qid, qraw = queries["q_id"].to_numpy(), np.stack([np.asarray(v, np.float64) for v in queries["q_v"]])
        qnorm = np.linalg.norm(qraw, axis=1)
        pa_, pb_ = [], []
        for a in range(0, len(qid), 256):
            qi, mi = search_shard(x, ends, nb, (qraw[a: a + 256] / qnorm[a: a + 256, None]).astype(np.float32), radius, beam)
            qi = qi + a
            fine = own[mi] & (qid[qi] != ids[mi])
            qi, mi = qi[fine], mi[fine]
            near = np.zeros(len(qi), bool)
            for s in range(0, len(qi), 50_000):  # verification in double precision
                e = slice(s, s + 50_000)
                near[e] = np.einsum("ij,ij->i", qraw[qi[e]], raw[mi[e]]) / (qnorm[qi[e]] * norm[mi[e]]) >= cosine
            qi, mi = qi[near], mi[near]
            got_id.append(qid[a: a + 256])
            got_n.append(np.bincount(qi - a, copies[mi], minlength=len(qid[a: a + 256])).astype(np.int64))
            pa_.append(qid[qi])
            pb_.append(ids[mi])
        pa_, pb_ = np.concatenate(pa_), np.concatenate(pb_)
        every = np.unique(np.r_[qid, pa_, pb_])
        low = every[_labels(len(every), np.searchsorted(every, pa_), np.searchsorted(every, pb_))]
        only = np.setdiff1d(pb_, qid)
        out = pd.DataFrame({"id": np.concatenate(got_id), "n": np.concatenate(got_n)})
        out["root"] = low[np.searchsorted(every, out["id"])]
        extra = pd.DataFrame({"id": only, "n": 0, "root": low[np.searchsorted(every, only)]})
        return pd.concat([out, extra]).astype("int64")

    by = ["grp", "cell", "part", "chunk"]
    return member.groupBy(*by).cogroup(asks.groupBy(*[f"q_{c}" for c in by])).applyInPandas(run, "id long, n long, root long")


def build_graph(routed: DataFrame) -> DataFrame:
    """(id, nb): united neighbour lists from all overlapping shards."""
    rows = dealt_members(routed, cell_sizes(routed))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pd.DataFrame({"id": pdf["id"], "nb": [x.tolist() for x in build_shard(pdf["id"].to_numpy(), _unit(pdf["v"].tolist()))]})

    lists = rows.select("grp", "cell", "part", "id", "v").groupBy("grp", "cell", "part").applyInPandas(run, "id long, nb array<long>")
    return lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("nb"))).alias("nb"))


@dataclass
class Recall:
    """Audited recall: share of the true links found, its mean over the audited vectors that have links,
    their number, and whether every vector was audited."""
    by_link: float
    by_vector: float
    linked: int
    whole: bool

    def least(self) -> float | None:
        """The lower of both shares; None (not audited) where a share of the vectors showed no link."""
        return min(self.by_link, self.by_vector) if self.linked else 1.0 if self.whole else None


def audit(classes: DataFrame, found: DataFrame, cosine: float, every: int = AUDIT_EVERY) -> Recall:
    """Recall of one vector in ``every``, against all vectors of the label by brute force.

    Rows are dealt into parts and audited vectors into chunks, both of about ``SHARD``; a task compares
    one part with one chunk.
    """
    every = max(1, min(every, classes.count() // AUDIT))
    picked = classes.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(every)) == 0)
    count = lambda df, name: df.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias(name))
    sizes = count(classes, "parts").join(count(picked, "chunks"), "grp")
    key = lambda c: F.pmod(F.xxhash64("id", F.lit(6)), F.col(c)).cast("int")
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    rows = (classes.join(sizes, "grp").withColumn("part", key("parts")).withColumn("chunk", spread("chunks"))
            .select("grp", "part", "chunk", "id", "v", "copies"))
    asks = (picked.join(sizes, "grp").withColumn("chunk", key("chunks")).withColumn("part", spread("parts"))
            .select(*[F.col(c).alias(f"q_{c}") for c in ("grp", "part", "chunk", "id", "v")]))

    def run(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        qid, n = asks["q_id"].to_numpy(), np.zeros(len(asks), np.int64)
        if len(rows) and len(asks):
            ids, w = rows["id"].to_numpy(), rows["copies"].to_numpy()
            x, q = (np.stack([np.asarray(v, np.float64) for v in side]) for side in (rows["v"], asks["q_v"]))
            norm, qnorm = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
            for a in range(0, len(qid), 256):
                e = slice(a, a + 256)
                n[e] = (((q[e] @ x.T) / (qnorm[e, None] * norm) >= cosine) & (qid[e, None] != ids)) @ w
        return pd.DataFrame({"id": qid, "n": n}).astype("int64")

    by = ["grp", "part", "chunk"]
    true = (rows.groupBy(*by).cogroup(asks.groupBy(*[f"q_{c}" for c in by])).applyInPandas(run, "id long, n long")
            .groupBy("id").agg(F.sum("n").alias("n")).where("n > 0"))
    got = found.groupBy("id").agg(F.sum("n").alias("got"))
    hit = F.least(F.coalesce("got", F.lit(0)), F.col("n"))
    r = true.join(got, "id", "left").agg(F.sum(hit).alias("hit"), F.sum("n").alias("n"), F.avg(hit / F.col("n")).alias("by_vector"),
                                         F.count(F.lit(1)).alias("linked")).first()
    return Recall(r["hit"] / r["n"] if r["n"] else 1.0, 1.0 if r["by_vector"] is None else r["by_vector"], r["linked"], every == 1)


def near_duplicates(df: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    min_recall: float = 0.98, beam: int = BEAM) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row.

    Rows link when their labels are equal and not null and their cosine is at least ``cosine``; vectors
    that are null, zero, or hold null or non-finite parts link with nothing, nor do vectors of different
    lengths.  Equal vectors of a label are linked to each other.  kept: the row's id is its component's
    smallest.  Rows with a null id link with nothing and are not kept.  An empty table gives no rows.
    """
    fine = usable(vec_col, label_col) & F.col(id_col).isNotNull()
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.when(fine, F.col(vec_col).cast("array<double>")).alias("v"),
                     F.when(fine, F.concat_ws(":", F.col(label_col).cast("string"), F.size(vec_col).cast("string"))).alias("grp"))
    good = rows.where("grp is not null")
    classes = saved(good.groupBy("grp", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "grp", "v", "copies"), "embed-classes")
    routed = saved(route(classes, centres(classes), float(np.sqrt(2 - 2 * cosine))), "embed-routed")
    graph = saved(build_graph(routed), "embed-graph")
    while True:
        found = saved(links(routed, graph, cosine, beam), "embed-links")
        recall = audit(classes, found, cosine)
        least = recall.least()
        if (least is not None and least >= min_recall) or beam >= 512:
            break
        beam *= 4
        release(found)
    if least is None:
        warnings.warn(f"recall not audited: no audited vector has a link; searched with beam {beam}", stacklevel=2)
    elif least < 0.9:
        raise RuntimeError(f"recall {recall.by_link:.3f} by link, {recall.by_vector:.3f} by vector is below 0.9 at beam {beam}")
    release(graph, routed)
    comps = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "embed")
    sums = found.groupBy("id").agg(F.sum("n").alias("n"))
    facts = (classes.join(sums, "id", "left").join(comps, "id", "left")
             .select("grp", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")))
    out = rows.join(facts, ["grp", "v"], "left")
    comp = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"),
                      F.coalesce(F.col("id") == comp, F.lit(False)).alias("kept"))

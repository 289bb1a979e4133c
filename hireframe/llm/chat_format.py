"""Chat formatting of reply trees: best root-to-leaf paths as conversations with a loss mask.

Paths come from iterative self-joins with doubling steps: the 2^k-th ancestor of every message is
found from two 2^(k-1)-steps, and a leaf's path is spread out by halving it, so a chain of n
messages takes log2(n) joins.  Branches are ranked by score (siblings: higher score first, then
smaller id); a path's cost is the sum of its messages' ranks, so cost 0 always took the best branch.
Each chosen path becomes one string.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ordered_running_totals, saved

#: Marks of the template (fixed values).  A role without marks of its own is named between [ROLE] and [/ROLE].
BEGIN = "<s>"
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("", "</s>")}
ROLE, ROLE_END, OTHER_END = "[ROLE]", "[/ROLE]", "[END]"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[END]")
_ANY = "|".join(re.escape(c) for c in CONTROL)
#: A backslash or control string in a text gets a backslash before it; reading takes it away.
_ESCAPE = re.compile(rf"\\|{_ANY}")
_TOKEN = re.compile(rf"\\(\\|{_ANY})|({_ANY})")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(rf"\\(\\|{_ANY})", r"\1", text)


def format_turns(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's string, and the code-point spans that carry loss (assistant texts).
    A null role is the role "", a null text is empty."""
    parts, spans, size = [BEGIN], [], len(BEGIN)
    for role, text in turns:
        body = escape(text or "")
        head, tail = MARKS.get(role or "", (ROLE + escape(role or "") + ROLE_END, OTHER_END))
        if role == "assistant":
            spans.append((size + len(head), size + len(head) + len(body)))
        parts += [head, body, tail]
        size += len(head) + len(body) + len(tail)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation: the exact inverse of ``format_turns``."""
    if not formatted.startswith(BEGIN):
        raise ValueError("not a formatted conversation")
    turns: list[tuple[str, str]] = []
    at = len(BEGIN)
    closes = {tail: role for role, (_, tail) in MARKS.items()}
    opens = {head: role for role, (head, _) in MARKS.items() if head}

    def upto(mark: str, start: int) -> tuple[str, int]:
        for m in _TOKEN.finditer(formatted, start):
            if m[2]:
                if m[2] != mark:
                    raise ValueError(f"unexpected {m[2]} at {m.start()}")
                return unescape(formatted[start: m.start()]), m.end()
        raise ValueError(f"no {mark}")

    while at < len(formatted):
        head = next((h for h in (*opens, ROLE) if formatted.startswith(h, at)), "")
        if head == ROLE:
            role, at = upto(ROLE_END, at + len(ROLE))
            text, at = upto(OTHER_END, at)
        else:
            role = opens.get(head, closes["</s>"])
            text, at = upto(MARKS[role][1], at + len(head))
        turns.append((role, text))
    return turns


def _same(a: DataFrame, b: DataFrame, left: str, right: str) -> Column:
    return a["tree"].eqNullSafe(b["_t"]) & (a[left] == b[right])


def root_paths(nodes: DataFrame, paths_per_tree: int | None = None) -> DataFrame:
    """(tree, leaf, path_rank, pos, node) of each chosen path, pos from 0 at the root.

    ``nodes``: tree, node, parent, score; (tree, node) unique.  A parent that is null or missing makes
    a root.  A null tree is a tree of its own; rows with a null node are ignored.  Null scores rank
    last.  Messages on or below a parent cycle have no root and are on no path.  ``paths_per_tree``
    keeps the cheapest paths (ties: smaller leaf); None keeps all.  An empty table gives no rows.
    """
    n = nodes.where("node is not null").select("tree", "node", "parent", F.col("score").cast("double").alias("score"))
    known = n.select(F.col("tree").alias("_t"), F.col("node").alias("_p"))
    n = n.join(known, n["tree"].eqNullSafe(known["_t"]) & (n["parent"] == known["_p"]), "left").select(
        "tree", "node", F.col("_p").alias("parent"), "score")
    # branch ranks from one global sort: a message with very many replies is not one task
    placed = ordered_running_totals(n, ["tree", "parent", F.col("score").desc_nulls_last(), "node"], [], "chat-ranks")
    first = placed.groupBy(F.col("tree").alias("_t"), F.col("parent").alias("_p")).agg(F.min("row_before").alias("_first"))
    ranked = placed.join(first, placed["tree"].eqNullSafe(first["_t"]) & placed["parent"].eqNullSafe(first["_p"]))
    jump = saved(ranked.select("tree", "node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("len"),
                               (F.col("row_before") - F.col("_first")).alias("cost")), "chat-jump")
    largest = jump.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    parents = jump.select(F.col("tree").alias("_t"), F.col("up").alias("_p")).where("_p is not null").distinct()
    leaves = jump.join(parents, _same(jump, parents, "node", "_p"), "left_anti").select(F.col("tree").alias("_t"), F.col("node").alias("leaf"))
    jumps = []
    while 1 << len(jumps) < largest and not jump.where("up is not null").isEmpty():
        jumps.append(jump)
        far = jump.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("len").alias("_len"), F.col("cost").alias("_cost"))
        jump = saved(jump.join(far, _same(jump, far, "up", "_n"), "left").select(
            "tree", "node", F.col("_up").alias("up"), (F.col("len") + F.coalesce("_len", F.lit(0))).alias("len"),
            (F.col("cost") + F.coalesce("_cost", F.lit(0))).alias("cost")), "chat-jump")
    whole = jump.where("up is null")
    ends = whole.join(leaves, _same(whole, leaves, "node", "leaf")).select("tree", "leaf", "len", "cost")
    order = ordered_running_totals(ends, ["tree", "cost", "leaf"], [], "chat-paths")
    start = order.groupBy(F.col("tree").alias("_t")).agg(F.min("row_before").alias("_first"))
    chosen = order.join(start, order["tree"].eqNullSafe(start["_t"])).withColumn("path_rank", F.col("row_before") - F.col("_first"))
    if paths_per_tree is not None:
        chosen = chosen.where(F.col("path_rank") < paths_per_tree)
    s = chosen.select("tree", "leaf", "path_rank", F.col("leaf").alias("node"), (F.col("len") - 1).alias("pos"), F.col("len").alias("need"))
    for k in reversed(range(len(jumps))):
        hop = jumps[k].select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"))
        step = 1 << k
        s = s.join(hop, _same(s, hop, "node", "_n"), "left").withColumn("_part", F.explode(F.when(
            F.col("need") > step, F.array(
                F.struct(F.col("node"), F.col("pos"), F.lit(step).cast("long").alias("need")),
                F.struct(F.col("_up").alias("node"), (F.col("pos") - step).alias("pos"), (F.col("need") - step).alias("need"))))
            .otherwise(F.array(F.struct("node", "pos", "need"))))).select("tree", "leaf", "path_rank", "_part.*")
    return s.drop("need")


def format_trees(messages: DataFrame, paths_per_tree: int | None = None) -> DataFrame:
    """(tree, leaf, path_rank, n_turns, formatted, loss_spans) from tree, node, parent, score, role, text.

    One row per chosen path (see ``root_paths``).  A conversation is one string, so a task holds one
    conversation at a time.  Other columns are ignored.
    """
    paths = root_paths(messages, paths_per_tree)
    said = messages.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "role", "text")
    rows = paths.join(said, _same(paths, said, "node", "_n"))
    talk = rows.groupBy("tree", "leaf", "path_rank").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    schema = T.StructType([*[f for f in talk.schema.fields if f.name != "turns"], T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()),
                           T.StructField("loss_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, texts, spans = [], [], []
            for turns in b.column(3):
                t = [(x["role"], x["text"]) for x in turns.as_py()]
                text, loss = format_turns(t)
                n.append(len(t))
                texts.append(text)
                spans.append([{"start": x, "end": y} for x, y in loss])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(n, pa.int64()), pa.array(texts, pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=schema.names)

    return talk.mapInArrow(run, schema)


def chains(turns: DataFrame, tree_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """A turn table as reply trees: each turn answers the one before it (null turns last; ties by role,
    then text; repeated rows are kept).  Adds tree (a number), node, parent and score; keeps all other columns
    (input columns of the added names are replaced)."""
    turns = turns.drop("tree", "node", "parent", "score", "row_before")
    rows = ordered_running_totals(turns, [tree_col, F.col(turn_col).asc_nulls_last(), "role", "text"], [], "chat-turns")
    first = rows.groupBy(F.col(tree_col).alias("_t")).agg(F.min("row_before").alias("tree"))
    rows = rows.join(first, rows[tree_col].eqNullSafe(first["_t"])).drop("_t")
    return rows.select(*turns.columns, "tree", F.col("row_before").alias("node"), F.lit(0.0).alias("score"),
                       F.when(F.col("row_before") > F.col("tree"), F.col("row_before") - 1).alias("parent"))

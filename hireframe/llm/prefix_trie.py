"""Conversation prefix trie by fixed-length block hashing.

A conversation is a sequence of turns; a node of the trie is a distinct sequence of first turns.

1. Every turn gets 128 bits of hash from its role, text and position.  The running sums of six 21-bit
   lanes of them along a conversation name each prefix, so prefixes come from one distributed
   running total and no conversation is gathered in one row.
2. Blocks of ``BLOCK`` turns are grouped first: a conversation's prefix at the end of each block (or
   at its own end) stands for the whole block, and one conversation represents all that share it.
   Only representatives' turns go on.
3. Blocks that begin at the same prefix are siblings.  Where a block has no sibling, its turns are
   nodes with the block's members; only where siblings diverge are turn boundaries counted one by one.
4. Sums over subtrees double their reach: with sums over the descendants nearer than 2^k steps, adding
   those of the descendants at exactly 2^k steps gives 2^(k+1).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ordered_running_totals, parallelism, release, saved

BLOCK = 4
LANES = [f"v{i}" for i in range(6)]
#: Ids rendered into one piece of text before a node's pieces meet.
RUN = 4096


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, idx, d1, d2, chars) of every turn in order, and for each (start, n) of its conversation."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    brief = turns.select("conv_id", "turn", "role", F.md5("text").alias("md5"), F.length("text").cast("long").alias("chars"))
    ranked = ordered_running_totals(brief, ["conv_id", "turn", "role", "md5"], [], "trie-turns")
    sizes = ranked.groupBy("conv_id").agg(F.min("row_before").alias("start"), F.count(F.lit(1)).alias("n"))
    out = saved(ranked.join(sizes, "conv_id").select("conv_id", (F.col("row_before") - F.col("start")).alias("idx"), "n",
                                                     F.xxhash64(F.lit(1), "role", "md5").alias("d1"), F.xxhash64(F.lit(2), "role", "md5").alias("d2"), "chars"),
                "trie-order")
    release(ranked)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, pos, d1, d2, chars, total) of the rebuilt conversations, (conv_id, total) of all of them).

    The first h turns come from conversation c - c % 100, the rest are the conversation's own turns
    after its first h; h is the CRC32 of the decimal id modulo 6, so at most five turns are borrowed.
    """
    own = turns.where("idx = 0").select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).alias("h"),
                                        (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    lenders = own.where("conv_id = base").select(F.col("base").alias("_base"), F.col("n").alias("m"))
    plan = (own.join(lenders, F.col("base") == F.col("_base"), "left")
            .withColumn("k", F.least("h", F.coalesce("m", F.lit(0).cast("long"))))
            .withColumn("total", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long")))
            .select("conv_id", "base", "h", "k", "total"))
    plan = saved(plan, "trie-plan")
    mine = (turns.join(plan.drop("base"), "conv_id").where("idx >= h")
            .select("conv_id", (F.col("idx") - F.col("h") + F.col("k")).alias("pos"), "d1", "d2", "chars", "total"))
    # at most five turns of each lender, each for at most a hundred borrowers
    heads = turns.where("idx < 5 and conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.col("idx").alias("pos"), "d1", "d2", "chars")
    lent = heads.join(plan.where("k > 0"), "base").where("pos < k").select("conv_id", "pos", "d1", "d2", "chars", "total")
    return mine.unionByName(lent), plan


def lanes(first: Column, second: Column) -> list[Column]:
    return [F.shiftrightunsigned(h, 21 * i).bitwiseAND((1 << 21) - 1) for h in (first, second) for i in range(3)]


def name_of(sums: list[Column], tag: str) -> list[Column]:
    """The two longs that name a prefix, from its six lane sums."""
    return [F.xxhash64(F.lit(k), *sums).alias(f"{tag}{k}") for k in (1, 2)]


def prefixes(rows: DataFrame) -> DataFrame:
    """Every turn with the names of the prefix before it (q1, q2) and up to it (p1, p2)."""
    hashed = rows.select("conv_id", "pos", "chars", "total",
                         *[c.alias(v) for v, c in zip(LANES, lanes(F.xxhash64("pos", "d1", "d2"), F.xxhash64("d2", "d1", "pos")))])
    run = ordered_running_totals(hashed, ["conv_id", "pos"], LANES, "trie-prefix")
    start = run.where("pos = 0").select("conv_id", *[F.col(f"{v}_before").alias(f"{v}_start") for v in LANES])
    before = [F.col(f"{v}_before") - F.col(f"{v}_start") for v in LANES]
    out = saved(run.join(start, "conv_id").select("conv_id", "pos", "chars", "total", *name_of(before, "q"),
                                                  *name_of([b + F.col(v) for b, v in zip(before, LANES)], "p")), "trie-named")
    release(run)
    return out


def nodes_of(named: DataFrame, plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """(p1, p2, q1, q2, depth, chars, conv_id, n_convs) of every node; q names the parent (null: root)."""
    turns = named.withColumn("blk", F.floor(F.col("pos") / block))
    keys = ["blk", "len", "p1", "p2"]
    ends = turns.where((F.col("pos") % block == block - 1) | (F.col("pos") == F.col("total") - 1)).withColumn("len", F.col("pos") % block + 1)
    blocks = ends.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
    blocks = saved(blocks.select("conv_id", "blk", "n_convs", F.col("len"), F.col("p1").alias("b1"), F.col("p2").alias("b2")), "trie-blocks")
    # a representative's turns up to the block's end; a conversation may end one block only at each blk
    inner = turns.join(blocks, ["conv_id", "blk"]).where(F.col("pos") % block < F.col("len"))
    heads = inner.where(F.col("pos") % block == 0).select("blk", "b1", "b2", F.col("q1").alias("s1"), F.col("q2").alias("s2"))
    # everything in the first blocks lies below the root, which always branches (or costs one row)
    alone = (heads.where("blk > 0").groupBy("blk", "s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.min("b1").alias("b1"), F.min("b2").alias("b2"))
             .where("n = 1").select("blk", "b1", "b2", F.lit(True).alias("alone")))
    marked = inner.join(alone, ["blk", "b1", "b2"], "left")
    cols = ["p1", "p2", "q1", "q2", (F.col("pos") + 1).alias("depth"), "chars", "conv_id", "n_convs"]
    marked = saved(marked.select(*cols, F.coalesce("alone", F.lit(False)).alias("alone")), "trie-inner")
    split = (marked.where("not alone").groupBy("p1", "p2", "q1", "q2", "depth", "chars")
             .agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs")))
    zero = [F.lit(0).cast("long")] * len(LANES)
    root = plan.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        *name_of(zero, "p"), F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"), F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("chars"), "conv_id", "n_convs")
    out = saved(marked.where("alone").drop("alone").unionByName(split).unionByName(root), "trie-nodes")
    release(blocks, marked)
    return out


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """(p1, p2, n_children, n_leaves, saved_tokens): sums over the subtree of every node."""
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    kids = nodes.where("q1 is not null").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    state = nodes.join(kids, ["p1", "p2"], "left").select(
        "p1", "p2", F.col("q1").alias("a1"), F.col("q2").alias("a2"), F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        F.col("n_children").isNull().cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    state, reach = saved(state, "trie-sums"), 1
    while reach <= depth:
        sent = state.where("a1 is not null").groupBy(F.col("a1").alias("p1"), F.col("a2").alias("p2")).agg(
            F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
        up = state.select(F.col("p1").alias("a1"), F.col("p2").alias("a2"), F.col("a1").alias("u1"), F.col("a2").alias("u2")).where("u1 is not null")
        zero = F.lit(0).cast("long")
        added = state.join(sent, ["p1", "p2"], "left").join(up, ["a1", "a2"], "left").select(
            "p1", "p2", F.col("u1").alias("a1"), F.col("u2").alias("a2"), "n_children",
            (F.col("n_leaves") + F.coalesce("_leaves", zero)).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("_saved", zero)).alias("saved_tokens"))
        further = saved(added, "trie-sums")
        release(state)
        state, reach = further, reach * 2
    return state


def end_digests(ends: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256) from (p1, p2, conv_id): ids in order are first rendered into runs of text by
    many tasks, then each node's runs stream through its hash; only the hash's state is held."""
    n = parallelism(ends.sparkSession)
    names = ["p1", "p2", "first", "ids"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p1, p2, ids = (b.column(i).to_numpy() for i in range(3))
            new = np.r_[True, (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])] if len(p1) else np.zeros(0, bool)
            starts = np.flatnonzero(new)
            starts = np.unique(np.r_[starts, *[np.arange(x, y, RUN) for x, y in zip(starts, np.r_[starts[1:], len(ids)]) if y - x > RUN]]).astype(np.int64)
            text = [",".join(map(str, ids[x:y].tolist())) for x, y in zip(starts, np.r_[starts[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays([pa.array(p1[starts]), pa.array(p2[starts]), pa.array(ids[starts]), pa.array(text, pa.string())], names=names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            out = []
            for p1, p2, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                if (p1, p2) == now:
                    state.update(b"," + text.encode())
                    continue
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = (p1, p2), hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))],
                                             names=["p1", "p2", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, state.hexdigest()), (pa.int64(), pa.int64(), pa.string()))],
                                             names=["p1", "p2", "ends_sha256"])

    ordered = ends.select("p1", "p2", "conv_id").repartitionByRange(n, "p1", "p2", "conv_id").sortWithinPartitions("p1", "p2", "conv_id")
    rendered = ordered.mapInArrow(runs, "p1 long, p2 long, first long, ids string")
    return rendered.repartition(n, "p1", "p2").sortWithinPartitions("p1", "p2", "first").mapInArrow(digest, "p1 long, p2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations: (conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    Turns are ordered by ``turn`` (null first); equal numbers by role, then by the MD5 of the text, and
    repeated rows are turns of their own.  Null roles and texts are empty.  Rows with a null conv_id
    belong to no conversation.  Other columns are ignored.  A conversation without rebuilt turns is a member of
    the root alone.  An empty table gives no rows.  A prefix is known by 128 bits.
    """
    turns = turns_of(conversations)
    rows, plan = rebuilt(turns)
    named = prefixes(rows)
    release(turns)
    nodes = nodes_of(named, plan, block)
    zero = [F.lit(0).cast("long")] * len(LANES)
    last = named.where("pos = total - 1").select("p1", "p2", "conv_id").unionByName(plan.where("total = 0").select(*name_of(zero, "p"), "conv_id"))
    digests = saved(end_digests(last), "trie-ends")
    release(named, plan)
    sums = subtree_sums(nodes)
    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(sums.select("p1", "p2", "n_children", "n_leaves", "saved_tokens"), ["p1", "p2"])
            .join(digests, ["p1", "p2"], "left").join(parents, ["q1", "q2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))

"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame operations only).

1. Targets: the word budget is shared by weight; a target stops at ``max_repeats`` times its
   source's words and the excess is reshared by weight until none is above (water-filling).
2. Schedule: slot k takes the golden-ratio point frac(k * phi), mapped through the cumulative
   targets to a source; slots are ranked per source.
3. Blocks: the documents of a source are shuffled by a seeded hash, laid end to end and cut
   into blocks of equal word counts; the slot of rank r takes block r mod n_blocks.  A source
   stops when its slots have given its target (its last slot may be cut short); where the
   schedule ends a few slots early for a source, they follow at the end.
4. Pieces: a slot's block is a list of document spans (``pieces``); how much of a document is taken,
   and at which slot each of its passes begins, are aggregates of them (``mix``).

Nothing is sampled: a block either comes, comes again, or its turn is not reached.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, saved

#: Words of a block.
BLOCK_WORDS = 64
#: Rows that a bucket of the two-level ranks should hold.
BUCKET_ROWS = 50_000
#: One row per source is broadcast up to this many sources, else joined by shuffle.
MAX_BROADCAST_SOURCES = 50_000
#: Golden ratio as a fixed-point fraction of 2^61.
ONE = 1 << 61
PHI = 1425089352415399815
#: Cells of the unit interval by which slots and sources are joined.
CELLS = 4096

_D = "decimal(38,0)"


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, max_repeats: float) -> DataFrame:
    """(source, source_size, weight, target) from (source, size) rows.

    Sources are ordered by code point, null last; the weights repeat in that order.  With the
    sources sorted by cap/weight the capped ones are a prefix, so the level at which resharing
    settles is found from running sums, on one row per source.
    """
    per = (sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.array(*[F.lit(float(x)) for x in weights])
    per = per.withColumn("_i", F.row_number().over(order) - 1)
    per = per.withColumn("weight", F.get(w, F.pmod("_i", F.lit(len(weights))).cast("int")))
    per = per.withColumn("_cap", F.col("source_size") * F.lit(float(max_repeats)))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), "_i")
    per = per.withColumn("_all", F.sum("source_size").over(everything) * F.lit(float(share)))
    per = per.withColumn("_caps", F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)))
    per = per.withColumn("_o", F.row_number().over(by_ratio))
    per = per.withColumn("_rest", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("_all") - F.coalesce("_caps", F.lit(0.0))) / F.col("_rest")
    per = per.withColumn("_level", level)
    # the first source (by cap/weight) that stays below its cap sets the level of all that follow
    free = F.col("_level") * F.col("weight") <= F.col("_cap")
    per = per.withColumn("_final", F.min(F.when(free, F.struct(F.col("_o"), F.col("_level")))).over(everything)["_level"])
    target = F.coalesce(F.least(F.col("_cap"), F.col("_final") * F.col("weight")), F.col("_cap"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def _bucket(key: Column, digits: int) -> Column:
    return F.substring(key, 1, digits)


def schedule(targets: DataFrame, n_slots: int, chunk: int = BUCKET_ROWS) -> DataFrame:
    """(slot, source, r) of every slot 0..n_slots-1 of the low-discrepancy schedule; r ranks a source's slots.

    A point's cell is joined with the sources whose interval meets the cell, then the interval
    itself is tested: an equi-join without a broadcast, spread over the cells.  Ranks are two-level
    (slots are counted by source and chunk first), so a source with most slots is not one task.
    """
    spark = targets.sparkSession
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    t = targets.withColumn("_t", F.round("target").cast("long"))
    t = t.withColumn("_hi", F.sum("_t").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("_all", F.sum("_t").over(Window.partitionBy()))
    t = t.where("_t > 0").withColumn("_lo", F.col("_hi") - F.col("_t"))
    point = f"(cast({{}} as {_D}) * cast({ONE} as decimal(19,0))) div cast(_all as {_D})"
    t = t.select("source", F.expr(point.format("_lo")).alias("lo"), F.expr(point.format("_hi")).alias("hi"))
    width = ONE // CELLS
    t = t.withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {width}L"), F.expr(f"(hi - 1) div {width}L"))))
    slots = spark.range(n_slots).withColumn(
        "u", ((F.col("id").cast("decimal(19,0)") * F.lit(PHI).cast("decimal(19,0)")).cast(_D)
              % F.lit(ONE).cast("decimal(19,0)")).cast("long"))
    slots = slots.withColumn("cell", F.expr(f"u div {width}L"))
    hit = slots.join(t, "cell").where("u >= lo and u < hi").select("id", "source")
    hit = hit.withColumn("_chunk", F.expr(f"id div {chunk}L"))
    counts = hit.groupBy("source", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("source", "_chunk", F.coalesce(F.sum("_n").over(
        Window.partitionBy("source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    ranked = hit.withColumn("_r", F.row_number().over(Window.partitionBy("source", "_chunk").orderBy("id")) - 1)
    b = before.withColumnRenamed("source", "_s").withColumnRenamed("_chunk", "_c")
    return (ranked.join(b, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_chunk") == F.col("_c")))
            .select(F.col("id").alias("slot"), "source", (F.col("_r") + F.col("_off")).alias("r")))


def _dealt(docs: DataFrame, weights: Sequence[int], share: float, max_repeats: float, block_words: int, seed: int,
           id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(layout, slots): the rows of ``docs`` with the word offsets _start and _end in their source, and
    (slot, source, block, pass, words) of every slot that is used."""
    d = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("text_hash"),
                    F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    d = d.withColumn("_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("_id").cast("string"), F.lit("null")), F.col("size").cast("string"))))
    d = saved(d, "mix-sizes")
    n, words = d.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    targets = saved(source_targets(d.select("source", "size"), weights, share, max_repeats), "mix-targets")
    few = F.broadcast if targets.count() <= MAX_BROADCAST_SOURCES else (lambda x: x)
    n_slots = max(0, round(share * words / block_words))

    # word offsets of the shuffled documents in their source: bucket totals first, then within buckets
    digits = 1
    while 16 ** digits * BUCKET_ROWS < n:
        digits += 1
    d = d.withColumn("_b", _bucket(F.col("_key"), digits))
    per_bucket = d.groupBy("source", "_b").agg(F.sum("size").alias("_w"))
    off = per_bucket.select(F.col("source").alias("_s"), F.col("_b").alias("_ob"), F.coalesce(F.sum("_w").over(
        Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("source", "_b").orderBy("_key", "_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_end", F.sum("size").over(inside))
    t = targets.withColumnRenamed("source", "_ts")
    d = (d.join(off, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_ob")))
         .withColumn("_end", F.col("_end") + F.col("_off")).withColumn("_start", F.col("_end") - F.col("size"))
         .drop("_s", "_ob", "_off", "_w"))
    d = (d.join(few(t), F.col("source").eqNullSafe(F.col("_ts")), "left")
         .withColumn("_row", F.monotonically_increasing_id()))
    d = saved(d.select("_row", "_id", "source", "text_hash", "size", "_start", "_end", "source_size", "target"), "mix-layout")

    # slots -> the block each one takes, in which pass over its source, and how many of the block's words
    b = int(block_words)
    q = targets.withColumn("_goal", F.round("target").cast("long")).where("_goal > 0")
    q = q.withColumn("_blocks", F.expr(f"(source_size + {b - 1}) div {b}"))
    q = q.withColumn("_quota", F.expr(f"(_goal div source_size) * _blocks + (_goal % source_size + {b - 1}) div {b}"))
    q = q.select(F.col("source").alias("_ts"), "source_size", "_goal", "_blocks", "_quota")
    slots = saved(schedule(targets, n_slots), "mix-slots")
    came = slots.groupBy("source").agg(F.count(F.lit(1)).alias("_came"))
    same = F.col("source").eqNullSafe(F.col("_ts"))
    short = (q.join(came, same, "left").select("_ts", "_quota", F.coalesce("_came", F.lit(0)).cast("long").alias("_came")).where("_came < _quota")
             # one row per source: the slots that follow the schedule are numbered source by source
             .withColumn("_first", n_slots - F.col("_came") + F.coalesce(F.sum(F.col("_quota") - F.col("_came")).over(
                 Window.orderBy(F.col("_ts").isNull(), F.col("_ts")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    tail = (short.withColumn("r", F.explode(F.expr("sequence(_came, _quota - 1)")))
            .select((F.col("_first") + F.col("r")).alias("slot"), F.col("_ts").alias("source"), "r"))
    s = slots.unionByName(tail).join(few(q), same).where("r < _quota")
    s = s.withColumn("_from", F.expr(f"(r div _blocks) * source_size + (r % _blocks) * {b}"))
    return d, s.select("slot", "source", F.expr("r % _blocks").alias("block"), F.expr("r div _blocks").alias("pass"),
                       F.least(F.lit(b), F.col("_goal") - F.col("_from")).alias("words"))


def _parts(layout: DataFrame, b: int) -> DataFrame:
    """``layout`` once for every block that a document has words in."""
    return layout.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(_start div {b}L, (_end - 1) div {b}L)")))


def pieces(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, max_repeats: int = 2,
           block_words: int = BLOCK_WORDS, seed: int = 9, id_col: str = "doc_id", text_col: str = "text",
           source_col: str = "source") -> DataFrame:
    """(slot, source, block, id_col, text_hash, start, end): the mix in the order of its schedule.

    Slots follow each other by number (a number whose source had its target already is not used); the
    pieces of a slot are the words start..end-1 of documents, in ``mix`` added up to ``taken``.
    """
    b = int(block_words)
    d, s = _dealt(docs, weights, share, max_repeats, block_words, seed, id_col, text_col, source_col)
    s = s.select("slot", F.col("source").alias("_ss"), F.col("block").alias("_sb"), "words")
    return (_parts(d, b).join(s, F.col("source").eqNullSafe(F.col("_ss")) & (F.col("block") == F.col("_sb")))
            .select("slot", "source", "block", F.col("_id").alias(id_col), "text_hash",
                    (F.greatest(F.col("_start"), F.col("block") * b) - F.col("_start")).alias("start"),
                    (F.least(F.col("_end"), F.col("block") * b + F.col("words")) - F.col("_start")).alias("end"))
            .where("end > start"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, max_repeats: int = 2,
        block_words: int = BLOCK_WORDS, seed: int = 9, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """(id_col, text_hash, size, source, source_size, target, taken, first_slots) for every row of ``docs``.

    size: words of the text (null: 0); taken: words that the mix takes, repeats counted, at most
    ``max_repeats`` times the size; first_slots: for each pass over the source (the first, the
    repeats) the first slot that takes words of the row, or null.  Null ids and null sources are kept
    (a null source is a source
    of its own, last in order); rows that agree in id, source and size share their words evenly
    by position and each is returned.  A source without words has target 0.  An empty table gives
    no rows.  The result depends on the rows only, not on their partitioning.
    """
    b = int(block_words)
    d, s = _dealt(docs, weights, share, max_repeats, block_words, seed, id_col, text_col, source_col)
    copies = s.groupBy(F.col("source").alias("_cs"), F.col("block").alias("_cb"), "words", "pass").agg(
        F.count(F.lit(1)).alias("copies"), F.min("slot").alias("slot"))
    w = F.least(F.col("_end"), F.col("block") * b + F.col("words")) - F.greatest(F.col("_start"), F.col("block") * b)
    got = (_parts(d.select("_row", "source", "size", "_start", "_end"), b)
           .join(copies, F.col("source").eqNullSafe(F.col("_cs")) & (F.col("block") == F.col("_cb")))
           .withColumn("_w", w).where("_w > 0").groupBy("_row")
           .agg(F.sum(F.col("_w") * F.col("copies")).alias("taken"),
                F.array(*[F.min(F.when(F.col("pass") == k, F.col("slot"))) for k in range(math.ceil(max_repeats))]).alias("first_slots")))
    return (d.join(got, "_row", "left")
            .select(F.col("_id").alias(id_col), "text_hash", "size", "source", "source_size", "target",
                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slots"))


def materialise(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                max_repeats: int = 2) -> DataFrame:
    """The mix as whole documents, in the order of the schedule: each row of ``docs`` as often as its
    words are taken, half a copy and more counting as one; its first copy comes at the first slot of its
    first pass, the next at that of its next pass.  Rows equal in id, source and text share their words
    evenly.  Rows without words have nothing to give and go."""
    passes = [F.min(F.get("first_slots", F.lit(k))) for k in range(math.ceil(max_repeats))]
    per = mixed.groupBy(id_col, "source", "text_hash").agg(F.sum("taken").alias("t"), F.sum("size").alias("z"),
                                                           F.sort_array(F.array_compact(F.array(*passes))).alias("slots"))
    per = per.withColumn("copies", F.expr("case when z > 0 then (2 * t + z) div (2 * z) else 0 end")).where("copies > 0")
    i, s, h, n, c, at = (fresh(docs, x) for x in ("_id", "_source", "_hash", "_copies", "_copy", "_slots"))
    per = per.select(F.col(id_col).alias(i), F.col("source").alias(s), F.col("text_hash").alias(h), F.col("copies").alias(n), F.col("slots").alias(at))
    same = F.col(id_col).eqNullSafe(F.col(i)) & F.col(source_col).eqNullSafe(F.col(s)) & (F.xxhash64(text_col) == F.col(h))
    rows = docs.join(per.hint("merge"), same).withColumn(c, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
    slot = F.get(at, (F.least(F.col(c), F.size(at).cast("long")) - 1).cast("int"))
    return rows.withColumn(at, slot).orderBy(at, i, h, c).select(docs.columns)

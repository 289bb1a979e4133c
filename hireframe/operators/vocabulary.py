"""Vocabulary and sequence encoding.

Token ids: 0 = '<pad>', 1 = '<unk>', then tokens by frequency (descending),
ties by first appearance in dataset order (the row key order, then position).
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.ordering import rank_by_sort, top_k_is_small
from ..functions.sizing import broadcast_if_small
from ..functions.text import first_tokens, pad_ids, word_tokens

PAD, UNK = "<pad>", "<unk>"
# Largest vocabulary that is held as a constant in each task.
MAX_IN_ROW_TOKENS, MAX_IN_ROW_BYTES = 100_000, 4 << 20
POS_RADIX = 10 ** 12   # positions below 10^12 pack exactly next to any 64-bit key


def exploded_tokens(df: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """(key, pos, token) for every word token, pos 0-based."""
    return df.select(F.col(key_col), F.posexplode(word_tokens(F.col(text_col))).alias("pos", "token"))


def _first_key(df: DataFrame, key_col: str):
    """Order key of a token occurrence: (row key, position).

    For integral keys it is packed into one exact DECIMAL(38,0)
    (key * 10^12 + pos), which hash aggregation can minimise in place; other
    keys fall back to a struct (sort-based aggregation).
    """
    if isinstance(df.schema[key_col].dataType, IntegralType):
        return (F.col(key_col).cast("decimal(38,0)") * F.lit(POS_RADIX).cast("decimal(38,0)")
                + F.col("pos").cast("decimal(38,0)")).cast("decimal(38,0)")
    return F.struct(F.col(key_col).alias("k"), F.col("pos"))


def token_counts(df: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """A5: (token, n, first) with ``first`` ordering the first occurrence
    (row key, then position).  Partial aggregation combines hot tokens map-side."""
    ex = exploded_tokens(df, key_col, text_col)
    return ex.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min(_first_key(df, key_col)).alias("first"))


def build_vocabulary(df: DataFrame, key_col: str, text_col: str, max_tokens: int | None = 50000,
                     checkpoint: bool = True) -> DataFrame:
    """(token STRING, id INT) with the two special tokens first.

    When the top ``max_tokens - 2`` tokens times the partition count is small,
    a per-partition top-k (TakeOrderedAndProject) picks them; otherwise (and
    without a cap) ids come from a distributed range sort with per-partition
    offsets (:func:`rank_by_sort`), never from a single-task merge or window.
    The result is checkpointed to the shared folder (it is reused by every
    encoding and its size check).
    """
    spark = df.sparkSession
    counts = token_counts(df, key_col, text_col)
    order = [F.col("n").desc(), F.col("first")]
    specials = spark.createDataFrame([(PAD, 0), (UNK, 1)], "token string, id int")
    k = max(max_tokens - 2, 0) if max_tokens else None
    if k is not None and top_k_is_small(counts, k):
        top = counts.orderBy(*order).limit(k)
        ranked = top.select("token", (F.row_number().over(Window.orderBy(*order)) + 1).cast("int").alias("id"))
    else:
        ranked = rank_by_sort(counts, order, out="_r")
        if k is not None:
            ranked = ranked.filter(F.col("_r") <= k)
        ranked = ranked.select("token", (F.col("_r") + 1).cast("int").alias("id"))
    vocab = specials.unionByName(ranked)
    if checkpoint:
        # built once, then size-checked and joined by every encoding: cut lineage here
        from ..session import shared_dir
        shared_dir(spark)
        vocab = vocab.checkpoint(eager=True)
    return vocab


def in_row_table(vocabulary: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> Column | None:
    """The vocabulary as one constant: an array of small maps, a token's map being named by its CRC32
    modulo their number.  Every task holds the constant once and probes it inside the row.  None when
    the table has more rows or bytes than may be held so (counted in one job before anything is collected).
    """
    max_rows = MAX_IN_ROW_TOKENS if max_rows is None else max_rows
    max_bytes = MAX_IN_ROW_BYTES if max_bytes is None else max_bytes
    known = vocabulary.where(F.col("token").isNotNull())
    n, size = known.agg(F.count(F.lit(1)), F.sum(F.octet_length("token"))).first()
    if n > max_rows or (size or 0) > max_bytes:
        return None
    buckets: list[dict[str, int]] = [{} for _ in range(max(1, n // 2))]
    for r in known.select("token", "id").collect():
        buckets[zlib.crc32(r["token"].encode()) % len(buckets)][r["token"]] = r["id"]
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def token_ids(words: Column, table: Column) -> Column:
    """Ids of an array of tokens, by ``in_row_table``; unknown tokens are 1."""
    def probe(w: Column) -> Column:
        bucket = F.get(table, F.pmod(F.crc32(w.cast("binary")), F.size(table)).cast("int"))
        return F.coalesce(F.try_element_at(bucket, w), F.lit(1))
    return F.transform(words, probe)


def encode_tokens(df: DataFrame, key_col: str, text_col: str, vocabulary: DataFrame,
                  sequence_length: int | None = None, padding_idx: int = 0, out: str = "ids") -> DataFrame:
    """(key, ids ARRAY<INT>): unknown tokens -> 1; optional truncate/pad.

    A vocabulary of bounded size is probed inside each row (:func:`in_row_table`): no explode, no
    exchange.  With a larger one tokens are exploded, joined to it and regrouped per row in position
    order.  A sequence length cuts the tokens before either.  Null and empty texts have no ids.
    """
    if sequence_length is not None and sequence_length > 0:
        words = first_tokens(text_col, sequence_length)   # truncate first: at most L tokens per text
    else:
        words = word_tokens(F.col(text_col)) if sequence_length is None else F.slice(word_tokens(F.col(text_col)), 1, sequence_length)
    table = in_row_table(vocabulary)
    if table is not None:
        coded, ids = df.select(key_col, token_ids(words, table).alias("_ids")), F.col("_ids")
    else:
        coded, ids = _encoded_by_join(df, key_col, words, vocabulary), F.transform(F.col("_items"), lambda x: x.getField("id"))
    if sequence_length is not None:
        ids = pad_ids(ids, sequence_length, padding_idx)
    return coded.select(key_col, ids.alias(out))


def _encoded_by_join(df: DataFrame, key_col: str, words: Column, vocabulary: DataFrame) -> DataFrame:
    """(key, _items) for vocabularies that are too large for a constant."""
    toks = df.select(F.col(key_col), F.posexplode_outer(words).alias("pos", "token"))
    vocab = broadcast_if_small(vocabulary.select("token", F.col("id").alias("_id")))
    j = toks.join(vocab, "token", "left")
    item = F.when(F.col("token").isNotNull(), F.struct("pos", F.coalesce(F.col("_id"), F.lit(1)).alias("id")))
    return j.groupBy(key_col).agg(F.sort_array(F.collect_list(item)).alias("_items"))


def longest_sequence(df: DataFrame, ids_col: str = "ids") -> int:
    """The longest token sequence (one aggregate)."""
    return int(df.agg(F.max(F.size(ids_col))).first()[0] or 0)


def pad_to_longest(df: DataFrame, ids_col: str = "ids", max_len: int | None = None,
                   padding_idx: int = 0) -> DataFrame:
    """pad every sequence to ``max_len`` or to the longest one."""
    L = max_len if max_len is not None else longest_sequence(df, ids_col)
    return df.withColumn(ids_col, pad_ids(F.col(ids_col), L, padding_idx))

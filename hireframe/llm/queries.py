"""The registered ``opN_<name>`` queries: production parameters over the whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, byte_bpe, chat_format, compression_quality, embedding_dedup, line_dedup, mixing, packing, parity_join, prefix_trie,
               quality_cascade, sharding, sp_codec, toxicity)
from .common import ship_code, table
from .labelled import id_remainder
from .sqltext import ORACLE  # noqa: F401

QUERIES: dict = {}


def register(fn):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_code(spark)
        return fn(spark, sf_dir)

    query.__name__, query.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = query
    return query


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Place of the public tokenizer file (installed beside Python; only its path is known here)."""
    import public_tokenizers
    return public_tokenizers.path(name)


@register
def op1_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, d, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_removed", "text")


@register
def op2_chat_format(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    ok = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                               F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    nodes = chat_format.chains(turns.unionByName(ok))
    talks = chat_format.format_trees(nodes.select("tree", "node", "parent", "score", "role", "text"))
    names = nodes.where("parent is null").select("tree", "conv_id")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns = chat_format.read_turns(text)
                loss = "".join(chat_format.unescape(text[s["start"]: s["end"]]) for s in spans)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]],
                                             names=["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    read = talks.select("tree", "formatted", "loss_spans").mapInArrow(
        digests, "tree long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return names.join(read, "tree").drop("tree")


@register
def op3_embedding_dedup(spark: SparkSession, d: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, d, "embeddings"))


@register
def op4_quality_cascade(spark: SparkSession, d: str) -> DataFrame:
    return quality_cascade.quality_filter(table(spark, d, "documents")).drop("first_failed")


@register
def op5_parity_join(spark: SparkSession, d: str) -> DataFrame:
    return parity_join.jaccard_components(table(spark, d, "documents").select("doc_id", "text"))


@register
def op6_byte_shards(spark: SparkSession, d: str) -> DataFrame:
    rows = sharding.shard_by_bytes(table(spark, d, "documents"), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def _scored(spark: SparkSession, d: str, operator, label: str, mod: int, rest: int) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels")
    held_out = id_remainder("doc_id", mod) == rest
    model, curve = operator.fit(docs, labels, ~held_out, label_col=label)
    rows = operator.score(docs, model, curve)
    return rows.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                       (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register
def op7_compression_quality(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, compression_quality, "quality", 5, 0)


@register
def op8_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, toxicity, "toxic", 4, 2)


@register
def op9_mix_schedule(spark: SparkSession, d: str) -> DataFrame:
    """first_slot, second_slot: the slot of the schedule at which each pass first takes words of the row (-1: none)."""
    rows = mixing.mix(table(spark, d, "documents"))
    slot = lambda i: F.coalesce(F.get("first_slots", F.lit(i)), F.lit(-1)).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", "taken", slot(0).alias("first_slot"), slot(1).alias("second_slot"))


@register
def op10_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    model = sp_codec.read_model(tokenizer_path())
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = sp_codec.encode(docs, model, decoded=True)
    covered = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda n, x: n + x)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
                       covered.alias("n_span_bytes"))


@register
def op11_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, d, "conversations"))


@register
def op12_token_alignment(spark: SparkSession, d: str) -> DataFrame:
    spec, model = byte_bpe.read_spec(tokenizer_path("byte_bpe_50k.json")), sp_codec.read_model(tokenizer_path())
    rows = alignment.align(table(spark, d, "documents"), spec, model, digest=True)
    return rows.withColumnRenamed("groups", "groups_sha256")


@register
def op13_histogram_packing(spark: SparkSession, d: str) -> DataFrame:
    rows = packing.pack(table(spark, d, "documents"), byte_bpe.read_spec(tokenizer_path("byte_bpe_50k.json")))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

import hashlib
import re

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from hireframe.llm import sp_codec  # noqa: E402
from hireframe.llm.queries import tokenizer_path  # noqa: E402

MODEL = sp_codec.read_model(tokenizer_path())
LIB = sentencepiece.SentencePieceProcessor(model_proto=MODEL)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from([*" ▁ab\n.é🙂漢\x00", "</s>", "  "]), st.characters(codec="utf-8")), max_size=30).map("".join), max_size=4))
def test_ids_and_spans(texts):
    c = sp_codec.codec(MODEL)
    ids = c.ids_of(texts)
    assert [i.tolist() for i in ids] == [LIB.encode(t) for t in texts]
    many = c.spans_of(texts, ids)
    for k, (t, i) in enumerate(zip(texts, ids)):
        starts, ends = c.spans(t, i)
        assert many[0][k].tolist() == starts.tolist() and many[1][k].tolist() == ends.tolist()
        data = t.encode()
        assert b"".join(data[a:b] for a, b in zip(starts, ends)) == data        # the spans tile the text
        for a, b, piece in zip(starts, ends, LIB.id_to_piece(i.tolist())):
            if not piece.startswith("<0x"):
                assert piece.replace(sp_codec.SPACE, " ").encode().endswith(data[a:b].replace(sp_codec.SPACE.encode(), b" "))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_character_map_against_the_library(rule):
    from sentencepiece import sentencepiece_model_pb2 as pb
    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    proto = pb.ModelProto()
    proto.ParseFromString(lib.serialized_model_proto())
    cmap = sp_codec.CharsMap(proto.normalizer_spec.precompiled_charsmap)
    for t in ["Ａｂｃ ﬁ ½ é", "①②x", "ｶﾞガ", "한글", "Ångström", "...…", "plain", "㍿ ＄"]:
        data, align = cmap.apply(t)
        assert re.sub(" +", "▁", data.decode().strip()) == lib.normalize(t).lstrip("▁")
        assert len(align) == len(data) + 1 and align[-1] == len(t.encode()) and (align[1:] >= align[:-1]).all()
        starts = {len(t[:i].encode()) for i in range(len(t) + 1)}
        assert set(align.tolist()) <= starts


def test_squeezed_spaces_keep_their_source():
    c = sp_codec.Codec(MODEL)
    c.squeeze = True
    out, spread = c.normalise("  ab   c  ")
    assert out.decode() == "▁ab▁c" and spread.tolist() == [2, 2, 2, 2, 3, 4, 4, 4, 7, 10]


def test_table(spark, odd_docs, docs_of):
    df = odd_docs(clash=True)
    rows = sp_codec.encode(df, MODEL, decoded=True).collect()
    assert len(rows) == 12
    for r in rows:
        want = LIB.encode(r["text"] or "", add_eos=True)
        assert r["ids"] == want and r["decoded"] == LIB.decode(want) and r["ends"][-1] == len((r["text"] or "").encode())
    again = sp_codec.decode(sp_codec.encode(df, MODEL, spans=False), MODEL).collect()
    assert sorted(str(r["decoded"]) for r in again) == sorted(str(r["decoded"]) for r in rows)
    assert sp_codec.encode(docs_of([]), MODEL).count() == 0


def test_span_bytes_and_stage_come_from_the_projected_spans(spark, odd_docs, monkeypatch):
    from hireframe.llm import queries, stages
    docs = odd_docs(clash=True)
    sizes = sorted((str(r["doc_id"]), len((r["text"] or "").encode())) for r in docs.collect())
    monkeypatch.setattr(queries, "table", lambda *a: docs)
    run = lambda: sorted((str(r["doc_id"]), r["n_span_bytes"]) for r in queries.QUERIES["op10_sentencepiece"](spark, "").collect())
    assert run() == sizes
    for r in stages.encode_tokens(spark, docs, "").collect():
        data, ids = (r["text"] or "").encode(), r["ids"]
        assert len(r["starts"]) == len(r["ends"]) == len(ids) == r["n_tokens"] and r["starts"][-1] == r["ends"][-1] == len(data)
        assert b"".join(data[a:b] for a, b in zip(r["starts"], r["ends"])) == data
    encode = sp_codec.encode

    def lose_one(*args, **kw):      # a projection that loses the first piece shows
        from pyspark.sql import functions as F
        rows = encode(*args, **kw)
        return rows.withColumn("starts", F.slice("starts", 2, 1 << 30)).withColumn("ends", F.slice("ends", 2, 1 << 30))

    monkeypatch.setattr(sp_codec, "encode", lose_one)
    assert run() != sizes


def test_query_digests(spark):
    from hireframe.llm.queries import QUERIES
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in QUERIES["op10_sentencepiece"](spark, d).collect():
        ids = LIB.encode(texts[r["doc_id"]] or "", add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()

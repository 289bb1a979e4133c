import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("sentencepiece")
pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from hireframe.llm import alignment, byte_bpe, sp_codec  # noqa: E402
from hireframe.llm.queries import tokenizer_path  # noqa: E402

SPEC, MODEL = byte_bpe.read_spec(tokenizer_path("byte_bpe_50k.json")), sp_codec.read_model(tokenizer_path())
LIB = Tokenizer.from_str(SPEC)
LIB.encode_special_tokens = True
#: A few letters, blanks, marks, other scripts and strings of special tokens.
PARTS = st.one_of(st.sampled_from([*" ab\n\t.'é🙂漢\x00\x85 ▁", "  ", "the ", "don't", "<|endoftext|>", "</s>", "12345"]), st.characters(codec="utf-8"))


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=40).map("".join))
def test_ids_are_the_librarys(text):
    assert byte_bpe.byte_bpe(SPEC).ids(text).tolist() == LIB.encode(text, add_special_tokens=False).ids


def test_ids_of_very_long_texts():
    for text in (" " * 1_500_000 + "x", "ab" * 300_000, "\n" * 300_000):
        assert byte_bpe.byte_bpe(SPEC).ids(text).tolist() == LIB.encode(text, add_special_tokens=False).ids


def tokens(text):
    """(A ids, B ids, A ends, B ends) by the libraries, or empty lists."""
    if not text:
        return [], [], [], []
    data, letters = (" " + text).encode(), byte_bpe.byte_letters()
    a, b = LIB.encode(" " + text, add_special_tokens=False).ids, alignment.piece_model(MODEL).sp.encode(text)
    ab = [bytes(letters[c] for c in LIB.id_to_token(i)) for i in a]
    bb = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in alignment.piece_model(MODEL).sp.id_to_piece(b)]
    if b"".join(ab) != data or b"".join(bb) != data:
        return [], [], [], []
    return a, b, np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()


def brute(texts):
    pairs, per_doc = Counter(), []
    for text in texts:
        a, b, ea, eb = tokens(text)
        links = []
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                if max(([0] + ea)[i], ([0] + eb)[j]) < min(ea[i], eb[j]):
                    links.append((x, y))
        both = sorted(set(ea) & set(eb))
        groups, i, j = [], 0, 0
        for e in both:
            ni, nj = ea.index(e) + 1, eb.index(e) + 1
            groups.append(",".join(map(str, a[i:ni])) + "|" + ",".join(map(str, b[j:nj])))
            i, j = ni, nj
        pairs.update(links)
        per_doc.append((a, b, links, ";".join(groups)))
    best = defaultdict(int)
    for (_, y), n in pairs.items():
        best[y] = max(best[y], n)
    return [(len(a), len(b), g.count(";") + 1 if g else 0, len(k), sum(pairs[x] == best[x[1]] for x in k), sum(pairs[x] for x in k), g) for a, b, k, g in per_doc], pairs


TEXTS = ["the cat sat on the mat", "the cat sat on the mat", "Ünïcode 🙂 words and 漢字 text\n\twith blanks  ", None, "", " ", "▁ marks", "x\x00y </s> <|endoftext|>",
         "unbelievable misunderstandings of internationalisation " * 30, "the " * 200, "a", " a", "\n", "the mat sat on a cat " * 7]


@pytest.mark.parametrize("most_links", [1, 300, alignment.LINKS])
def test_against_brute_force(spark, docs_of, most_links):
    docs = docs_of([(i // 2 if i > 3 else (None if i == 3 else i), t) for i, t in enumerate(TEXTS)], clash=True)
    got = [tuple(r) for r in alignment.align(docs, SPEC, MODEL, most_links=most_links).collect()]
    want, _ = brute(TEXTS)
    ids = [r["doc_id"] for r in docs.collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, *w)) for i, w in zip(ids, want))
    hashed = [tuple(r) for r in alignment.align(docs, SPEC, MODEL, digest=True, most_links=most_links).collect()]
    assert sorted(map(repr, hashed)) == sorted(repr((*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "")) for r in got)


def test_pair_counts(spark, docs_of):
    docs = docs_of(list(enumerate(TEXTS * 40)))
    rows = alignment.postings(docs.repartition(3), SPEC, MODEL, most_links=500)
    _, pairs = brute(TEXTS)
    got = {(r["a"], r["b"]): (r["n_links"], r["n_docs"]) for r in alignment.pair_counts(rows).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: 40 * n for k, n in pairs.items()}
    per = Counter(p for t in TEXTS for p in set(brute([t])[1]))
    assert {k: v[1] for k, v in got.items()} == {k: 40 * n for k, n in per.items()}


def test_counts_joined_by_shuffle(spark, docs_of):
    """The table of counts is too large for a broadcast."""
    rows = alignment.postings(docs_of(list(enumerate(TEXTS))), SPEC, MODEL, most_links=300)
    pairs = alignment.pair_counts(rows)
    one, two = ([tuple(r) for r in alignment.scores(rows, pairs, n).orderBy("container", "ord").collect()] for n in (10 ** 6, 0))
    assert one == two


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 199), st.integers(1, 40)), min_size=1, max_size=300), st.integers(200, 3000))
def test_planes_round_trip(raw, width):
    rows = sorted({(k, d): n for k, d, n in raw}.items())
    keys, docs, times = (np.array(x, np.int64) for x in ([r[0][0] for r in rows], [r[0][1] for r in rows], [r[1] for r in rows]))
    first, lists, offsets, data = alignment.planes(keys, docs, times, width)
    row, doc, plane = alignment.read_planes(lists, offsets, data, width)
    back = Counter()
    for r, d, p in zip(row.tolist(), doc.tolist(), plane.tolist()):
        back[int(keys[first[r]]), d] += 1 << p
    assert back == Counter(dict(rows))


def test_odd_and_empty_tables(spark, odd_docs, docs_of):
    got = alignment.align(odd_docs(clash=True), SPEC, MODEL).collect()
    assert len(got) == 12 and all(r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"] for r in got)
    assert alignment.align(docs_of([]), SPEC, MODEL).collect() == []
    none = alignment.align(docs_of([(1, None), (2, "")]), SPEC, MODEL).collect()
    assert [tuple(r)[1:] for r in none] == [(0, 0, 0, 0, 0, 0, "")] * 2

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lockfleet.llm import bpe, token_histogram
from lockfleet.llm.pretokenize import pieces

PATH = P.path("byte_bpe_50k.tiktoken")
SCHEMA = "token_ids string, doc_id long, text string, n_tokens int"


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return bpe.Codec(f.read())


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def same(codec, library, texts):
    got = list(codec.encode(texts))
    assert got == [b" ".join(b"%d" % i for i in library.encode_ordinary(t)) for t in texts]
    assert codec.decode(got) == [t.encode() for t in texts]


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.one_of(st.sampled_from("ab's tremvldSé1٣²\n\t 　.,!’"), st.characters(codec="utf-8")), max_size=30), min_size=1, max_size=8))
def test_any_text(codec, library, texts):
    same(codec, library, texts)


def test_chosen_texts(codec, library):
    same(codec, library, ["", " ", "   ", "a  ", "\n\n b", "it's we'll I'd'd 's 'S ''s", "x" * 3000, "ab" * 5000 + " !" * 300, " " * 5000 + "a", "é" * 900, "<|endoftext|>", "'", "a'", "a're", "\r\n x", "\0a\0"])


def test_every_codepoint(codec, library):
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for k in range(0, len(chars), 20000):
        same(codec, library, [f"a{c}1{c} {c}" for c in chars[k : k + 20000]])


def test_pieces_and_offsets(codec):
    texts = ["it's  fine\n now", "", "a"]
    for text, (own, at) in zip(texts, pieces(texts)):
        assert "".join(own) == text and [text[i:].startswith(p) for p, i in zip(own, at.tolist())] == [True] * len(own)


def test_columns(spark, library):
    rows = [("x", 1, "Hello wörld's", 0), ("x", 2, None, 0), ("x", 2, "", 0), ("x", None, "word " * 20000, 0), ("x", 1, "Hello wörld's", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    enc = bpe.encoded(docs, PATH)
    assert enc.columns == [*docs.columns, "_token_ids", "token_offsets"]
    for r, (_, _, t, _) in zip(enc.collect(), rows):
        assert r["_token_ids"] == library.encode_ordinary(t or "")
        assert r.token_offsets == [sum(len(library.decode_single_token_bytes(i)) for i in r["_token_ids"][:k]) for k in range(min(50, len(r.token_offsets)))] + r.token_offsets[50:]
    back = bpe.decoded(enc, PATH, "_token_ids").collect()
    assert [r.decoded for r in back] == [t or "" for _, _, t, _ in rows]
    again = bpe.decoded(bpe.decoded(enc, PATH, "_token_ids"), PATH, "_token_ids")
    assert again.columns[-2:] == ["decoded", "_decoded"] and all(r.decoded == r._decoded for r in again.collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = [library.encode_ordinary(t or "") for _, _, t, _ in rows]
    want = [(r[1], len(i), sha(" ".join(map(str, i)).encode()), sha((r[2] or "").encode())) for r, i in zip(rows, ids)]
    assert list(map(tuple, bpe.digests(docs, PATH).collect())) == want
    assert bpe.digests(docs.limit(0), PATH).count() == 0


def test_histogram(spark, library):
    rng = random.Random(1)
    texts = [None, "", *("word " * rng.choice([1, 2, 3, 1500, 3000]) for _ in range(30))]
    docs = spark.createDataFrame([("x", i, t, 0) for i, t in enumerate(texts)], SCHEMA)
    n = [len(library.encode_ordinary(t or "")) for t in texts]
    table = {r.n_tokens: r for r in token_histogram.report(docs, PATH).collect()}
    assert set(table) == set(n)
    for k, r in table.items():
        assert (r.n_docs, r.docs_within, r.docs_longer) == (n.count(k), sum(x <= k for x in n), sum(x > k for x in n))
        assert (r.tokens_within, r.truncated_total, r.total_tokens) == (sum(x for x in n if x <= k), sum(min(x, k) for x in n), sum(n))
        assert r.quantile == r.docs_within / len(n)
    hist = token_histogram.histogram(docs, PATH)
    assert {r[0]: tuple(r)[1:] for r in token_histogram.truncated_at(hist, [0, 2, 1000, 10**6]).collect()} == {k: (sum(min(x, k) for x in n), sum(x > k for x in n)) for k in (0, 2, 1000, 10**6)}
    assert {r[0]: r[1] for r in token_histogram.quantiles(hist, [0.5, 1.0]).collect()} == {q: sorted(n)[int(-(-len(n) * q // 1)) - 1] for q in (0.5, 1.0)}
    assert token_histogram.report(docs.limit(0), PATH).count() == 0
    none = token_histogram.histogram(docs.limit(0), PATH)
    assert list(map(tuple, token_histogram.truncated_at(none, [5]).collect())) == [(5, 0, 0)]
    assert list(map(tuple, token_histogram.quantiles(none, [0.5]).collect())) == [(0.5, None)]

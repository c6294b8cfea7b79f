import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from lockfleet.llm import piece_bpe as B
from lockfleet.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return B.Codec(f.read())


def joined(ids):
    return " ".join(map(str, ids)).encode()


def test_query_equals_the_library_on_whole_documents(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert B.differing(docs, PATH).collect() == []
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids = library.encode(text or "", add_eos=True)
        want.append((doc_id, len(ids), sha(joined(ids)), sha(library.decode(ids).encode())))
    got = QUERIES["op12_sentencepiece"](spark, DATA)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_any_text_equals_the_library(codec, library):
    rng = random.Random(5)
    some = [*" ▁  \n\t\0aeiouthnsr019.,'-é漢字한가😀́‍﻿ A", "<s>", "</s>", "<unk>", "<0x0A>", "  ", "ing", " the"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(40))) for _ in range(4000)]
    ids = library.encode(texts, add_eos=True)
    assert list(codec.encode(texts)) == [joined(x) for x in ids]
    assert [codec.decode(joined(x)).decode() for x in ids] == library.decode(ids)


def test_any_ids_decode_as_in_the_library(codec, library):
    rng = random.Random(6)
    some = [0, 1, 2, 3 + 0xE2, 3 + 0x96, 3 + 0x81, 3 + 0x20, 259, 260, 261]
    for _ in range(4000):
        ids = [rng.choice([*some, 3 + rng.randrange(256), rng.randrange(32000)]) for _ in range(rng.randrange(8))]
        assert codec.decode(joined(ids)).decode() == library.decode(ids), ids
    with pytest.raises(ValueError, match="no piece has"):
        codec.decode(b"32000")


def test_long_sections_and_full_caches(codec, library, monkeypatch):
    rng = random.Random(7)
    long = "".join(rng.choice(["the", "ing", "er", "a"]) for _ in range(20_000))
    texts = [long, " " * 5000 + "x" + " " * 5000, "x" * 9999]
    assert list(codec.encode(texts)) == [joined(x) for x in library.encode(texts, add_eos=True)]
    monkeypatch.setattr(B, "CACHE", 3)
    monkeypatch.setattr(B, "ROWS", 2)
    for text in ("one two three", "four five", "one"):
        assert next(codec.encode([text])) == joined(library.encode(text, add_eos=True))


def test_shared_classes_make_no_wrong_cuts(library, monkeypatch):
    monkeypatch.setattr(B, "CLASSES", 7)
    with open(PATH, "rb") as f:
        own = B.Codec(f.read())
    texts = ["The nearest words, and 42 more; été niño.", "a  b"]
    assert list(own.encode(texts)) == [joined(x) for x in library.encode(texts, add_eos=True)]


def test_equal_scores_merge_leftmost_first(codec, library):
    runs = ["▁" * n for n in range(2, 45)]  # the pieces of several spaces share one score
    want = [library.encode(" " * (len(r) - 1)) for r in runs]
    assert [codec._section(r) for r in runs] == want
    symbols, counts = codec.merged_many(runs)
    assert counts.tolist() == list(map(len, want)) and symbols.tolist() == sum(want, [])


def test_a_wrong_section_is_noticed(codec):
    for section in ("▁the", "the", "▁"):
        with pytest.raises(AssertionError, match="other ids"):
            codec._checked({section: [5]})


def test_nulls_empty_tables_and_clashes(spark):
    rows = [(1, None, "a"), (1, "", "b"), (None, "two words", "c"), (2, "two words", "d"), (2, "two words", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece_ids string")
    out = B.encoded(df, PATH)
    assert out.columns == ["doc_id", "text", "piece_ids", "_piece_ids"]
    assert sorted(len(r["_piece_ids"]) for r in out.collect()) == [1, 1, 3, 3, 3]
    back = B.decoded(out, PATH, "_piece_ids", "Text")
    assert back.columns[-1] == "_Text" and sorted(r["_Text"] for r in back.collect()) == ["", "", *["two words"] * 3]
    assert sorted((r.doc_id or 0, r.n_tokens) for r in B.digests(df, PATH).collect()) == [(0, 3), (1, 1), (1, 1), (2, 3), (2, 3)]
    none = df.where("false")
    assert B.encoded(none, PATH).collect() == B.digests(none, PATH).collect() == B.differing(none, PATH).collect() == []
    lost = spark.createDataFrame([(None,), ([],)], "piece_ids array<int>")
    assert [r.decoded for r in B.decoded(lost, PATH).collect()] == [None, ""]


def test_other_models_are_refused():
    def message(*fields):
        return b"".join(bytes([n << 3 | 2, len(x)]) + x for n, x in fields)

    piece = lambda text, kind: (1, message((1, text)) + bytes([3 << 3, kind]))
    merge = (2, bytes([3 << 3, 2]) + b"\x98\x02\x01")
    plain = (3, bytes([3 << 3, 1, 4 << 3, 0]))
    assert B.Model(message(piece(b"<0x00>", 6), merge, plain)).pieces == [("<0x00>", 0.0, 6)]
    for bad in ([piece(b"<0x00>", 6), plain], [piece(b"a", 1), merge, plain], [piece(b"<0x00>", 6), piece(b"u", 4), merge, plain], [piece(b"<0x00>", 6), merge], [piece(b"<0x00>", 6), merge, (3, plain[1] + message((2, b"x")))]):
        with pytest.raises(ValueError, match="only models"):
            B.Model(message(*bad))

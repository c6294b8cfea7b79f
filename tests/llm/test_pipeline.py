import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(n))
    passage, bench = say(60), say(30)
    rows = [(i, say(rng.randrange(60, 150))) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1].upper()), (200, say(90) + " " + passage + " " + say(40)), (201, say(80) + " " + passage + " " + say(70)), (300, say(60) + " " + bench + " " + say(60)), (301, say(10)), (302, None), (303, "")]
    rows += [(400 + i, " ".join(w + "$$$" for w in say(80).split())) for i in range(20)]
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, bench), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(i, 0 if i >= 400 else 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out), dict(rows)


def test_stages(spark, folder):
    import tiktoken

    import corpus_pipeline as cp
    import public_tokenizers as P
    from lockfleet.llm.bpe import ranks_of

    sf, texts = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, [set(texts)]
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        docs = spark.createDataFrame(out.collect(), out.schema)
        if k < len(cp.STAGES) - 1:
            assert docs.columns == columns, name
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    gone = [sorted(a - b) for a, b in zip(ids, ids[1:])]
    assert gone[0] == [301, 302, 303, *range(400, 420)]
    assert gone[1] == [100, 101] and gone[2] == [] and gone[3] == [300] and gone[4] == []
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks_of(f.read()), special_tokens={})
    n = {r.doc_id: r.n_tokens for r in docs.collect()}
    assert all(n[i] == len(lib.encode_ordinary(texts[i])) for i in n if i != 201)
    assert n[201] < len(lib.encode_ordinary(texts[201]))
    whole = {r.doc_id: r.ids_sha256 for r in cp.run(spark, sf).collect()}
    assert whole == {r.doc_id: r.ids_sha256 for r in docs.collect()}


def test_near_duplicates_without_ids(spark):
    from corpus_pipeline import near_duplicates

    text = "one two three four five six"
    rows = [(5, text), (5, text), (9, text.upper()), (None, text), (None, "alone and without id"), (None, "Alone and without ID"), (7, "quite another text here"), (8, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, (r.text or "").lower()) for r in got.collect()), key=str) == sorted([(5, text), (7, "quite another text here"), (8, ""), (None, "alone and without id")], key=str)


def test_rows_that_share_an_id_keep_their_components(spark):
    from corpus_pipeline import near_duplicates

    rows = [(5, "one two three four five six"), (5, "quite another text of the same id"), (6, "one two three four five six"), (7, "Quite another text of the same ID")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(rows[:2])


def test_stages_on_nulls_clashes_and_nothing(spark, folder):
    import corpus_pipeline as cp

    sf, _ = folder
    schema = SCHEMA + ", tag long, place int, root string, __keep long, segment long, hit_bits binary, n_words int"
    long = " ".join(f"word{i}" for i in range(70))
    rows = [(None, None, None, None, None), (None, long, None, "s", 1), (1, long, "en", None, None), (1, long, "en", None, None), (2, "", "en", "s", 0), (2, None, None, None, None), (3, " ".join(f"other{i}" for i in range(80)), "en", "s", 9)]
    docs = spark.createDataFrame([(*r, 1, 2, "x", 3, 4, None, 5) for r in rows], schema)
    for name, stage in cp.STAGES:
        for some in (docs, docs.limit(0)):
            some = spark.createDataFrame(some.collect(), schema)
            out = stage(spark, some, sf)
            got = out.collect()
            if stage is not cp.STAGES[-1][1]:
                assert out.columns == docs.columns, name
                assert all(r.tag == 1 and r.root == "x" and r.segment == 4 for r in got)
            texts = [(r.doc_id, r.text) for r in got] if "text" in out.columns else []
            if some.count() == 0:
                assert not got
            elif stage is cp.quality_rules:
                assert sorted(texts, key=str) == sorted([(None, long), (1, long), (1, long), (3, rows[6][1])], key=str)
            elif stage is cp.near_duplicates:
                assert sorted(texts, key=str) in [sorted([(1, long), (2, t), (3, rows[6][1])], key=str) for t in ("", None)]
            elif stage in (cp.substring_repeats, cp.benchmark_contamination):
                assert sorted(texts, key=str) == sorted([r[:2] for r in rows], key=str)
            else:
                assert len(got) == len(rows)

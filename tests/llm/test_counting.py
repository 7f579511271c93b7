"""Token counts against the tokenizer over whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from vintage_jobs.llm import counting as C
from vintage_jobs.llm.packing import tokenizer_path


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path())
    return lambda text: len(own.encode(text or "", add_special_tokens=False).ids)


def texts():
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "a", "word", "'ll", "'", "don't", "<|endoftext|>", "<|endof", "12", "日本語", "é", "é", "😀", "...", "\t", "\xa0", " the"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(40, 400))) for _ in range(60)]
    return [*made, "a" * 3000, " " * 3000, "\n" * 500 + "x" + " " * 700, "<|endoftext|>" * 100, "日本" * 900, "'l" * 600, "word " * 2000, "x" * 700 + " and then " * 200]


@pytest.mark.parametrize("size, overlap", [(40, 17), (64, 20), (300, 40)])
def test_small_chunks_against_whole_texts(spark, plain, size, overlap):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in C.counted(spark.createDataFrame(rows, "doc_id long, text string"), size, overlap).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {i: plain(t) for i, t in rows}
    assert {i: r.n_bytes for i, r in got.items()} == {i: len(t.encode()) for i, t in rows}


def test_a_splice_needs_a_common_start(spark):
    long = spark.createDataFrame([("k", "x" * 200), ("l", "one two three " * 20)], "key string, text string")
    cut = C.chunks(long, 80, 40)
    assert sorted((r.key, r.no, r.start, len(r.text)) for r in cut.collect() if r.key == "k") == [("k", i, 40 * i, 80) for i in range(4)]
    got = {r.key: r.n for r in C.spliced(C.encoded(cut, 40, tokenizer_path())).collect()}
    assert got["k"] is None and got["l"] is not None


def test_chunks_cover_and_overlap():
    for n in (0, 1, 79, 80, 81, 140, 141, 1000):
        ends = C.chunk_ends(n, 80, 20)
        assert ends[0][0] == 0 and ends[-1][1] == n
        assert all(b[0] == a[1] - 20 and b[1] > a[1] for a, b in zip(ends, ends[1:], strict=False))
    with pytest.raises(ValueError):
        C.chunks(None, 30, 20)


def test_whole_table(spark, small_dir, plain):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in C.count_digest(docs).collect()}
    want = {r.doc_id: (len((r.text or "").encode()), plain(r.text), plain(r.text) > 512) for r in docs.collect()}
    assert got == want and any(x for *_, x in got.values())


def test_edge_rows(spark, plain):
    long = "It isn't over yet.\n" * 4000
    rows = [(1, None), (1, None), (None, long), (None, long), (2, ""), (3, long), (3, "b"), (4, "z" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("n_tokens", F.lit("clash"))
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in C.counted(docs).collect())
    assert got == sorted((d or 0, len((t or "").encode()), plain(t)) for d, t in rows)
    assert C.count_digest(docs.limit(0)).count() == 0

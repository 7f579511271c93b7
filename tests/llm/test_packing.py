import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintage_jobs.llm import packing as P


def test_words_encode_as_whole_texts():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.tokenizer_path())
    texts = ["", "one", "It's a test, isn't it? 3.5% of 10", "first line.\nSecond line\nthird", "two  blanks", "tab\tand\xa0nbsp", " lead", "trail ", "a\n\nb", "é ß 中文 😀 a", "x<|endoftext|>y <|endoftext|> z", "a \nb", "\n", "　x y", "don't'll 're"]
    texts += ["日本語 テキスト", "naïve’s café—“quoted” 12ab34 x²", "a b  c", "tail\x1c end", "ﬁ ǅ ʰ ١٢٣ Ⅷ ½"]
    for ranks in (None, P.tokenizer_path("byte_bpe_50k.tiktoken")):
        own = P.Encoder(P.tokenizer_path(), ranks, most=5)
        got = own.encode(texts)
        got = own.encode(texts)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        values, capacity = rng.random(6), int(rng.integers(1, 15))
        worth, pattern = P.best_pattern(values, capacity)
        best = [0.0]
        for c in range(1, capacity + 1):
            best.append(max([best[c - 1], *(best[c - s] + values[s - 1] for s in range(1, min(c, 6) + 1))]))
        assert worth == pytest.approx(best[-1]) and worth == pytest.approx(pattern @ values)
        assert pattern @ np.arange(1, 7) <= capacity


def test_column_generation_reaches_the_bound():
    demand = np.zeros(100, np.int64)
    demand[[44, 35, 30, 13]] = [97, 610, 395, 211]  # Gilmore and Gomory's example has the bound 452.25
    uses = sum(x for _, x in P.column_generation(demand, 100, gap=1e-9))
    assert uses == pytest.approx(452.25)
    patterns = P.integer_patterns(demand, 100)
    assert (sum(p * n for p, n in patterns) >= demand).all() and sum(n for _, n in patterns) <= 456


def check_packing(rows, seq_len=2048):
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= seq_len
    return by_seq, by_doc


def test_whole_table(spark, small_dir):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.tokenizer_path())
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = P.packed(docs).collect()
    by_seq, by_doc = check_packing(rows)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert {d for d, _ in by_doc} == set(texts)
    ids = {d: np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4") for d, t in texts.items()}
    for (doc, n), own in by_doc.items():
        assert n == len(ids[doc]) and [s for s, _ in sorted(own)] == [0, *np.cumsum([x for _, x in sorted(own)])[:-1]] and sum(x for _, x in own) == n
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) for r in rows)
    assert sum(r.length for r in rows) / (2048 * len(by_seq)) > 0.95


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "a b"), (2, ""), (3, "word " * 9000)], "doc_id long, text string").withColumn("start", F.lit("clash")).withColumn("class", F.lit(2))
    rows = P.packed(docs).collect()
    _, by_doc = check_packing(rows)
    assert sorted(n for (d, n) in by_doc if d in (1, 2)) == [1, 1] and len(by_doc[(1, 1)]) == 2
    assert P.packed(docs.limit(0)).count() == 0

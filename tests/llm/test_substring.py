import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintage_jobs.llm import substring as S


def brute(rows, window=20):
    """rows of (doc_id, text), each another document -> (doc_id, n_words, n_removed, kept)."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            own = tuple(words[i : i + window])
            if own in seen:
                gone.update(range(i, i + window))
            seen.add(own)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_whole_table(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in S.substring_digest(docs).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("seed", range(2))
def test_random_repeats_at_all_offsets(spark, seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(5000)]
    passages = [rng.choice(vocabulary, n).tolist() for n in (19, 20, 21, 25, 40, 57, 130)]
    rows = []
    for doc in range(60):
        words = []
        for _ in range(rng.integers(1, 5)):
            words += rng.choice(vocabulary, rng.integers(0, 30)).tolist() + passages[rng.integers(len(passages))]
        rows.append((int(doc), "  ".join(words)))
    rows += [(100, "to " * 500), (101, "a b " * 200), (102, "to " * 19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((tuple(r) for r in S.substring_digest(docs).collect()), key=str) == brute(rows)


def test_edge_rows(spark):
    text = " ".join(f"x{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, "one"), (None, text), (4, text + "\x0b\tend É")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("anchors", F.lit("clash")).withColumn("row_key", F.lit(1))
    assert sorted((tuple(r) for r in S.substring_digest(docs).collect()), key=str) == brute(rows)
    assert S.substring_digest(docs.limit(0)).count() == 0
    twice = S.substring_digest(docs.union(docs)).collect()
    assert sorted((tuple(r) for r in twice), key=str) == sorted(brute(rows) * 2, key=str)


def test_word_hashes_do_not_depend_on_place():
    data = np.frombuffer(("ab " * 50 + "long" * 40 + " ab é" * 30).encode(), np.uint8)
    starts, ends = S.word_bounds(data)
    small, large = S.word_hashes(data, starts, ends, block=16), S.word_hashes(data, starts, ends)
    assert (small == large).all() and len(set(large.tolist())) == 3
    assert [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)] == bytes(data).split()


def test_the_two_hashes_share_no_collision():
    """Word hashes that collide in one window hash, built by moving what one place adds to the next, differ in the other."""
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 63, 20, np.uint64)
    moved = words.copy()
    moved[3] -= np.uint64(1)
    moved[4] += np.uint64(S.MULTIPLIER)
    assert S.window_hashes(words, 20, 11)[0] == S.window_hashes(moved, 20, 11)[0]
    assert S.window_hashes(words, 20, 13, S.SECOND)[0] != S.window_hashes(moved, 20, 13, S.SECOND)[0]
    data = np.frombuffer(" ".join(f"w{i}" for i in range(5000)).encode(), np.uint8)
    one, two = S.word_hashes(data, *S.word_bounds(data)), S.word_hashes(data, *S.word_bounds(data), base=S.SECOND)
    assert len(np.unique(one)) == len(np.unique(two)) == 5000 and not (one == two).any()


def test_very_long_text(spark):
    words = [f"v{i % 700}" for i in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[100:300])), (3, "q " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in S.substring_digest(docs).collect()), key=str) == brute(rows)


def test_documents_whose_hashes_collide_are_told_apart(spark, monkeypatch):
    rng = np.random.default_rng(2)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 900, 40)) + (" " + passage if i % 3 == 0 else "")) for i in range(30)] + [(None, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(S, "row_key", lambda: [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.lit(7).cast("long").alias("row_key")])
    assert sorted((tuple(r) for r in S.substring_digest(docs).collect()), key=str) == brute(rows)


def test_words_are_hashed_in_little_memory():
    import tracemalloc

    data = np.frombuffer(b"seven77 " * (1 << 18), np.uint8)
    starts, ends = S.word_bounds(data)
    S.powers.cache_clear()
    tracemalloc.start()
    hashes = S.word_hashes(data, starts, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(hashes.tolist())) == 1 and peak < hashes.nbytes + (10 << 20)


def test_rows_are_cut_in_parts():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"a": list(range(n))}) for n in (0, 3, 1030)]
    made = [b.column("a").to_pylist() for b in S.in_parts(iter(batches))]
    assert [len(x) for x in made] == [3, 512, 512, 6] and sum(made, []) == [0, 1, 2, *range(1030)]

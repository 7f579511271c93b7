"""Vector codes against a full search in Python's whole numbers, and against SQL."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vintage_jobs.llm import codes as V


def brute(rows, parts=8, entries=16, rounds=6):
    kept = sorted((i, [math.floor(4096 * float(c)) for c in v], l) for i, v, l in rows if v is not None and all(c is not None and math.isfinite(c) for c in v))
    cut = V.cuts(len(kept[0][1]), parts)
    books = [[v[p] for _, v, _ in kept[:entries]] for p in cut]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, part in enumerate(cut):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(v[part], books[p])[1], []).append(v[part])
            for k, own in groups.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out, by_label = [], {}
    for i, v, l in kept:
        found = [near(v[part], book) for part, book in zip(cut, books, strict=True)]
        out.append([i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), l])
        by_label[l] = by_label.get(l, 0) + out[-1][2]
    import hashlib

    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((i, code, error, by_label[l], digest) for i, code, error, l in out)


def test_search_is_exact_with_ties():
    rng = np.random.default_rng(3)
    for width, high in ((1, 4), (2, 3), (8, 300)):
        x, book = rng.integers(-high, high, (400, width)), rng.integers(-high, high, (16, width))
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        index, best = V.nearest(x, rng.integers(0, 16, 400), book)
        assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_far_entries_are_not_compared():
    book = np.array([[0], [10], [1000]])
    between = V.nearest(np.array([[1], [9]]), np.array([0, 1]), book)
    assert between[0].tolist() == [0, 1] and between[1].tolist() == [1, 1]


def test_whole_table(spark, small_dir):
    vectors = spark.read.parquet(f"{small_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    assert sorted(tuple(r) for r in V.code_digest(vectors).collect()) == brute(rows)


def test_sql(spark, small_dir):
    own = duckdb.connect()
    own.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small_dir}/embeddings.parquet'")
    want = own.execute(V.oracle()).fetchall()
    assert sorted(tuple(r) for r in V.code_digest(spark.read.parquet(f"{small_dir}/embeddings.parquet")).collect()) == sorted(want)


def test_edge_rows(spark):
    rng = np.random.default_rng(1)
    vec = lambda: [float(np.float32(c)) for c in rng.normal(size=10)]
    same = vec()
    rows = [(i, vec(), i % 3 or None) for i in range(40)]
    rows += [(50, None, 1), (51, [1.0] * 9 + [None], 1), (52, [1.0] * 9 + [math.nan], 2), (53, [math.inf] + [0.0] * 9, 2), (60, same, 1), (60, same, 1), (61, [3.0] * 10, 2), (62, [-3.0] * 10, None)]
    schema = "vec_id long, embedding array<float>, label int"
    frame = spark.createDataFrame(rows, schema).withColumn("x", F.lit("clash")).withColumn("codes", F.lit(1))
    got = sorted(tuple(r) for r in V.code_digest(frame.repartition(3)).collect())
    assert got == brute(rows) and len(got) == 44
    assert V.code_digest(frame.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:3], schema)
    assert sorted(tuple(r) for r in V.code_digest(few).collect()) == brute(rows[:3])
    odd = spark.createDataFrame([(1, [1e30] * 10, 1), (2, [1.0] * 4, 1), (None, [0.5] * 10, None)], schema)
    got = {r.vec_id: r for r in V.code_digest(odd).collect()}
    assert set(got) == {1, None} and got[1].error == 0


@pytest.mark.parametrize("width", [3, 8, 13])
def test_parts_of_any_width(width):
    assert sum(p.stop - p.start for p in V.cuts(width, 8)) == width and len(V.cuts(width, 8)) == 8

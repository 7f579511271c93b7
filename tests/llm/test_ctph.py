import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintage_jobs.llm import ctph as C


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_against_the_table():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd", k=rng.randrange(0, 90))) for _ in "ab")
        assert C.edit_distance(a, b) == slow_distance(a, b)


def test_triggers_do_not_depend_on_the_step():
    data = random.Random(4).randbytes(5000)
    assert C.triggers(data, 48) == C.triggers(data, 48, step=64)


@pytest.mark.parametrize("text", ["", "a", "a" * 100_000, "to " * 5000])
def test_signatures_stay_short(text):
    assert len(C.fingerprint(text)) < 600 and C.likeness(C.fingerprint(text), C.fingerprint(text)) == 1


def test_likeness_follows_the_change():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(2000)]
    text, other = " ".join(words[:1000]), " ".join(words[1000:])
    near = C.likeness(C.fingerprint(text), C.fingerprint(C.edited(text, other)))
    small = C.likeness(C.fingerprint(text), C.fingerprint(text[:3000] + "xyz" + text[3000:]))
    far = C.likeness(C.fingerprint(text), C.fingerprint(other))
    assert small > 0.8 and 0.35 < near < 0.8 and far < 0.25


def slow_fingerprint(text):
    """The same definition, a byte at a time."""
    data = (text or "").encode()
    mask, alphabet = (1 << 32) - 1, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rolling = []
    for i in range(len(data)):
        h = sum((data[i - j] + 1) * pow(0x01000193, j, 1 << 32) for j in range(7) if i >= j) & mask
        h = ((h ^ h >> 15) * 0x85EBCA6B) & mask
        rolling.append(h ^ h >> 13)

    def cuts(block):
        out, last = [], 0
        for i, h in enumerate(rolling):
            if h % block == block - 1 and i + 1 - last >= max(1, block // 4):
                out.append(last := i + 1)
        return out

    def sign(ends):
        ends = [0, *ends] + ([len(data)] if not ends or ends[-1] != len(data) else [])
        return "".join(alphabet[zlib.crc32(data[a:b]) % 64] for a, b in zip(ends, ends[1:], strict=False))

    if not data:
        return "3::"
    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and len(cuts(block)) < 16 and len(cuts(block // 2)) <= 256:
        block //= 2
    return f"{block}:{sign(cuts(block))}:{sign(cuts(2 * block))}"


def slow_likeness(a, b):
    if a == b:
        return 1.0
    (x, *xs), (y, *ys) = a.split(":"), b.split(":")
    own, other = {int(x): xs[0], 2 * int(x): xs[1]}, {int(y): ys[0], 2 * int(y): ys[1]}
    both = [(own[k], other[k]) for k in own.keys() & other.keys()]
    return max((1 - slow_distance(s, t) / max(len(s), len(t)) for s, t in both if s and t), default=0.0)


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    out = {}
    for i, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        f, e, n = map(slow_fingerprint, (text, changed, following))
        out[doc] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), f, e, slow_likeness(f, e), slow_likeness(f, n))
    return out


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_whole_table(spark, small_dir, ranges):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert {r[0]: tuple(r[1:]) for r in C.with_neighbours(docs, ranges).collect()} == want


def test_edge_rows(spark):
    rows = [(None, "first one"), (1, None), (2, ""), (9, "é" * 50), (-4, "ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("range", F.lit("clash")).withColumn("own", F.lit("clash"))
    assert {r[0]: tuple(r[1:]) for r in C.with_neighbours(docs).collect()} == brute(rows)
    assert C.with_neighbours(docs.limit(0)).count() == 0
    one = C.with_neighbours(docs.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert C.with_neighbours(docs.where("doc_id = 9").union(docs.where("doc_id = 9"))).count() == 2
    assert C.fingerprints(docs).count() == 5


def test_places_follow_the_order_and_split_what_is_frequent():
    rng = np.random.default_rng(0)
    rows = np.column_stack((rng.integers(0, 2, 4000), rng.integers(0, 4, 4000), rng.integers(0, 3, 4000)))
    rows[:1500] = (1, 2, 1)
    ordered = rows[np.lexsort(rows.T[::-1])]
    bounds = ordered[np.arange(1, 20) * 200]
    at = C.places(bounds, *ordered.T, rng.random(4000))
    assert at.min() >= 0 and at.max() <= 19 and np.bincount(at).max() < 500
    spans = {}
    for row, i in zip(map(tuple, ordered), at, strict=True):
        lo, hi = spans.get(row, (i, i))
        spans[row] = min(lo, i), max(hi, i)
    keys = sorted(spans)
    assert all(spans[a][1] <= spans[b][0] for a, b in zip(keys, keys[1:], strict=False))


def test_null_and_repeated_rows_are_dealt_over_ranges(spark):
    text = F.when(F.col("id") % 3 == 0, F.lit("one text in a third of all rows")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string")))
    docs = spark.range(600).select(F.when(F.col("id") % 3 != 2, F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.lit(None))).otherwise(F.col("id")).cast("long").alias("doc_id"), text.alias("text"))
    shares = [r["count"] for r in C.in_ranges(docs, 12).groupBy("range").count().collect()]
    assert sum(shares) == 600 and max(shares) < 150
    got = C.with_neighbours(docs, 12).collect()
    rows = [(r.doc_id, r.text, r.key) for r in docs.withColumn("key", F.xxhash64("text")).collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    texts = [t for _, t, _ in rows]
    want = [(d, hashlib.sha256(C.edited(t, texts[(i + 1) % len(texts)]).encode()).hexdigest()) for i, (d, t, _) in enumerate(rows)]
    assert sorted(((r.doc_id, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)

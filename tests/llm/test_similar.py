import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vintage_jobs.llm import packing
from vintage_jobs.llm import similar as S
from vintage_jobs.llm import simhash
from tests.llm.test_simhash import slow_fingerprint


def slow_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def slow_components(ids, sets):
    of = {d: d for d in ids}

    def root(d):
        while of[d] != d:
            d = of[d]
        return d

    for i, a in enumerate(ids):
        for j, b in enumerate(ids[:i]):
            if jaccard(sets[i], sets[j]) >= 0.8:
                x, y = root(a), root(b)
                of[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_components_against_exact_similarity(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 600))]
        rows += [" ".join(base), " ".join(base[: len(base) * 9 // 10]), edited(rng, base, 1), edited(rng, base, len(base) // 80), edited(rng, base, len(base) // 8)]
    rows += ["one two three", "one two three four", "One two  three", "", None, "lone"]
    ids = list(range(1, len(rows) + 1))
    sets = [slow_shingles(t) for t in rows]
    want = slow_components(ids, sets)
    docs = spark.createDataFrame(list(zip(ids, rows, strict=True)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in S.similar_documents(docs).collect()}
    assert got == want and len(set(want.values())) < len(ids) - 12
    far = [(a, b) for a in ids for b in ids[: a - 1] if want[a] == want[b] and bin(slow_fingerprint(rows[a - 1]) ^ slow_fingerprint(rows[b - 1])).count("1") > 4]
    assert far, "the rows hold similar texts beyond four bits"
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == set(want.values())


def test_large_group_is_whole(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, edited(rng, base, 1 + i % 4)) for i in range(300)]
    sets = [slow_shingles(t) for _, t in rows]
    want = slow_components([i for i, _ in rows], sets)
    got = {r.doc_id: r.component_id for r in S.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_fingerprints_alone_give_links(spark):
    """Without a band in common, what multi-index hashing finds within 4 bits is linked, verified on the sets."""
    rng = random.Random(13)
    rows = []
    for i in range(20):
        base = [f"w{rng.randrange(10**6)}" for _ in range(900)]
        rows += [(3 * i, " ".join(base)), (3 * i + 1, edited(rng, base, 2)), (3 * i + 2, edited(rng, base, 500))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = S.stored(S.sketches(docs), "similar")
    of = {r.node: (r.doc_id, r.fp) for r in made.collect()}
    nodes = made.select("node", "fp", F.array("node").alias("bands"), F.struct(F.lit(False).alias("no_id"), "doc_id", "row_key").alias("first"), F.lit(1).alias("n"))
    got = {frozenset((of[r.a][0], of[r.b][0])) for r in S.similar_links(docs, nodes).collect()}
    fp = {d: f % 2**64 for d, f in of.values()}
    sets = {d: slow_shingles(t) for d, t in rows}
    want = {frozenset((a, b)) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4 and jaccard(sets[a], sets[b]) >= 0.8}
    assert got == want and len(want) >= 15
    own = S.shingles(rows[0][1].encode())
    assert fp[0] == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in own) > len(own)) and S.set_fingerprint(own[:0]) == 0


def test_sets_and_threshold():
    text = "A b c d e F g h"
    assert len(S.shingles(text.encode())) == len(slow_shingles(text)) and not len(S.shingles(None)) and not len(S.bands(S.shingles(b" ")))
    a, b = np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)
    assert S.similarity_reached(a, b, 80) and not S.similarity_reached(a[:8], b[:8], 80)


def test_sets_whose_hashes_collide_are_told_apart(spark):
    rows = [(1, 10, 5, 70), (2, 20, 5, 71), (3, 30, 5, 70), (4, 40, 6, 72), (5, 50, 5, 73)]
    made = spark.createDataFrame(rows, "doc_id long, row_key long, node long, proof long").withColumn("bands", F.array(F.lit(1).cast("long")))
    got = {r.doc_id: r.node for r in S.told_apart(made).collect()}
    assert got[1] == got[3] == 5 and got[4] == 6 and len({got[1], got[2], got[5], got[4]}) == 4
    assert S.told_apart(made.where("proof <> 71 AND proof <> 73")).columns == made.columns


def test_documents_whose_hashes_collide_keep_their_texts(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(1, " ".join(base)), (2, edited(rng, base, 1)), (3, " ".join(f"v{i}" for i in range(90))), (4, " ".join(f"v{i}" for i in range(91)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = S.told_apart(S.stored(S.sketches(docs), "similar")).withColumn("row_key", F.lit(3).cast("long"))
    nodes = made.select("node", "row_key", F.col("doc_id").alias("id"), F.lit(4).alias("n"))
    monkeypatch.setattr(S.F, "xxhash64", lambda *c: F.lit(3).cast("long"))
    sets = {r.node: r.own for r in S.shingle_sets(docs, nodes, 4).collect()}
    monkeypatch.undo()
    text = dict(rows)
    assert sets == {r.node: bytearray(S.shingles(text[r.doc_id].encode()).tobytes()) for r in made.collect()}


def test_pairs_just_above_the_threshold_are_found(spark):
    """60 planted pairs of similarity 0.80 to 0.85: all but what the bands miss, expected 0.04 of them."""
    rng = random.Random(11)
    rows, pairs = [], 0
    while pairs < 60:
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(150, 400))]
        other = edited(rng, base, len(base) // 48)
        if 0.80 <= jaccard(slow_shingles(" ".join(base)), slow_shingles(other)) <= 0.85:
            rows += [(2 * pairs, " ".join(base)), (2 * pairs + 1, other)]
            pairs += 1
    got = {r.doc_id: r.component_id for r in S.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] == 2 * i for i in range(pairs)) >= 59 and len(set(got.values())) >= 60


class Taken:
    """Stands for a DataFrame and hands out the function that its rows would go through."""

    def select(self, *_):
        return self

    def mapInArrow(self, work, _):
        return work


def test_a_worker_lets_go_of_tokenizers_before_it_sketches(spark):
    packing.encoder(packing.tokenizer_path())
    assert packing.encoder.cache_info().currsize == 1
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([b"a b c d e f"], pa.binary())], names=["doc_id", "row_key", "text"])
    made = list(S.sketches(Taken())(iter([batch])))
    assert made[0].num_rows == 1 and packing.encoder.cache_info().currsize == 0


def test_later_passes_do_not_walk_chains_again(spark, monkeypatch):
    """What is given to the last pass over components are stars, not the chains of verified links."""
    rng = random.Random(19)
    words, rows = [f"w{rng.randrange(10**6)}" for _ in range(400)], []
    for i in range(24):
        rows.append((i, " ".join(words)))
        words = edited(rng, words, 2).split(" ")
    given = []
    monkeypatch.setattr(S, "of_components", lambda rows, node, linked, more: given.append(linked(rows.groupBy(node).agg(F.first(F.struct("doc_id", "row_key")).alias("first"), *(F.first(c).alias(c) for c in more), F.count("*").alias("n")))))
    S.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    edges = [tuple(r) for r in given[0].collect()]
    assert len(edges) >= 20 and not {a for a, _ in edges} & {b for _, b in edges}

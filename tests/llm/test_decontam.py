import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintage_jobs.llm import decontam as D


def words(text):
    return re.findall(D.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    grams = []
    for item, text in items:
        w = words(text)
        k = min(10, len(w))
        grams.append(("" if item is None else str(item), k, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, k, own in grams:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in own:
                    hit.update(range(i, i + k))
                    found.add(item)
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


DOCS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it all day long"),
    (2, "quick BROWN fox, jumps. over the lazy dog and runs"),
    (3, "tiny item here; tiny Item again"),
    (4, None),
    (5, ""),
    (None, "Émile zola 42 wrote"),
    (6, "the the the the the the the the the the the the the"),
    (6, "the the the the the the the the the the the the the"),
    (7, "élan " * 3000 + "tiny item"),
    (8, "over the lazy dog and runs away from it today"),
]
ITEMS = [(1, "a quick brown fox jumps over the lazy dog and runs away from it"), (2, "TINY item"), (3, None), (4, "!!"), (None, "Émile"), (5, "the " * 11), (5, "the " * 11), (6, "émile")]


def test_against_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("doc", F.lit("clash")).withColumn("term", F.lit(1)).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("n", F.lit("clash"))
    assert sorted((tuple(r) for r in D.contamination_digest(docs, items).collect()), key=str) == brute(DOCS, ITEMS)
    kept = D.decontaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 8]
    assert D.contamination_digest(docs.limit(0), items).count() == 0
    assert all(r.n_hit == 0 for r in D.contamination_digest(docs, items.limit(0)).collect())


@pytest.mark.parametrize("small_side", [0, 10_000])
def test_spans_and_proximity_with_and_without_broadcast(spark, small_side):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    terms = D.item_terms(items)
    index = D.build_index(docs, terms, small_side)
    names = {r.doc: r.doc_id for r in index.where("term = 0").collect()}
    spans = {(names[r.doc], r.item_id, r.start, r.end) for r in D.phrase_matches(index, terms, 10, small_side).collect()}
    assert {s for s in spans if s[0] in (1, 2, 3)} == {(1, "1", 1, 14), (2, "1", 0, 10), (3, "2", 0, 2), (3, "2", 3, 5)}
    near = {(names[r.doc], r.item_id) for r in D.proximity_matches(index, terms, 20, 0.6, small_side).collect()}
    assert (8, "1") in near and (4, "1") not in near


def test_proximity_with_an_unseen_or_replaced_word(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    long = [f"t{i}" for i in range(120)]
    rows = [
        (1, "filler " * 50 + "alpha beta gamma delta other zeta eta theta iota kappa"),
        (2, "alpha beta gamma delta epsilon zeta eta filler filler filler"),
        (3, " ".join(reversed(long[:100]))),
        (4, "filler " * 30 + "kappa iota theta eta zeta delta gamma beta"),
    ]
    docs = spark.createDataFrame([*rows, (5, "epsilon")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, item.replace("epsilon", "unseen")), (3, " ".join(long))], "item_id long, text string")
    terms = D.item_terms(items)
    index = D.build_index(docs, terms)
    names = {r.doc: r.doc_id for r in index.where("term = 0").collect()}
    near = {(names[r.doc], r.item_id) for r in D.proximity_matches(index, terms).collect()}
    assert near == {(1, "1"), (1, "2"), (3, "3"), (4, "1"), (4, "2")}


@pytest.mark.parametrize("small_side", [0, 10_000])
def test_proximity_against_brute_force(spark, small_side):
    rng = np.random.default_rng(8)
    vocabulary = [f"v{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in range(40)]
    items = [(i, " ".join(rng.choice([*vocabulary, "unseen"], rng.integers(1, 8)))) for i in range(12)]
    terms = D.item_terms(spark.createDataFrame(items, "item_id long, text string"))
    number = {r.word: r.term for r in terms.collect()}
    index = D.build_index(spark.createDataFrame(docs, "doc_id long, text string"), terms, small_side)
    names = {r.doc: r.doc_id for r in index.where("term = 0").collect()}
    df = {w: sum(words(t).count(w) for _, t in docs) for w in number}
    want = set()
    for item, text in items:
        own, n = set(words(text)), len(words(text))
        least = -(-len(own) * 8 // 10)
        anchors = [w for w in sorted(own, key=lambda w: (df[w], number[w]))[: len(own) - least + 1] if df[w]]
        for doc, said in docs:
            w = words(said)
            for at, word in enumerate(w):
                found = len(own & set(w[max(0, at - n) : at + n + 1]))
                if word in anchors and found >= least:
                    want.add((doc, str(item), at, found, len(own)))
    got = {(names[r.doc], r.item_id, r.position, r.found, r.wanted) for r in D.proximity_matches(index, terms, share=0.8, small_side=small_side).collect()}
    assert got == want and len(want) > 20


@pytest.mark.parametrize("small_side", [0, 3])
def test_shuffled_sides_give_the_same_digest(spark, small_side):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.contamination(docs, items, small_side=small_side).drop(*D.KEY)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(DOCS, ITEMS)


def test_frequent_keys_are_dealt_by_their_count(spark):
    """A word with most rows goes to many tasks, each with a copy of its test rows; nothing is lost or doubled."""
    rows = spark.range(4000).select(F.when(F.col("id") % 4 > 0, F.lit(1)).otherwise(F.col("id")).alias("term"), F.col("id").alias("at"))
    side = spark.createDataFrame([(1, "a"), (1, "b"), (4, "c"), (5, "d")], "term long, item string")
    got = D.looked_up(rows, side, "term", ["at"], 0)
    assert sorted((r.term, r.at, r.item) for r in got.collect()) == sorted((r.term, r.at, r.item) for r in rows.join(side, "term").collect())
    assert D.ways_share(10**9, 1000) == 500_000 and D.ways_share(10, 8) == 64


def test_proximity_plan_meets_only_an_items_own_terms(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    terms = D.item_terms(items)
    near = D.proximity_matches(D.build_index(docs, terms), terms)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan

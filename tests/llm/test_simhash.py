import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vintage_jobs.llm import simhash as S


def slow_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(ids, fps, bits=4):
    fps = np.array(fps, np.uint64)
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in np.nonzero(np.bitwise_count(fps[i] ^ fps) <= bits)[0]:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    best = {}
    for i, d in enumerate(ids):
        r = root(i)
        if d is not None:
            best[r] = min(best.get(r, d), d)
    return [best.get(root(i)) for i in range(len(ids))]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "A b c", "É Été A B c d e f g", "x " * 5000, "tab\tand\x0bvt\x1cno É"])
def test_fingerprint(text):
    assert S.fingerprint(None if text is None else text.encode(), block=64) == slow_fingerprint(text)


def test_whole_table_against_brute_force(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    want = dict(zip((r.doc_id for r in rows), zip((f"{f:016x}" for f in fps), slow_components([r.doc_id for r in rows], fps)), strict=True))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash_digest(docs).collect()}
    assert got == want


def test_links_of_dense_buckets_are_whole(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**63))
    fps = {base}
    for _ in range(400):
        x = base
        for b in rng.integers(0, 63, rng.integers(1, 7)):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps | {int(x) for x in rng.integers(0, 2**63, 100)})
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = slow_components(fps, fps)
    for hot, block in ((1 << 30, 4096), (4, 32)):
        found = dict(S.components(S.links(nodes, hot_bucket=hot, block=block)).collect())
        assert [found.get(x, x) for x in fps] == want


def test_chain_has_one_component(spark):
    edges = spark.range(500).select((F.col("id") * 7 % 501).alias("a"), ((F.col("id") + 1) * 7 % 501).alias("b"))
    assert {r.root for r in S.components(edges).collect()} == {0}


def test_edge_rows(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (None, "zz yy xx ww vv uu"), (7, None), (8, "  "), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1)).withColumn("row_key", F.lit(1))
    got = sorted(((r.doc_id, r.component_id) for r in S.simhash_digest(docs).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (None, 5), (None, None), (7, 3), (8, 3), (3, 3)], key=str)
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 5, None]
    assert S.simhash_digest(docs.limit(0)).count() == 0


def test_plan_covers_every_split():
    for bits, segments in ((4, 3), (3, 4), (6, 4), (4, 5)):
        plan = S.plan_segments(bits, segments)
        assert len(plan) <= segments and sum(r + 1 for _, _, r in plan) > bits


def test_segments_follow_the_number_of_fingerprints():
    chosen = [S.best_segments(4, n) for n in (0, 10**3, 10**5, 10**7, 10**10)]
    assert chosen == [3, 3, 3, 3, 2]
    for n in (10**7, 10**10):  # a bucket of a table stays small
        assert all(n / 2**width < 64 for _, width, _ in S.plan_segments(4, S.best_segments(4, n)))


@pytest.mark.parametrize("segments", [2, 3, 4, 5])
def test_links_do_not_depend_on_the_segments(spark, segments):
    rng = np.random.default_rng(9)
    fps = {int(x) for x in rng.integers(0, 2**63, 60)}
    for x in list(fps)[:40]:
        for b in rng.integers(0, 63, 4):
            x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    found = dict(S.components(S.links(spark.createDataFrame([(x,) for x in fps], "fp long"), segments=segments)).collect())
    assert [found.get(x, x) for x in fps] == slow_components(fps, fps)


def roots_of(edges):
    least = {x: x for e in edges for x in e}
    while True:
        before = dict(least)
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            return least


def counted(monkeypatch):
    """The tables of edges that a call stores: one, and one a round."""
    tables, real = [], S.stored
    monkeypatch.setattr(S, "stored", lambda df, name, *a: tables.append((name, df._jdf.queryExecution().toString())) or real(df, name, *a))
    return tables


def test_stars_take_no_round(spark, monkeypatch):
    tables = counted(monkeypatch)
    edges = [(i, i % 5) for i in range(5, 400)] + [(3, 3)]
    assert dict(S.components(spark.createDataFrame(edges, "a long, b long")).collect()) == {i: i % 5 for i in range(400)}
    assert len(tables) == 1
    assert S.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_rounds_without_frequent_nodes_broadcast_nothing(spark, monkeypatch):
    """Each round's broadcasts and shuffles stay in the driver's memory for a while; few nodes have many edges."""
    tables = counted(monkeypatch)
    rng = np.random.default_rng(5)
    edges = [(a, b) for chain in rng.permutation(1200).reshape(60, 20).tolist() for a, b in zip(chain, chain[1:])]
    assert dict(S.components(spark.createDataFrame(edges, "a long, b long")).collect()) == roots_of(edges)
    assert len(tables) > 2
    for _, plan in tables[1:]:
        physical = plan.split("== Physical Plan ==")[-1]
        assert "Broadcast" not in physical and physical.count("Exchange hashpartitioning") <= 3


def test_rounds_with_frequent_nodes(spark):
    """Large hubs in the middle, at the end and joined by chains: the dealt steps and the windows give the same components."""
    hubs = [(900, i) for i in range(1000, 1800)] + [(2900 + i, 2500) for i in range(600)] + [(i, 5000) for i in range(3600, 4300)]
    chains = [(i, i + 1) for i in range(900, 905)] + [(905, 3000), (3001, 4000)] + [(7000 + i, 7001 + i) for i in range(40)]
    edges = hubs + chains
    assert dict(S.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()) == roots_of(edges)

"""Near-duplicates by the shingles themselves: Jaccard similarity of 0.8 or more over sets of five-word shingles.

Candidates come from SimHash fingerprints of the sets by multi-index hashing (``simhash.links``, 4 bits). At a similarity
of 0.8 two fingerprints differ in about 10 of 64 bits and often in 15, a radius at which multi-index hashing looks at much
of each table. So what lies beyond 4 bits is added from MinHash: 24 bands of 6 values each, of which two texts of
similarity s share one with probability 1 - (1 - s^6)^24, 0.9993 at 0.8. Every candidate of both is then verified on the
whole sets, in a shuffled join; only verified pairs make components.

Texts with equal sets are one node before any join; sets are equal where two independent 64-bit hashes are, and sets that
share only one of them are told apart first. A band's bucket is first linked through one member: each node is
compared with the least node of all its buckets, then with the least node of each bucket that is not yet in its
component. What is then left in different components of one bucket is compared in pairs of blocks, whose tasks return
only links that join components. So a large group of near copies costs about one comparison a node, and no step makes a
row a pair. Pairs of one component are never compared, which changes no component.

Defined results: words are as in ``simhash``; a text of fewer than five words is one shingle; texts without words are
copies of each other; ids and repeated rows as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage_jobs.llm.common import joined_by_key, start_bare, stored
from vintage_jobs.llm.simhash import BITS, components, of_components
from vintage_jobs.llm.simhash import links as fingerprint_links

WORDS, BANDS, DEEP = 5, 24, 6
_odd = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * DEEP), np.uint64)
TIMES, PLUS = _odd[0] | np.uint64(1), _odd[1]
STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    import xxhash

    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    k = min(words, len(parts))
    out = np.full(len(parts) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mixed(out * STEP + own[i : i + len(out)])
    return np.unique(out)


def bands(own: np.ndarray, block: int = 512) -> np.ndarray:
    """A key for each band of the set's MinHash; none for the empty set."""
    if not len(own):
        return np.empty(0, np.uint64)
    least = np.full(BANDS * DEEP, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), block):
        np.minimum(least, (own[at : at + block, None] * TIMES + PLUS).min(axis=0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, DEEP).T:
        keys = _mixed(keys * STEP + column)
    return keys


def set_fingerprint(own: np.ndarray, block: int = 1 << 15) -> int:
    """The 64-bit SimHash of a set of shingle hashes; zero for the empty set."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(own), block):
        counts += np.unpackbits(own[at : at + block].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((counts * 2 > len(own)).astype(np.uint8), bitorder="little").view("<u8")[0])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (64-bit hash of id and text), node and proof (two hashes of the shingle set), its fp and bands of every row."""
    import xxhash

    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("node", pa.int64()), ("proof", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_bare()
        for batch in batches:
            (nodes, proofs, fps), keys = np.empty((3, batch.num_rows), np.uint64), []
            for i, text in enumerate(batch.column("text")):
                own = shingles(text.as_py())
                nodes[i] = xxhash.xxh64_intdigest(own.tobytes(), WORDS)
                proofs[i] = xxhash.xxh3_64_intdigest(own.tobytes(), len(own))
                fps[i] = set_fingerprint(own)
                keys.append(bands(own).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), *(pa.array(x.view(np.int64)) for x in (nodes, proofs, fps)), pa.array(keys, schema.field("bands").type)], schema=schema)

    key = F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row_key")
    return docs.select(F.col("doc_id").cast("long"), key, F.col("text").cast("binary").alias("text")).mapInArrow(work, "doc_id long, row_key long, node long, proof long, fp long, bands array<long>")


def told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` with another node for those whose node is also that of another set (by ``proof``), which keeps it where it
    has the least proof. Equal sets keep equal nodes."""
    sets = rows.select("node", "proof").distinct()
    clash = sets.groupBy("node").agg(F.min("proof").alias("least"), F.max("proof").alias("most")).where("least < most").select("node", "least")
    if clash.isEmpty():
        return rows
    kept = rows.join(clash, "node", "left")
    own = F.when(F.col("proof") > F.col("least"), F.xxhash64("node", "proof")).otherwise(F.col("node"))
    return told_apart(stored(kept.withColumn("node", own).select(rows.columns), "similar"))


def shingle_sets(docs: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """node, own (its packed shingles) of the nodes in ``wanted`` (node, row_key, id, n), from the texts of that row of docs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_bare()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = pa.array([shingles(x.as_py()).tobytes() for x in part.column("text")], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("node"), own], names=["node", "own"])

    texts = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row_key"), F.col("text").cast("binary").alias("text"))
    met = joined_by_key(texts, wanted, "row_key", "n", rows, [F.monotonically_increasing_id()]).where(F.col("own_id").eqNullSafe(F.col("id")))
    return met.dropDuplicates(["node"]).select("node", "text").mapInArrow(work, "node long, own binary")


def similarity_reached(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``percent`` hundredths or more."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_bare()
        for batch in batches:
            own, other = batch.column("own"), batch.column("other")
            good = [similarity_reached(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(own, other, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = sets.select(F.col("node").alias("a"), "own"), sets.select(F.col("node").alias("b"), F.col("own").alias("other"))
    return pairs.join(left.hint("shuffle_merge"), "a").join(right.hint("shuffle_merge"), "b").select("a", "b", "own", "other").mapInArrow(work, "a long, b long")


def links_between(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between rows (node, cluster, own) of two tables, one for each pair of clusters that they join."""
    size, other = np.array([len(x) // 8 for x in right.own]), np.concatenate([np.frombuffer(x, np.uint64) for x in right.own])
    ids, at = np.unique(other, return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(size)[:-1]))
    near, far = left.cluster.to_numpy(copy=True), right.cluster.to_numpy(copy=True)
    nodes, others = left.node.tolist(), right.node.tolist()
    held = np.zeros(len(ids), bool)
    found = []
    for i, own in enumerate(left.own):
        own = np.frombuffer(own, np.uint64)
        if not ((far != near[i]) & (100 * np.minimum(size, len(own)) >= percent * np.maximum(size, len(own)))).any():
            continue
        place = np.searchsorted(ids, own)
        place[place == len(ids)] = 0
        place = place[ids[place] == own]
        held[place] = True
        both = np.add.reduceat(held[at], starts, dtype=np.int64)
        held[place] = False
        for j in np.flatnonzero((far != near[i]) & (100 * both >= percent * (len(own) + size - both))).tolist():
            if far[j] != near[i]:
                found.append((nodes[i], others[j]))
                gone, kept = far[j], near[i]
                near[near == gone], far[far == gone] = kept, kept
    return found


def links_in_blocks(rows: DataFrame, sets: DataFrame, percent: int, block: int = 256) -> DataFrame:
    """a, b: links that join the clusters of each bucket, from rows (key, node, cluster, n: how many share the key).

    A bucket is cut into blocks and a task gets one pair of blocks at a time; it returns at most a link for each pair of
    clusters that it joins, so no step makes a row a pair.
    """

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        start_bare()
        found = links_between(pdf[pdf.ahead], pdf[~pdf.ahead], percent)
        return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])

    own = rows.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own_block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = own.select("key", "node", "cluster", F.col("own_block").alias("i"), F.explode(F.sequence("own_block", F.col("blocks") - 1)).alias("j"), F.lit(True).alias("ahead"))
    right = own.select("key", "node", "cluster", F.explode(F.sequence(F.lit(0), "own_block")).alias("i"), F.col("own_block").alias("j"), F.lit(False).alias("ahead"))
    return left.unionByName(right).join(sets.hint("shuffle_merge"), "node").groupBy("key", "i", "j").applyInPandas(lambda pdf: work(pdf), "a long, b long").distinct()


def simhash_pairs(nodes: DataFrame, max_bits: int = 4) -> DataFrame:
    """a, b: candidates among nodes (node, fp, bands) by multi-index hashing: the least nodes of linked fingerprints, and each
    node with the least one of its own fingerprint."""
    own = nodes.where(F.size("bands") > 0).select("node", "fp")  # the empty set is one node
    least = stored(own.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("size")), "similar-fingerprints")
    side = lambda c, name: least.select(F.col("fp").alias(c), F.col("least").alias(name))
    near = fingerprint_links(least.select("fp"), max_bits)
    found = near.join(side("a", "x"), "a").join(side("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    total = least.agg(F.sum("size")).first()[0] or 0
    same = joined_by_key(own, least.where("size > 1"), "fp", "size", total, ["node"]).where("node <> least")
    return found.unionByName(same.select(F.col("node").alias("a"), F.col("least").alias("b")))


def similar_links(docs: DataFrame, nodes: DataFrame, percent: int = 80) -> DataFrame:
    """a, b: links between nodes (node, fp, bands, first), whole up to connectivity: stars of what verified links join, so
    that no later pass walks their chains again, and the links that join stars."""
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("size")).where("size > 1")
    of_all = nodes.agg(F.count("*"), F.sum("n")).first()
    buckets = stored(joined_by_key(keyed, shared, "key", "size", BANDS * of_all[0], ["node"]), "similar-buckets")
    close = stored(simhash_pairs(nodes), "similar-simhash")
    met = buckets.select("node").unionByName(close.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    wanted = met.join(nodes.select("node", F.col("first.row_key").alias("row_key"), F.col("first.doc_id").alias("id"), "n"), "node")
    sets = stored(shingle_sets(docs, wanted, of_all[1] or 0), "similar-sets")

    def clusters(links: DataFrame) -> DataFrame:
        of = components(links)
        return stored(met.join(of, "node", "left").select("node", F.coalesce("root", "node").alias("cluster")), "similar-clusters")

    def stars(of: DataFrame) -> DataFrame:
        return of.where("node <> cluster").select(F.col("node").alias("a"), F.col("cluster").alias("b"))

    def apart(pairs: DataFrame, of: DataFrame) -> DataFrame:
        ends = pairs.join(of.select(F.col("node").alias("a"), F.col("cluster").alias("ca")), "a").join(of.select(F.col("node").alias("b"), F.col("cluster").alias("cb")), "b")
        return ends.where("ca <> cb").select("a", "b").distinct()

    first = buckets.groupBy("node").agg(F.min("least").alias("b")).where("node <> b").withColumnRenamed("node", "a")
    ordered = first.unionByName(close).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    of = clusters(stored(verified(ordered, sets, percent), "similar-links"))
    others = buckets.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    more = stored(verified(stored(apart(others, of), "similar-pairs"), sets, percent), "similar-links")
    if not more.isEmpty():
        of = clusters(stars(of).unionByName(more))

    left = buckets.join(of, "node")
    mixed = left.groupBy("key").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n")
    open_ = stored(joined_by_key(left.select("key", "node", "cluster"), mixed, "key", "n", BANDS * of_all[0], ["node"]), "similar-open")
    if open_.isEmpty():
        return stars(of)
    return stars(of).unionByName(stored(links_in_blocks(open_, sets, percent), "similar-links"))


def similar_documents(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, row_key, node, component_id, first_key: the component of each row and the row that stands for it."""
    rows = told_apart(stored(sketches(docs), "similar"))
    return of_components(rows, "node", lambda nodes: similar_links(docs, nodes, percent), more=("fp", "bands"))

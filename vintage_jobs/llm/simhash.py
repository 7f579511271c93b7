"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits. It is cut into pieces; two fingerprints within ``max_bits`` agree in at least one piece up to
a few bits, so the small Hamming ball of each piece is enumerated, looked up in the table of that piece, and every match
is verified over all 64 bits. With 4 bits and 3 segments the first two pieces (22 and 21 bits) are searched with radius 1
and the last (21 bits) with radius 0: if the first two differ by 2 or more each, the last cannot differ. How many pieces
there are follows from the counted fingerprints: two wide ones for very many (from about 10^8), so that a bucket of a
table stays small, else three with smaller balls (``best_segments``). More pieces would save little on small tables.

Copies collapse to one fingerprint before any join, so a group of copies costs one row. A bucket that more than
``hot_bucket`` fingerprints lie in or probe is cut into blocks; a task gets one pair of blocks at a time, verifies it
with numpy and returns only a spanning forest of its links. Thus no step emits all pairs of a group and none needs a
group in one task. Components come from alternating large-star and small-star steps over stored edges, until they are
stars. Joins on a fingerprint, a star's centre or a component deal frequent keys over several tasks (``common.joined_by_key``).

Defined results: null or blank texts have fingerprint zero and are linked like any other; a null doc_id is in no
minimum unless its whole component has none (then the component is null); repeated rows share their row's result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintage_jobs.llm.common import fair_share, joined_by_key, stored

BITS = 64


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42, block: int = 1 << 15) -> int:
    """The 64-bit SimHash of UTF-8 text: A-Z lowered, words between ASCII white space, shingles of ``words`` words."""
    import xxhash

    parts = (text or b"").lower().split()
    if not parts:
        return 0
    plain = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(parts))
    starts, ends = starts[: len(parts) - k + 1], ends[k - 1 :]
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), block):
        own = zip(starts[at : at + block].tolist(), ends[at : at + block].tolist(), strict=True)
        hashes = np.array([digest(plain[s:e], seed) for s, e in own], np.uint64)
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((counts * 2 > len(starts)).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (64-bit hash of id and text), fp (signed) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("fp", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py()) for x in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(fps.view(np.int64))], schema=schema)

    key = F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row_key")
    return docs.select(F.col("doc_id").cast("long"), key, F.col("text").cast("binary").alias("text")).mapInArrow(work, "doc_id long, row_key long, fp long")


def plan_segments(max_bits: int, segments: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each piece that has to be searched."""
    least, more = divmod(max_bits, segments)
    widths = [BITS // segments + (i < BITS % segments) for i in range(segments)]
    out, at = [], 0
    for i, w in enumerate(widths):
        radius = least if i <= more else least - 1
        if radius >= 0:
            out.append((at, w, radius))
        at += w
    return out


def best_segments(max_bits: int, n: int) -> int:
    """The number of segments with the least work for ``n`` fingerprints: probes of each, and entries they meet by chance."""

    def work(segments: int) -> float:
        balls = [(sum(comb(width, r) for r in range(radius + 1)), width) for _, width, radius in plan_segments(max_bits, segments)]
        return sum(ball * (1 + n / 2**width) for ball, width in balls)

    return min(range(2, min(3, max_bits + 1) + 1), key=work)


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _keys(fp: str, plan: list[tuple[int, int, int]], ball: bool):
    keys = []
    for i, (shift, width, radius) in enumerate(plan):
        value = F.shiftrightunsigned(F.col(fp), shift).bitwiseAND(F.lit((1 << width) - 1))
        keys += [value.bitwiseXOR(F.lit(m)).bitwiseOR(F.lit(i << 56)) for m in _masks(width, radius if ball else 0)]
    return F.explode(F.array(*keys)).alias("key")


def hot_buckets(table: DataFrame, plan: list[tuple[int, int, int]], most: int, block: int) -> DataFrame:
    """key, rows, columns: how many blocks the probes and the entries of each bucket with over ``most`` of either make.

    A bucket is probed from its own ball, so only full buckets and those around them are counted."""
    sizes = table.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    around = F.lit(None).cast("array<long>")
    for i, (_, width, radius) in enumerate(plan):
        around = F.when(F.shiftright("key", 56) == i, F.array(*(F.col("key").bitwiseXOR(F.lit(m)) for m in _masks(width, radius)))).otherwise(around)
    full = table.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most // 8)
    probes = full.select("n", F.explode(around).alias("key")).groupBy("key").agg(F.sum("n").alias("probes"))
    # buckets of at most most / 8 entries add less than their ball's size times that
    counted = probes.join(sizes, "key", "left").select("key", F.coalesce("n", F.lit(1)).alias("n"), "probes").where((F.col("n") > most) | (F.col("probes") > 8 * most))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / block)).cast("int")
    return counted.select("key", blocks("probes").alias("rows"), blocks("n").alias("columns"))


def spanning_forest(left: np.ndarray, right: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges that span the links between two sets of distinct fingerprints, found breadth first: a row of distances a node."""
    sides, todo = (left, right), []
    unseen = [np.ones(len(s), bool) for s in sides]
    found = []
    for start in range(len(left)):
        if unseen[0][start]:
            unseen[0][start] = False
            todo.append((0, start))
        while todo:
            side, i = todo.pop()
            own, other = sides[side][i], 1 - side
            open_ = np.flatnonzero(unseen[other])
            met = open_[np.bitwise_count(sides[other][open_] ^ own) <= max_bits]
            unseen[other][met] = False
            found += [(own, sides[other][j]) for j in met.tolist()]
            todo += [(other, j) for j in met.tolist()]
    return found


def _forest(pdf, max_bits: int):
    """Links of a spanning forest between the probes and the table entries of one pair of blocks."""
    import pandas as pd

    left, right = pdf.fp[pdf.probe].unique().astype(np.uint64), pdf.fp[~pdf.probe].unique().astype(np.uint64)
    pairs = np.array(spanning_forest(left, right, max_bits), np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]}).query("a != b")


def links(nodes: DataFrame, max_bits: int = 4, segments: int | None = None, hot_bucket: int = 64, block: int = 4096) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp); whole up to connectivity, as hot buckets give forests."""
    plan = plan_segments(max_bits, segments or best_segments(max_bits, nodes.count()))
    table, probes = nodes.select("fp", _keys("fp", plan, ball=False)), nodes.select("fp", _keys("fp", plan, ball=True))
    hot = stored(hot_buckets(table, plan, hot_bucket, block), "hot-buckets")
    near = (F.bit_count(F.col("p.fp").bitwiseXOR(F.col("t.fp"))) <= max_bits) & (F.col("p.fp") != F.col("t.fp"))
    cold = probes.alias("p").join(table.join(hot, "key", "left_anti").alias("t"), (F.col("p.key") == F.col("t.key")) & near).select(F.col("p.fp").alias("a"), F.col("t.fp").alias("b"))
    if hot.isEmpty():
        return cold
    deal = lambda c: F.pmod(F.xxhash64("fp"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = probes.join(hot, "key").select("key", deal("rows").alias("i"), every("columns").alias("j"), "fp", F.lit(True).alias("probe"))
    right = table.join(hot, "key").select("key", every("rows").alias("i"), deal("columns").alias("j"), "fp", F.lit(False).alias("probe"))
    dense = left.unionByName(right).groupBy("key", "i", "j").applyInPandas(lambda pdf: _forest(pdf, max_bits), "a long, b long")
    return cold.unionByName(dense)


def state_of(edges: DataFrame) -> tuple[int, bool, int, int]:
    """Of distinct edges (a > b): how many, whether all are stars around their least node, and the most edges of a node, and
    of a node to smaller ones."""
    one, none = F.lit(1), F.lit(0)
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), one.alias("up"), none.alias("down")), F.struct(F.col("b").alias("node"), none.alias("up"), one.alias("down")))).alias("end")).select("end.*")
    each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    n, degree, up, between = each.agg(F.sum("up"), F.max(F.col("up") + F.col("down")), F.max("up"), F.max((F.col("up") > 0) & (F.col("down") > 0))).first()
    return n or 0, not between and (up or 0) <= 1, degree or 0, up or 0


def large_star(edges: DataFrame, total: int, deal: bool) -> DataFrame:
    """a > b, perhaps repeated: each node's larger neighbours, linked to the least of the node and its neighbours. ``deal``: a node
    may have so many edges that they are dealt over tasks; else they meet in one window."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if deal:
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
        met = joined_by_key(both.where("b > a"), least, "a", "n", total, ["b"])
    else:
        met = both.withColumn("m", F.least("a", F.min("b").over(Window.partitionBy("a")))).where("b > a")
    return met.select(F.col("b").alias("a"), F.col("m").alias("b"))


def small_star(edges: DataFrame, total: int, deal: bool) -> DataFrame:
    """a > b, distinct: each node and its smaller neighbours, linked to the least of these. ``deal`` as for ``large_star``."""
    if deal:
        edges = edges.distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        met = joined_by_key(edges, least, "a", "n", total, ["b"])
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        met = edges.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        out = met.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node reachable from each node of ``edges`` (a, b), itself included.

    Rounds end where the edges are stars, which is looked up and takes no further round. A node's edges meet in one window
    where no node has more than half a task's share; else they are dealt (``joined_by_key``). Large-star gives a node no more
    edges to smaller ones than it had, so one look tells for both steps.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    n, stars, degree, up = state_of(edges)
    for _ in range(most_rounds):
        if stars:
            break
        total = 2 * n
        share = fair_share(edges.sparkSession, total)
        edges = stored(small_star(large_star(edges, total, degree > share), total, up > share), "edges")
        n, stars, degree, up = state_of(edges)
    else:
        if not stars:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, max_bits: int = 4, segments: int | None = None) -> DataFrame:
    """doc_id, row_key, fp, component_id, first_key: the component of each row and the row that stands for it."""
    rows = stored(fingerprints(docs), "simhash")
    return of_components(rows, "fp", lambda nodes: links(nodes.select("fp"), max_bits, segments))


def of_components(rows: DataFrame, node: str, linked: Callable[[DataFrame], DataFrame], more: Sequence[str] = ()) -> DataFrame:
    """doc_id, row_key, node, component_id, first_key of stored ``rows`` (doc_id, row_key, node, more), given the links of their nodes.

    ``linked`` gets one row a node: node, ``more``, first (the row that stands for it), n (how many rows it has)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first")
    nodes = stored(rows.groupBy(node).agg(first, *(F.any_value(c).alias(c) for c in more), F.count("*").alias("n")), f"{node}-nodes")
    roots = components(linked(nodes)).withColumnRenamed("node", node)
    linked_nodes = stored(nodes.join(roots, node, "left").select(node, F.coalesce("root", node).alias("root"), "first", "n"), f"{node}-roots")
    best = linked_nodes.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("size"))
    of = joined_by_key(linked_nodes.drop("first"), best, "root", "size", linked_nodes.count(), [node]).select(node, "first", "n")
    out = joined_by_key(rows, of, node, "n", rows.count(), [F.monotonically_increasing_id()])
    return out.select("doc_id", "row_key", node, F.col("first.doc_id").alias("component_id"), F.col("first.row_key").alias("first_key"))


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that another row of their component stands for.

    Components are of five-word shingle sets with that Jaccard similarity (see ``similar``), not of fingerprints.
    """
    from vintage_jobs.llm.similar import similar_documents

    first = similar_documents(docs, percent).where("row_key = first_key AND doc_id <=> component_id").select(F.col("row_key").alias("__kept"), F.col("doc_id").alias("__kept_id")).distinct()
    keyed = docs.withColumns({"__row_key": F.xxhash64(F.col("doc_id").cast("long"), "text"), "__id": F.col("doc_id").cast("long")})
    kept = keyed.join(first, (F.col("__row_key") == F.col("__kept")) & F.col("__id").eqNullSafe(F.col("__kept_id")), "left_semi")
    return kept.dropDuplicates(["__row_key", "__id"]).select(docs.columns)


def simhash_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

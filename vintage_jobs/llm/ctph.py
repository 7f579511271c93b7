"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes sets chunk boundaries where it meets the block size; each chunk gives one of 64
symbols. A fingerprint is ``block:signature:signature at twice the block``; fingerprints are compared by edit distance
at equal or neighbouring block sizes.

Pairs of neighbours in doc_id order need no window over the whole table: rows go to ranges of doc_id and text hash, a
task streams its sorted range with two texts in memory and keeps the texts of its first and its last row, and the last
rows then meet the first rows of the next ranges. Bounds of ranges come from a sample; a null or repeated doc_id, and
even one repeated row, is dealt over as many ranges as its share of the rows asks for.

Defined results: a null text is empty, its fingerprint ``3::``; null doc_ids come first; equal doc_ids are ordered by
a hash of their texts; a table of one row is its own neighbour.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage_jobs.llm.common import stored, widest

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LEAST_BLOCK, LONGEST, SHORTEST, WINDOW = 3, 64, 16, 7


def triggers(data: bytes, block: int, step: int = 1 << 20) -> list[int]:
    """Ends of chunks: after each byte where the rolling hash meets ``block``, at least block / 4 bytes apart."""
    out, last, gap = [], 0, max(1, block // 4)
    for at in range(0, len(data), step):
        lead = min(at, WINDOW - 1)
        own = np.frombuffer(data, np.uint8, min(step, len(data) - at) + lead, at - lead).astype(np.uint32) + 1
        rolling = own.copy()
        for j in range(1, WINDOW):
            rolling[j:] += own[:-j] * np.uint32(0x01000193**j & 0xFFFFFFFF)
        rolling ^= rolling >> np.uint32(15)
        rolling *= np.uint32(0x85EBCA6B)
        rolling ^= rolling >> np.uint32(13)
        ends = (np.nonzero(rolling[lead:] % np.uint32(block) == block - 1)[0] + at + 1).tolist()
        i = bisect_left(ends, last + gap)
        while i < len(ends):
            out.append(last := ends[i])
            i = bisect_left(ends, last + gap, i + 1)
    return out


def signature(data: bytes, ends: list[int]) -> str:
    view, start, out = memoryview(data), 0, []
    for end in ends if ends and ends[-1] == len(data) else [*ends, len(data)]:
        out.append(SYMBOLS[zlib.crc32(view[start:end]) & 63])
        start = end
    return "".join(out)


def fingerprint(text: str) -> str:
    data = text.encode()
    block = LEAST_BLOCK
    if not data:
        return f"{block}::"
    while block * LONGEST < len(data):
        block *= 2
    ends = triggers(data, block)
    while len(ends) < SHORTEST and block > LEAST_BLOCK and len(finer := triggers(data, block // 2)) <= 4 * LONGEST:
        block, ends = block // 2, finer
    return f"{block}:{signature(data, ends)}:{signature(data, triggers(data, 2 * block))}"


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column at a time in the bits of one integer."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        cross = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(cross | up) & full, up & cross
        score += bool(plus & top) - bool(minus & top)
        plus = (plus << 1 | 1) & full
        minus = minus << 1 & full
        vertical = eq | down
        up, down = minus | ~(vertical | plus) & full, plus & vertical
    return score


def likeness(a: str, b: str) -> float:
    """0 to 1: 1 less the edit distance over the longer signature, at the best compatible block size."""
    if a == b:
        return 1.0
    (x, *xs), (y, *ys) = a.split(":"), b.split(":")
    x, y = int(x), int(y)
    pairs = [(xs[0], ys[0]), (xs[1], ys[1])] if x == y else [(xs[0], ys[1])] if x == 2 * y else [(xs[1], ys[0])] if y == 2 * x else []
    return max((1 - edit_distance(s, t) / max(len(s), len(t)) for s, t in pairs if s and t), default=0.0)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every whole text."""
    make = F.pandas_udf(lambda s: s.fillna("").map(fingerprint), "string")
    return docs.select(F.col("doc_id").cast("long"), make("text").alias("fingerprint"))


def range_bounds(docs: DataFrame, ranges: int, a_range: int = 32) -> np.ndarray:
    """Bounds (not null, doc_id, key) of ``ranges`` about equal ranges, repeated for what fills several, from a sample of
    about ``a_range`` rows a range."""
    rows, parts = docs.count(), 1 << 30
    keep = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)) < int(parts * min(1.0, a_range * ranges / max(1, rows)))
    own = docs.where(keep).select(F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("key"))
    found = sorted(map(tuple, own.collect()))
    return np.array([found[i * len(found) // ranges] for i in range(1, ranges)] if found else [], np.int64).reshape(-1, 3)


def places(bounds: np.ndarray, known: np.ndarray, ids: np.ndarray, keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """The range of each row. Rows equal to several bounds are dealt over the ranges between them by ``ties`` (0 to 1)."""
    columns = [np.concatenate((b, own.astype(np.int64))) for b, own in zip(bounds.T, (known, ids, keys), strict=True)]
    order = np.lexsort(columns[::-1])
    ordered = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in ordered])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new)
    at = np.searchsorted(np.sort(group[: len(bounds)]), group[len(bounds) :], "left")
    upto = np.searchsorted(np.sort(group[: len(bounds)]), group[len(bounds) :], "right")
    return (at + np.minimum((ties * (upto - at + 1)).astype(np.int64), upto - at)).astype(np.int32)


def in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, text, key (hash of the text), range of every row; ranges follow each other by doc_id (nulls first) and key."""
    bounds = range_bounds(docs, ranges)

    @F.pandas_udf("int")
    def place(known: pd.Series, ids: pd.Series, keys: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(places(bounds, *(s.to_numpy() for s in (known, ids, keys, ties))))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("key"), (F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 11) / float(1 << 53)).alias("tie"))
    return rows.withColumn("range", place(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), "key", "tie")).drop("tie")


OUT = [("doc_id", "long", pa.int64()), ("n_chars", "long", pa.int64()), ("edited_sha256", "string", pa.string()), ("fingerprint", "string", pa.string()), ("edited_fingerprint", "string", pa.string()), ("near_edited", "double", pa.float64()), ("near_next", "double", pa.float64())]


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first characters of the following one, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(doc, text: str, own: str, following: str, theirs: str) -> tuple:
    changed = edited(text, following)
    other = fingerprint(changed)
    return doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, other, likeness(own, other), likeness(own, theirs)


INNER, FIRST, LAST = range(3)


def _within_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The results of all rows but the last of each sorted range, and the texts of its first and last row."""
    schema = pa.schema([*((n, t) for n, _, t in OUT), ("text", pa.string()), ("range", pa.int32()), ("kind", pa.int32())])
    blank = [None] * (len(OUT) - 4)
    held = None
    packed = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    end = lambda: (held[1], None, None, held[3], *blank, held[2], held[0], LAST)
    for batch in batches:
        out = []
        for doc, text, place in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "range")), strict=True):
            text = text or ""
            sign = fingerprint(text)
            if held is not None and held[0] == place:
                out.append((*compared(*held[1:], text, sign), None, place, INNER))
            else:
                if held is not None:
                    out.append(end())
                out.append((None, None, None, sign, *blank, text, place, FIRST))
            held = (place, doc, text, sign)
        if out:
            yield packed(out)
    if held is not None:
        yield packed([end()])


def _across_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, t) for n, _, t in OUT])
    for batch in batches:
        rows = [compared(*r) for r in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "own", "following", "theirs")), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def with_neighbours(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Per row, its fingerprint, that of its edited text, and how like they and the next row's are."""
    ranges = ranges or 4 * widest(docs.sparkSession)
    columns = ", ".join(f"{n} {t}" for n, t, _ in OUT)
    dealt = in_ranges(docs, ranges).repartition(ranges, "range").sortWithinPartitions("range", "doc_id", "key")
    made = stored(dealt.mapInArrow(_within_ranges, columns + ", text string, range int, kind int"), "fingerprints")
    used = [r.range for r in made.where(F.col("kind") == FIRST).select("range").orderBy("range").collect()]  # at most one a range
    after = docs.sparkSession.createDataFrame(list(zip(used, used[1:] + used[:1], strict=True)), "range int, next int")
    lasts = made.where(F.col("kind") == LAST).join(F.broadcast(after), "range").select("next", "doc_id", "text", F.col("fingerprint").alias("own"))
    firsts = made.where(F.col("kind") == FIRST).select(F.col("range").alias("next"), F.col("text").alias("following"), F.col("fingerprint").alias("theirs"))
    edges = lasts.join(firsts.hint("shuffle_merge"), "next").select("doc_id", "text", "own", "following", "theirs").mapInArrow(_across_ranges, columns)
    return made.where(F.col("kind") == INNER).select(*(n for n, _, _ in OUT)).unionByName(edges)

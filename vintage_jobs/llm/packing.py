"""Packing by cutting-stock column generation.

Documents become token pieces of at most ``seq_len`` ids. The histogram of piece lengths, in classes of ``grain`` ids,
is the demand of a cutting-stock problem: a linear program chooses how often each pattern (a multiset of classes that
fits one sequence) is used, and a knapsack by dynamic programming prices new patterns from its dual values until none
helps. Rounded-down patterns, and greedy ones for the rest, are then assigned to the ranked pieces of each class. Only
the histogram (at most seq_len / grain rows) reaches the driver, and only the pattern table (a few thousand rows, by
the number of classes) is broadcast. Ranks come from salted groups, so a class of any size is ranked in parallel; what
comes before each group is joined by shuffle, as it grows with the partitions.

Defined results: a null text is the empty text and packs as its closing id alone; null and repeated doc_ids pack like
any other; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintage_jobs.llm.common import keeps, stored, widest

SPECIAL = "<|endoftext|>"


def lines_of_words(text: str) -> list[list[str]] | None:
    """The words of each line of a text with single blanks and line ends only; None for any other text."""
    if not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return None
    lines = [line.split(" ") for line in text.split("\n")]
    return lines if sum(map(len, lines)) == len(text.split()) else None


class Encoder:
    """Ids of texts as little-endian 32-bit bytes.

    Byte-level BPE never merges over the boundary between a non-space character and a single blank or line end that
    is followed by another non-space character, so the ids of such words are remembered and each unseen word is
    encoded once. With ``ranks``, the same vocabulary as merge ranks, a faster library encodes the words; texts of any
    other form always go through the tokenizer at ``path``. At most ``most`` words are kept.
    """

    def __init__(self, path: str, ranks: str | None = None, most: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.most = most
        self.bare: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.line = self.whole("\n")
        self.line_id = int.from_bytes(self.line, "little")

    def ids(self, text: str) -> np.ndarray:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return np.array(encode([text], add_special_tokens=False)[0].ids, "<u4")

    def whole(self, text: str) -> bytes:
        return self.ids(text).tobytes()

    def _learn(self, cache: dict[str, bytes], words: set[str], before: str) -> None:
        """Encodes unseen words, a few thousand at a time, one a line: a line end is an id of its own there."""
        new = words.difference(cache)
        if len(cache) + len(new) > self.most:
            cache.clear()
            new = words
        plain = []
        for w in new:
            if SPECIAL in w:
                cache[w] = self.whole(before + w)
            else:
                plain.append(w)
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            joined = before + f"\n{before}".join(part)
            ids = np.array(self.fast.encode_ordinary(joined), "<u4") if self.fast else self.ids(joined)
            ends = np.flatnonzero(ids == self.line_id).tolist()
            data = ids.tobytes()
            cache.update({w: data[4 * a : 4 * b] for w, a, b in zip(part, [0, *(e + 1 for e in ends)], [*ends, len(ids)], strict=True)})

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [lines_of_words(t) for t in texts]
        first, rest = set(), set()
        for lines in split:
            for words in lines or ():
                first.add(words[0])
                rest.update(words[1:])
        self._learn(self.bare, first, "")
        self._learn(self.spaced, rest, " ")
        bare, spaced = self.bare, self.spaced.__getitem__
        return [self.whole(t) if lines is None else self.line.join([b"".join([bare[w[0]], *map(spaced, w[1:])]) for w in lines]) for t, lines in zip(texts, split, strict=True)]


@lru_cache(2)
def encoder(path: str, ranks: str | None = None) -> Encoder:
    return Encoder(path, ranks)


keeps(encoder.cache_clear)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, seq_len: int = 2048, path: str | None = None, end_id: int = 1) -> DataFrame:
    """The token pieces of each document: full sequences and what is left of it."""
    ranks = None if path else tokenizer_path("byte_bpe_50k.tiktoken")
    path = path or tokenizer_path()
    schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECE.split(", ")])
    closing = int(end_id).to_bytes(4, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), own.encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    ids = memoryview(ids + closing)
                    n = len(ids) // 4
                    rows += [(doc, s, min(seq_len, n - s), zlib.crc32(ids[4 * s : 4 * (s + seq_len)]), n) for s in range(0, n, seq_len)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, PIECE)


def best_pattern(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes 1.. that fits ``capacity`` (unbounded knapsack)."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        sizes = min(c, len(values))
        worth = best[c - sizes : c][::-1] + values[:sizes]
        k = int(worth.argmax())
        best[c], took[c] = (worth[k], k + 1) if worth[k] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    pattern, c = np.zeros(len(values), np.int64), capacity
    while c > 0:
        if took[c]:
            pattern[took[c] - 1] += 1
        c -= max(1, took[c])
    return float(best[capacity]), pattern


def column_generation(demand: np.ndarray, capacity: int, gap: float = 1e-3, most: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Patterns and their fractional uses for demand[i] pieces of size i + 1: a revised simplex over priced columns."""
    rows = np.nonzero(demand)[0]
    if not len(rows):
        return []
    d = demand[rows].astype(float)
    columns = [np.zeros(len(demand), np.int64) for _ in rows]
    for column, r in zip(columns, rows, strict=True):
        column[r] = capacity // (r + 1)
    inverse = np.diag([1.0 / column[r] for column, r in zip(columns, rows, strict=True)])
    x = inverse @ d
    for _ in range(most):
        dual = inverse.sum(axis=0)
        values = np.zeros(len(demand))
        values[rows] = np.maximum(dual, 0)
        worth, pattern = best_pattern(values, capacity)
        if worth <= 1 + gap:  # the optimum is at least the present value / worth
            break
        step = inverse @ pattern[rows]
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        move = ratio[out]
        x -= move * step
        x[out] = move
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        columns[out] = pattern
        np.maximum(x, 0, out=x)
    return list(zip(columns, x.tolist(), strict=True))


def integer_patterns(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole uses of patterns that cover the demand: the program's, rounded down, then greedy ones for the rest."""
    left, out = demand.astype(np.int64).copy(), []
    for pattern, uses in sorted(column_generation(demand, capacity), key=lambda p: -p[1]):
        n = int(uses + 1e-9)
        if n:
            out.append((pattern, n))
            left -= n * pattern
    left = np.maximum(left, 0)
    while left.any():
        pattern, room = np.zeros_like(left), capacity
        for size in range(min(capacity, len(left)), 0, -1):
            k = min(int(left[size - 1]), room // size)
            pattern[size - 1], room = k, room - k * size
        n = int((left[pattern > 0] // pattern[pattern > 0]).min())
        out.append((pattern, n))
        left -= n * pattern
    return out


def assignment_rows(patterns: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, last rank + 1, first sequence, pieces a sequence, first slot) for each class of each pattern."""
    rows, taken, base = [], {}, 0
    for pattern, uses in patterns:
        slot = 0
        for c in np.nonzero(pattern)[0][::-1].tolist():
            k, lo = int(pattern[c]), taken.get(c, 0)
            taken[c] = lo + k * uses
            rows.append((c + 1, lo, lo + k * uses, base, k, slot))
            slot += k
        base += uses
    return rows


def packed(docs: DataFrame, seq_len: int = 2048, grain: int = 4, path: str | None = None) -> DataFrame:
    """One row for each piece, with its sequence and its offset there."""
    spark = docs.sparkSession
    capacity, salts = seq_len // grain, 4 * widest(spark)
    sized = pieces(docs, seq_len, path).withColumn("class", F.ceil(F.col("length") / grain).cast("int")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    sized = stored(sized, "pieces")
    counts = stored(sized.groupBy("class", "salt").count(), "piece-counts")
    demand = np.zeros(capacity, np.int64)
    for row in counts.groupBy("class").agg(F.sum("count").alias("n")).collect():  # at most `capacity` rows
        demand[row["class"] - 1] = row["n"]
    table = spark.createDataFrame(assignment_rows(integer_patterns(demand, capacity)), "class int, lo long, hi long, base long, k long, first_slot long")
    before = counts.select("class", "salt", (F.sum("count").over(Window.partitionBy("class").orderBy("salt")) - F.col("count")).alias("before"))
    order = Window.partitionBy("class", "salt").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32")
    ranked = sized.withColumn("own", F.row_number().over(order) - 1).join(before.hint("merge"), ["class", "salt"]).withColumn("rank", F.col("before") + F.col("own"))
    placed = ranked.join(F.broadcast(table), (ranked["class"] == table["class"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    within = F.col("rank") - F.col("lo")
    placed = placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.floor(within / F.col("k"))).cast("long").alias("sequence_id"), (F.col("first_slot") + within % F.col("k")).alias("slot"))
    sequence = Window.partitionBy("sequence_id").orderBy("slot")
    return placed.withColumn("offset", (F.sum("length").over(sequence) - F.col("length")).cast("long")).drop("slot")

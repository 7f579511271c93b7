"""Token counts by overlap resynchronisation.

A text of at most ``size`` characters is counted whole. A longer one is cut into chunks of ``size`` characters, each of
which overlaps the next; the chunks are dealt over all tasks and encoded with offsets. Two neighbours are spliced at a
position of their overlap where both begin a word of the tokenizer's own splitting. From there on the split depends only
on what follows, so this is the boundary of the whole text once the left chunk is right up to it and sees all that could
change its mind (``MARGIN`` characters: the longest is a special string). The first chunk is right from its start, so by
induction all splices are. What a splice adds (tokens of the left chunk before it, less those of the right one) sums up
to the count of the whole text; no chunk has to meet more than its neighbours. Documents with a pair that shares no such
position, as in one word longer than the overlap, are cut again into chunks and overlaps four times as wide; the last
such round has one chunk a document, so every document gets its count.

Defined results: a null text counts as the empty one; null and repeated doc_ids and rows are counted like any other; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage_jobs.llm.common import stored, widest
from vintage_jobs.llm.packing import Encoder, lines_of_words, tokenizer_path

#: Characters after a position that can decide whether it is a boundary: a special string that begins one character later.
MARGIN = 16


class Counter(Encoder):
    """Counts of texts; those of words are remembered, see Encoder."""

    def counts(self, texts: list[str]) -> list[int]:
        split = [lines_of_words(t) for t in texts]
        first, rest = set(), set()
        for lines in split:
            for words in lines or ():
                first.add(words[0])
                rest.update(words[1:])
        self._learn(self.bare, first, "")
        self._learn(self.spaced, rest, " ")
        bare, spaced = self.bare, self.spaced
        return [len(self.ids(t)) if lines is None else (len(lines) - 1) * len(self.line) // 4 + sum(len(bare[w[0]]) + sum(len(spaced[x]) for x in w[1:]) for w in lines) // 4 for t, lines in zip(texts, split, strict=True)]

    def starts(self, texts: list[str]) -> list[tuple[list[int], list[int], int]]:
        """For each text the characters at which words of the tokenizer begin, the tokens before each, and all tokens."""
        out = []
        for e in self.tokenizer.encode_batch(texts, add_special_tokens=False):
            words = e.word_ids
            own = [i for i in range(len(words)) if i == 0 or words[i] != words[i - 1]]
            offsets = e.offsets
            out.append(([offsets[i][0] for i in own], own, len(words)))
        return out


@lru_cache(2)
def counter(path: str, ranks: str | None = None) -> Counter:
    return Counter(path, ranks)


def chunk_ends(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of the chunks of a text of ``n`` characters; each starts ``overlap`` before the end of the last."""
    step = size - overlap
    return [(i * step, min(n, i * step + size)) for i in range(max(1, -(-(n - overlap) // step)))]


def _measured(docs: DataFrame, size: int, path: str, ranks: str | None) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row; rows of long texts have a key (the digest of the text) and the text instead."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("key", pa.string()), ("text", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                long = [len(t) > size for t in texts]
                raw = [t.encode() for t in texts]
                found = iter(own.counts([t for t, x in zip(texts, long, strict=True) if not x]))
                columns = [
                    part.column("doc_id"),
                    pa.array(map(len, raw), pa.int64()),
                    pa.array([None if x else next(found) for x in long], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() if x else None for b, x in zip(raw, long, strict=True)], pa.string()),
                    pa.array([t if x else None for t, x in zip(texts, long, strict=True)], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, n_bytes long, n_tokens long, key string, text string")


def chunks(texts: DataFrame, size: int, overlap: int) -> DataFrame:
    """key, no, start, last, text: the chunks of each text, dealt evenly over all tasks."""
    if overlap <= MARGIN or size < 2 * overlap:
        raise ValueError(f"an overlap has over {MARGIN} characters and at most half a chunk")
    schema = pa.schema([("key", pa.string()), ("no", pa.int64()), ("start", pa.int64()), ("last", pa.bool_()), ("text", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ends = chunk_ends(len(text), size, overlap)
                for lo in range(0, len(ends), 64):
                    rows = [(key, i, *ends[i][:1], i == len(ends) - 1, text[slice(*ends[i])]) for i in range(lo, min(lo + 64, len(ends)))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return texts.mapInArrow(work, "key string, no long, start long, last boolean, text string").repartition(widest(texts.sparkSession))


def encoded(cut: DataFrame, overlap: int, path: str) -> DataFrame:
    """key, no, last, n, and the word starts in both overlaps of each chunk (position in the text, tokens before it)."""
    schema = pa.schema([("key", pa.string()), ("no", pa.int64()), ("last", pa.bool_()), ("n", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("head", "head_n", "tail", "tail_n"))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16).to_pylist()
                rows = []
                for r, (places, before, n) in zip(part, own.starts([r["text"] for r in part]), strict=True):
                    lo, hi, end = r["start"], len(r["text"]) - overlap, len(r["text"]) - MARGIN
                    head = [i for i, p in enumerate(places) if p <= overlap] if r["no"] else []
                    tail = [i for i, p in enumerate(places) if hi <= p <= end] if not r["last"] else []
                    rows.append((r["key"], r["no"], r["last"], n, *([x[i] + y for i in z] for z in (head, tail) for x, y in ((places, lo), (before, 0)))))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return cut.mapInArrow(work, "key string, no long, last boolean, n long, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>")


def spliced(made: DataFrame) -> DataFrame:
    """key, n: the tokens of each text, null where two neighbours have no common word start.

    Every chunk goes to the splice before it and the one after it; equal texts give equal rows, of which one counts.
    """
    none = F.lit(None).cast("array<long>")
    before = F.struct((F.col("no") - 1).alias("at"), none.alias("left"), none.alias("left_n"), F.col("head").alias("right"), F.col("head_n").alias("right_n"), F.lit(None).cast("long").alias("whole"))
    after = F.struct(F.col("no").alias("at"), F.col("tail").alias("left"), F.col("tail_n").alias("left_n"), none.alias("right"), none.alias("right_n"), F.when(F.col("last"), F.col("n")).alias("whole"))
    sides = made.select("key", F.explode(F.array(before, after)).alias("s")).select("key", "s.*").where("at >= 0")
    met = sides.groupBy("key", "at").agg(*(F.max(c).alias(c) for c in ("left", "left_n", "right", "right_n", "whole")))
    place = F.array_max(F.array_intersect("left", "right"))
    adds = F.try_element_at("left_n", F.array_position("left", place).cast("int")) - F.try_element_at("right_n", F.array_position("right", place).cast("int"))
    met = met.select("key", F.coalesce("whole", adds).alias("adds"))
    return met.groupBy("key").agg(F.sum("adds").alias("n"), F.bool_or(F.col("adds").isNull()).alias("failed")).select("key", F.when(~F.col("failed"), F.col("n")).alias("n"))


def counted(docs: DataFrame, size: int = 32_768, overlap: int = 512, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row; special strings in a text are what the library takes them for."""
    ranks = None if path else tokenizer_path("byte_bpe_50k.tiktoken")
    path = path or tokenizer_path()
    rows = stored(_measured(docs, size, path, ranks), "measured")
    long = rows.where(F.col("key").isNotNull()).select("key", "text")
    found, left = [], long
    while True:
        made = stored(spliced(encoded(chunks(left, size, overlap), overlap, path)), "spliced")
        found.append(made.where(F.col("n").isNotNull()))
        failed = made.where(F.col("n").isNull())
        if failed.isEmpty():  # at the latest when a chunk is as long as the longest text
            break
        left, size, overlap = long.join(failed.select("key"), "key", "left_semi"), 4 * size, 4 * overlap
    totals = found[0]
    for more in found[1:]:
        totals = totals.unionByName(more)
    short = rows.where(F.col("key").isNull()).select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(rows.where(F.col("key").isNotNull()).select("doc_id", "n_bytes", "key").join(totals, "key").select("doc_id", "n_bytes", F.col("n").alias("n_tokens")))


def count_digest(docs: DataFrame, limit: int = 512) -> DataFrame:
    """The counts of every document, and whether they exceed ``limit`` tokens."""
    return counted(docs).withColumn("over_limit", F.col("n_tokens") > limit)

"""Exact substring dedup with fixed-block anchors.

A window of ``window`` words contains a whole block of window / 2 words that begins at a multiple of that length in
its document. So the non-overlapping blocks of every document are the reference index, and every rolling window of a
block's length probes it: where a probe meets a block of another place, both places are anchors. Anchors are extended
to all windows that hold one; windows are compared by two 64-bit hashes that share neither the hash of a word nor the
way words are combined, and all but the earliest of each class are removed; what they cover are the maximal exact
repeats. Texts do not travel with the windows, so equality rests on these 128 bits: among 10^13 windows the chance of
one wrong match is about 10^-13.

Index and probes are dealt by hash in packed arrays, about six bytes a word. A batch sends a hash once however often
it holds it, so a passage that a third of all documents share costs one entry a batch. Anchors only choose the windows
that are compared: a chance match adds work and changes no result.

Defined results: null texts have no words; documents are ordered by doc_id (null last), then by a hash of id and text;
rows equal in both are one document and share its result; documents are joined by both. A window's class, its earliest place in each batch, meets in
one group of a bucket: a passage in every batch costs a bucket about 25 bytes a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintage_jobs.llm.common import stored, widest

MULTIPLIER, SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
PLAIN, ALIGNED, HEADER, FLAGGED = range(4)


@lru_cache(4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between ASCII white space."""
    space = np.ones(len(data) + 2, np.int8)
    space[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    step = np.diff(space)
    return np.flatnonzero(step == -1), np.flatnonzero(step == 1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 17, base: int = MULTIPLIER) -> np.ndarray:
    """A 64-bit hash of each word: differences of a prefix polynomial, a block of bytes at a time."""
    inverse = pow(base, -1, 1 << 64)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + block, "right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        size = max(block, 1 << (hi - lo).bit_length())
        prefix = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * powers(base, size)[: hi - lo], out=prefix[1:])
        own = (prefix[ends[at:to] - lo] - prefix[starts[at:to] - lo]) * powers(inverse, size)[starts[at:to] - lo]
        out[at:to] = mixed(own + (ends[at:to] - starts[at:to]).astype(np.uint64))
        at = to
    return out


def window_hashes(words: np.ndarray, size: int, seed: int, base: int = MULTIPLIER) -> np.ndarray:
    """The hash of each run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, seed, np.uint64)
    for j in range(size):
        out = out * np.uint64(base) + words[j : j + n]
    return mixed(out)


def planes(values: np.ndarray) -> bytes:
    """32-bit numbers, all lowest bytes first: ascending ones compress well so."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _group_starts(*ordered: np.ndarray) -> np.ndarray:
    """Which entries of sorted arrays differ from the one before."""
    new = np.ones(len(ordered[0]), bool)
    new[1:] = np.logical_or.reduce([a[1:] != a[:-1] for a in ordered])
    return new


SENT = "bucket int, batch long, kind int, hashes binary, places binary"


def _anchor_rows(keys: list[tuple[int, int]], texts: list[bytes], window: int, buckets: int) -> Iterator[tuple]:
    """What one batch of documents sends: its blocks and probes by bucket, its local anchors and its own layout."""
    block = window // 2
    buffer = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, ends = word_bounds(buffer)
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1]))
    first = np.searchsorted(starts, offsets)
    hashes = window_hashes(word_hashes(buffer, starts, ends), block, 7)
    doc = np.repeat(np.arange(len(texts)), np.diff(np.append(first, len(starts))))
    n = len(hashes)
    place = np.flatnonzero(doc[:n] == doc[block - 1 : block - 1 + n]) if n else np.empty(0, np.int64)
    if not len(place):
        return
    batch = xxhash.xxh64_intdigest(np.array(keys, np.int64).tobytes()) >> 1
    aside = -1 - batch % buckets
    yield aside, batch, HEADER, np.array(keys, "<i8").tobytes(), first.astype("<u4").tobytes()
    hashes, aligned = hashes[place], (place - first[doc[place]]) % block == 0
    order = np.argsort(hashes, kind="stable")
    new = _group_starts(hashes[order])
    begin = np.flatnonzero(new)
    many = np.diff(np.append(begin, len(order))) > 1
    if many.any():
        repeated = np.repeat(many, np.diff(np.append(begin, len(order))))
        yield aside, batch, FLAGGED, None, planes(np.sort(place[order][repeated]))
    any_aligned = np.logical_or.reduceat(aligned[order], begin)
    one = order[begin]
    sent, where = hashes[one], place[one]
    by = (sent & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
    for kind, own in ((PLAIN, ~any_aligned), (ALIGNED, any_aligned)):
        idx = np.flatnonzero(own)
        idx = idx[np.lexsort((where[idx], by[idx]))]
        cuts = np.searchsorted(by[idx], np.arange(buckets + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            part = idx[cuts[b] : cuts[b + 1]]
            yield b, batch, kind, (sent[part] >> np.uint64(32)).astype("<u4").tobytes(), planes(where[part])


def _met(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Places of one bucket whose hash meets a reference block elsewhere."""
    if key[0] < 0:
        return pdf[["batch", "kind", "hashes", "places"]]
    kinds = []
    for kind in (PLAIN, ALIGNED):
        own = pdf[pdf.kind == kind]
        found = [np.frombuffer(h, "<u4") for h in own.hashes]
        kinds.append((own, found, np.concatenate(found) if found else np.empty(0, np.uint32)))
    (plain, plain_parts, probes), (blocks, block_parts, index) = kinds
    distinct, inverse, counts = np.unique(index, return_inverse=True, return_counts=True)
    met = counts > 1
    if len(distinct):
        at = np.searchsorted(distinct, probes)
        at[at == len(distinct)] = 0
        hit = distinct[at] == probes
        met[at[hit]] = True
    else:
        hit = np.zeros(len(probes), bool)
    rows = []
    for own, parts, flags in ((plain, plain_parts, hit), (blocks, block_parts, met[inverse] if len(index) else np.empty(0, bool))):
        end = 0
        for batch, part, places in zip(own.batch, parts, own.places, strict=True):
            mine = flags[end : end + len(part)]
            end += len(part)
            if mine.any():
                rows.append((batch, FLAGGED, None, planes(from_planes(places)[mine])))
    return pd.DataFrame(rows, columns=["batch", "kind", "hashes", "places"])


def _to_documents(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """The anchors of one batch by document."""
    head = pdf[pdf.kind == HEADER].iloc[0]
    keys, first = np.frombuffer(head.hashes, "<i8").reshape(-1, 2), np.frombuffer(head.places, "<u4").astype(np.int64)
    found = [from_planes(p) for p in pdf[pdf.kind == FLAGGED].places]
    place = np.unique(np.concatenate(found)).astype(np.int64) if found else np.empty(0, np.int64)
    doc = np.searchsorted(first, place, "right") - 1
    cuts = np.flatnonzero(_group_starts(doc)) if len(doc) else []
    rows = [(*keys[doc[a]].tolist(), planes(place[a:b] - first[doc[a]])) for a, b in zip(cuts, [*cuts[1:], len(doc)], strict=True)]
    return pd.DataFrame(rows, columns=["id", "row_key", "anchors"])


#: What tells documents apart: the id (-1 for null) and a hash of id and text.
KEY = ["id", "row_key"]


def row_key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row_key")]


def anchors(docs: DataFrame, window: int, buckets: int, batch_bytes: int = 1 << 21) -> DataFrame:
    """id, row_key, anchors: word positions of each document where a block of another place begins."""
    schema = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), ("hashes", pa.binary()), ("places", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, size = [], [], 0

        def flush():
            rows = list(_anchor_rows(keys, texts, window, buckets))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for *key, text in zip(*(batch.column(c).to_pylist() for c in KEY), batch.column("text"), strict=True):
                keys.append(tuple(key))
                texts.append(text.as_py())
                size += len(texts[-1]) + 1
                if size >= batch_bytes:
                    yield from flush()
                    keys, texts, size = [], [], 0
        if keys:
            yield from flush()

    rows = docs.where("text IS NOT NULL").select(*row_key(), F.col("text").cast("string").cast("binary").alias("text"))
    met = rows.mapInArrow(work, SENT).groupBy("bucket").applyInPandas(_met, "batch long, kind int, hashes binary, places binary")
    return met.groupBy("batch").applyInPandas(_to_documents, "id long, row_key long, anchors binary")


WINDOWS = "bucket int, h1 binary, h2 binary, docs binary, doc binary, start binary, later_docs binary, later_doc binary, later_start binary"
#: A document: its place in the order of documents.
DOC = np.dtype([("none", "<u1"), ("id", "<i8"), ("key", "<i8")])


def _listed(docs: np.ndarray, doc: np.ndarray) -> tuple[bytes, bytes]:
    """The documents that ``doc`` points to, and where each points among them."""
    own, at = np.unique(doc, return_inverse=True)
    return docs[own].tobytes(), planes(at)


def _later_than_first(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of windows by class and place, which of them begin a class, and which begin later than that one."""
    order = np.lexsort((start, doc, h2, h1))
    h1, h2, doc, start = h1[order], h2[order], doc[order], start[order]
    new = _group_starts(h1, h2)
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return order, new, (doc != doc[head]) | (start != start[head])


def _window_rows(docs: list[tuple], held: list[tuple], buckets: int) -> Iterator[tuple]:
    """What one batch sends of its windows: the first of each class by bucket, and the later ones it knows already."""
    table, rank = np.unique(np.array(docs, DOC), return_inverse=True)
    h1, h2, start = (np.concatenate([h[i] for h in held]) for i in range(3))
    doc = np.repeat(rank, [len(h[0]) for h in held])
    order, new, later = _later_than_first(h1, h2, doc, start)
    h1, h2, doc, start = h1[order], h2[order], doc[order], start[order]
    first = np.flatnonzero(new)
    by = (h1[first] % np.uint64(buckets)).astype(np.int64)
    first = first[np.argsort(by, kind="stable")]
    cuts = np.searchsorted(np.sort(by), np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(cuts)).tolist()
    for b, known in zip(used, np.array_split(np.flatnonzero(later), len(used)), strict=True):
        p = first[cuts[b] : cuts[b + 1]]
        yield b, h1[p].tobytes(), h2[p].tobytes(), *_listed(table, doc[p]), planes(start[p]), *_listed(table, doc[known]), planes(start[known])


def _later(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Windows of one bucket that begin earlier elsewhere."""
    h1, h2 = (np.frombuffer(b"".join(pdf[c]), "<u8") for c in ("h1", "h2"))
    start, known = (np.concatenate([from_planes(x) for x in pdf[c]]) for c in ("start", "later_start"))

    def places(docs: str, doc: str) -> tuple[np.ndarray, np.ndarray]:
        """All documents in their order, and the rank there of each window's."""
        table, rank = np.unique(np.frombuffer(b"".join(pdf[docs]), DOC), return_inverse=True)
        base = np.concatenate(([0], np.cumsum([len(x) // DOC.itemsize for x in pdf[docs]])[:-1]))
        return table, rank[np.concatenate([from_planes(x).astype(np.int64) + n for x, n in zip(pdf[doc], base.tolist(), strict=True)])]

    table, doc = places("docs", "doc")
    order, _, later = _later_than_first(h1, h2, doc, start)
    later = order[later]
    known_table, known_doc = places("later_docs", "later_doc")
    found = np.concatenate((table[doc[later]], known_table[known_doc]))
    return pd.DataFrame({"id": np.where(found["none"] == 1, -1, found["id"]), "row_key": found["key"], "start": np.concatenate((start[later], known)).astype(np.int32)})


def later_windows(rows: DataFrame, window: int, buckets: int, batch_windows: int = 1 << 18) -> DataFrame:
    """id, row_key, start: windows with an anchor whose words also begin earlier."""
    schema = pa.schema([("bucket", pa.int32()), *((n.split()[0], pa.binary()) for n in WINDOWS.split(", ")[1:])])
    block = window // 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, held, size = [], [], 0

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*_window_rows(docs, held, buckets), strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for doc, key, packed, found in zip(*(batch.column(n) for n in ("doc_id", "row_key", "packed", "anchors")), strict=True):
                data = np.frombuffer(zstandard.decompress(packed.as_py()), np.uint8)
                bounds = word_bounds(data)
                words = word_hashes(data, *bounds)
                n = len(words) - window + 1
                if n <= 0:
                    continue
                hit = np.zeros(len(words) + 1, np.int32)
                for part in found.as_py():
                    hit[from_planes(part).astype(np.int64) + 1] = 1
                total = np.cumsum(hit)
                start = np.flatnonzero(total[block + 1 : block + 1 + n] > total[:n])
                if not len(start):
                    continue
                others = word_hashes(data, *bounds, base=SECOND)
                docs.append((doc.as_py() is None, doc.as_py() or 0, key.as_py()))
                held.append((window_hashes(words, window, 11)[start], window_hashes(others, window, 13, SECOND)[start], start.astype("<u4")))
                size += len(start)
                if size >= batch_windows:
                    yield from flush()
                    docs, held, size = [], [], 0
        if held:
            yield from flush()

    return rows.where("anchors IS NOT NULL").mapInArrow(work, WINDOWS).groupBy("bucket").applyInPandas(_later, "id long, row_key long, start int")


def buckets_for(docs: DataFrame, words_a_bucket: int = 1 << 20) -> int:
    """Enough buckets for about ``words_a_bucket`` words each."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(2 * widest(docs.sparkSession), -(-size // (6 * words_a_bucket)))


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that only a part's results are in memory beside the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def repeats_removed(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, removed (spans of word positions), kept_text of every row."""
    if window % 2:
        raise ValueError("the window must be even")
    buckets = buckets_for(docs)
    found = stored(anchors(docs, window, buckets), "anchors").groupBy(*KEY).agg(F.collect_list("anchors").alias("anchors"))
    packing = pa.schema([("doc_id", pa.int64()), ("id", pa.int64()), ("row_key", pa.int64()), ("packed", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(3)
        for batch in in_parts(batches):
            packed = pa.array([press.compress(t.as_py()) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in KEY), packed], schema=packing)

    texts = docs.select(F.col("doc_id").cast("long"), *row_key(), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    base = texts.mapInArrow(pack, "doc_id long, id long, row_key long, packed binary").join(found, KEY, "left").select("doc_id", *KEY, "packed", "anchors")
    later = later_windows(base, window, buckets).groupBy(*KEY).agg(F.collect_list("start").alias("starts"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            rows = []
            for doc, packed, starts in zip(batch.column("doc_id").to_pylist(), batch.column("packed"), batch.column("starts"), strict=True):
                words = zstandard.decompress(packed.as_py()).split()
                spans, kept, at = [], [], 0
                for s in sorted(set(starts.as_py() or ())):
                    if spans and s <= spans[-1]["end"]:
                        spans[-1]["end"] = s + window
                    else:
                        spans.append({"start": s, "end": s + window})
                for span in spans:
                    kept += words[at : span["start"]]
                    at = span["end"]
                rows.append((doc, len(words), spans, b" ".join([*kept, *words[at:]]).decode()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return base.select("doc_id", *KEY, "packed").join(later, KEY, "left").mapInArrow(cut, "doc_id long, n_words long, removed array<struct<start long, end long>>, kept_text string")


def substring_digest(docs: DataFrame) -> DataFrame:
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return repeats_removed(docs).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, [w FOR w IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF w <> ''] AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
s AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS n FROM g),
c AS (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM s WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p FROM c),
x AS (SELECT doc_id, w, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT x.doc_id, count(*) FILTER (WHERE gone.p IS NOT NULL) AS n_removed, string_agg(CASE WHEN gone.p IS NULL THEN word END, ' ' ORDER BY x.p) AS kept FROM x LEFT JOIN gone USING (doc_id, p) GROUP BY x.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

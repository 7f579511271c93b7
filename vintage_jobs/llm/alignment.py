"""Alignment of two tokenizers by a cogroup of postings.

Every text is encoded by both tokenizers, A on blank and text, B on the text (it adds the blank). Positions in the bytes
where tokens of both end cut them into groups; tokens whose bytes overlap are linked. Each task folds its documents into
batches and emits, per batch, one posting an id pair: the documents that link it and how often. Postings are shuffled by
pair, B's id first, to meet the pair's count and the highest count of its B id: the join merges two sorted streams, which
Spark spills. Each posting so gives what it adds to its documents; these are dealt back by batch, where they are summed.

A pair's postings are at most one a batch; pairs with more of them than a share of a task are dealt over several tasks.
A B id has at most as many pairs as A has ids, whatever the input is, so its highest count is a window over few rows.

Words are aligned once a worker: neither tokenizer has a token over the boundary between a word and a blank or line end
that another word follows (B has no piece with a blank after another character and none with a line end). Texts of other
forms go through both tokenizers whole.

Defined results: null and empty texts, and those whose joined tokens differ from blank and text (B writes U+2581 as a
blank), have no tokens: zeros and an empty digest. Special strings in a text are plain text. Null and repeated doc_ids and
rows are documents of their own and all count; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintage_jobs.llm.common import joined_by_key, stored, widest
from vintage_jobs.llm.packing import lines_of_words, tokenizer_path

#: A word with the blank before it, a word that begins a line, or a line end.
PARTS = re.compile(r"\n| ?[^ \n]+")


def aligned(a: list[int], b: list[int], len_a: list[int], len_b: list[int]) -> tuple[str, int, list[int]]:
    """The groups as text, how many, and the links (B's id in the upper half, A's in the lower), for equally long bytes."""
    groups, links, i, j, i0, j0 = [], [], 0, 0, 0, 0
    end_a, end_b = len_a[a[0]], len_b[b[0]]
    while True:
        links.append(b[j] << 32 | a[i])
        at_a, at_b = end_a <= end_b, end_b <= end_a
        if at_a and at_b:
            groups.append(f"{','.join(map(str, a[i0 : i + 1]))}|{','.join(map(str, b[j0 : j + 1]))}")
            i0, j0 = i + 1, j + 1
            if i0 == len(a):
                return ";".join(groups), len(groups), links
        if at_a:
            i += 1
            end_a += len_a[a[i]]
        if at_b:
            j += 1
            end_b += len_b[b[j]]


class Aligner:
    """Both tokenizers, and the alignments of the words seen since the last ``forget``, which is due beyond ``most``."""

    def __init__(self, path_a: str, path_b: str, ranks_a: str | None = None, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b, self.most, self.fast = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b), most, None
        self.a.encode_special_tokens = True
        if ranks_a:
            import public_tokenizers
            import tiktoken

            with open(ranks_a, "rb") as lines:
                merges = {base64.b64decode(x): int(y) for x, y in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        # the byte of each character of byte-level tokens: printable ones stand for themselves, the others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(sorted(set(range(256)) - set(plain)))}
        self.bytes_a = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in (self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size()))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = list(map(len, self.bytes_a)), list(map(len, self.bytes_b))
        self.width_a, self.width_b = np.array(self.len_a), np.array(self.len_b)
        # each id as it is shown within a group and at the end of its side
        self.shown = [f"{i}{c}" for i in range(len(self.len_a)) for c in ",|"] + [f"{i}{c}" for i in range(len(self.len_b)) for c in ",;"]
        self.shown_width = np.array(list(map(len, self.shown)))
        self.by_word = not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes = np.zeros((1024, 4), np.int64)  # tokens of A and B, groups, links; -1 where the bytes differ
        self.new: list[tuple[np.ndarray, np.ndarray]] = []  # links of words learned together, and how many each has
        self.flat, self.starts = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def all_links(self) -> tuple[np.ndarray, np.ndarray]:
        """The links of all words in one array, and where those of each word begin."""
        if self.new:
            links, many = map(np.concatenate, zip(*self.new, strict=True))
            self.flat, self.starts = np.concatenate((self.flat, links)), np.concatenate((self.starts, np.cumsum(many) + self.starts[-1]))
            self.new = []
        return self.flat, self.starts

    @property
    def links(self) -> list[list[int]]:
        """The links of each word."""
        flat, starts = self.all_links()
        return [flat[lo:hi].tolist() for lo, hi in zip(starts[:-1], starts[1:], strict=True)]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]

    def compared(self, data: bytes, a: list[int], b: list[int]) -> tuple[str, int, list[int]] | None:
        if not a or not b or b"".join([self.bytes_a[i] for i in a]) != data or b"".join([self.bytes_b[i] for i in b]) != data:
            return None
        return aligned(a, b, self.len_a, self.len_b)

    def whole(self, text: str) -> tuple[str, tuple[int, int, int, int], list[int]] | None:
        """Groups, sizes and links of a text, without remembered words."""
        if not text:
            return None
        a, b = self._ids([" " + text])[0], self.b.encode(text)
        found = self.compared((" " + text).encode(), a, b)
        return found and (found[0], (len(a), len(b), found[1], len(found[2])), found[2])

    def _learn(self, words: list[str]) -> None:
        ids_a = [self.fast.encode_ordinary(w) for w in words] if self.fast else self._ids(words)
        # B puts a blank before every text: a line end takes it up for words that have none
        ids_b = [x[0:] if w[0] == " " else x[2:] if w != "\n" else x[1:] for w, x in zip(words, self.b.encode([w[1:] if w[0] == " " else w if w == "\n" else "\n" + w for w in words], num_threads=1), strict=True)]
        while len(self.groups) + len(words) > len(self.sizes):
            self.sizes = np.concatenate((self.sizes, np.zeros_like(self.sizes)))
        data = [w.encode() for w in words]
        good = [a and b and b"".join([self.bytes_a[i] for i in a]) == d == b"".join([self.bytes_b[i] for i in b]) for a, b, d in zip(ids_a, ids_b, data, strict=True)]
        if not all(good):
            ids_a, ids_b = ([x if g else [] for x, g in zip(ids, good, strict=True)] for ids in (ids_a, ids_b))
        groups, sizes, links = self.aligned_all(ids_a, ids_b)
        n = len(self.groups)
        self.place.update(zip(words, range(n, n + len(words)), strict=True))
        self.sizes[n : n + len(words)] = sizes
        self.sizes[n : n + len(words)][[not g for g in good]] = -1
        self.groups += groups
        self.new.append((links, sizes[:, 3]))

    def aligned_all(self, ids_a: list[list[int]], ids_b: list[list[int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """What ``aligned`` gives for each of many words, at once: groups, sizes (a row a word), and the links of all.

        The words are laid end to end, so a place in the bytes tells the word; a word without tokens takes none.
        """
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, n.sum()) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        end_a, end_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])
        ends = np.union1d(end_a, end_b)  # a link lasts up to each
        of_a, of_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        closed = (end_a[of_a] == ends) & (end_b[of_b] == ends)
        word = np.repeat(np.arange(len(n_a)), n_a)[of_a]
        sizes = np.column_stack((n_a, n_b, np.bincount(word[closed], minlength=len(n_a)), np.bincount(word, minlength=len(n_a))))
        in_a, in_b = np.searchsorted(ends[closed], end_a), np.searchsorted(ends[closed], end_b)
        last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (in_a, in_b))
        order = np.argsort(np.concatenate((2 * in_a, 2 * in_b + 1)), kind="stable")
        shown = np.concatenate((2 * a + last_a, 2 * (b + len(self.width_a)) + last_b))[order]
        text = "".join(map(self.shown.__getitem__, shown.tolist()))
        at = np.concatenate(([0], np.cumsum(self.shown_width[shown])))[np.concatenate(([0], np.cumsum(n_a + n_b)))].tolist()
        return [text[lo : max(lo, hi - 1)] for lo, hi in zip(at, at[1:], strict=False)], sizes, b[of_b] << 32 | a[of_a]

    def by_parts(self, texts: list[str]) -> list[list[int] | None]:
        """The places of the words of each text; None for texts that have to go whole."""
        split = [PARTS.findall(" " + t) if self.by_word and lines_of_words(t) is not None else None for t in texts]
        seen = set().union(*(s for s in split if s))
        self._learn(list(seen.difference(self.place)))
        return [None if s is None else [self.place[w] for w in s] for s in split]


@lru_cache(2)
def aligner(path_a: str, path_b: str, ranks_a: str | None = None) -> Aligner:
    return Aligner(path_a, path_b, ranks_a)


ROWS = "batch long, at int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pair long, total long, ats array<int>, times array<int>"


def _as_batch(schema: pa.Schema, columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def postings_of(pairs: np.ndarray, ats: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, the sum of times and where the documents of each begin, and documents and times by pair; from links
    of ``n`` documents in any order."""
    own, place = np.unique(pairs, return_inverse=True)
    key = place * n + ats
    order = np.argsort(key)
    key, times = key[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    times, key = (np.add.reduceat(times, first) if len(key) else times), key[first]
    starts = np.searchsorted(key // n, np.arange(len(own) + 1))
    total = np.add.reduceat(times, starts[:-1]) if len(own) else times
    return own, total, starts, key % n, times


def linked(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, digest: bool = True, words: int = 1 << 18) -> DataFrame:
    """Rows of documents (at is their number in the batch; groups as text, or their digest) and rows of postings (pair is
    not null), for batches of about ``words`` words each."""
    ranks = None if path_a else tokenizer_path("byte_bpe_50k.tiktoken")
    path_a, path_b = path_a or tokenizer_path(), path_b or tokenizer_path("piece_bpe_32k.model")
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ROWS.split(", ")])

    def flushed(own: Aligner, held: list[tuple], number: int) -> Iterator[pa.RecordBatch]:
        shown = [(hashlib.sha256(g.encode()).hexdigest() if digest and g else g) for _, g, _, _, _ in held]
        sizes = [s for _, _, s, _, _ in held]
        columns = {"batch": pa.array([number] * len(held), pa.int64()), "at": pa.array(range(len(held)), pa.int32()), "doc_id": pa.array([d for d, *_ in held], pa.int64()), "groups": pa.array(shown, pa.string())}
        yield _as_batch(schema, columns | {c: pa.array([s[i] for s in sizes], pa.int64()) for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}, len(held))
        links, (flat, starts) = [], own.all_links()
        for at, (_, _, _, places, alone) in enumerate(held):
            if places is not None:
                found, many = np.unique(places, return_counts=True)
                n = starts[found + 1] - starts[found]
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                links.append((flat[np.repeat(starts[found], n) + inner], np.full(n.sum(), at), np.repeat(many, n)))
            elif alone:
                links.append((np.array(alone, np.int64), np.full(len(alone), at), np.ones(len(alone), np.int64)))
        if links:
            pairs, total, begin, ats, times = postings_of(*map(np.concatenate, zip(*links, strict=True)), len(held))
            for lo in range(0, len(pairs), 20_000):
                hi = min(lo + 20_000, len(pairs))
                lists = {c: pa.ListArray.from_arrays(pa.array(begin[lo : hi + 1] - begin[lo], pa.int32()), pa.array(x[begin[lo] : begin[hi]], pa.int32())) for c, x in (("ats", ats), ("times", times))}
                yield _as_batch(schema, {"batch": pa.array(np.full(hi - lo, number), pa.int64()), "pair": pa.array(pairs[lo:hi], pa.int64()), "total": pa.array(total[lo:hi], pa.int64())} | lists, hi - lo)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, size, number = aligner(path_a, path_b, ranks), [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc, text, places in zip(part.column("doc_id").to_pylist(), texts, own.by_parts(texts), strict=True):
                    if places is None:
                        groups, sizes, alone = own.whole(text) or ("", (0, 0, 0, 0), [])
                        held.append((doc, groups, sizes, None, alone))
                        size += len(alone)
                    else:
                        of = own.sizes[places]
                        good = bool(of.min() >= 0)
                        held.append((doc, ";".join([own.groups[i] for i in places]), tuple(of.sum(axis=0).tolist()), places, None) if good else (doc, "", (0, 0, 0, 0), None, []))
                        size += len(places)
                if size >= words or len(own.place) > own.most:
                    yield from flushed(own, held, number)
                    held, size, number = [], 0, number + 1
                    if len(own.place) > own.most:  # nothing is held that needs them
                        own.forget()
        if held:
            yield from flushed(own, held, number)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, ROWS)


def pair_counts(postings: DataFrame) -> DataFrame:
    """pair, count, rows, best: the links of each pair, its postings, and whether no pair of its B id has more links."""
    counts = postings.groupBy("pair").agg(F.sum("total").alias("count"), F.count("*").alias("rows"))
    most = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.withColumn("best", F.col("count") == most)


def contributions(met: DataFrame) -> DataFrame:
    """batch, at, n_best, count_sum: what the postings add to each document, summed over the rows of its batch."""
    schema = pa.schema([("batch", pa.int64()), ("at", pa.int32()), ("n_best", pa.int64()), ("count_sum", pa.int64())])

    def packed(number: int, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(sums), number), pa.int64()), pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = None, np.zeros((0, 2), np.int64)
        for batch in batches:
            numbers = batch.column("batch").to_numpy()
            for lo in np.flatnonzero(np.concatenate(([True], numbers[1:] != numbers[:-1]))) if len(numbers) else ():
                own = batch.slice(lo, np.searchsorted(numbers[lo:], numbers[lo], "right"))
                if numbers[lo] != held:
                    if held is not None:
                        yield packed(held, sums)
                    held, sums = int(numbers[lo]), np.zeros((0, 2), np.int64)
                ats, times = (own.column(c).flatten().to_numpy() for c in ("ats", "times"))
                many = np.diff(own.column("ats").offsets.to_numpy())
                if len(ats) and ats.max() >= len(sums):
                    sums = np.concatenate((sums, np.zeros((int(ats.max()) + 1 - len(sums), 2), np.int64)))
                best, count = (np.repeat(own.column(c).to_numpy(zero_copy_only=False).astype(np.int64), many) for c in ("best", "count"))
                np.add.at(sums, ats, np.column_stack((best * times, count * times)))
        if held is not None:
            yield packed(held, sums)

    rows = met.select("batch", "best", "count", "ats", "times").repartition(widest(met.sparkSession), "batch").sortWithinPartitions("batch")
    return rows.mapInArrow(work, "batch long, at int, n_best long, count_sum long")


def alignment_digest(docs: DataFrame) -> DataFrame:
    """Per document: tokens, groups and links, the links that are their B id's most frequent, and the sum of their counts."""
    rows = stored(linked(docs), "linked")
    postings = rows.where(F.col("pair").isNotNull()).select("batch", "pair", "total", "ats", "times")
    pairs = stored(pair_counts(postings), "pairs")
    met = joined_by_key(postings.drop("total"), pairs, "pair", "rows", postings.count(), ["batch"])
    made = rows.where(F.col("pair").isNull()).select("batch", "at", "doc_id", "n_a", "n_b", "n_groups", "n_links", F.col("groups").alias("groups_sha256"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return made.join(contributions(met), ["batch", "at"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")

"""Vector codes: each vector's parts as indexes of small codebooks, assigned by exponion search in whole numbers.

Components are floor(4096 x). Each round assigns every part to the nearest entry of its codebook and moves the entries to
their parts' means. The search starts at the entry of the round before, at squared distance d. An entry that is as near
or nearer lies within twice that distance of it, so only those of its neighbours, sorted by distance, are compared whose
squared distance is at most 4 d: exact in whole numbers, with ties to the lower index.

Vectors travel as bytes with their codes, are kept on the executors' disks from round to round (a lost one is made anew
from the rounds before), and each round brings to the driver only the sums of the entries: 16 times the components of a
vector, whatever the input is.

Defined results: null vectors and those with null or non-finite components are dropped. The first codebooks come from the
smallest vec_ids, nulls first, equal ids by their vector; fewer than 16 rows give so many entries. The length of the
first of them holds for the table, and vectors of another length are dropped; if it is no multiple of the parts, the
first parts have one component more. Repeated rows are coded like any other; components beyond +-2^27 / 4096 count as
that. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage_jobs.llm.common import stored

#: Largest whole number of a component: squared distances of parts of up to 128 components fit 64 bits.
LARGEST = 1 << 27


def nearest(x: np.ndarray, start: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of each row; ties go to the lower index."""
    between = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(between, axis=1, kind="stable")  # each entry's neighbours, itself among them
    ordered = np.take_along_axis(between, order, axis=1)
    index, best = start.copy(), ((x - book[start]) ** 2).sum(axis=1)
    reach, rows = 4 * best, np.arange(len(x))
    for k in range(len(book)):
        near = ordered[start[rows], k] <= reach[rows]
        rows = rows[near]
        if not len(rows):
            break
        other = order[start[rows], k]
        d = ((x[rows] - book[other]) ** 2).sum(axis=1)
        closer = (d < best[rows]) | ((d == best[rows]) & (other < index[rows]))
        index[rows[closer]], best[rows[closer]] = other[closer], d[closer]
    return index, best


def cuts(width: int, parts: int) -> list[slice]:
    """Consecutive parts, as equal as can be."""
    ends = np.cumsum([0, *(len(p) for p in np.array_split(np.arange(width), parts))])
    return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]


def encoded(x: np.ndarray, codes: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all vectors, searched from those before, and the sums of their squared distances."""
    found, error = np.empty_like(codes), np.zeros(len(x), np.int64)
    for p, part in enumerate(cuts(x.shape[1], len(books))):
        index, d = nearest(x[:, part], codes[:, p].astype(np.int64), books[p])
        found[:, p], error = index, error + d
    return found, error


def whole_numbers(vectors: DataFrame, scale: int = 4096) -> DataFrame:
    """vec_id, label, x: the vectors without missing or non-finite components, in whole numbers."""
    v = F.col("embedding").cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    x = F.transform(v, lambda c: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), c * scale))).cast("int"))
    return vectors.where(good).select(F.col("vec_id").cast("long"), F.col("label").cast("int"), x.alias("x"))


def _matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _mapped(rows: DataFrame, each: Callable, schema: str, arrow: pa.Schema) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                yield pa.RecordBatch.from_arrays(each(batch.slice(lo, 4096)), schema=arrow)

    return rows.mapInArrow(work, schema)


STATE = "vec_id long, label int, x binary, codes binary"
STATE_ARROW = pa.schema([("vec_id", pa.int64()), ("label", pa.int32()), ("x", pa.binary()), ("codes", pa.binary())])


def _packed(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """The vectors as bytes, beside codes of zeros."""

    def each(batch: pa.RecordBatch) -> list:
        flat = batch.column("x").flatten().to_numpy().astype("<i4").reshape(-1, width)
        return [batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes() for r in flat], pa.binary()), pa.array([bytes(parts)] * batch.num_rows, pa.binary())]

    return _mapped(rows, each, STATE, STATE_ARROW)


def _assigned(state: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    def each(batch: pa.RecordBatch) -> list:
        x, codes = _matrix(batch.column("x"), width, "<i4").astype(np.int64), _matrix(batch.column("codes"), len(books), "u1")
        return [batch.column("vec_id"), batch.column("label"), batch.column("x"), pa.array([r.tobytes() for r in encoded(x, codes, books)[0]], pa.binary())]

    return _mapped(state, each, STATE, STATE_ARROW)


def entry_sums(state: DataFrame, sizes: list[int], width: int) -> list[tuple[int, int, int, list[int]]]:
    """part, entry, count and component sums of what is assigned to each used entry: summed in the tasks, then over them."""
    arrow = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
    parts = cuts(width, len(sizes))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(k, np.int64) for k in sizes]
        sums = [np.zeros((k, p.stop - p.start), np.int64) for k, p in zip(sizes, parts, strict=True)]
        for batch in batches:
            x, codes = _matrix(batch.column("x"), width, "<i4").astype(np.int64), _matrix(batch.column("codes"), len(sizes), "u1")
            for p, part in enumerate(parts):
                n[p] += np.bincount(codes[:, p], minlength=sizes[p])
                np.add.at(sums[p], codes[:, p], x[:, part])
        rows = [(p, e, int(n[p][e]), sums[p][e].tolist()) for p in range(len(sizes)) for e in range(sizes[p]) if n[p][e]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    made = state.mapInArrow(work, "part int, entry int, n long, sums array<long>").select("part", "entry", "n", F.posexplode_outer("sums").alias("place", "s"))
    each = made.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    found = each.groupBy("part", "entry").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "s"))).alias("sums"))
    return [(r.part, r.entry, r.n, [s.s for s in r.sums]) for r in found.collect()]  # at most 16 entries a part


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code, error of every kept vector, and the codebook of each part."""
    spark, out = vectors.sparkSession, "vec_id long, label int, code string, error long"
    rows = whole_numbers(vectors)
    smallest = lambda df: [r.x for r in df.orderBy(F.col("vec_id").asc_nulls_first(), "x").limit(entries).collect()]
    start = smallest(rows)
    if not start:
        return spark.createDataFrame([], out), [np.zeros((0, 0), np.int64)] * parts
    width = len(start[0])
    rows = rows.where(F.size("x") == width)
    if any(len(x) != width for x in start):
        start = smallest(rows)
    start = np.array(start, np.int64).reshape(-1, width)
    books = [start[:, p].copy() for p in cuts(width, parts)]
    held = []
    state = _packed(rows, width, parts)
    for _ in range(rounds):
        state = _assigned(state, books, width).persist(StorageLevel.DISK_ONLY)
        held.append(state)
        for p, e, n, sums in entry_sums(state, [len(b) for b in books], width):
            books[p][e] = [s // n for s in sums]
        if len(held) > 1:
            held.pop(0).unpersist()
    arrow = pa.schema([("vec_id", pa.int64()), ("label", pa.int32()), ("code", pa.string()), ("error", pa.int64())])

    def each(batch: pa.RecordBatch) -> list:
        codes, error = encoded(_matrix(batch.column("x"), width, "<i4").astype(np.int64), _matrix(batch.column("codes"), parts, "u1"), books)
        return [batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes().hex() for r in codes], pa.string()), pa.array(error, pa.int64())]

    made = stored(_mapped(state, each, out, arrow), "codes")
    for df in held:
        df.unpersist()
    return made, books


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def code_digest(vectors: DataFrame) -> DataFrame:
    """The code and error of each kept vector, its label's summed error, and the digest of all codebooks.

    Errors are summed by label in the tasks first; there is one row a label, joined by the optimizer's choice.
    """
    made, books = vector_codes(vectors)
    by_label = made.groupBy("label").agg(F.sum("error").alias("label_error"))
    joined = made.alias("v").join(by_label.alias("l"), F.col("v.label").eqNullSafe(F.col("l.label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def oracle(parts: int = 8, width: int = 64, entries: int = 16, rounds: int = 6) -> str:
    """DuckDB SQL for ``code_digest`` over vectors of one width: each round is a table of codebooks."""
    size = width // parts
    nearest_of = "SELECT vec_id, label, part, x, entry, d FROM (SELECT v.*, entry, list_sum(list_transform(list_zip(v.x, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM pt v JOIN cb{r} b USING (part)) QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1"
    tables = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * 4096)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        f"pt AS MATERIALIZED (SELECT vec_id, label, part, x[part * {size} + 1 : (part + 1) * {size}] AS x FROM kept, (SELECT unnest(range({parts}))::INTEGER AS part))",
        f"cb0 AS (SELECT part, (row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1)::INTEGER AS entry, x AS y FROM pt QUALIFY entry < {entries})",
    ]
    for r in range(rounds):
        tables += [
            f"as{r} AS MATERIALIZED ({nearest_of.format(r=r)})",
            f"sm{r} AS (SELECT part, entry, place, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT part, entry, unnest(x) AS v, unnest(range({size})) AS place FROM as{r}) GROUP BY ALL)",
            f"cb{r + 1} AS MATERIALIZED (SELECT o.part, o.entry, coalesce(m.y, o.y) AS y FROM cb{r} o LEFT JOIN (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS y FROM sm{r} GROUP BY ALL) m USING (part, entry))",
        ]
    tables += [
        f"last AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM ({nearest_of.format(r=rounds)}) GROUP BY ALL)",
        f"dg AS (SELECT sha256(string_agg(v, ',' ORDER BY part, entry)) AS codebooks_sha256 FROM (SELECT part, entry, array_to_string(y, ',') AS v FROM cb{rounds}))",
    ]
    return "WITH " + ",\n".join(tables) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM last, dg"

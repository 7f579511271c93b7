"""Language identification: the family first, then one-versus-one linear support vector machines within it.

A text is the square roots of its relative frequencies of hashed letter trigrams. One machine a family separates it
from the other families; within the chosen family one machine a pair of languages votes, ties go by summed margins. All
machines are fitted by dual coordinate descent on at most ``per_lang`` rows a language and ``max_rows`` in all, of the
``max_langs`` most frequent languages, chosen by a hash of id and text among the rows that may be learnt from; only
their trigram frequencies reach the driver.

Defined results: ``und`` with score 0 for null texts, texts without a letter, and when nothing could be learnt; equal
texts get equal results; null doc_ids are kept and belong to the rows learnt from like the empty id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintage_jobs.llm.common import crc32_of

#: Families by ISO 639-1 code; any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af yi lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "celtic": "ga gd cy br",
    "indic": "hi mr ne bn as gu pa",
    "dravidian": "ta te kn ml",
    "semitic": "ar he mt am",
    "sinitic": "zh yue wuu",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
LETTER = re.compile(r"[^\W\d_]")
BINS = 4096
#: Lower-case letters and the bytes of non-ASCII characters stay, all else is a blank.
FOLD = np.array([b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint32)


def trigrams(text: str, block: int = 1 << 20) -> np.ndarray:
    """Square roots of the relative frequencies of hashed trigrams."""
    data = b" " + text.encode() + b" "
    counts = np.zeros(BINS)
    for at in range(0, len(data) - 2, block):
        own = FOLD[np.frombuffer(data, np.uint8, min(block + 2, len(data) - at), at)]
        codes = (own[:-2] << np.uint32(16)) | (own[1:-1] << np.uint32(8)) | own[2:]
        codes = codes[codes != 0x202020]
        counts += np.bincount((codes * np.uint32(2654435761)) >> np.uint32(20), minlength=BINS)
    return np.sqrt(counts / max(1.0, counts.sum()))


def support_vectors(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 30) -> np.ndarray:
    """A linear machine (last weight: intercept) with squared hinge loss; classes weigh alike."""
    x = np.column_stack((x, np.full(len(x), 0.3)))
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    ridge = share * 2 / (2 * cost)
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    diagonal = (x * x).sum(axis=1) + ridge
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1 + ridge[i] * alpha[i]
            new = max(alpha[i] - gradient / diagonal[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    w[-1] *= 0.3
    return w.astype(np.float32)


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        own = np.array(langs)
        of = np.array([FAMILY_OF.get(c, c) for c in langs])
        self.families = {f: sorted({c for c in self.langs if FAMILY_OF.get(c, c) == f}) for f in sorted(set(of.tolist()))}
        heads = list(self.families) if len(self.families) != 2 else list(self.families)[:1]
        self.heads = [(f, support_vectors(x, np.where(of == f, 1.0, -1.0))) for f in heads] if len(self.families) > 1 else []
        self.pairs = {}
        for codes in self.families.values():
            for a, b in combinations(codes, 2):
                two = (own == a) | (own == b)
                self.pairs[a, b] = support_vectors(x[two], np.where(own[two] == a, 1.0, -1.0))

    @staticmethod
    def margin(w: np.ndarray, x: np.ndarray) -> float:
        return float(x @ w[:-1] + w[-1])

    @staticmethod
    def sure(margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(3 * margin, -40, 40))))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not LETTER.search(text) or not self.langs:
            return "und", 0.0
        x = trigrams(text)
        family, score = next(iter(self.families)), 1.0
        if self.heads:
            margins = {f: self.margin(w, x) for f, w in self.heads}
            if len(self.families) == 2:
                margins[list(self.families)[1]] = -margins[family]
            family = max(margins, key=margins.get)
            score = self.sure(margins[family])
        codes = self.families[family]
        votes, total, against = dict.fromkeys(codes, 0), dict.fromkeys(codes, 0.0), {c: [] for c in codes}
        for a, b in combinations(codes, 2):
            m = self.margin(self.pairs[a, b], x)
            votes[a if m >= 0 else b] += 1
            for c, s in ((a, m), (b, -m)):
                total[c] += s
                against[c].append(s)
        best = max(codes, key=lambda c: (votes[c], total[c]))
        return best, score * min(map(self.sure, against[best]), default=1.0)


def fit(docs: DataFrame, per_lang: int = 400, max_rows: int = 4000, max_langs: int = 200) -> Model:
    """Fits on a bounded sample. Languages are counted first and thinned by a hash to little more than their share, so no
    language's rows meet in one task."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc32_of(F.col("doc_id")) % 4 != 2)).withColumn("key", F.xxhash64("doc_id", "text"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs)
    found = counts.collect()  # at most max_langs rows
    each = max(1, min(per_lang, max_rows // max(1, len(found))))
    parts = 1 << 30
    share = docs.sparkSession.createDataFrame([(r.lang, min(parts, int(parts * (1.5 * each + 50) / max(1, r.n)))) for r in found], "lang string, share long")
    thin = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("key"), F.lit(parts)) < F.col("share")).dropDuplicates(["lang", "key"])
    chosen = thin.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("n") <= each)
    schema = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("x", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            x = pa.array([trigrams(t).astype("<f4").tobytes() if LETTER.search(t) else None for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("key"), x], schema=schema)

    made = chosen.select("lang", "key", "text").mapInArrow(work, "lang string, key long, x binary")
    got = sorted(made.where("x IS NOT NULL").collect(), key=lambda r: (r.lang, r.key))
    x = np.array([np.frombuffer(bytes(r.x), "<f4") for r in got], np.float32).reshape(-1, BINS)
    return Model(x, [r.lang for r in got])


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, lang_pred string, score double")


def language_digest(docs: DataFrame) -> DataFrame:
    return predictions(docs, fit(docs)).select("doc_id", (crc32_of(F.col("doc_id")) % 4 == 2).alias("held_out"), "lang_pred", "score")

"""Document quality from a linear-chain conditional random field over lines.

Every line with words is good or bad. Its features describe the line and its two neighbours: repeated words, symbols,
capitals, digits, punctuation and the like. Only documents carry labels, so lines are labelled in two steps: a logistic
model is fitted with each line under its document's label, then in bad documents the lines it finds bad (at least the
worst) are bad and the others good. The field is fitted to these labels by likelihood. A document's length-weighted
mean of the forward-backward marginals is mapped to a probability by a logistic curve fitted on the same documents.

The fit uses the whole texts of labelled rows, in the order of a hash of doc_id and text, until it has ``max_docs`` rows
or ``max_lines`` lines: this bounds what reaches the driver. In the fit a text of more than ``CHAIN`` lines counts as
several chains; scoring runs exact forward-backward over the whole text. Neither labels nor ids are features.

Defined results: null and empty texts and texts without words score 0; without labels of both classes every other text
scores the share of good labels (0.5 without any); rows are scored one by one, so repeated rows score alike. Labels of
one doc_id that differ count as the greatest; a labelled doc_id with several texts gives each of them that label.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintage_jobs.llm.common import crc32_of, start_bare, stored, within_bound

SYMBOLS = "|&*$#%=<>{}[]~^_\\/@+"
N_LINE = 13
CHAIN = 256  # the most lines of a chain in the fit


def line_features(line: str, words: list[str], seen: set[int]) -> tuple[float, ...]:
    n, chars = len(words), len(line)
    key = hash(line)
    again = key in seen
    seen.add(key)
    return (
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(words)) / n,
        sum(map(line.count, SYMBOLS)) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(line.count, "0123456789")) / chars,
        (line.count(",") + line.count(";")) / n,
        (line.count(".") + line.count("!") + line.count("?")) / n,
        float(line.rstrip()[-1] in ".!?:\"'”»)"),
        float(line.lstrip()[0].isupper()),
        min(chars / n, 40) / 10,
        float(n < 4),
        min(n, 100) / 100,
        float(again),
    )


def line_blocks(text: str | None, block: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features (lines x 3 N_LINE: own, line before, line after) and lengths of the lines with words, some at a time."""
    rows, lengths, seen, before, at = [], [], set(), np.zeros((1, N_LINE)), 0

    def made(n: int) -> tuple[np.ndarray, np.ndarray]:
        own = np.array(rows, np.float64).reshape(-1, N_LINE)
        around = np.concatenate((before, own, np.zeros((1, N_LINE))))
        return np.hstack((own[:n], around[:n], around[2 : n + 2])), np.array(lengths[:n], np.float64)

    text = text or ""
    while at <= len(text):
        end = text.find("\n", at)
        line, at = (text[at:], len(text) + 1) if end < 0 else (text[at:end], end + 1)
        words = line.split()
        if words:
            rows.append(line_features(line, words, seen))
            lengths.append(len(line))
            if len(rows) > block:
                yield made(block)
                before, rows, lengths = np.array([rows[block - 1]]), rows[block:], lengths[block:]
    if rows:
        yield made(len(rows))


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The features and lengths of all lines of a text."""
    parts = list(line_blocks(text))
    if not parts:
        return np.zeros((0, 3 * N_LINE)), np.zeros(0)
    return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 30, around: np.ndarray | None = None) -> np.ndarray:
    """Weights (last: intercept) by Newton's method; the ridge draws them towards ``around`` (zeros by default)."""
    return newton(np.column_stack((x, np.ones(len(x)))), y, weight, ridge, steps, around)


def newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 30, around: np.ndarray | None = None) -> np.ndarray:
    """``logistic`` of rows that end with a one for the intercept; they are not copied."""
    around = np.zeros(x.shape[1]) if around is None else around
    w = around.copy()
    penalty = np.full(len(w), ridge * weight.sum() / len(x))
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + penalty * (w - around)
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def log_add(a, b):
    return np.logaddexp(a, b)


def forward_backward(unary: np.ndarray, mask: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log Z, marginals of state 1 and summed pair marginals, for padded chains (chains x lines; state 0 scores 0)."""
    n, length = unary.shape
    forward, backward = np.zeros((length, n, 2)), np.zeros((length, n, 2))
    emit = np.stack((np.zeros_like(unary), unary), axis=2).transpose(1, 0, 2)
    live = mask.T
    forward[0] = emit[0]
    for t in range(1, length):
        step = np.stack([log_add(forward[t - 1, :, 0] + transition[0, j], forward[t - 1, :, 1] + transition[1, j]) for j in (0, 1)], axis=1) + emit[t]
        forward[t] = np.where(live[t][:, None], step, forward[t - 1])
    for t in range(length - 2, -1, -1):
        ahead = backward[t + 1] + emit[t + 1]
        step = np.stack([log_add(ahead[:, 0] + transition[i, 0], ahead[:, 1] + transition[i, 1]) for i in (0, 1)], axis=1)
        backward[t] = np.where(live[t + 1][:, None], step, 0.0)
    total = log_add(forward[-1, :, 0], forward[-1, :, 1])
    marginal = np.exp(np.minimum(forward[:, :, 1] + backward[:, :, 1] - total, 0)) * live
    pairs = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            score = forward[:-1, :, i] + transition[i, j] + emit[1:, :, j] + backward[1:, :, j] - total
            pairs[i, j] = (np.exp(np.minimum(score, 0)) * live[1:]).sum()
    return total, marginal.T, pairs


def chain_marginals(unary: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Marginals of state 1 of one chain of any length: the messages are log odds, so a step is one number."""
    (a, b), (c, d) = np.exp(transition).tolist()
    scores = np.clip(unary, -300, 300).tolist()
    ahead = [0.0] * len(scores)
    odds = 0.0
    for t in range(len(scores) - 1, 0, -1):
        r = math.exp(min(max(scores[t] + odds, -600.0), 600.0))
        ahead[t - 1] = odds = math.log((c + d * r) / (a + b * r))
    odds, out = scores[0], []
    for t, after in enumerate(ahead):
        if t:
            r = math.exp(min(max(odds, -600.0), 600.0))
            odds = scores[t] + math.log((b + d * r) / (a + c * r))
        out.append(odds + after)
    return 1 / (1 + np.exp(-np.clip(out, -600, 600)))


def with_ones(parts: list[np.ndarray]) -> np.ndarray:
    """The rows of all parts, each with a one at its end, in one table."""
    out = np.ones((sum(map(len, parts)), parts[0].shape[1] + 1))
    np.concatenate(parts, out=out[:, :-1])
    return out


def padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = max(map(len, parts))
    mask = np.zeros((len(parts), length), bool)
    for i, p in enumerate(parts):
        mask[i, : len(p)] = True
    out = np.zeros((*mask.shape, *parts[0].shape[1:]))
    out[mask] = np.concatenate(parts)
    return out, mask


def fit_field(x: list[np.ndarray], y: list[np.ndarray], rounds: int = 120, rate: float = 0.1, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights (last: intercept) and transitions of the field, by gradient ascent with adaptive steps.

    Chains are padded beside those of about their length, as few lines of the longest would pad all others manifold."""
    order = sorted(range(len(x)), key=lambda i: len(x[i]))
    flat, truth = with_ones([x[i] for i in order]), np.concatenate([y[i].astype(float) for i in order])
    lines = len(flat)
    observed, parts, at = np.zeros((2, 2)), [], 0
    for _, own in groupby(order, key=lambda i: len(x[i]).bit_length()):
        labels, mask = padded([y[i].astype(float) for i in own])
        chosen = labels > 0.5
        observed += np.array([[((~chosen if not i else chosen)[:, :-1] & (~chosen if not j else chosen)[:, 1:] & mask[:, 1:]).sum() for j in (0, 1)] for i in (0, 1)], float)
        parts.append((slice(at, at := at + int(mask.sum())), mask))
    seen = flat.T @ truth
    transition = np.zeros((2, 2))
    w = newton(flat, truth, np.ones(lines))
    theta = np.concatenate((w, transition.ravel()))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, transition = theta[:-4], theta[-4:].reshape(2, 2)
        scored, marginal, pairs = flat @ w, np.empty(lines), np.zeros((2, 2))
        for own, mask in parts:
            unary = np.zeros(mask.shape)
            unary[mask] = scored[own]
            _, at_lines, met = forward_backward(unary, mask, transition)
            marginal[own] = at_lines[mask]
            pairs += met
        gradient = np.concatenate((seen - flat.T @ marginal, (observed - pairs).ravel())) / lines - ridge * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


class Model:
    """The fitted field and the curve from a document's mean marginal to its score."""

    def __init__(self, prior: float = 0.5):
        self.prior, self.weights = prior, None

    def line_scores(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]

    def mean_marginal(self, unary: np.ndarray, lengths: np.ndarray) -> float:
        """Length-weighted mean of the marginals of a text's lines, from the scores of its lines."""
        return float(chain_marginals(unary, self.transition) @ lengths) / float(lengths.sum())

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
        docs = [d for d in docs if len(d[0])]
        labels = np.array([d[2] for d in docs], float)
        self.prior = float(labels.mean()) if len(docs) else 0.5
        if len(set(labels.tolist())) < 2:
            return self
        # one table of all lines beside the given arrays, scaled where it stands: the driver holds it
        flat = with_ones([d[0] for d in docs])
        x = flat[:, :-1]
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x -= self.mean
        x /= self.scale
        each = np.concatenate([np.full(len(d[0]), label) for d, label in zip(docs, labels, strict=True)])
        size = np.concatenate([np.full(len(d[0]), 1 / len(d[0])) for d in docs])
        rough = newton(flat, each, size)
        scaled = np.split(x, np.cumsum([len(d[0]) for d in docs])[:-1])
        lines = []
        for s, label in zip(scaled, labels, strict=True):
            good = s @ rough[:-1] + rough[-1]
            lines.append(np.ones(len(s)) if label else (good > max(0.0, good.min())).astype(float))
        cut = lambda parts: [p[at : at + CHAIN] for p in parts for at in range(0, len(p), CHAIN)]
        self.weights, self.transition = fit_field(cut(scaled), cut(lines))
        means = np.array([self.mean_marginal(self.line_scores(d[0]), d[1]) for d in docs])
        self.curve = logistic(means[:, None], labels, np.ones(len(docs)), ridge=1e-4)
        return self

    def score(self, text: str | None) -> float:
        parts = [(x if self.weights is None else self.line_scores(x), n) for x, n in line_blocks(text)]
        if not parts:
            return 0.0
        if self.weights is None:
            return self.prior
        mean = self.mean_marginal(np.concatenate([u for u, _ in parts]), np.concatenate([n for _, n in parts]))
        return float(sigmoid(self.curve[0] * mean + self.curve[1]))


def learn_by_default(doc_id: str = "doc_id") -> Column:
    return crc32_of(F.col(doc_id)) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 4000, max_lines: int = 100_000) -> Model:
    """Fits on a bounded sample of labelled rows: at most max_docs whole texts of together at most max_lines lines.

    A text of over a tenth of these lines is left out of the fit, and takes no other one with it.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & learn_by_default()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL")
    rank = (F.xxhash64("doc_id"), F.col("doc_id"), F.col("key"))
    sized = own.select("doc_id", "quality", F.xxhash64("text").alias("key"), (F.char_length("text") - F.char_length(F.translate("text", "\n", "")) + 1).alias("lines"), "text")
    # a doc_id may have any number of texts, so the rows are ranked before their bound holds
    first = sized.select("doc_id", "key", "lines").distinct().orderBy(*rank).limit(max_docs)
    within = within_bound((((r.doc_id, r.key), r.lines) for r in first.collect()), max_lines)  # at most max_docs rows
    within = docs.sparkSession.createDataFrame(within, "doc_id long, key long")
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("quality", pa.int32()), ("x", pa.binary()), ("lengths", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [document_features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "key", "quality")), pa.array([x.astype("<f4").tobytes() for x, _ in made], pa.binary()), pa.array([n.astype("<f4").tobytes() for _, n in made], pa.binary())], schema=schema)

    texts = stored(sized.join(F.broadcast(within), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("doc_id", "key", "quality", "text"), "labelled")
    rows = texts.mapInArrow(work, "doc_id long, key long, quality int, x binary, lengths binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.key))
    unpack = lambda b: np.frombuffer(b, "<f4")  # noqa: E731  not copied
    return Model().fit([(unpack(r.x).reshape(-1, 3 * N_LINE), unpack(r.lengths).astype(np.float64), r.quality) for r in rows])


def scores(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """The rows of ``docs`` with their score in a column ``name``."""

    def rated(s):
        start_bare()
        return s.map(model.score).astype("float64")

    rate = F.pandas_udf(rated, "double")
    return docs.withColumn(name, rate(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rated = scores(docs.select(F.col("doc_id").cast("long"), "text"), fit(docs, labels))
    return rated.select("doc_id", (crc32_of(F.col("doc_id")) % 3 == 1).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts."""
    return scores(docs, fit(docs, labels), "__score").where("__score >= 0.5").select(docs.columns)

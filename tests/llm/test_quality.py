import tracemalloc
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintage_jobs.llm import quality as Q
from vintage_jobs.llm.common import within_bound


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(0)
    unary, transition = rng.normal(size=(3, 5)), rng.normal(size=(2, 2))
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], bool)
    total, marginal, pairs = Q.forward_backward(unary, mask, transition)
    seen = np.zeros((2, 2))
    for i, n in enumerate(mask.sum(axis=1)):
        paths = list(product((0, 1), repeat=int(n)))
        scores = np.array([sum(unary[i, t] for t in range(n) if p[t]) + sum(transition[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths])
        assert total[i] == pytest.approx(np.log(np.exp(scores).sum()))
        share = np.exp(scores - total[i])
        assert marginal[i, :n] == pytest.approx(sum(s * np.array(p) for s, p in zip(share, paths, strict=True)))
        for s, p in zip(share, paths, strict=True):
            for a, b in zip(p, p[1:], strict=False):
                seen[a, b] += s
    assert pairs == pytest.approx(seen)


def test_held_out_accuracy_and_labels_unseen(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.quality_digest(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    flipped = labels.withColumn("quality", F.when(Q.learn_by_default(), F.col("quality")).otherwise(1 - F.col("quality")))
    same = {r.doc_id: r.score for r in Q.quality_digest(docs, flipped).where("held_out").collect()}
    assert same == {r.doc_id: r.score for r in Q.quality_digest(docs, labels).where("held_out").collect()}


GOOD, BAD = "It is a plain sentence about the weather today.", "a | b | c | d | e | f"


def small_model():
    return Q.Model().fit([(*Q.document_features("\n".join([line] * 5)), q) for line, q in ((GOOD, 1), (BAD, 0)) for _ in range(20)])


def test_long_documents_are_scored_whole():
    model = small_model()
    text = "\n".join([GOOD, BAD, GOOD] * 3000)
    small, whole = (np.concatenate([x for x, _ in Q.line_blocks(text, block)]) for block in (7, 1 << 20))
    assert (small == whole).all() and len(whole) == 9000
    unary = model.line_scores(whole)
    _, marginal, _ = Q.forward_backward(unary[None], np.ones((1, len(unary)), bool), model.transition)
    assert Q.chain_marginals(unary, model.transition) == pytest.approx(marginal[0], abs=1e-7)
    assert Q.chain_marginals(np.array([1e4, -1e4, 1e4]), model.transition) == pytest.approx([1, 0, 1])
    assert model.score(GOOD) > 0.5 > model.score(BAD)
    # what comes after any number of lines counts
    assert model.score("\n".join([GOOD] * 300 + [BAD] * 3000)) < model.score("\n".join([GOOD] * 300))


def slow_features(line, lines_before):
    words = line.split()
    n = len(words)
    count = lambda chars, s: sum(c in chars for c in s)
    return [
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, 1 - len(set(words)) / n, count("|&*$#%=<>{}[]~^_\\/@+", line) / n, sum(w.isupper() for w in words) / n,
        count("0123456789", line) / len(line), count(",;", line) / n, count(".!?", line) / n, float(line.strip()[-1] in ".!?:\"'”»)"), float(line.strip()[0].isupper()),
        min(len(line) / n, 40) / 10, float(n < 4), min(n, 100) / 100, float(line in lines_before),
    ]


def slow_score(model, text):
    """By listing all labellings of the lines."""
    lines = [line for line in (text or "").split("\n") if line.split()]
    if not lines:
        return 0.0
    own = [slow_features(line, lines[:i]) for i, line in enumerate(lines)]
    zero = [0.0] * len(own[0])
    x = np.array([own[i] + (own[i - 1] if i else zero) + (own[i + 1] if i + 1 < len(own) else zero) for i in range(len(own))])
    unary = ((x - model.mean) / model.scale) @ model.weights[:-1] + model.weights[-1]
    good, total = np.zeros(len(lines)), 0.0
    for path in product((0, 1), repeat=len(lines)):
        weight = np.exp(sum(u for u, s in zip(unary, path, strict=True) if s) + sum(model.transition[a, b] for a, b in zip(path, path[1:], strict=False)))
        good, total = good + weight * np.array(path), total + weight
    sizes = np.array([len(line) for line in lines])
    mean = (good / total) @ sizes / sizes.sum()
    return 1 / (1 + np.exp(-(model.curve[0] * mean + model.curve[1])))


def test_query_against_all_labellings(spark, small_dir):
    docs, labels = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    short = {d: t for d, t in texts.items() if sum(bool(line.split()) for line in (t or "").split("\n")) <= 10}
    assert len(short) > 50
    got = {r.doc_id: r for r in Q.quality_digest(docs, labels).collect()}
    assert set(got) == set(texts)
    for d, t in short.items():
        assert got[d].score == pytest.approx(slow_score(model, t), abs=1e-9) and got[d].predicted == (got[d].score >= 0.5)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())


def test_field_is_a_maximum_of_the_likelihood():
    rng = np.random.default_rng(1)
    x = [rng.normal(size=(n, 3)) for n in rng.integers(1, 9, 60)]
    y = [(v[:, 0] + rng.normal(size=len(v)) > 0).astype(float) for v in x]
    w, transition = Q.fit_field(x, y, rounds=600)

    def value(w, transition):
        out = 0.0
        for v, own in zip(x, y, strict=True):
            unary = v @ w[:-1] + w[-1]
            paths = list(product((0, 1), repeat=len(v)))
            scores = [sum(u for u, s in zip(unary, p, strict=True) if s) + sum(transition[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths]
            out += scores[paths.index(tuple(own.astype(int)))] - np.log(np.exp(scores).sum())
        return out / sum(map(len, x)) - 0.5e-3 * ((w**2).sum() + (transition**2).sum())

    best = value(w, transition)
    for _ in range(30):
        assert value(w + rng.normal(0, 0.05, len(w)), transition + rng.normal(0, 0.05, (2, 2))) < best


def test_sample_is_bounded_however_often_a_document_is_repeated(spark, monkeypatch):
    docs = spark.range(300).select((F.col("id") % 6).alias("doc_id"), F.concat(F.lit(GOOD + "\n"), F.col("id").cast("string"), F.lit(" words")).alias("text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(Q.Model, "fit", lambda self, rows: seen.append(rows) or self)
    Q.fit(docs, labels, max_docs=20)
    Q.fit(docs, labels, max_docs=200, max_lines=30)
    assert [len(r) for r in seen] == [20, 15]
    assert sum(len(x) for x, _, _ in seen[1]) <= 30


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (None, "Some words are here."), (1, None), (2, " \n "), (3, "x" * 200_000)], "doc_id long, text string").withColumn("quality_score", F.lit("clash")).withColumn("quality", F.lit(1))
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 1)], "doc_id long, quality int")
    for own in (labels, labels.limit(0)):
        got = {r.doc_id: r.score for r in Q.quality_digest(docs, own).collect()}
        assert got[1] == got[2] == 0.0 and 0 <= got[None] <= 1 and Q.quality_digest(docs, own).count() == 5
    assert Q.accepted(docs, labels).columns == docs.columns and Q.quality_digest(docs.limit(0), labels).count() == 0


def test_a_long_text_leaves_the_others_in_the_fit(spark):
    rows = [(i, "A good line of words.\nAnother one, with an end." if i % 2 else "buy now!!! $$$\nCLICK") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(70)], "doc_id long, quality int")
    long = [(60 + i, "line\n" * 3000) for i in range(10)]
    both = [Q.fit(spark.createDataFrame(r, "doc_id long, text string"), labels, max_lines=2000) for r in (rows, rows + long)]
    assert both[1].weights is not None and np.allclose(both[0].weights, both[1].weights)
    assert both[1].score(rows[1][1]) > 0.5 > both[1].score(rows[0][1])


def test_what_stays_within_a_bound():
    assert within_bound([("a", 50), ("b", 3), ("c", 200), ("d", 4)], 100) == ["b", "d"]
    assert within_bound([("a", 90), ("b", 60), ("c", 20)], 100) == ["c", "b"]
    assert within_bound([(i, 10) for i in range(20)], 100) == list(range(10)) and within_bound([], 5) == []


def test_fit_holds_few_copies_of_its_lines():
    """The driver holds the fit: one long text does not pad all others to its length, and lines are copied only a few times."""
    rng = np.random.default_rng(3)
    docs = [(rng.random((n, 3 * Q.N_LINE), np.float32), np.full(n, 20.0), i % 2) for i, n in enumerate([200, *[3] * 3000])]
    tracemalloc.start()
    Q.Model().fit(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * sum(x.size for x, _, _ in docs) * 8


def test_field_does_not_depend_on_the_order_of_its_chains():
    rng = np.random.default_rng(4)
    x = [rng.random((n, 4)) for n in (1, 9, 2, 30, 1, 5, 64, 3)]
    y = [(rng.random(len(v)) < 0.5).astype(float) for v in x]
    a, b = Q.fit_field(x, y, rounds=30), Q.fit_field(x[::-1], y[::-1], rounds=30)
    assert np.allclose(a[0], b[0]) and np.allclose(a[1], b[1])

import re

from pyspark.sql import functions as F

import corpus_pipeline as C
from tests.llm.test_packing import check_packing
from tests.llm.test_similar import slow_components, slow_shingles
from vintage_jobs.llm import decontam, pii, quality
from vintage_jobs.llm.common import stored


def words(text):
    return re.findall(decontam.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_stages_against_brute_force(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{small_dir}/labels.parquet"))
    rows = {d: r for d, r in rows.items() if model.score(r.text) >= 0.5}
    got = []
    for name, stage in C.STAGES:
        docs = stored(stage(spark, docs, small_dir), name)
        got.append(docs)
    assert {r.doc_id for r in got[0].collect()} == set(rows)

    ids = sorted(rows)
    of = slow_components(ids, [slow_shingles(rows[d].text) for d in ids])
    rows = {d: rows[d] for d in ids if d == of[d]}
    assert {r.doc_id for r in got[1].collect()} == set(rows)

    grams = set()
    for item in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect():
        w = words(item.text)
        k = min(10, len(w))
        grams |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    sizes = {len(g) for g in grams}
    rows = {d: r for d, r in rows.items() if not any(tuple(w[i : i + k]) in grams for w in [words(r.text)] for k in sizes for i in range(len(w) - k + 1))}
    assert {r.doc_id for r in got[2].collect()} == set(rows)

    clean = {r.doc_id: r for r in got[3].collect()}
    assert got[3].columns == spark.read.parquet(f"{small_dir}/documents.parquet").columns
    assert set(clean) == set(rows) and all(clean[d].text == pii.redact(r.text) and clean[d].n_chars == len(clean[d].text) for d, r in rows.items())

    _, by_doc = check_packing(got[4].collect())
    assert {d for d, _ in by_doc} == set(rows)


def test_run_is_the_stages(spark, small_dir):
    assert C.run(spark, small_dir).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_stages_on_edge_rows(spark, small_dir):
    documents = spark.read.parquet(f"{small_dir}/documents.parquet")
    good = " ".join(f"word{i}" for i in range(40)) + "."
    rows = [(1, None), (2, ""), (3, good), (3, good), (None, good + " more of a@b.example here"), (None, None), (4, "x " * 30_000)]
    docs = spark.createDataFrame([(d, t, None, None, 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").select(*(F.col(c).cast(documents.schema[c].dataType) for c in documents.columns)).withColumn("row_key", F.lit(1))
    for name, stage in C.STAGES[1:]:
        docs = stored(stage(spark, docs, small_dir), f"edge-{name}")
        if name == "simhash":
            assert sorted((r.doc_id, r.text) for r in docs.collect()) == [(1, None), (3, good), (4, "x " * 30_000)]
        if name != "packing":
            assert docs.columns == [*documents.columns, "row_key"]
    assert {r.doc_id for r in docs.collect()} == {1, 3, 4}


def test_quality_stage_on_edge_rows(spark, small_dir):
    """Null and empty texts go, repeated rows score alike and stay or go together, further columns stay."""
    documents = spark.read.parquet(f"{small_dir}/documents.parquet")
    text = {r.doc_id: r.text for r in documents.collect()}
    kept = {r.doc_id for r in C.STAGES[0][1](spark, documents, small_dir).collect()}
    good, bad = min(d for d in kept if text[d]), min(d for d in text if d not in kept)
    more = [(None, text[good]), (None, None), (10**6, None), (10**6, ""), (good, text[good]), (bad, text[bad]), (10**6 + 1, text[good] * 400)]
    rows = spark.createDataFrame([(d, t, None, None, 0) for d, t in more], "doc_id long, text string, lang string, source string, n_chars long").select(*(F.col(c).cast(documents.schema[c].dataType) for c in documents.columns))
    docs = documents.unionByName(rows).withColumn("__score", F.lit("clash")).withColumn("quality", F.lit(1))
    got = C.STAGES[0][1](spark, docs, small_dir)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert ids.count(good) == 2 and bad not in ids and 10**6 not in ids and ids.count(None) == 1
    assert {d for d in ids if d in text} == kept


def test_stages_on_empty_tables(spark, small_dir):
    documents = spark.read.parquet(f"{small_dir}/documents.parquet")
    assert C.STAGES[0][1](spark, documents.limit(0), small_dir).count() == 0

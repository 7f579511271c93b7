"""Keyword searches against plain substring tests."""

import random

import pytest

from vintage_jobs.operators import catalog as C

LINES = ["the quick brown fox", "Quick silver", "", "a", "ab", "naïve 日本語 text", "x" * 300 + "needle in a long line", "emoji 😀 here", "tab\tand  two blanks", "quick", "the the the", None]
NEEDLES = ["", "q", "Quick", "quick brown", "日本", "needle in a", "😀", "ab", "zz", "the quick brown fox jumps", "x" * 9, "e", "\t", "blanks", None, "İ"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("small_side", [0, 10_000])
@pytest.mark.parametrize("match_case", [True, False])
def test_lines_against_substrings(spark, small_side, match_case):
    rng = random.Random(2)
    lines = LINES + ["".join(rng.choice("abAB 😀😁") for _ in range(rng.randrange(30))) for _ in range(80)]
    needles = NEEDLES + ["".join(rng.choice("abAB 😀😁") for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    rows = [(f"f{i % 3}", i, line) for i, line in enumerate(lines)] * 2
    made = C.line_matches(spark.createDataFrame(rows, "file string, line_no int, line string"), spark.createDataFrame([(n, f"why {i}") for i, n in enumerate(needles)], "needle string, why string"), match_case, small_side)
    assert "NestedLoop" not in plan_of(made) and "Cartesian" not in plan_of(made)
    fold = (lambda s: s) if match_case else str.lower
    want = {}
    for file, no, line in rows:
        why = [f"why {i}" for i, n in enumerate(needles) if n is not None and line is not None and fold(n) in fold(line)]
        if why:
            want[file, no, line] = min(why)
    got = made.collect()
    assert {(r.file, r.line_no, r.line): r.why for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("direct", [0, 3])
@pytest.mark.parametrize("match_case", [True, False])
def test_lines_tried_directly_and_by_index(spark, direct, match_case):
    rng = random.Random(4)
    lines = LINES + ["".join(rng.choice("abcdAB ") for _ in range(rng.randrange(12))) for _ in range(60)]
    needles = [n for n in NEEDLES if n] + ["".join(rng.choice("abcdAB") for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    reason = [f"why {rng.randrange(20)}" for _ in needles]
    needed = spark.createDataFrame(list(zip(needles, reason, strict=True)), "needle string, why string")
    made = C.line_matches(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string"), needed, match_case, direct=direct)
    fold = (lambda s: s) if match_case else str.lower
    want = {i: min(why) for i, x in enumerate(lines) if x is not None and (why := [w for n, w in zip(needles, reason, strict=True) if fold(n) in fold(x)])}
    got = made.collect()
    assert {r.line_no: r.why for r in got} == want and len(got) == len(want)


def test_needles_that_cannot_give_a_first_reason_are_not_searched(spark):
    rows = [("a", "w2"), ("bad", "w3"), ("ab", "w1"), ("cab", "w1"), ("A", "w2"), ("zz", None), ("zzz", "w9")]
    needles = spark.createDataFrame(rows, "needle string, why string")
    assert {r.needle for r in C.least_needles(needles).collect()} == {"a", "ab", "A", "zz", "zzz"}
    assert {r.needle for r in C.least_needles(needles, match_case=False).collect()} == {"A", "ab", "zz", "zzz"}


def test_rows_of_a_catalogue_are_dealt_before_they_are_multiplied(spark):
    files = spark.range(4_000).selectExpr("concat('f', id) AS file", "concat('x', id) AS folder", "concat_ws(';', 'alpha', 'beta', 'gamma', 'alphabet') AS header", "';' AS sep")
    words = spark.createDataFrame([(w,) for w in ("a", "al", "be", "bet", "ta", "alphabet")], "keyword string")
    made = C.header_matches(files.coalesce(1), words, rows_a_task=100)
    assert made.rdd.getNumPartitions() == 40 and made.count() == 24_000
    assert {(r.keyword, r.column_name) for r in made.select("keyword", "column_name").distinct().collect()} == {("a", "alpha"), ("al", "alpha"), ("be", "beta"), ("bet", "beta"), ("ta", "beta"), ("alphabet", "alphabet")}


def test_grams_of_wide_characters_and_long_texts(spark):
    texts = {"wide": "a😀b", "short": "a", "long": "ab" * 50_000, "lines": "a\nb"}
    got = {r.name: set(r.g) for r in spark.createDataFrame(list(texts.items()), "name string, text string").select("name", C.grams(C.F.col("text"), [2, 1]).alias("g")).collect()}
    for name, text in texts.items():
        assert got[name] >= {text[i : i + n] for n in (1, 2) for i in range(len(text) - n + 1)}
    assert got["short"] == {"a"} and got["long"] == {"a", "b", "ab", "ba"}


def test_no_needles_or_lines(spark):
    lines = spark.createDataFrame([("f", 1, "a")], "file string, line_no int, line string")
    needles = spark.createDataFrame([("a", "w")], "needle string, why string")
    assert C.line_matches(lines, needles.limit(0)).count() == 0 and C.line_matches(lines.limit(0), needles).count() == 0


@pytest.mark.parametrize("small_side", [0, 10_000])
def test_headers_by_their_distinct_cells(spark, small_side):
    files = [("a.csv", "x", "Date; Order Value;value"), ("b.csv", "x", "date;VALUE added"), ("c.csv", "y", ""), ("d.csv", "y", "Name;name of order")]
    words = ["value", "ORDER", "date", "missing", "e"]
    made = C.header_matches(spark.createDataFrame([(*f, ";") for f in files], "file string, folder string, header string, sep string"), spark.createDataFrame([(w,) for w in words], "keyword string"), small_side=small_side)
    assert "NestedLoop" not in plan_of(made) and "Cartesian" not in plan_of(made)
    want = {}
    for file, folder, header in files:
        for w in words:
            hits = [c.strip() for c in header.split(";") if w.lower() in c.strip().lower()]
            if hits:
                want[file, folder, w] = hits[0]
    assert {(r.file, r.folder, r.keyword): r.column_name for r in made.collect()} == want


def test_words_and_lines_of_texts(spark):
    from pyspark.sql import functions as F

    texts = spark.createDataFrame([(1, "one two\nthree  one"), (2, None), (3, "")], "id int, text string")
    assert sorted(tuple(r) for r in C.text_words(texts, F.col("id")).collect()) == sorted((n, 1) for n in ("one two", "three  one", "one", "two", "three"))

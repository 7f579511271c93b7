"""Benchmark decontamination with a distributed positional inverted index. DataFrame functions only.

The index holds a posting (document, term, position) for every training word that some test item uses, and one posting
of the empty term at the end of each document, whose position is the document's length. It is written to the shared
folder once; everything else reads it. For each window of a test item the rarest term is looked up by its corpus
frequency; its postings, shifted by its place in the item, are the candidate alignments (document, item, diagonal).
A posting also holds a byte of the hash of the words beside it, so most chance alignments fall before the intersection.
The lists of the item's other terms, shifted likewise, are intersected with them in one join on (document, position,
term), and runs of consecutive matches as long as a window are exact phrase matches.

Work is keyed by document and position, so neither a common term, nor a passage in a third of all documents, nor a long
document gathers in one task. Test-side tables are broadcast up to ``small_side`` rows; beyond, they are joined by
shuffle, and the rows of a word or item with more than half a task's share of them are counted and dealt over as many
tasks as they fill, each with a copy of its test rows. Ends of documents meet no lexicon.

Defined results: null texts have no words; items without words are ignored; a null item_id is written as the empty
text; repeated items count once; repeated document rows each get their row.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintage_jobs.llm.common import stored, widest

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
END = 0  # the term of the posting that closes a document


def words(text: str) -> Column:
    lowered = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


#: What tells documents apart: the id (-1 for null) and a hash of id and text.
KEY = ["id", "doc"]


def row_key(docs: DataFrame) -> list[Column]:
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(-1)).alias("id"), F.xxhash64(docs["doc_id"].cast("long"), docs["text"]).alias("doc")]


def item_terms(items: DataFrame) -> DataFrame:
    """item, item_id, place, term, n of each word of the distinct items; terms are checked to be free of collisions."""
    own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words("text").alias("w")).where(F.size("w") > 0).distinct()
    out = stored(own.select(F.xxhash64("item_id", "w").alias("item"), "item_id", F.size("w").alias("n"), F.posexplode("w").alias("place", "word")).withColumn("term", F.xxhash64("word")), "items")
    clash = out.groupBy("term").agg(F.count_distinct("word").alias("words")).where("words > 1 OR term = 0")
    if not clash.isEmpty():
        raise ValueError("two test words share a term number")
    return out


def is_small(df: DataFrame, small_side: int) -> bool:
    return df.limit(small_side + 1).count() <= small_side


def looked_up(rows: DataFrame, side: DataFrame, on: str, apart: list[str], small_side: int) -> DataFrame:
    """``rows`` joined with a test-side table: broadcast where its counted rows are within the bound.

    Beyond it by shuffle: the rows of frequent keys are dealt over several tasks by a hash of ``apart``. They are fewer than
    two a task, so their table is broadcast.
    """
    if is_small(side, small_side):
        return rows.join(F.broadcast(side), on)
    counts = stored(rows.groupBy(on).agg(F.count("*").alias("n")), "counts")
    share = ways_share(counts.agg(F.sum("n")).first()[0] or 0, widest(rows.sparkSession))
    hot = counts.where(F.col("n") > share).select(on, F.ceil(F.col("n") / share).cast("int").alias("__ways"))
    ways = F.coalesce("__ways", F.lit(1))
    left = rows.join(F.broadcast(hot), on, "left").withColumn("__way", F.pmod(F.xxhash64(*apart), ways).cast("int")).drop("__ways")
    right = side.join(F.broadcast(hot), on, "left").withColumn("__way", F.explode(F.sequence(F.lit(0), ways - 1))).drop("__ways")
    return left.join(right.hint("merge"), [on, "__way"]).drop("__way")


def ways_share(rows: int, tasks: int) -> int:
    """How many rows of one key stay together: half a task's share."""
    return max(64, rows // (2 * tasks))


def low_byte(term: Column) -> Column:
    return term.bitwiseAND(F.lit(255)).cast("smallint")


def build_index(docs: DataFrame, terms: DataFrame, small_side: int = 200_000) -> DataFrame:
    """id, doc, term, position, before, after of the words among ``terms`` (word, term), and the END posting with its doc_id."""
    lexicon = stored(terms.select("word", "term").distinct(), "lexicon")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(docs), words("text").alias("w"))
    beside = [low_byte(F.xxhash64(F.get("w", F.col("position") + d))).alias(name) for d, name in ((-1, "before"), (1, "after"))]
    each = lambda w: read.withColumn("w", w).select("doc_id", *KEY, "w", F.posexplode("w").alias("position", "word")).select("doc_id", *KEY, "position", "word", *beside)
    if is_small(lexicon, small_side):
        # one pass: the end of a document is one more word, the empty one
        end = docs.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(END).cast("long").alias("term"))
        postings = each(F.concat("w", F.array(F.lit("")))).join(F.broadcast(lexicon.unionByName(end)), "word")
    else:
        none = F.lit(None).cast("smallint")
        ends = read.select("doc_id", *KEY, F.size("w").alias("position"), none.alias("before"), none.alias("after"), F.lit(END).cast("long").alias("term"))
        postings = looked_up(each(F.col("w")), lexicon, "word", [*KEY, "position"], small_side).drop("word").unionByName(ends)
    return stored(postings.select(*KEY, "term", "position", "before", "after", F.when(F.col("term") == END, F.col("doc_id")).alias("doc_id")), "postings")


def rarest_terms(index: DataFrame, terms: DataFrame, window: int) -> DataFrame:
    """item, place, term, before, after: for every window of every item, its rarest term, unless one never occurs.

    ``before`` and ``after`` are the bytes of the words beside it, where those are in the window too.
    """
    counts = index.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("df"))
    line = Window.partitionBy("item").orderBy("place")
    own = terms.join(counts, "term", "left").withColumns({"df": F.coalesce("df", F.lit(0)), "before": low_byte(F.lag("term").over(line)), "after": low_byte(F.lead("term").over(line))})
    best = F.min(F.struct("df", "place", "term", "before", "after")).over(line.rowsBetween(0, window - 1))
    rows = own.withColumn("best", best).where((F.col("place") <= F.greatest(F.lit(0), F.col("n") - window)) & (F.col("best.df") > 0))
    last = F.col("place") + F.least(F.lit(window), F.col("n")) - 1
    before, after = F.when(F.col("best.place") > F.col("place"), F.col("best.before")), F.when(F.col("best.place") < last, F.col("best.after"))
    return rows.select("item", "best.place", "best.term", before.alias("before"), after.alias("after")).distinct()


def phrase_matches(index: DataFrame, terms: DataFrame, window: int = 10, small_side: int = 200_000) -> DataFrame:
    """id, doc, item, item_id, start, end: maximal runs of at least a window of an item in a document (end exclusive).

    An item shorter than the window is one window.
    """
    anchors = stored(rarest_terms(index, terms, window).withColumnsRenamed({"before": "wants_before", "after": "wants_after"}), "anchors")
    fits = [F.col(f"wants_{c}").isNull() | (F.col(f"wants_{c}") == F.col(c)) for c in ("before", "after")]
    met = looked_up(index.drop("doc_id"), anchors, "term", [*KEY, "position"], small_side).where(fits[0] & fits[1])
    seeds = stored(met.select(*KEY, "item", (F.col("position") - F.col("place")).alias("diagonal")).distinct(), "alignments")
    probes = looked_up(seeds, terms.select("item", "place", "term"), "item", [*KEY, "diagonal"], small_side).withColumn("position", F.col("diagonal") + F.col("place")).where("position >= 0")
    hits = probes.join(index.select(*KEY, "position", "term"), [*KEY, "position", "term"]).select(*KEY, "item", "diagonal", "place").distinct()
    line = Window.partitionBy(*KEY, "item", "diagonal").orderBy("place")
    runs = hits.withColumn("run", F.col("place") - F.row_number().over(line)).groupBy(*KEY, "item", "diagonal", "run").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    lengths = terms.select("item", "item_id", "n").distinct()
    long_enough = (F.col("last") - F.col("first") + 1) >= F.least(F.lit(window), F.col("n"))
    return looked_up(runs, lengths, "item", [*KEY, "diagonal"], small_side).where(long_enough).select(*KEY, "item", "item_id", (F.col("diagonal") + F.col("first")).alias("start"), (F.col("diagonal") + F.col("last") + 1).alias("end"))


def proximity_matches(index: DataFrame, terms: DataFrame, span: int | None = None, share: float = 0.8, small_side: int = 200_000) -> DataFrame:
    """id, doc, item_id, position, found, wanted: places of an item's anchor terms with ``share`` of its terms within ``span`` words.

    ``span`` is the item's length in words by default. As many terms may be missing as ``share`` allows, those that never
    occur first; the anchors are the rarest terms that do occur, one more than may still be missing, so every match has one.
    """
    counts = index.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("df"))
    reach = F.col("n") if span is None else F.lit(span)
    lengths = terms.groupBy("item").agg(F.count_distinct("term").alias("wanted"), F.first("item_id").alias("item_id"), F.first("n").alias("n"))
    wanted = lengths.withColumn("least", F.ceil(F.col("wanted") * share).cast("int")).withColumn("reach", reach.cast("int"))
    ranked = terms.select("item", "term").distinct().join(counts, "term", "left").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("df", F.lit(0)), "term")))
    anchors = ranked.join(wanted, "item").where(F.col("df").isNotNull() & (F.col("rank") <= F.col("wanted") - F.col("least") + 1))
    anchors = stored(anchors.select("item", "term", "reach"), "anchors")
    cell = F.floor(F.col("position") / F.col("reach")).cast("int")
    near = F.explode(F.array(*(cell + d for d in (-1, 0, 1)))).alias("cell")
    seeds = looked_up(index.drop("doc_id"), anchors, "term", [*KEY, "position"], small_side).select(*KEY, "item", "reach", "position")
    seeds = stored(seeds.distinct(), "seeds")
    # a document's list of each term is looked up for the items it has seeds of, and for their own terms only
    own = looked_up(seeds.select(*KEY, "item", "reach").distinct(), terms.select("item", "term").distinct(), "item", KEY, small_side)
    lists = own.join(index.where(F.col("term") != END).select(*KEY, "term", "position"), [*KEY, "term"]).withColumn("cell", cell)
    close = seeds.select(*KEY, "item", F.col("position").alias("at"), near).join(lists, [*KEY, "item", "cell"]).where(F.abs(F.col("position") - F.col("at")) <= F.col("reach"))
    found = close.groupBy(*KEY, "item", "at").agg(F.count_distinct("term").alias("found"))
    return looked_up(found, wanted, "item", [*KEY, "at"], small_side).where(F.col("found") >= F.col("least")).select(*KEY, "item_id", F.col("at").alias("position"), "found", "wanted")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, small_side: int = 200_000) -> DataFrame:
    """id, doc (row key), doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row."""
    terms = item_terms(items)
    index = build_index(docs, terms, small_side)
    runs = stored(phrase_matches(index, terms, window, small_side), "runs")
    covered = runs.select(*KEY, F.explode(F.sequence("start", F.col("end") - 1)).alias("position")).distinct().groupBy(*KEY).agg(F.count("*").alias("n_hit"))
    named = runs.select(*KEY, "item_id").distinct().groupBy(*KEY).agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    ends = index.where(F.col("term") == END).select(*KEY, "doc_id", F.col("position").cast("long").alias("n_words"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return ends.join(covered, KEY, "left").join(named, KEY, "left").select(*KEY, "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs."""
    bad = contamination(docs, items, window).where("contaminated").select(F.col("id").alias("__bad_id"), F.col("doc").alias("__bad")).distinct()
    id_, doc = row_key(docs)
    return docs.withColumns({"__id": id_, "__doc": doc}).join(bad, (F.col("__doc") == F.col("__bad")) & (F.col("__id") == F.col("__bad_id")), "left_anti").select(docs.columns)


def contamination_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contamination(docs, items).drop(*KEY)


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') AS w FROM benchmark),
b2 AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b2)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b2) WHERE len(w) >= k)),
m AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

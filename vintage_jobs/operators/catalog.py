"""Keyword searches over column catalogues and text lines, by an index of character grams.

A text can only hold a needle if it holds all of the needle's grams. So the grams of the texts are counted, each needle
takes its rarest one as anchor, texts and anchors meet in one equi join on the gram, and what meets is verified. No step
compares each text with each needle, and a needle with a gram that no text has is dropped before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintage_jobs.sources.store import stored

#: Lengths of grams; a needle has those of the greatest length that it reaches.
SIZES = (8, 4, 2, 1)


def grams(text: Column, sizes: list[int]) -> Column:
    """The distinct runs of so many characters of a text, linear in it; none where it is shorter.

    A lookahead finds a run at each place. Within a character of two code units it finds one more run, which a text has
    wherever a needle in it has it, so nothing is lost.
    """
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes)))


def contained(texts: DataFrame, needles: DataFrame, match_case: bool = True, small_side: int = 200_000) -> DataFrame:
    """The rows of ``texts`` (text, ...) with each row of ``needles`` (needle, ...; distinct needles) that their text holds.

    Up to ``small_side`` needles, which are counted, the anchors are broadcast and the texts stay where they are. Beyond,
    a hash of each text goes to the anchors by shuffle and comes back with the needles to verify. Null texts and needles
    hold nothing; the empty needle is in every text.
    """
    fold = (lambda c: c) if match_case else F.lower
    size = F.coalesce(*(F.when(F.char_length(fold(F.col("needle"))) >= s, F.lit(s)) for s in SIZES))
    of_needle = F.coalesce(*(F.when(F.col("size") == s, grams(fold(F.col("needle")), [s])) for s in SIZES))
    parts = stored(needles.where("needle <> ''").select("needle", size.alias("size")).select("needle", "size", F.explode(of_needle).alias("gram")), "needle-grams")
    used = [r[0] for r in parts.select("size").distinct().collect()]  # at most as many as SIZES
    of_text = F.explode(grams(fold(F.col("text")), used) if used else F.array().cast("array<string>"))

    seen = texts.select(of_text.alias("gram")).join(parts.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = parts.join(seen, "gram", "left").groupBy("needle").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("unseen"))
    anchors = stored(rarest.where("unseen = 0").select("needle", "gram").join(needles, "needle"), "anchors")
    holds = fold(F.col("text")).contains(fold(F.col("needle")))
    if anchors.limit(small_side + 1).count() <= small_side:
        found = texts.withColumn("gram", of_text).join(F.broadcast(anchors), "gram").where(holds).drop("gram")
    else:
        met = texts.select(F.xxhash64("text").alias("key"), of_text.alias("gram")).distinct().join(anchors, "gram").drop("gram")
        found = texts.withColumn("key", F.xxhash64("text")).join(met, "key").where(holds).drop("key")
    for empty in needles.where("needle = ''").collect():  # one row at most
        more = texts.where("text IS NOT NULL").select("*", *(F.lit(v).cast(needles.schema[c].dataType).alias(c) for c, v in empty.asDict().items()))
        found = found.unionByName(more)
    return found


def header_matches(catalog: DataFrame, keywords: DataFrame, match_case: bool = False, small_side: int = 200_000, rows_a_task: int = 10_000) -> DataFrame:
    """file, folder, keyword, column_name: the first column of each file that contains each keyword.

    Keywords meet a dictionary of the distinct columns, whatever the number of files; its matches are joined back. A row
    of the catalogue becomes many matches, which are sorted: so the counted rows are dealt by file, ``rows_a_task`` at a
    time, and what a task holds stays the same however long the catalogue is.
    """

    def cells(rows: DataFrame) -> DataFrame:
        parts = F.posexplode(F.split("header", F.concat(F.lit("\\Q"), F.col("sep"), F.lit("\\E")))).alias("place", "cell")
        return rows.select("file", "folder", parts).select("file", "folder", "place", F.trim("cell").alias("column_name"))

    texts = cells(catalog).select(F.col("column_name").alias("text")).distinct()
    found = contained(texts, keywords.select(F.col("keyword").alias("needle")).distinct(), match_case, small_side)
    matches = stored(found.select(F.col("text").alias("column_name"), F.col("needle").alias("keyword")), "header-matches")
    tasks = max(1, -(-catalog.count() // rows_a_task))
    if matches.limit(small_side + 1).count() <= small_side:
        hits = cells(catalog.repartition(tasks, "file", "folder")).join(F.broadcast(matches), "column_name")
    else:
        hits = cells(catalog).join(matches, "column_name").repartition(tasks, "file", "folder")
    return hits.groupBy("file", "folder", "keyword").agg(F.min_by("column_name", "place").alias("column_name"))


def least_needles(needles: DataFrame, match_case: bool = True, small_side: int = 200_000) -> DataFrame:
    """The rows of ``needles`` (needle, why) without those that hold another one whose why is no later.

    A line with such a needle has the other one too, so the least why of each line stays the same.
    """
    fold = (lambda c: c) if match_case else F.lower
    rank = lambda needle: F.struct(F.char_length(fold(F.col(needle))), F.col(needle))
    held = contained(needles.select(F.col("needle").alias("text"), F.col("why").alias("own")), needles, match_case, small_side)
    later = held.where((F.col("why") < F.col("own")) | ((F.col("why") == F.col("own")) & (rank("needle") < rank("text"))))
    return needles.join(later.select(F.col("text").alias("needle")).distinct(), "needle", "left_anti")


def line_matches(lines: DataFrame, needles: DataFrame, match_case: bool = True, small_side: int = 200_000, direct: int = 256) -> DataFrame:
    """file, line_no, line, why: each line that contains a needle, once, with the first reason in sort order.

    Only needles that can give a first reason are searched (``least_needles``). The first ``direct`` of them by reason are
    tried in that order, and a line ends at the first it holds. Lines that hold none of these go to the index of the others.
    """
    fold = (lambda c: c) if match_case else F.lower
    needles = needles.where("needle IS NOT NULL").groupBy("needle").agg(F.min("why").alias("why"))
    needles = stored(least_needles(stored(needles, "needles"), match_case, small_side), "least-needles")
    first = needles.where("why IS NOT NULL").orderBy("why", "needle").limit(direct).collect()
    tried = [F.when(F.col("folded").contains(fold(F.lit(r.needle))), F.lit(r.why)) for r in first]
    why = F.coalesce(*tried) if tried else F.lit(None).cast(needles.schema["why"].dataType)
    # the copies of a row are one; its reason follows from its line
    rows = lines.select("file", "line_no", "line").distinct().withColumn("folded", fold(F.col("line"))).withColumn("why", why).drop("folded")
    settled = rows.where("why IS NOT NULL")
    others = needles.join(needles.sparkSession.createDataFrame([(r.needle,) for r in first], "needle string"), "needle", "left_anti") if first else needles
    if others.isEmpty():
        return settled
    # each different line is searched once, in the task that its copies go to
    left = stored(rows.where("why IS NULL").drop("why"), "open-lines")
    texts = stored(left.select(F.col("line").alias("text")).distinct(), "lines")  # read twice
    reasons = contained(texts, others, match_case, small_side).groupBy(F.col("text").alias("line")).agg(F.min("why").alias("why"))
    return settled.unionByName(left.join(reasons, "line").select("file", "line_no", "line", "why"))


def text_lines(documents: DataFrame, file: str = "doc_id", text: str = "text") -> DataFrame:
    return documents.select(F.col(file).cast("string").alias("file"), F.posexplode(F.split(text, "\n")).alias("place", "line")).select("file", (F.col("place") + 1).alias("line_no"), "line")


def text_words(texts: DataFrame, why: Column, text: str = "text") -> DataFrame:
    """needle, why: the distinct words and the whole lines of each text."""
    lines = F.split(text, "\n")
    return texts.select(why.alias("why"), F.explode(F.array_distinct(F.concat(lines, F.split(text, r"\s+")))).alias("needle")).where("needle <> ''").select("needle", "why")

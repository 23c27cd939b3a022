"""Line de-duplication: suffix ranks of line sequences by prefix doubling, LCP intervals, later copies deleted.

The lines with a word of every document form a sequence of line ids; documents are separated by what never matches. Ranks of
the first 2^k lines of every suffix are made from ranks of 2^(k-1) lines, as in the construction of a suffix
array; suffixes whose first 2^k lines stand nowhere else are settled and leave. Walking down the powers then builds the
tree of LCP intervals: all suffixes that share their first t lines, with the earliest of them. The longest match of a line with
an earlier place is the longest interval in which it is not the earliest. Matches are deleted, so of each maximal repeated run
the first copy stays; a caller may ask for a least number of words.

A rank is the earliest place with those lines, so ranks are exact and need no global sort. All grouping is pre-aggregated;
a line in a third of all places is a skewed join, not a group held by one task.

Defined results: places are ordered by doc_id (null first), then text hash, then line. A row that repeats another row whole
(id and text) is the same document and gets the same result. Null and empty texts have no lines. Lines without a
word take no part and stay.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, cut

#: Words of a repeated run that is deleted: with one, all of them are.
MIN_WORDS = 1
LONGEST = 40  # doublings; a run of 2^40 lines is out of reach


def row_key(docs: DataFrame) -> Column:
    parts = F.coalesce(docs["doc_id"].cast("string"), F.lit("null")), docs["text"].isNull().cast("string"), F.coalesce(docs["text"], F.lit(""))
    return F.unhex(F.md5(F.concat_ws(":", *parts)))


def line_places(docs: DataFrame) -> DataFrame:
    """(at, line): a row for each line with a word; ``at`` is the place (doc, key, pos) and sorts by age."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select("doc_id", row_key(docs).alias("key"), F.transform(lines, lambda x: F.unhex(F.md5(x))).alias("lines"))
    rows = rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), "key", F.posexplode("lines").alias("pos", "line"))
    return rows.select(F.struct("doc", "key", "pos").alias("at"), "line").dropDuplicates(["at"])


def ranks(places: DataFrame) -> list[DataFrame]:
    """For k = 0, 1, ... the places whose next 2^k lines stand elsewhere too, with their rank (at, rank)."""
    named = places.withColumnRenamed("line", "name")
    out = []
    for k in range(LONGEST):
        groups = named.groupBy("name").agg(F.min("at").alias("rank"), F.count("*").alias("n")).filter("n > 1")
        level = cut(named.join(groups, "name").select("at", "rank"), "ranks")
        if level.isEmpty():
            break
        out.append(level)
        ahead = level.select(_moved(F.col("at"), -(1 << k)).alias("at"), F.col("rank").alias("next"))
        named = level.join(ahead, "at").select("at", F.struct("rank", "next").alias("name"))
    return out


def _moved(at: Column, by: Column | int) -> Column:
    return F.struct(at["doc"].alias("doc"), at["key"].alias("key"), (at["pos"] + by).alias("pos"))


def longest_earlier(places: DataFrame) -> DataFrame:
    """(at, length) of the places whose next lines also stand earlier, with the greatest such number of lines."""
    levels = ranks(places)
    if not levels:
        return places.select("at", F.lit(0).alias("length")).limit(0)
    # an interval is (first, t): suffixes that share t lines, the earliest of them; at the start all share none
    root = F.struct(F.lit(0).cast("long").alias("doc"), F.unhex(F.lit("")).alias("key"), F.lit(-1).alias("pos"))
    now = levels[0].select("at", root.alias("first"), F.lit(0).alias("t"), F.lit(0).alias("length"))
    for k in range(len(levels) - 1, -1, -1):
        step = levels[k].select(F.col("at").alias("end"), "rank")
        rows = now.withColumn("end", _moved(F.col("at"), F.col("t"))).join(step, "end", "left").drop("end")
        groups = rows.filter("rank IS NOT NULL").groupBy("first", "t", "rank").agg(F.min("at").alias("low"), F.count("*").alias("n"))
        # those who leave have no rank; each gets a key of its own, as a common null would be one key for nearly all
        own = F.struct(F.col("at.doc").alias("doc"), F.col("at.key").alias("key"), (-1 - F.col("at.pos")).alias("pos"))
        rows = rows.withColumn("rank", F.coalesce("rank", own)).join(groups.filter("n > 1"), ["first", "t", "rank"], "left")
        longer = F.col("t") + (1 << k)
        # a suffix moves to the longer interval; its earliest member also stays to witness for those left behind
        moved = F.struct(
            F.col("low").alias("first"), longer.alias("t"),
            F.when(F.col("at") > F.col("low"), F.greatest("length", longer)).otherwise(F.col("length")).alias("length"),
        )
        stay = F.struct("first", "t", "length")
        both = F.when(F.col("low").isNull(), F.array(stay)).when(F.col("at") == F.col("low"), F.array(moved, stay)).otherwise(F.array(moved))
        now = cut(rows.select("at", F.explode(both).alias("s")).select("at", "s.first", "s.t", "s.length"), "intervals")
    return now.groupBy("at").agg(F.max("length").alias("length")).filter("length > 0")


def _strip(text: str | None, starts, lengths, min_words: int) -> tuple[str | None, int, int, str]:
    """The text without later copies, its lines with a word, how many went, and which (line numbers, end exclusive)."""
    lines = (text or "").split("\n")
    full = [i for i, line in enumerate(lines) if line.strip(SPACE_CHARS)]
    if starts is None or not len(starts):
        return text, len(full), 0, ""
    gone, reach = set(), 0
    for p, n in sorted(zip(starts, lengths, strict=True)):
        # a line taking part has a word; encoded, only the six ASCII spaces part words
        if n >= min_words or sum(len(lines[i].encode("utf-8", "surrogatepass").split()) for i in full[p : p + n]) >= min_words:
            gone.update(full[max(p, reach) : p + n])
            reach = max(reach, p + n)
    spans: list[list[int]] = []
    for i in sorted(gone):
        if spans and spans[-1][1] == i:
            spans[-1][1] = i + 1
        else:
            spans.append([i, i + 1])
    kept = "\n".join(line for i, line in enumerate(lines) if i not in gone) if gone else text
    return kept, len(full), len(gone), ",".join(f"{a}-{b}" for a, b in spans)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text, ...) and a struct ``deduped``: text, n_lines, n_removed, removed.

    ``deduped`` is the name of the added column; a column of that name in ``docs`` is replaced.
    """
    runs = longest_earlier(line_places(docs.select("doc_id", "text")))
    runs = runs.groupBy(F.col("at.key").alias("__key")).agg(
        F.collect_list("at.pos").alias("__starts"), F.collect_list("length").alias("__lengths")
    )

    def clean(texts: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.DataFrame:
        rows = [_strip(*row, min_words) for row in zip(texts, starts, lengths, strict=True)]
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_removed", "removed"])

    clean = F.pandas_udf(clean, "text string, n_lines long, n_removed long, removed string")
    rows = docs.withColumn("__key", row_key(docs)).join(runs, "__key", "left")
    rows = rows.withColumn("deduped", clean("text", "__starts", "__lengths"))
    return rows.drop("__key", "__starts", "__lengths")
